"""Rows that every operator on documents has to survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, size string, key string, band string"


def rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(400)
    near = base.split()
    texts = [None, "", " \t\n", "one", "One", "ONE two", "one\ttwo", base, base.upper(), base + " ", base.replace(" ", "\n"), prose(40_000), "x" * 200_000]
    for k in (3, 120, 250):
        near[k] = "changed"
        texts.append(" ".join(near))
    texts += [prose(rnd.randint(1, 300)) for _ in range(60)] + [prose(5)] * 9 + ["É\u0301 ﬁ ǅ İ Σ it's <|endoftext|> \U0001f600 123,456 a.b"]
    texts += ["mail a.b@c.example or +49 (30) 123-456-78, card 4111 1111 1111 1111, host 10.0.0.256 and 192.168.1.1.", "4111-1111-1111-1112 IBAN DE89 3704 0044 0532 0130 00 x@y.z_w@v.u"]
    sources = [None, "src0", "src0", "src0", "b", "ä", "a", ""]
    out = [(i, t, "en", rnd.choice(sources), None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return out + [(7, base, None, "src0", 3, *["y"] * 5), (None, base, None, None, None, *[None] * 5), (None, None, None, None, None, *[None] * 5), (-5, "one", None, "b", 1, *["y"] * 5)]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
