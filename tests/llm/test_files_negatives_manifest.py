"""Token files, hard negatives and the Merkle manifest against plain code."""

import glob
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from tests.llm.fixtures import frame, rows
from tests.llm.test_tokens_media import every_character, texts
from tidewater.llm import frames, merkle, negatives, queries, wordids
from tidewater.llm.vocab import tokenizer_file

ENDLESS = 2**63


def library(name=frames.FILE):
    return Tokenizer.from_file(tokenizer_file(name))


def encoder(name=frames.FILE):
    with open(tokenizer_file(name), "rb") as f:
        return wordids.WordIds(f.read())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    lib, own, values = library(name), encoder(name), texts()
    assert own.by_words == name.startswith("word")
    got = own.encode(pa.array([*values, None]))
    assert got[-1] == b"" and [np.frombuffer(x, own.kind).tolist() for x in got[:-1]] == [lib.encode(t, add_special_tokens=False).ids for t in values]


def test_ids_of_every_character():
    lib, own, values = library(), encoder(), every_character()[::3]
    values = [v.replace("!", " ! ") for v in values]
    got = own.encode(pa.array(values))
    assert [np.frombuffer(x, own.kind).tolist() for x in got] == [x.ids for x in lib.encode_batch(values, add_special_tokens=False)]


def test_pieces_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(wordids, "REMEMBER", 50)
    lib, own = library(), encoder()
    for _ in range(2):
        for t in texts()[:200]:
            assert np.frombuffer(own.encode(pa.array([t]))[0], own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(own.older) > 0


def in_order(found):
    """(doc_id, start, n_tokens, crc32) by plain code."""
    lib, out, start = library(), [], 0
    for i, text in sorted(found, key=lambda r: -ENDLESS if r[0] is None else r[0]):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, frames.END], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    """Null, empty and long texts, repeated and null ids, columns with clashing names."""
    got = sorted((tuple(r) for r in frames.token_files(frame(spark), str(tmp_path / "a")).collect()), key=lambda r: r[1])
    want = in_order([r[:2] for r in rows()])
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, n, c) for i, _, n, c in want)
    assert [r[0] for r in got] == [r[0] for r in want] and got[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert frames.token_files(frame(spark, []), str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception, match="holds token files already"):
        frames.write_tokens(frame(spark), str(tmp_path / "a"))


def test_an_id_that_fills_several_files_is_spread(spark, tmp_path):
    path = str(tmp_path / "hot")
    docs = spark.createDataFrame([(7 if i % 3 else i, f"text {i}") for i in range(300)], "doc_id long, text string").repartition(3)
    got = frames.token_files(docs, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(7 if i % 3 else i for i in range(300))
    assert len(glob.glob(f"{path}/part-*")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_frames_asked_for_are_opened(spark, tmp_path):
    path = str(tmp_path / "f")
    docs = spark.createDataFrame([(i, "word " * (1 + i % 50)) for i in range(400)] + [(1000, "long text " * 5000)], "doc_id long, text string").coalesce(1)
    frames.write_tokens(docs, path, frame=512)
    want = {i: (i, s, n, c) for i, s, n, c in in_order([tuple(r) for r in docs.collect()])}
    asked = spark.createDataFrame([(3,), (3,), (399,), (1000,), (5555,), (None,)], "doc_id long")
    found = frames.fetch(spark, path, asked).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found) == [want[3], want[399], want[1000]]
    name = sorted(glob.glob(f"{path}/part-*"))[0]
    with open(name, "rb") as f:
        data = f.read()
    source = frames.FrameFile(pa.BufferReader(data))
    assert len(source.sums) > 5
    begin = np.concatenate([[0], np.cumsum(source.counts)])
    source.tokens(int(begin[3]), int(source.counts[3]))
    assert source.opened <= 2
    # any zstandard reader gives the same ids: what is not a frame of theirs can be skipped
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == source.tokens(0, int(begin[-1]))
    hurt = bytearray(data)
    hurt[source.at[1] + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.FrameFile(pa.BufferReader(bytes(hurt))).tokens(0, int(begin[-1]))
    wrong = bytearray(data)
    wrong[-9 - 12 * len(source.sums) + 8] ^= 1  # the checksum of the first frame
    with pytest.raises(ValueError, match="checksum"):
        frames.FrameFile(pa.BufferReader(bytes(wrong))).tokens(0, 1)
    with pytest.raises(ValueError, match="no seek table"):
        frames.FrameFile(pa.BufferReader(data[:-1]))
    (tmp_path / "f" / "part-000000-left-by-a-failed-task.zst").write_bytes(data)
    assert frames.read_tokens(spark, path).count() == 401


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for dims, bound in ((64, 70_000), (1, 5), (3, 1 << 59), (1000, 1 << 50)):
        primes, half = negatives.primes_for(dims, bound), int((bound / dims) ** 0.5)
        a, b = (rng.integers(-half, half + 1, (n, dims)) for n in (9, 20))
        a[0] = b[0] = half
        b[1] = -half
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert negatives.scores(negatives.Residues(a, primes), negatives.Residues(b, primes), primes).tolist() == want
        assert min(dims, negatives.SPAN) * ((primes[0] - 1) // 2) ** 2 < 1 << 24 and math.prod(primes) > 2 * bound


def mined(found):
    own = []
    for i, v, label in found:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        own.append((i, [math.floor(256 * c) for c in v], label))
    key = lambda i: -ENDLESS if i is None else i
    table = np.zeros((len(own), max((len(v) for _, v, _ in own), default=0)), np.int64)
    for k, (_, v, _) in enumerate(own):
        table[k, : len(v)] = v
    out = Counter()
    for a, (i, _, label) in enumerate(own):
        if i is None or i % 100:
            continue
        s = table @ table[a]
        order = sorted(range(len(own)), key=lambda k: (-s[k], key(own[k][0])))
        for p in [k for k in order if k != a and own[k][2] == label][:5]:
            fits = [k for k in order if own[k][2] != label and 80 * s[p] <= 100 * s[k] <= 100 * s[p]][:5]
            out.update((i, own[p][0], r, own[k][0], int(s[p]), int(s[k])) for r, k in enumerate(fits, 1))
    return out


HARD = [
    (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [0.5], 1), (None, [1.0, 1.9], 1), (5, [1.0, 1.5], 2), (6, [1.0, 1.5], 2), (7, [1.0, 1.5], 9), (8, None, 1), (9, [None, 1.0], 1),
    (10, [float("nan"), 1.0], 1), (11, [float("inf")], 2), (12, [1.0, 1.6], None), (200, [-1.0, -2.0], 1), (300, [], 1), (13, [0.9, 1.7], 3), (14, [0.9, 1.7], 3), (14, [0.9, 1.7], 3),
    (-100, [1.0, 2.0], -4), (400, [1.0, 1.0], 5),
]


@pytest.mark.parametrize("block", [2, 2048])
def test_negatives(spark, small, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    schema = "vec_id long, embedding array<float>, label int, row string, id string, v string"
    hard = spark.createDataFrame([(*r, "x", "y", "z") for r in HARD], schema)
    assert Counter(tuple(r) for r in negatives.mine(hard).collect()) == mined(HARD)
    assert negatives.mine(hard.limit(0)).count() == 0
    real = spark.read.parquet(f"{small}/embeddings.parquet").limit(250)
    got = Counter(tuple(r) for r in negatives.mine(real).collect())
    assert got == mined([(r.vec_id, r.embedding, r.label) for r in real.collect()]) and len(got) > 20


def test_rows_whose_scores_need_not_fit_take_no_part(spark):
    huge = spark.createDataFrame([(100, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (3, [1e30, 1.0], 2), (4, [3e6, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert {r.negative_id for r in negatives.mine(huge).collect()} == {2}


def sealed(row, more=0):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row[:5]
    return merkle.digest(*map(value, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def proved(found):
    def grown(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([merkle.digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    by_lang = defaultdict(list)
    for r in found:
        by_lang[r[2]].append((-ENDLESS if r[0] is None else r[0], sealed(r), r))
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    each = {k: sorted(by_lang[k], key=lambda x: x[:2]) for k in langs}
    trees = {k: grown([x[1] for x in each[k]]) for k in langs}
    top, out = grown([trees[k][-1][0] for k in langs]), Counter()
    for place, k in enumerate(langs):
        for i, (_, leaf, r) in enumerate(each[k]):
            path = []
            for tree, at in ((trees[k], i), (top, place)):
                for level in tree[:-1]:
                    path.append((level[at ^ 1] if at ^ 1 < len(level) else "", at & 1))
                    at >>= 1
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = sealed(r, 1) if bad else leaf
            for s, left in path:
                now = merkle.digest(s, now) if left else merkle.digest(now, s)
            out[r[0], leaf, trees[k][-1][0], top[-1][0], merkle.digest(*[s for s, _ in path]), now, now == top[-1][0]] += 1
    return out


LANGS = [None, "", "en", "de", "zu", "é", "Z"]


@pytest.mark.parametrize("blocks", [1, 2, 12])
def test_manifest(spark, blocks):
    some = [(*r[:2], LANGS[i % 7] if i % 2 else "en", r[3], i if i % 3 else None, *r[5:]) for i, r in enumerate(rows())]
    some += [some[5]] * 9
    got = Counter(tuple(r) for r in merkle.verify_documents(frame(spark, some), blocks=blocks).collect())
    assert got == proved(some) and not all(r[-1] for r in got)
    assert merkle.verify_documents(frame(spark, []), blocks=blocks).count() == 0
    one = [(1, "t", "en", None, 5, *["x"] * 5)]
    assert Counter(tuple(r) for r in merkle.verify_documents(frame(spark, one), blocks=blocks).collect()) == proved(one)


def test_missing_nodes_are_the_fewest():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 29):
        for _ in range(20):
            own = np.unique(rng.integers(0, n, rng.integers(1, n + 1)))
            got, size, known, want = set(merkle.missing(own, n)), n, set(own.tolist()), set()
            level = 0
            while size > 1:
                want |= {(level, i ^ 1) for i in known if i ^ 1 < size and i ^ 1 not in known}
                known, size, level = {i >> 1 for i in known}, (size + 1) // 2, level + 1
            assert got == want
            leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
            whole = merkle.Branch(0, leaves, n, {})
            at = int(own[0])
            alone = merkle.Branch(at, [leaves[at]], n, {(lv, i): whole.node(lv, i) for lv, i in merkle.missing(own[:1], n)})
            assert alone.root == whole.root == merkle.folded(leaves[at], alone.proof(at)) and alone.proof(at) == whole.proof(at)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_merkle_manifest"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, small).select(*columns).collect()) == Counter(found.fetchall())
