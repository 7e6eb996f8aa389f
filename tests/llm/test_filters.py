"""URL filters, personal data and quality scores against plain code and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.fixtures import frame, rows
from tidewater.llm import pii, quality, urlfilter

URLS = [
    None, "", "example.net/en/", "http://", "http://net", "http://net/", "HTTP://NET/x", "http://a.net/x?y#z", "http://anet/x", "https://www.Example.NET/en/1?q", "http://example.net/enx", "http://example.net/en/",
    "http://example.com/de/9", "http://example.com/de", "http://x.example.com/de/?a", "http://badexample.com/de/", "http://fr.org/fr/", "ftp://a.b.org/fr/fr/?", "http://org?/fr/", "http://a..net//", "http://.net/a", "x://y://net/",
    "http://example.net#/en/", "http://example.net:80/en/", "http://u@example.net/en/", "http://net./", "http://ÉX.net/\n/é", "http://\n.net/a",
]


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    data = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(3, URLS[7], "x", "y", "z"), (None, URLS[9], None, None, None), (None, URLS[9], None, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, rule string, verdict string")
    got = Counter(tuple(r) for r in urlfilter.judge_urls(pages).collect())
    assert got == Counter((r[0], *plain_verdict(r[1])) for r in data)
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    none = urlfilter.judge_urls(pages, spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string"))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_many_rules(spark):
    rules = [(f"h{i}.net", f"/{'p' * (i % 7)}", "block" if i % 2 else "allow") for i in range(5000)]
    table = urlfilter.rules_table(spark, rules)
    urls = [(i, f"http://www.h{i * 3}.net/pppp{'p' * (i % 4)}/x") for i in range(3000)]
    held = {h: (p, v) for h, p, v in rules}
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    for i, u in urls:
        p, v = held.get(f"h{i * 3}.net", (None, None))
        fits = p is not None and u.split(".net", 1)[1].startswith(p)
        assert got[i] == ((f"h{i * 3}.net{p}", v) if fits else (None, "allow"))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        if kind == "email" and "@" not in (text or ""):
            continue
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


PII = [
    "a@b.c_x@d.e a@b..c a@@b.c @b.c é@b.c😀 +x@y-z.q-r.s1 a@b.c.d.", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.2.3 1..2.3.4 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111111111111111 5 4111-1111-1111-1111-2 378282246310005 3782 822463 10005 1 2 3", "+1 (555) 123-4567 +15551234567. +1) +12 +123456789 +1234567890123456 ++49 30 1234567 8)",
    "IBAN DE89370400440532013000 account DE89 3704 0044 0532 0130 00, DE88370400440532013000 ssn 123-45-6789 123-45-6780", "9" * 4_000, "a" * 50_000 + "@b.c", "x@" + "a." * 30_000 + "b", "+1" + "2 " * 30_000, "1-" * 20_000, "é 4111 1111 1111 1111, a@b.cd +15551234567.",
]


def test_personal_data(spark):
    data = rows() + [(1000 + i, t, None, None, None, *[None] * 5) for i, t in enumerate(PII)]
    got = pii.span_digests(frame(spark, data)).collect()
    want = Counter()
    for r in data:
        s = plain_spans(r[1])
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in s)
        n = Counter(x[3] for x in s)
        want[r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(line.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[1004].spans.count("iban") == 2 and by_id[1004].spans.count("ssn") == 2
    text = pii.redact(frame(spark, data)).where("doc_id = 1010").first().text
    assert text == "é [card], [email] [phone]."
    assert pii.span_digests(frame(spark, [])).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[x.doc_id], x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    swapped = quality.classify(docs.selectExpr("doc_id", "text", "'x' lang", "'y' source"), labels)
    assert {r.doc_id: r.score for r in swapped.collect()} == {i: r.score for i, r in got.items()}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark), labels)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows())
    assert quality.classify(frame(spark), labels.limit(0)).agg({"score": "max"}).first()[0] == 0.5
    assert quality.classify(frame(spark, []), labels).count() == 0
    kept = quality.keep_good(frame(spark), labels)
    assert kept.columns == frame(spark).columns


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    n = len(quality.NAMES)
    model = quality.Model(np.zeros(n), np.ones(n), features=20_000)
    x = rng.normal(0, 1, (40, n))
    phi = model.phi(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-gap / (2 * quality.WIDTH**2 * n / 8))
    assert np.abs(phi @ phi.T - kernel).max() < 0.05


def plain_isotonic(p, n):
    """The monotone fit by its minimax formula: of every place, the largest over starts of the smallest mean over ends."""
    mean = lambda i, j: p[i : j + 1].sum() / n[i : j + 1].sum()
    return [max(min(mean(i, j) for j in range(k, len(p))) for i in range(k + 1)) for k in range(len(p))]


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0.0, 2, 1, 3, 2, 4]), np.full(6, 4.0))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    assert np.isclose(y, [0, 0.375, 0.625, 1]).all()
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 30, 40).astype(float)
        p = np.round(rng.uniform(0, 1, 40) * n)
        x, y = quality.isotonic(np.arange(40.0), p, n)
        assert np.allclose(sorted(set(np.round(plain_isotonic(p, n), 9))), np.round(y, 9))


def test_scores_equal_a_dense_fit(spark):
    """The model fitted again without Spark, from the same rows: weights by a dense solve, calibration bin by bin, a score per text."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    x = {r.doc_id: np.array(quality.statistics(r.text or "")) for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in y}
    tune, hold = ([i for i in y if i in x and fold[i] in of] for of in ((1, 2, 3), (4,)))
    a = np.array([x[i] for i in tune])
    model = quality.Model(np.round(a.mean(axis=0), 9), np.round(a.std(axis=0), 9))
    phi, target = model.phi(a), np.array([y[i] for i in tune], float)
    penalty = np.diag([quality.PENALTY * len(tune)] * quality.FEATURES + [1e-9])
    beta = np.linalg.lstsq(np.vstack([phi, np.sqrt(penalty)]), np.concatenate([target, np.zeros(len(penalty))]), rcond=None)[0]
    raw = {i: float(model.phi(v[None])[0] @ beta) for i, v in x.items()}
    bins = {}
    for i in hold or tune:
        b = min(max(int((raw[i] + 0.5) / 2 * quality.BINS), 0), quality.BINS - 1)
        s = bins.setdefault(b, [0.0, 0, 0])
        bins[b] = [s[0] + raw[i], s[1] + y[i], s[2] + 1]
    order = [bins[b] for b in sorted(bins)]
    share = plain_isotonic(np.array([s[1] for s in order], float), np.array([s[2] for s in order], float))
    knots = {}
    for s, v in zip(order, share):
        k = knots.setdefault(round(v, 9), [0.0, 0])
        knots[round(v, 9)] = [k[0] + s[0], k[1] + s[2]]
    at, value = [k[0] / k[1] for k in knots.values()], list(knots)
    at, value = [-1.0, *at, 2.0], [max(0.0, value[0] - 1e-3), *value, min(1.0, value[-1] + 1e-3)]
    assert len(got) == len(x)
    assert all(abs(got[i] - min(1.0, max(0.0, np.interp(raw[i], at, value)))) < 1e-4 for i in x)
