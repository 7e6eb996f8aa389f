"""SimHash, exact dedup, sharding and mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import frame, rows
from tidewater.llm import dedup, mixing, sharding, simhash
from tidewater.llm.common import ROW, numbered
from tidewater.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[find(i)].append(ids[i])
    return [min(low[find(i)], key=lambda x: -(2**63) if x is None else x) for i in range(len(ids))]


def test_near_duplicates(spark):
    data = rows()
    fps = [plain_fingerprint(r[1]) for r in data]
    want = Counter(zip([r[0] for r in data], [f"{x:016x}" for x in fps], plain_components([r[0] for r in data], fps)))
    got = simhash.near_duplicates(frame(spark)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_in_hot_keys_and_chains(spark):
    rng = np.random.default_rng(3)
    fps, fp = [], 0x0123456789ABCDEF
    for _ in range(300):  # a chain, each 3 bits from the last
        for b in rng.choice(64, 3, replace=False):
            fp ^= 1 << int(b)
        fps.append(fp)
    hot = 0xFFFF0000FFFF0000
    fps += list({hot ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(1500)})
    fps += [int(x) for x in rng.integers(0, 2**63, 400)]
    fps = list(dict.fromkeys(fps))
    want = plain_components(list(range(len(fps))), fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    links = simhash.links(table, block=128)
    assert links.count() < 40 * len(fps)
    roots = {r.node: r.root for r in components(links).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == want


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)] + [(900, 900 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400} | {900 + i: 900 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_groups(texts, least=0.8):
    """The first index of each text's group: chains of Jaccard similarity over sets of shingles."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and sets[j] and len(x & sets[j]) >= least * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts():
    """Texts with copies that differ in one to sixty words, chains of them, and many near copies of one text."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    out = []
    for n in (6, 12, 40, 150, 400, 1500):
        for _ in range(6):
            base = prose(n)
            out.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.06):
                at = set(rnd.sample(range(n), max(1, int(n * share))))
                out.append(" ".join(rnd.choice(words) if i in at else w for i, w in enumerate(base)))
    hot = prose(120)
    for _ in range(700):
        k = rnd.randrange(120)
        out.append(" ".join([*hot[:k], rnd.choice(words), *hot[k + 1 :]]))
    return out + [" ".join(prose(rnd.randint(1, 80))) for _ in range(300)] + ["", None, " \n", "a", "A", "a b", "A  b"]


def test_alike_equals_brute_force(spark):
    texts = near_texts()
    docs = frame(spark, [(i, t, None, None, None, *["x"] * 5) for i, t in enumerate(texts)])
    want = plain_groups(texts)
    found = simhash.alike(numbered(docs)).collect()
    first = {r.group: r.id for r in found if r.stays}
    got = {r.id: first[r.group] for r in found}
    assert len(got) == len(texts) and len(first) == sum(r.stays for r in found) == len({r.group for r in found})
    assert all(first[g] == min(i for i in got if got[i] == first[g]) for g in first)
    # every link found is right: no group joins two groups of the brute force
    assert all(want[i] == want[got[i]] for i in got)
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs) > 1000


def test_keep_apart(spark):
    data = rows()
    groups = plain_groups([r[1] for r in data])
    order = lambda r: -(2**63) if r[0] is None else r[0]
    best = {}
    for g, r in zip(groups, data):
        best[g] = min(best.get(g, r), r, key=order)
    kept = simhash.keep_apart(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter((r.doc_id, shingle_set(r.text)) for r in kept.collect()) == Counter((r[0], shingle_set(r[1])) for r in best.values())
    assert simhash.keep_apart(frame(spark, [])).count() == 0


def test_rows_of_files_and_of_frames_are_numbered(spark, small):
    files, frames = spark.read.parquet(f"{small}/documents.parquet"), frame(spark)
    for docs in (files, frames, files.union(files), files.where("doc_id < 50"), files.limit(7)):
        got = numbered(docs)
        assert got.columns == [*docs.columns, *ROW]
        assert got.select(*ROW).distinct().count() == docs.count()
    assert numbered(files).drop("text").subtract(numbered(files).drop("text")).isEmpty()


def test_blocks_of_a_hot_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS", 8)
    texts = near_texts()[200:320]
    docs = frame(spark, [(i, t, None, None, None, *["x"] * 5) for i, t in enumerate(texts)])
    assert simhash.keep_apart(docs).count() == len(set(plain_groups(texts)))


def plain_exact():
    groups = defaultdict(list)
    for r in rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    order = lambda r: (-len(r[1] or ""), -(2**63) if r[0] is None else r[0])
    return {t: (min(g, key=order)[0], len(g)) for t, g in groups.items()}


def test_exact_duplicates(spark):
    best = plain_exact()
    want = Counter()
    for r in rows():
        t = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        keep, n = best[t]
        want[r[0], keep, n, r[0] == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in dedup.exact_duplicates(frame(spark)).collect()) == want
    assert dedup.exact_duplicates(frame(spark, [])).count() == 0
    kept = dedup.keep_distinct(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in best.values())


def test_index_grows(spark):
    index = dedup.DigestIndex(spark)
    docs = frame(spark)
    first = dedup.keep_distinct(docs.where("doc_id < 40"), index=index).count()
    second = dedup.keep_distinct(docs, index=index).count()
    third = dedup.keep_distinct(docs, index=index).count()
    assert first + second == len(plain_exact()) and third == 0
    assert index.table().count() == len(plain_exact())


def test_index_is_opened_again_at_its_path(spark, tmp_path):
    path, docs = f"file://{tmp_path}/digests", frame(spark)
    first = dedup.keep_distinct(docs.where("doc_id < 40"), index=dedup.DigestIndex(spark, path, buckets=3)).count()
    index = dedup.DigestIndex(spark, path, buckets=5)
    assert index.buckets == 3 and index.table().count() == first > 0
    second = dedup.keep_distinct(docs, index=index).count()
    again = dedup.DigestIndex(spark, path)
    assert again.table().count() == first + second == len(plain_exact())
    assert dedup.keep_distinct(docs, index=again).count() == 0
    found = dedup.exact_duplicates(docs, index=dedup.DigestIndex(spark, path)).collect()
    assert len(found) == len(rows()) and len({r.text_sha256 for r in found}) == len(plain_exact())
    assert "SelectedBucketsCount: 3 out of 3" in again.table().groupBy("digest").count()._jdf.queryExecution().toString()


def test_index_without_its_bucket_count_is_not_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/digests"
    spark.createDataFrame([("x", 1, 1)], dedup.SCHEMA).write.parquet(path)
    with pytest.raises(ValueError):
        dedup.DigestIndex(spark, path)
    assert spark.read.parquet(path).count() == 1


def test_loads_of_an_index_equal_one(spark, tmp_path):
    docs, parts = frame(spark), 3
    found = []
    for loads in (1, parts):
        index = dedup.DigestIndex(spark, f"file://{tmp_path}/loads-{loads}")
        got = dedup.digests(docs)
        for i in range(loads):
            index.add(got.where(F.pmod(F.xxhash64("length", "id"), F.lit(loads)) == i), better=True)
        found.append(Counter((r.digest, r.keep_id) for r in index.entries().collect()))
        assert index.table().count() >= len(found[-1])
        index.close()
    best = plain_exact()
    assert found[0] == found[1] == Counter((hashlib.sha256(t.encode()).hexdigest(), -(2**63) if keep is None else keep) for t, (keep, _) in best.items())


def test_index_outlives_the_session_and_is_not_shuffled(spark, tmp_path):
    path, docs = f"file://{tmp_path}/digests", frame(spark)
    tables = lambda s: {t.name for t in s.catalog.listTables() if t.name.startswith("digests_")}
    before = tables(spark)
    index = dedup.DigestIndex(spark, path, buckets=4)
    n = dedup.keep_distinct(docs, index=index).count()
    index.close()
    assert tables(spark) == before
    other = dedup.DigestIndex(spark.newSession(), path)
    assert other.table().count() == n
    assert dedup.keep_distinct(docs, index=other).count() == 0
    new = spark.createDataFrame([("x", 1, 1)], dedup.SCHEMA)
    plan = other.fresh(new)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the new rows alone
    other.close()
    dedup.exact_duplicates(docs).count()
    assert tables(spark) == before


def test_sharding(spark):
    got = sharding.shard_documents(frame(spark)).collect()
    data = rows()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    for r in got:
        of[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_shards_are_even(spark):
    some = [(i, "w" * (1 + i * i % 997), None, "s", None, *["x"] * 5) for i in range(8000)]
    load = Counter()
    for r in sharding.shard_documents(frame(spark, some)).collect():
        load[r.shard] += r.size
    assert len(load) == 24 and max(load.values()) <= 1.01 * min(load.values())


def plain_schedule(sizes, shards):
    """Longest processing time, one group after the other: size -> shards of its groups, in ascending order."""
    loads, out = [0] * shards, defaultdict(list)
    for size in sorted(sizes, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        out[size].append(s)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_schedule_equals_a_plain_heap(seed):
    rnd = random.Random(seed)
    sizes = Counter(rnd.choice([9, 10, 11, 50, 1000, rnd.randint(9, 5000)]) for _ in range(3000)) + Counter({9: 2000, 10**6: 3})
    got = sharding.schedule(list(sizes.items()), 7)
    assert {k: [s for s, c in enumerate(v) for _ in range(c)] for k, v in got.items()} == plain_schedule(sizes.elements(), 7)


def test_every_group_is_placed_by_the_heap(spark):
    rnd = random.Random(3)
    texts = ["t" * rnd.randint(0, 60) + str(rnd.randrange(400)) for _ in range(3000)] + ["copy"] * 900 + [None] * 7
    got = sharding.shard_documents(frame(spark, [(i, t, None, None, None, *["x"] * 5) for i, t in enumerate(texts)])).collect()
    size, shard = Counter(), {}
    for r in got:
        t = texts[r.doc_id] or ""
        size[t] += r.size
        assert shard.setdefault(t, r.shard) == r.shard
    placed = defaultdict(list)
    for t in sorted(size, key=lambda t: hashlib.sha256(t.encode()).hexdigest()):
        placed[size[t]].append(shard[t])
    assert dict(placed) == plain_schedule(size.values(), 24)


def test_repeats_of_one_row_get_slots_of_their_own(spark):
    got = sharding.shard_documents(frame(spark, [(None, "same", None, None, None, *["x"] * 5)] * 500), shards=3).collect()
    assert sorted(r.slot for r in got) == list(range(500)) and {r.doc_id for r in got} == {None}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.remove(s)
        rest = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_mix(spark):
    data = rows()
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    got = mixing.mix(frame(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in data)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert got == mixing.mix(frame(spark)).collect() or Counter(got) == Counter(mixing.mix(frame(spark)).collect())
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None, None, None, *["x"] * 5)])).first().taken == 0


@pytest.mark.parametrize("seed", ["a", "b"])
def test_mix_comes_near(spark, seed):
    some = [(i, "w " * (1 + i * 7919 % 500), None, f"s{min(i % 7, 3)}", None, *["x"] * 5) for i in range(6000)]
    got = mixing.mix(frame(spark, some), seed=seed).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)
    assert mixing.take_mixed(frame(spark, some), seed=seed).count() == sum(r.copies for r in got)


def test_sizes_pass_the_driver_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HELD", 7)
    rnd = random.Random(3)
    sizes = [(8 + 3 * i, rnd.randint(1, 400)) for i in range(60)]
    got = {r["size"]: list(r["ends"]) for r in sharding._ends(spark.createDataFrame(sizes, "size long, n long").repartition(3), 5).collect()}
    assert got == {size: [sum(c[: k + 1]) for k in range(5)] for size, c in sharding.schedule(sizes, 5).items()}
