"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are compared only where they share a key. Within a key, fingerprints stand as vertical bit planes, 64 to
a word. A query adds one plane after the other to carry-save counters, which hold 64 distances at once, and leaves a
word as soon as all of it exceeds the radius. Keys with many fingerprints are dealt as pairs of blocks of bounded size, so
no task holds a whole hot key, and a task returns a spanning forest of the links it found, never all pairs.

Two ways to near duplicates share this. near_duplicates() links fingerprints within a small radius, and finds all of
these: radius + 2 bit blocks leave at least two blocks untouched by radius flipped bits, so every linked pair
shares the key of one of C(radius + 2, 2) block pairs. alike() links texts by the Jaccard similarity of their shingles. A similarity of
0.8 means some 10 of 64 bits, for which no key of fingerprint bits is selective, so its keys are bands of
minima of shingle hashes; the comparison with a wide radius drops what only shares a band, and what remains, dealt by
component, is compared once more with each hit checked exactly before it becomes a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import NULL_ID, ROW, cut, numbered, real_id, texts
from tidewater.llm.components import components

SHINGLE = 4
RADIUS = 4
#: Fingerprints in one block of a hot key.
BLOCK = 1024
#: (query, word) pairs that are compared at once.
LANES = 1 << 16
#: Texts alike share at least ALIKE of their WIDE-word shingles (Jaccard). A pair at 0.8 shares one of BANDS keys of ROWS minima
#: with probability 1 - (1 - 0.8 ** 6) ** 16 = 0.992, and lies within LOOSE bits with 0.997 (9.7 expected, deviation 2.9).
WIDE, ALIKE, ROWS, BANDS, LOOSE = 5, 0.8, 6, 16, 18
#: Texts in one block of a hot component, and characters that a task gathers before it compares.
TEXTS, GATHER = 256, 1 << 25


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included, as unsigned integers: fewer words than a shingle make one, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, digest, out = end - size, xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        ends = end[at + shingle - 1 : stop + shingle - 1] if len(words) >= shingle else end[-1:]
        out[at:stop] = [digest(line[a:b], seed) for a, b in zip(start[at:stop].tolist(), ends.tolist())]
    return out


def fold(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is set where over half the hashes set it; of no hashes zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the shingles of a text."""
    return fold(shingle_hashes(text, shingle, seed))


#: Odd factors, each of which orders hashes anew; drawn from a fixed seed.
ORDERS = np.random.default_rng(20).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of the hashes under random orders; texts without words share theirs."""
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(ORDERS, hashes[at : at + 1024]).min(axis=1), out=least)
    least, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ (least[:, r] >> np.uint64(17)) ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int = WIDE) -> DataFrame:
    """(id, *ROW, key, fp, bands) of every row: a digest of its set of shingles, and that set's fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                hashes = np.unique(shingle_hashes(x.as_py(), shingle))
                out.append((xxhash.xxh3_128_hexdigest(hashes.tobytes()), fold(hashes), bands(hashes)))
            fps = np.fromiter((x[1] for x in out), np.uint64, len(out)).view(np.int64)
            keys = np.concatenate([x[2] for x in out] or [np.empty(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array([x[0] for x in out], pa.string()), pa.array(fps), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", *ROW, "key", "fp", "bands"])

    return texts(docs, id_col, text_col, *ROW).mapInArrow(run, f"id long, {ROW[0]} long, {ROW[1]} long, key string, fp long, bands array<long>")


def near(fps: np.ndarray, query: np.ndarray, word: np.ndarray, planes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For (query row, word) pairs, yields (pair index, bits of the 64 lanes within radius). planes: (words, 64)."""
    ones = ~np.uint64(0)
    for at in range(0, len(query), LANES):
        live = np.arange(at, min(len(query), at + LANES))
        fp, w = fps[query[live]], word[live]
        count = [np.zeros(len(live), np.uint64) for _ in range((radius + 1).bit_length())]
        over = np.zeros(len(live), np.uint64)
        for p in range(64):
            carry = planes[w, p] ^ (np.uint64(0) - ((fp >> np.uint64(p)) & np.uint64(1)))
            for c in count:  # carry-save addition of one plane to 64 counters
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if p % 8 == 7:
                above, equal = np.zeros_like(over), np.full_like(over, ones)
                for k in reversed(range(len(count))):  # counter > radius, from the top bit down
                    if radius >> k & 1:
                        equal &= count[k]
                    else:
                        above |= equal & count[k]
                        equal &= ~count[k]
                over |= above
                keep = over != ones
                if not keep.all():
                    live, fp, w, over = live[keep], fp[keep], w[keep], over[keep]
                    count = [c[keep] for c in count]
                if not len(live):
                    break
        if len(live):
            yield live, ~over


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _hits(cols: dict[str, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius. Rows are sorted by run (key, i, j) and block: block i meets block j where they differ, else itself."""
    n = len(cols["fp"])
    fps = cols["fp"].view(np.uint64)
    change = lambda *names: np.flatnonzero(np.concatenate([[True], np.any([cols[x][1:] != cols[x][:-1] for x in names], axis=0)]))
    part = change("k", "i", "j", "blk")
    size = np.diff(np.append(part, n))
    words = -(-size // 64)
    first_word = np.cumsum(words) - words
    total = int(words.sum())
    lanes = np.zeros((total, 64), np.uint64)
    part_of = np.repeat(np.arange(len(part)), size)
    lane = np.arange(n) - part[part_of]
    slot = first_word[part_of] * 64 + lane
    lanes.reshape(-1)[slot] = fps
    row_at = np.full(total * 64, -1)
    row_at[slot] = np.arange(n)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(total, 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[..., 0]
    # which part each row is held against: its own, or the next one of the same run
    against = part_of.copy()
    i, j, blk = cols["i"], cols["j"], cols["blk"]
    cross = i != j
    against[cross] += 1
    asks = np.where(cross, (blk == i) & (against < len(part)), True)
    rows = np.flatnonzero(asks)
    after = part[np.minimum(against[rows], len(part) - 1)]
    same_run = np.all([cols[x][after] == cols[x][rows] for x in ("k", "i", "j")], axis=0)
    rows = rows[same_run]
    target = against[rows]
    reps = words[target]
    query = np.repeat(rows, reps)
    word = np.repeat(first_word[target], reps) + np.arange(len(query)) - np.repeat(np.cumsum(reps) - reps, reps)
    own = np.repeat(~cross[rows], reps)
    useful = ~own | (word * 64 + 63 > slot[query])
    query, word = query[useful], word[useful]
    for live, mask in near(fps, query, word, planes, radius):
        hit = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        x, bit = np.nonzero(hit)
        a, b = query[live[x]], row_at[word[live[x]] * 64 + bit]
        ok = (b >= 0) & (a != b)
        yield a[ok], b[ok]


def _compare(cols: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the pairs within the radius."""
    found = list(_hits(cols, radius))
    n = len(cols["fp"])
    a, b = (np.concatenate([x[side] for x in found] or [np.empty(0, np.int64)]) for side in (0, 1))
    root = _forest(a, b, n)
    away = np.flatnonzero(root != np.arange(n))
    return away, root[away]


def _check(cols: dict[str, np.ndarray], radius: int, least: float, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans those pairs within the radius whose sets of shingles are alike.

    Each hit is checked exactly, unless its rows are joined already.
    """
    n = len(cols["fp"])
    sets = [np.unique(shingle_hashes(x, shingle)) for x in cols["text"]]
    size, root = np.fromiter(map(len, sets), np.int64, n), np.arange(n)
    left, right = [], []
    for a, b in _hits(cols, radius):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
        for at, stop in zip(start.tolist(), np.append(start[1:], len(a)).tolist()):
            x, others = int(a[at]), b[at:stop]
            others = others[(root[others] != root[x]) & (np.minimum(size[others], size[x]) >= least * np.maximum(size[others], size[x]))]
            if not len(others):
                continue
            own, flat = sets[x], np.concatenate([sets[y] for y in others.tolist()])
            if size[x]:
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                shared = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size[others]) - size[others])
            else:
                shared = np.zeros(len(others), np.int64)  # texts without words, which equal each other
            for y in others[(shared >= least * (size[others] + size[x] - shared)) | (size[others] + size[x] == 0)].tolist():
                if root[x] != root[y]:
                    low, high = sorted((root[x], root[y]))
                    root[root == high] = low
                    left.append(x)
                    right.append(y)
    return np.array(left, np.int64), np.array(right, np.int64)


def _deal(rows: DataFrame, block: int, node: str, more: DataFrame | None = None) -> DataFrame:
    """Rows (k, fp, node) of every key that has several, as runs (k, i, j): a key's rows, or block i with block j of a hot key's.

    more, joined by node, brings columns that only these rows need.
    """
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / block).alias("nb"))
    dealt = (
        rows.join(sizes, "k")
        .withColumn("blk", F.pmod(F.xxhash64("fp", node), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
        .select("k", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "fp", node)
    )
    if more is not None:
        dealt = dealt.join(more, node)
    return dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "blk")


def _linked(dealt: DataFrame, node: str, compare: Callable) -> DataFrame:
    """(a, b): the nodes of the links that compare(columns) finds in whole runs."""
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = chars = 0

        def links(cols):
            a, b = compare(cols)
            return pa.RecordBatch.from_arrays([pa.array(cols[node][a]), pa.array(cols[node][b])], ["a", "b"])

        for batch in batches:
            held.append({x: batch.column(c).to_numpy(zero_copy_only=False) for c, x in enumerate(names)})
            rows, chars = rows + batch.num_rows, chars + batch.nbytes
            if rows < 20_000 and chars < GATHER:
                continue
            cols = {x: np.concatenate([h[x] for h in held]) for x in names}
            new = np.flatnonzero((cols["k"][1:] != cols["k"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])) + 1
            if not len(new):
                held = [cols]
                continue
            yield links({x: v[: new[-1]] for x, v in cols.items()})
            held = [{x: v[new[-1] :] for x, v in cols.items()}]
            rows, chars = len(held[0]["k"]), 0
        if rows:
            yield links({x: np.concatenate([h[x] for h in held]) for x in names})

    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, rep) with distinct fp -> links (a, b) between reps whose fingerprints join within radius bits.

    The links span the same components as all pairs within the radius do.
    """
    n_blocks = radius + 2
    edge = [round(64 * x / n_blocks) for x in range(n_blocks + 1)]

    def bits(b: int):
        width = edge[b + 1] - edge[b]
        return F.shiftrightunsigned("fp", edge[b]).bitwiseAND(F.lit((1 << width) - 1)), width

    keys = []
    for t, (x, y) in enumerate(combinations(range(n_blocks), 2)):
        (low, width), (high, _) = bits(x), bits(y)
        keys.append(F.lit(t << 40) + F.shiftleft(high, width) + low)
    spread = fps.select("fp", "rep", F.explode(F.array(*keys)).alias("k"))
    return _linked(_deal(spread, block, "rep"), "rep", lambda cols: _compare(cols, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: documents whose fingerprints chain within radius bits.

    component_id is the smallest id of the chain. Null texts and texts without words have fingerprint zero
    and link like any other; texts of any length are read whole; a null id is a document before all others and comes back as null; repeated rows
    give repeated results; an empty table gives an empty one; only the two named columns are read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("low"))
    # nodes are fingerprints, not ids, which unrelated texts can share
    roots = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    chains = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    chains = cut(chains, "chains")
    lowest = chains.groupBy("root").agg(F.min("low").alias("component"))
    # written, so that both sides of the last join are shuffled for it and adaptive execution can split a hot fingerprint
    of_fp = cut(chains.join(lowest, "root").select("fp", "component"), "components")
    return fps.join(of_fp, "fp").select(
        real_id("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real_id("component").alias("component_id"),
    )


def alike(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE, least: float = ALIKE, radius: int = LOOSE) -> DataFrame:
    """(*ROW, id, group, stays) for every row: groups of texts that chain by a Jaccard similarity of shingles of `least` or more.

    rows is numbered(). The row that stays for its group is that with the smallest id, null first, then any one row. Every link
    is exact; of the pairs at `least` itself 0.99 are found, of closer ones more (see BANDS). Texts with the same set of shingles
    are one class, which is compared once.
    """
    found = cut(sketches(rows, id_col, text_col, shingle), "sketches")
    classes = found.groupBy("key").agg(F.min(F.struct("id", *ROW)).alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # numbered as they are written
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), "key", "low", "fp", "bands"), "classes")
    # classes that may be alike: components of fingerprints that share a band and lie within the radius
    banded = classes.select("class", "fp", F.explode("bands").alias("k"))
    maybe = components(_linked(_deal(banded, BLOCK, "class"), "class", lambda cols: _compare(cols, radius)))
    together = maybe.select(F.col("node").alias("class"), F.col("root").alias("k")).unionAll(maybe.select("root", "root").distinct())
    together = cut(together.join(classes, "class").select("class", "k", "fp", *[F.col(f"low.{c}") for c in ROW]), "together")
    # only these fetch their texts, once per block of their component
    text = rows.select(*ROW, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(together.select("class", *ROW), ROW).select("class", "text")
    dealt = _deal(together.select("class", "k", "fp"), TEXTS, "class", text)
    roots = components(_linked(dealt, "class", lambda cols: _check(cols, radius, least, shingle)))
    grouped = classes.join(roots, F.col("class") == F.col("node"), "left").select("key", "low", F.coalesce("root", "class").alias("group"))
    # written, so that adaptive execution can split the join at a class of very many copies
    grouped = cut(grouped, "grouped")
    first = grouped.groupBy("group").agg(F.min("low").alias("first"))
    of_key = cut(grouped.join(first, "group").select("key", "group", "first"), "of-key")
    stays = F.col("first") == F.struct("id", *ROW)
    return found.join(of_key, "key").select(*ROW, real_id("id").alias("id"), "group", stays.alias("stays"))


def keep_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE, least: float = ALIKE, radius: int = LOOSE) -> DataFrame:
    """docs without near duplicates: one row of every group of alike() stays, with all its columns.

    It is that with the smallest id, null first, then any one row. A null text is empty; texts without words are one group; texts of any
    length are read whole; copies and repeated rows leave one; rows that share an id or have none are told apart by their
    texts. An empty table gives an empty one; other columns may have any name but those of ROW.
    """
    rows = numbered(docs)
    kept = alike(rows, id_col, text_col, shingle, least, radius).where("stays").select(*ROW)
    return rows.join(kept, ROW, "left_semi").drop(*ROW)
