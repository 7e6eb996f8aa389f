"""Hard-negative mining: exact integer scores by a residue-number-system GEMM, then windowed selection.

Components are integers. A block of anchors meets a stream of rows as float32 matrices of residues modulo several small primes;
products of centred residues stay below 2 ** 24, so float32 sums are exact. Signed scores come back by Chinese
remaindering in balanced mixed radix. A task keeps each anchor's best rows so far, and a window over what tasks kept selects.

Anchors are a stated query set. Their blocks and slices of the rows are dealt as cells, about as many as there are shuffle
partitions: few anchors meet many slices, and many blocks meet all rows as one slice, so what tasks keep grows with the anchors alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import NULL_ID, cut, real_id

SCALE, CLASSES, RELABEL, ANCHOR, BEST = 256, 10, 7, 100, 5
#: Anchors in a block, and rows that meet them at once.
BLOCK, ROWS = 2048, 1024
#: Components multiplied before residues are reduced again.
SPAN = 256
#: A row's sum of squared components must stay below this, so that five times any score fits in 64 bits.
MOST = 1 << 60
#: Stands below every score.
NEVER = -(1 << 62)


def primes_for(dims: int, bound: int) -> list[int]:
    """The largest primes whose centred residues give exact float32 sums over min(dims, SPAN) products, as many as scores up to +-bound need."""
    half = int((((1 << 24) - 1) / max(1, min(dims, SPAN))) ** 0.5)
    half = min(half, 1 << 11)
    out, product, p = [], 1, 2 * half + 1
    while product < 2 * bound + 1:
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        if p < 3:
            raise ValueError(f"scores up to {bound} need more primes than there are")
        out.append(p)
        product, p = product * p, p - 1
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p - 1) / 2 and (p - 1) / 2."""
    h = (p - 1) // 2
    return np.mod(x + h, p) - h


class Residues:
    """Integer rows as float32 residue matrices, one per prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.parts = [np.ascontiguousarray(centred(rows, p).astype(np.float32)) for p in primes]


def scores(a: Residues, b: Residues, primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b (int64)."""
    residues = []
    for x, y, p in zip(a.parts, b.parts, primes):
        total = None
        for k in range(0, x.shape[1], SPAN):
            part = centred((x[:, k : k + SPAN] @ y[:, k : k + SPAN].T).astype(np.int32), p)
            total = part if total is None else centred(total + part, p)
        residues.append(np.zeros((len(x), len(y)), np.int32) if total is None else total)
    # balanced mixed radix: score = d0 + p0 (d1 + p1 (d2 + ..)), each digit centred
    digits = []
    for i, p in enumerate(primes):
        value = residues[i].astype(np.int64)
        for d, q in zip(digits, primes):
            value = centred((value - d) * pow(q, -1, p), p)
        digits.append(value)
    out = digits[-1]
    for d, p in zip(digits[-2::-1], primes[-2::-1]):
        out = out * p + d
    return out


def candidates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", labels: Column | None = None) -> DataFrame:
    """(row, id, label, v): rows that take part, with integer components floor(SCALE * x).

    Those with a null label, a null vector, or a null or non-finite component do not; nor, as their scores need not fit in 64 bits, those whose
    squared components add up to MOST or more.
    """
    x = F.col("x")
    rows = embeddings.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.col(id_col).isNotNull().alias("known")
    ).where("label is not null and x is not null")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.floor(c * SCALE).cast("double") * F.floor(c * SCALE).cast("double"))
    small = ~F.exists(x, lambda c: F.abs(c) >= float(1 << 22))
    rows = rows.where(~F.coalesce(bad, F.lit(False))).where(small).where(square < float(MOST))
    label = F.when(F.col("known") & (F.col("id") % RELABEL == 0), (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "known", label.alias("label"), v.alias("v"))


def _top(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, held: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (score, id, row) of every line among the allowed columns and those held. Columns are in order of id, so the first of equals is the smallest."""
    some = np.flatnonzero(allowed.any(axis=1))
    if not len(some):
        return held
    work = np.where(allowed[some], score[some], NEVER)
    found = []
    for _ in range(min(k, work.shape[1])):
        at = work.argmax(axis=1)
        best = work[np.arange(len(some)), at]
        found.append((best, ids[at], rows[at]))
        if (best == NEVER).all():
            break
        work[np.arange(len(some)), at] = NEVER
    merged = [np.concatenate([h[some], np.stack([f[i] for f in found], axis=1)], axis=1) for i, h in enumerate(held)]
    order = np.lexsort((merged[1], -merged[0]), axis=1)[:, :k]
    for h, m in zip(held, merged):
        h[some] = np.take_along_axis(m, order, axis=1)
    return held


def _dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, cells: int) -> tuple[DataFrame, int]:
    """Anchors (slot, ..) and rows dealt to cells; in each the anchors come first, then rows in order of id."""
    blocks = max(1, -(-n_anchors // BLOCK))
    slices = max(1, cells // blocks)
    at = F.col("slot").cast("long")
    block = F.floor(at / BLOCK).cast("int")
    heads = anchors.select(F.explode(F.sequence(block * slices, block * slices + slices - 1)).alias("cell"), F.lit(0).alias("kind"), *ROW)
    slice_ = F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    tails = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * slices + slice_)).alias("cell"), F.lit(1).alias("kind"), *ROW)
    n = blocks * slices
    return heads.unionByName(tails).repartitionById(n, "cell").sortWithinPartitions("cell", "kind", "id"), n


ROW = ["row", "id", "label", "v", "limits"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _search(dealt: DataFrame, dims: int, primes: list[int], negative: bool) -> DataFrame:
    """(anchor_row, place, score, id, row): for each anchor its best other rows of its label, or for each of its positives its best
    rows of other labels between that positive's limits, of those that met it in one cell."""

    def flush(block, held):
        if block is None:
            return
        for place, (s, i, r) in enumerate(held):
            line, column = np.nonzero(s != NEVER)
            if len(line):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["row"][line]), pa.array(np.full(len(line), place, np.int32)), pa.array(s[line, column]), pa.array(i[line, column]), pa.array(r[line, column])],
                    ["anchor_row", "place", "score", "id", "row"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heads, block, held = None, [], None, []
        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    yield from flush(block, held)
                    cell, heads, block, held = cells[a], [], None, []
                if kinds[a] == 0:
                    heads.append(part)
                    continue
                if block is None and heads:
                    block, held = _block(heads, dims, primes, negative)
                if block is None:
                    continue
                for at in range(0, b - a, ROWS):
                    some = part.slice(at, ROWS)
                    row, ids, label = (some.column(k).to_numpy() for k in (2, 3, 4))
                    got = scores(block["v"], Residues(_matrix(some.column(5), dims), primes), primes)
                    same = block["label"][:, None] == label[None, :]
                    if not negative:
                        held[0] = _top(got, same & (block["row"][:, None] != row[None, :]), ids, row, held[0], BEST)
                        continue
                    for place in range(len(held)):
                        low, high = block["low"][:, place, None], block["high"][:, place, None]
                        held[place] = _top(got, ~same & (got >= low) & (got <= high), ids, row, held[place], BEST)
        yield from flush(block, held)

    return dealt.select("cell", "kind", *ROW).mapInArrow(run, "anchor_row long, place int, score long, id long, row long")


def _block(heads: list[pa.RecordBatch], dims: int, primes: list[int], negative: bool) -> tuple[dict, list]:
    t = pa.Table.from_batches(heads).combine_chunks()
    n = t.num_rows
    block = {"row": t["row"].to_numpy(), "label": t["label"].to_numpy(), "v": Residues(_matrix(t["v"].combine_chunks(), dims), primes)}
    places = BEST if negative else 1
    if negative:  # positive scores by place; where there is none, nothing lies between the limits
        high = np.full((n, BEST), NEVER, np.int64)
        for i, own in enumerate(t["limits"].to_pylist()):
            high[i, : len(own)] = own
        block["high"] = high
        block["low"] = np.where(high == NEVER, np.int64(MOST), -((-4 * high) // 5))  # 80 p <= 100 s just where s >= 4 p / 5
    return block, [tuple(np.full((n, BEST), x, np.int64) for x in (NEVER, 0, 0)) for _ in range(places)]


def mine(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ANCHOR divides; an anchor's positives are its BEST other rows of the same label by score, then by smaller id; a positive's
    negatives the BEST rows of other labels with scores from 80 to 100 percent of its own. Anchors and positives without any give no row.
    Rows that candidates() leaves out take no part; a vector with fewer components than others counts as filled with zeros. A row
    is told from others that repeat its id or all of it, so repeats are each other's positives, and repeated anchors answer each; equal
    scores of equal ids stand in any order. A null id is neither anchor nor relabelled, comes before all others and comes out as null. An empty
    table gives an empty one; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = cut(candidates(embeddings, id_col, vector_col, label_col), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    is_anchor = F.col("known") & (F.col("id") % ANCHOR == 0)
    dims, norm, n = rows.agg(F.max(F.size("v")), F.max(square), F.count_if(is_anchor)).first()
    dims, norm, cells = dims or 0, norm or 0, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    primes = primes_for(dims, norm)  # by Cauchy and Schwarz no score exceeds the largest squared norm
    none = F.expr("cast(array() as array<bigint>)")
    # slots without gaps: partitions are counted, then rows within
    found = cut(rows.where(is_anchor).select("row", "id", "label", "v", F.shiftright("row", 33).alias("part")), "anchors")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    anchors = cut(found.withColumn("rn", within).join(starts, "part").select("row", "id", "label", "v", (F.col("start") + F.col("rn")).alias("slot")), "slots")
    bare = rows.withColumn("limits", none)

    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    dealt, _ = _dealt(anchors.withColumn("limits", none), bare, n, cells)
    near = _search(dealt, dims, primes, False)
    near = near.withColumn("rank", best("anchor_row")).where(F.col("rank") <= BEST).select("anchor_row", "rank", "score", "id")
    positives = cut(near, "positives")
    limits = positives.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("limits"))
    heads = anchors.join(limits, anchors["row"] == limits["anchor_row"]).drop("anchor_row")
    dealt, _ = _dealt(heads, bare, n, cells)
    found = _search(dealt, dims, primes, True)
    found = found.withColumn("rank", best("anchor_row", "place")).where(F.col("rank") <= BEST)
    named = positives.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return found.join(named, ["anchor_row", "place"]).select(
        "anchor_id", real_id("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real_id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
