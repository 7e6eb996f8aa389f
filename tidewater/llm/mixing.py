"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source is expected target / source_size times. A prefix sum of these expectations, shifted by one
random offset per source, is cut at the integers: a document is taken once for each integer that its interval
covers. Documents stand in the order of their size, so the words taken come near the target too. The
prefix sum takes two steps: parts of a source are counted, then numbered within; no source is one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import NULL_ID, ROW, WORD, cut, numbered, real_id

#: Weights of the sources in the order of their names, repeating; share of all words; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def _hash(*cols: Column) -> Column:
    """28 bits that any engine with MD5 can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 7), 16, 10).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): share x all words dealt by weight, no source over most x its own.

    The excess of sources at their limit is dealt again by weight: sources in the order of limit / weight are
    at their limit up to the first for which the rest, by weight, stays below. One row per source is sorted, not the documents.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.lit([float(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level grows while sources are at their limit and falls after the first that is not, so its peak is that one's
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    found = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most).withColumn("level", level)
    target = F.least(F.col("limit").cast("double"), F.max("level").over(whole) * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def _key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row.

    size counts the words of the text (null: none); copies is how often the mix takes the document, at most
    `most`; taken = copies x size, which is none for a document without words. A null source is a
    source of its own; repeated rows are documents each; the same rows give the same result; a null id stays
    null; an empty table gives an empty one; other columns are not read.
    """
    got = _deal(docs, id_col, text_col, source_col, weights, share, most, seed)
    return got.select(real_id("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def _deal(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: int, seed: str, *more: str) -> DataFrame:
    """(id, size, source_size, target, copies, *more) for every row; more names columns of docs, which order rows alike in size, id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        # of id and text, so that neither rows without ids nor those that repeat one stand in one place
        _hash(F.lit(seed), F.col(id_col).cast("long").cast("string"), F.md5(text)).alias("h"),
        *more,
    )
    rows = cut(rows, "sizes")
    n = rows.count()
    parts = math.isqrt(n) // 32 + 1
    targets_ = targets(rows, weights, share, most)
    # order within a source: eighths of a doubling of the size, hash part, size, hash, id
    digits = F.length(F.bin("size"))
    band = digits * 16 + F.floor(F.col("size") * 16 / F.pow(F.lit(2.0), digits)).cast("int")
    rows = rows.select("id", "size", "h", *more, _key("source").alias("key"), band.alias("band"), F.pmod("h", F.lit(parts)).alias("part"))
    counts = rows.groupBy("key", "band", "part").agg(F.count("*").alias("c"))
    start = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = targets_.select(_key("source").alias("key"), "source_size", "target")
    starts = counts.select("key", "band", "part", start.alias("start")).join(goal, "key")
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key", "band", "part").orderBy("size", "h", "id", *more)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _hash(F.lit(seed), F.lit("offset"), F.col("key")) / F.lit(float(1 << 28))
    rank = F.col("start") + F.col("rn")
    copies = F.least(F.lit(most), F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)).cast("int")
    return placed.join(starts, ["key", "band", "part"]).select("id", "size", "source_size", "target", copies.alias("copies"), *more)


def take_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """docs as the mix takes them: each row as many times as mix() gives it copies, with all its columns.

    Each row is taken by its own copies, whatever ids or texts it shares; a null source is a source, a null text has no words
    and is taken as its place in the order falls, texts of any length are counted whole, ties in size go by hash, id, then row. An
    empty table gives an empty one; other columns may have any name but those of ROW and ``__copies``.
    """
    rows, copies = numbered(docs), "__copies"
    got = _deal(rows, id_col, text_col, source_col, weights, share, most, seed, *ROW).where("copies > 0").select(*ROW, F.col("copies").alias(copies))
    return rows.join(got, ROW).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(*ROW, copies)
