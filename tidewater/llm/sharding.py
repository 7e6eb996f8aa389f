"""Sharding by longest processing time: groups that must stay together, largest first, go to the least-loaded shard.

Groups of one size are alike to the heap, so it runs over sizes, each with the number of its groups: few groups are
placed one by one, many at once by the level that they fill. The sizes pass the driver sorted and as a stream: it holds the loads of the shards and
one piece of results, which it writes to the shared folder, however many sizes there are. A group then finds its shard by its rank
among the groups of its size, so every group is placed by the heap, whatever its size.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import cut, real_id, shared_dir, texts

SHARDS = 24
#: Groups of one size up to which they pass the heap one by one.
SINGLY = 256
#: Sizes whose results the driver holds at once.
HELD = 20_000
#: Digits of a group's hash by which groups of one size are ranked in parts.
DIGITS = 3


def fill(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard gets if each goes to the least-loaded shard, the lowest of equals."""
    got = [0] * len(loads)
    if n > SINGLY:  # all groups that start below a level, the highest that does not take more than n
        low, high = min(loads), max(loads) + n * size
        below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
        got = below(low)
    heap = [(x + c * size, s) for s, (x, c) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(n - sum(got)):
        load, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return got


def placed(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, number of its groups that each shard gets) of sizes (size, number of groups) in descending order, distinct and above zero; holds the loads alone."""
    loads = [0] * shards
    for size, n in sizes:
        got = fill(loads, size, n)
        loads = [x + c * size for x, c in zip(loads, got)]
        yield size, got


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """Size -> number of its groups that each shard gets. sizes: (size, number of groups), in any order."""
    return dict(placed(sorted(sizes, reverse=True), shards))


def _ends(sizes: DataFrame, shards: int) -> DataFrame:
    """(size, ends): for each size (size, n) the rank at which each shard's groups end; sizes pass the driver in order, results go to the shared folder in pieces."""
    spark = sizes.sparkSession
    path, schema = f"{shared_dir(spark)}/ends-{uuid.uuid4().hex}", "size long, ends array<long>"
    rows = ((size, list(accumulate(got))) for size, got in placed(((r["size"], r["n"]) for r in sizes.orderBy(F.desc("size")).toLocalIterator()), shards))
    piece = list(islice(rows, HELD))
    while True:
        spark.createDataFrame(piece, schema).write.mode("append").parquet(path)
        piece = list(islice(rows, HELD))
        if not piece:
            return spark.read.schema(schema).parquet(path)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; law is ``bytes``: sizes near equal.

    size: UTF-8 bytes plus 8. Rows of equal text (a null text is empty) share a shard, however many or long they
    are. Of groups of one size the first by hash go to the lowest shard that takes some of them. slot numbers a shard's rows from
    0 without gaps, in no promised order. Repeated rows each get a slot; a null id stays null;
    an empty table gives an empty one; other columns are not read.
    """
    text = F.col("text")
    rows = texts(docs, id_col, text_col).select(
        "id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("g"), F.monotonically_increasing_id().alias("row")
    )
    rows = cut(rows, "sizes")
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"))
    groups = cut(groups.withColumn("part", F.substring("g", 1, DIGITS)), "groups")
    counts = cut(groups.groupBy("size", "part").agg(F.count("*").alias("c")), "counts")
    ends = _ends(cut(counts.groupBy("size").agg(F.sum("c").alias("n")), "all-sizes"), shards)
    # a group's rank within its size in two steps, so that no size is one task's work
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    ranked = groups.withColumn("rn", F.row_number().over(Window.partitionBy("size", "part").orderBy("g"))).join(starts, ["size", "part"])
    ranked = ranked.select("g", "size", (F.col("start") + F.col("rn") - 1).alias("rank"))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    of_group = cut(ranked.join(ends, "size").select("g", shard.alias("shard")), "of-group")
    # gapless slots in two steps: parts of about the root of a shard's rows are counted, then numbered within
    n = rows.count()
    parts = max(1, math.isqrt(n // shards))
    rows = cut(rows.join(of_group, "g").select("id", "size", "crc", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("c")).select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (
        rows.withColumn("rn", within)
        .join(starts, ["shard", "part"])
        .select(
            real_id("id").alias("doc_id"),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
