"""Exact dedup against a persistent digest index, bucketed and sorted by hash. DataFrame functions only.

The index holds the digest of every text seen, with the document that stays for it. It is a table in the shared
folder, bucketed and sorted by digest, which outlives the session. New digests are counted before they are
shuffled and meet the index in a sort-merge anti-join for which the index is not shuffled; what is left is
appended. Each append adds one sorted file to a bucket, and a bucket of several files is sorted again as it is read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import BLANK, ROW, cut, numbered, real_id, shared_dir, texts

SCHEMA = "digest string, keep_id long, keep_length long"
#: Loads in which a table is added to an index of its own.
LOADS = 2


class DigestIndex:
    """A table of digests in `buckets` buckets by hash, opened or made at path.

    An index that is opened keeps its rows and the number of buckets it was made with, which stands beside its files.
    close() takes the table's name out of the catalog and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.name = f"digests_{uuid.uuid4().hex}"
        stored = self._first("buckets int", f"{self.path}/_buckets") if path else None
        if path and not stored and self._first(SCHEMA, self.path):
            raise ValueError(f"{path} holds rows but not the number of buckets they were written in")
        self.buckets = stored[0] if stored else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if stored:
            at = self.path.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        else:
            self.append(spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in SCHEMA.split(", "))]))
            if path:  # an index without a path of its own cannot be opened again
                spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}/_buckets")

    def _first(self, schema: str, path: str) -> Row | None:
        """The first row of the files at path, none where there are none."""
        try:
            return self.spark.read.schema(schema).parquet(path).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "keep_length").repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        """Every row appended; a digest has several where better documents replaced the first one."""
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """(digest, keep_id): the document that stays for each text, without a shuffle."""
        return self.table().groupBy("digest").agg(F.max(_order("keep_length", "keep_id")).alias("best")).select("digest", F.col("best.id").alias("keep_id"))

    def fresh(self, new: DataFrame, better: bool = False) -> DataFrame:
        """Rows of new (digest, keep_id, keep_length) that the index does not know; better: nor knows a document that stays over theirs."""
        held = self.table().select("digest", F.col("keep_id").alias("__held_id"), F.col("keep_length").alias("__held_length")).alias("held").hint("merge")
        on = F.col("new.digest") == F.col("held.digest")
        if better:
            on &= (F.col("__held_length") > F.col("keep_length")) | ((F.col("__held_length") == F.col("keep_length")) & (F.col("__held_id") <= F.col("keep_id")))
        return new.alias("new").hint("merge").join(held, on, "left_anti")

    def add(self, digests: DataFrame, better: bool = False) -> DataFrame:
        """Takes (id, length, digest[, *ROW]) rows, appends those texts that are new, and returns the rows appended.

        Of new rows with the same text that with the most code points stays, then the smallest id, then any one row. A
        text that the index has keeps its document; with better, a document that stays over it by the same rule replaces it.
        """
        row = [c for c in ROW if c in digests.columns]
        new = digests.groupBy("digest").agg(F.max(_order("length", "id", *row)).alias("best"))
        new = new.select("digest", F.col("best.id").alias("keep_id"), F.col("best.length").alias("keep_length"), *[F.col(f"best.{c}") for c in row])
        found = cut(self.fresh(new, better), "fresh")
        self.append(found)
        return found


def _order(length: str, id_: str, *row: str) -> Column:
    """What is largest for the row that stays."""
    return F.struct(F.col(length).alias("length"), F.bitwise_not(F.col(id_)).alias("order"), F.col(id_).alias("id"), *row)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, length, digest, *more) of every row: code points of the text, SHA-256 of the text without its blanks."""
    text = F.col("text")
    return texts(docs, id_col, text_col, *more).select("id", F.length(text).cast("long").alias("length"), F.sha2(F.regexp_replace(text, f"{BLANK}+", ""), 256).alias("digest"), *more)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal without their blanks; a null text is empty; texts of any length are read whole. Of equal texts the row with the most code
    points stays, then the smallest id; with an index given, the document that it already keeps. Without one, the rows go into an index of
    this call's own in LOADS loads by hash, so that the later loads meet what the earlier ones left. group_size counts this
    call's rows. Rows that repeat an id are one document and share its verdict; a null id comes before all others and stays
    null; an empty table gives an empty one; other columns are not read.
    """
    own = DigestIndex(docs.sparkSession) if index is None else index
    rows = cut(digests(docs, id_col, text_col), "digests")
    if index is None:
        for load in range(LOADS):
            own.add(rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(LOADS)) == load), better=True)
    else:
        own.add(rows)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"))
    held = cut(sizes.hint("merge").join(own.entries().hint("merge"), "digest"), "held")
    if index is None:
        own.close()
    # the verdict goes back to the rows by a plain shuffled join, which adaptive execution can split at a hot digest
    return rows.join(held, "digest").select(
        real_id("id").alias("doc_id"),
        real_id("keep_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """docs with one row of every distinct text that the index did not know, all columns kept.

    Texts are equal without their blanks; a null text is empty, and one row of all empty texts stays. Of equal texts the row with the
    most code points stays, then the smallest id, null first, then any one row, so null or repeated ids and repeated rows
    cost no distinct text. An empty table gives an empty one; other columns may have any name but those of ROW.
    """
    own = DigestIndex(docs.sparkSession) if index is None else index
    rows = numbered(docs)
    fresh = own.add(cut(digests(rows, id_col, text_col, *ROW), "digests"))
    if index is None:
        own.close()
    return rows.join(fresh.select(*ROW), ROW, "left_semi").drop(*ROW)
