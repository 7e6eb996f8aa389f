"""Shared pieces: reading a table, null ids, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; ids come back as null.
NULL_ID = -(2**63)

#: The columns that tell rows apart inside the operators.
ROW = ["__file", "__row"]

#: What ``[\x20\x09-\x0D]`` names, in Java and DuckDB regular expressions.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, text, *more) alone, so that no other column can clash; a null text is empty."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *more,
    )


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW, which no two rows share and no second reading changes.

    Rows of Parquet files are known by a hash of their file's path and their place in it, at no cost; rows of any other
    frame, and of files listed by several paths, as one of them may stand there twice, are numbered as they are written once. Columns of docs
    called as ROW are an error. Decisions on rows are taken and joined back by ROW, so null, repeated or
    clashing ids and equal texts neither lose nor multiply a row, and no key of such a join is hot.
    """
    clash = [c for c in docs.columns if c.lower() in ROW]
    if clash:
        raise ValueError(f"columns called {', '.join(clash)} would clash with those that tell rows apart")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().location().rootPaths().size() == 1:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
        except AnalysisException as e:  # files of a kind that has no such places
            if not e.getCondition().startswith(("FIELD_NOT_FOUND", "UNRESOLVED_COLUMN")):
                raise
    return cut(docs.select("*", F.lit(0).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1])), "rows")


def real_id(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != F.lit(NULL_ID), c)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir, which all executors share.

    Only a local session may do without the setting: there is one machine then, and a folder of our own serves.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/{context.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application has written for its own use; frames that still read it can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(ids: list, values: list, limit: int = 1 << 21) -> Iterator[tuple[list, list]]:
    """Splits one Arrow batch so that a block holds about limit characters; a longer text is a block of its own."""
    at, held = 0, 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= limit:
            yield ids[at : i + 1], values[at : i + 1]
            at, held = i + 1, 0
    if at < len(values):
        yield ids[at:], values[at:]
