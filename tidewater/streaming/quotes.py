"""Structured Streaming forms of the quote operators. Each is checked against its batch twin on the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources import snapshots

FAMILY = ["event_id", "book_id", "market"]


def stream_quotes(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Quotes of the event files that arrive in a folder, as a stream: event, book, market, price, time."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return raw.select(
        (F.col("event_id") % 200).alias("event_id"), (F.col("user_id") % 6).alias("book_id"), F.col("event_type").alias("market"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def stream_dedupe(quotes: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First row of every identity within the watermark; state is dropped as time passes."""
    return quotes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_state(quotes: DataFrame) -> DataFrame:
    """Newest price per family; the same text for a stream in update mode, which keeps one row per family, and for a batch."""
    newest = F.max_by(F.struct("ts", "seq", "price"), F.struct("ts", "seq"))
    return quotes.groupBy("event_id", "book_id", "market").agg(newest.alias("n"), F.count("*").alias("seen")).select("event_id", "book_id", "market", "n.price", "n.seq", F.col("n.ts").alias("ts"), "seen")


def window_counts(quotes: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Quotes and mean price per tumbling or sliding window and market."""
    quotes = quotes.withWatermark("ts", late) if quotes.isStreaming else quotes
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return quotes.groupBy(w, "market").agg(F.count("*").alias("n"), F.sum("price").alias("total")).select(F.col("window.start").alias("start"), "market", "n", "total")


def freshness(state: DataFrame, now, limit: int) -> DataFrame:
    """FRESH or STALE by the age of the newest quote at a given time."""
    age = F.greatest(F.lit(0), F.lit(now).cast("long") - F.col("ts").cast("long"))
    return state.withColumn("age", age).withColumn("state", F.when(age <= limit, "FRESH").otherwise("STALE"))


def known_at(quotes: DataFrame, ingested: str, cutoff) -> DataFrame:
    """What was known at a cutoff: late rows are appended with their ingestion time and change no earlier answer."""
    return quotes.where(F.col(ingested) <= cutoff)


def newest_batch(out: DataFrame, key: list[str]) -> DataFrame:
    """Of every key the row of the last batch that wrote it."""
    rest = [c for c in out.columns if c not in (*key, "batch")]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def run_to_table(stream: DataFrame, folder: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its table.

    Without a key rows are appended to a Parquet sink. With a key the stream runs in update mode: each batch writes the keys that it changed, and nothing
    else, and the table has the last row of each. Writing a batch again replaces it, so a restart repeats nothing.
    """
    spark = stream.sparkSession
    out, state = f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("update" if key else "append").option("checkpointLocation", state).trigger(availableNow=True)
    if not key:
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    return newest_batch(spark.read.parquet(out), key)


def stream_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the JSON snapshots (snapshot_id, body) that arrive in a folder: parsed, damaged documents left out, flattened."""
    raw = spark.readStream.schema("snapshot_id long, body string").parquet(folder)
    return snapshots.flatten_quotes(snapshots.readable(raw))
