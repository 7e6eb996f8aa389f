"""Registered streams with keyed state, fed in several arrivals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.fixtures import ctes, view
from tidewater.plans.more import EV
from tidewater.plans.queries import BEST, CONS, ORACLES, PAIRS, PRICED, QUERIES, d6, r6, rounded
from tidewater.plans.shared import folder
from tidewater.plans.wider import KIND, damaged
from tidewater.streaming import pricing
from tidewater.streaming import quotes as streams


def arriving(df: DataFrame, landing: str, parts: list, run) -> None:
    """Writes the rows of each part (a condition) to a folder, and runs a stream over it after each."""
    spark = df.sparkSession
    for part in parts:
        df.where(part).write.mode("append").parquet(landing)
        run(spark.readStream.schema(df.schema).parquet(landing))


# ---- repricing

#: Events start two months apart from 1997 on, so that some end while quotes still arrive, in epoch seconds.
START = "852076800 + (event_id % 30) * 5184000"
HALF = 867_715_200


def _reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/reprice-{uuid.uuid4().hex}"
    q = view(spark, sf_dir, "quotes").withColumn("start", F.expr(START))
    q = q.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in pricing.QUOTE.split(", ")])
    at = F.col("ingested")
    arriving(q, f"{path}/landing", [at < HALF, at >= HALF], lambda stream: pricing.reprice(stream, path))
    got = pricing.current_prices(spark, path)
    return rounded(got.select("event_id", "market", "line", "side", "books", "book_id", "odds", "consensus", "edge", "ev"), "consensus", "edge", "ev")


QUERIES["x7_stream_reprice"] = _reprice
ORACLES["x7_stream_reprice"] = f"""{ctes('quotes')},
    known AS (SELECT * EXCLUDE (start), {START} AS start FROM quotes WHERE ingested < {START}),
    s AS (SELECT * FROM known QUALIFY rank() OVER (PARTITION BY event_id, book_id, market ORDER BY requested DESC, observed DESC, ingested DESC, snapshot_id DESC) = 1),
    {PAIRS}, {CONS}, {BEST}, {PRICED}
    SELECT event_id, market, line, side, books, book_id, odds, {d6('consensus')} AS consensus, {d6('fair - 1 / price')} AS edge, {d6('fair * price - 1')} AS ev FROM x"""


# ---- snapshots with warnings


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/land-{uuid.uuid4().hex}"
    raw = damaged(lambda name: view(spark, sf_dir, name)).select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "body")
    even = F.col("snapshot_id") % 2 == 0
    arriving(raw, f"{path}/landing", [even, ~even], lambda stream: pricing.land_snapshots(stream, path))
    n = F.count("*").alias("n")
    warned = pricing.landed_warnings(spark, path).groupBy("reason").agg(n, F.count_distinct("snapshot_id").alias("batches"))
    partial = pricing.landed_status(spark, path).where("status = 'partial'").agg(n).select(F.lit("status_partial").alias("reason"), "n", F.col("n").alias("batches"))
    rows = pricing.landed_rows(spark, path).agg(n, F.count_distinct("snapshot_id").alias("batches")).select(F.lit("rows").alias("reason"), "n", "batches")
    return warned.unionAll(partial).unionAll(rows)


QUERIES["x1_stream_quarantine"] = _quarantined
ORACLES["x1_stream_quarantine"] = f"""{ctes('quotes')}, t AS (SELECT *, {KIND} AS kind,
    row_number() OVER (PARTITION BY snapshot_id, event_id, book_id, market, side, point, odds) AS again FROM quotes),
    w AS (SELECT snapshot_id, CASE kind WHEN 'event' THEN 'malformed_event' WHEN 'secret' THEN 'credential_key' WHEN 'books' THEN 'malformed_bookmakers' ELSE 'event_not_normalized' END AS reason
          FROM (SELECT DISTINCT snapshot_id, event_id, kind FROM t WHERE kind IN ('event', 'secret', 'books', 'start'))
          UNION ALL SELECT snapshot_id, 'malformed_bookmaker' FROM (SELECT DISTINCT snapshot_id, event_id, book_id FROM t WHERE kind = 'markets')
          UNION ALL SELECT snapshot_id, 'observation_not_normalized' FROM (SELECT DISTINCT snapshot_id, event_id, book_id, market FROM t WHERE kind = 'outcomes')
          UNION ALL SELECT snapshot_id, 'observation_not_normalized' FROM t WHERE kind = 'odds'
          UNION ALL SELECT snapshot_id, 'duplicate_observation_skipped' FROM t WHERE kind = 'whole' AND again > 1)
    SELECT reason, count(*) AS n, count(DISTINCT snapshot_id) AS batches FROM w GROUP BY reason
    UNION ALL SELECT 'status_partial', count(DISTINCT snapshot_id), count(DISTINCT snapshot_id) FROM w
    UNION ALL SELECT 'rows', count(*), count(DISTINCT snapshot_id) FROM t WHERE kind = 'whole' AND again = 1"""


# ---- late rows

HORIZON = "3 days"


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of requests of every 20th quote, a day after it; quotes are ingested up to two days after they were observed."""
    path = f"{folder(spark)}/answers-{uuid.uuid4().hex}"
    s = streams.stream_quotes(spark, sf_dir)
    hours = F.make_interval(hours=(F.col("seq") % 48).cast("int"))
    told = s.select("event_id", "market", "price", "seq", F.col("ts").alias("observed"), (F.col("ts") + hours).alias("ingested"))
    asked = s.where("seq % 20 = 0").select(F.col("seq").alias("request_id"), "event_id", (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 DAY")).alias("as_of"))
    pricing.answer(asked, told, path, horizon=HORIZON)
    got = spark.read.parquet(f"{path}/answers")
    return got.select("request_id", "event_id", "market", "quotes", r6("price").alias("price"), "seq")


QUERIES["x6_late_data"] = _late
ORACLES["x6_late_data"] = f"""WITH {EV}, q AS (SELECT *, ts + INTERVAL 1 hour * (seq % 48) AS ingested FROM e),
    r AS (SELECT seq AS request_id, event_id, date_trunc('hour', ts) + INTERVAL 1 day AS as_of FROM e WHERE seq % 20 = 0)
    SELECT request_id, r.event_id, market, count(*) AS quotes, {d6('max((ts, seq, price))[3]')} AS price, max((ts, seq))[2] AS seq
    FROM r JOIN q ON r.event_id = q.event_id AND ingested BETWEEN as_of - INTERVAL {HORIZON} AND as_of AND ts <= as_of
    WHERE as_of < least((SELECT max(as_of) FROM r), (SELECT max(ingested) FROM q)) - INTERVAL 1 hour - INTERVAL {HORIZON} GROUP BY ALL"""
