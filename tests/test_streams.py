"""Streams with keyed state on hand-made arrivals: against the batch operators, after failures, with late rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewater.operators import quotes as batch
from tidewater.plans import live, wider
from tidewater.plans.fixtures import view
from tidewater.sources import snapshots
from tidewater.streaming import pricing

PRICED = ["event_id", "market", "line", "side", "books", "book_id", "odds", "consensus", "ev"]


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def quote(event, book, side, at, odds, start, point=None, market=0, snapshot=None):
    return (event, book, market, side, at if snapshot is None else snapshot, point, odds, at, at - 5, at + 5, start, 1)


def both(event, book, at, odds, start, **more):
    return [quote(event, book, 1, at, odds, start, **more), quote(event, book, 2, at, -odds - 20, start, **more)]


def prices(df):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*PRICED).collect())


def land(spark, rows, folder, schema=pricing.QUOTE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_repricing_equals_the_batch_pipeline_after_every_arrival(spark, tmp_path, two_partitions):
    path, landing, seen = f"{tmp_path}/run", f"{tmp_path}/landing", []
    arrivals = [
        both(1, 1, 1000, 110, 50_000) + both(1, 2, 1010, 120, 50_000) + both(2, 1, 1000, 130, 9_000) + both(2, 2, 1000, 140, 9_000) + both(3, 1, 1000, 110, 50_000),
        # a newer snapshot replaces a line, an older one that comes later does not, and event 3 gets its second book
        both(1, 1, 2000, 150, 50_000) + both(1, 1, 1500, 180, 50_000) + both(3, 2, 2100, 105, 50_000),
        # event 2 has begun: what is ingested from then on changes nothing
        both(2, 1, 9_100, 300, 9_000) + both(1, 2, 20_000, 125, 50_000),
        # its state has gone, so that a late row of it finds none
        both(2, 1, 8_000, 310, 9_000) + both(3, 1, 30_000, 115, 50_000),
    ]
    states = []
    for rows in arrivals:
        seen += rows
        land(spark, rows, landing)
        query = pricing.reprice(spark.readStream.schema(pricing.QUOTE).parquet(landing), path, late="1 minute")
        states.append(query.lastProgress.stateOperators[0].numRowsTotal)
        valid = [r for r in seen if r[9] < r[10] and not (r[0] == 2 and r[7] == 8_000)]
        want = batch.price_markets(spark.createDataFrame(valid, pricing.QUOTE), 10**9)
        assert prices(pricing.current_prices(spark, path)) == prices(want)
    # one row of state per event that has not begun
    assert states == [3, 3, 2, 2]


def test_a_batch_prices_touched_events_only_and_its_work_does_not_grow(spark, tmp_path, two_partitions):
    path, landing = f"{tmp_path}/run", f"{tmp_path}/landing"
    for n in range(6):
        land(spark, [q for e in ((0, 1, 2, 3) if n == 0 else (n % 2,)) for b in (1, 2) for q in both(e, b, 1000 + n, 100 + n, 10**6)], landing)
    stream = spark.readStream.schema(pricing.QUOTE).option("maxFilesPerTrigger", 1).parquet(landing)
    pricing.reprice(stream, path)
    n = spark.read.parquet(f"{path}/prices").groupBy("batch").agg(F.collect_set("event_id").alias("events"), F.count("*").alias("rows")).collect()
    sizes = sorted((r.batch, len(r.events), r["rows"]) for r in n)
    assert [s[1:] for s in sizes] == [(4, 8), *[(1, 2)] * 5]
    assert spark.read.parquet(f"{path}/touched/1").count() <= 16 and {f.name for f in (tmp_path / "run" / "touched").iterdir()} == {"0", "1"}


def test_a_line_that_the_newest_snapshot_lacks_is_gone(spark, tmp_path, two_partitions):
    path, landing = f"{tmp_path}/run", f"{tmp_path}/landing"
    first = [q for b in (1, 2) for line in (40.5, 41.5) for q in both(7, b, 1000, 110, 10**6, point=line, market=2)]
    second = [q for b in (1, 2) for q in both(7, b, 2000, 115, 10**6, point=40.5, market=2)]
    for rows in (first, second):
        land(spark, rows, landing)
        pricing.reprice(spark.readStream.schema(pricing.QUOTE).parquet(landing), path)
    assert {r.line for r in pricing.current_prices(spark, path).collect()} == {40.5}


def test_events_of_a_group_share_a_row_of_state_and_are_priced_alone(spark, tmp_path, two_partitions):
    """Events with one rest in a block, some of which begin: one row of state, whose events are put out when a batch touches them, with nulls as they came."""
    path, landing, seen, rnd, n = f"{tmp_path}/run", f"{tmp_path}/landing", [], random.Random(2), pricing.TOGETHER
    sizes = []
    for batch_no, events in enumerate(([i * n + 3 for i in range(40)], [3, n + 3, 5 * n + 3], [7 * n + 3])):
        rows = []
        for e in events:
            for book in (1, 2, 3):
                for market in (0, 1, 2):
                    at, start = 1000 + 1000 * batch_no + rnd.randrange(500), 1600 if e >= 30 * n else 10**6
                    two = both(e, book, at, 100 + rnd.randrange(90), start, market=market, point=None if market == 0 else 3.0 + rnd.randrange(2))
                    two = [(*q[:5], -q[5] if market == 1 and q[3] == 2 else q[5], None if rnd.random() < 0.1 else q[6], *q[7:]) for q in two]
                    rows += two * (2 if rnd.random() < 0.1 else 1)
        # never priced, and no reason to fail: rows without an event, a book, a clock or a start
        rows += [(None, *rows[0][1:]), (3, None, *rows[0][2:]), (*rows[0][:7], None, *rows[0][8:]), (*rows[0][:10], None, rows[0][11])]
        seen += rows
        land(spark, rows, landing)
        query = pricing.reprice(spark.readStream.schema(pricing.QUOTE).parquet(landing), path, late="1 second")
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
        valid = [r for r in seen if r[10] is not None and r[9] < r[10]]
        assert prices(pricing.current_prices(spark, path)) == prices(batch.price_markets(spark.createDataFrame(valid, pricing.QUOTE), 10**9))
    assert sizes == [1, 1, 1]
    last = spark.read.parquet(f"{path}/prices").groupBy("batch").agg(F.collect_set("event_id").alias("e")).collect()
    assert [sorted(r.e) for r in sorted(last, key=lambda r: r.batch) if r.batch][-1] == [7 * n + 3] and max(len(r.e) for r in last if r.batch == 0) > 30


def test_an_older_ingestion_that_comes_later_is_priced_with_what_was_known(spark, tmp_path, two_partitions):
    """A batch that touches an event by an older row prices all of its state, not the part known when that row was ingested."""
    path, landing = f"{tmp_path}/run", f"{tmp_path}/landing"
    first = [q for b in (1, 2) for q in both(4, b, 5000, 110 + b, 10**6)]
    for rows in (first, both(4, 3, 4000, 130, 10**6)):
        land(spark, rows, landing)
        pricing.reprice(spark.readStream.schema(pricing.QUOTE).parquet(landing), path, late="1 hour")
    assert {(r.event_id, r.books) for r in pricing.current_prices(spark, path).collect()} == {(4, 3)}


def snapshots_of(spark, small):
    raw = wider.damaged(lambda n: view(spark, small, n)).select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "body").where("snapshot_id < 1500")
    nested = '{"id":1,"start":5,"books":[null,{"key":3,"markets":[]},{"key":4,"markets":[null,{"key":1,"outcomes":[]},{"key":2,"outcomes":[null,{"side":1,"odds":100},{"side":1,"odds":100}]}]}]}'
    own = [(-1, '{"id":1,"start":5,"books":[]}'), (-2, nested), (-3, None), (-4, ""), (-5, "[1]")]
    return raw.unionAll(spark.createDataFrame(own, "snapshot_id long, body string"))


def test_one_pass_gives_the_warnings_of_quarantine(spark, small, tmp_path):
    snapshots_of(spark, small).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    got = snapshots.read_documents(raw)
    good, warned = snapshots.quarantine_malformed(raw)
    assert Counter(tuple(r) for r in got.where("reason is not null").select("snapshot_id", "reason", "place").collect()) == Counter(tuple(r) for r in warned.collect())
    rows = snapshots.flatten_quotes(good).where("side is not null and odds is not null and book_id is not null and market is not null")
    assert {tuple(r) for r in got.where("reason is null").select(rows.columns[0], "event_id", "book_id", "market", "side", "odds", "point").collect()} == {
        tuple(r) for r in rows.select("snapshot_id", "event_id", "book_id", "market", "side", "odds", "point").collect()
    }


def test_rows_and_warnings_land_together_even_after_a_failure(spark, small, tmp_path, two_partitions):
    path, landing = f"{tmp_path}/run", f"{tmp_path}/landing"
    raw = snapshots_of(spark, small)
    stream = lambda: spark.readStream.schema("snapshot_id long, body string").parquet(landing)
    raw.where("snapshot_id % 2 = 0").write.parquet(landing)
    pricing.land_snapshots(stream(), path)
    before = pricing.landed_rows(spark, path).count()
    raw.where("snapshot_id % 2 <> 0").write.mode("append").parquet(landing)

    def fail(n):
        raise RuntimeError("lost before the batch was committed")

    with pytest.raises(StreamingQueryException, match="lost before"):
        pricing.land_snapshots(stream(), path, fail)
    # documents of the batch are there, but nobody reads them
    assert pricing.landed_rows(spark, path).count() == before > 0
    pricing.land_snapshots(stream(), path)
    pricing.land_snapshots(stream(), path)
    good, warned = snapshots.quarantine_malformed(raw)
    assert Counter(tuple(r) for r in pricing.landed_warnings(spark, path).collect()) == Counter(tuple(r) for r in warned.collect())
    status = {(r.snapshot_id, r.warnings, r.status) for r in pricing.landed_status(spark, path).collect()}
    assert status == {(r.snapshot_id, r.warnings, r.status) for r in snapshots.batch_status(raw, warned).collect()}
    assert pricing.landed_rows(spark, path).count() == snapshots.read_documents(raw).where("reason is null").count()


def test_documents_are_dealt_once_before_they_are_parsed(spark, small, tmp_path, two_partitions):
    snapshots_of(spark, small).write.parquet(f"{tmp_path}/raw")
    got = snapshots.read_documents(spark.read.parquet(f"{tmp_path}/raw"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("from_json") < plan.index("Exchange ") and "hashpartitioning(snapshot_id" in plan
    assert got.rdd.getNumPartitions() == 2  # as many tasks as the session says, whatever their bytes


def test_landed_rows_are_written_unsorted_and_not_shuffled_by_batch(spark, small, tmp_path, two_partitions):
    path, landing = f"{tmp_path}/run", f"{tmp_path}/landing"
    empty = spark.createDataFrame([(-9, '{"id":1,"start":5,"books":[]}')], "snapshot_id long, body string")
    snapshots_of(spark, small).unionAll(empty).write.parquet(landing)
    pricing.land_snapshots(spark.readStream.schema("snapshot_id long, body string").parquet(landing), path)
    assert not [f.name for f in (tmp_path / "run" / "documents" / "batch=0").iterdir() if f.is_dir()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the status were large
    try:
        for df in (pricing.landed_rows(spark, path), pricing.landed_warnings(spark, path)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # a snapshot of which there is neither row nor warning has its status too
    assert [tuple(r) for r in pricing.landed_status(spark, path).where("snapshot_id = -9").collect()] == [(-9, 0, 0, "success")]


def test_forbidden_keys_in_any_case(spark):
    # what any letter's case may turn into a letter of the names, and into what it only looks like
    like = sorted({c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and any(x.isascii() and x.isalpha() for x in c.lower() + c.upper() + c.casefold())} | set("-_ "))
    names = snapshots.SECRETS + ["api-key"]
    bodies = [f'{{"{n[:i]}{c}{n[i + 1 :]}" :1}}' for n in names for i in range(len(n)) for c in like] + ['{"a":"token"}', '{"atoken":1}', '{"token1":1}', '{"x":{"ToKeN"\n:1}}', "", None]
    plain = F.translate(F.lower("body"), "-", "_").rlike('"(' + "|".join(snapshots.SECRETS) + ')"\\s*:')
    got = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", snapshots.leaks().alias("leak"), plain.alias("plain")).collect()
    assert [r.body for r in got if r.leak != r.plain] == [] and 50 < sum(r.leak is True for r in got) < len(bodies)
    assert "lower(" not in str(snapshots.leaks())  # no copy of the text


def test_nothing_committed_reads_as_empty(spark, tmp_path):
    assert pricing.landed_rows(spark, str(tmp_path)).count() == 0 and pricing.landed_warnings(spark, str(tmp_path)).count() == 0


def test_late_rows_change_no_answer(spark, tmp_path, two_partitions):
    path, asked, told = str(tmp_path), f"{tmp_path}/asked", f"{tmp_path}/told"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    request, line = "request_id long, event_id long, as_of timestamp", "event_id long, market string, price double, seq long, observed timestamp, ingested timestamp"

    def run():
        pricing.answer(spark.readStream.schema(request).parquet(asked), spark.readStream.schema(line).parquet(told), path, late="1 hour", horizon="2 hours")
        return {(r.request_id, r.price, r.quotes) for r in spark.read.parquet(f"{path}/answers").collect()}

    land(spark, [(1, 5, at(10)), (2, 6, at(10)), (99, 0, at(20))], asked, request)
    land(spark, [(5, "m", 1.0, 1, at(8.5), at(9)), (5, "m", 2.0, 2, at(9.4), at(9.5)), (5, "m", 3.0, 3, at(9.6), at(10.5)), (5, "m", 0.5, 4, at(1), at(1)), (0, "m", 0.0, 0, at(20), at(20))], told, line)
    first = run()
    assert first == {(1, 2.0, 2)}  # not 3.0, which was observed before but ingested after; not 0.5, beyond the horizon
    # rows with clocks before the request, but come in now: they join the history alone
    land(spark, [(5, "m", 9.0, 5, at(9.9), at(9.95)), (6, "m", 9.0, 6, at(9.9), at(9.95)), (5, "m", 4.0, 7, at(18), at(24.5)), (0, "m", 0.0, 8, at(40), at(40))], told, line)
    land(spark, [(3, 5, at(25)), (98, 0, at(40))], asked, request)
    second = run()
    assert first <= second and {r for r in second if r[0] in (1, 2)} == first and (3, 4.0, 1) in second
    assert spark.read.parquet(f"{path}/history").count() == 9


def test_registered_streams_are_the_keyed_ones():
    assert live.QUERIES["x7_stream_reprice"] is live._reprice and live.QUERIES["x6_late_data"] is live._late
