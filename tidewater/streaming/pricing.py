"""Streams with keyed state: repricing of touched events, snapshots with their warnings, as-of answers that late rows leave alone.

Each function runs what has arrived and returns; run again on the same path it goes on from its checkpoint. A batch that is
run again replaces what it wrote, and is read only once the last of its tables is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewater.operators import quotes as batch
from tidewater.sources import snapshots

CLOCKS = ["requested", "observed", "ingested", "snapshot_id"]
QUOTE = (
    "event_id long, book_id long, market long, side long, snapshot_id long, point double, odds long, "
    "requested long, observed long, ingested long, start long, league long"
)
#: What the state holds of each quote, as eight-byte integers (those of the double that a point is) with a set of bits at the end that tells the nulls.
HELD = [c.split()[0] for c in QUOTE.split(", ")]
AT = {c: i for i, c in enumerate([*HELD, "nulls"])}
FAMILY = [AT[c] for c in batch.FAMILY]
#: Of this many events the state is one row: ids with the same rest, within a block of its square. Calls between Spark and the worker cost more than their rows.
TOGETHER = 128
#: Rows of arriving quotes that are packed by their events at once.
CHUNK = 1 << 19
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.set(ROCKS[0], before)


def newest_rows(rows: np.ndarray) -> np.ndarray:
    """Of every family the rows of its newest snapshot: those with the largest clocks. rows: a line per quote, in the order of HELD."""
    if not len(rows):
        return rows
    clocks = [AT[c] for c in CLOCKS]
    rows = rows[np.lexsort(rows[:, [*reversed(clocks), *reversed(FAMILY)]].T)]
    last = np.append((rows[1:, FAMILY] != rows[:-1, FAMILY]).any(1), True)
    newest = np.flatnonzero(last)[np.cumsum(last) - last]  # the last row of each row's family
    return rows[(rows[:, clocks] == rows[newest][:, clocks]).all(1)]


def _each_event(rows: np.ndarray, column: str, among: np.ndarray) -> np.ndarray:
    """The largest value of a column, for each row of `among`, in the rows of its event."""
    events, at = np.unique(rows[:, AT["event_id"]], return_inverse=True)
    most = np.full(len(events), np.iinfo(np.int64).min)
    np.maximum.at(most, at, rows[:, AT[column]])
    return most[np.searchsorted(events, among[:, AT["event_id"]])]


def _starts(rows: np.ndarray) -> np.ndarray:
    """For each row the start that the newest snapshot of its event names."""
    order = np.lexsort(rows[:, [AT[c] for c in ("start", "ingested", "observed", "requested", "event_id")]].T)
    event = rows[order, AT["event_id"]]
    last = np.flatnonzero(np.append(event[1:] != event[:-1], True)) if len(rows) else order
    return rows[order[last], AT["start"]][np.searchsorted(event[last], rows[:, AT["event_id"]])]


class EventState(StatefulProcessor):
    """Keyed by a group of events: the rows of the newest snapshot of every family, put out whole for each event that a batch touches.

    The state of an event is as large as its books and markets, whatever its history. A timer stands at the first start of the group's events, and drops
    those that have begun; rows of events that begin by the watermark are left out.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "at long, rows binary")

    def _held(self) -> tuple[int | None, np.ndarray]:
        before = self.state.get()
        return (before[0], _lines(before[1])) if before else (None, _lines(b""))

    def _hold(self, before: int | None, rows: np.ndarray, starts: np.ndarray) -> None:
        at = int(starts.min()) * 1000 if len(rows) else None
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.state.clear()
        else:
            self.state.update((at, rows.tobytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = _lines(b"".join(r["pack"] for r in rows))
        new = new[new[:, AT["start"]] * 1000 > timerValues.getCurrentWatermarkInMs()]
        if not len(new):
            return
        before, held = self._held()
        every = np.concatenate([held, new])
        got = newest_rows(every)
        self._hold(before, got, _starts(got))
        out = got[np.isin(got[:, AT["event_id"]], new[:, AT["event_id"]])]
        yield Row(rows=np.column_stack([out, _each_event(every, "ingested", out)]).tobytes())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, held = self._held()
        starts = _starts(held)
        wait = starts * 1000 > timerValues.getCurrentWatermarkInMs()
        self._hold(None, held[wait], starts[wait])  # the timer that has come is dropped by Spark
        return iter([])

    def close(self) -> None:
        pass


def _lines(packed: bytes, width: int = len(AT)) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, width)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(events, clock, pack): the rows of a group of events that may still be priced, packed, and the last ingestion of all that came with them."""
    needed = ~sum(1 << AT[c] for c in ("side", "point", "odds", "league"))  # null in any other column is never priced

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        rows = np.zeros((table.num_rows, len(AT)), np.int64)
        for c in HELD:
            x = table.column(c).combine_chunks()
            rows[:, AT[c]] = x.fill_null(0).to_numpy(zero_copy_only=False).view(np.int64)
            rows[:, -1] |= np.array(x.is_null()).astype(np.int64) << AT[c]
        known = rows[rows[:, -1] & (1 << AT["ingested"]) == 0, AT["ingested"]]
        if not len(known):
            return
        rows = rows[(rows[:, -1] & needed == 0) & (rows[:, AT["ingested"]] < rows[:, AT["start"]])]
        event = rows[:, AT["event_id"]]
        group = event // TOGETHER**2 * TOGETHER + event % TOGETHER
        order = np.argsort(group, kind="stable")
        groups, first = np.unique(group[order], return_index=True)
        rows, ends = rows[order], np.append(first, len(rows))
        parts = [rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if not parts:  # the clock goes on all the same
            groups, parts = np.zeros(1, np.int64), [b""]
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.full(len(groups), known.max())), pa.array(parts, pa.binary())], ["events", "clock", "pack"])

    held, n = [], 0
    for x in batches:
        held.append(x)
        n += x.num_rows
        if n >= CHUNK:
            yield from packs(held)
            held, n = [], 0
    if n:
        yield from packs(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = _lines(b"".join(r.as_py() for r in x.column(0)), len(AT) + 1)
        column = lambda c: np.ascontiguousarray(rows[:, AT[c]]).view(np.float64 if c == "point" else np.int64)
        columns = [pa.array(column(c), mask=rows[:, AT["nulls"]] >> AT[c] & 1 == 1) for c in HELD]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[:, -1])], [*HELD, "as_of"])


def touched_states(quotes: DataFrame, late: str) -> DataFrame:
    """The whole state of every event that a batch touches, with as_of: the last ingestion among its rows.

    Rows of events that have begun move the watermark but no state. A row within `late` of the last one is never left out for its time, one that
    comes later may be, as Spark has it.
    """
    x = quotes.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in QUOTE.split(", ")]).mapInArrow(_packed, "events long, clock long, pack binary")
    x = x.select("events", F.timestamp_seconds("clock").alias("arrived"), "pack").withWatermark("arrived", late)
    got = x.groupBy("events").transformWithState(EventState(), "rows binary", "Update", "EventTime")
    return got.mapInArrow(_unpacked, f"{QUOTE}, as_of long")


def _run(stream: DataFrame, path: str, step: Callable[[DataFrame, int], None], mode: str = "update"):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return query


def reprice(quotes: DataFrame, path: str, late: str = "1 hour", minimum: int = 2, outlier: float = 0.03):
    """Prices events as their quotes arrive, by the batch pipeline: fair value, best price, edge and expected value of every line.

    A batch writes the state of the events that it touches once, over that of the batch before last, and prices what it wrote: keyed state is run
    through once, and nothing that earlier batches wrote is read, so the cost of a batch does not grow with their number. Events are priced as of the last ingestion of their rows, and only before they start. Prices of batch n are
    in path/prices/batch=n; current_prices() reads them.
    """

    def step(touched: DataFrame, n: int) -> None:
        states, as_of = f"{path}/touched/{n % 2}", F.col("as_of")
        touched.write.mode("overwrite").parquet(states)
        known = touched.sparkSession.read.schema(touched.schema).parquet(states)
        # of a family there are the rows of one snapshot, which have the same clocks: those known by then are its latest state
        state = batch.known_by(known.where(F.col("start") > as_of), as_of)
        priced = batch.price_state(state.repartition(*batch.MARKET), minimum, outlier)
        priced.write.mode("overwrite").parquet(f"{path}/prices/batch={n}")

    with rocks(quotes.sparkSession):
        return _run(touched_states(quotes, late), path, step)


def current_prices(spark: SparkSession, path: str) -> DataFrame:
    """The prices of every event from the last batch that priced it; lines that it no longer had are gone."""
    every = spark.read.parquet(f"{path}/prices")
    last = every.groupBy("event_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["event_id", "batch"], "left_semi")


# ---- snapshots with their warnings


def land_snapshots(raw: DataFrame, path: str, before_commit: Callable[[int], None] | None = None):
    """Writes the outcomes of arriving JSON snapshots (snapshot_id, body) and the warnings about what could not be read.

    A batch is parsed once, and rows and warnings are written together; what it says of each snapshot is written last, and commits it:
    readers see all three tables of a batch or none. before_commit is called in between, for tests that need a batch to fail there.
    """

    def step(arrived: DataFrame, n: int) -> None:
        # rows and warnings stand in one folder, told apart by their reason: a folder of each would have every row sorted again
        snapshots.read_documents(arrived).write.mode("overwrite").parquet(f"{path}/documents/batch={n}")
        if before_commit:
            before_commit(n)
        found = arrived.sparkSession.read.schema(snapshots.DOCUMENTS).parquet(f"{path}/documents/batch={n}")
        one = lambda reason: F.when(reason, 1).otherwise(0).cast("long")
        each = found.select("snapshot_id", one(F.col("reason").isNull()).alias("rows"), one(F.col("reason").isNotNull()).alias("warnings"))
        # those of which there is neither row nor warning are named by what arrived
        none = arrived.select(F.col("snapshot_id").cast("long").alias("snapshot_id"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("warnings"))
        seen = each.unionAll(none).groupBy("snapshot_id").agg(F.sum("rows").alias("rows"), F.sum("warnings").alias("warnings"))
        seen.write.mode("overwrite").parquet(f"{path}/status/batch={n}")

    return _run(raw, path, step, "append")


def _committed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = f"{snapshots.DOCUMENTS}, batch long"
    try:
        done = spark.read.parquet(f"{path}/status").select("batch").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    wanted = F.col("reason").isNull() if kind == "rows" else F.col("reason").isNotNull()
    # done has a row per batch, though Spark takes its size from that of the status; shuffled by batch, the rows of each would be one task's
    return spark.read.schema(schema).parquet(f"{path}/documents").where(wanted).join(F.broadcast(done), "batch", "left_semi")


def landed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of all committed batches, as flatten_quotes() gives them."""
    return _committed(spark, path, "rows").drop("reason", "place", "batch")


def landed_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, reason, place) of all committed batches, as quarantine_malformed() gives them."""
    return _committed(spark, path, "warnings").select("snapshot_id", "reason", "place")


def landed_status(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, rows, warnings, status): success, or partial where anything of a snapshot was left out."""
    each = spark.read.parquet(f"{path}/status").groupBy("snapshot_id").agg(F.sum("rows").alias("rows"), F.sum("warnings").alias("warnings"))
    return each.withColumn("status", F.when(F.col("warnings") == 0, "success").otherwise("partial"))


# ---- as-of answers


def last_active(first: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """For each of m places the last of the ranges [first, end) that holds it, -1 where none does. The time is that of ranges + m log m, not that of their meetings."""
    width = end - first
    on = np.flatnonzero(width > 0)
    level = np.frexp(width[on])[1] - 1  # each range is two that overlap, of a length that is a power of two
    top = np.full((int(level.max(initial=0)) + 1, m), -1)
    for at in (first[on], end[on] - (1 << level)):
        np.maximum.at(top, (level, at), on)
    for k in range(len(top) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(top[k - 1], top[k], out=top[k - 1])
        np.maximum(top[k - 1][half:], top[k][:-half], out=top[k - 1][half:])
    return top[0]


class AnswerState(StatefulProcessor):
    """Keyed by event: the quotes that a request may still need, in chunks, and the requests that wait, answered in one sweep when the watermark is beyond them.

    One timer per event stands at the first request that waits. Quotes older than the horizon of every request that may still come are dropped then.
    Columns that may be null have none here, but a flag beside them, as pandas would make doubles of long ids with nulls.
    """

    ASKED = ["clock", "since", "request_id", "request_id_null"]
    TOLD = ["clock", "observed", "market", "market_null", "price", "price_null", "seq", "seq_null"]

    def init(self, handle) -> None:
        self.handle = handle
        self.told, self.asked = handle.getListState("told", "chunk binary"), handle.getListState("asked", "chunk binary")
        self.next = handle.getValueState("next", "at long")

    def _add(self, state, rows: pa.Table) -> None:
        if rows.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            state.appendValue((sink.getvalue().to_pybytes(),))

    def _held(self, state) -> pa.Table | None:
        chunks = [pa.ipc.open_stream(bytes(c[0])).read_all() for c in state.get()] if state.exists() else []
        return pa.concat_tables(chunks) if chunks else None

    def _wake(self, at: int) -> None:
        """The timer is put at a time in milliseconds, if it stands at none before."""
        before = self.next.get()
        if before is not None and before[0] <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            ask = df["kind"] == 1
            for state, names, part in ((self.asked, self.ASKED, df[ask]), (self.told, self.TOLD, df[~ask])):
                self._add(state, pa.table({c: part[c].to_numpy() for c in names}))
            if ask.any():
                self._wake(int((2 * df["clock"][ask] - df["since"][ask]).min()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        asked, told = self._held(self.asked), self._held(self.told)
        self.next.clear()
        due = np.zeros(0, bool)
        if asked is not None:
            clock, since = (asked[c].to_numpy() for c in ("clock", "since"))
            due = 2 * clock - since < now * 1000
            if told is not None:
                yield from self._swept(key[0], asked.filter(pa.array(due)), told)
            wait = asked.filter(pa.array(~due))
            self.asked.clear()
            self._add(self.asked, wait)
            if wait.num_rows:
                self._wake(int((2 * clock - since)[~due].min()) // 1000 + 1)
        if told is not None and due.any():
            # a later request has a time after the watermark, and a horizon as far before it as those that were asked, at most
            reach = int((clock - since).max())
            oldest = min(now * 1000 - reach, int(since[~due].min()) if not due.all() else now * 1000)
            self.told.clear()
            self._add(self.told, told.filter(pa.compute.greater_equal(told["clock"], oldest)))

    def _swept(self, event: int, asked: pa.Table, told: pa.Table) -> Iterator[pd.DataFrame]:
        clock, since = asked["clock"].to_numpy(), asked["since"].to_numpy()
        times, first = np.unique(clock, return_index=True)  # requests of one time share their answers
        opens = since[first]
        ids = asked.to_pandas().groupby(["clock", "request_id", "request_id_null"]).size().reset_index(name="again")
        ids["place"] = np.searchsorted(times, ids["clock"].to_numpy())
        t = {c: told[c].to_numpy() for c in self.TOLD}
        kind = np.where(t["price_null"], 0, np.where(np.isnan(t["price"]), 2, 1))  # no price, numbers, NaN
        order = np.lexsort((np.nan_to_num(t["price"]), kind, t["seq"], ~t["seq_null"], t["observed"]))
        t = {c: x[order] for c, x in t.items()}
        known = np.maximum(t["clock"], t["observed"])
        code, names = pd.factorize(pd.MultiIndex.from_arrays([t["market"], t["market_null"]]))
        for k, (market, nameless) in enumerate(names):
            on = np.flatnonzero(code == k)
            lo, hi = np.searchsorted(times, known[on]), np.searchsorted(opens, t["clock"][on], "right")
            on, lo, hi = on[lo < hi], lo[lo < hi], hi[lo < hi]
            m = len(times)
            n = np.cumsum(np.bincount(lo, minlength=m + 1) - np.bincount(hi, minlength=m + 1))[:m]
            if not n.any():
                continue
            last = last_active(lo, hi, m)
            got = ids[n[ids["place"]] > 0]
            at = got["place"].to_numpy()
            best = on[last[at]]
            own = {c: got[c].to_numpy() for c in ("request_id", "request_id_null")}
            yield pd.DataFrame({"event_id": event, "as_of": times[at], "market": market, "market_null": nameless, "quotes": n[at] * got["again"].to_numpy(), **own, **{c: t[c][best] for c in ("price", "price_null", "seq", "seq_null", "observed")}})

    def close(self) -> None:
        pass


def answers(requests: DataFrame, quotes: DataFrame, late: str = "1 hour", horizon: str = "3 days") -> DataFrame:
    """(request_id, as_of, event_id, market, quotes, price, seq, observed): what was known at each request's time, as a stream.

    requests: request_id, event_id, as_of. quotes: event_id, market, price, seq, observed, ingested. Both sides carry a watermark, and are kept by event:
    of the quotes ingested up to as_of and within the horizon before it, and observed by then, the
    one observed last answers (the larger seq of equals). A request is answered once the watermark has passed its time by the horizon, and what
    has been answered stays: a quote observed earlier but ingested after as_of never meets it, and one that comes in after the watermark
    only joins the history. Requests and quotes are swept in time order, so the work grows with their numbers, not with those that meet.
    """
    kinds = {n: k for df in (requests, quotes) for n, k in df.dtypes}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = lambda c: F.lit(0).cast(kinds[c])
    held = lambda *names: [x for c in names for x in (F.coalesce(c, none(c)).alias(c), F.col(c).isNull().alias(f"{c}_null"))]
    blank = lambda *names: [x for c in names for x in (none(c).alias(c), F.lit(True).alias(f"{c}_null"))]
    r = requests.withWatermark("as_of", late).where("event_id is not null and as_of is not null")
    since = F.unix_micros(F.col("as_of").cast("timestamp") - F.expr(f"INTERVAL {horizon}"))
    r = r.select("event_id", F.col("as_of").alias("at"), F.lit(1).alias("kind"), micros("as_of").alias("clock"), since.alias("since"), F.lit(0).cast("long").alias("observed"), *held("request_id"), *blank("market", "price", "seq"))
    q = quotes.withWatermark("ingested", late).where("event_id is not null and ingested is not null and observed is not null")
    q = q.select("event_id", F.col("ingested").alias("at"), F.lit(0).alias("kind"), micros("ingested").alias("clock"), F.lit(0).cast("long").alias("since"), micros("observed").alias("observed"), *blank("request_id"), *held("market", "price", "seq"))
    nullable = ("request_id", "market", "price", "seq")
    out = f"event_id {kinds['event_id']}, as_of long, quotes long, observed long, " + ", ".join(f"{c} {kinds[c]}, {c}_null boolean" for c in nullable)
    got = r.unionByName(q).groupBy("event_id").transformWithStateInPandas(AnswerState(), out, "Append", "EventTime")
    value = lambda c: F.coalesce(c, F.lit(float("nan"))) if kinds[c] in ("double", "float") else F.col(c)
    clean = [F.when(~F.col(f"{c}_null"), value(c)).alias(c) for c in nullable]
    return got.withColumns({c: F.timestamp_micros(c) for c in ("as_of", "observed")}).select("as_of", "event_id", "quotes", "observed", *clean).select("request_id", "as_of", "event_id", "market", "quotes", "price", "seq", "observed")


def answer(requests: DataFrame, quotes: DataFrame, path: str, late: str = "1 hour", horizon: str = "3 days"):
    """Runs answers() over what has arrived; every quote, late or not, is appended to path/history, answers to path/answers."""

    def append(table: str) -> Callable[[DataFrame, int], None]:
        return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={n}")

    _run(quotes, f"{path}/of-history", append("history"), "append")
    with rocks(quotes.sparkSession):
        return _run(answers(requests, quotes, late, horizon), f"{path}/of-answers", append("answers"), "append")
