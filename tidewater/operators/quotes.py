"""As-of state, gates, pairing, consensus and ranking of two-sided quotes.

A quote row has event_id, book_id, market, side (1 or 2), snapshot_id, point, odds and three clocks: requested,
observed, ingested (timestamps or epoch seconds). family = event, book, market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import labels, prices

FAMILY = ["event_id", "book_id", "market"]
MARKET = ["event_id", "market"]


def known_by(quotes: DataFrame, as_of) -> DataFrame:
    """Rows whose three clocks are at or before the cutoff; the filter reaches the scan."""
    return quotes.where((F.col("requested") <= as_of) & (F.col("observed") <= as_of) & (F.col("ingested") <= as_of))


def market_filter(quotes: DataFrame, leagues=None, markets=None, start_from=None, start_before=None) -> DataFrame:
    for name, values in (("league", leagues), ("market", markets)):
        quotes = quotes if values is None else quotes.where(F.col(name).isin(list(values)))
    quotes = quotes if start_from is None else quotes.where(F.col("start") >= start_from)
    return quotes if start_before is None else quotes.where(F.col("start") < start_before)


def latest_state(quotes: DataFrame, as_of=None) -> DataFrame:
    """All rows of the newest snapshot of every family, so a line that it lacks disappears.

    The newest snapshots are an aggregate, combined before its shuffle, of clocks and keys alone: one row per family,
    however long its history. No window holds or sorts the history, and only rows of those snapshots go on.
    """
    quotes = quotes if as_of is None else known_by(quotes, as_of)
    return restrict_to_latest(quotes, newest_snapshots(quotes))


def newest_snapshots(quotes: DataFrame) -> DataFrame:
    """(event_id, book_id, market, snapshot_id) of the newest snapshot of every family."""
    newest = F.max(F.struct("requested", "observed", "ingested", "snapshot_id"))
    return quotes.groupBy(*FAMILY).agg(newest.alias("_newest")).select(*FAMILY, F.col("_newest.snapshot_id").alias("snapshot_id"))


def restrict_to_latest(quotes: DataFrame, heads: DataFrame) -> DataFrame:
    return quotes.join(heads, [*FAMILY, "snapshot_id"], "left_semi")


def dedupe_within_snapshot(quotes: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(first row of every observation identity, the others)."""
    w = Window.partitionBy("snapshot_id", *FAMILY, "side", labels.point_key(F.col("point"))).orderBy(*order)
    ranked = quotes.withColumn("_rn", F.row_number().over(w))
    return ranked.where("_rn = 1").drop("_rn"), ranked.where("_rn > 1").drop("_rn")


def eligibility(as_of, stale_after: int, quote_age: int, books=None) -> Column:
    """First failing reason of a quote, null if it may be priced."""
    supported = F.lit(True) if books is None else F.col("book_id").isin(list(books))
    cutoff = F.lit(as_of)
    return (
        F.when(~supported | ~F.col("book_active"), "unsupported_or_inactive_book")
        .when(~F.col("matched"), "ambiguous_event")
        .when(F.col("status") != "active", "inactive_observation")
        .when(F.col("start") <= cutoff, "event_started")
        .when(labels.age_seconds(cutoff, F.col("requested")) > stale_after, "stale_snapshot")
        .when(labels.age_seconds(F.col("requested"), F.col("observed")) > quote_age, "pathologically_old_provider_quote")
    )


def reason_gate(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """All failing reasons of a row as an array; rules: reason -> failing condition."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])))


def pair_sides(quotes: DataFrame) -> DataFrame:
    """One row per family and line with both sides: odds, implied and no-vig probabilities, overround; a reason where the pair does not hold.

    A conditional aggregate, not a self join. A family of two rows, one for each side, is a pair whatever its points, which are
    then checked; its line is that of side 1. Of any other family the rows of one line are a pair: lines have one key for both sides.
    """
    line = F.when(F.col("market") == 1, F.when(F.col("side") == 2, -F.col("point")).otherwise(F.col("point"))).otherwise(F.col("point"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    family = Window.partitionBy(*FAMILY)
    whole = (F.count("*").over(family) == 2) & (F.count_if(F.col("side") == 1).over(family) == 1) & (F.count_if(F.col("side") == 2).over(family) == 1)
    paired = (
        quotes.withColumn("_line", line)
        .withColumn("line", F.when(whole, F.max(F.when(F.col("side") == 1, F.col("_line"))).over(family)).otherwise(F.col("_line")))
        .groupBy(*FAMILY, "line")
        .agg(
            F.count("*").alias("rows"), pick("odds", 1).alias("odds1"), pick("odds", 2).alias("odds2"), pick("point", 1).alias("point1"), pick("point", 2).alias("point2"),
            F.max("snapshot_id").alias("snapshot_id"), F.max("start").alias("start"), F.max("league").alias("league"),
        )
    )
    p1, p2 = prices.implied_probability(F.col("odds1")), prices.implied_probability(F.col("odds2"))
    reason = (
        F.when(F.col("odds1").isNull() | F.col("odds2").isNull(), "missing_side")
        .when(F.col("rows") != 2, "ambiguous_pair")
        .when((F.col("market") == 1) & (F.col("point1") != -F.col("point2")), "spread_points_differ")
        .when((F.col("market") == 2) & (F.col("point1") != F.col("point2")), "total_points_differ")
    )
    return paired.withColumn("reason", reason).withColumn("overround", p1 + p2 - 1).withColumn("fair1", p1 / (p1 + p2)).withColumn("fair2", 1 - F.col("fair1"))


def middle(values: Column) -> Column:
    """Exact median of an array."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor((n + 1) / 2).cast("int")
    return (F.get(s, half - 1) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def median_consensus(pairs: DataFrame, by: list[str], minimum: int = 2, outlier: float = 0.03) -> DataFrame:
    """Unweighted median of the no-vig probability over books, its dispersion, its ends, and books beyond the outlier distance."""
    books = F.collect_list(F.struct("fair1", "book_id"))
    got = pairs.groupBy(*by).agg(F.count("*").alias("books"), books.alias("_b"), (F.max("fair1") - F.min("fair1")).alias("dispersion"), F.min("fair1").alias("lowest"), F.max("fair1").alias("highest")).where(F.col("books") >= minimum)
    got = got.withColumn("consensus", middle(F.transform("_b", lambda x: x["fair1"])))
    out = F.array_sort(F.transform(F.filter("_b", lambda x: F.abs(x["fair1"] - F.col("consensus")) > outlier), lambda x: x["book_id"]))
    return got.withColumn("outliers", out).drop("_b")


def modal_line(pairs: DataFrame, by: list[str] = MARKET) -> DataFrame:
    """The most frequent line; ties by distance to the median line, then the lower one."""
    counts = pairs.groupBy(*by, "line").agg(F.count("*").alias("n"))
    med = pairs.groupBy(*by).agg(F.median("line").alias("median_line"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.abs(F.col("line") - F.col("median_line")), "line")
    return counts.join(med, by).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*by, "line", "n", "median_line")


def one_main_pair_per_book(pairs: DataFrame) -> DataFrame:
    """Of each book the pair nearest to the market's median line, then with the smallest overround, then the lower line."""
    med = pairs.groupBy(*MARKET).agg(F.median("line").alias("reference"))
    w = Window.partitionBy(*FAMILY).orderBy(F.abs(F.col("line") - F.col("reference")), F.abs("overround"), "line")
    return pairs.join(med, MARKET).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def robust_center(points: DataFrame, by: list[str], distance: float) -> DataFrame:
    """Weighted median of book centres (weights 1 / (1 + overround), kept in 0.5..2), then a Huber-weighted mean around it.

    points: by, book_id, center, weight. Two shuffles at most, both on `by`.
    """
    w = Window.partitionBy(*by)
    run = w.orderBy("center", "book_id").rowsBetween(Window.unboundedPreceding, 0)
    x = points.withColumn("weight", F.greatest(F.lit(0.5), F.least(F.lit(2.0), "weight")))
    x = x.withColumn("_run", F.sum("weight").over(run)).withColumn("_half", F.sum("weight").over(w) / 2)
    x = x.withColumn("wmedian", F.min(F.when(F.col("_run") >= F.col("_half"), F.col("center"))).over(w))
    x = x.withColumn("dev", F.abs(F.col("center") - F.col("wmedian"))).withColumn("mad", F.median("dev").over(w))
    cut = F.greatest(F.lit(0.5), F.col("mad") * 2.2239)
    x = x.withColumn("inf", F.col("weight") * F.when(F.col("dev") > 0, F.least(F.lit(1.0), cut / F.col("dev"))).otherwise(1.0))
    got = x.groupBy(*by).agg(
        F.count("*").alias("books"), F.max("wmedian").alias("weighted_median"), (F.sum(F.col("center") * F.col("inf")) / F.sum("inf")).alias("center"),
        (F.max("center") - F.min("center")).alias("center_dispersion"), F.collect_list(F.struct("center", "book_id")).alias("_b"),
    ).where("books >= 2")
    far = F.array_sort(F.transform(F.filter("_b", lambda b: F.abs(b["center"] - F.col("center")) > distance), lambda b: b["book_id"]))
    return got.withColumn("outliers", far).drop("_b")


def best_executable(quotes: DataFrame, by: list[str], largest_key: bool = True, along: list[str] = []) -> DataFrame:  # noqa: B006
    """Highest decimal price per side; ties take the largest (or the first) book key. along: columns read besides, see price_markets()."""
    price = prices.american_to_decimal(F.col("odds"))
    key = F.col("book_id") if largest_key else -F.col("book_id")
    return quotes.groupBy(*by).agg(F.max(F.struct(price.alias("price"), key.alias("key"), F.col("book_id"), F.col("odds"), *along)).alias("b")).select(*by, "b.book_id", "b.odds", "b.price")


def price_markets(quotes: DataFrame, as_of, minimum: int = 2, outlier: float = 0.03) -> DataFrame:
    """Consensus, best price, edge and expected value per event, market, line and side, as of a cutoff.

    Pairs and best prices both come from the latest state. Both read the same columns of it, dealt by family, so that Spark makes the state once and reuses its exchange.
    """
    return price_state(latest_state(quotes, as_of).repartition(*FAMILY), minimum, outlier)


def price_state(state: DataFrame, minimum: int = 2, outlier: float = 0.03) -> DataFrame:
    """price_markets() of a state that holds the newest snapshots alone."""
    pairs = pair_sides(state).where("reason is null")
    fair = median_consensus(pairs, [*MARKET, "line", "start", "league"], minimum, outlier)
    line = F.when((F.col("market") == 1) & (F.col("side") == 2), -F.col("point")).otherwise(F.col("point"))
    best = best_executable(state.withColumn("line", line), [*MARKET, "line", "side"], along=["start", "league"])
    best = best.withColumnsRenamed({"line": "_line", "event_id": "_event", "market": "_market"})
    got = fair.join(best, (F.col("event_id") == F.col("_event")) & (F.col("market") == F.col("_market")) & F.col("line").eqNullSafe(F.col("_line"))).drop("_event", "_market", "_line")
    p = F.when(F.col("side") == 1, F.col("consensus")).otherwise(1 - F.col("consensus"))
    return got.withColumn("fair", p).withColumn("edge", prices.edge(p, 1 / F.col("price"))).withColumn("ev", prices.ev_binary(p, F.col("price")))


def top_n_per_league(priced: DataFrame, n: int) -> DataFrame:
    order = [F.desc("ev"), F.desc("books"), "dispersion", "start", "event_id", "market", "side", F.coalesce("line", F.lit(0.0))]
    return priced.withColumn("rank", F.row_number().over(Window.partitionBy("league").orderBy(*order))).where(F.col("rank") <= n)


def pricing_funnel(state: DataFrame, reason: Column, as_of) -> DataFrame:
    """Counts of rows and of each rejection, and nearest-rank percentiles of the quotes' age."""
    age = labels.age_seconds(F.lit(as_of), F.col("observed"))
    count = lambda c: F.count_if(c)
    reasons = ["unsupported_or_inactive_book", "ambiguous_event", "inactive_observation", "event_started", "stale_snapshot", "pathologically_old_provider_quote"]
    x = state.withColumn("_r", reason).withColumn("_age", age)
    return x.agg(
        F.count("*").alias("rows"), count(F.col("_r").isNull()).alias("eligible"), *[count(F.coalesce(F.col("_r") == r, F.lit(False))).alias(r) for r in reasons],
        F.count_distinct("event_id").alias("events"), F.count_distinct("book_id").alias("books"), F.min("_age").alias("youngest"), F.max("_age").alias("oldest"),
        *[F.expr(f"percentile_disc({q}) within group (order by _age)").alias(f"age_p{int(q * 100)}") for q in (0.5, 0.9)],
    )


def rejection_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def history_series(quotes: DataFrame, by: list[str], books: list[int]) -> DataFrame:
    """Per snapshot time: median price over books and one column per book."""
    one = [F.max(F.when(F.col("book_id") == b, F.col("odds"))).alias(f"book_{b}") for b in books]
    return quotes.groupBy(*by, "requested").agg(F.median("odds").alias("median_odds"), *one)


def line_movement(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Ordered history with the change from the previous snapshot."""
    w = Window.partitionBy(*by).orderBy("requested", "snapshot_id")
    return quotes.withColumn("previous", F.lag("odds").over(w)).withColumn("change", F.col("odds") - F.col("previous"))


def asof_latest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Every left row with the values of the last right row at or before its time, by a union and a running last; no range join."""
    tag = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_k"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    other = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.lit(None).alias("_l"), F.struct(F.col(right_time).alias("_at"), *values).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_k", "_r").rowsBetween(Window.unboundedPreceding, 0)
    got = tag.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_k = 1")
    return got.select("_l.*", F.col("_r._at").alias(right_time), *[F.col(f"_r.{v}").alias(v) for v in values])


def quote_star(quotes: DataFrame, events: DataFrame, books: DataFrame) -> DataFrame:
    """Quotes with their event's and book's columns; Spark broadcasts a dimension only where its size allows."""
    return quotes.join(events, "event_id", "left").join(books, "book_id", "left")


def exact_line_consensus(pairs: DataFrame, minimum: int = 2) -> DataFrame:
    """Per market: its modal line, median probability and dispersion of the books at that line, and the best price of both sides (first book wins a tie)."""
    line = modal_line(pairs).select(*MARKET, "line")
    at = pairs.join(line, [*MARKET, "line"])
    best = lambda s: F.max(F.struct(prices.american_to_decimal(F.col(f"odds{s}")).alias("price"), (-F.col("book_id")).alias("_k"), "book_id")).alias(f"best{s}")
    got = median_consensus(at, [*MARKET, "line"], minimum)
    return got.join(at.groupBy(*MARKET, "line").agg(best(1), best(2)), [*MARKET, "line"]).select(*MARKET, "line", "books", "consensus", "dispersion", F.col("best1.price").alias("price1"), F.col("best1.book_id").alias("book1"), F.col("best2.price").alias("price2"), F.col("best2.book_id").alias("book2"))


def resolve_events(batch: DataFrame, mappings: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """batch (provider_id, identity, ..) with event_id and state.

    A missing id needs_review; an id with several identities, in the batch or against its mapping's event, is a conflict in all its rows;
    one with a mapping (provider_id -> event_id) to an event of the same identity is reused; one whose identity is
    a known event's (events: event_id, identity) is matched to it; any other is new.
    """
    n = batch.where("provider_id is not null").groupBy("provider_id").agg(F.count_distinct("identity").alias("identities"))
    x = batch.join(n, "provider_id", "left")
    if mappings is None or events is None:
        return x.withColumn("state", F.when(F.col("provider_id").isNull(), "needs_review").when(F.col("identities") > 1, "conflict").otherwise("matched"))
    held = mappings.join(events.select("event_id", F.col("identity").alias("_held")), "event_id").select("provider_id", F.col("event_id").alias("_mapped"), "_held")
    same = events.groupBy("identity").agg(F.min("event_id").alias("_same"), F.count("*").alias("_known"))
    x = x.join(held, "provider_id", "left").join(same, "identity", "left")
    clash = F.max((F.col("identities") > 1) | (F.col("_held").isNotNull() & (F.col("_held") != F.col("identity")))).over(Window.partitionBy("provider_id"))
    state = (
        F.when(F.col("provider_id").isNull(), "needs_review").when(clash, "conflict").when(F.col("_mapped").isNotNull(), "reused").when(F.col("_known") == 1, "matched")
        .when(F.col("_known") > 1, "needs_review").otherwise("new")
    )
    x = x.withColumn("state", state).withColumn("event_id", F.when(F.col("state") == "reused", F.col("_mapped")).when(F.col("state") == "matched", F.col("_same")))
    return x.drop("identities", "_held", "_mapped", "_same", "_known")


def latest_run_per_slate(runs: DataFrame, as_of: int) -> DataFrame:
    """The newest run known at `as_of` (epoch seconds) of every slate from that day on. runs: slate_date (days since 1970), run_id, created."""
    known = runs.where((F.col("created") <= as_of) & (F.col("slate_date") >= as_of // 86400))
    newest = F.max(F.struct("created", "run_id"))
    return known.groupBy("slate_date").agg(newest.alias("_m"), F.count("*").alias("runs")).select("slate_date", "_m.run_id", "_m.created", "runs")


def full_funnel(quotes: DataFrame, as_of, reason: Column, supported: Column, minimum_edge: float, minimum_ev: float) -> DataFrame:
    """(counter, value): every step from the observations received to the sides that qualify, and nearest-rank ages; one row per counter."""
    state = latest_state(quotes, as_of)
    age, wait = labels.age_seconds(F.col("requested"), F.col("observed")), labels.age_seconds(F.lit(as_of), F.col("requested"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by _age)")

    def long(df: DataFrame, **counters: Column) -> DataFrame:
        one = df.agg(*[c.cast("long").alias(k) for k, c in counters.items()])
        return one.unpivot([], list(counters), "counter", "value").select("counter", F.coalesce("value", F.lit(0)).alias("value"))

    seen = state.withColumn("_age", age).withColumn("_wait", wait).withColumn("_ok", supported).withColumn("_r", reason)
    priced = price_markets(quotes, as_of)
    better = (F.col("edge") >= minimum_edge) & (F.col("ev") >= minimum_ev)
    parts = [
        long(quotes, games_received=F.count_distinct("event_id"), observations_received=F.count("*")),
        long(known_by(quotes, as_of), observations_considered=F.count("*")),
        long(
            seen, games_analyzed=F.count_distinct("event_id"), latest_observations=F.count("*"), supported_book_observations=F.count_if("_ok"), unsupported_book_observations=F.count_if(~F.col("_ok")),
            supported_books_seen=F.count_distinct(F.when(F.col("_ok"), F.col("book_id"))), unsupported_books_seen=F.count_distinct(F.when(~F.col("_ok"), F.col("book_id"))), snapshot_age_seconds=F.max("_wait"),
            quote_age_min=F.min("_age"), quote_age_median=disc(0.5), quote_age_p90=disc(0.9), quote_age_max=F.max("_age"), eligible_observations=F.count_if(F.col("_r").isNull()),
        ),
        long(pair_sides(state).where("reason is null"), exact_paired_book_markets=F.count("*")),
        long(priced.select("event_id", "market", "line").distinct(), comparable_market_groups=F.count("*")),
        long(priced, calculable_candidate_sides=F.count("*"), positive_edge_candidates=F.count_if(F.col("edge") > 0), positive_ev_candidates=F.count_if(F.col("ev") > 0), pricing_qualified_candidates=F.count_if(better)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def bucket_returns(returns: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Count, mean expected value and mean return of bets per bucket [low, high) of a value; the outer buckets are open."""
    at = F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: F.col(value) >= e))
    return returns.where(F.col(value).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.avg("ev").alias("mean_ev"), F.avg("unit_return").alias("mean_return"))


def collapse_repeated_state(rows: DataFrame, key: list[str], immutable: list[str]) -> DataFrame:
    """One row per key with its immutable columns, and whether they agreed."""
    same = F.lit(True)
    for c in immutable:
        same = same & F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), *[F.min(c).alias(c) for c in immutable], same.alias("agrees"))


def group_usability(pairs: DataFrame, by: list[str], minimum: int = 2) -> DataFrame:
    """Complete and incomplete books of every group, whether it can be used, and why not."""
    got = pairs.groupBy(*by).agg(F.count_if(F.col("reason").isNull()).alias("complete"), F.count_if(F.col("reason").isNotNull()).alias("incomplete"))
    why = F.concat_ws(";", F.when(F.col("complete") == 0, "no_complete_book"), F.when(F.col("complete") < minimum, "too_few_books"), F.when(F.col("incomplete") > 0, "incomplete_books"))
    return got.withColumn("usable", F.col("complete") >= minimum).withColumn("why", why)


def coverage_by_dimensions(groups: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The same measures over several key sets."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    got = groups.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count("*").alias("groups"), F.count_if("usable").alias("usable"), F.count_if(F.col("complete") >= 3).alias("three_books"), F.sum("complete").alias("books"))
    return got.withColumn("usable_share", F.col("usable") / F.col("groups"))


def coverage_report(records: DataFrame, primary: Column) -> DataFrame:
    """(scope, season, cohort, slate, horizon, market) with the same measures over six key sets, two of them on the primary cohort alone.

    records, one per game, horizon and market: season, cohort, slate, horizon, market, usable, distance (seconds, null if unknown),
    eligible, books, complete, supported (complete supported books), mapping (reliable, ambiguous, missing). One grouping-sets aggregate each.
    """
    keys = ["season", "cohort", "slate", "horizon", "market"]
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    disc = lambda q, c: F.expr(f"percentile_disc({q}) within group (order by {c})").cast("long")
    measures = [
        F.count("*").alias("requested"), F.count_if("usable").alias("usable"), pct(F.col("usable")).alias("coverage_pct"), disc(0.5, "distance").alias("distance_p50"), disc(0.9, "distance").alias("distance_p90"),
        pct(F.col("eligible")).alias("fidelity_pct"), F.min("supported").alias("supported_min"), disc(0.5, "supported").alias("supported_p50"), F.max("supported").alias("supported_max"),
        pct(F.col("supported") >= 2).alias("two_books_pct"), pct(F.col("supported") >= 3).alias("three_books_pct"), F.round(100 * F.try_divide(F.sum("complete"), F.sum("books")), 6).alias("completeness_pct"),
        *[F.count_if(F.col("mapping") == m).alias(f"{m}_mappings") for m in ("reliable", "ambiguous", "missing")],
    ]

    def over(rows: DataFrame, scope: str, sets: list[list[str]]) -> DataFrame:
        got = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*measures)
        return got.select(F.lit(scope).alias("scope"), *got.columns)

    narrow = [["season", "horizon", "market"], ["horizon", "market"]]
    every = over(records, "all", [*narrow, ["cohort", "horizon", "market"], ["season", "slate", "horizon", "market"]])
    return every.unionAll(over(records.where(primary), "primary", narrow))


def approve(coverage: DataFrame, by: list[str], share: float) -> DataFrame:
    """GO where every row of a group reaches the share, CONDITIONAL where some does, else NO-GO."""
    ok = F.col("usable_share") >= share
    return coverage.groupBy(*by).agg(F.when(F.bool_and(ok), "GO").when(F.bool_or(ok), "CONDITIONAL").otherwise("NO-GO").alias("verdict"), F.min("usable_share").alias("worst"))


def freshness_state(snapshots: DataFrame, now, limit: int, tie: str | None = None) -> DataFrame:
    """Last success and attempt per source, age and state. snapshots: source, at, ok; of attempts at one time the largest `tie` is the last."""
    latest = F.struct("at", tie) if tie else F.col("at")
    got = snapshots.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max("at").alias("last_attempt"), F.max_by("ok", latest).alias("last_ok"))
    age = labels.age_seconds(F.lit(now), F.col("last_success"))
    state = F.when(F.col("last_success").isNull(), "UNAVAILABLE").when(~F.col("last_ok"), "ERROR").when(age <= limit, "FRESH").otherwise("STALE")
    return got.withColumn("age", age).withColumn("state", state)


def slate_summary(priced: DataFrame, day: str) -> DataFrame:
    """Market groups (event and line, or the event where there is none) per slate and market, and the books of all groups, each group's once."""
    groups = priced.groupBy(day, "market", "event_id", "line").agg(F.max("books").alias("books"))
    return groups.groupBy(day, "market").agg(F.count("*").alias("groups"), F.sum("books").alias("books"))


def threshold_sweep(returns: DataFrame, thresholds: list[float]) -> DataFrame:
    """Count, mean expected value and mean return of bets at or above each threshold; one pass, one array entry per threshold met."""
    met = F.filter(F.lit(thresholds), lambda t: F.col("ev") >= t)
    return returns.withColumn("threshold", F.explode(met)).groupBy("threshold").agg(F.count("*").alias("n"), F.avg("ev").alias("mean_ev"), F.avg("unit_return").alias("mean_return"))


def distinct_members(quotes: DataFrame, by: list[str]) -> DataFrame:
    return quotes.groupBy(*by).agg(F.array_sort(F.collect_set("book_id")).alias("books"), F.count_distinct("snapshot_id").alias("snapshots"))


def merge_funnels(funnels: DataFrame, by: list[str]) -> DataFrame:
    """Sums of counters, extremes of gauges and the row-weighted median of the median age."""
    w = Window.partitionBy(*by).orderBy("age_p50", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = funnels.withColumn("_run", F.sum("rows").over(w)).withColumn("_all", F.sum("rows").over(Window.partitionBy(*by)))
    return x.groupBy(*by).agg(F.sum("rows").alias("rows"), F.min("youngest").alias("youngest"), F.max("oldest").alias("oldest"), F.min(F.when(F.col("_run") * 2 >= F.col("_all"), F.col("age_p50"))).alias("age_p50"))


def pipeline_status(funnel: DataFrame, share: float = 0.5) -> DataFrame:
    """ok, degraded (too few rows may be priced) or empty."""
    return funnel.withColumn("status", F.when(F.col("rows") == 0, "empty").when(F.col("eligible") < share * F.col("rows"), "degraded").otherwise("ok"))


def historical_coverage(groups: DataFrame, by: list[str]) -> DataFrame:
    """Share of usable groups, of those with two and three complete books, and nearest-rank percentiles of the books."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by complete)").cast("long")
    return groups.groupBy(*by).agg(F.count("*").alias("groups"), F.avg(F.col("usable").cast("int")).alias("usable_share"), F.avg((F.col("complete") >= 2).cast("int")).alias("two_books"), F.avg((F.col("complete") >= 3).cast("int")).alias("three_books"), at(0.5).alias("books_p50"), at(0.9).alias("books_p90"))


def reason_frequency(groups: DataFrame, by: list[str], reasons: str = "why", sep: str = ";") -> DataFrame:
    """How often each reason stands in a joined list of reasons; rows without one add nothing."""
    each = groups.select(*by, F.explode(F.split(reasons, sep)).alias("reason")).where("reason <> ''")
    return each.groupBy(*by, "reason").agg(F.count("*").alias("n"))
