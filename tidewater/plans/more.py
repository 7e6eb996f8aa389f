"""Queries of sources, exposure, coverage and streams. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import prices
from tidewater.operators import evaluate, exposure, features, ledger, quotes
from tidewater.plans.fixtures import AS_OF, view
from tidewater.plans.queries import BAND, BEST, CONS, DEC, HEADS, KNOWN, ORACLES, PAIRS, PRICED, QUERIES, STATE, d6, doubles, pairs, query, r6, rounded, state
from tidewater.sources import snapshots
from tidewater.streaming import quotes as streams

ASOF = f", {KNOWN}, {HEADS}, {STATE}"

# ---- sources


def raw(v):
    """Snapshots nested again as JSON, every 50th damaged, every 70th with a key that must not be stored."""
    x = snapshots.nest_quotes(v("quotes"))
    body = F.when(F.col("snapshot_id") % 50 == 0, F.substring("body", 1, 20)).when(F.col("snapshot_id") % 70 == 1, F.regexp_replace("body", r"^\{", '{"apiKey":"x",')).otherwise(F.col("body"))
    return x.withColumn("body", body)


@query("s1_flatten_quotes", "SELECT snapshot_id, event_id, book_id, market, side, odds, point + 0e0 AS point, CAST(count(*) AS BIGINT) AS n FROM quotes WHERE snapshot_id % 50 <> 0 AND snapshot_id % 70 <> 1 GROUP BY ALL", ("quotes",))
def _(v):
    good, _bad = snapshots.quarantine_malformed(raw(v))
    return snapshots.flatten_quotes(good).groupBy("snapshot_id", "event_id", "book_id", "market", "side", "odds", "point").agg(F.count("*").alias("n"))


@query("s5_dataset_fingerprint")
def _(v):
    return snapshots.dataset_fingerprint(v("lineitem"))


@query("s6_validate_dataset", """SELECT 'row_count' AS rule, 1 AS n UNION ALL SELECT 'season_fence', count(*) FROM games WHERE season > 2000 UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT home, kickoff FROM games GROUP BY ALL HAVING count(*) > 1)""", ("games",))
def _(v):
    g = v("games")
    return snapshots.validate_dataset(g, ["home", "kickoff"], "season", 2000, g.count() + 1)


@query("s13_profile_columns", "SELECT count(*) AS rows, 'o_custkey' AS column, 0 AS nulls, count(DISTINCT o_custkey) AS distinct_values FROM orders UNION ALL SELECT count(*), 'o_orderstatus', 0, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT count(*), 'o_orderdate', 0, count(DISTINCT o_orderdate) FROM orders")
def _(v):
    return snapshots.profile_columns(v("orders"), ["o_custkey", "o_orderstatus", "o_orderdate"])


@query("s14_build_request_plan", ", d AS (SELECT min(kickoff) OVER (PARTITION BY kickoff // 86400) - 10800 AS due, game_id FROM games UNION SELECT kickoff - 3600, game_id FROM games UNION SELECT kickoff - 300, game_id FROM games) SELECT due, count(*) AS games, min(game_id) AS first_game FROM d GROUP BY due", ("games",))
def _(v):
    return snapshots.build_request_plan(v("games").withColumn("day", F.floor(F.col("kickoff") / 86400))).withColumnRenamed("at", "due")


# ---- joins and coverage


@query("j1_quote_star", "SELECT event_id, book_id, market, side, snapshot_id, line_no, quantity, p_brand, s_name FROM quotes LEFT JOIN part ON event_id = p_partkey LEFT JOIN supplier ON book_id = s_suppkey", ("quotes",))
def _(v):
    events = v("part").select(F.col("p_partkey").alias("event_id"), "p_brand")
    books = v("supplier").select(F.col("s_suppkey").alias("book_id"), "s_name")
    return quotes.quote_star(v("quotes"), events, books).select("event_id", "book_id", "market", "side", "snapshot_id", "line_no", "quantity", "p_brand", "s_name")


@query("j18_collapse_repeated_state", "SELECT event_id, count(*) AS rows, min(start) AS start, min(league) AS league, min(status) AS status, min(status) = max(status) AS agrees FROM quotes GROUP BY event_id", ("quotes",))
def _(v):
    return quotes.collapse_repeated_state(v("quotes"), ["event_id"], ["start", "league", "status"])


@query("a3_exact_line_consensus", f"""{ASOF}, {PAIRS}, g AS (SELECT event_id, market, line, count(*) AS n FROM p WHERE reason IS NULL AND market > 0 GROUP BY ALL), m AS (SELECT event_id, market, median(line) AS med FROM p WHERE reason IS NULL AND market > 0 GROUP BY ALL),
    l AS (SELECT event_id, market, line FROM g JOIN m USING (event_id, market) QUALIFY row_number() OVER (PARTITION BY event_id, market ORDER BY n DESC, abs(line - med), line) = 1),
    t AS (SELECT event_id, market, line, count(*) AS books, median(fair1) AS consensus, max(fair1) - min(fair1) AS dispersion, max((1 / x1, -book_id)) AS m1, max((1 / x2, -book_id)) AS m2 FROM p JOIN l USING (event_id, market, line) WHERE reason IS NULL GROUP BY ALL HAVING count(*) >= 2)
    SELECT event_id, market, line, books, {d6('consensus')} AS consensus, {d6('dispersion')} AS dispersion, {d6('m1[1]')} AS price1, {d6('m2[1]')} AS price2 FROM t""", ("quotes",))
def _(v):
    return rounded(quotes.exact_line_consensus(pairs(v).where("market > 0")).drop("book1", "book2"), "consensus", "dispersion", "price1", "price2")


USABLE = "us AS (SELECT event_id, market, event_id % 3 AS league, count(*) FILTER (reason IS NULL) AS complete, count(*) FILTER (reason IS NOT NULL) AS incomplete FROM p GROUP BY ALL)"


def usable(v):
    return quotes.group_usability(quotes.pair_sides(state(v)), ["event_id", "market", "league"])


@query("a14_group_usability", f"""{ASOF}, {PAIRS}, {USABLE} SELECT event_id, market, complete, incomplete, complete >= 2 AS usable,
    concat_ws(';', CASE WHEN complete = 0 THEN 'no_complete_book' END, CASE WHEN complete < 2 THEN 'too_few_books' END, CASE WHEN incomplete > 0 THEN 'incomplete_books' END) AS why FROM us""", ("quotes",))
def _(v):
    return usable(v).drop("league")


COVER = "SELECT market, league, count(*) AS groups, count(*) FILTER (complete >= 2) AS usable, count(*) FILTER (complete >= 3) AS three_books, CAST(sum(complete) AS BIGINT) AS books, count(*) FILTER (complete >= 2) / count(*) AS usable_share FROM us GROUP BY GROUPING SETS ((market), (league), (market, league))"


@query("a9_coverage_by_dimensions", f"{ASOF}, {PAIRS}, {USABLE} SELECT CAST(market AS DOUBLE) AS market, CAST(league AS DOUBLE) AS league, groups, usable, three_books, books, {d6('usable_share')} AS usable_share FROM ({COVER})", ("quotes",))
def _(v):
    return doubles(rounded(quotes.coverage_by_dimensions(usable(v), [["market"], ["league"], ["market", "league"]]), "usable_share"), "market", "league")


@query("a11_approve_horizons", f"{ASOF}, {PAIRS}, {USABLE} SELECT market, CASE WHEN bool_and(usable_share >= 0.99) THEN 'GO' WHEN bool_or(usable_share >= 0.99) THEN 'CONDITIONAL' ELSE 'NO-GO' END AS verdict, {d6('min(usable_share)')} AS worst FROM ({COVER}) WHERE market IS NOT NULL AND league IS NOT NULL GROUP BY market", ("quotes",))
def _(v):
    c = quotes.coverage_by_dimensions(usable(v), [["market", "league"]])
    return rounded(quotes.approve(c, ["market"], 0.99), "worst")


@query("a15_freshness_state", """SELECT event_type AS source, CAST(max(epoch(ts)) FILTER (event_id % 3 <> 0) AS DOUBLE) - CAST(max(epoch(ts)) FILTER (event_id % 3 <> 0) AS DOUBLE) AS zero, CASE WHEN max((ts, event_id))[2] % 3 = 0 THEN 'ERROR' WHEN greatest(0, 1706572800 - floor(max(epoch(ts)) FILTER (event_id % 3 <> 0))) <= 3600 THEN 'FRESH' ELSE 'STALE' END AS state FROM events GROUP BY event_type""")
def _(v):
    e = v("events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 != 0).alias("ok"), "event_id")
    return quotes.freshness_state(e, 1706572800, 3600, "event_id").select("source", F.lit(0.0).alias("zero"), "state")


@query("a21_threshold_sweep", f"""{ASOF}, {PAIRS}, {CONS}, {BEST}, {PRICED}, r AS (SELECT fair * price - 1 AS ev, CASE WHEN event_id % 2 = side - 1 THEN price - 1 ELSE -1 END AS u FROM x), t AS (SELECT unnest([-0.05, 0.0, 0.02, 0.05, 0.1])::DOUBLE AS threshold)
    SELECT threshold, count(*) AS n, {d6('avg(ev)')} AS mean_ev, {d6('avg(u)')} AS mean_return FROM t JOIN r ON ev >= threshold GROUP BY threshold""", ("quotes",))
def _(v):
    x = quotes.price_markets(v("quotes"), AS_OF)
    result = F.when(F.col("event_id") % 2 == F.col("side") - 1, "win").otherwise("loss")
    return rounded(quotes.threshold_sweep(x.withColumn("unit_return", prices.unit_return(result, F.col("price"))), [-0.05, 0.0, 0.02, 0.05, 0.1]), "mean_ev", "mean_return")


@query("u4_distinct_members", "SELECT event_id, array_to_string(list_sort(list(DISTINCT book_id)), ',') AS books, count(DISTINCT snapshot_id) AS snapshots FROM quotes GROUP BY event_id", ("quotes",))
def _(v):
    return quotes.distinct_members(v("quotes"), ["event_id"]).withColumn("books", F.array_join("books", ","))


@query("u1_union_by_name", "SELECT game_id, season, NULL::DOUBLE AS actual FROM games UNION ALL SELECT game_id, NULL, actual FROM predictions", ("games", "predictions"))
def _(v):
    a = v("games").select("game_id", F.col("season").cast("double").alias("season"))
    return a.unionByName(v("predictions").select("game_id", "actual"), allowMissingColumns=True)


ORACLES["u1_union_by_name"] = ORACLES["u1_union_by_name"].replace("SELECT game_id, season, NULL::DOUBLE AS actual FROM games", "SELECT game_id, CAST(season AS DOUBLE) AS season, NULL::DOUBLE AS actual FROM games")


@query("u2_id_sets", "SELECT 'both' AS side, count(*) AS n FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders) UNION ALL SELECT 'only_orders', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def _(v):
    a, b = v("orders").select(F.col("o_orderkey").alias("id")), v("lineitem").select(F.col("l_orderkey").alias("id"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only_orders"))


@query("t4_top_differences", "SELECT season, week, n, d FROM (SELECT season, week, count(*) AS n, abs(count(*) - 45) AS d FROM games GROUP BY ALL) ORDER BY d DESC, season, week LIMIT 100", ("games",))
def _(v):
    x = v("games").groupBy("season", "week").agg(F.count("*").alias("n")).withColumn("d", F.abs(F.col("n") - 45))
    return x.select("season", "week", "n", "d").orderBy(F.desc("d"), "season", "week").limit(100)


@query("t5_recent", "SELECT game_id, kickoff FROM games ORDER BY kickoff DESC, game_id DESC LIMIT 50", ("games",))
def _(v):
    return v("games").select("game_id", "kickoff").orderBy(F.desc("kickoff"), F.desc("game_id")).limit(50).orderBy("kickoff", "game_id")


@query("l9_score_outcomes", f"SELECT bet_id, CASE WHEN state = 'open' THEN 'pending' ELSE state END AS result, {d6('CASE WHEN state = $$won$$ THEN (closing_p - 1) * (closing_p - 1) WHEN state = $$lost$$ THEN closing_p * closing_p END')} AS brier FROM bets", ("bets",))
def _(v):
    won = F.when(F.col("state") == "won", 1.0).when(F.col("state") == "lost", 0.0)
    return v("bets").select("bet_id", F.when(F.col("state") == "open", "pending").otherwise(F.col("state")).alias("result"), r6(evaluate.brier(F.col("closing_p"), won)).alias("brier"))


@query("l10_shadow_summary", "SELECT CAST(league AS DOUBLE) AS league, CAST(market AS DOUBLE) AS market, count(*) AS total, count(*) FILTER (state = 'open') AS pending FROM bets GROUP BY GROUPING SETS ((), (league), (league, market))", ("bets",))
def _(v):
    got = v("bets").groupingSets([[], ["league"], ["league", "market"]], "league", "market").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "open").alias("pending"))
    return doubles(got, "league", "market")


@query("l5_exposures", "SELECT bet_id, b.event_id, stake, home, away FROM bets b JOIN games g ON b.event_id = g.game_id WHERE state = 'open'", ("bets", "games"))
def _(v):
    return ledger.exposures(v("bets"), v("games")).select("bet_id", "event_id", "stake", "home", "away")


@query("g9_play_counts", "SELECT g.game_id, neutral, count(p.game_id) AS plays FROM games g LEFT JOIN plays p ON p.game_id = g.game_id GROUP BY ALL", ("plays",))
def _(v):
    n = v("plays").groupBy("game_id").agg(F.count("*").alias("plays"))
    return v("games").join(n, "game_id", "left").select("game_id", "neutral", F.coalesce("plays", F.lit(0)).alias("plays"))


@query("g3_transfer_counts", ", m AS (SELECT home AS team, 'out' AS way, total FROM games UNION ALL SELECT away, 'in', total FROM games) SELECT team, count(*) FILTER (way = 'in') AS moved_in, count(*) FILTER (way = 'out') AS moved_out, CAST(coalesce(sum(total) FILTER (way = 'in'), 0) AS BIGINT) AS rating_in, CAST(coalesce(sum(total) FILTER (way = 'out'), 0) AS BIGINT) AS rating_out FROM m GROUP BY team", ("games",))
def _(v):
    way = F.explode(F.array(F.struct(F.col("home").alias("team"), F.lit("out").alias("way")), F.struct(F.col("away").alias("team"), F.lit("in").alias("way"))))
    x = v("games").select(way.alias("w"), "total")
    at = lambda w, c: F.coalesce(F.sum(F.when(F.col("w.way") == w, c)), F.lit(0))
    return x.groupBy("w.team").agg(at("in", 1).alias("moved_in"), at("out", 1).alias("moved_out"), at("in", F.col("total")).alias("rating_in"), at("out", F.col("total")).alias("rating_out"))


# ---- exposure


def candidates(v):
    x = quotes.price_markets(v("quotes"), AS_OF)
    return x.select(
        F.concat_ws("/", "event_id", "market", F.coalesce(F.col("line").cast("string"), F.lit("none")), "side").alias("candidate_id"), "event_id", "market", "side", (F.col("event_id") % 130).alias("home"), ((F.col("event_id") * 7 + 1) % 130).alias("away"),
        "fair", F.when(F.col("side") == 1, F.col("lowest")).otherwise(1 - F.col("highest")).alias("worst"), F.lit(0.0).alias("push"), "price", "odds", r6("edge").alias("edge"),
        F.when(F.array_contains("outliers", F.col("book_id")), 2).when(F.size("outliers") > 0, 1).otherwise(0).alias("integrity"), r6("ev").alias("ev"), "books", r6("dispersion").alias("dispersion"), (F.col("event_id") % 1000).alias("age"), "start", F.floor(F.col("start") / 86400).alias("slate"),
    )


CAND = f"""{ASOF}, {PAIRS}, {CONS}, {BEST}, {PRICED}, ca AS (SELECT event_id, market, line, side, book_id, consensus, fair, price, odds, books, start, event_id % 1000 AS age, {d6('fair - 1 / price')} AS edge, {d6('fair * price - 1')} AS ev, {d6('dispersion')} AS dispersion, event_id % 130 AS home, (event_id * 7 + 1) % 130 AS away FROM x),
    ev AS (SELECT *, list_filter([CASE WHEN books < 2 THEN 'insufficient_book_depth' END, CASE WHEN dispersion > 0.06 THEN 'excessive_or_unknown_dispersion' END, CASE WHEN age > 120 THEN 'stale_or_future_fair_value' END, CASE WHEN edge < 0.0075 THEN 'below_minimum_edge' END, CASE WHEN ev < 0.015 THEN 'below_minimum_ev' END, CASE WHEN odds > 500 THEN 'outside_main_board_odds_profile' END], lambda r: r IS NOT NULL) AS reasons,
        CASE WHEN dispersion <= 0.015e0 THEN 1.0e0 WHEN dispersion <= 0.03e0 THEN 0.75e0 ELSE 0.4e0 END AS multiplier FROM ca),
    cl AS (SELECT *, len(reasons) = 0 AS qualified, CASE WHEN len(reasons) = 0 THEN CASE WHEN ev >= 0.03 AND edge >= 0.015 AND dispersion <= 0.03 THEN 'CORE' ELSE 'OPPORTUNISTIC' END END AS class FROM ev)"""


@query("b1_evaluate_candidates", f"{CAND} SELECT event_id, market, side, array_to_string(reasons, ',') AS reasons, qualified, class, multiplier, count(*) AS n FROM cl GROUP BY ALL", ("quotes",))
def _(v):
    got = exposure.evaluate_candidates(candidates(v)).withColumn("reasons", F.array_join("reasons", ","))
    return got.groupBy("event_id", "market", "side", "reasons", "qualified", "class", "multiplier").agg(F.count("*").alias("n"))


@query("b2_portfolio_state", ", e AS (SELECT portfolio, 2000000 + CAST(sum(profit) AS BIGINT) AS equity FROM bets GROUP BY portfolio) SELECT portfolio, equity, CASE WHEN equity <= 1000000 OR (2000000 - equity) / 2000000e0 >= 0.2 THEN 'PAUSED' WHEN (2000000 - equity) / 2000000e0 >= 0.1 THEN 'REDUCED_RISK' ELSE 'NORMAL' END AS state FROM e", ("bets",))
def _(v):
    e = v("bets").groupBy("portfolio").agg((F.sum("profit") + 2_000_000).alias("equity"))
    return e.withColumn("state", exposure.portfolio_state(F.col("equity"), F.lit(2_000_000), (2_000_000 - F.col("equity")) / 2e6))


KELLY = "greatest(0, ((price - 1) * fair - (1 - fair)) / (price - 1))"


@query("b3_kelly_allocation", f"{CAND} SELECT event_id, market, coalesce(line, -999) AS line, side, {d6(KELLY)} AS raw_kelly, {d6(f'{KELLY} * 0.25e0 * multiplier * CASE WHEN class = $$OPPORTUNISTIC$$ THEN 0.6e0 ELSE 1e0 END')} AS adjusted_kelly FROM cl WHERE qualified", ("quotes",))
def _(v):
    got = exposure.kelly_allocation(exposure.evaluate_candidates(candidates(v)).where("qualified"))
    line = F.split("candidate_id", "/")[2]
    return rounded(got.select("event_id", "market", F.when(line == "none", -999.0).otherwise(line.try_cast("double")).alias("line"), "side", "raw_kelly", "adjusted_kelly"), "raw_kelly", "adjusted_kelly")


EQUITY, CASH = 3000.0, 2000.0


def held(v):
    """Open bets with their game's teams, dealt to the slates of the board."""
    return ledger.exposures(v("bets"), v("games")).withColumn("slate", 11688 + F.col("bet_id") % 30)


def exposed(v):
    """Open stakes by slate, game, team and market as shares of an equity of eight times their sum."""
    open_ = held(v)
    by = ledger.exposure_by(open_).select("kind", "value", "stake")
    by = by.unionByName(open_.groupBy("slate").agg(F.sum("stake").alias("stake")).select(F.lit("slate").alias("kind"), F.col("slate").cast("string").alias("value"), "stake"))
    return by.join(open_.agg((F.sum("stake") * 8.0).alias("equity"))).withColumn("fraction", F.col("stake") / F.col("equity"))


def ranked(v):
    c = exposure.kelly_allocation(exposure.evaluate_candidates(candidates(v)).where("qualified"))
    c = exposure.mark_opposed(c, v("bets").where("state = 'open'"))
    return exposure.rank_candidates(exposure.rank_with_caps(c, exposed(v), EQUITY, CASH), ["slate"])


KEY = "concat_ws('/', event_id, market, coalesce(CAST(line AS VARCHAR), 'none'), side)"
CAPS = f"""{CAND}, op AS (SELECT b.*, 11688 + bet_id % 30 AS slate, g.home, g.away FROM bets b JOIN games g ON g.game_id = b.event_id WHERE state = 'open'), te AS (SELECT sum(stake) * 8e0 AS equity FROM op),
    ek AS (SELECT 'slate' AS kind, slate AS k, sum(stake) AS st FROM op GROUP BY slate UNION ALL SELECT 'game', event_id, sum(stake) FROM op GROUP BY event_id UNION ALL SELECT 'market', market, sum(stake) FROM op GROUP BY market
        UNION ALL SELECT 'team', t, sum(stake) FROM (SELECT home AS t, stake FROM op UNION ALL SELECT away, stake FROM op) GROUP BY t), ex AS (SELECT kind, k, st / equity AS f FROM ek, te),
    bk AS (SELECT c.event_id, c.market, c.line, min(fair1) AS lowest, max(fair1) AS highest, count(*) FILTER (abs(fair1 - consensus) > 0.03e0) AS n_out, list(p.book_id) FILTER (abs(fair1 - consensus) > 0.03e0) AS out_books
        FROM p JOIN c ON c.event_id = p.event_id AND c.market = p.market AND c.line IS NOT DISTINCT FROM p.line WHERE p.reason IS NULL GROUP BY ALL),
    q AS (SELECT cl.*, {KEY.replace('event_id', 'cl.event_id').replace('market', 'cl.market').replace('line', 'cl.line')} AS candidate_id, start // 86400 AS slate, {KELLY} * 0.25e0 * multiplier * CASE WHEN class = 'CORE' THEN 1e0 ELSE 0.6e0 END AS adjusted,
        CASE WHEN side = 1 THEN lowest ELSE 1 - highest END AS worst, CASE WHEN list_contains(out_books, book_id) THEN 2 WHEN n_out > 0 THEN 1 ELSE 0 END AS integrity, least(CASE WHEN class = 'CORE' THEN 0.02e0 ELSE 0.01e0 END, 50e0 / 3000) AS left_bet
        FROM cl JOIN bk ON bk.event_id = cl.event_id AND bk.market = cl.market AND bk.line IS NOT DISTINCT FROM cl.line WHERE qualified),
    lf AS (SELECT q.*, 0.08e0 - coalesce(s.f, 0) AS left_daily, 0.04e0 - coalesce(g.f, 0) AS left_game, 0.04e0 - coalesce(g.f, 0) AS left_correlated, 0.05e0 - greatest(coalesce(h.f, 0), coalesce(w.f, 0)) AS left_team, 0.05e0 - coalesce(m.f, 0) AS left_market,
        EXISTS (SELECT 1 FROM bets o WHERE o.state = 'open' AND o.event_id = q.event_id AND o.market = q.market AND o.side <> q.side) AS opposed
        FROM q LEFT JOIN ex s ON s.kind = 'slate' AND s.k = q.slate LEFT JOIN ex g ON g.kind = 'game' AND g.k = q.event_id LEFT JOIN ex h ON h.kind = 'team' AND h.k = q.home LEFT JOIN ex w ON w.kind = 'team' AND w.k = q.away LEFT JOIN ex m ON m.kind = 'market' AND m.k = q.market),
    fr AS (SELECT *, greatest(0, least(adjusted, left_bet, 2e0 / 3, left_daily, left_game, left_correlated, left_team, left_market)) AS fraction FROM lf),
    gr AS (SELECT *, fair * ln(1 + fraction * (price - 1)) + (1 - fair) * ln(1 - fraction) AS growth, worst * ln(1 + fraction * (price - 1)) + (1 - worst) * ln(1 - fraction) AS worst_growth FROM fr)"""
RANKED = "row_number() OVER (PARTITION BY slate ORDER BY round(worst_growth, 12) DESC, round(growth, 12) DESC, round(fraction, 12) DESC, integrity, books DESC, dispersion, round(abs(1 / price - 0.5e0), 12), ev DESC, edge DESC, start, candidate_id)"
NEED = ("quotes", "bets", "games")


@query("b4_rank_with_caps", f"{CAPS} SELECT slate, candidate_id, {d6('fraction')} AS fraction, {d6('growth')} AS growth, {d6('worst_growth')} AS worst_growth FROM gr", NEED)
def _(v):
    return rounded(ranked(v).select("slate", "candidate_id", "fraction", "growth", "worst_growth"), "fraction", "growth", "worst_growth")


@query("t3_rank_candidates", f"{CAPS} SELECT slate, candidate_id, integrity, {RANKED} AS rank FROM gr", NEED)
def _(v):
    return ranked(v).select("slate", "candidate_id", "integrity", "rank")


@query("a8_rejection_counts", f"{CAND} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM cl) GROUP BY reason", ("quotes",))
def _(v):
    return quotes.rejection_counts(exposure.evaluate_candidates(candidates(v)))


@query("s12_scan_credential_keys", "SELECT DISTINCT snapshot_id FROM quotes WHERE snapshot_id % 50 <> 0 AND snapshot_id % 70 = 1", ("quotes",))
def _(v):
    return snapshots.scan_credential_keys(raw(v)).select("snapshot_id").distinct()


@query("b5_allocate")
def _(v):
    return exposure.allocate(ranked(v), EQUITY, CASH)


DIST = """list_transform(reasons, lambda r: CASE r WHEN 'below_minimum_ev' THEN greatest(0, (0.015e0 - ev) / 0.015e0) WHEN 'below_minimum_edge' THEN greatest(0, (0.0075e0 - edge) / 0.0075e0) WHEN 'insufficient_book_depth' THEN (2 - books) / 2e0
    WHEN 'excessive_or_unknown_dispersion' THEN greatest(0, (dispersion - 0.06e0) / 0.06e0) WHEN 'stale_or_future_fair_value' THEN abs(age - 120) / 120e0 ELSE 1e0 END)"""


@query("b8_watchlist", f"{CAND}, w AS (SELECT *, {DIST} AS d FROM cl WHERE NOT qualified AND edge > 0 AND ev > 0) SELECT event_id, market, side, {d6('list_sum(d)')} AS distance, len(reasons) AS gates, count(*) AS n FROM w WHERE len(reasons) <= 2 AND list_sum(d) <= 0.75 AND list_max(d) <= 0.5 GROUP BY ALL", ("quotes",))
def _(v):
    got = exposure.watchlist(exposure.evaluate_candidates(candidates(v)))
    return rounded(got, "distance").groupBy("event_id", "market", "side", "distance", F.size("reasons").cast("long").alias("gates")).agg(F.count("*").alias("n"))


@query("b10_evaluation_status", f"{CAND}, w AS (SELECT *, {DIST} AS d FROM cl) SELECT CASE WHEN qualified THEN 'QUALIFIED' WHEN edge > 0 AND ev > 0 AND len(reasons) <= 2 AND list_sum(d) <= 0.75 AND list_max(d) <= 0.5 THEN 'WATCHLIST' ELSE 'PASS' END AS status, count(*) AS n FROM w GROUP BY ALL", ("quotes",))
def _(v):
    c = exposure.evaluate_candidates(candidates(v))
    return exposure.evaluation_status(c, exposure.watchlist(c)).groupBy("status").agg(F.count("*").alias("n"))


@query("a17_candidate_diagnostics", f"{CAND}, kk AS (SELECT *, 'market' AS kind, CAST(market AS VARCHAR) AS value FROM cl UNION ALL SELECT *, 'odds_band', {BAND} FROM cl UNION ALL SELECT *, 'core', '-220..220' FROM cl WHERE odds BETWEEN -220 AND 220) SELECT kind, value, count(*) AS calculable, count(*) FILTER (edge > 0) AS positive_edge, count(*) FILTER (ev > 0) AS positive_ev, count(*) FILTER (qualified) AS qualified FROM kk GROUP BY ALL", ("quotes",))
def _(v):
    return exposure.candidate_diagnostics(exposure.evaluate_candidates(candidates(v)))


# ---- streams: run over all of the events table, then compared as tables

EV = "e AS (SELECT event_id % 200 AS event_id, user_id % 6 AS book_id, event_type AS market, value AS price, ts, event_id AS seq FROM events)"


def stream_query(name: str, sql: str):
    def put(f):
        from tidewater.plans.shared import folder

        QUERIES[name] = lambda spark, sf_dir: f(streams.stream_quotes(spark, sf_dir), folder(spark))
        ORACLES[name] = sql
        return f

    return put


@stream_query("x1_stream_quotes", f"WITH {EV} SELECT event_id, book_id, market, price, seq FROM e")
def _(s, folder):
    return streams.run_to_table(s.select("event_id", "book_id", "market", "price", "seq"), folder)


@stream_query("x2_stream_dedupe", f"WITH {EV} SELECT event_id, book_id, market, count(*) AS n FROM e GROUP BY ALL")
def _(s, folder):
    both = s.unionAll(s)  # everything arrives twice
    once = streams.stream_dedupe(both, ["seq"], "60 days")
    return streams.run_to_table(once, folder).groupBy("event_id", "book_id", "market").agg(F.count("*").alias("n"))


@stream_query("x3_stream_latest_state", f"WITH {EV} SELECT event_id, book_id, market, max((ts, seq, price))[3] AS price, max((ts, seq))[2] AS seq, count(*) AS seen FROM e GROUP BY ALL")
def _(s, folder):
    return streams.run_to_table(streams.latest_state(s), folder, streams.FAMILY).drop("ts")


@stream_query("x4_stream_freshness", f"WITH {EV} SELECT CASE WHEN greatest(0, 1706572800 - floor(epoch(max(ts)))) <= 604800 THEN 'FRESH' ELSE 'STALE' END AS state, event_id, book_id, market FROM e GROUP BY event_id, book_id, market")
def _(s, folder):
    got = streams.run_to_table(streams.latest_state(s), folder, streams.FAMILY)
    return streams.freshness(got, 1706572800, 604800).select("event_id", "book_id", "market", "state")


@stream_query("x5_stream_window_counts", f"WITH {EV} SELECT CAST(epoch(time_bucket(INTERVAL 6 hours, ts)) AS BIGINT) AS start, market, count(*) AS n, {d6('sum(price)')} AS total FROM e GROUP BY ALL")
def _(s, folder):
    got = streams.run_to_table(streams.window_counts(s, "6 hours"), folder, ["start", "market"])
    return rounded(got.withColumn("start", F.unix_seconds("start")), "total")


@stream_query("x6_known_at", f"WITH {EV} SELECT event_id, count(*) AS n, max(price) AS price FROM e WHERE ts + INTERVAL 1 hour * (seq % 48) <= TIMESTAMP '2024-01-15' GROUP BY event_id")
def _(s, folder):
    got = streams.run_to_table(s, folder).withColumn("ingested", F.unix_micros("ts") + F.col("seq") % 48 * 3_600_000_000)
    return streams.known_at(got, "ingested", 1705276800 * 1_000_000).groupBy("event_id").agg(F.count("*").alias("n"), F.max("price").alias("price"))
