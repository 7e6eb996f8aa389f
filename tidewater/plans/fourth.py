"""Queries of the remaining sources, reports and preseason facts. Importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewater.operators import distributions as dist
from tidewater.operators import evaluate, exposure, features, quotes
from tidewater.plans.fixtures import AS_OF, ctes
from tidewater.plans.more import ASOF, USABLE, candidates, usable
from tidewater.plans.queries import ORACLES, PAIRS, QUERIES, REASON, d6, doubles, query, rounded, state
from tidewater.plans.shared import folder
from tidewater.plans.third import lattice, normal_rows
from tidewater.sources import snapshots


@query("a7_pipeline_status", f"{ASOF} SELECT market, count(*) AS rows, count(*) FILTER (({REASON}) IS NULL) AS eligible, CASE WHEN count(*) FILTER (({REASON}) IS NULL) < 0.5 * count(*) THEN 'degraded' ELSE 'ok' END AS status FROM s GROUP BY market", ("quotes",))
def _(v):
    x = state(v).withColumn("r", quotes.eligibility(AS_OF, 40_000_000, 2400, range(5))).groupBy("market").agg(F.count("*").alias("rows"), F.count_if(F.col("r").isNull()).alias("eligible"))
    return quotes.pipeline_status(x)


@query("a10_historical_coverage", f"{ASOF}, {PAIRS}, {USABLE} SELECT market, league, count(*) AS groups, {d6('avg(CAST(complete >= 2 AS INTEGER))')} AS usable_share, {d6('avg(CAST(complete >= 2 AS INTEGER))')} AS two_books, {d6('avg(CAST(complete >= 3 AS INTEGER))')} AS three_books, quantile_disc(complete, 0.5) AS books_p50, quantile_disc(complete, 0.9) AS books_p90 FROM us GROUP BY market, league", ("quotes",))
def _(v):
    return rounded(quotes.historical_coverage(usable(v), ["market", "league"]), "usable_share", "two_books", "three_books")


@query("a10_reason_frequencies", f"{ASOF}, {PAIRS}, {USABLE} " + " UNION ALL ".join(f"SELECT market, '{r}' AS reason, count(*) AS n FROM us WHERE {c} GROUP BY market" for r, c in (("no_complete_book", "complete = 0"), ("too_few_books", "complete < 2"), ("incomplete_books", "incomplete > 0"))), ("quotes",))
def _(v):
    return quotes.reason_frequency(usable(v), ["market"])


@query("a16_merge_funnels", ", f AS (SELECT book_id AS id, market, count(*) AS rows, min(requested - observed) AS youngest, max(requested - observed) AS oldest, quantile_disc(requested - observed, 0.5) AS age_p50 FROM quotes GROUP BY ALL), r AS (SELECT *, sum(rows) OVER (PARTITION BY market ORDER BY age_p50, id ROWS UNBOUNDED PRECEDING) AS run, sum(rows) OVER (PARTITION BY market) AS al FROM f) SELECT market, CAST(sum(rows) AS BIGINT) AS rows, min(youngest) AS youngest, max(oldest) AS oldest, min(age_p50) FILTER (run * 2 >= al) AS age_p50 FROM r GROUP BY market", ("quotes",))
def _(v):
    age = F.col("requested") - F.col("observed")
    f = v("quotes").withColumn("_age", age).groupBy(F.col("book_id").alias("id"), "market").agg(F.count("*").alias("rows"), F.min("_age").alias("youngest"), F.max("_age").alias("oldest"), F.expr("percentile_disc(0.5) within group (order by _age)").cast("long").alias("age_p50"))
    return quotes.merge_funnels(f, ["market"])


@query("e14_market_scores", f"SELECT count(*) AS n, {d6('avg((p - outcome) * (p - outcome))')} AS brier FROM probabilities", ("probabilities",))
def _(v):
    p = v("probabilities").dropDuplicates(["game_id"])
    return rounded(p.agg(F.count("*").alias("n"), F.avg(evaluate.brier(F.col("p"), F.col("outcome"))).alias("brier")), "brier")


@query("e15_distribution_challenge")
def _(v):
    """Scores of a shifted and a plain Normal against each other, as block-bootstrap intervals of the paired difference."""
    rows = normal_rows(v)
    crps = lambda loc: dist.proper_scores(F.col("actual"), loc, F.col("scale"))["crps"]
    pairs = rows.select("season", crps(F.col("loc")).alias("error_a"), crps(F.col("loc") + 1).alias("error_b"))
    return evaluate.block_bootstrap(pairs, "season", 300)


@query("g2_preseason_facts", """, t AS (SELECT r.team, r.season, count(*) AS players, avg(CASE WHEN q.player IS NULL THEN 0 ELSE 1 END) AS rs FROM roster r LEFT JOIN roster q ON q.team = r.team AND q.player = r.player AND q.season + 1 = r.season GROUP BY ALL),
    i AS (SELECT *, season - row_number() OVER (PARTITION BY team, coach ORDER BY season) AS isl FROM coaches), k AS (SELECT team, season, row_number() OVER (PARTITION BY team, coach, isl ORDER BY season) AS tenure FROM i),
    l AS (SELECT team, season + 1 AS season, avg(m) AS lm FROM (SELECT home AS team, season, margin AS m FROM games UNION ALL SELECT away, season, -margin FROM games) GROUP BY ALL)
    SELECT team, season, CAST(players AS DOUBLE) AS players, """ + d6("rs") + " AS returning_share, CAST(tenure AS DOUBLE) AS tenure, " + d6("lm") + " AS last_margin, (players IS NULL)::INT + (tenure IS NULL)::INT + (lm IS NULL)::INT AS missing_families FROM t FULL JOIN k USING (team, season) FULL JOIN l USING (team, season)", ("roster", "coaches", "games"))
def _(v):
    got = features.preseason_facts(v("roster"), v("coaches"), v("games"))
    return doubles(rounded(got.drop("changed"), "returning_share", "last_margin"), "players", "tenure")


@query("b6_rank_combinations")
def _(v):
    legs = exposure.evaluate_candidates(candidates(v)).where("qualified")
    near = legs.select("slate", F.col("candidate_id").alias("a"), F.col("event_id").alias("ea"), (F.col("event_id") + 30).alias("next"))
    other = legs.select(F.col("slate").alias("s2"), F.col("candidate_id").alias("b"), F.col("event_id").alias("eb"))
    offers = near.join(other, (F.col("slate") == F.col("s2")) & (F.col("next") == F.col("eb"))).select(F.concat_ws("+", "a", "b").alias("offer_id"), "slate", F.lit(290).cast("long").alias("odds"), F.array("a", "b").alias("leg_ids"))
    return rounded(exposure.rank_combinations(offers, legs).select("slate", "offer_id", "p", "ev", "fraction", "growth", "score", "rank"), "p", "ev", "fraction", "growth", "score")


# ---- sources over JSON made from the tables


@query("s7_flatten_games", "SELECT game_id, CAST(season AS INTEGER) AS season, CAST(week AS INTEGER) AS week, kickoff, home * 10 AS home_party, away * 10 AS away_party, margin, 2 * CAST(floor((total + margin) / 2e0) AS BIGINT) - margin AS total, available_at FROM games", ("games",))
def _(v):
    # points of both sides from every game: those of the home side are rounded down where total and margin do not fit
    home = F.floor((F.col("total") + F.col("margin")) / 2)
    side = lambda n, points: F.struct(F.col(n).alias("id"), points.alias("points"))
    g = v("games")
    raw = g.select(F.to_json(F.struct(F.col("game_id").alias("id"), "season", "week", F.col("kickoff").alias("start"), side("home", home).alias("home"), side("away", home - F.col("margin")).alias("away"), F.lit("final").alias("status"))).alias("body"))
    parties = v("games").select(F.col("home").alias("id")).union(v("games").select("away")).distinct().withColumn("party", F.col("id") * 10)
    return snapshots.flatten_games(raw, parties)


@query("s8_flatten_plays", "SELECT game_id, count(*) AS plays, CAST(sum(clock_s) AS BIGINT) AS clock, CAST(sum(yards) AS BIGINT) AS yards FROM (SELECT game_id, yards, (down % 15) * 60 + distance AS clock_s FROM plays) GROUP BY game_id", ("plays",))
def _(v):
    p = v("plays").select(F.to_json(F.struct(F.monotonically_increasing_id().alias("id"), F.col("game_id").alias("game"), "offense", "down", "distance", "yards", F.struct((F.col("down") % 15).alias("minutes"), F.col("distance").alias("seconds")).alias("clock"))).alias("body"))
    return snapshots.flatten_plays(p, v("games")).groupBy("game_id").agg(F.count("*").alias("plays"), F.sum("clock_s").alias("clock"), F.sum("yards").alias("yards"))


@query("s9_flatten_drives", "SELECT game_id, offense, points FROM drives", ("drives",))
def _(v):
    d = v("drives").select("game_id", "offense", F.lit(7).alias("start_score"), (F.col("points") + 7).alias("end_score"))
    return snapshots.flatten_drives(d).select("game_id", "offense", "points")


@query("s10_flatten_team_stats", "SELECT game_id, home AS team, 'total' AS category, CAST(total AS VARCHAR) AS value FROM games UNION ALL SELECT game_id, home, 'margin', CAST(margin AS VARCHAR) FROM games UNION ALL SELECT game_id, away, 'total', CAST(total AS VARCHAR) FROM games UNION ALL SELECT game_id, away, 'margin', CAST(-margin AS VARCHAR) FROM games", ("games",))
def _(v):
    stat = lambda c, x: F.struct(F.lit(c).alias("category"), x.cast("string").alias("value"))
    team = lambda n, sign: F.struct(F.col(n).alias("team"), F.array(stat("total", F.col("total")), stat("margin", sign * F.col("margin"))).alias("stats"))
    return snapshots.flatten_team_stats(v("games").select(F.to_json(F.struct(F.col("game_id").alias("game"), F.array(team("home", 1), team("away", -1)).alias("teams"))).alias("body")))


@query("s11_flatten_venues", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS elevation, s_nationkey % 2 = 0 AS dome FROM supplier WHERE s_suppkey % 8 <> 0")
def _(v):
    s = v("supplier").select(F.to_json(F.struct(F.when(F.col("s_suppkey") % 8 != 0, F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("UTC").alias("zone"), F.col("s_acctbal").alias("elevation"), (F.col("s_nationkey") % 2 == 0).alias("dome"))).alias("body"))
    return snapshots.flatten_venues(s).drop("zone")


def _written(spark, sf_dir):
    from tidewater.plans.fixtures import view

    path = f"{folder(spark)}/games-{uuid.uuid4().hex}"
    snapshots.write_partitioned(view(spark, sf_dir, "games"), path, ["season"], ["kickoff", "game_id"])
    return snapshots.scan_partitioned(spark, path, ["game_id", "season", "margin"], "season", 1996, 1998).withColumn("season", F.col("season").cast("long"))


QUERIES["s4_write_partitioned"] = _written
ORACLES["s4_write_partitioned"] = f"{ctes('games')} SELECT game_id, season, margin FROM games WHERE season BETWEEN 1996 AND 1998"
