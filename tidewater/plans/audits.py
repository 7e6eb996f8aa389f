"""Queries of coverage and corpus reports. Importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import distributions as dist
from tidewater.operators import evaluate, exposure, features, preseason, reports
from tidewater.plans.fifth import starts
from tidewater.plans.fixtures import ctes, view
from tidewater.plans.more import ASOF, CAND, USABLE, candidates, usable
from tidewater.plans.queries import HIST, METRICS, MNAMES, ORACLES, PAIRS, QUERIES, d6, landed, metrics, query, requests, rounded, state
from tidewater.plans.shared import folder
from tidewater.plans.third import normal_rows
from tidewater.sources import snapshots


def cells(section: str, key: str, source: str, **measures: str) -> str:
    """One SELECT per measure of an aggregate in long form."""
    group = "" if key.startswith("'") else f" GROUP BY {key}"
    return " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{n}' AS measure, CAST({e} AS DOUBLE) AS value FROM {source}{group}" for n, e in measures.items())


# ---- historical quotes


def groups(v) -> DataFrame:
    e = F.col("event_id")
    mapping = F.when(e % 7 == 0, "missing").when(e % 7 == 1, "ambiguous").otherwise("reliable")
    start = 1009843200 + e % 30 * 86400
    x = usable(v).select("event_id", "market", "complete", "usable", F.col("why"), (e % 5).alias("season"), (e % 2).alias("horizon"), mapping.alias("mapping"), start.alias("requested_at"))
    return x.withColumn("snapshot_at", F.when(e % 11 != 0, F.col("requested_at") - e % 700))


def quoted(v) -> DataFrame:
    return state(v).select((F.col("event_id") % 2).alias("horizon"), "market", "book_id")


PCT = "floor(1e8 * avg(CAST({} AS INTEGER)) + 0.5) / 1e6"
COVERED = {
    "games": "count(*)", "usable": "count(*) FILTER (complete >= 2)", "coverage_pct": PCT.format("complete >= 2"), "two_books_pct": PCT.format("complete >= 2"), "three_books_pct": PCT.format("complete >= 3"),
    **{f"{m}_mappings": f"count(*) FILTER (mapping = '{m}')" for m in ("reliable", "ambiguous", "missing")},
}
GROUPS = f"""{ASOF}, {PAIRS}, {USABLE}, gr AS (SELECT *, event_id % 5 AS season, event_id % 2 AS horizon, 1009843200 + event_id % 30 * 86400 AS requested_at,
    CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous' ELSE 'reliable' END AS mapping FROM us),
    qb AS (SELECT event_id % 2 AS horizon, market, book_id FROM s), di AS (SELECT DISTINCT requested_at, event_id % 700 AS distance FROM gr WHERE event_id % 11 <> 0),
    ma AS (SELECT event_id, horizon, max(mapping) AS mapping FROM gr GROUP BY ALL),
    wy AS (SELECT 'no_complete_book' AS reason FROM us WHERE complete = 0 UNION ALL SELECT 'too_few_books' FROM us WHERE complete < 2 UNION ALL SELECT 'incomplete_books' FROM us WHERE incomplete > 0)"""
A10 = " UNION ALL ".join([
    cells("coverage", "concat_ws('|', season, horizon, market)", "gr", **COVERED), cells("aggregate_coverage", "concat_ws('|', horizon, market)", "gr", **COVERED),
    cells("games_by_season", "season", "gr", games="count(DISTINCT event_id)", reliably_mapped="count(DISTINCT event_id) FILTER (mapping = 'reliable')"), cells("event_horizon_reconciliation", "mapping", "ma", n="count(*)"),
    cells("distance_seconds", "'all'", "di", median="quantile_disc(distance, 0.5)", p90="quantile_disc(distance, 0.9)", pairs="count(*)"), cells("rows_by_horizon_market_book", "concat_ws('|', horizon, market, book_id)", "qb", n="count(*)"),
    cells("book_frequency", "book_id", "qb", n="count(*)"), cells("unusable_reasons", "reason", "wy", n="count(*)"),
])


@query("a10_full_report", f"{GROUPS} {A10}", ("quotes",))
def _(v):
    return reports.historical_coverage(groups(v), quoted(v), ";")


@query("a10_sketched_report", f"{GROUPS} SELECT market, book_id, count(*) AS n FROM qb GROUP BY ALL", ("quotes",))
def _(v):
    """Book frequencies from sketches stored by horizon and market and merged over horizons; six books are far below where the sketch is exact no more."""
    got = reports.sketched_coverage(reports.coverage_sketches(groups(v), quoted(v), ["horizon", "market"]), ["market"])
    return got.select("market", F.explode("books").alias("b")).select("market", F.col("b.item").alias("book_id"), F.col("b.count").alias("n"))


# ---- corpus


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "games")
    side = lambda c: F.when(F.col(c) % 3 == 0, "fcs").otherwise("fbs")
    known = lambda c: F.when(F.col(c) % 41 != 0, F.col(c))
    exclusion = F.when(known("home").isNull() | known("away").isNull(), "unresolved_program_identity").when((side("home") == "fcs") & (side("away") == "fcs"), "no_top_side")
    games = g.select("game_id", "season", side("home").alias("home_class"), side("away").alias("away_class"), known("home").alias("home_id"), known("away").alias("away_id"), exclusion.alias("exclusion"))
    part = F.floor(F.col("game_id") / 500)  # a partition holds 500 games at most
    artifacts = [view(spark, sf_dir, k).groupBy(F.lit(k).alias("kind"), part.alias("p")).agg(F.count("*").alias("row_count"), F.collect_set("game_id").alias("game_ids")).drop("p") for k in ("plays", "drives")]
    o = view(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    old = F.coalesce(before, F.when(F.col("o_custkey") % 10 == 0, -1 - F.col("o_custkey")))
    manifests = o.select(F.col("o_orderkey").alias("manifest_id"), F.col("o_custkey").alias("request_hash"), F.floor("o_totalprice").alias("response_bytes"), F.floor(F.col("o_totalprice") / 10).alias("stored_bytes"), old.alias("supersedes"))
    return reports.corpus_report(games, manifests, artifacts[0].unionByName(artifacts[1]), folder(spark))


QUERIES["g7_corpus_chains"] = _corpus
ONE, BOTH = "(home % 3 <> 0 OR away % 3 <> 0)", "(home % 3 <> 0 AND away % 3 <> 0)"
GAP = "(home % 41 = 0 OR away % 41 = 0)"
ORACLES["g7_corpus_chains"] = f"""{ctes('plays', 'drives')}, ex AS (SELECT *, CASE WHEN {GAP} THEN 'unresolved_program_identity' WHEN NOT {ONE} THEN 'no_top_side' ELSE 'eligible' END AS exclusion FROM games),
    un AS (SELECT DISTINCT game_id FROM games WHERE {ONE}), ro AS (SELECT 'plays' AS kind, game_id FROM plays UNION ALL SELECT 'drives', game_id FROM drives),
    pa AS (SELECT kind, game_id // 500 AS p, count(*) AS row_count FROM ro GROUP BY ALL), co AS (SELECT kind, count(DISTINCT game_id) FILTER (game_id IN (SELECT game_id FROM un)) AS covered, (SELECT count(*) FROM un) AS total FROM ro GROUP BY kind),
    ch AS (SELECT o_custkey, count(*) - 1 + CAST(o_custkey % 10 = 0 AS INTEGER) AS depth, o_custkey % 10 = 0 AS dangling, count(*) AS n FROM orders GROUP BY o_custkey)
    {cells('games_by_season', 'season', 'games', games='count(*)', both_top=f'count(*) FILTER {BOTH}', top_and_other=f'count(*) FILTER ({ONE} AND NOT {BOTH})')}
    UNION ALL {cells('exclusions', 'exclusion', 'ex', games='count(*)')} UNION ALL {cells('artifacts', 'kind', 'pa', partitions_with_rows='count(*)', rows='sum(row_count)')}
    UNION ALL {cells('coverage', 'kind', 'co', games='max(covered)', total_games='max(total)', percentage='floor(1e4 * max(covered) / max(total) + 0.5) / 1e2')}
    UNION ALL {cells('identity_gaps', "'all'", 'games', missing_home='count(*) FILTER (home % 41 = 0)', missing_away='count(*) FILTER (away % 41 = 0)', missing_identities=f'count(*) FILTER {GAP}', missing_participants=f'count(*) FILTER ({GAP} AND {ONE})', ambiguous=f'count(*) FILTER {GAP}')}
    UNION ALL {cells('calls', "'all'", 'orders', recorded='count(*)', unique_requests='count(DISTINCT o_custkey)', reuses='count(*) - count(DISTINCT o_custkey)', response_bytes='sum(floor(o_totalprice))', stored_bytes='sum(floor(o_totalprice / 10))', supersessions='count(*) - count(DISTINCT o_custkey) + count(DISTINCT o_custkey) FILTER (o_custkey % 10 = 0)')}
    UNION ALL {cells('chains', "'all'", 'ch', chains='count(*)', longest='max(depth) + 1', of_several_versions='count(*) FILTER (depth > 0)', dangling='count(*) FILTER (dangling)')}
    UNION ALL {cells('versions', "CASE WHEN dangling THEN 'dangling' ELSE 'ok' END", 'ch', n='sum(n)')}"""


# ---- features, model input, preseason

FAMILY = {"plays": ["ppa", "success", "explosive", "pass_rate"], "drives": ["points_per_drive"], "allowed": ["ppa_allowed", "success_allowed"]}


@query("g6_full_report", f""", {METRICS}, fr AS (SELECT *, season % 3 AS horizon, game_id % 6 AS home_games, (game_id // 6) % 6 AS away_games, game_id % 50 AS wk, game_id % 4 = 0 AS adjusted, season = 1996 AS regime, CASE WHEN game_id % 9 <> 0 THEN game_id % 5 / 4e0 END AS ratio FROM tm),
    de AS (SELECT CASE WHEN d < 4 THEN CAST(d AS VARCHAR) ELSE '4_plus' END AS depth FROM (SELECT home_games AS d FROM fr WHERE wk <= 3 UNION ALL SELECT away_games FROM fr WHERE wk <= 3)),
    ga AS (SELECT CASE WHEN neutral THEN 'neutral_site' ELSE 'eligible' END AS exclusion FROM games)
    {cells('rows_by_season', 'season', 'fr', n='count(*)')} UNION ALL {cells('rows_by_horizon', 'horizon', 'fr', n='count(*)')} UNION ALL {cells('early_depth', 'depth', 'de', n='count(*)')} UNION ALL {cells('exclusions', 'exclusion', 'ga', n='count(*)')}
    UNION ALL {' UNION ALL '.join(cells('family_coverage', f"'{f}'", 'fr', present_cells=' + '.join(f'count({c})' for c in cs), total_cells=f'{len(cs)} * count(*)', missing_cells=f'{len(cs)} * count(*) - ' + ' - '.join(f'count({c})' for c in cs), coverage=f"floor(1e6 * ({' + '.join(f'count({c})' for c in cs)}) / ({len(cs)} * count(*)) + 0.5) / 1e6") for f, cs in FAMILY.items())}
    UNION ALL {cells('quality', "'all'", 'fr', ratio='floor(1e6 * avg(coalesce(ratio, 0)) + 0.5) / 1e6')}
    UNION ALL {cells('adjustment', "'all'", 'fr', rows='count(*) FILTER (adjusted)', share='floor(1e6 * avg(CAST(adjusted AS INTEGER)) + 0.5) / 1e6', regime_rows='count(*) FILTER (regime)')}""", ("plays", "drives"))  # fmt: skip
def _(v):
    g = F.col("game_id")
    rows = metrics(v).withColumns({
        "horizon": F.col("season") % 3, "home_games": g % 6, "away_games": F.floor(g / 6) % 6, "week": g % 50, "adjusted": g % 4 == 0, "regime": F.col("season") == 1996, "ratio": F.when(g % 9 != 0, g % 5 / 4.0),
    })
    games = v("games").select(F.when(F.col("neutral"), "neutral_site").alias("exclusion"))
    return reports.feature_report(rows, games, FAMILY, ["ratio"])


@query("g8_audit_model_input", f""", {METRICS}, x AS (SELECT *, game_id * 2 + CAST(is_home AS INTEGER) AS place, CASE WHEN game_id % 13 <> 0 THEN ppa END AS target FROM tm), n AS (SELECT *, lag((available_at, game_id)) OVER (ORDER BY place) AS before FROM x)
    SELECT 'rows' AS rule, 'all' AS name, count(*) AS n FROM x UNION ALL SELECT 'season_fence', 'all', count(*) FILTER (season > 2000) FROM x UNION ALL SELECT 'null_target', 'target', count(*) - count(target) FROM x
    UNION ALL {' UNION ALL '.join(f"SELECT 'missing', '{m}', count(*) - count({m}) FROM x UNION ALL SELECT 'non_finite', '{m}', 0" for m in MNAMES)}
    UNION ALL SELECT 'duplicate_rows', 'all', count(*) - count(DISTINCT (game_id, season)) FROM x UNION ALL SELECT 'order_violation', 'all', count(*) FILTER (before > (available_at, game_id)) FROM n""", ("plays", "drives"))  # fmt: skip
def _(v):
    x = metrics(v).withColumn("place", F.col("game_id") * 2 + F.col("is_home").cast("int")).withColumn("target", F.when(F.col("game_id") % 13 != 0, F.col("ppa")))
    return features.audit_model_input(x, ["game_id", "season"], MNAMES, ["target"], ["available_at", "game_id"], "place", 2000)


@query("j5_asof_newest", f"{HIST} SELECT rq.game_id, rq.team, rq.as_of, count(fg) AS facts, coalesce(max(available_at), 0) AS newest_at, coalesce(min(available_at), 0) AS oldest_at, {d6('coalesce(sum(ppa), 0)')} AS total FROM rq LEFT JOIN (SELECT * FROM hs WHERE newest <= 5) h ON h.game_id = rq.game_id AND h.team = rq.team GROUP BY ALL", ("plays", "drives"))
def _(v):
    got = features.asof_newest(requests(v), metrics(v).where("ppa is not null").select("team", "game_id", "available_at", "ppa"), 5, ["ppa"])
    at = F.transform("history", lambda h: h["fact_at"])
    total = F.aggregate("history", F.lit(0.0), lambda s, h: s + h["ppa"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rounded(got.select("game_id", "team", "as_of", F.size("history").cast("long").alias("facts"), zero(F.array_max(at)).alias("newest_at"), zero(F.array_min(at)).alias("oldest_at"), total.alias("total")), "total")


PRESEASON = {"returning": "percent_ppa", "recruiting": "rank", "talent": "talent", "roster": "roster_count", "portal": "transfer_in_count", "coach": "coach_tenure", "passer": "leader_attempts"}


@query("g10_seven_families", f"""{ORACLES['g2_seven_families'].removeprefix(ctes('squad', 'passing', 'games', 'portal', 'coaches', 'team_context')).rsplit('SELECT team, season', 1)[0]}
    {cells('by_season', 'season', 'al', team_seasons='count(*)', **{f: f'count({c})' for f, c in PRESEASON.items()})} UNION ALL {' UNION ALL '.join(cells('source_rows', f"'{n}'", n, n='count(*)') for n in ('squad', 'portal', 'coaches'))}""",
    ("squad", "passing", "games", "portal", "coaches", "team_context"))
def _(v):
    c = v("team_context")
    facts = preseason.preseason_families(
        c.where("team % 5 <> 0").select("team", "season", "percent_ppa", "usage"), c.where("team % 7 <> 0").select("team", "season", "rank", "points"), c.where("season > 1996").select("team", "season", "talent"),
        v("squad"), v("passing"), v("portal"), v("coaches"), starts(v),
    )
    return reports.preseason_coverage(facts, PRESEASON, {n: v(n) for n in ("squad", "portal", "coaches")})


# ---- registries and distributions


@query("b1_evaluate_registered", f"""{CAND}, r AS (SELECT *, event_id % 4 AS m, 900000000 + (event_id % 50) * 1000000 AS seen_at, event_id % 6 = 0 AS turned, event_id % 8 = 3 AS warned FROM cl),
    z AS (SELECT event_id, market, side, list_filter([CASE WHEN event_id % 5 = 0 AND seen_at >= 930000000 OR event_id % 9 = 4 THEN 'event_identity_mismatch' END, CASE WHEN turned THEN 'market_identity_mismatch' END,
        CASE WHEN event_id % 7 = 2 THEN 'exact_point_mismatch' END, CASE WHEN m = 0 AND seen_at >= 920000000 OR m = 1 THEN 'model_status_not_eligible' END, CASE WHEN warned THEN 'pricing_quality_warning' END], lambda x: x IS NOT NULL) || reasons AS all_reasons FROM r)
    SELECT event_id, market, side, array_to_string(all_reasons, ',') AS reasons, len(all_reasons) = 0 AS qualified, count(*) AS n FROM z GROUP BY ALL""", ("quotes",))  # fmt: skip
def _(v):
    e = F.col("event_id")
    c = candidates(v).withColumns({
        "as_of": 900000000 + e % 50 * 1000000, "model_id": F.concat(F.lit("m"), (e % 4).cast("string")), "provider_id": F.when(e % 9 != 4, F.concat(F.lit("p"), e.cast("string"))), "fair_market": F.col("market"),
        "fair_side": F.when(e % 6 == 0, 3 - F.col("side")).otherwise(F.col("side")), "point": F.lit(1.5), "fair_point": F.when(e % 7 == 2, 2.5).otherwise(1.5), "warnings": F.when(e % 8 == 3, F.array(F.lit("stale_book"), F.lit("material_book_outlier"))).otherwise(F.array(F.lit("material_book_outlier"))),
    })
    c = landed(c, "candidates")  # both registries are made of them
    models = c.select("model_id").distinct().select("model_id", F.when(F.col("model_id") == "m1", "shadow").otherwise("retained_benchmark").alias("status"), F.lit(0).cast("long").alias("valid_from"), F.when(F.col("model_id") == "m0", 920000000).cast("long").alias("valid_to"))
    mappings = c.select("event_id").distinct().select(F.concat(F.lit("p"), e.cast("string")).alias("provider_id"), "event_id", F.lit(0).cast("long").alias("valid_from"), F.when(e % 5 == 0, 930000000).cast("long").alias("valid_to"))
    got = exposure.evaluate_registered(c, models, mappings)
    return got.groupBy("event_id", "market", "side", F.array_join("reasons", ",").alias("reasons"), "qualified").agg(F.count("*").alias("n"))


@query("e15_distribution_candidates")
def _(v):
    """Three Normals against the plain one on shared draws: one better placed, one too wide, one shifted. Scores are made once and read back, as a challenge reads them in several passes."""
    rows = normal_rows(v)
    scored = []
    for name, loc, scale in (("plain", F.col("loc"), F.col("scale")), ("nearer", F.col("loc") * 0.6 + F.col("actual") * 0.4, F.col("scale")), ("wide", F.col("loc"), F.col("scale") * 2), ("shifted", F.col("loc") + 3, F.col("scale"))):
        s = dist.proper_scores(F.col("actual"), loc, scale)
        half = scale * 1.6448536269514722
        nll = F.log(scale * 2.5066282746310002) + (F.col("actual") - loc) * (F.col("actual") - loc) / (2 * scale * scale)
        scored.append(F.struct(F.lit(name).alias("candidate"), nll.alias("nll"), s["crps"].alias("crps"), (F.abs(F.col("actual") - loc) <= half).alias("covered"), (2 * half).alias("interval_width")))
    out = landed(rows.select("game_id", "season", F.explode(F.array(*scored)).alias("_s")).select("game_id", "season", "_s.*"), "scored")
    return evaluate.distribution_challenge(out, "plain", [], "season")


# ---- drives from nested documents


def _drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per game with its drives as an array; every 19th is damaged, every 23rd names no known game, every 17th has an odd drive."""
    g = F.col("game_id")
    games = view(spark, sf_dir, "games").select("game_id", "home", "away", F.concat(F.lit("T"), "home").alias("home_name"), F.concat(F.lit("T"), "away").alias("away_name"))
    d = view(spark, sf_dir, "drives").select("game_id", "offense", F.struct(
        F.concat_ws("-", "game_id", "offense").alias("id"), F.concat(F.lit("T"), "offense").alias("offense"), "yards", F.lit(7).alias("startOffenseScore"), (F.col("points") + 7).alias("endOffenseScore"),
    ).alias("d"))
    body = F.to_json(F.struct(F.when(g % 23 == 0, -g).otherwise(g).alias("gameId"), F.array_sort(F.collect_list("d")).alias("drives")))  # a game has two rows
    raw = d.groupBy("game_id").agg(body.alias("body")).select("game_id", F.when(g % 19 == 0, F.substring("body", 1, 15)).when(g % 17 == 0, F.regexp_replace("body", r"\]\}$", ',{"plays":3},7]}')).otherwise(F.col("body")).alias("body"))
    path = f"{folder(spark)}/drives-{uuid.uuid4().hex}"
    snapshots.land_variants(raw, path, "game_id")
    good, warned = snapshots.flatten_drive_documents(spark.read.parquet(path), games)
    n = F.count("*").alias("n")
    sums = good.groupBy(F.lit("drives").alias("reason"), F.col("offense").alias("team")).agg(n, F.sum("points").alias("points"), F.sum("yards").alias("yards"))
    none = F.lit(None).cast("long")
    return sums.unionAll(warned.groupBy("reason").agg(n).select("reason", none.alias("team"), "n", none.alias("points"), none.alias("yards")))


QUERIES["s9_flatten_drive_documents"] = _drives
ORACLES["s9_flatten_drive_documents"] = f"""{ctes('drives')}, k AS (SELECT *, CASE WHEN game_id % 19 = 0 THEN 'malformed_document' WHEN game_id % 23 = 0 THEN 'unknown_game' ELSE 'drives' END AS state FROM drives),
    w AS (SELECT DISTINCT game_id, state FROM k)
    SELECT 'drives' AS reason, offense AS team, count(*) AS n, CAST(sum(points) AS BIGINT) AS points, CAST(sum(yards) AS BIGINT) AS yards FROM k WHERE state = 'drives' GROUP BY offense
    UNION ALL SELECT state, NULL, count(*), NULL, NULL FROM w WHERE state <> 'drives' GROUP BY state
    UNION ALL SELECT unnest(['malformed_drive', 'drive_without_id']), NULL, count(*), NULL, NULL FROM w WHERE state = 'drives' AND game_id % 17 = 0"""
