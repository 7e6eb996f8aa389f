"""Queries of linear models over all folds, families and penalties. Importing this module registers them.

A model of one or two columns has a closed form, which the twins compute from counts, means, deviations and covariances of each fold's training rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import folds, models
from tidewater.plans.queries import MNAMES, d6, model_rows, query, rated_rows, rounded

SEASONS = [1997, 1998, 1999, 2000, 2001]
#: Fixed values of the tuning grids: penalties of the ridge; penalty and share of the absolute one of the elastic net.
RIDGE = [0.1, 1.0, 10.0, 100.0]
ELASTIC = [(0.001, 0.1), (0.001, 0.5), (0.01, 0.1), (0.01, 0.5), (0.1, 0.1), (0.1, 0.5)]
#: Feature families over the team metrics: all, without one family, one alone.
FAMILIES = {
    "full": MNAMES,
    "without_allowed": [m for m in MNAMES if not m.endswith("_allowed")],
    "allowed_only": [m for m in MNAMES if m.endswith("_allowed")],
    "without_ppa": [m for m in MNAMES if not m.startswith("ppa")],
    "ppa_only": [m for m in MNAMES if m.startswith("ppa")],
    "style_only": ["pass_rate", "explosive"],
}

SINGLE = """, fo AS (SELECT unnest(range(1997, 2002)) AS fold),
    ob AS (SELECT game_id, season, actual, 'b' AS family, b AS x FROM predictions UNION ALL SELECT game_id, season, actual, 'week', CAST(week AS DOUBLE) FROM predictions),
    st AS (SELECT fold, family, count(*) AS n, avg(x) AS mx, avg(actual) AS my, stddev_pop(x) AS sd, covar_pop(x, actual) / stddev_pop(x) AS u FROM fo JOIN ob ON season < fold GROUP BY ALL)"""
RIDGE_W = "n * u / (n + alpha)"
ELASTIC_W = "sign(u) * greatest(0, abs(u) - alpha * mix) / (1 + alpha * (1 - mix))"
RIDGES = ", gr AS (SELECT unnest([0.1e0, 1e0, 10e0, 100e0]) AS alpha)"
ELASTICS = ", ge AS (SELECT unnest([0.001e0, 0.001e0, 0.01e0, 0.01e0, 0.1e0, 0.1e0]) AS alpha, unnest([0.1e0, 0.5e0, 0.1e0, 0.5e0, 0.1e0, 0.5e0]) AS mix)"
AT = "my + w * (x - mx) / sd"


def single(grid: str, weight: str) -> str:
    return f"(SELECT st.*, {grid}.*, {weight} AS w FROM st CROSS JOIN {grid})"


def singles(v):
    return v("predictions").withColumn("week", F.col("week").cast("double"))


ALONE = {"b": ["b"], "week": ["week"]}


@query("m3_ridge_single", f"{SINGLE}{RIDGES}, f AS {single('gr', RIDGE_W)} SELECT game_id, season, family, alpha, n AS trained_on, {d6(AT)} AS prediction FROM ob JOIN f USING (family) WHERE season = fold", ("predictions",))
def _(v):
    got = folds.linear_folds(singles(v), ALONE, SEASONS, [(a, None) for a in RIDGE])
    return rounded(got.select("game_id", "season", "family", "alpha", "trained_on", "prediction"), "prediction")


@query("m3_ridge_families")
def _(v):
    return folds.linear_folds(model_rows(v), FAMILIES, SEASONS, [(10.0, None)])


@query("m4_elastic_grid", f"{SINGLE}{ELASTICS}, f AS {single('ge', ELASTIC_W)} SELECT game_id, season, family, alpha, mix, {d6(AT)} AS prediction FROM ob JOIN f USING (family) WHERE season = fold", ("predictions",))
def _(v):
    got = folds.linear_folds(singles(v), ALONE, SEASONS, ELASTIC)
    return rounded(got.select("game_id", "season", "family", "alpha", "mix", "prediction"), "prediction")


TUNED = f"""{SINGLE}{RIDGES}{ELASTICS}, fr AS {single('gr', RIDGE_W)}, fe AS {single('ge', ELASTIC_W)},
    f AS (SELECT fold, family, mx, my, sd, alpha, CAST(NULL AS DOUBLE) AS mix, w FROM fr UNION ALL SELECT fold, family, mx, my, sd, alpha, mix, w FROM fe),
    e AS (SELECT family, alpha, mix, avg(abs({AT} - actual)) AS mae, count(*) AS n FROM ob JOIN f USING (family) WHERE season = fold GROUP BY ALL)
    SELECT family, alpha, coalesce(mix, -1e0) AS mix, {d6('mae')} AS mae, n, row_number() OVER (PARTITION BY family ORDER BY round(mae, 9), sha256(alpha || '|' || coalesce(CAST(mix AS VARCHAR), ''))) AS place FROM e"""


@query("m5_tune_folds", TUNED, ("predictions",))
def _(v):
    got = folds.tune_folds(folds.linear_folds(singles(v), ALONE, SEASONS, [*[(a, None) for a in RIDGE], *ELASTIC]))
    return rounded(got.select("family", "alpha", F.coalesce("mix", F.lit(-1.0)).alias("mix"), "mae", "n", "place"), "mae")


@query("m8_rating_prior_folds")
def _(v):
    return folds.adjusted_ratings(rated_rows(v), MNAMES, SEASONS)


MARKETS = f""", fo AS (SELECT unnest(range(1998, 2002)) AS fold), ob AS (SELECT game_id, season, actual, b, CAST(week AS DOUBLE) AS x FROM predictions WHERE season >= 1996),
    r AS (SELECT fold, count(*) AS n, avg(x) AS mx, avg(actual - b) AS my, stddev_pop(x) AS sd, covar_pop(x, actual - b) / stddev_pop(x) AS u FROM fo JOIN ob ON season < fold GROUP BY fold),
    t AS (SELECT fold, 1 + 10e0 / count(*) AS d, avg(x) AS mx, avg(b) AS mb, avg(actual) AS my, stddev_pop(x) AS sx, stddev_pop(b) AS sb, corr(x, b) AS c, covar_pop(x, actual) / stddev_pop(x) AS ux, covar_pop(b, actual) / stddev_pop(b) AS ub FROM fo JOIN ob ON season < fold GROUP BY fold)
    SELECT game_id, season, 'residual' AS variant, {d6('b + my + n * u / (n + 10) * (x - mx) / sd')} AS prediction FROM ob JOIN r ON season = fold UNION ALL
    SELECT game_id, season, 'market_as_feature', {d6('my + (d * ux - c * ub) / (d * d - c * c) * (x - mx) / sx + (d * ub - c * ux) / (d * d - c * c) * (b - mb) / sb')} FROM ob JOIN t ON season = fold"""


@query("m9_market_folds", MARKETS, ("predictions",))
def _(v):
    got = folds.market_folds(singles(v), ["week"], "b", SEASONS[1:], 1996)
    return rounded(got.select("game_id", "season", "variant", "prediction"), "prediction")


LONG = f"""{SINGLE}, k AS (SELECT *, (2 + CAST(week > 26 AS INTEGER)) / 3e0 AS coverage FROM predictions),
    m AS (SELECT fold, avg(actual) AS my FROM fo JOIN predictions ON season < fold GROUP BY fold),
    a AS (SELECT 'training_mean' AS family, game_id, my AS prediction FROM k JOIN m ON season = fold UNION ALL
        SELECT 'ridge', game_id, my + n * u / (n + 10) * (x - mx) / sd FROM ob JOIN st USING (family) WHERE season = fold AND family = 'b' UNION ALL
        SELECT 'elastic_net', game_id, my + sign(u) * greatest(0, abs(u) - 0.05e0) / 1.05e0 * (x - mx) / sd FROM ob JOIN st USING (family) WHERE season = fold AND family = 'week')
    SELECT a.family, game_id, season, season - 1 AS training_cutoff, {d6('prediction')} AS prediction, {d6('actual - prediction')} AS residual, {d6('coverage')} AS coverage FROM a JOIN k USING (game_id)"""


@query("m13_oof_models", LONG, ("predictions",))
def _(v):
    rows = singles(v).withColumn("late", F.when(F.col("week") > 26, F.col("week")))
    parts = {
        "training_mean": models.naive_predictions(v("predictions"), SEASONS[0], SEASONS[-1]),
        "ridge": folds.linear_folds(rows, {"b": ["b"]}, SEASONS, [(10.0, None)]),
        "elastic_net": folds.linear_folds(rows, {"week": ["week"]}, SEASONS, [(0.1, 0.5)]),
    }
    return rounded(folds.out_of_fold(parts, rows, ["b", "week", "late"]), "prediction", "residual", "coverage")
