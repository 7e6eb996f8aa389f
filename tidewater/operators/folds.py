"""Linear models of many folds, feature families and penalties from one pass of sums."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: str) -> Column:
    """A feature as a finite double, else null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def fold_sums(rows: DataFrame, features: list[str], seasons: list[int], first: int | None = None) -> tuple[dict, dict]:
    """(median of each feature by fold, matrix of summed products by fold) of the rows that each fold trains on, all seasons before its own.

    The matrix is over (1, values, missing marks, actual); values are taken from the last fold's median, and 0 where missing. Every later
    step (imputing by a fold's own median, scaling, choosing columns) is linear in these, so the rows are read twice whatever the number of folds, families and penalties.
    The driver gets one row per fold: (2p + 2)(2p + 3) / 2 sums for p features, which is meant for tens of features.
    """
    x = rows.where(F.col("actual").isNotNull() & (F.col("season") < max(seasons)))
    x = x if first is None else x.where(F.col("season") >= first)
    middle = lambda c, s: F.percentile_approx(F.when(F.col("season") < s, present(c)), 0.5, 10000)
    got = x.agg(*[middle(c, s).alias(f"{c}@{s}") for c in features for s in seasons]).first()
    medians = {s: [got[f"{c}@{s}"] for c in features] for s in seasons}
    shift = [m or 0.0 for m in medians[max(seasons)]]
    z = [F.lit(1.0), *terms(features, shift), F.col("actual").cast("double")]
    names = [f"_z{i}" for i in range(len(z))]
    slot = F.array_min(F.filter(F.lit(sorted(seasons)), lambda s: s > F.col("season"))).alias("_slot")
    pairs = list(combinations_with_replacement(range(len(z)), 2))
    sums = x.select(slot, *[c.alias(n) for c, n in zip(z, names, strict=True)]).groupBy("_slot").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i, j in pairs])
    parts = {}
    for r in sums.collect():  # one row per fold
        g = np.zeros((len(z), len(z)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"_{i}_{j}"]
        parts[r["_slot"]] = g
    return medians, {s: sum((g for t, g in parts.items() if t <= s), np.zeros((len(z), len(z)))) for s in seasons}


def terms(features: list[str], shift: list[float]) -> list[Column]:
    return [F.coalesce(present(c) - F.lit(m), F.lit(0.0)) for c, m in zip(features, shift, strict=True)] + [present(c).isNull().cast("double") for c in features]


def solve(gram: np.ndarray, impute: np.ndarray, keep: list[int], alpha: float, mix: float | None) -> np.ndarray:
    """Weights over (1, values, missing marks) of one model: imputing, standardising, dropping columns that do not vary, penalty.

    mix None is ridge, alpha against the sum of squares; else elastic net, alpha against the mean and mix the share of the absolute penalty.
    """
    p = len(impute)
    to = np.zeros((2 * p + 2, 2 * len(keep) + 2))  # columns: 1, imputed values, marks, actual
    to[0, 0] = to[-1, -1] = 1.0
    for k, j in enumerate(keep):
        to[1 + j, 1 + k] = to[1 + p + j, 1 + len(keep) + k] = 1.0
        to[1 + p + j, 1 + k] = impute[j]
    g = to.T @ gram @ to
    n, mean = g[0, 0], g[0] / g[0, 0]
    s = g - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(s), 0.0) / n)
    on = [k for k in range(1, len(scale) - 1) if scale[k] ** 2 > 1e-12 * max(1.0, g[k, k] / n)]
    a = s[np.ix_(on, on)] / np.outer(scale[on], scale[on])
    b = s[on, -1] / scale[on]
    if mix is None:
        w = np.linalg.solve(a + alpha * np.eye(len(on)), b) if on else np.zeros(0)
    else:
        w = np.zeros(len(on))
        for _ in range(20000):
            before = w.copy()
            for k in range(len(on)):
                pull = (b[k] - a[k] @ w) / n + w[k]
                w[k] = np.sign(pull) * max(0.0, abs(pull) - alpha * mix) / (1.0 + alpha * (1.0 - mix))
            if np.max(np.abs(w - before), initial=0.0) < 1e-12:
                break
    beta = np.zeros(to.shape[1] - 1)
    beta[on] = w / scale[on]
    beta[0] = mean[-1] - beta[1:] @ mean[1:-1]
    return to[:-1, :-1] @ beta


def linear_folds(rows: DataFrame, families: dict[str, list[str]], seasons: list[int], grid: list[tuple[float, float | None]], first: int | None = None, label: str = "game_id") -> DataFrame:
    """(game_id, season, actual, family, alpha, mix, trained_on, prediction): every model of every season, fitted on the seasons before it.

    rows: game_id, season, actual, features. families: features by name; grid: (alpha, None) for ridge, (alpha, mix) for elastic net.
    Missing and non-finite features take the fold's median (0 without any) and a mark; rows without actual train nothing and are predicted;
    a season without training rows gets none. The models are folds x families x grid rows, joined to the rows by season.
    """
    features = list(dict.fromkeys(c for cs in families.values() for c in cs))
    medians, grams = fold_sums(rows, features, seasons, first)
    shift = [m or 0.0 for m in medians[max(seasons)]]
    found = []
    for s in seasons:
        if grams[s][0, 0] == 0:
            continue
        impute = np.array([0.0 if m is None else m - z for m, z in zip(medians[s], shift, strict=True)])
        for name, cs in families.items():
            for alpha, mix in grid:
                w = solve(grams[s], impute, [features.index(c) for c in cs], alpha, mix)
                found.append((s, name, float(alpha), None if mix is None else float(mix), int(grams[s][0, 0]), [float(v) for v in w]))
    fitted = rows.sparkSession.createDataFrame(found, "season long, family string, alpha double, mix double, trained_on long, _w array<double>")
    x = rows.where(F.col("season").isin(seasons)).select(F.col(label), F.col("season").cast("long").alias("season"), F.col("actual").cast("double").alias("actual"), F.array(*terms(features, shift)).alias("_t"))
    total = F.get("_w", F.lit(0))
    for i in range(2 * len(features)):
        total = total + F.get("_w", F.lit(i + 1)) * F.get("_t", F.lit(i))
    return x.join(fitted, "season").select(label, "season", "actual", "family", "alpha", "mix", "trained_on", total.alias("prediction"))


def tune_folds(predictions: DataFrame) -> DataFrame:
    """Mean absolute error by family and penalty over all folds, and its place in the family; equal errors go by a hash of the penalty."""
    from pyspark.sql.window import Window

    got = predictions.groupBy("family", "alpha", "mix").agg(F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("mae"), F.count("*").alias("n"))
    tie = F.sha2(F.concat_ws("|", F.col("alpha").cast("string"), F.coalesce(F.col("mix").cast("string"), F.lit(""))), 256)
    return got.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.round("mae", 9), tie)))


def adjusted_ratings(rows: DataFrame, features: list[str], seasons: list[int], alpha: float = 10.0, cap: float = 7.5) -> DataFrame:
    """rating plus a ridge on what it leaves over (actual - rating), the adjustment kept within the cap."""
    x = rows.withColumn("actual", F.col("actual") - F.col("rating"))
    got = linear_folds(x, {"power": features}, seasons, [(alpha, None)])
    bound = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("prediction")))
    return got.select("game_id", "season", bound.alias("_b")).join(rows.select("game_id", "rating", F.col("actual")), "game_id").select("game_id", "season", "actual", (F.col("rating") + F.col("_b")).alias("prediction"))


def market_folds(rows: DataFrame, features: list[str], market: str, seasons: list[int], first: int, alpha: float = 10.0) -> DataFrame:
    """Two ridges of every season from `first` on: on what the market's number leaves over, and on the target with that number as a feature."""
    rest = linear_folds(rows.withColumn("actual", F.col("actual") - F.col(market)), {"residual": features}, seasons, [(alpha, None)], first)
    rest = rest.join(rows.select("game_id", F.col(market).cast("double").alias("_m"), F.col("actual").cast("double").alias("_a")), "game_id").withColumn("prediction", F.col("prediction") + F.col("_m")).withColumn("actual", F.col("_a"))
    both = linear_folds(rows, {"market_as_feature": [*features, market]}, seasons, [(alpha, None)], first)
    return rest.select(*both.columns).unionByName(both).withColumnRenamed("family", "variant")


def out_of_fold(parts: dict[str, DataFrame], rows: DataFrame, features: list[str]) -> DataFrame:
    """One long table of out-of-fold predictions: family, game_id, season, training_cutoff (the last season trained on), prediction, residual, coverage (share of features present).

    parts: (game_id, prediction) by family; rows: game_id, season, actual, features.
    """
    have = sum((present(c).isNotNull().cast("int") for c in features), F.lit(0)) / len(features)
    base = rows.select("game_id", "season", F.col("actual").cast("double").alias("actual"), have.alias("coverage"))
    every = None
    for name, p in parts.items():
        x = p.select(F.lit(name).alias("family"), "game_id", "prediction")
        every = x if every is None else every.unionByName(x)
    return every.join(base, "game_id").select("family", "game_id", "season", (F.col("season") - 1).alias("training_cutoff"), "prediction", (F.col("actual") - F.col("prediction")).alias("residual"), "coverage")
