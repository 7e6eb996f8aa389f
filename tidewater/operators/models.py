"""Ratings, blends, folds and residual distributions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.distributions import settle_at


def expanding_folds(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with each evaluation season they train (all before it) or are evaluated in."""
    seasons = F.explode(F.sequence(F.greatest(F.lit(first), F.col("season")).cast("int"), F.lit(last)))
    return rows.where(F.col("season") <= last).withColumn("fold", seasons).withColumn("role", F.when(F.col("season") == F.col("fold"), "evaluate").otherwise("train"))


def naive_predictions(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Training mean of every fold as the prediction of its season."""
    x = expanding_folds(rows, first, last)
    means = x.where("role = 'train'").groupBy("fold").agg(F.avg("actual").alias("prediction"), F.count("*").alias("trained_on"))
    return x.where("role = 'evaluate'").join(means, "fold").select("game_id", "season", "fold", "actual", "prediction", "trained_on")


def baseline_predictions(games: DataFrame, target: str, first: int, last: int, newest: int = 20) -> DataFrame:
    """(game_id, fold, variant, prediction) of three baselines that are fitted on the seasons before each fold's.

    training_mean; site_mean, for margins the mean of neutral or of home games; prior_team, for margins the home side's mean minus the
    away side's (0 without history), for totals the mean of the last `newest` games of both (the training mean without any).
    games: game_id, season, kickoff, home, away, neutral, margin, total.
    """
    margin = target == "margin"
    x = expanding_folds(games.withColumn("_y", F.col(target).cast("double")), first, last)
    train, ask = x.where("role = 'train'"), x.where("role = 'evaluate'").select("game_id", "fold", "home", "away", "neutral")
    mean = train.groupBy("fold").agg(F.avg("_y").alias("_mean"))
    site = train.groupBy("fold", "neutral").agg(F.avg("_y").alias("_site"))
    own = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("_y").alias("y")), F.struct(F.col("away").alias("team"), (-F.col("_y") if margin else F.col("_y")).alias("y"))))
    past = train.select("fold", "kickoff", "game_id", own.alias("_o")).select("fold", "kickoff", "game_id", "_o.*")
    if not margin:  # the last games of every team
        w = Window.partitionBy("fold", "team").orderBy(F.desc("kickoff"), F.desc("game_id"))
        past = past.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest)
    team = past.groupBy("fold", "team").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    side = lambda n: team.select("fold", F.col("team").alias(n), F.col("s").alias(f"_s_{n}"), F.col("n").alias(f"_n_{n}"))
    got = ask.join(mean, "fold").join(site, ["fold", "neutral"], "left").join(side("home"), ["fold", "home"], "left").join(side("away"), ["fold", "away"], "left")
    part = lambda n: F.coalesce(F.col(f"_s_{n}") / F.col(f"_n_{n}"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = F.try_divide(zero("_s_home") + zero("_s_away"), zero("_n_home") + zero("_n_away"))
    prior = part("home") - part("away") if margin else F.coalesce(both, F.col("_mean"))
    cells = {"training_mean": F.col("_mean"), "site_mean": F.coalesce("_site", "_mean") if margin else F.col("_mean"), "prior_team": prior}
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("prediction")) for k, c in cells.items()]))
    return got.select("game_id", "fold", out.alias("_x")).select("game_id", "fold", "_x.*")


def blend_weight(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Least-squares weight of b against a, kept in 0..1, fitted on earlier seasons; one row per fold."""
    x = expanding_folds(rows, first, last).where("role = 'train'")
    d, t = F.col("b") - F.col("a"), F.col("actual") - F.col("a")
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.sum(d * t), F.sum(d * d)), F.lit(0.0))))
    return x.groupBy("fold").agg(w.alias("weight"), F.count("*").alias("n"))


def residual_histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def fit_normal(rows: DataFrame, by: list[str], value: str, floor: float = 0.25) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.greatest(F.lit(floor), F.stddev_pop(value)).alias("sd"), F.count("*").alias("n"))


def grouped_scale(rows: DataFrame, group: str, value: str, k: float = 200.0) -> DataFrame:
    """Deviation of each group, its variance shrunk to the overall one."""
    got = rows.groupBy(group).agg(F.var_pop(value).alias("v"), F.count("*").alias("n"))
    return got.join(rows.agg(F.var_pop(value).alias("g"))).select(group, "n", F.sqrt((F.col("v") * F.col("n") + F.col("g") * k) / (F.col("n") + k)).alias("sd"))


def settle_on_lattice(points: DataFrame, histogram: DataFrame) -> DataFrame:
    """win, push and loss mass of offers (id, market, center, point): the histogram, moved to the centre, with each mass split between the two integers around it.

    A market's histogram is one array of a few hundred bins, and an offer sums over it within its row: nothing is exploded or shuffled again.
    """
    return settle_at(points.withColumn("line", -F.col("point")), histogram).select("id", "market", "win", "push", "loss")


def power_ratings(games: DataFrame, carry: float = 0.65, home: float = 2.5, rate: float = 0.15, cap: float = 35.0) -> DataFrame:
    """Prediction of every game before its result moves both ratings; pool, game_id, prediction.

    Each game depends on all before it in its pool (a league). Spark sorts the games of a pool, and a task reads them batch by batch: it holds one rating per team, however many games there are.
    """

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[int, float] = {}
        pool = season = None
        for df in batches:
            guesses = []
            for g in df.itertuples(index=False):
                if g.pool != pool:
                    ratings, pool, season = {}, g.pool, g.season
                if g.season != season:
                    ratings, season = {t: r * carry for t, r in ratings.items()}, g.season
                guess = ratings.get(g.home, 0.0) - ratings.get(g.away, 0.0) + (0.0 if g.neutral else home)
                step = rate * min(cap, max(-cap, g.margin - guess)) / 2
                ratings[g.home] = ratings.get(g.home, 0.0) + step
                ratings[g.away] = ratings.get(g.away, 0.0) - step
                guesses.append(guess)
            yield pd.DataFrame({"pool": df["pool"], "game_id": df["game_id"], "prediction": guesses}, columns=["pool", "game_id", "prediction"])

    x = games.select("pool", "game_id", "season", "kickoff", "home", "away", "margin", "neutral").where("pool is not null and margin is not null")
    return x.repartition("pool").sortWithinPartitions("pool", "kickoff", "game_id").mapInPandas(play, "pool long, game_id long, prediction double")


def ridge_fold(rows: DataFrame, features: list[str], season: int, alpha: float = 10.0) -> DataFrame:
    """Predictions of one season by a ridge fitted on all before it: median imputation with indicators, standardising, Spark ML's normal solver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = rows.select("game_id", "season", F.col("actual").cast("double").alias("actual"), *[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features])
    train, test = x.where(F.col("season") < season), x.where(F.col("season") == season)
    n, sd = train.agg(F.count("*"), F.stddev_pop("actual")).first()
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_full" for c in features]),
        VectorAssembler(inputCols=[f"{c}_full" for c in features] + [f"{c}_missing" for c in features], outputCol="_raw"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_varied"),
        StandardScaler(inputCol="_varied", outputCol="_x", withMean=True),
        LinearRegression(featuresCol="_x", labelCol="actual", elasticNetParam=0.0, regParam=alpha * (sd or 1.0) / max(1, n), solver="normal", standardization=False),
    ]
    return Pipeline(stages=stages).fit(train).transform(test).select("game_id", "season", "actual", "prediction")


def fold_model(rows: DataFrame, features: list[str], season: int, regressor) -> tuple:
    """(fitted pipeline, predictions of the season): median imputation with indicators, then any Spark ML regressor on `_x`, fitted on earlier seasons."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler

    x = rows.select("game_id", "season", F.col("actual").cast("double").alias("actual"), *[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features])
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_full" for c in features]),
        VectorAssembler(inputCols=[f"{c}_full" for c in features] + [f"{c}_missing" for c in features], outputCol="_raw"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_varied"),
        StandardScaler(inputCol="_varied", outputCol="_x", withMean=True),
        regressor,
    ]
    model = Pipeline(stages=stages).fit(x.where(F.col("season") < season))
    return model, model.transform(x.where(F.col("season") == season)).select("game_id", "season", "actual", "prediction")


def elastic_net_fold(rows: DataFrame, features: list[str], season: int, alpha: float = 0.1, mix: float = 0.5) -> DataFrame:
    from pyspark.ml.regression import LinearRegression

    return fold_model(rows, features, season, LinearRegression(featuresCol="_x", labelCol="actual", regParam=alpha, elasticNetParam=mix))[1]


def tree_fold(rows: DataFrame, features: list[str], season: int, depth: int = 3, trees: int = 10) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor

    return fold_model(rows, features, season, GBTRegressor(featuresCol="_x", labelCol="actual", maxDepth=depth, maxIter=trees, stepSize=0.1, subsamplingRate=0.8, seed=7))[1]


def tune(rows: DataFrame, features: list[str], seasons: list[int], grid: list[float]) -> DataFrame:
    """Mean absolute error of each penalty over the seasons, best first; the grid is a few values."""
    parts = [ridge_fold(rows, features, s, a).select(F.lit(a).alias("alpha"), F.abs(F.col("prediction") - F.col("actual")).alias("e")) for a in grid for s in seasons]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("alpha").agg(F.avg("e").alias("mae"), F.count("*").alias("n"))


def apply_linear(rows: DataFrame, key: str, params: DataFrame) -> DataFrame:
    """Scores of frozen parameters (feature, fill, mean, scale, weight): missing values are filled, the rest is a sum within the row.

    The parameters are one row per feature, and meet the rows as one map; keys are unique.
    """
    names = [c for c in rows.columns if c != key]
    one = params.where(F.col("feature").isin(names)).agg(F.collect_list(F.struct("feature", F.struct("fill", "mean", "scale", "weight").alias("p"))).alias("_p")).select(F.map_from_entries("_p").alias("_p"))
    at = lambda c, f: F.element_at("_p", F.lit(c))[f]
    terms = [(F.coalesce(F.col(c).cast("double"), at(c, "fill")) - at(c, "mean")) / at(c, "scale") * at(c, "weight") for c in names]
    known = F.filter(F.array(*terms), lambda x: x.isNotNull())
    score = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    return rows.crossJoin(one.where(F.size("_p") > 0)).select(key, score.alias("score"))


def dealt(rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """rows, which have a column `repeat`, with `_v`: the chosen columns of another row of their repeat, dealt anew over all of them.

    Each row takes the values of the row of its rank in another hash order. Ranks take two steps, by hash part and within it, so no task sorts them all.
    """

    def ranked(x: DataFrame, salt: int) -> DataFrame:
        h = F.xxhash64("game_id", "repeat", F.lit(salt))
        x = x.withColumn("_h", h).withColumn("_p", F.shiftrightunsigned("_h", 58))
        before = Window.partitionBy("repeat").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        starts = x.groupBy("repeat", "_p").agg(F.count("*").alias("_c")).select("repeat", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("repeat", "_p").orderBy("_h", "game_id")))
        return x.join(starts, ["repeat", "_p"]).withColumn("_i", F.col("_s") + F.col("_n")).drop("_h", "_p", "_s", "_n")

    values = ranked(rows.select("game_id", "repeat", F.struct(*columns).alias("_v")), seed + 1).drop("game_id")
    return ranked(rows, seed).join(values, ["repeat", "_i"]).drop("_i")


def shuffled(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """rows, which have a column `repeat`, with one column dealt anew over all rows of each repeat, for permutation importance; see dealt()."""
    return dealt(rows, [column], seed).withColumn(column, F.col("_v")[column]).drop("_v")


def permutation_importance(rows: DataFrame, features: list[str], season: int, regressor, seed: int = 7, repeats: int = 3) -> DataFrame:
    """Growth of the mean absolute error when a feature is shuffled, its mean and deviation over the repeats; one deal and one transform for all features."""
    model, base = fold_model(rows, features, season, regressor)
    test = rows.where(F.col("season") == season).select("game_id", "season", F.col("actual").cast("double").alias("actual"), *[F.col(c).cast("double").alias(c) for c in features])
    error = F.avg(F.abs(F.col("prediction") - F.col("actual")))
    own = base.agg(error.alias("base"))
    # the order that a feature is dealt in is that of all: one deal serves them, and a row stands once per feature within its task
    every = dealt(test.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))), features, seed)
    x = every.withColumn("feature", F.explode(F.lit(features)))
    x = x.withColumns({c: F.when(F.col("feature") == c, F.col("_v")[c]).otherwise(F.col(c)) for c in features}).drop("_v")
    x = x.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})
    out = model.transform(x).groupBy("feature", "repeat").agg(error.alias("mae"))
    base = own.first()["base"]  # one number
    return out.groupBy("feature").agg((F.avg("mae") - (base or 0.0)).alias("importance"), F.stddev_pop("mae").alias("deviation"))
