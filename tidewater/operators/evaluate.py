"""Point, probability and distribution scores, calibration, bootstrap and gates.

Point rows have actual and prediction; probability rows have p and outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def point_metrics(rows: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """mae, rmse, bias (prediction - actual, or its negative), median absolute error, r2 (0 without variance)."""
    e = F.col("prediction") - F.col("actual")
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(e) * sign).alias("bias"),
        F.median(F.abs(e)).alias("median_error"), F.var_pop("actual").alias("_v"), F.avg(e * e).alias("_m"),
    )
    return got.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("_m") / F.col("_v")).otherwise(0.0)).drop("_v", "_m")


def brier(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss(p: Column, outcome: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return -(outcome * F.ln(q) + (1 - outcome) * F.ln(1 - q))


def multiclass_scores(ps: list[Column], outcome: Column, clip: float = 1e-6) -> tuple[Column, Column]:
    """(Brier, log loss) over classes 0, 1, ..."""
    b = sum((brier(p, (outcome == i).cast("double")) for i, p in enumerate(ps)), F.lit(0.0))
    chosen = F.coalesce(*[F.when(outcome == i, p) for i, p in enumerate(ps)])
    return b, -F.ln(F.greatest(F.lit(clip), F.least(F.lit(1.0), chosen)))


def residual_diagnostics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, linear quantiles, skewness, excess kurtosis, heavy-tail flag of prediction - actual."""
    x = rows.withColumn("_e", F.col("prediction") - F.col("actual"))
    got = x.groupBy(*by).agg(
        F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("sd"), F.skewness("_e").alias("skewness"), F.kurtosis("_e").alias("excess_kurtosis"),
        *[F.percentile("_e", q).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)],
    )
    return got.withColumn("heavy_tail", F.col("excess_kurtosis") > 1)


def segmented_metrics(rows: DataFrame, segments: dict[str, Column], sign: int = 1) -> DataFrame:
    """point_metrics over overlapping segments in one pass; segments: name -> label column, null leaves a row out."""
    label = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("segment"), c.cast("string").alias("label"))) for k, c in segments.items()])))
    return point_metrics(rows.withColumn("_s", label).select("actual", "prediction", "_s.segment", "_s.label"), ["segment", "label"], sign)


def reliability_bins(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Half-open bins of p, the last closed: count, mean p, observed share, gap."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    got = rows.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("outcome").alias("observed"))
    return got.withColumn("gap", F.col("observed") - F.col("mean_p"))


def calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    got = reliability_bins(rows, by, bins)
    return got.groupBy(*by).agg((F.sum(F.abs("gap") * F.col("n")) / F.sum("n")).alias("calibration_error"))


def probability_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    p, o = F.col("p"), F.col("outcome")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(brier(p, o)).alias("brier"), F.avg(log_loss(p, o)).alias("log_loss"))


def residual_correlation(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x = a.select(*keys, (F.col("actual") - F.col("prediction")).alias("_a")).join(b.select(*keys, (F.col("actual") - F.col("prediction")).alias("_b")), keys)
    return x.agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("correlation"))


def implied_scores(rows: DataFrame) -> DataFrame:
    """Scores of both sides from margin and total, and how many are negative."""
    h, a = (F.col("total") + F.col("margin")) / 2, (F.col("total") - F.col("margin")) / 2
    return rows.agg(F.count("*").alias("n"), F.count_if(h < 0).alias("negative_home"), F.count_if(a < 0).alias("negative_away"), F.min(F.least(h, a)).alias("lowest"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute errors of a challenger and a baseline on shared keys."""
    err = lambda d, n: d.select(*keys, F.abs(F.col("prediction") - F.col("actual")).alias(n))
    return err(a, "error_a").join(err(b, "error_b"), keys)


def block_bootstrap(pairs: DataFrame, block: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Mean difference error_a - error_b and its 95 % interval when whole blocks are drawn again with replacement.

    Rows are reduced to one sum and count per block first; draws are hashes of (draw, slot, seed), so reruns agree.
    The blocks (seasons or weeks) are few; draws x blocks rows are made, none per input row.
    """
    d = F.col("error_a") - F.col("error_b")
    sums = pairs.groupBy(block).agg(F.sum(d).alias("s"), F.count("*").alias("c"))
    ranked = sums.withColumn("i", F.row_number().over(Window.orderBy(block)) - 1).withColumn("blocks", F.count("*").over(Window.partitionBy()))
    slots = ranked.select("i", "blocks", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = slots.select("draw", F.pmod(F.xxhash64("draw", "i", F.lit(seed)), F.col("blocks")).alias("pick"))
    means = picks.join(ranked, picks.pick == ranked.i).groupBy("draw").agg((F.sum("s") / F.sum("c")).alias("m"))
    point = sums.agg((F.sum("s") / F.sum("c")).alias("difference"), F.count("*").alias("blocks"))
    bounds = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("*").alias("draws"))
    return point.join(bounds)


def shared_draws(n: int, draws: int, seed: int, spark) -> DataFrame:
    """(draw, pick): for each draw, n blocks by number, with replacement; hashes, so reruns and all candidates share them."""
    slots = spark.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    return slots.select("draw", F.pmod(F.xxhash64("draw", "slot", F.lit(seed)), F.lit(n)).cast("int").alias("pick"))


def distribution_challenge(scored: DataFrame, benchmark: str, by: list[str], block: str, draws: int = 2000, seed: int = 7, width: float = 0.9, slack: float = 0.01) -> DataFrame:
    """One row per `by` and candidate distribution: summaries, paired intervals against the benchmark, gates, and whether it advances.

    scored, one row per game and candidate: candidate, game_id, nll, crps, covered (whether the central interval of `width` holds the outcome), interval_width, the columns of
    `by` and `block`. Games are paired; blocks are drawn again with replacement, all candidates and scores by the same draws, and all intervals come from one aggregate. A
    candidate advances if the intervals of both score differences lie below zero and its coverage error exceeds the benchmark's by no more than slack.
    Rows shrink to sums per block first; the blocks (seasons, weeks) are few.
    """
    own = scored.where(F.col("candidate") == benchmark).select(*by, "game_id", F.col("nll").alias("_n"), F.col("crps").alias("_c"))
    means = {"rows": F.count("*"), "nll": F.avg("nll"), "crps": F.avg("crps"), "coverage": F.avg(F.col("covered").cast("double")), "interval_width": F.avg("interval_width")}
    summary = scored.groupBy(*by, "candidate").agg(*[c.alias(n) for n, c in means.items()])
    d = scored.where(F.col("candidate") != benchmark).join(own, [*by, "game_id"])
    blocks = d.groupBy(*by, "candidate", block).agg(F.sum(F.col("nll") - F.col("_n")).alias("n"), F.sum(F.col("crps") - F.col("_c")).alias("c"), F.count("*").alias("k"))
    names = blocks.select(block).distinct().withColumn("pick", F.row_number().over(Window.orderBy(block)) - 1)
    count = names.count()  # blocks
    picked = shared_draws(max(1, count), draws, seed, scored.sparkSession).groupBy("draw", "pick").agg(F.count("*").alias("times"))
    again = picked.join(names, "pick").join(blocks, block).groupBy(*by, "candidate", "draw").agg(*[F.try_divide(F.sum(F.col(x) * F.col("times")), F.sum(F.col("k") * F.col("times"))).alias(x) for x in ("n", "c")])
    ends = lambda x, name: [F.percentile(x, q).alias(f"{name}_{end}") for q, end in ((0.025, "low"), (0.975, "high"))]
    intervals = again.groupBy(*by, "candidate").agg(*ends("n", "nll"), *ends("c", "crps"), F.count("*").alias("draws"))
    points = blocks.groupBy(*by, "candidate").agg((F.sum("n") / F.sum("k")).alias("nll_difference"), (F.sum("c") / F.sum("k")).alias("crps_difference"))
    off = lambda c: F.abs(F.col(c) - width)
    bench = summary.where(F.col("candidate") == benchmark).select(*by, F.col("coverage").alias("_cover"))
    got = summary.join(points, [*by, "candidate"], "left").join(intervals, [*by, "candidate"], "left")
    got = got.join(bench, by, "left") if by else got.crossJoin(bench)
    rules = {"nll_below_zero": F.col("nll_high") < 0, "crps_below_zero": F.col("crps_high") < 0, "coverage_not_worse": off("coverage") <= off("_cover") + slack}
    got = got.withColumns({k: F.when(F.col("candidate") != benchmark, F.coalesce(c, F.lit(False))) for k, c in rules.items()})
    advances = F.col("nll_below_zero") & F.col("crps_below_zero") & F.col("coverage_not_worse")
    return got.withColumn("advances", advances).drop("_cover")


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Named rules (metric, at_least, at_most) against (metric, value): pass, fail or unevaluable, and whether all pass."""
    got = rules.join(metrics, "metric", "left")
    ok = (F.coalesce(F.col("value") >= F.col("at_least"), F.col("at_least").isNull())) & (F.coalesce(F.col("value") <= F.col("at_most"), F.col("at_most").isNull()))
    got = got.withColumn("verdict", F.when(F.col("value").isNull(), "unevaluable").when(ok, "pass").otherwise("fail"))
    return got.withColumn("all_pass", F.bool_and(F.col("verdict") == "pass").over(Window.partitionBy()))


def segment_degradation(candidate: DataFrame, reference: DataFrame, least: int = 75, limit: float = 0.25) -> DataFrame:
    """Candidate minus reference error by segment, judged at `least` rows or more."""
    a = candidate.select("segment", "label", F.col("n"), F.col("mae").alias("candidate_mae"))
    got = a.join(reference.select("segment", "label", F.col("mae").alias("reference_mae")), ["segment", "label"]).withColumn("worse", F.col("candidate_mae") - F.col("reference_mae"))
    judged = F.col("n") >= least
    return got.groupBy("segment").agg(F.count_if(judged).alias("evaluated"), F.max(F.when(judged, F.col("worse"))).alias("worst"), F.count_if(judged & (F.col("worse") > limit)).alias("over_limit"))


def common_cohort(predictions: DataFrame, reference: str) -> DataFrame:
    """Keys that a model lacks or has beyond the reference model's; none if all cover the same games."""
    others = sorted(r["model"] for r in predictions.select("model").distinct().collect() if r["model"] != reference)  # one name per model
    names = F.array(*[F.lit(m) for m in others]).cast("array<string>")
    games = predictions.groupBy("game_id").agg(F.collect_set("model").alias("_has"))  # at most one entry per model
    known = F.array_contains("_has", reference)
    off = F.when(known, F.array_except(names, "_has")).otherwise(F.array_intersect(names, F.col("_has")))
    return games.select("game_id", F.explode(off).alias("model"), F.when(known, "missing").otherwise("extra").alias("violation"))
