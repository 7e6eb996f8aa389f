"""Balances, performance, attribution, exposure and equity curves of bets and ledger entries.

bets: portfolio, bet_id, event_id, market, side, odds, stake, state (won, lost, push, open), profit, settled_at, closing_p.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import labels, prices


def balances(ledger: DataFrame, bets: DataFrame) -> DataFrame:
    """Cash, reserved stakes, equity and realised profit per portfolio."""
    cash = ledger.groupBy("portfolio").agg(F.sum("amount").alias("cash"))
    held = bets.groupBy("portfolio").agg(F.sum(F.when(F.col("state") == "open", F.col("stake"))).alias("reserved"), F.sum(F.when(F.col("state") != "open", F.col("profit"))).alias("realised"))
    got = cash.join(held, "portfolio", "full_outer").na.fill(0, ["cash", "reserved", "realised"])
    return got.withColumn("equity", F.col("cash") + F.col("reserved"))


def _measures() -> list:
    n = lambda s: F.count_if(F.col("state") == s)
    return [F.count("*").alias("settled"), n("won").alias("wins"), n("lost").alias("losses"), n("push").alias("pushes"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit")]


def performance(bets: DataFrame) -> DataFrame:
    """Settled bets overall and by league and market; hit rate counts pushes as settled."""
    sets = bets.where("state <> 'open'").groupingSets([[], ["league", "market"]], "league", "market").agg(*_measures())
    return sets.withColumn("roi", F.try_divide("profit", "staked")).withColumn("hit_rate", F.try_divide("wins", "settled"))


def attribution(bets: DataFrame, dimensions: dict) -> DataFrame:
    """The same measures over many labels at once; here the hit rate leaves pushes out. One pass: labels are unpivoted."""
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for k, c in dimensions.items()]))
    got = bets.where("state <> 'open'").withColumn("_x", label).groupBy("_x.dimension", "_x.value").agg(*_measures())
    return got.withColumn("hit_rate", F.try_divide("wins", F.col("wins") + F.col("losses")))


def closing_value(bets: DataFrame, by: list[str]) -> DataFrame:
    """Mean closing probability over entry probability, with its count."""
    gain = F.col("closing_p") - prices.implied_probability(F.col("odds"))
    return bets.groupBy(*by).agg(F.count("closing_p").alias("observations"), F.avg(gain).alias("mean_gain"))


def equity_curve(bets: DataFrame) -> DataFrame:
    """Running profit, its running peak (not below 0) and the drawdown, in settling order per portfolio."""
    w = Window.partitionBy("portfolio").orderBy("settled_at", "bet_id").rowsBetween(Window.unboundedPreceding, 0)
    x = bets.where("state <> 'open'").withColumn("equity", F.sum("profit").over(w))
    x = x.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(w)))
    return x.withColumn("drawdown", F.col("peak") - F.col("equity"))


def exposures(bets: DataFrame, games: DataFrame) -> DataFrame:
    """Open stakes with both teams of their game."""
    return bets.where("state = 'open'").join(games.select(F.col("game_id").alias("event_id"), "home", "away"), "event_id")


def exposure_by(exposed: DataFrame) -> DataFrame:
    """Open stake by game, by team (a game counts for both) and by market."""
    keys = F.array(
        F.struct(F.lit("game").alias("kind"), F.col("event_id").cast("string").alias("value")),
        F.struct(F.lit("team").alias("kind"), F.col("home").cast("string").alias("value")),
        F.struct(F.lit("team").alias("kind"), F.col("away").cast("string").alias("value")),
        F.struct(F.lit("market").alias("kind"), F.col("market").cast("string").alias("value")),
    )
    return exposed.select("stake", F.explode(keys).alias("_k")).groupBy("_k.kind", "_k.value").agg(F.sum("stake").alias("stake"), F.count("*").alias("n"))


def ledger_reconcile(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """Expected minus derived cash of every portfolio that either side knows."""
    got = ledger.groupBy("portfolio").agg(F.sum("amount").alias("derived"))
    return targets.join(got, "portfolio", "full_outer").withColumn("difference", F.coalesce("expected", F.lit(0)) - F.coalesce("derived", F.lit(0)))


def bucket_columns() -> dict:
    """The label columns of attribution: league, market, book, classification, kind, model version, edge, odds and confidence, with side, price and portfolio beside."""
    return {
        "market": F.col("market"), "side": F.col("side"), "league": F.col("league"), "odds_band": labels.odds_band(F.col("odds")),
        "price": labels.price_bucket(F.col("odds")), "edge": labels.edge_bucket(F.col("edge")), "portfolio": F.col("portfolio"), "book": F.col("book_id"),
        "classification": F.coalesce("classification", F.lit("unclassified")), "kind": F.col("kind"), "model_version": F.coalesce("model_version", F.lit("unversioned")), "confidence": F.coalesce("confidence", F.lit("unknown")),
    }
