"""Prices of every offered line against one centre per market, and their returns.

A `line` here is what the outcome must exceed for the first side (home, over) to win: the total itself, the home side's points taken negatively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import prices
from tidewater.operators import distributions as dist
from tidewater.operators import quotes

KEY = ["event_id", "market", "side"]


def threshold(market: Column, point: Column) -> Column:
    """Line of a first side's point: market 1 is a spread, whose outcome plus point must be above 0."""
    return F.when(market == 1, 0 - point).otherwise(point)


def centered(pairs: DataFrame, histogram: DataFrame, distance: float = 3.0) -> DataFrame:
    """pairs (event_id, book_id, market, line, p, overround, ...) with each book's own centre, `own`, and the robust one over at least two, `center`."""
    own = dist.infer_center(pairs, histogram).withColumnRenamed("center", "own")
    weighted = own.select("event_id", "market", "book_id", F.col("own").alias("center"), (1 / (1 + F.col("overround"))).alias("weight"))
    robust = quotes.robust_center(weighted, quotes.MARKET, distance).select("event_id", "market", "center", F.col("books").cast("long").alias("books"))
    return own.join(robust, quotes.MARKET)


def best_offers(offers: DataFrame, histogram: DataFrame) -> DataFrame:
    """Best offer of each event, market and side by (ev, edge, price, book), of every line that a book offers.

    offers: centered() with odds1 and odds2. dispersion is how far the books' own centres differ on the win probability at the chosen line.
    """
    at = dist.settle_at(offers.select("event_id", "market", "book_id", "line", "center", "books", "odds1", "odds2"), histogram)
    side = lambda n, win, loss: F.struct(F.lit(n).cast("long").alias("side"), F.col(f"odds{n}").alias("odds"), F.col(win).alias("win"), F.col("push").alias("push"), F.col(loss).alias("loss"))
    x = at.withColumn("_s", F.explode(F.array(side(1, "win", "loss"), side(2, "loss", "win")))).select("event_id", "market", "book_id", "line", "center", "books", "_s.*")
    x = x.withColumn("price", prices.american_to_decimal(F.col("odds")))
    x = x.withColumn("ev", prices.ev_with_push(F.col("win"), F.col("loss"), F.col("price"))).withColumn("edge", prices.edge_with_push(F.col("win"), F.col("push"), 1 / F.col("price")))
    order = [F.round("ev", 9).alias("_ev"), F.round("edge", 9).alias("_edge"), "price", "book_id", "line"]
    best = x.groupBy(*KEY).agg(F.max(F.struct(*order, "odds", "win", "push", "loss", "ev", "edge", "center", "books")).alias("b"), F.count("*").alias("offers"))
    best = best.select(*KEY, "offers", *[f"b.{c}" for c in ("book_id", "line", "odds", "price", "win", "push", "loss", "ev", "edge", "center", "books")])
    own = best.select(*KEY, "line").join(offers.select("event_id", "market", F.col("own").alias("center")), quotes.MARKET)
    q = F.try_divide("win", F.col("win") + F.col("loss"))
    spread = dist.settle_at(own, histogram).groupBy(*KEY).agg((F.max(q) - F.min(q)).alias("dispersion"))
    return best.join(spread, KEY)


def expanding_histograms(residuals: DataFrame, last: int, least: int = 300) -> DataFrame:
    """(season, market, value, n): residuals (season, market, value) of the seasons before each, where these are at least `least`."""
    each = residuals.groupBy("season", "market", "value").agg(F.count("*").alias("n")).where(F.col("season") < last)
    x = each.withColumn("season", F.explode(F.sequence((F.col("season") + 1).cast("long"), F.lit(last).cast("long")))).groupBy("season", "market", "value").agg(F.sum("n").alias("n"))
    enough = x.groupBy("season", "market").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select("season", "market")
    return x.join(enough, ["season", "market"])


def backtest(pairs: DataFrame, residuals: DataFrame, results: DataFrame, least: int = 300) -> DataFrame:
    """best_offers() of past events, each priced by the residuals of earlier seasons alone, with the unit return that followed.

    results: event_id, season, margin, total. Events of seasons with fewer than `least` earlier residuals are not priced.
    """
    last = results.agg(F.max("season")).first()[0]
    if last is None:
        last = 0
    key = lambda: (F.col("season") * 10 + F.col("market")).alias("market")
    hist = expanding_histograms(residuals, last, least).select(key(), "value", "n")
    x = pairs.join(results.select("event_id", "season"), "event_id")
    x = x.select(*[key() if c == "market" else F.col(c) for c in pairs.columns])
    best = best_offers(centered(x, hist), hist).withColumn("season", F.floor(F.col("market") / 10)).withColumn("market", F.col("market") % 10)
    got = best.join(results.select("event_id", "margin", "total"), "event_id")
    first, spread = F.col("side") == 1, F.col("market") == 1
    label = F.when(spread, F.when(first, "home").otherwise("away")).otherwise(F.when(first, "over").otherwise("under"))
    point = F.when(spread & first, 0 - F.col("line")).otherwise(F.col("line"))
    result = prices.settle(F.when(spread, "spread").otherwise("total"), label, point, F.col("margin"), F.col("total"))
    return got.withColumn("realized", prices.unit_return(result, F.col("price"))).drop("margin", "total")
