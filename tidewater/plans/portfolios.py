"""Queries of allocation over many portfolios. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import allocation, exposure
from tidewater.plans.more import candidates
from tidewater.plans.queries import landed, query


def portfolios(v) -> DataFrame:
    """Fifty portfolios with equity from their ledgers, some of them in drawdown."""
    got = v("ledger").groupBy("portfolio").agg((F.sum("amount") / 1e5).alias("equity"))
    return got.select("portfolio", "equity", (F.col("equity") * 0.6).alias("cash"), F.col("equity").alias("start"), ((F.col("portfolio") % 11) / 50.0).alias("drawdown"))


def opened(v) -> DataFrame:
    event = F.col("bet_id") % 200 + 1
    kind = F.when(F.col("kind") == "parlay", "combination").otherwise("straight")
    return v("bets").where("state = 'open'").select("portfolio", (F.col("bet_id") % 30 + 11688).alias("slate"), event.alias("event_id"), "market", "side", (event % 130).alias("home"), ((event * 7 + 1) % 130).alias("away"), (F.col("stake") / 1e4).alias("stake"), kind.alias("kind"))


def followed(v) -> DataFrame:
    """Every portfolio follows one league: its qualified candidates, ranked."""
    p = portfolios(v)
    c = exposure.evaluate_candidates(candidates(v)).where("qualified").withColumn("source_ids", F.array(F.concat("candidate_id", F.lit("/a")), F.concat("candidate_id", F.lit("/b"))))
    c = c.withColumn("league", F.col("event_id") % 3).join(p.select("portfolio", (F.col("portfolio") % 3).alias("league")), "league").drop("league")
    return allocation.ranked_by_portfolio(c, p, opened(v))


def decisions(v) -> DataFrame:
    """Offers join each candidate to the one and to the two ranked after it. Candidates are ranked once and read back: they are picked from, make the offers and are their legs."""
    p, e, ranked = portfolios(v), opened(v), landed(followed(v), "ranked")
    after = Window.partitionBy("portfolio", "slate").orderBy("rank")
    ids = F.array("candidate_id", F.lead("candidate_id", 1).over(after), F.lead("candidate_id", 2).over(after))
    o = ranked.select("portfolio", "slate", ids.alias("ids")).select("portfolio", "slate", F.explode(F.array(F.slice("ids", 1, 2), F.col("ids"))).alias("leg_ids")).where("not exists(leg_ids, x -> x is null)")
    o = o.select("portfolio", "slate", F.array_join("leg_ids", "+").alias("offer_id"), F.when(F.size("leg_ids") == 2, 280).otherwise(650).cast("long").alias("odds"), "leg_ids", F.transform("leg_ids", lambda x: F.concat(x, F.lit("/a"))).alias("quote_ids"))
    return allocation.decide(ranked, allocation.with_legs(o, ranked, p, e))


@query("b5_allocate_portfolios")
def _(v):
    """Singles alone: combinations draw on what singles leave, and change none of them."""
    return allocation.decide(followed(v)).select("portfolio", "slate", "id", "place", "stake", "blocker")


@query("b6_combine_portfolios")
def _(v):
    return decisions(v).where("kind = 'combination'").select("portfolio", "slate", "id", "place", "stake", "blocker", "p", "ev", "growth", "score")
