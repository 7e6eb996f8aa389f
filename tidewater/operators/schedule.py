"""A team's recent form, adjusted for the strength of those it met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.features import population_asof_mean


def schedule_adjusted(requests: DataFrame, facts: DataFrame, value: str, against: str, n: int = 5) -> DataFrame:
    """Mean of `value` over the last n games of the season, less the opponents' own mean of `against`, plus the population's.

    All three are as of the request: requests (game_id, team, season, as_of), facts (game_id, team, opponent, season, available_at,
    value, against). `against` is the opposite side's measure: what a defence allows for an offence's own. Null where any part is unknown.
    Facts and requests are merged in time order, so no request meets a history; a request carries at most n opponents on.
    """
    none = lambda kind: F.lit(None).cast(kind)
    told = facts.where(F.col(value).isNotNull()).select("team", "season", F.col("available_at").alias("_t"), F.lit(0).alias("_k"), F.col("game_id").alias("_g"), F.col("opponent").alias("_o"), F.col(value).cast("double").alias("_v"), none("long").alias("game_id"))
    asks = requests.select("team", "season", F.col("as_of").alias("_t"), F.lit(1).alias("_k"), none("long").alias("_g"), none("long").alias("_o"), none("double").alias("_v"), "game_id")
    order = Window.partitionBy("team", "season").orderBy("_t", "_k", "_g", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asks).withColumn("_seen", F.count("_v").over(order))
    # one game more than asked, so that the request's own can be left out
    frame = Window.partitionBy("team", "season").orderBy("_seen").rangeBetween(-n, 0)
    both = both.withColumn("_all", F.collect_list(F.when(F.col("_k") == 0, F.struct("_seen", "_g", "_o", "_v"))).over(frame)).where("_k = 1")
    both = both.withColumn("_last", F.slice(F.sort_array(F.filter("_all", lambda x: x["_g"] != F.col("game_id")), asc=False), 1, n))
    total = F.aggregate("_last", F.lit(0.0), lambda a, x: a + x["_v"])
    own = both.select("game_id", "team", F.col("_t").alias("as_of"), F.try_divide(total, F.size("_last")).alias("own"), F.col("_last._o").alias("_met"))

    there = facts.where(F.col(against).isNotNull()).select(F.col("team").alias("_o"), F.col("available_at").alias("_t"), F.lit(0).alias("_k"), F.col(against).cast("double").alias("_v"), none("long").alias("game_id"), none("long").alias("team"))
    met = own.select(F.explode("_met").alias("_o"), F.col("as_of").alias("_t"), F.lit(1).alias("_k"), none("double").alias("_v"), "game_id", "team")
    upto = Window.partitionBy("_o").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    strength = there.unionByName(met).withColumn("_m", F.avg("_v").over(upto)).where("_k = 1").groupBy("game_id", "team", F.col("_t").alias("as_of")).agg(F.avg("_m").alias("strength"))

    pop = population_asof_mean(requests.select("as_of").distinct(), facts, against)
    got = own.join(strength, ["game_id", "team", "as_of"], "left").join(pop, "as_of", "left")
    return got.select("game_id", "team", "as_of", "own", "strength", (F.col("own") - F.col("strength") + F.col("population_mean")).alias("adjusted"))
