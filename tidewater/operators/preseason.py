"""What is known of a team before its season starts: seven families of context, one grouped aggregate each.

Families come from different sources and any may be missing for a team and season; nothing missing is filled with zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import labels
from tidewater.operators.features import tenure

KEY = ["team", "season"]
GROUPS = ["qb", "offense_skill", "offensive_line", "defense"]
FAMILIES = ["returning", "recruiting", "talent", "roster", "leader", "portal", "coach"]


def roster_continuity(roster: DataFrame) -> DataFrame:
    """Size of each roster, of the one before, and the share of the earlier one that stays, in all and by position group.

    A player who changes group stays in the roster but not in either group; without an earlier roster or group the share is null.
    Each player counts for its own season and as the prior of the next, so no roster is joined with itself.
    """
    one = roster.groupBy(*KEY, "player").agg(labels.position_group(F.max("position")).alias("group"))
    none = F.lit(None).cast("string")
    mark = lambda lag, now, before: F.struct((F.col("season") + lag).alias("season"), now.alias("now"), before.alias("before"))
    both = one.select("team", "player", F.explode(F.array(mark(0, F.col("group"), none), mark(1, none, F.col("group")))).alias("x"))
    seen = both.groupBy("team", "x.season", "player").agg(F.max("x.now").alias("now"), F.max("x.before").alias("before"))
    share = lambda kept, of: F.try_divide(F.count_if(kept), F.count_if(of))
    was = F.col("before").isNotNull()
    got = seen.groupBy(*KEY).agg(
        F.count("now").alias("roster_count"),
        F.count("before").alias("prior_roster_count"),
        F.count_if(was & F.col("now").isNotNull()).alias("roster_returning_count"),
        share(was & F.col("now").isNotNull(), was).alias("roster_continuity"),
        *[share((F.col("before") == g) & (F.col("now") == g), F.col("before") == g).alias(f"{g}_continuity") for g in GROUPS],
    )
    return got.where("roster_count > 0")


def transfer_counts(portal: DataFrame, starts: DataFrame) -> DataFrame:
    """Moves into and out of each team up to its season's first kickoff: counts, rated counts, rating sums, counts by position group.

    portal: season, moved_at, origin, destination, position, rating. starts: season, first_kickoff. A move without a time, or in
    a season without a start, is left out; one without a team on a side counts for the other side only.
    """
    known = portal.join(starts.select("season", "first_kickoff"), "season").where("moved_at <= first_kickoff")
    way = lambda side, name: F.struct(F.col(side).alias("team"), F.lit(name).alias("way"))
    moves = known.select("season", "rating", labels.position_group(F.col("position")).alias("group"), F.explode(F.array(way("origin", "out"), way("destination", "in"))).alias("w"))
    cells = []
    for name in ("out", "in"):
        here = F.col("w.way") == name
        cells += [
            F.count_if(here).alias(f"transfer_{name}_count"),
            F.count_if(here & F.col("rating").isNotNull()).alias(f"transfer_{name}_rated_count"),
            F.coalesce(F.sum(F.when(here, F.col("rating"))), F.lit(0.0)).alias(f"transfer_{name}_rating_sum"),
            *[F.count_if(here & (F.col("group") == g)).alias(f"transfer_{name}_{g}_count") for g in GROUPS],
        ]
    return moves.where("w.team is not null").groupBy("w.team", "season").agg(*cells)


def leader_share(stats: DataFrame, roster: DataFrame) -> DataFrame:
    """Last season's leading passer of every roster: by attempts, then yards, then smallest id; shares; whether the leader is back.

    stats: team, season, player, stat_type, stat, long form. Teams without a roster or without last season's passers have no row.
    """
    at = lambda kind: F.coalesce(F.max(F.when(F.upper("stat_type") == kind, F.col("stat"))), F.lit(0.0))
    each = stats.groupBy(*KEY, "player").agg(at("ATT").alias("attempts"), at("YDS").alias("yards"))
    top = F.min(F.struct((-F.col("attempts")).alias("a"), (-F.col("yards")).alias("y"), "player"))
    best = each.groupBy("team", (F.col("season") + 1).alias("season")).agg(top.alias("top"), F.sum("attempts").alias("_a"), F.sum("yards").alias("_y"))
    lead = best.select(
        *KEY, F.col("top.player").alias("player"), (-F.col("top.a")).alias("leader_attempts"),
        F.try_divide(-F.col("top.a"), "_a").alias("leader_attempt_share"), F.try_divide(-F.col("top.y"), "_y").alias("leader_yard_share"),
    )
    # a leader meets its own season's roster: kept where the team has one, back where the leader is in it
    players = roster.select(*KEY, "player").distinct()
    back = lead.join(players.withColumn("_back", F.lit(True)), [*KEY, "player"], "left")
    return back.join(players.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, F.col("player").alias("leader"), "leader_attempts", "leader_attempt_share", "leader_yard_share", F.coalesce("_back", F.lit(False)).alias("leader_returns")
    )


def coach_facts(coaches: DataFrame) -> DataFrame:
    """Tenure of each team's coach in seasons, whether the coach is new, and whether last season's is known."""
    return tenure(coaches).select(*KEY, "coach", F.col("tenure").alias("coach_tenure"), F.coalesce("changed", F.lit(False)).alias("coach_change"), F.col("known").alias("coach_known"))


def preseason_families(returning: DataFrame, recruiting: DataFrame, talent: DataFrame, roster: DataFrame, stats: DataFrame, portal: DataFrame, coaches: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per team and season that any family knows: all columns of the seven families, a flag per family, their missing count.

    Families are laid over each other by one union and one aggregate, not by six outer joins. returning, recruiting and talent
    hold one row per team and season; of repeated ones each column's largest value counts.
    """
    parts = [returning, recruiting, talent, roster_continuity(roster), leader_share(stats, roster), transfer_counts(portal, starts), coach_facts(coaches)]
    laid = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn(f"has_{f}", F.lit(True)) for f, p in zip(FAMILIES, parts)])
    got = laid.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in laid.columns if c not in KEY])
    got = got.withColumns({f"has_{f}": F.coalesce(f"has_{f}", F.lit(False)) for f in FAMILIES})
    return got.withColumn("missing_families", sum(((~F.col(f"has_{f}")).cast("int") for f in FAMILIES), F.lit(0)))
