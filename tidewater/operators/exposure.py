"""Qualification, sizing, ranking and allocation of priced candidates.

candidates: candidate_id, event_id, market, side, home, away, fair, worst (the lowest probability that a contributing
book gives), push, price, odds, edge, ev, books, dispersion, integrity (0 no outlying book, 1 one of them, 2 the best
price's own), age, start, slate. Caps, exposures and stakes are shares of equity until `allocate` turns them into money.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import labels, prices

#: Fixed values of the qualification and risk rules.
POLICY = {
    "minimum_books": 2, "maximum_dispersion": 0.06, "maximum_age": 120, "minimum_edge": 0.0075, "minimum_ev": 0.015, "maximum_odds": 500, "core_ev": 0.03, "core_edge": 0.015, "outlier": 0.03,
    "kelly": 0.25, "opportunistic": 0.6, "reduced": 0.5, "core_bet": 0.02, "other_bet": 0.01, "daily": 0.08, "game": 0.04, "team": 0.05, "market": 0.05, "correlated": 0.04,
    "minimum_stake": 1.0, "maximum_stake": 50.0, "top_n": 5,
}


def evaluate_candidates(c: DataFrame, policy: dict = POLICY, before: dict[str, Column] | None = None) -> DataFrame:
    """All failing rules of each candidate, those of `before` first, whether it qualifies, its class and its quality multiplier."""
    col = F.col
    rules = (before or {}) | {
        "insufficient_book_depth": col("books") < policy["minimum_books"],
        "excessive_or_unknown_dispersion": col("dispersion").isNull() | (col("dispersion") > policy["maximum_dispersion"]),
        "stale_or_future_fair_value": (col("age") < 0) | (col("age") > policy["maximum_age"]),
        "invalid_probability_mass": col("fair") + col("push") > 1,
        "below_minimum_edge": col("edge") < policy["minimum_edge"],
        "below_minimum_ev": col("ev") < policy["minimum_ev"],
        "outside_main_board_odds_profile": col("odds") > policy["maximum_odds"],
    }
    got = c.withColumn("reasons", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))
    doubt = labels.uncertainty_label(col("dispersion"), policy["outlier"])
    core = (col("ev") >= policy["core_ev"]) & (col("edge") >= policy["core_edge"]) & (doubt != "high")
    got = got.withColumn("qualified", F.size("reasons") == 0)
    multiplier = F.when(doubt == "low", 1.0).when(doubt == "moderate", 0.75).when(doubt == "high", 0.4).otherwise(0.6)
    return got.withColumn("multiplier", multiplier).withColumn("class", F.when(col("qualified"), F.when(core, "CORE").otherwise("OPPORTUNISTIC")))


#: Model statuses that may be acted on, and warnings that only inform; fixed values.
ALLOWED_STATUSES = ["retained_benchmark"]
INFORMING = ["material_book_outlier", "best_executable_book_outlier"]


def apart(registry: DataFrame, key: str) -> DataFrame:
    """Rows of a registry (key, valid_from, valid_to or null, ..) with intervals [valid_from, valid_to) that do not overlap: a newer row ends an older one."""
    w = Window.partitionBy(key).orderBy("valid_from")
    newest = registry.groupBy(key, "valid_from").agg(*[F.max_by(c, F.struct(F.coalesce("valid_to", F.lit(2**62)), F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in registry.columns if c not in (key, "valid_from")])
    return newest.withColumn("valid_to", F.least("valid_to", F.lead("valid_from").over(w)))


def valid_at(rows: DataFrame, registry: DataFrame, key: str, at: str, values: dict[str, str]) -> DataFrame:
    """rows with what a registry says of their key at their own time; values: column of the registry -> name. Without an interval that holds: null.

    Intervals are made disjoint first, so a row meets at most one and none is multiplied; keys meet by an equi-join.
    """
    r = apart(registry, key).select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *[F.col(c).alias(n) for c, n in values.items()])
    holds = (F.col(key) == F.col("_key")) & (F.col("_from") <= F.col(at)) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return rows.join(r, holds, "left").drop("_key", "_from", "_to")


def evaluate_registered(c: DataFrame, models: DataFrame, mappings: DataFrame, policy: dict = POLICY) -> DataFrame:
    """evaluate_candidates() behind the rules on identity, model status and pricing warnings, by what the registries said at each candidate's as_of.

    c has besides: as_of, model_id, provider_id (of the event its fair value was made for), fair_market, fair_side, fair_point, point, warnings (array). models: model_id,
    status, valid_from, valid_to; mappings: provider_id, event_id, valid_from, valid_to (epoch seconds, valid_to null while open). A fair value is no candidate's whose event
    is not the one its provider id was mapped to at the time; a model is eligible from valid_from on and no more at valid_to.
    """
    x = valid_at(c, models, "model_id", "as_of", {"status": "model_status"})
    x = valid_at(x, mappings, "provider_id", "as_of", {"event_id": "fair_event"})
    before = {
        "event_identity_mismatch": ~F.col("fair_event").eqNullSafe(F.col("event_id")),
        "market_identity_mismatch": ~(F.col("fair_market").eqNullSafe(F.col("market")) & F.col("fair_side").eqNullSafe(F.col("side"))),
        "exact_point_mismatch": ~F.col("fair_point").eqNullSafe(F.col("point")),
        "model_status_not_eligible": ~F.coalesce(F.col("model_status").isin(ALLOWED_STATUSES), F.lit(False)),
        "fair_probability_unavailable": F.col("fair").isNull(),
        "pricing_quality_warning": F.size(F.array_except(F.coalesce("warnings", F.array().cast("array<string>")), F.lit(INFORMING))) > 0,
    }
    return evaluate_candidates(x, policy, before)


def portfolio_state(equity: Column, start: Column, drawdown: Column, floor: float = 0.5, paused: float = 0.2, reduced: float = 0.1) -> Column:
    return F.when((equity <= start * floor) | (drawdown >= paused), "PAUSED").when(drawdown >= reduced, "REDUCED_RISK").otherwise("NORMAL")


def kelly_allocation(c: DataFrame, policy: dict = POLICY, state: str = "NORMAL") -> DataFrame:
    raw = prices.kelly_with_push(F.col("fair"), F.col("push"), F.col("price"))
    factor = F.col("multiplier") * F.when(F.col("class") == "OPPORTUNISTIC", policy["opportunistic"]).otherwise(1.0) * (policy["reduced"] if state == "REDUCED_RISK" else 1.0)
    return c.withColumn("raw_kelly", raw).withColumn("adjusted_kelly", raw * policy["kelly"] * factor)


def rank_with_caps(c: DataFrame, exposed: DataFrame, equity: float, cash: float, policy: dict = POLICY) -> DataFrame:
    """Stake fraction under the eight caps, and its expected log growth at the fair and at the worst book's probability.

    exposed (kind, value, fraction) holds open exposure by slate, game, team and market. What each cap leaves comes
    back too, as left_daily, left_game, left_team, left_market and left_correlated. Without equity nothing is staked.
    """
    got = c
    for kind, key in (("slate", "slate"), ("game", "event_id"), ("team", "home"), ("team", "away"), ("market", "market")):
        own = exposed.where(F.col("kind") == kind).select(F.col("value").alias("_v"), F.col("fraction").alias(f"_{key}"))
        got = got.join(own, F.col(key).cast("string") == F.col("_v"), "left").drop("_v")
    used = lambda key: F.coalesce(F.col(f"_{key}"), F.lit(0.0))
    got = got.withColumns({
        "left_daily": policy["daily"] - used("slate"), "left_game": policy["game"] - used("event_id"), "left_team": policy["team"] - F.greatest(used("home"), used("away")),
        "left_market": policy["market"] - used("market"), "left_correlated": policy["correlated"] - used("event_id"), "left_bet": per_bet(equity, policy),
    })
    room = F.least("adjusted_kelly", "left_bet", F.lit(cash / equity if equity > 0 else 0.0), *[f"left_{x}" for x in ("daily", "game", "team", "market", "correlated")])
    got = got.withColumn("fraction", F.greatest(F.lit(0.0), room)).drop("_slate", "_event_id", "_home", "_away", "_market")
    growth = lambda p: prices.expected_log_growth(p, F.col("push"), F.col("price"), F.col("fraction"))
    return got.withColumns({"growth": growth(F.col("fair")), "worst_growth": growth(F.least(F.col("worst"), 1 - F.col("push")))})


def per_bet(equity: float, policy: dict = POLICY) -> Column:
    """The most that one bet may stake, by its class and by the fixed maximum."""
    by_class = F.when(F.col("class") == "CORE", policy["core_bet"]).otherwise(policy["other_bet"])
    return F.least(by_class, F.lit(policy["maximum_stake"] / equity if equity > 0 else 0.0))


def rank_candidates(c: DataFrame, by: list[str]) -> DataFrame:
    """Rank by eleven keys, led by the growth at the worst book's probability; growths are compared at twelve places."""
    keys = [
        F.desc(F.round("worst_growth", 12)), F.desc(F.round("growth", 12)), F.desc(F.round("fraction", 12)), F.asc("integrity"), F.desc("books"), F.asc("dispersion"),
        F.asc(F.round(F.abs(1 / F.col("price") - 0.5), 12)), F.desc("ev"), F.desc("edge"), F.asc("start"), F.asc("candidate_id"),
    ]
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def mark_opposed(c: DataFrame, held: DataFrame) -> DataFrame:
    """Whether a position on the other side of the same event and market is held (event_id, market, side)."""
    sides = held.groupBy("event_id", "market").agg(F.min("side").alias("_low"), F.max("side").alias("_high"))
    got = c.join(sides, ["event_id", "market"], "left")
    return got.withColumn("opposed", F.coalesce((F.col("_low") != F.col("side")) | (F.col("_high") != F.col("side")), F.lit(False))).drop("_low", "_high")


def check_caps(c: DataFrame, asked: str = "adjusted_kelly") -> DataFrame:
    """violations: every cap that the asked share would break, and opposing positions."""
    rules = {f"{x}_cap": F.col(asked) > F.col(f"left_{x}") for x in ("bet", "daily", "game", "correlated", "market", "team")} | {"opposing_position": F.col("opposed")}
    return c.withColumn("violations", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))


def allocate(ranked: DataFrame, equity: float, cash: float, policy: dict = POLICY, state: str = "NORMAL") -> DataFrame:
    """Stakes in money, rounded down to cents, in rank order per slate: opposing sides, caps after open exposure and earlier picks, a least stake, at most top_n.

    Later picks depend on earlier stakes. Spark sorts the candidates of a slate, and a task reads them batch by batch: it holds what is
    taken so far, which top_n bounds, however many candidates there are. Null slates are one slate. A paused portfolio stakes nothing.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for df in batches:
            stakes, blockers = [], []
            for r in df.itertuples(index=False):
                if r.slate_key != now:
                    now, game, team, market, total, taken, n = r.slate_key, {}, {}, {}, 0.0, {}, 0
                key = (r.event_id, r.market)
                of_game, of_team = game.get(r.event_id, 0.0), max(team.get(t, 0.0) for t in (r.home, r.away))
                caps = (r.left_daily * equity - total, min(r.left_game, r.left_correlated) * equity - of_game, r.left_team * equity - of_team, r.left_market * equity - market.get(r.market, 0.0))
                stake = floor(max(0.0, min(r.adjusted_kelly * equity, r.left_bet * equity, cash - total, *caps)) * 100 + 1e-9) / 100
                if state == "PAUSED":
                    blocker = "portfolio_paused"
                elif n >= policy["top_n"]:
                    blocker = "top_n_reached"
                elif r.opposed or taken.get(key, {r.side}) != {r.side}:
                    blocker = "opposing_position"
                elif stake < policy["minimum_stake"]:
                    blocker = "below_minimum_stake"
                else:
                    blocker = None
                    n += 1
                    taken.setdefault(key, set()).add(r.side)
                    total += stake
                    game[r.event_id] = of_game + stake
                    market[r.market] = market.get(r.market, 0.0) + stake
                    for t in {r.home, r.away}:
                        team[t] = team.get(t, 0.0) + stake
                stakes.append(stake if blocker is None else 0.0)
                blockers.append(blocker)
            yield pd.DataFrame({"slate": df["slate"], "candidate_id": df["candidate_id"], "rank": df["rank"], "stake": stakes, "blocker": pd.Series(blockers, dtype="object", index=df.index)})

    cols = ranked.select("slate", F.coalesce(F.col("slate").cast("string"), F.lit("")).alias("slate_key"), "candidate_id", "event_id", "market", "side", "home", "away", "adjusted_kelly", "left_bet", "left_daily", "left_game", "left_correlated", "left_team", "left_market", "opposed", "rank")
    cols = cols.repartition("slate_key").sortWithinPartitions("slate_key", "rank", "candidate_id")
    return cols.mapInPandas(pick, "slate long, candidate_id string, rank int, stake double, blocker string")


def distances(policy: dict = POLICY) -> Column:
    """How far each failed rule is from holding, as a share of its threshold; map by reason."""
    short = lambda c, t: F.greatest(F.lit(0.0), (t - F.col(c)) / t)
    far = {
        "below_minimum_ev": short("ev", policy["minimum_ev"]), "below_minimum_edge": short("edge", policy["minimum_edge"]),
        "insufficient_book_depth": (policy["minimum_books"] - F.col("books")) / policy["minimum_books"],
        "excessive_or_unknown_dispersion": F.when(F.col("dispersion").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("dispersion") - policy["maximum_dispersion"]) / policy["maximum_dispersion"])),
        "stale_or_future_fair_value": F.abs(F.col("age") - policy["maximum_age"]) / policy["maximum_age"],
    }
    value = lambda r: F.coalesce(*[F.when(r == k, v) for k, v in far.items()], F.lit(1.0))
    return F.transform("reasons", lambda r: F.struct(value(r).alias("distance"), r.alias("reason")))


def watchlist(c: DataFrame, policy: dict = POLICY, gates: int = 2, total: float = 0.75, single: float = 0.5, as_of=None) -> DataFrame:
    """Near misses with positive edge and value that have not started: at most `gates` failed rules, near their thresholds; ranked."""
    c = c if as_of is None else c.where(F.col("start") > as_of)
    x = c.where((~F.col("qualified")) & (F.col("edge") > 0) & (F.col("ev") > 0)).withColumn("_d", distances(policy))
    x = x.withColumn("distance", F.aggregate("_d", F.lit(0.0), lambda a, d: a + d["distance"])).withColumn("_top", F.array_max("_d"))
    x = x.where((F.size("reasons") <= gates) & (F.col("distance") <= total) & (F.col("_top.distance") <= single)).withColumn("primary_blocker", F.col("_top.reason"))
    w = Window.partitionBy("slate").orderBy(F.size("reasons"), "distance", F.desc("ev"), F.desc("edge"), "start", "candidate_id")
    return x.withColumn("place", F.row_number().over(w)).drop("_d", "_top")


def evaluation_status(c: DataFrame, watched: DataFrame) -> DataFrame:
    """QUALIFIED, WATCHLIST or PASS per candidate."""
    w = watched.select("candidate_id", F.lit(True).alias("_w"))
    state = F.when(F.col("qualified"), "QUALIFIED").when(F.col("_w"), "WATCHLIST").otherwise("PASS")
    return c.join(w, "candidate_id", "left").select("candidate_id", "slate", state.alias("status"))


def candidate_diagnostics(c: DataFrame) -> DataFrame:
    """Stage counts by market and by odds band, and of the practical core of prices, in one pass."""
    keys = F.array_compact(F.array(
        F.struct(F.lit("market").alias("kind"), F.col("market").cast("string").alias("value")), F.struct(F.lit("odds_band").alias("kind"), labels.odds_band(F.col("odds")).alias("value")),
        F.when(F.col("odds").between(-220, 220), F.struct(F.lit("core").alias("kind"), F.lit("-220..220").alias("value"))),
    ))
    return c.withColumn("_k", F.explode(keys)).groupBy("_k.kind", "_k.value").agg(F.count("*").alias("calculable"), F.count_if(F.col("edge") > 0).alias("positive_edge"), F.count_if(F.col("ev") > 0).alias("positive_ev"), F.count_if("qualified").alias("qualified"))


#: Fixed values of the combination rules.
COMBINED = {"minimum_ev": 0.05, "kelly": 0.1, "maximum": 0.005, "duplicate": 0.25}


def rank_combinations(offers: DataFrame, legs: DataFrame, policy: dict = COMBINED) -> DataFrame:
    """Offers of two or three recommended legs on distinct events and disjoint teams: joint probability, value, stake fraction, growth, score, rank.

    offers: offer_id, slate, odds, leg_ids (array); legs: candidate_id, event_id, home, away, fair. Every leg is
    recommended by itself too, so the score takes the whole penalty for exposure that is held twice.
    """
    x = offers.select("offer_id", "slate", "odds", F.size("leg_ids").alias("wanted"), F.explode("leg_ids").alias("candidate_id")).join(legs.select("candidate_id", "event_id", "home", "away", "fair"), "candidate_id")
    teams = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("home", "away"))))).alias("teams")
    got = x.groupBy("offer_id", "slate", "odds", "wanted").agg(F.count("*").alias("legs"), F.count_distinct("event_id").alias("events"), teams, F.exp(F.sum(F.ln("fair"))).alias("p"), F.min("fair").alias("least"), F.sum("fair").alias("total"))
    got = got.where("legs = wanted and legs between 2 and 3 and events = legs and teams = 2 * legs")
    price = prices.american_to_decimal(F.col("odds"))
    got = got.withColumn("ev", prices.ev_binary(F.col("p"), price)).where(F.col("ev") >= policy["minimum_ev"])
    got = got.withColumn("fraction", F.least(prices.kelly_with_push(F.col("p"), F.lit(0.0), price) * policy["kelly"], F.lit(policy["maximum"])))
    got = got.withColumn("growth", prices.expected_log_growth(F.col("p"), F.lit(0.0), price, F.col("fraction")))
    got = got.withColumn("score", F.col("growth") * (1 - policy["duplicate"]))
    order = [F.desc(F.round(k, 12)) for k in ("score", "p", "least", "total", "ev")]
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("slate").orderBy(*order, "offer_id"))).drop("least", "total")


def opposing_positions(candidates: DataFrame, opened: DataFrame) -> DataFrame:
    """candidates without those that face an open position of their portfolio on another side of the same event and market."""
    held = opened.select(F.col("portfolio").alias("_p"), F.col("event_id").alias("_e"), F.col("market").alias("_m"), F.col("side").alias("_s")).distinct()
    same = (F.col("portfolio") == F.col("_p")) & (F.col("event_id") == F.col("_e")) & (F.col("market") == F.col("_m"))
    return candidates.join(held, same & (F.col("side") != F.col("_s")), "left_anti")
