"""Stakes of many portfolios: singles and combinations under each portfolio's own equity, cash, state and open exposure.

candidates: those of `exposure.evaluate_candidates` with `portfolio` and source_ids (the quotes behind a candidate's price).
portfolios: portfolio, equity, cash, start, drawdown. exposures: portfolio, slate, event_id, market, side, home, away, stake, kind (straight or
combination), in money. offers: portfolio, slate, offer_id, odds, leg_ids, quote_ids (arrays of one length). Stakes are money.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import prices
from tidewater.operators.exposure import COMBINED, POLICY, portfolio_state, rank_candidates

#: Share of equity that all combinations of a slate may hold; fixed value.
DAILY_COMBINED = 0.01
GROUP = ["portfolio", "slate"]


def with_open(rows: DataFrame, exposures: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """rows with what their portfolio has open, by each of `keys`: column -> what it is summed by besides the portfolio. No exposure is 0."""
    out = rows
    for name, by in keys.items():
        if name in ("open_home", "open_away"):
            side = name.removeprefix("open_")
            x = exposures.select("portfolio", "stake", F.explode(F.array_distinct(F.array("home", "away"))).alias(side))
            got = x.groupBy("portfolio", side).agg(F.sum("stake").alias(name))
        else:
            x = exposures.where("kind = 'combination'") if name == "open_combined" else exposures
            got = x.groupBy("portfolio", *by).agg(F.sum("stake").alias(name))
        out = out.join(got, ["portfolio", *by], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def ranked_by_portfolio(candidates: DataFrame, portfolios: DataFrame, exposures: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Qualified candidates of every portfolio: adjusted_kelly, what every cap leaves in money, growths, opposed, and rank per slate.

    The caps of a portfolio are shares of its own equity, less what it has open; without equity nothing is staked.
    """
    state = portfolio_state(F.col("equity"), F.col("start_equity"), F.col("drawdown"))
    own = portfolios.withColumnRenamed("start", "start_equity").withColumn("state", state).select("portfolio", "equity", "cash", "state")
    c = candidates.where("qualified").join(own, "portfolio")
    c = with_open(c, exposures, {"open_daily": ["slate"], "open_game": ["event_id"], "open_home": ["home"], "open_away": ["away"], "open_market": ["market"]})
    sides = exposures.groupBy("portfolio", "event_id", "market").agg(F.min("side").alias("_low"), F.max("side").alias("_high"))
    c = c.join(sides, ["portfolio", "event_id", "market"], "left")
    opposed = F.coalesce((F.col("_low") != F.col("side")) | (F.col("_high") != F.col("side")), F.lit(False))
    share = lambda k: F.col("equity") * policy[k]
    factor = F.col("multiplier") * F.when(F.col("class") == "OPPORTUNISTIC", policy["opportunistic"]).otherwise(1.0) * F.when(F.col("state") == "REDUCED_RISK", policy["reduced"]).otherwise(1.0)
    c = c.withColumns({
        "opposed": opposed,
        "adjusted_kelly": prices.kelly_with_push(F.col("fair"), F.col("push"), F.col("price")) * policy["kelly"] * factor,
        "left_bet": F.least(F.when(F.col("class") == "CORE", share("core_bet")).otherwise(share("other_bet")), F.lit(policy["maximum_stake"])),
        "left_daily": share("daily") - F.col("open_daily"),
        "left_game": share("game") - F.col("open_game"),
        "left_correlated": share("correlated") - F.col("open_game"),
        "left_home": share("team") - F.col("open_home"),
        "left_away": share("team") - F.col("open_away"),
        "left_market": share("market") - F.col("open_market"),
    })
    room = F.least("left_bet", "cash", "left_daily", "left_game", "left_correlated", "left_home", "left_away", "left_market")
    fraction = F.when(F.col("equity") > 0, F.greatest(F.lit(0.0), F.least(F.col("adjusted_kelly"), room / F.col("equity")))).otherwise(0.0)
    c = c.drop("_low", "_high").withColumn("fraction", fraction)
    growth = lambda p: prices.expected_log_growth(p, F.col("push"), F.col("price"), F.col("fraction"))
    c = c.withColumns({"growth": growth(F.col("fair")), "worst_growth": growth(F.least(F.col("worst"), 1 - F.col("push")))})
    return rank_candidates(c, GROUP)


LEG = ["pos", "candidate_id", "event_id", "home", "away", "fair", "left_game", "left_home", "left_away", "verified"]
SINGLE = ["portfolio", "slate", "equity", "cash", "state", "id", "rank", "event_id", "market", "side", "home", "away", "adjusted_kelly", "left_bet", "left_daily", "left_game", "left_correlated", "left_home", "left_away", "left_market", "opposed"]


def with_legs(offers: DataFrame, ranked: DataFrame, portfolios: DataFrame, exposures: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Offers with their legs: what is known of each from the ranked candidates, and whether its quote is one behind that candidate.

    Offers of other than two or three legs go on without them.
    """
    state = portfolio_state(F.col("equity"), F.col("start_equity"), F.col("drawdown"))
    own = portfolios.withColumnRenamed("start", "start_equity").withColumn("state", state).select("portfolio", "equity", "cash", "state")
    o = with_open(offers.join(own, "portfolio"), exposures, {"open_daily": ["slate"], "open_combined": ["slate"]})
    o = o.withColumn("left_daily", F.col("equity") * policy["daily"] - F.col("open_daily")).withColumn("left_combined", F.col("equity") * DAILY_COMBINED - F.col("open_combined"))
    o = o.withColumn("wanted", F.size("leg_ids")).withColumn("repeated", F.size(F.array_distinct("leg_ids")) != F.size("leg_ids"))
    legs = o.where("wanted between 2 and 3").select("portfolio", "slate", "offer_id", F.posexplode(F.arrays_zip("leg_ids", "quote_ids")).alias("pos", "leg"))
    legs = legs.select("portfolio", "slate", "offer_id", "pos", F.col("leg.leg_ids").alias("candidate_id"), F.col("leg.quote_ids").alias("_quote"))
    known = ranked.select("portfolio", "slate", "candidate_id", "event_id", "home", "away", "fair", "left_game", "left_home", "left_away", "source_ids")
    legs = legs.join(known, [*GROUP, "candidate_id"]).withColumn("verified", F.coalesce(F.array_contains("source_ids", F.col("_quote")), F.lit(False)))
    legs = legs.groupBy("portfolio", "slate", "offer_id").agg(F.sort_array(F.collect_list(F.struct(*LEG))).alias("legs"))
    return o.join(legs, ["portfolio", "slate", "offer_id"], "left")


def decide(ranked: DataFrame, offers: DataFrame | None = None, policy: dict = POLICY, combined: dict = COMBINED) -> DataFrame:
    """(portfolio, slate, kind, id, place, stake, blocker, p, ev, growth, score): singles in rank order, then combinations of what was picked.

    A pick takes from the caps of those after it: opposing sides, what is left by slate, game, team, market and cash, a least stake, at most top_n. A
    combination draws on the same caps after all picks of its slate; its legs are picked candidates with verified quotes on distinct events and
    teams. Combinations do not take from each other, as one of them is chosen: place orders singles by rank and combinations that pass by
    score. What does not pass has stake 0 and its first blocker. offers: with_legs().

    Spark deals (portfolio, slate) groups and sorts them, candidates before offers; a task holds the picks of one group, which top_n bounds.
    """
    key = F.concat_ws("|", F.coalesce(F.col("portfolio").cast("string"), F.lit("")), F.coalesce(F.col("slate").cast("string"), F.lit("")))
    rows = ranked.withColumnRenamed("candidate_id", "id").select(*SINGLE, F.lit(0).alias("kind"), F.lit(None).cast("double").alias("price"))
    if offers is not None:
        x = offers.select("portfolio", "slate", "equity", "cash", "state", F.col("offer_id").alias("id"), "left_daily", "left_combined", "wanted", "repeated", "legs", F.lit(1).alias("kind"), prices.american_to_decimal(F.col("odds")).alias("price"))
        rows = rows.unionByName(x, allowMissingColumns=True)
    else:
        rows = rows.withColumns({"left_combined": F.lit(0.0), "wanted": F.lit(0), "repeated": F.lit(False), "legs": F.lit(None).cast("array<struct<pos:int>>")})
    cents = lambda x: floor(max(0.0, x) * 100 + 1e-9) / 100

    def single(r, s) -> tuple:
        of_game, of_team = s["game"].get(r.event_id, 0.0), lambda t: s["team"].get(t, 0.0)
        caps = (
            r.left_bet, r.cash - s["total"], r.left_daily - s["total"], min(r.left_game, r.left_correlated) - of_game, r.left_home - of_team(r.home), r.left_away - of_team(r.away),
            r.left_market - s["market"].get(r.market, 0.0),
        )
        stake = cents(min(r.adjusted_kelly * r.equity, *caps))
        if r.state == "PAUSED":
            return 0.0, "portfolio_paused"
        if len(s["picked"]) >= policy["top_n"]:
            return 0.0, "top_n_reached"
        if r.opposed or s["sides"].get((r.event_id, r.market), r.side) != r.side:
            return 0.0, "opposing_position"
        if stake < policy["minimum_stake"]:
            return 0.0, "below_minimum_stake"
        s["picked"].add(r.id)
        s["sides"][r.event_id, r.market] = r.side
        s["total"] += stake
        s["game"][r.event_id] = of_game + stake
        s["market"][r.market] = s["market"].get(r.market, 0.0) + stake
        for t in {r.home, r.away}:
            s["team"][t] = of_team(t) + stake
        return stake, None

    def together(r, s) -> tuple:
        """(stake, blocker, p, ev, growth, score, least, total)"""
        legs = [] if r.legs is None else [dict(x) if isinstance(x, dict) else x.asDict() for x in r.legs]
        stop = lambda why, *known: (0.0, why, *known, *[None] * (6 - len(known)))
        if r.state == "PAUSED":
            return stop("portfolio_paused")
        if not 2 <= r.wanted <= 3:
            return stop("wrong_number_of_legs")
        if r.repeated:
            return stop("repeated_leg")
        if len(legs) != r.wanted or any(x["candidate_id"] not in s["picked"] for x in legs):
            return stop("leg_not_recommended")
        if not all(x["verified"] for x in legs):
            return stop("leg_quote_not_verified")
        teams = [t for x in legs for t in {x["home"], x["away"]}]
        if len({x["event_id"] for x in legs}) < len(legs) or len(set(teams)) < len(teams):
            return stop("shared_event_or_team")
        p = 1.0
        for x in legs:
            p *= x["fair"]
        if r.price is None or r.price != r.price:
            return stop("no_price", p)
        ev = p * r.price - 1
        if ev < combined["minimum_ev"]:
            return stop("below_minimum_ev", p, ev)
        full = max(0.0, ((r.price - 1) * p - (1 - p)) / (r.price - 1))
        share = min(full * combined["kelly"], combined["maximum"]) * (policy["reduced"] if r.state == "REDUCED_RISK" else 1.0)
        caps = [r.left_daily - s["total"], r.left_combined, r.cash]
        for x in legs:
            caps += [x["left_game"] - s["game"].get(x["event_id"], 0.0), x["left_home"] - s["team"].get(x["home"], 0.0), x["left_away"] - s["team"].get(x["away"], 0.0)]
        stake = cents(min(r.equity * share, *caps))
        if stake < policy["minimum_stake"]:
            return stop("below_minimum_stake", p, ev)
        growth = p * log1p(stake / r.equity * (r.price - 1)) + (1 - p) * log1p(-stake / r.equity)
        held = sum(x["event_id"] in s["game"] for x in legs) / len(legs)
        fair = [x["fair"] for x in legs]
        return stake, None, p, ev, growth, growth * (1 - combined["duplicate"] * held), min(fair), sum(fair)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = None, {}
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                if r.key != now:
                    now, s = r.key, {"picked": set(), "sides": {}, "game": {}, "team": {}, "market": {}, "total": 0.0}
                out.append((*single(r, s), *[None] * 6) if r.kind == 0 else together(r, s))
            found = pd.DataFrame(out, columns=["stake", "blocker", "p", "ev", "growth", "score", "least", "sum"], index=df.index)
            yield pd.concat([df[["portfolio", "slate", "kind", "id", "rank"]], found], axis=1)

    dealt = rows.withColumn("key", key).repartition("key").sortWithinPartitions("key", "kind", "rank", "id")
    got = dealt.mapInPandas(pick, "portfolio long, slate long, kind int, id string, rank int, stake double, blocker string, p double, ev double, growth double, score double, least double, sum double")
    passes = (F.col("kind") == 1) & F.col("blocker").isNull()
    order = [F.desc(F.round(k, 12)) for k in ("score", "p", "least", "sum", "ev")]
    place = F.row_number().over(Window.partitionBy(*GROUP, passes).orderBy(*order, "id"))
    got = got.withColumn("place", F.when(F.col("kind") == 0, F.col("rank")).when(passes, place))
    return got.select(*GROUP, F.when(F.col("kind") == 0, "straight").otherwise("combination").alias("kind"), "id", "place", "stake", "blocker", "p", "ev", "growth", "score")
