"""Stakes of several portfolios against a plain loop over one portfolio and slate at a time."""

import math
import random
from collections import defaultdict

import pytest

from tidewater.operators import allocation
from tidewater.operators.exposure import COMBINED, POLICY

CANDIDATE = "portfolio long, candidate_id string, slate long, event_id long, market long, side long, home long, away long, fair double, worst double, push double, price double, ev double, edge double, books int, dispersion double, integrity int, start long, class string, multiplier double, qualified boolean, source_ids array<string>"
EXPOSURE = "portfolio long, slate long, event_id long, market long, side long, home long, away long, stake double, kind string"
PORTFOLIO = "portfolio long, equity double, cash double, start double, drawdown double"
OFFER = "portfolio long, slate long, offer_id string, odds long, leg_ids array<string>, quote_ids array<string>"


def made(seed):
    rnd = random.Random(seed)
    portfolios = [(1, 1000.0, 400.0, 1000.0, 0.0), (2, 20_000.0, 9000.0, 20_000.0, 0.0), (3, 5000.0, 5000.0, 5000.0, 0.12), (4, 900.0, 900.0, 2000.0, 0.3), (5, 3000.0, 30.0, 3000.0, 0.0)]
    candidates, offers = [], []
    for p in range(1, 6):
        for slate in (10, 11):
            own = []
            for i in range(14):
                event = 100 * slate + rnd.randrange(9)
                price, fair = rnd.uniform(1.6, 3.2), rnd.uniform(0.35, 0.7)
                ev = fair * price - 1
                row = (p, f"{p}-{slate}-{i}", slate, event, rnd.randrange(3), rnd.choice((1, 2)), event % 7, 7 + event % 5, fair, fair - 0.02, 0.0, price, ev, fair - 1 / price, rnd.randint(2, 6), rnd.random() / 30, rnd.randrange(3), 5000 + i, "CORE" if ev > 0.03 else "OPPORTUNISTIC", 1.0, ev > 0, [f"q{i}", f"r{i}"])
                candidates.append(row)
                own.append(row)
            for k in range(120):
                legs = rnd.sample(own, rnd.choice((1, 2, 2, 2, 3, 3, 4)))
                ids = [x[1] for x in legs] if k % 9 else [legs[0][1]] * 2
                quotes = [x[-1][k % 2] for x in legs] if k % 5 else ["wrong"] * len(legs)
                offers.append((p, slate, f"o{p}-{slate}-{k}", rnd.choice((250, 400, 900)), ids, (quotes * 2)[: len(ids)]))
    exposures = [(p, rnd.choice((10, 11, 12)), 100 * rnd.choice((10, 11)) + rnd.randrange(9), rnd.randrange(3), rnd.choice((1, 2)), rnd.randrange(7), 7 + rnd.randrange(5), rnd.uniform(1, 30), rnd.choice(("straight", "combination"))) for p in (1, 2, 3, 5) for _ in range(4)]
    return candidates, portfolios, exposures, offers


def cents(x):
    return math.floor(max(0.0, x) * 100 + 1e-9) / 100


def loop(candidates, portfolios, exposures, offers, P=POLICY, C=COMBINED):
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    out = {}
    for p, equity, cash, start, drawdown in portfolios:
        state = "PAUSED" if equity <= start * 0.5 or drawdown >= 0.2 else "REDUCED_RISK" if drawdown >= 0.1 else "NORMAL"
        mine = [dict(zip([c.split()[0] for c in EXPOSURE.split(", ")], e)) for e in exposures if e[0] == p]
        for slate in sorted({c[2] for c in candidates}):
            own = [dict(zip(names, c)) for c in candidates if c[0] == p and c[2] == slate]
            own = [c for c in own if c["qualified"]]
            total = lambda rows, keep: sum(e["stake"] for e in rows if keep(e))

            def caps(c, rows):
                bet = min(equity * (P["core_bet"] if c["class"] == "CORE" else P["other_bet"]), P["maximum_stake"])
                game = total(rows, lambda e: e["event_id"] == c["event_id"])
                team = [equity * P["team"] - total(rows, lambda e, t=t: t in (e["home"], e["away"])) for t in (c["home"], c["away"])]
                return bet, equity * P["daily"] - total(rows, lambda e: e["slate"] == slate), min(equity * P["game"], equity * P["correlated"]) - game, *team, equity * P["market"] - total(rows, lambda e: e["market"] == c["market"])

            for c in own:
                b = c["price"] - 1
                full = max(0.0, (b * c["fair"] - (1 - c["fair"])) / b)
                c["kelly"] = full * P["kelly"] * c["multiplier"] * (P["opportunistic"] if c["class"] == "OPPORTUNISTIC" else 1) * (P["reduced"] if state == "REDUCED_RISK" else 1)
                f = max(0.0, min(c["kelly"], min(*caps(c, mine), cash) / equity))
                grow = lambda q: q * math.log1p(f * b) + (1 - q) * math.log1p(-f) if f else 0.0
                c["order"] = (-round(grow(c["worst"]), 12), -round(grow(c["fair"]), 12), -round(f, 12), c["integrity"], -c["books"], c["dispersion"], round(abs(1 / c["price"] - 0.5), 12), -c["ev"], -c["edge"], c["start"], c["candidate_id"])
            picked, rows = {}, list(mine)
            for place, c in enumerate(sorted(own, key=lambda c: c["order"]), 1):
                stake, spent = 0.0, sum(x["stake"] for x in picked.values())
                if state == "PAUSED":
                    why = "portfolio_paused"
                elif len(picked) >= P["top_n"]:
                    why = "top_n_reached"
                elif any(e["event_id"] == c["event_id"] and e["market"] == c["market"] and e["side"] != c["side"] for e in rows):
                    why = "opposing_position"
                else:
                    stake = cents(min(equity * c["kelly"], *caps(c, rows), cash - spent))
                    why = "below_minimum_stake" if stake < P["minimum_stake"] else None
                    if why:
                        stake = 0.0
                    else:
                        picked[c["candidate_id"]] = c | {"stake": stake}
                        rows.append({k: c[k] for k in ("event_id", "market", "side", "home", "away", "slate")} | {"stake": stake, "kind": "straight"})
                out[p, slate, c["candidate_id"]] = (place, stake, why)
            passing = []
            for _, _, offer, odds, legs, quotes in [o for o in offers if o[0] == p and o[1] == slate]:
                price, own_legs = 1 + odds / 100, [picked.get(x) for x in legs]
                why, stake = None, 0.0
                if state == "PAUSED":
                    why = "portfolio_paused"
                elif not 2 <= len(legs) <= 3:
                    why = "wrong_number_of_legs"
                elif len(set(legs)) < len(legs):
                    why = "repeated_leg"
                elif None in own_legs:
                    why = "leg_not_recommended"
                elif any(q not in x["source_ids"] for q, x in zip(quotes, own_legs)):
                    why = "leg_quote_not_verified"
                elif len({x["event_id"] for x in own_legs}) < len(legs) or any({a["home"], a["away"]} & {b["home"], b["away"]} for i, a in enumerate(own_legs) for b in own_legs[:i]):
                    why = "shared_event_or_team"
                else:
                    q = math.prod(x["fair"] for x in own_legs)
                    ev = q * price - 1
                    if ev < C["minimum_ev"]:
                        why = "below_minimum_ev"
                    else:
                        share = min(max(0.0, ((price - 1) * q - (1 - q)) / (price - 1)) * C["kelly"], C["maximum"]) * (P["reduced"] if state == "REDUCED_RISK" else 1)
                        left = [equity * P["daily"] - total(rows, lambda e: e["slate"] == slate), equity * allocation.DAILY_COMBINED - total(rows, lambda e: e["slate"] == slate and e["kind"] == "combination"), cash]
                        for x in own_legs:
                            left.append(equity * P["game"] - total(rows, lambda e: e["event_id"] == x["event_id"]))
                            left += [equity * P["team"] - total(rows, lambda e, t=t: t in (e["home"], e["away"])) for t in (x["home"], x["away"])]
                        stake = cents(min(equity * share, *left))
                        if stake < P["minimum_stake"]:
                            why, stake = "below_minimum_stake", 0.0
                        else:
                            growth = q * math.log1p(stake / equity * (price - 1)) + (1 - q) * math.log1p(-stake / equity)
                            fair = [x["fair"] for x in own_legs]
                            passing.append(((-round(growth * (1 - C["duplicate"]), 12), -round(q, 12), -round(min(fair), 12), -round(sum(fair), 12), -round(ev, 12), offer), stake))
                out[p, slate, offer] = (None, stake, why)
            for place, (order, stake) in enumerate(sorted(passing), 1):
                out[p, slate, order[-1]] = (place, stake, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_equal_a_loop(spark, seed):
    candidates, portfolios, exposures, offers = made(seed)
    c, p, e, o = (spark.createDataFrame(x, s) for x, s in ((candidates, CANDIDATE), (portfolios, PORTFOLIO), (exposures, EXPOSURE), (offers, OFFER)))
    ranked = allocation.ranked_by_portfolio(c, p, e)
    got = allocation.decide(ranked, allocation.with_legs(o, ranked, p, e)).collect()
    want = loop(candidates, portfolios, exposures, offers)
    assert {(r.portfolio, r.slate, r.id): (r.place, round(r.stake, 2), r.blocker) for r in got} == {k: (a, round(s, 2), w) for k, (a, s, w) in want.items()}
    seen = defaultdict(int)
    for _, _, why in want.values():
        seen[why] += 1
    assert {None, "portfolio_paused", "top_n_reached", "opposing_position", "leg_not_recommended", "wrong_number_of_legs", "repeated_leg"} <= set(seen)
    assert any(r.kind == "combination" and r.stake > 0 for r in got)


def test_portfolios_do_not_share_caps(spark):
    candidates, portfolios, _, _ = made(3)
    none = spark.createDataFrame([], EXPOSURE)
    c = spark.createDataFrame(candidates, CANDIDATE)
    every = allocation.decide(allocation.ranked_by_portfolio(c, spark.createDataFrame(portfolios, PORTFOLIO), none)).collect()
    for own in portfolios:
        alone = allocation.decide(allocation.ranked_by_portfolio(c, spark.createDataFrame([own], PORTFOLIO), none)).collect()
        assert {tuple(r) for r in alone} == {tuple(r) for r in every if r.portfolio == own[0]} and alone


def test_nothing_to_decide(spark):
    candidates, portfolios, exposures, offers = made(4)
    p, e = spark.createDataFrame(portfolios, PORTFOLIO), spark.createDataFrame(exposures, EXPOSURE)
    ranked = allocation.ranked_by_portfolio(spark.createDataFrame([], CANDIDATE), p, e)
    got = allocation.decide(ranked, allocation.with_legs(spark.createDataFrame(offers, OFFER), ranked, p, e)).collect()
    assert len(got) == len(offers) and all(r.stake == 0 and r.blocker for r in got)
