"""Registry rules in time, several distributions against a benchmark, bounded history, audits: against plain code."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import evaluate, exposure, features, reports

CANDIDATE = "candidate_id string, event_id long, market long, side long, fair double, push double, price double, odds long, ev double, edge double, books int, dispersion double, age long, as_of long, model_id string, provider_id string, fair_market long, fair_side long, fair_point double, point double, warnings array<string>"


def candidate(name, at=100, model="m", provider="p", event=1, fair=0.55, fair_market=0, fair_side=1, fair_point=None, point=None, warnings=()):
    return (name, event, 0, 1, fair, 0.0, 2.1, 110, 0.1, 0.07, 4, 0.01, 10, at, model, provider, fair_market, fair_side, fair_point, point, list(warnings))


def test_a_retired_model_and_a_moved_mapping_count_from_their_time_on(spark):
    models = [("m", "retained_benchmark", 0, 200), ("m", "retired", 200, None), ("x", "shadow", 0, None), ("y", "retained_benchmark", 0, None), ("y", "retired", 50, 60), ("z", "retained_benchmark", 0, None)]
    mappings = [("p", 1, 0, 300), ("p", 2, 300, None), ("q", 1, 150, None)]
    c = [
        candidate("before", 199), candidate("at", 200), candidate("after", 250), candidate("shadow", model="x"), candidate("unknown", model="none"), candidate("no model", model=None),
        candidate("moved", 300, "z"), candidate("moved with it", 300, "z", event=2), candidate("too early", 149, provider="q"), candidate("side", fair_side=2), candidate("point", fair_point=1.5, point=2.5),
        candidate("same point", fair_point=1.5, point=1.5), candidate("warned", warnings=["stale_book"]), candidate("informed", warnings=["material_book_outlier"]), candidate("no fair", fair=None),
        candidate("overruled", 55, "y"), candidate("overruled, over", 70, "y"),
    ]
    got = exposure.evaluate_registered(
        spark.createDataFrame(c, CANDIDATE), spark.createDataFrame(models, "model_id string, status string, valid_from long, valid_to long"), spark.createDataFrame(mappings, "provider_id string, event_id long, valid_from long, valid_to long")
    )
    reasons = {r.candidate_id: r.reasons for r in got.collect()}
    status, event = ["model_status_not_eligible"], ["event_identity_mismatch"]
    assert reasons == {
        "before": [], "at": status, "after": status, "shadow": status, "unknown": status, "no model": status, "moved": event, "moved with it": [], "too early": event, "side": ["market_identity_mismatch"],
        "point": ["exact_point_mismatch"], "same point": [], "warned": ["pricing_quality_warning"], "informed": [], "no fair": ["fair_probability_unavailable"], "overruled": status, "overruled, over": status,
    }
    assert got.where("qualified").count() == 4 and got.where("class = 'CORE'").count() == 4


def test_challenge_equals_a_loop_with_the_same_draws(spark):
    rnd, rows = random.Random(3), []
    for g in range(600):
        season, base = 2000 + g % 9, rnd.gauss(3, 1)
        for h in ("open", "close"):
            for name, shift in (("bench", 0.0), ("better", -0.2), ("worse", 0.3), ("even", 0.0)):
                if name != "even" or g % 5:
                    rows.append((name, g, season, h, base + shift + rnd.gauss(0, 0.3), base / 2 + shift + rnd.gauss(0, 0.2), rnd.random() < (0.9 if name != "worse" else 0.6), 20 + shift))
    df = spark.createDataFrame(rows, "candidate string, game_id long, season long, horizon string, nll double, crps double, covered boolean, interval_width double")
    got = {(r.horizon, r.candidate): r for r in evaluate.distribution_challenge(df, "bench", ["horizon"], "season").collect()}
    picks = defaultdict(list)
    for r in evaluate.shared_draws(9, 2000, 7, spark).collect():
        picks[r.draw].append(r.pick)
    assert len(picks) == 2000 and all(len(p) == 9 for p in picks.values())
    by = {(r[3], r[0], r[1]): r for r in rows}
    for (h, name), r in got.items():
        own = [x for x in rows if x[0] == name and x[3] == h]
        assert r["rows"] == len(own) and r.nll == pytest.approx(np.mean([x[4] for x in own])) and r.coverage == pytest.approx(np.mean([x[6] for x in own]))
        if name == "bench":
            assert r.advances is None and r.nll_low is None
            continue
        sums = np.zeros((9, 3))
        for x in own:
            b = by[h, "bench", x[1]]
            sums[x[2] - 2000] += (x[4] - b[4], x[5] - b[5], 1)
        drawn = np.array([sums[p].sum(axis=0) for p in picks.values()])
        for k, low, high in ((0, r.nll_low, r.nll_high), (1, r.crps_low, r.crps_high)):
            assert (low, high) == pytest.approx(tuple(np.percentile(drawn[:, k] / drawn[:, 2], [2.5, 97.5])), abs=1e-9)
    assert {k[1] for k, r in got.items() if r.advances} == {"better"} and not got["open", "worse"].coverage_not_worse


def test_bounded_history_is_the_head_of_the_unbounded_one(spark):
    rnd = random.Random(5)
    facts = spark.createDataFrame([(t, g, 1000 * rnd.randrange(40), rnd.choice([None, rnd.random()])) for t in (1, 2, 3) for g in range(60)], "team long, game_id long, available_at long, ppa double")
    asked = spark.createDataFrame([(g, t, 1000 * rnd.randrange(45), g * 2) for t in (1, 2, 3, 4) for g in range(0, 80, 3)], "game_id long, team long, as_of long, more long")
    want = defaultdict(list)
    for r in features.asof_history(asked, facts).where("newest <= 5").orderBy("newest").collect():
        want[r.game_id, r.team].append((r.fact_at, r.fact_game, r.ppa))
    got = features.asof_newest(asked, facts, 5, ["ppa"]).collect()
    assert len(got) == asked.count() and got[0].asDict().keys() == {"game_id", "team", "as_of", "more", "history"}
    assert {(r.game_id, r.team): [tuple(x) for x in r.history] for r in got} == {(r.game_id, r.team): want[r.game_id, r.team] for r in asked.collect()}


def test_audit(spark):
    rows = [(i, 1 + i // 3, 10 * (i // 4), None if i % 7 == 0 else float(i), float("inf") if i % 5 == 0 else 1.0, None if i == 3 else i, 2020 + i % 2) for i in range(20)]
    rows[12], rows[13] = (12, *rows[13][1:]), (13, *rows[12][1:])
    rows += [(5000, *rows[4][1:])]
    df = spark.createDataFrame(rows, "place long, game_id long, kickoff long, a double, b double, target long, season int")
    got = {(r.rule, r.name): r.n for r in features.audit_model_input(df, ["game_id", "kickoff", "target"], ["a", "b"], ["target"], ["kickoff", "game_id"], "place", 2020).collect()}
    keys = [(r[2], r[1]) for r in sorted(rows)]
    want = {("rows", "all"): 21, ("missing", "a"): 3, ("missing", "b"): 0, ("non_finite", "a"): 0, ("non_finite", "b"): 4, ("null_target", "target"): 1, ("duplicate_rows", "all"): 1}
    want |= {("order_violation", "all"): sum(a > b for a, b in zip(keys, keys[1:])), ("season_fence", "all"): sum(r[-1] > 2020 for r in rows)}
    assert got == want and want["order_violation", "all"] >= 1


def test_feature_report(spark):
    rows = [(2020, 1, "open", 0, 5, True, True, 1.0, None, 0.5), (2020, 3, "close", 2, 4, None, False, None, None, None), (2021, 9, "open", 1, 1, False, False, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "season int, week int, horizon string, home_games int, away_games int, adjusted boolean, regime boolean, a double, b double, ratio double")
    games = spark.createDataFrame([(None,), ("late",)], "exclusion string")
    got = {(r.section, r.key, r.measure): r.value for r in reports.feature_report(df, games, {"ab": ["a", "b"]}, ["ratio"]).collect()}
    assert got == {
        ("rows_by_season", "2020", "n"): 2, ("rows_by_season", "2021", "n"): 1, ("rows_by_horizon", "open", "n"): 2, ("rows_by_horizon", "close", "n"): 1, ("early_depth", "0", "n"): 1, ("early_depth", "2", "n"): 1,
        ("early_depth", "4_plus", "n"): 2, ("exclusions", "eligible", "n"): 1, ("exclusions", "late", "n"): 1, ("family_coverage", "ab", "present_cells"): 3, ("family_coverage", "ab", "total_cells"): 6,
        ("family_coverage", "ab", "missing_cells"): 3, ("family_coverage", "ab", "coverage"): 0.5, ("quality", "all", "ratio"): 0.5, ("adjustment", "all", "rows"): 1, ("adjustment", "all", "share"): 0.333333, ("adjustment", "all", "regime_rows"): 1,
    }
    facts = spark.createDataFrame([(1, 2020, 1.0, None), (2, 2020, 1.0, 2.0), (1, 2021, None, None)], "team long, season int, x double, y double")
    cover = {(r.key, r.measure): r.value for r in reports.preseason_coverage(facts, {"one": "x", "two": "y"}, {"xs": facts.where(F.col("x") > 0)}).collect()}
    assert cover == {("2020", "team_seasons"): 2, ("2020", "one"): 2, ("2020", "two"): 1, ("2021", "team_seasons"): 1, ("2021", "one"): 0, ("2021", "two"): 0, ("xs", "n"): 2}
