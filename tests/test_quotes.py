"""Hand-made quotes: edge cases and metamorphic tests of as-of operators."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import labels, prices
from tidewater.operators import exposure, features, models, quotes
from tidewater.sources import snapshots

SCHEMA = "event_id long, book_id long, market long, side long, snapshot_id long, requested long, observed long, ingested long, point double, odds long, start long, league long, status string, book_active boolean, matched boolean"


def row(event=1, book=1, market=0, side=1, snap=1, requested=100, observed=90, ingested=101, point=None, odds=-110, start=10_000, status="active"):
    return (event, book, market, side, snap, requested, observed, ingested, point, odds, start, 0, status, True, True)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_a_line_removed_by_a_newer_snapshot_disappears(spark):
    q = frame(spark, [row(market=2, point=40.0, snap=1), row(market=2, point=41.0, snap=1), row(market=2, point=41.0, snap=2, requested=200, observed=50, ingested=201)])
    assert [r.point for r in quotes.latest_state(q).collect()] == [41.0]
    assert quotes.latest_state(q, 150).count() == 2


def test_future_rows_change_no_earlier_answer(spark):
    past = [row(event=e, book=b, side=s, odds=-110 + 3 * b, snap=1) for e in range(5) for b in range(4) for s in (1, 2)]
    future = [row(event=e, book=b, side=s, odds=300, snap=9, requested=500, observed=90, ingested=501) for e in range(5) for b in range(4) for s in (1, 2)]
    late = [row(event=1, side=1, odds=450, snap=8, requested=100, observed=60, ingested=900)]
    before = sorted(map(tuple, quotes.price_markets(frame(spark, past), 400).collect()), key=str)
    after = sorted(map(tuple, quotes.price_markets(frame(spark, past + future + late), 400).collect()), key=str)
    assert before == after and len(before) == 10


def test_first_failing_reason(spark):
    rows = [row(), row(book=9), row(status="suspended"), row(start=50), row(requested=1, observed=1), row(observed=-100_000_000)]
    got = frame(spark, rows).select(quotes.eligibility(110, 60, 1000, [1]).alias("r")).collect()
    assert [r.r for r in got] == [None, "unsupported_or_inactive_book", "inactive_observation", "event_started", "stale_snapshot", "pathologically_old_provider_quote"]


def test_pairs(spark):
    q = frame(spark, [row(market=1, side=1, point=-3.0), row(market=1, side=2, point=3.0), row(market=1, book=2, side=1, point=-3.0), row(market=2, book=3, side=1, point=40.0), row(market=2, book=3, side=2, point=41.0)])
    got = {(r.book_id, r.line): r.reason for r in quotes.pair_sides(q).collect()}
    assert got == {(1, -3.0): None, (2, -3.0): "missing_side", (3, 40.0): "total_points_differ"}


def test_prices(spark):
    c = F.lit
    got = one(spark, prices.american_to_decimal(c(150)), prices.american_to_decimal(c(-200)), prices.american_to_decimal(c(99)), prices.kelly_with_push(c(0.4), c(0.0), c(2.0)), prices.money_half_up(c(2.345)), prices.money_down(c(2.349)), prices.expected_log_growth(c(0.5), c(0.0), c(2.0), c(0.0)))
    assert [None if x is None else float(x) for x in got] == [2.5, 1.5, None, 0.0, 2.35, 2.34, 0.0]
    got = one(spark, *[prices.settle(c(m), c(s), c(p), c(3), c(40)) for m, s, p in (("spread", "home", -3.0), ("spread", "away", 3.5), ("total", "under", 40.5), ("moneyline", "away", None))])
    assert list(got) == ["push", "win", "win", "loss"]


def test_labels(spark):
    c = F.lit
    got = one(spark, labels.play_success(c("1"), c("7"), c(4)), labels.play_success(c("3"), c("7"), c(6)), labels.play_success(c("x"), c("7"), c(60)), labels.play_success(c("2"), c("0"), c(0)), labels.normalize_book(c(" Fan Duel "), c(None)), labels.normalize_book(c(None), c("My Book!")), labels.parse_utc(c("2024-01-01T00:00:00")), labels.parse_utc(c("2024-01-01T00:00:00Z")).cast("long"), labels.exact_point(c("3.14159")).cast("string"), labels.finite(c("inf")), labels.position_group(c("xx")), labels.selection_side(c("moneyline"), c(" Tie"), c("a"), c("b")))
    assert list(got) == [True, False, False, True, "fanduel", "my_book", None, 1704067200, "3.142", None, "other", "draw"]


def test_recent_mean_ignores_the_future(spark):
    facts = [(1, g, 100 * g, float(g)) for g in range(1, 20)]
    req = spark.createDataFrame([(50, 1, 1000), (51, 1, 50)], "game_id long, team long, as_of long")
    table = lambda rows: spark.createDataFrame(rows, "team long, game_id long, available_at long, v double")
    got = {r.game_id: (r.last_3, r.known) for r in features.recent_mean(req, table(facts), "v", 3).collect()}
    assert got == {50: (9.0, 3), 51: (None, 0)}
    changed = [f if f[2] <= 1000 else (*f[:3], 1e9) for f in facts]
    assert {r.game_id: (r.last_3, r.known) for r in features.recent_mean(req, table(changed), "v", 3).collect()} == got


def test_ratings_predict_before_they_update(spark):
    games = spark.createDataFrame([(0, 1, 1999, 10, 1, 2, 14, False), (0, 2, 1999, 20, 2, 1, 7, True), (0, 3, 2000, 30, 1, 2, 0, False)], "pool long, game_id long, season long, kickoff long, home long, away long, margin long, neutral boolean")
    got = {r.game_id: r.prediction for r in models.power_ratings(games).collect()}
    step = 0.15 * (14 - 2.5) / 2
    second = -2 * step
    assert got[1] == 2.5 and got[2] == pytest.approx(second)
    step -= 0.15 * (7 - second) / 2
    assert got[3] == pytest.approx(2 * step * 0.65 + 2.5)


CANDIDATE = "candidate_id string, slate long, event_id long, market long, side long, home long, away long, fair double, worst double, push double, price double, odds long, edge double, ev double, books long, dispersion double, integrity int, age long, start long"


def candidate(name, event=1, market=0, side=1, home=10, away=20, fair=0.55, worst=0.53, price=2.0, odds=100, books=4, dispersion=0.01, integrity=0, age=10, start=9000, slate=1, push=0.0):
    return (name, slate, event, market, side, home, away, fair, worst, push, price, odds, fair - 1 / price, fair * price - 1, books, dispersion, integrity, age, start)


def board(spark, rows, exposed=(), held=(), equity=1000.0, cash=1000.0):
    c = exposure.kelly_allocation(exposure.evaluate_candidates(spark.createDataFrame(rows, CANDIDATE)).where("qualified"))
    c = exposure.mark_opposed(c, spark.createDataFrame(list(held), "event_id long, market long, side long"))
    used = spark.createDataFrame(list(exposed), "kind string, value string, fraction double")
    return exposure.rank_candidates(exposure.rank_with_caps(c, used, equity, cash), ["slate"])


def test_qualification_rules(spark):
    rows = [candidate("ok"), candidate("thin", books=1), candidate("wide", dispersion=0.07), candidate("unknown", dispersion=None), candidate("old", age=121), candidate("future", age=-1), candidate("edge", fair=0.507), candidate("long", fair=0.2, price=6.01, odds=501)]
    got = {r.candidate_id: (r.reasons, r["class"], r.multiplier) for r in exposure.evaluate_candidates(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got["ok"] == ([], "CORE", 1.0)
    assert {k: v[0] for k, v in got.items() if k != "ok"} == {
        "thin": ["insufficient_book_depth"], "wide": ["excessive_or_unknown_dispersion"], "unknown": ["excessive_or_unknown_dispersion"], "old": ["stale_or_future_fair_value"], "future": ["stale_or_future_fair_value"],
        "edge": ["below_minimum_edge", "below_minimum_ev"], "long": ["outside_main_board_odds_profile"],
    }
    assert got["unknown"][2] == 0.6 and got["wide"][2] == 0.4


def test_caps_leave_the_least_room(spark):
    exposed = [("slate", "1", 0.07), ("game", "2", 0.035), ("team", "30", 0.048), ("market", "5", 0.049)]
    rows = [candidate("a", slate=2), candidate("b", slate=1), candidate("c", event=2, slate=2), candidate("d", away=30, slate=2), candidate("e", market=5, slate=2), candidate("f", fair=0.51, worst=0.5, slate=2)]
    got = {r.candidate_id: r for r in board(spark, rows, exposed).collect()}
    assert {k: round(r.fraction, 9) for k, r in got.items()} == {"a": 0.02, "b": 0.01, "c": 0.005, "d": 0.002, "e": 0.001, "f": 0.003}
    assert got["a"].growth > got["a"].worst_growth > 0
    assert all(r.fraction == 0 and r.growth == 0 for r in board(spark, rows, equity=0.0).collect())
    assert {r.fraction for r in board(spark, rows[:1], cash=3.0).collect()} == {0.003}
    broken = {r.candidate_id: r.violations for r in exposure.check_caps(board(spark, rows, exposed, [(1, 0, 2)])).collect()}
    assert broken["c"] == ["bet_cap", "game_cap", "correlated_cap"] and broken["b"] == ["bet_cap", "daily_cap", "opposing_position"] and broken["e"] == ["bet_cap", "market_cap"]


def test_rank_is_led_by_the_worst_book(spark):
    rows = [candidate("x", worst=0.50), candidate("y", event=2, worst=0.54), candidate("z", event=3, worst=0.54, integrity=1), candidate("w", event=4, worst=0.54, books=9)]
    got = {r.candidate_id: r["rank"] for r in board(spark, rows).collect()}
    assert got == {"w": 1, "y": 2, "z": 3, "x": 4}


def test_allocation_obeys_caps(spark):
    rows = [candidate("a"), candidate("b", side=2), candidate("c", event=2, home=10, away=21, fair=0.549), candidate("d", event=3, home=10, away=22, fair=0.548), candidate("e", event=4, market=1, home=40, away=41, fair=0.547), candidate("g", event=5, market=3, home=50, away=51, fair=0.546)]
    kept = {r.candidate_id: (round(r.stake, 2), r.blocker) for r in exposure.allocate(board(spark, rows, held=[(4, 1, 2)]), 1000.0, 1000.0).collect()}
    assert kept["a"] == (20.0, None) and kept["b"] == (0.0, "opposing_position") and kept["e"] == (0.0, "opposing_position")
    assert kept["c"] == (20.0, None) and kept["d"] == (10.0, None) and kept["g"] == (20.0, None)
    few = exposure.allocate(board(spark, rows), 1000.0, 1000.0, exposure.POLICY | {"top_n": 1}).collect()
    assert sorted(r.blocker or "" for r in few) == ["", *["top_n_reached"] * 5]
    assert {r.blocker for r in exposure.allocate(board(spark, rows), 40.0, 40.0).collect()} == {"below_minimum_stake"}
    assert {r.blocker for r in exposure.allocate(board(spark, rows), 1000.0, 1000.0, state="PAUSED").collect()} == {"portfolio_paused"}


def test_watchlist_leaves_out_started_and_far_rows(spark):
    rows = [candidate("near", age=150), candidate("far", age=190), candidate("started", age=150, start=50), candidate("good"), candidate("long", fair=0.2, price=6.01, odds=501)]
    got = exposure.watchlist(exposure.evaluate_candidates(spark.createDataFrame(rows, CANDIDATE)), as_of=100).collect()
    assert [(r.candidate_id, r.primary_blocker, r.distance) for r in got] == [("near", "stale_or_future_fair_value", 0.25)]


def test_combinations(spark):
    legs = spark.createDataFrame([("a", 1, 10, 20, 0.6), ("b", 2, 30, 40, 0.55), ("c", 3, 10, 50, 0.6), ("d", 1, 60, 70, 0.9)], "candidate_id string, event_id long, home long, away long, fair double")
    offers = spark.createDataFrame([("o1", 1, 260, ["a", "b"]), ("o2", 1, 300, ["b", "c"]), ("same_team", 1, 300, ["a", "c"]), ("same_event", 1, 300, ["a", "d"]), ("poor", 1, 210, ["a", "b"]), ("unknown", 1, 300, ["a", "z"]), ("single", 1, 300, ["a"])], "offer_id string, slate long, odds long, leg_ids array<string>")
    got = exposure.rank_combinations(offers, legs).orderBy("rank").collect()
    assert [r.offer_id for r in got] == ["o2", "o1"] and all(r.fraction == 0.005 and r.score == pytest.approx(0.75 * r.growth) for r in got)


def test_credential_keys_at_any_depth(spark):
    bodies = ['{"id": 1, "books": []}', '{"id": 1, "x": {"Api-Key" : "s"}}', '{"id": 1, "x": [{"TOKEN": 1}]}', '{"id": 1, "x": "token"}', '{"id": 1, "tokens": 2}']
    raw = spark.createDataFrame(list(enumerate(bodies)), "snapshot_id long, body string")
    assert sorted(r.snapshot_id for r in snapshots.scan_credential_keys(raw).collect()) == [1, 2]


def test_a_family_of_two_rows_is_paired_whole(spark):
    """Sides whose points differ are one incoherent pair; with more rows in the family each line stands alone."""
    row = lambda event, market, side, point: (event, 1, market, side, 7, point, -110, 0, 0)
    rows = [row(1, 1, 1, -3.0), row(1, 1, 2, 3.5), row(2, 2, 1, 47.0), row(2, 2, 2, 47.5), row(3, 1, 1, -3.0), row(3, 1, 2, 3.0), row(4, 1, 1, -3.0), row(4, 1, 2, 3.5), row(4, 1, 1, -3.5), row(5, 0, 1, None), row(5, 0, 2, None)]
    frame = spark.createDataFrame(rows, "event_id long, book_id long, market long, side long, snapshot_id long, point double, odds long, start long, league long")
    got = sorted((r.event_id, r.line or 0.0, r.reason) for r in quotes.pair_sides(frame).collect())
    assert got == [(1, -3.0, "spread_points_differ"), (2, 47.0, "total_points_differ"), (3, -3.0, None), (4, -3.5, None), (4, -3.0, "missing_side"), (5, 0.0, None)]
