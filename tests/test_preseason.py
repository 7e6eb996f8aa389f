"""Preseason families and schedule-adjusted form on hand-made rows."""

import pytest

from tidewater.operators import preseason, schedule


def one(df, **at):
    (row,) = [r for r in df.collect() if all(r[k] == v for k, v in at.items())]
    return row


def test_continuity_counts_the_group_and_the_roster(spark):
    roster = spark.createDataFrame(
        [(1, 2000, 1, "QB"), (1, 2000, 2, "qb"), (1, 2000, 3, "LB"), (1, 2001, 1, "QB"), (1, 2001, 2, "WR"), (1, 2001, 2, "WR"), (1, 2001, 4, None)],
        "team long, season long, player long, position string",
    )
    got = preseason.roster_continuity(roster)
    assert got.count() == 2  # a roster that only follows from an earlier one is no roster
    first, second = one(got, season=2000), one(got, season=2001)
    assert first.prior_roster_count == 0 and first.roster_continuity is None and first.qb_continuity is None
    assert (second.roster_count, second.prior_roster_count, second.roster_returning_count) == (3, 3, 2)
    assert second.roster_continuity == pytest.approx(2 / 3) and second.qb_continuity == 0.5 and second.defense_continuity == 0 and second.offensive_line_continuity is None


def test_transfers_after_the_start_and_without_a_time_are_left_out(spark):
    portal = spark.createDataFrame(
        [(2000, 10, 1, 2, "QB", 0.9), (2000, 100, 1, 2, "LB", None), (2000, 101, 1, 2, "LB", 0.8), (2000, None, 1, 2, "LB", 0.8), (2000, 5, 1, None, "K", 0.5), (2001, 5, 1, 2, "QB", 0.5)],
        "season long, moved_at long, origin long, destination long, position string, rating double",
    )
    got = preseason.transfer_counts(portal, spark.createDataFrame([(2000, 100)], "season long, first_kickoff long"))
    assert got.count() == 2
    out, into = one(got, team=1), one(got, team=2)
    assert (out.transfer_out_count, out.transfer_out_rated_count, out.transfer_out_qb_count, out.transfer_out_defense_count, out.transfer_in_count) == (3, 2, 1, 1, 0)
    assert (into.transfer_in_count, into.transfer_in_rating_sum) == (2, 0.9)


def test_leader_by_attempts_then_yards_then_id(spark):
    stats = spark.createDataFrame(
        [(1, 2000, 7, "ATT", 10.0), (1, 2000, 7, "YDS", 80.0), (1, 2000, 8, "att", 10.0), (1, 2000, 8, "YDS", 120.0), (2, 2000, 5, "ATT", 0.0), (2, 2000, 4, "ATT", 0.0), (3, 2000, 1, "ATT", 5.0)],
        "team long, season long, player long, stat_type string, stat double",
    )
    roster = spark.createDataFrame([(1, 2001, 8, "QB"), (2, 2001, 9, "QB")], "team long, season long, player long, position string")
    got = preseason.leader_share(stats, roster)
    assert got.count() == 2  # team 3 has no roster
    a, b = one(got, team=1), one(got, team=2)
    assert (a.season, a.leader, a.leader_attempt_share, a.leader_yard_share, a.leader_returns) == (2001, 8, 0.5, 0.6, True)
    assert (b.leader, b.leader_attempt_share, b.leader_returns) == (4, None, False)


def test_families_missing_are_counted_not_filled(spark):
    none = {n: spark.createDataFrame([], s) for n, s in {
        "recruiting": "team long, season long, rank long", "talent": "team long, season long, talent double", "roster": "team long, season long, player long, position string",
        "stats": "team long, season long, player long, stat_type string, stat double", "portal": "season long, moved_at long, origin long, destination long, position string, rating double",
        "starts": "season long, first_kickoff long",
    }.items()}
    returning = spark.createDataFrame([(1, 2000, 0.5)], "team long, season long, percent_ppa double")
    coaches = spark.createDataFrame([(1, 2000, 3), (1, 2001, 4)], "team long, season long, coach long")
    got = preseason.preseason_families(returning, coaches=coaches, **none)
    a, b = one(got, season=2000), one(got, season=2001)
    assert (a.missing_families, a.percent_ppa, a.coach_change, a.coach_known, a.roster_count, a.transfer_in_count) == (5, 0.5, False, False, None, None)
    assert (b.missing_families, b.percent_ppa, b.coach_change, b.coach_tenure) == (6, None, True, 1)


def test_adjusted_form_swaps_sides_and_never_sees_its_own_game(spark):
    facts = spark.createDataFrame(
        [(1, 10, 20, 2000, 100, 4.0, 1.0), (1, 20, 10, 2000, 100, 1.0, 4.0), (2, 20, 30, 2000, 200, 2.0, 3.0), (2, 30, 20, 2000, 200, 3.0, 2.0), (9, 10, 30, 2000, 150, 99.0, 50.0)],
        "game_id long, team long, opponent long, season long, available_at long, made double, allowed double",
    )
    asks = spark.createDataFrame([(9, 10, 2000, 250), (8, 10, 2000, 50)], "game_id long, team long, season long, as_of long")
    got = schedule.schedule_adjusted(asks, facts, "made", "allowed")
    seen, early = one(got, game_id=9), one(got, game_id=8)
    assert (seen.own, seen.strength) == (4.0, 3.5)  # team 20 allowed 4 and 3
    assert seen.adjusted == pytest.approx(4.0 - 3.5 + (1 + 4 + 3 + 2 + 50) / 5)
    assert early.adjusted is None
