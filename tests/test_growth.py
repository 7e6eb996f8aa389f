"""Work and memory that grow no faster than the input: results of the bounded forms, and how they get them."""

import random
import re
from datetime import datetime, timedelta, timezone
from statistics import NormalDist
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import distributions as dist
from tidewater.operators import features, models
from tidewater.plans import audits, more, portfolios, scored, wider  # noqa: F401
from tidewater.plans.fixtures import view
from tidewater.plans.queries import QUERIES, measured_games
from tidewater.sources import snapshots
from tidewater.streaming import pricing
from tidewater.streaming import quotes as streams


def test_counts_of_history_are_those_of_the_pairs(spark):
    rnd = random.Random(11)
    facts = spark.createDataFrame([(t, g, 1000 * rnd.randrange(20)) for t in (1, 2, None) for g in range(40)] + [(1, 500, None), (2, None, 7000)], "team long, game_id long, available_at long")
    asked = spark.createDataFrame([(g, t, 1000 * rnd.randrange(24), g % 3) for t in (1, 2, 3, None) for g in range(60)] + [(9000, 1, None, 0), (9001, 2, 0, 0)], "game_id long, team long, as_of long, more long")
    h = features.asof_history(asked, facts).groupBy("game_id", "team", "as_of", "more")
    want = h.agg(F.count("*").alias("facts"), F.max("fact_at").alias("newest_at"), F.max(F.when(F.col("newest") == 1, F.col("fact_game"))).alias("newest_game"))
    got = features.asof_counts(asked, facts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.select(*asked.columns, "facts", "newest_at", "newest_game").columns


def test_a_long_history_is_counted_without_its_pairs(spark):
    n = 100_000  # 5 * 10^9 pairs
    facts = spark.range(n).select(F.lit(1).cast("long").alias("team"), F.col("id").alias("game_id"), F.col("id").alias("available_at"))
    got = features.asof_counts(facts.withColumnRenamed("available_at", "as_of"), facts).agg(F.count("*"), F.sum("facts"), F.count_if(F.col("newest_game") == F.col("game_id") - 1)).first()
    assert tuple(got) == (n - 1, n * (n - 1) // 2, n - 1)


@pytest.mark.parametrize("name", ["s1_flatten_quotes", "s2_quarantine_malformed"])
def test_documents_are_parsed_once(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_damage_of_every_kind(spark):
    book = '{"key": 7, "markets": [{"key": 0, "outcomes": [{"side": 1, "odds": 100}, {"side": 1, "odds": 100}, {"side": 2}]}, {"key": 1}, {"outcomes": []}]}'
    bodies = [f'{{"id": 5, "start": 9, "books": [{book}, {{"key": 8}}, {{"key": 9, "markets": []}}]}}', '{"id": 5, "start": 9, "books": []}', '{"id": 5, "start": 9}', '{"id": 5, "books": []}', "{", None, '{"id": 5, "ToKen": 1}']
    raw = spark.createDataFrame(list(enumerate(bodies)), "snapshot_id long, body string")
    good, warned = snapshots.quarantine_malformed(raw)
    assert sorted(r.snapshot_id for r in good.collect()) == [0, 1] and good.columns == ["snapshot_id", "body", "doc"]
    want = [(0, "malformed_bookmaker", "1"), (0, "observation_not_normalized", "0/1"), (0, "observation_not_normalized", "0/2"), (0, "observation_not_normalized", "0/0/2"), (0, "duplicate_observation_skipped", "0/0/1")]
    want += [(2, "malformed_bookmakers", ""), (3, "event_not_normalized", ""), (4, "malformed_event", ""), (5, "malformed_event", ""), (6, "credential_key", "")]
    assert sorted(map(tuple, warned.collect())) == sorted(want)
    assert sorted((r.book_no, r.market_no, r.outcome_no) for r in snapshots.flatten_quotes(good).collect()) == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]


@pytest.mark.parametrize("name", ["m3_ridge_fold", "m4_elastic_net_fold", "m6_tree_fold", "m8_rating_prior", "m9_market_models"])
def test_models_read_their_rows_from_a_table(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan  # neither plays nor games are joined again


def test_plays_are_joined_once_for_attack_and_defence(spark, small):
    plan = measured_games(lambda n: view(spark, small, n))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2  # for the plays and for the drives


def test_metrics_of_both_sides(spark):
    games = spark.createDataFrame([(1, 10, 20, 1999, 5), (2, 10, 30, 1999, 6), (3, None, 20, 1999, 7), (1, 10, 20, 1999, 5)], "game_id long, home long, away long, season long, available_at long")
    plays = [(1, 10, "Rush", 1.0, 12, 1, 10, True), (1, 10, "Sack", -1.0, None, 1, 10, False), (1, 20, "Pass Reception", 3.0, 5, 3, 5, True), (1, 99, "Rush", 7.0, 1, 1, 1, True), (1, 20, "Punt", 9.0, 1, 1, 1, True), (3, None, "Rush", 5.0, 1, 1, 1, True)]
    p = spark.createDataFrame(plays, "game_id long, offense long, type string, ppa double, yards long, down long, distance long, wallclock boolean")
    d = spark.createDataFrame([(1, 20, 7, 30), (1, 20, None, 10)], "game_id long, offense long, points long, yards long")
    got = features.team_game_metrics(games, p, d).select("game_id", "team", "is_home", "plays", "ppa", "pass_ppa", "success", "ppa_allowed", "havoc_rate", "drives", "points_per_drive", "yards_per_drive")
    home = (1, 10, True, 2, 0.0, -1.0, 0.5, 3.0, 0.0, None, None, None)
    away = (1, 20, False, 1, 3.0, 3.0, 1.0, 0.0, 0.5, 2, 3.5, 20.0)
    none = [(2, 10, True), (2, 30, False), (3, None, True), (3, 20, False)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [home, home, away, away, *[(*x, *[None] * 9) for x in none]]))


def test_scores_of_frozen_parameters_need_no_shuffle(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), i % 5) for i in range(50)], "id long, a double, b int")
    params = spark.createDataFrame([("a", 2.0, 1.0, 4.0, 3.0), ("b", 0.0, 0.5, 2.0, -1.0), ("other", 0.0, 0.0, 1.0, 1.0)], "feature string, fill double, mean double, scale double, weight double")
    got = models.apply_linear(rows, "id", params)
    want = {i: ((2.0 if i % 3 == 0 else i) - 1.0) / 4.0 * 3.0 - (i % 5 - 0.5) / 2.0 for i in range(50)}
    assert {r.id: r.score for r in got.collect()} == pytest.approx(want)
    assert models.apply_linear(rows, "id", params.where("feature = 'other'")).count() == 0
    assert "Aggregate [id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_deal_serves_every_column(spark):
    rows = spark.range(500).select(F.col("id").alias("game_id"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b")).withColumn("repeat", F.explode(F.lit([1, 2])))
    got = models.dealt(rows, ["a", "b"], 7).collect()
    assert len(got) == 1000 and all(r._v.b * 2 == r._v.a * 3 for r in got)
    for c in ("a", "b"):
        one = {(r.game_id, r.repeat): r[c] for r in models.shuffled(rows, c, 7).collect()}
        assert one == {(r.game_id, r.repeat): r._v[c] for r in got}
        for k in (1, 2):
            assert sorted(v for (_, n), v in one.items() if n == k) == [i * (2 if c == "a" else 3) for i in range(500)]


def test_the_lattice_is_summed_once_per_row(spark):
    rows = spark.createDataFrame([(1, 0.5, 9.0, 3.0), (2, -4.0, 12.0, -90.0)], "game_id long, loc double, scale double, actual double")
    ratios = spark.createDataFrame([(3, 2.0), (7, 0.5)], "k int, ratio double")
    got = dist.corrected_lattice(rows, ratios)
    plan = got.select("game_id", "corrected")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(_m") == 1 and not re.search(r"/ aggregate\(", plan)  # the sum is not within the lambda that divides by it
    scored = dist.discrete_crps(got, ["game_id"])
    assert "array_insert" not in scored._jdf.queryExecution().optimizedPlan().toString()  # nor is the cdf built by copies
    crps = {r.game_id: r.crps for r in scored.collect()}
    for r in got.collect():
        want = sum((c - (r.actual <= k)) ** 2 for k, c in enumerate(r.cdf, -80))
        assert sum(r.corrected) == pytest.approx(1.0) and crps[r.game_id] == pytest.approx(want, abs=1e-12)


def test_events_meet_games_by_whole_names(spark):
    names = ["team 1", "team 1 state", "team 1 state b", "team 11", "team", "team  1", " team 1", "", None, "other"]
    rnd = random.Random(5)
    g = [(i, rnd.choice(names), rnd.choice(names), rnd.choice([None, *range(0, 9000, 600)])) for i in range(400)]
    p = [(1000 + i, rnd.choice(names), rnd.choice(names), rnd.choice([None, *range(0, 9000, 600)])) for i in range(150)]
    games, found = spark.createDataFrame(g, "game_id long, home_name string, away_name string, kickoff long"), spark.createDataFrame(p, "provider_id long, found_home string, found_away string, start long")
    alike = lambda a, b: a is not None and b is not None and (a == b or a.startswith(b + " ") or b.startswith(a + " "))
    want = set()
    for i, h, a, t in g:
        hits = [e[0] for e in p if t is not None and e[3] is not None and abs(t - e[3]) <= 1800 and alike(h, e[1]) and alike(a, e[2])]
        want.add((i, hits[0] if len(hits) == 1 else None, "missing" if not hits else "reliable" if len(hits) == 1 else "ambiguous"))
    got = features.reconcile_events(games, found)
    assert {s for _, _, s in want} == {"missing", "reliable", "ambiguous"} and set(map(tuple, got.collect())) == want
    # names are keys of the join, not a test of the pairs that start together
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\(found_home#\d+ = found_home#\d+\)", plan)


def test_the_last_range_at_every_place():
    rnd = np.random.default_rng(3)
    for m in (1, 2, 7, 100):
        lo, hi = rnd.integers(0, m + 1, 60), rnd.integers(0, m + 1, 60)
        want = [max((i for i in range(60) if lo[i] <= x < hi[i]), default=-1) for x in range(m)]
        assert pricing.last_active(lo, hi, m).tolist() == want
    assert pricing.last_active(lo[:0], hi[:0], 3).tolist() == [-1] * 3


def test_answers_of_odd_rows_and_many_that_meet(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rnd, t0, big = random.Random(2), datetime(2024, 1, 1), 2**60 + 1
        at = lambda m: None if m is None else t0 + timedelta(minutes=m)
        asked = [(big + i, rnd.choice([1, 2, None]), at(rnd.choice([None, *range(0, 3000, 7)]))) for i in range(300)] + [(big, 1, at(700)), (big, 1, at(700)), (None, 2, at(900))]
        told = [(rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), 1.0, 2.0]), rnd.choice([None, big, big + 1, big + 2]), at(rnd.choice([None, *range(0, 3000, 50)])), at(rnd.choice([None, *range(0, 3000, 11)]))) for _ in range(1500)]
        end = [(99, 99, at(20_000))], [(99, "z", 0.0, 0, at(20_000), at(20_000))]
        # enough rows of one event that pairs of them could not be made: 4 * 10^9
        request, line = "request_id long, event_id long, as_of timestamp", "event_id long, market string, price double, seq long, observed timestamp, ingested timestamp"
        n = 20_000
        many = F.timestamp_micros(F.lit(int(t0.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000) + F.col("id") * 1_000_000)
        spark.createDataFrame(asked + end[0], request).write.parquet(f"{tmp_path}/asked")
        spark.range(10 * n).select(F.col("id").alias("request_id"), F.lit(7).cast("long").alias("event_id"), F.timestamp_micros(F.unix_micros(many) - F.col("id") * 900_000).alias("as_of")).write.mode("append").parquet(f"{tmp_path}/asked")
        spark.createDataFrame(told + end[1], line).write.parquet(f"{tmp_path}/told")
        spark.range(n).select(F.lit(7).cast("long").alias("event_id"), F.lit("m").alias("market"), F.col("id").cast("double").alias("price"), F.col("id").alias("seq"), many.alias("observed"), many.alias("ingested")).write.mode("append").parquet(f"{tmp_path}/told")
        pricing.answer(spark.readStream.schema(request).parquet(f"{tmp_path}/asked"), spark.readStream.schema(line).parquet(f"{tmp_path}/told"), f"{tmp_path}/run", late="1 hour", horizon="5 hours")
        got = spark.read.parquet(f"{tmp_path}/run/answers")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for i, e, a in asked:
        for x in told:
            if e is not None and a is not None and x[0] == e and x[4] is not None and x[5] is not None and a - timedelta(hours=5) <= x[5] <= a and x[4] <= a:
                want.setdefault((str(i), a, e, str(x[1])), []).append((x[4], -1 if x[3] is None else x[3], -1 if x[2] is None else 9 if x[2] != x[2] else x[2]))
    small = got.where("event_id in (1, 2, 3)").collect()
    assert len(small) == len(want) > 200
    for r in small:
        rows = want[str(r.request_id), r.as_of, r.event_id, str(r.market)]
        assert (r.quotes, r.observed, -1 if r.seq is None else r.seq, -1 if r.price is None else 9 if r.price != r.price else r.price) == (len(rows), *max(rows))
    # the tenth of a second asks; all quotes up to it within five hours are known
    big_one = got.where("event_id = 7").select(F.count("*"), F.count_if(F.col("seq") == F.least(F.floor(F.col("request_id") / 10), F.lit(n - 1))), F.sum("quotes")).first()
    per = [min(i // 10, n - 1) - max(0, -(-(i - 180_000) // 10)) + 1 for i in range(10 * n)]
    assert tuple(big_one) == (10 * n, 10 * n, sum(per))


def test_snapshots_of_a_stream_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, '{"id": 5, "start": 9, "books": []}')], "snapshot_id long, body string").write.parquet(f"{tmp_path}/raw")
    plan = streams.stream_snapshots(SimpleNamespace(readStream=spark.read), f"{tmp_path}/raw")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_candidates_of_registries_are_priced_once(spark, small):
    assert "l_orderkey" not in QUERIES["b1_evaluate_registered"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_singles_are_picked_without_making_combinations(spark, small):
    got = QUERIES["b5_allocate_portfolios"](spark, small)
    assert "leg_ids" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = portfolios.decisions(lambda n: view(spark, small, n)).where("kind = 'straight'").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pinball_losses_are_a_line_between_quantiles(spark):
    zs = [-9.0, -2.0537489106318225, -1.0, 0.0, 0.01, 2.0, 2.0537489106318225, 9.0]
    rows = spark.createDataFrame([(z * 3.0 + 1, 1.0, 3.0) for z in zs] + [(None, 1.0, 3.0)], "actual double, loc double, scale double")
    crps = rows.select("actual", dist.proper_scores(F.col("actual"), F.col("loc"), F.col("scale"))["crps"].alias("crps"))
    assert "aggregate(" not in crps._jdf.queryExecution().optimizedPlan().toString()
    qs = [(i / 50, NormalDist().inv_cdf(i / 50)) for i in range(1, 50)]
    for r in crps.collect():
        want = None if r.actual is None else 3.0 * 2 / 49 * sum(((r.actual - 1) / 3.0 - q) * (i - ((r.actual - 1) / 3.0 < q)) for i, q in qs)
        assert r.crps == (None if want is None else pytest.approx(want, abs=1e-12))


def test_offers_are_settled_without_a_pass_over_the_bins(spark):
    rnd = random.Random(4)
    hist = [(m, v, rnd.randrange(1, 9)) for m, step in ((1, 0.25), (2, 0.3)) for v in {k * step for k in range(-40, 60, 3)}]
    offers = [(i, rnd.choice([1, 2, 3]), rnd.randrange(-20, 20) / 2, rnd.choice([rnd.uniform(-20, 20), float(rnd.randrange(-9, 9)), 500.0, -500.0])) for i in range(300)]
    got = dist.settle_at(spark.createDataFrame(offers, "id long, market long, line double, center double"), spark.createDataFrame(hist, "market int, value double, n long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "Join" not in plan
    clip = lambda x: max(0.0, min(1.0, x))
    want = {}
    for i, m, line, center in offers:
        own = [(v, n) for k, v, n in hist if k == m]
        if own:
            all_n, y = sum(n for _, n in own), center - line
            win = sum(n * clip(y + v + (0.0 if line % 1 == 0 else 0.5)) for v, n in own) / all_n
            loss = sum(n * clip(-y - v) for v, n in own) / all_n if line % 1 == 0 else 1 - win
            want[i] = pytest.approx((win, 1 - win - loss, loss), abs=1e-12)
    assert {r.id: (r.win, r.push, r.loss) for r in got.collect()} == want


def test_scores_of_candidates_are_made_once(spark, small):
    plan = QUERIES["e15_distribution_candidates"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_scores_of_lattices_are_read_from_sums_of_those_that_differ(spark, monkeypatch):
    """corrected_crps() is discrete_crps() of corrected_lattice(), for rows alike, nulls and outcomes beyond the ends; no lattice is made for a row whose like has one."""
    rnd = random.Random(3)
    data = [(i, rnd.choice([None, 0.5, -4.0, 90.0, rnd.gauss(0, 30)]), rnd.choice([None, 0.25, 9.0, 12.0]), rnd.choice([None, float("nan"), -200.0, -80.0, 2.5, 3.0, 80.0, 80.5, 300.0])) for i in range(400)]
    rows = spark.createDataFrame(data, "game_id long, loc double, scale double, actual double")
    ratios = spark.createDataFrame([(k, 0.25 + (k % 7) / 2) for k in range(-80, 79)], "k int, ratio double")
    want = {r.game_id: r.crps for r in dist.discrete_crps(dist.corrected_lattice(rows, ratios), ["game_id"]).collect()}
    priced = dist.corrected_crps(rows, ratios, ["game_id"])
    got = {r.game_id: r.crps for r in priced.collect()}
    assert got == {k: x if x is None else pytest.approx(x, abs=1e-9) for k, x in want.items()} and None in got.values()
    plan = priced._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # these are interpreted, element by element
    with pytest.raises(Exception, match="a scale is 0"):
        dist.corrected_crps(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], rows.schema), ratios, ["game_id"]).collect()


def test_the_corrected_lattice_query_scores_without_a_lattice_per_row(spark, small):
    plan = QUERIES["d17_corrected_lattice"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "crps(" in plan and "aggregate(" not in plan
