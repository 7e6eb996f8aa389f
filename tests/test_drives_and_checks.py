"""Drives from nested documents; queries that had run-only checks against plain code."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import distributions, evaluate, models
from tidewater.sources import snapshots

DRIVES = """{"gameId": 7, "drives": [
    {"id": "7-1", "driveNumber": 1, "offense": "Home", "defense": "Away", "plays": 5, "yards": -3, "startOffenseScore": 3, "endOffenseScore": 10, "driveResult": "TD", "scoring": true, "extra": {"a": [1]}},
    {"id": 72, "offense": "Home", "defense": "Elsewhere", "plays": "many", "startOffenseScore": null, "endOffenseScore": 10},
    5, null, {"plays": 3}, {"id": "7-6", "startOffenseScore": 7, "endOffenseScore": "7", "offense": "Away", "defense": "Home"}]}"""


def test_drives_of_nested_documents(spark, tmp_path):
    bodies = [(1, DRIVES), (2, '{"gameId": 99, "drives": []}'), (3, '{"gameId": 8}'), (4, "{nothing"), (5, None), (6, '{"gameId": 8, "drives": []}'), (7, '{"gameId": 8, "drives": {"id": 1}}'), (8, "[1, 2]"), (9, '{"gameId": "8", "drives": [{"id": "8-1"}]}')]
    snapshots.land_variants(spark.createDataFrame(bodies, "document_id long, body string"), str(tmp_path / "docs"))
    games = spark.createDataFrame([(7, 70, 71, "Home", "Away"), (8, 80, 81, "A", "B")], "game_id long, home long, away long, home_name string, away_name string")
    good, warned = snapshots.flatten_drive_documents(spark.read.parquet(str(tmp_path / "docs")), games)
    rows = {r.drive_id: r for r in good.collect()}
    assert set(rows) == {"7-1", "72", "7-6", "8-1"}
    first, second, last = rows["7-1"], rows["72"], rows["7-6"]
    assert (first.game_id, first.drive_number, first.offense, first.defense, first.plays, first.yards, first.points, first.drive_result, first.scoring, first.identity_resolved) == (7, 1, 70, 71, 5, -3, 7, "TD", True, True)
    assert (second.offense, second.defense, second.plays, second.points, second.identity_resolved) == (70, None, None, None, False)
    assert (last.offense, last.points, last.identity_resolved) == (71, 0, True)
    assert {tuple(r) for r in warned.collect()} == {(1, "malformed_drive", "2"), (1, "malformed_drive", "3"), (1, "drive_without_id", "4"), (2, "unknown_game", ""), (3, "malformed_drives", ""), (4, "malformed_document", ""), (5, "malformed_document", ""), (7, "malformed_drives", ""), (8, "malformed_document", "")}


def test_fingerprint_does_not_see_order_but_every_change(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 == 0 else i / 3) for i in range(200)]
    of = lambda some, schema="a long, b string, c double": tuple(snapshots.dataset_fingerprint(spark.createDataFrame(some, schema).repartition(3)).first())
    base, mixed = of(rows), rows[:]
    random.Random(1).shuffle(mixed)
    assert of(mixed) == base
    for changed in (rows[1:], [*rows, rows[0]], [(0, "v0", 0.0), *rows[1:]], [(1, "v0", None), *rows[1:]], [*rows[:-2], (198, rows[199][1], rows[198][2]), (199, rows[198][1], rows[199][2])]):
        assert of(changed)[:3] != base[:3]
    assert of(rows, "a long, b string, d double")[3] != base[3]


def test_bootstrap_equals_a_loop_with_the_same_draws(spark):
    rnd = random.Random(2)
    rows = [(2000 + i % 6, rnd.random(), rnd.random()) for i in range(300)]
    got = evaluate.block_bootstrap(spark.createDataFrame(rows, "season long, error_a double, error_b double"), "season", 400).first()
    sums = np.zeros((6, 2))
    for s, a, b in rows:
        sums[s - 2000] += (a - b, 1)
    draws = spark.range(1, 401).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("draw", F.pmod(F.xxhash64("draw", "i", F.lit(7)), F.lit(6)).alias("pick")).collect()
    total = np.zeros((401, 2))
    for r in draws:
        total[r.draw] += sums[r.pick]
    means = total[1:, 0] / total[1:, 1]
    assert got.difference == pytest.approx(sums[:, 0].sum() / 300) and got.draws == 400 and got.blocks == 6
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_a_dealt_column_keeps_its_values_and_other_columns(spark):
    rows = [(i, rep, float(i * 10 + rep), float(i)) for i in range(300) for rep in (1, 2)]
    df = spark.createDataFrame(rows, "game_id long, repeat int, u double, v double")
    got = models.shuffled(df, "u", 7).select("game_id", "repeat", "u", "v").collect()
    for rep in (1, 2):
        own = [r for r in got if r.repeat == rep]
        assert Counter(r.u for r in own) == Counter(x[2] for x in rows if x[1] == rep) and {(r.game_id, r.v) for r in own} == {(x[0], x[3]) for x in rows}
        assert sum(r.u == r.game_id * 10 + rep for r in own) < 20


def test_permutation_importance_finds_the_feature_that_matters(spark):
    from pyspark.ml.regression import LinearRegression

    rnd = random.Random(4)
    rows = [(i, 1998 + i % 3, (u := rnd.gauss(0, 1)), rnd.gauss(0, 1), 5 * u + rnd.gauss(0, 0.1)) for i in range(600)]
    df = spark.createDataFrame(rows, "game_id long, season int, u double, v double, actual double")
    got = {r.feature: r.importance for r in models.permutation_importance(df, ["u", "v"], 2000, LinearRegression(featuresCol="_x", labelCol="actual")).collect()}
    # a shuffled u errs by 5 |u - u'|, whose mean is 5 * 2 / sqrt(pi)
    assert got["u"] == pytest.approx(10 / np.sqrt(np.pi), rel=0.15) and abs(got["v"]) < 0.02


def test_skew_normal_equals_a_loop(spark):
    from math import erf, log, pi, sqrt

    rnd = random.Random(6)
    rows = [("right", abs(rnd.gauss(0, 4)) + rnd.gauss(0, 1)) for _ in range(400)] + [("even", rnd.gauss(1, 3)) for _ in range(400)] + [("left", -abs(rnd.gauss(0, 4)) + rnd.gauss(0, 1)) for _ in range(300)] + [("flat", 2.0)] * 3
    got = {r.g: r for r in distributions.fit_skew_normal(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    for g, r in got.items():
        x = np.array([v for k, v in rows if k == g])
        mean, sd, best = x.mean(), max(0.25, x.std()), None
        for a in range(-4, 5):
            d = a / sqrt(1 + a * a)
            scale = sd / sqrt(1 - 2 * d * d / pi)
            z = (x - (mean - scale * d * sqrt(2 / pi))) / scale
            nll = np.mean([-(log(2) - log(scale) - v * v / 2 - 0.5 * log(2 * pi) + log(max(1e-300, 0.5 * (1 + erf(a * v / sqrt(2)))))) for v in z])
            best = min(best or (nll, a, scale), (nll, a, scale))
        assert (r.nll, r.scale) == pytest.approx((best[0], best[2]), abs=1e-5) and r.shape == best[1] and r.mean == pytest.approx(mean)
    assert got["right"].shape > 0 > got["left"].shape
