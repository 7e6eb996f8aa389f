"""Boosted trees of all folds and budgets against a plain loop over rows."""

import math
import random

import pytest

from tidewater.operators import trees
from tidewater.plans import boosted

SCHEMA = "game_id long, season int, actual double, a double, b double, c double"
SMALL = [trees.Budget("three", 3, 4, 0.3, 5, 1.0), trees.Budget("five", 5, 3, 0.2, 3, 2.0), trees.Budget("seven", 7, 2, 0.5, 2, 0.5)]
SEASONS = [1997, 1998, 1999]


def rows(n=500, seed=1):
    rnd, out = random.Random(seed), []
    for i in range(n):
        a, b, c = rnd.gauss(0, 1), float(rnd.randrange(4)), rnd.choice([None, float("nan"), rnd.random()])
        y = 3 * a + (5 if b > 1 else -5) * (a > 0) + (2 if c is None else 0) + rnd.gauss(0, 1)
        out.append((i, 1995 + i % 5, None if i % 41 == 0 else y, a, b, c))
    return out


def fine(x):
    return x is not None and math.isfinite(x)


def loop(found, edges, seasons, budgets):
    """(game, season, budget) -> (rows trained on, prediction): one row, one node, one split at a time."""
    cell = lambda x, e: 0 if not fine(x) else 1 + sum(v < x for v in e)
    bins = {r[0]: [cell(x, e) for x, e in zip(r[3:], edges)] for r in found}
    out = {}
    for fold in seasons:
        train = [r for r in found if r[1] < fold and r[2] is not None]
        for budget in budgets:
            base = sum(r[2] for r in train) / len(train)
            score = {r[0]: base for r in found}
            for _ in range(budget.rounds):

                def tree(own, asked, depth):
                    g, n = sum(r[2] - score[r[0]] for r in own), len(own)
                    value, best = budget.rate * g / (n + budget.l2), None
                    if depth < budget.depth:
                        for f in range(3):
                            for at in sorted({bins[r[0]][f] for r in own}):
                                left = [r for r in own if bins[r[0]][f] <= at]
                                ln, rn = len(left), n - len(left)
                                if ln < budget.smallest or rn < budget.smallest:
                                    continue
                                lg = sum(r[2] - score[r[0]] for r in left)
                                gain = round(lg * lg / (ln + budget.l2) + (g - lg) ** 2 / (rn + budget.l2) - g * g / (n + budget.l2), 9)
                                if gain > 0 and (best is None or gain > best[0]):
                                    best = gain, f, at
                    if best is None:
                        return {r[0]: value for r in asked}
                    _, f, at = best
                    side = lambda rs, left: [r for r in rs if (bins[r[0]][f] <= at) == left]
                    return tree(side(own, True), side(asked, True), depth + 1) | tree(side(own, False), side(asked, False), depth + 1)

                step = tree(train, found, 0)
                score = {k: v + step[k] for k, v in score.items()}
            out.update({(r[0], fold, budget.name): (len(train), score[r[0]]) for r in found if r[1] == fold})
    return out


@pytest.mark.parametrize("write", [2, 100])
def test_trees_equal_a_loop(spark, tmp_path, monkeypatch, write):
    monkeypatch.setattr(trees, "WRITE", write)
    found = rows()
    df = spark.createDataFrame(found, SCHEMA).repartition(3)
    edges = trees.edges(df, ["a", "b", "c"], 1997)
    got = trees.boosted_folds(df, ["a", "b", "c"], SEASONS, str(tmp_path), SMALL).collect()
    want = loop(found, edges, SEASONS, SMALL)
    assert len(got) == len(want)
    for r in got:
        n, prediction = want[r.game_id, r.season, r.budget]
        assert r.trained_on == n and r.prediction == pytest.approx(prediction, abs=1e-9)
    error = lambda name: sum((r.actual - r.prediction) ** 2 for r in got if r.budget == name and r.actual is not None)
    mean = sum(r[2] for r in found if r[2] is not None) / sum(r[2] is not None for r in found)
    assert all(error(b.name) < 0.8 * sum((r[2] - mean) ** 2 for r in found if r[2] is not None and r[1] in SEASONS) for b in SMALL)


def test_later_outcomes_and_values_change_no_earlier_fold(spark, tmp_path):
    found = rows(200)
    hurt = [(*r[:2], r[2] and r[2] + 1000, r[3] * 50, *r[4:]) if r[1] >= 1998 else r for r in found]
    at = [{r.game_id: r.prediction for r in trees.boosted_folds(spark.createDataFrame(x, SCHEMA), ["a", "b"], [1997], str(tmp_path), SMALL[:1]).collect()} for x in (found, hurt)]
    assert at[0] == at[1] and len(at[0]) == 40


def test_edges_of_the_input(spark, tmp_path):
    """No features, no rows, no earlier season, features without values, and more rounds than there is anything to split."""
    df = spark.createDataFrame(rows(60), SCHEMA)
    plain = trees.boosted_folds(df, [], [1997], str(tmp_path), SMALL[:1]).collect()
    assert len({r.prediction for r in plain}) == 1 and len(plain) == 12
    assert trees.boosted_folds(df.limit(0), ["a"], [1997], str(tmp_path), SMALL).count() == 0
    assert trees.boosted_folds(df, ["a"], [1990, 1995], str(tmp_path), SMALL).count() == 0
    nothing = spark.createDataFrame([(*r[:3], None, 1.0, None) for r in rows(60)], SCHEMA)
    flat = trees.boosted_folds(nothing, ["a", "b", "c"], [1997], str(tmp_path), SMALL[:1]).collect()
    assert len({round(r.prediction, 9) for r in flat}) == 1


def test_trees_on_the_market(spark, tmp_path):
    found = [(*r, 2 * r[3] + 1) for r in rows(300)]
    df = spark.createDataFrame(found, SCHEMA + ", m double")
    got = trees.market_trees(df, ["a", "b"], "m", [1998, 1999], 1996, str(tmp_path), SMALL[0]).collect()
    own = {r[0]: r for r in found}
    assert {(r.variant, r.season) for r in got} == {(v, s) for v in ("residual", "market_as_feature") for s in (1998, 1999)}
    edges = trees.edges(df.where("season >= 1996"), ["a", "b", "c"], 1998)
    known = [(*r[:2], None if r[2] is None else r[2] - r[6], r[3], r[4], None) for r in found if r[1] >= 1996]
    want = loop(known, [*edges[:2], []], [1998, 1999], SMALL[:1])
    for r in got:
        if r.variant == "residual":
            assert r.prediction == pytest.approx(want[r.game_id, r.season, "three"][1] + own[r.game_id][6], abs=1e-9) and r.actual == own[r.game_id][2]


def test_rows_with_the_same_bins_are_counted_as_one(spark, tmp_path, monkeypatch):
    """Ten copies of every row: the passes read no more rows than for one, and the trees are those of a loop over all."""
    found = [(i, s, None if y is None else y + k, a, b, c) for k in range(10) for i, s, y, a, b, c in rows(120)]
    found = [(n, *r[1:]) for n, r in enumerate(found)]
    df = spark.createDataFrame(found, SCHEMA)
    seen, own = [], trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda x, *more: (seen.append(x.count()), own(x, *more))[1])
    got = trees.boosted_folds(df, ["a", "b", "c"], SEASONS, str(tmp_path), SMALL)
    assert max(seen) <= 120
    at = trees.edges(df, ["a", "b", "c"], min(SEASONS))
    want = loop(found, at, SEASONS, SMALL)
    assert {(r.game_id, r.season, r.budget): r.trained_on for r in got.collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.game_id, r.season, r.budget): r.prediction for r in got.collect()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-6)


@pytest.mark.parametrize("alone", [0, 10**6])
def test_passes_over_many_tasks_and_groups_of_models_grow_the_same_trees(spark, tmp_path, monkeypatch, alone):
    """Distinct rows in several tasks, whose counts are summed, or in one group per model."""
    monkeypatch.setattr(trees, "ALONE", alone)
    monkeypatch.setattr(trees, "WRITE", 3)
    monkeypatch.setattr(trees, "CHUNK", 50)
    parts, own = [], trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda x, *more: (parts.append(x.rdd.getNumPartitions()), own(x, *more))[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = rows()
        df = spark.createDataFrame(found, SCHEMA).repartition(3)
        edges = trees.edges(df, ["a", "b", "c"], 1997)
        got = trees.boosted_folds(df, ["a", "b", "c"], SEASONS, str(tmp_path), SMALL).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts[0] > 1 and (len(parts) > 10) == (alone == 0)
    want = loop(found, edges, SEASONS, SMALL)
    assert {(r.game_id, r.season, r.budget): (r.trained_on, r.prediction) for r in got} == {k: (n, pytest.approx(x, abs=1e-9)) for k, (n, x) in want.items()}


def test_the_queries_grow_every_tree_of_their_budgets(spark, small, monkeypatch):
    grown, own = [], trees.boosted_models
    monkeypatch.setattr(trees, "boosted_models", lambda *a: (grown.append(own(*a)), grown[-1])[1])
    assert boosted.QUERIES["m6_tree_budgets"](spark, small).count()
    (models,) = grown
    assert {(m.budget.name, len(m.trees)) for m in models} == {("conservative", 500), ("balanced", 300), ("flexible", 200)} and len(models) == 15


def test_the_market_queries_grow_every_tree_of_their_budget(spark, small, monkeypatch):
    grown, own = [], trees.boosted_models
    monkeypatch.setattr(trees, "boosted_models", lambda *a: (grown.append(own(*a)), grown[-1])[1])
    assert boosted.QUERIES["m9_market_trees"](spark, small).count()
    assert len(grown) == 2 and [{(m.budget.name, len(m.trees)) for m in models} for models in grown] == [{("conservative", 500)}] * 2 and [len(models) for models in grown] == [4, 4]
