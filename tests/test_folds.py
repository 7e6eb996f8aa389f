"""Linear folds against a dense loop over the same rows, and against the pipeline of Spark's library."""

import numpy as np
import pytest

from tidewater.operators import folds, models

FEATURES = ["u", "v", "w"]
SEASONS = [2001, 2002, 2003]


def table(spark, n=400, hole=0.2, dead=False):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        u, v, w = rng.normal(3, 2), rng.normal(-1, 0.5), float(rng.integers(0, 3))
        y = 2 * u - 3 * v + w + rng.normal()
        rows.append((i, 1998 + i % 6, y, None if rng.random() < hole else u, float("nan") if rng.random() < hole else v, 7.0 if dead else w))
    return rows, spark.createDataFrame(rows, "game_id long, season long, actual double, u double, v double, w double")


def plain(rows, season, cols, alpha, mix):
    """Imputation by the lower median, marks, scaling and descent, row by row."""
    train, test = [r for r in rows if r[1] < season], [r for r in rows if r[1] == season]

    def matrix(part):
        out = []
        for r in part:
            x = [r[3 + FEATURES.index(c)] for c in cols]
            gone = [a is None or a != a for a in x]
            out.append([m if g else a for a, g, m in zip(x, gone, middle, strict=True)] + [float(g) for g in gone])
        return np.array(out)

    middle = []
    for c in cols:
        have = sorted(a for a in (r[3 + FEATURES.index(c)] for r in train) if a is not None and a == a)
        middle.append(have[(len(have) + 1) // 2 - 1] if have else 0.0)
    x, y = matrix(train), np.array([r[2] for r in train])
    on = x.std(0) > 1e-9
    mean, sd = x.mean(0)[on], x.std(0)[on]
    z, d = (x[:, on] - mean) / sd, y - y.mean()
    if mix is None:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ d)
    else:
        w = np.zeros(z.shape[1])
        for _ in range(3000):
            for k in range(len(w)):
                pull = z[:, k] @ (d - z @ w + z[:, k] * w[k]) / len(y)
                w[k] = np.sign(pull) * max(0, abs(pull) - alpha * mix) / (1 + alpha * (1 - mix))
    return dict(zip([r[0] for r in test], (matrix(test)[:, on] - mean) / sd @ w + y.mean(), strict=True))


@pytest.mark.parametrize("hole,dead", [(0.2, False), (0.0, True), (1.0, False)])
def test_folds_equal_a_dense_fit(spark, hole, dead):
    rows, df = table(spark, hole=hole, dead=dead)
    families, grid = {"all": FEATURES, "u": ["u"], "vw": ["v", "w"]}, [(1.0, None), (50.0, None), (0.1, 0.5)]
    got = folds.linear_folds(df, families, SEASONS, grid).collect()
    assert len(got) == sum(r[1] in SEASONS for r in rows) * len(families) * len(grid)
    for name, cols in families.items():
        for alpha, mix in grid:
            for s in SEASONS:
                want = plain(rows, s, cols, alpha, mix)
                mine = {r.game_id: r.prediction for r in got if (r.family, r.alpha, r.mix, r.season) == (name, alpha, mix, s)}
                assert mine == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_folds_equal_the_library_pipeline(spark):
    _, df = table(spark, hole=0.0)
    want = {r.game_id: r.prediction for r in models.ridge_fold(df, FEATURES, 2002, 10.0).collect()}
    n = df.where("season < 2002").count()
    same = 10.0 * n / (n - 1)  # the library scales by the sample's deviation, which is a penalty of n / (n - 1) here
    got = {r.game_id: r.prediction for r in folds.linear_folds(df, {"all": FEATURES}, [2002], [(same, None)]).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_folds_without_training_rows_or_targets(spark):
    rows, df = table(spark, n=60)
    empty = df.limit(0)
    assert folds.linear_folds(empty, {"all": FEATURES}, SEASONS, [(1.0, None)]).count() == 0
    assert folds.linear_folds(df, {"all": FEATURES}, [1998], [(1.0, None)]).count() == 0
    late = df.selectExpr("game_id", "season", "if(season = 2003, null, actual) actual", "u", "v", "w")
    got = folds.linear_folds(late, {"all": FEATURES}, SEASONS, [(1.0, None)]).where("season = 2003").collect()
    assert len(got) == sum(r[1] == 2003 for r in rows) and all(r.prediction is not None and r.actual is None for r in got)


def test_best_penalty_first_and_ties(spark):
    x = spark.createDataFrame([("f", 1.0, None, 2.0, 1.0), ("f", 2.0, None, 1.5, 1.0), ("f", 3.0, 0.5, 1.5, 1.0)], "family string, alpha double, mix double, prediction double, actual double")
    got = {r.alpha: (r.place, r.mae) for r in folds.tune_folds(x).collect()}
    assert got[1.0] == (3, 1.0) and sorted(p for p, _ in got.values()) == [1, 2, 3]


def test_market_and_rating_forms(spark):
    rows, df = table(spark)
    held = df.selectExpr("*", "actual * 0.5 + game_id % 3 AS market", "actual - game_id % 40 AS rating")
    m = folds.market_folds(held, ["u"], "market", SEASONS, 1999)
    assert {r.variant: r["count"] for r in m.groupBy("variant").count().collect()} == {"residual": sum(r[1] in SEASONS for r in rows), "market_as_feature": sum(r[1] in SEASONS for r in rows)}
    r = folds.adjusted_ratings(held, ["u"], SEASONS).join(held.select("game_id", "rating"), "game_id").collect()
    assert all(abs(x.prediction - x.rating) <= 7.5 + 1e-9 for x in r) and any(abs(x.prediction - x.rating) > 7.4 for x in r)
