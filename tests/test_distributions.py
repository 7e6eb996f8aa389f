"""Distribution tables against closed forms and plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from tidewater.operators import distributions as dist


def test_normal_cdf(spark):
    xs = [i / 7 for i in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", dist.normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in got) < 1e-7


HIST = [(-10.25, 3), (-3.0, 9), (-2.75, 4), (0.0, 8), (0.5, 7), (3.25, 9), (7.0, 6), (14.0, 2)]


def conditional(center, line):
    win = loss = 0.0
    for r, n in HIST:
        low = math.floor(center + r)
        for k, w in ((low, 1 - (center + r - low)), (low + 1, center + r - low)):
            win += n * w * (k > line)
            loss += n * w * (k < line)
    return win / (win + loss) if win + loss else 0.0, win, loss


def test_center_agrees_with_bisection(spark):
    cases = [(i, 1, line, p) for i, (line, p) in enumerate((line, p) for line in (-7.0, -3.5, 0.0, 2.5, 10.0) for p in (0.08, 0.31, 0.5, 0.74, 0.93))]
    h = spark.createDataFrame([(1, *x) for x in HIST], "market long, value double, n long")
    got = {r.id: r.center for r in dist.infer_center(spark.createDataFrame(cases, "id long, market long, line double, p double"), h).collect()}
    for i, _, line, p in cases:
        lo, hi = line - 40, line + 40
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if conditional(mid, line)[0] >= p else (mid, hi)
        assert got[i] == pytest.approx(hi, abs=1e-6)


def test_settlement_on_histogram(spark):
    h = spark.createDataFrame([(1, *x) for x in HIST], "market long, value double, n long")
    offers = spark.createDataFrame([(1, 1, 3.0, 2.3), (2, 1, 3.5, 2.3)], "id long, market long, line double, center double")
    got = {r.id: r for r in dist.settle_at(offers, h).collect()}
    all_ = sum(n for _, n in HIST)
    for i, line in ((1, 3.0), (2, 3.5)):
        _, win, loss = conditional(2.3, line)
        assert got[i].win == pytest.approx(win / all_) and got[i].loss == pytest.approx(loss / all_)
    assert got[2].push == pytest.approx(0) and got[1].push > 0


def plain_lattice(loc, scale, low=-80, high=80):
    cdf = lambda x: 0.5 * math.erfc((loc - x) / scale / math.sqrt(2))
    return [(1.0 if k == high else cdf(k + 0.5)) - (0.0 if k == low else cdf(k - 0.5)) for k in range(low, high + 1)]


def test_lattice_correction_equals_loops(spark):
    """Outcomes are rounded and those beyond the ends count there; ratios, corrected mass, score and key numbers against loops."""
    rows = [(i, (i % 23) - 11.0 + 0.3, 9.0 + i % 5, [95.0, -200.0, 2.5, float(i % 31 - 15)][i % 4]) for i in range(450)]
    frame = spark.createDataFrame(rows, "game_id long, loc double, scale double, actual double")
    expected, observed = [0.0] * 161, [0] * 161
    for _, loc, scale, actual in rows:
        expected = [a + b for a, b in zip(expected, plain_lattice(loc, scale))]
        observed[min(80, max(-80, round(actual))) + 80] += 1
    ratio = [min(4.0, max(0.25, (o + 200 * e / 450) / max(e + 200 * e / 450, 1e-12))) for o, e in zip(observed, expected)]
    got = {r.k: r for r in dist.lattice_correction(frame).collect()}
    assert [got[k].observed for k in range(-80, 81)] == observed and observed[-1] > 100 and observed[0] > 100
    assert [got[k].ratio for k in range(-80, 81)] == pytest.approx(ratio, abs=1e-5)
    corrected = dist.corrected_lattice(frame, dist.lattice_correction(frame))
    scores = {r.game_id: r.crps for r in dist.discrete_crps(corrected, ["game_id"]).collect()}
    modelled = 0.0
    for i, loc, scale, actual in rows:
        mass = [m * r for m, r in zip(plain_lattice(loc, scale), ratio)]
        mass = [m / sum(mass) for m in mass]
        modelled += mass[83] + mass[77]
        run, crps = 0.0, 0.0
        for k, m in zip(range(-80, 81), mass):
            run += m
            crps += (run - (actual <= k)) ** 2
        assert scores[i] == pytest.approx(crps, abs=1e-4)
    three = dist.key_number_mass(corrected, [3]).first()
    assert three.modelled == pytest.approx(modelled / 900, abs=1e-6) and three.observed == pytest.approx(sum(abs(r[3]) == 3 for r in rows) / 900)
    few = dist.lattice_correction(frame.limit(399))
    assert {r.ratio for r in few.collect()} == {1.0}


@pytest.mark.parametrize("heavy", [True, False])
def test_student_t_agrees_with_a_loop(spark, heavy):
    values = [math.tan((i + 0.5) / 2000 * 3.0 - 1.5) if heavy else i / 500 - 2 for i in range(2000)]
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))

    def nll(df):
        scale = sd * math.sqrt((df - 2) / df)
        c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale)
        return -sum(c - (df + 1) / 2 * math.log1p(((x - mean) / scale) ** 2 / df) for x in values) / len(values)

    want = min((nll(df), df) for df in (3, 5, 8, 15, 30))
    got = dist.fit_student_t(spark.createDataFrame([(1, x) for x in values], "g long, r double"), ["g"], "r").first()
    assert got.df == want[1] and got.nll == pytest.approx(want[0])


def test_push_only_on_whole_lines(spark):
    win, push, loss = dist.settlement(F.lit(1.0), F.lit(10.0), F.col("line"))
    got = spark.createDataFrame([(3.0,), (3.5,)], "line double").select(win.alias("w"), push.alias("p"), loss.alias("l")).collect()
    assert got[0].p > 0 and got[1].p == 0 and all(r.w + r.p + r.l == pytest.approx(1) for r in got)


def test_scores_match_the_closed_form(spark):
    s = dist.proper_scores(F.lit(5.0), F.lit(2.0), F.lit(4.0))
    got = spark.range(1).select(*[c.alias(k) for k, c in s.items()]).first()
    z = 0.75
    phi, cdf = math.exp(-z * z / 2) / math.sqrt(2 * math.pi), 0.5 * math.erfc(-z / math.sqrt(2))
    assert got.crps == pytest.approx(4 * (z * (2 * cdf - 1) + 2 * phi - 1 / math.sqrt(math.pi)), rel=0.03)
    assert got.nll == pytest.approx(math.log(4) + z * z / 2 + 0.5 * math.log(2 * math.pi)) and got.in_80 and not got.in_50
