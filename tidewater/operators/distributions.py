"""Predictive distributions as tables and column arithmetic.

Residual histograms are reference tables of a few hundred bins; grids and lattices have a fixed number of points.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Coefficients of a published rational approximation of erfc, lowest power first; relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Offsets of the centre from the line that are searched, in quarter points.
REACH, STEP = 40, 0.25


def _tail(z: Column, t: Column) -> Column:
    """Mass beyond sqrt(2) z of a standard normal, where t = 1 / (1 + z / 2)."""
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    return t * F.exp(power - z * z) / 2


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    tail = _tail(z, 1 / (1 + z / 2))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def win_loss(y: Column, half: Column) -> tuple[Column, Column]:
    """Win and loss share of a mass that stands y beyond the line, split between the two integers around it; half: a line between integers."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    win = F.when(half, clip(y + 0.5)).otherwise(clip(y))
    return win, F.when(half, 1 - clip(y + 0.5)).otherwise(clip(-y))


def brackets(histogram: DataFrame) -> DataFrame:
    """Per market and kind of line: ordered array of (offset, win, resolved, q) of a centre that stands offset beyond the line.

    Win and resolved mass are linear in the offset between quarter points, as all residuals are multiples of them. 321 entries per key.
    """
    n = int(REACH / STEP)
    total = histogram.groupBy("market").agg(F.sum("n").alias("_all"))
    x = histogram.join(total, "market").select("market", "value", (F.col("n") / F.col("_all")).alias("w"), F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("i"))
    x = x.withColumn("half", F.explode(F.array(F.lit(False), F.lit(True))))
    win, loss = win_loss(F.col("i") * STEP + F.col("value"), F.col("half"))
    at = x.groupBy("market", "half", "i").agg(F.sum(win * F.col("w")).alias("win"), F.sum((win + loss) * F.col("w")).alias("s"))
    entry = F.struct("i", "win", "s", F.coalesce(F.try_divide("win", "s"), F.lit(0.0)).alias("q"))
    return at.groupBy("market", "half").agg(F.array_sort(F.collect_list(entry)).alias("b"))


def infer_center(quotes: DataFrame, histogram: DataFrame) -> DataFrame:
    """quotes (id, market, line, p) with the lowest centre whose conditional win probability against the line is p; kept within 40 points of it."""
    half = F.col("line") != F.floor("line")
    x = quotes.withColumn("half", half).join(brackets(histogram), ["market", "half"])
    at = F.coalesce(F.get(F.filter("b", lambda e: e["q"] >= F.col("p")), F.lit(0))["i"], F.lit(int(REACH / STEP)))
    x = x.withColumn("_at", (at + int(REACH / STEP)).cast("int"))
    lo, hi = F.get("b", F.greatest(F.col("_at") - 1, F.lit(0))), F.get("b", F.col("_at"))
    x = x.withColumn("_lo", lo).withColumn("_hi", hi)
    dw, ds = F.col("_hi.win") - F.col("_lo.win"), F.col("_hi.s") - F.col("_lo.s")
    t = F.coalesce(F.try_divide(F.col("p") * F.col("_lo.s") - F.col("_lo.win"), dw - F.col("p") * ds), F.lit(0.0))
    center = F.col("line") + STEP * (F.col("_lo.i") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    return x.withColumn("center", center).drop("half", "b", "_at", "_lo", "_hi")


def shares(histogram: DataFrame) -> DataFrame:
    """(market, _h): each market's histogram (market, value, n) as one array of values and their shares, by value."""
    h = histogram.groupBy("market").agg(F.sum("n").alias("_all"), F.sort_array(F.collect_list(F.struct("value", "n"))).alias("_bins"))
    return h.select("market", F.transform("_bins", lambda x: F.struct(x["value"].alias("value"), (x["n"] / F.col("_all")).alias("w"))).alias("_h"))


def settle_at(offers: DataFrame, histogram: DataFrame) -> DataFrame:
    """offers (id, market, line, center) with win, push, loss mass over the market's histogram; markets without one are left out.

    Each mass is split between the two integers around it, see win_loss(); on a line between integers nothing is a push. The driver reads
    the histograms, some hundred bins per market. Sums of the ordered bins are kept, so an offer costs two searches, not a pass over the bins.
    """
    bins = {}
    for r in shares(histogram).where("market is not null").collect():
        v, w = (np.array([x[k] for x in r["_h"] if x["value"] is not None], dtype=float) for k in ("value", "w"))
        bins[r["market"]] = v, np.append(0.0, np.cumsum(w)), np.append(0.0, np.cumsum(v * w))

    def above(off: np.ndarray, v: np.ndarray, w: np.ndarray, vw: np.ndarray) -> np.ndarray:
        """Sum of w * clip(off + v, 0, 1)."""
        low, high = np.searchsorted(v, -off, "right"), np.searchsorted(v, 1 - off, "left")
        return vw[high] - vw[low] + off * (w[high] - w[low]) + w[-1] - w[high]

    @F.pandas_udf("struct<win: double, loss: double>")
    def settled(market: pd.Series, off: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = np.full((len(off), 2), np.nan)
        for m in market.unique():
            at = np.flatnonzero((market == m) & off.notna())
            x, (v, w, vw) = off.to_numpy(float)[at], bins[m]
            out[at, 0] = above(x, v, w, vw)
            mirrored = -v[::-1], np.append(0.0, np.cumsum(np.diff(w)[::-1])), np.append(0.0, np.cumsum(-np.diff(vw)[::-1]))
            out[at, 1] = np.where(whole.to_numpy(bool)[at], above(-x, *mirrored), 1 - out[at, 0])
        return pd.DataFrame(out, columns=["win", "loss"])

    whole = F.col("line") == F.floor("line")
    got = offers.where(F.col("market").isin(list(bins)) if bins else F.lit(False))
    got = got.withColumn("_s", settled("market", F.col("center") - F.col("line") + F.when(whole, 0.0).otherwise(0.5), F.coalesce(whole, F.lit(False))))
    return got.select(*offers.columns, "_s.win", "_s.loss").withColumn("push", 1 - F.col("win") - F.col("loss"))


def fit_student_t(rows: DataFrame, by: list[str], value: str, degrees=(3, 5, 8, 15, 30)) -> DataFrame:
    """Degrees of freedom with the least mean negative log likelihood, scale from the population deviation."""
    base = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.greatest(F.lit(0.25), F.stddev_pop(value)).alias("sd"))
    choice = F.explode(F.array(*[F.struct(F.lit(d).alias("df"), F.lit(math.sqrt((d - 2) / d)).alias("k"), F.lit(math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi)).alias("c")) for d in degrees]))
    x = rows.join(base, by).withColumn("_d", choice)
    scale = F.col("sd") * F.col("_d.k")
    z = (F.col(value) - F.col("mean")) / scale
    nll = -(F.col("_d.c") - F.ln(scale) - (F.col("_d.df") + 1) / 2 * F.log1p(z * z / F.col("_d.df")))
    each = x.groupBy(*by, F.col("_d.df").alias("df"), "mean", (F.col("sd") * F.col("_d.k")).alias("scale")).agg(F.avg(nll).alias("nll"))
    return each.groupBy(*by).agg(F.min(F.struct("nll", "df", "mean", "scale")).alias("b")).select(*by, "b.*")


def fit_skew_normal(rows: DataFrame, by: list[str], value: str, shapes=(-4, -3, -2, -1, 0, 1, 2, 3, 4)) -> DataFrame:
    """Shape with the least mean negative log likelihood, location and scale matched to the moments."""
    base = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.greatest(F.lit(0.25), F.stddev_pop(value)).alias("sd"))
    delta = {a: a / math.sqrt(1 + a * a) for a in shapes}
    choice = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("shape"), F.lit(delta[a] * math.sqrt(2 / math.pi)).alias("m"), F.lit(math.sqrt(1 - 2 * delta[a] ** 2 / math.pi)).alias("k")) for a in shapes]))
    x = rows.join(base, by).withColumn("_d", choice)
    scale = F.col("sd") / F.col("_d.k")
    z = (F.col(value) - (F.col("mean") - scale * F.col("_d.m"))) / scale
    nll = -(math.log(2) - F.ln(scale) - z * z / 2 - 0.5 * math.log(2 * math.pi) + F.ln(F.greatest(F.lit(1e-300), normal_cdf(F.col("_d.shape") * z))))
    each = x.groupBy(*by, F.col("_d.shape").alias("shape"), "mean", scale.alias("scale")).agg(F.avg(nll).alias("nll"))
    return each.groupBy(*by).agg(F.min(F.struct("nll", "shape", "mean", "scale")).alias("b")).select(*by, "b.*")


def fit_kernel_grid(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quarter-point histogram smoothed by a Gaussian of bandwidth max(0.35, 1.06 sd n^-0.2): mass and distribution function per grid point."""
    h = F.greatest(F.lit(0.35), 1.06 * F.stddev_pop(value) * F.pow(F.count(value), F.lit(-0.2)))
    base = rows.groupBy(*by).agg(h.alias("h"))
    bins = rows.groupBy(*by, F.floor(F.col(value) * 4 + 0.5).alias("k")).agg(F.count("*").alias("n")).join(base, by)
    reach = F.ceil(F.col("h") * 16).cast("int")
    spread = bins.withColumn("o", F.explode(F.sequence(-reach, reach)))
    weight = F.col("n") * F.exp(-F.pow(F.col("o") / 4 / F.col("h"), F.lit(2)) / 2)
    grid = spread.groupBy(*by, (F.col("k") + F.col("o")).alias("k")).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    run = w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select(*by, (F.col("k") / 4).alias("x"), (F.col("w") / F.sum("w").over(w)).alias("mass"), (F.sum("w").over(run) / F.sum("w").over(w)).alias("cdf"))


def expanding_fit(rows: DataFrame, value: str, first: int, last: int, least: int = 400) -> DataFrame:
    """Normal fit for every season from first to last on earlier seasons only, where these have enough rows."""
    x = rows.where(F.col("season") < last).withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(first), F.col("season") + 1).cast("int"), F.lit(last))))
    return x.groupBy("fold").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.greatest(F.lit(0.25), F.stddev_pop(value)).alias("sd")).where(F.col("n") >= least)


def settlement(loc: Column, scale: Column, line: Column) -> tuple[Column, Column, Column]:
    """win, push, loss of a Normal outcome above a line: whole lines have push mass, half lines none."""
    at = lambda x: normal_cdf((x - loc) / scale)
    whole = line == F.floor(line)
    low, high = F.when(whole, at(line - 0.5)).otherwise(at(line)), F.when(whole, at(line + 0.5)).otherwise(at(line))
    return 1 - high, high - low, low


#: Central intervals that are scored, in per cent.
LEVELS = (50, 80, 90, 95)


def proper_scores(actual: Column, loc: Column, scale: Column) -> dict[str, Column]:
    """Negative log likelihood, CRPS by pinball losses of 49 quantiles, PIT, and cover of four central intervals."""
    z = (actual - loc) / scale
    qs = [NormalDist().inv_cdf(i / 50) for i in range(1, 50)]
    rise, fall = math.fsum(i / 50 for i in range(1, 50)), math.fsum(q * i / 50 for i, q in enumerate(qs, 1))

    def pinball(z: Column, low: int, high: int) -> Column:
        """Sum of (z - q) * (i / 50 - (z < q)) where z lies from quantile `low` up to quantile `high`: a line in z, found by halving."""
        if low == high:
            return (rise - (len(qs) - low)) * z - F.lit(fall - math.fsum(qs[low:]))
        mid = (low + high) // 2
        return F.when(z < qs[mid], pinball(z, low, mid)).otherwise(pinball(z, mid + 1, high))

    out = {"nll": F.ln(scale) + z * z / 2 + 0.5 * math.log(2 * math.pi), "crps": scale * _let(z, lambda x: pinball(x, 0, len(qs))) * 2 / 49, "pit": normal_cdf(z)}
    return out | {f"in_{p}": F.abs(z) <= NormalDist().inv_cdf(0.5 + p / 200) for p in LEVELS}


def distribution_summary(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Mean scores, histogram of the PIT in equal bins (the last one closed), coverage and mean width of the central intervals. rows: actual, loc, scale. One aggregate."""
    s = proper_scores(F.col("actual"), F.col("loc"), F.col("scale"))
    x = rows.withColumns({f"_{k}": c.cast("double") for k, c in s.items()})
    at = F.least(F.floor(F.col("_pit") * bins), F.lit(bins - 1))
    width = lambda p: F.avg(2 * NormalDist().inv_cdf(0.5 + p / 200) * F.col("scale"))
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_nll").alias("nll"), F.avg("_crps").alias("crps"), *[F.count_if(at == b).alias(f"pit_{b}") for b in range(bins)],
        *[F.avg(f"_in_{p}").alias(f"in_{p}") for p in LEVELS], *[width(p).alias(f"width_{p}") for p in LEVELS],
    )


#: Ends of the lattice of outcomes; tails go to the ends.
LOW, HIGH = -80, 80


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, also within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Rows whose lattices are made at once.
CHUNK = 1024


def _masses(loc: np.ndarray, scale: np.ndarray, low: int, high: int) -> np.ndarray:
    """Normal mass of the integers low..high, a line per row; tails go to the ends. One distribution function per border between integers."""
    x = (np.arange(low + 1, high + 1) - 0.5 - loc[:, None]) / scale[:, None]
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + z / 2)
    power = np.full_like(t, ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    tail = t * np.exp(power - z * z) / 2
    return np.diff(np.where(x > 0, 1 - tail, tail), prepend=0.0, append=1.0)


def _kinds(loc: pa.Array, scale: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether loc or scale is null; the different pairs of the others, as loc + scale i; which of them each row has)."""
    none = np.array(loc.is_null()) | np.array(scale.is_null())
    kinds, place = np.unique(loc.to_numpy(zero_copy_only=False)[~none] + 1j * scale.to_numpy(zero_copy_only=False)[~none], return_inverse=True)
    if not kinds.imag.all():
        raise ZeroDivisionError("a scale is 0")
    return none, kinds, place


def lattice_mass(loc: Column, scale: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Normal mass of the integers low..high as an array; tails go to the ends. Rows of a batch that are alike are made once; null without loc or scale."""

    @F.arrow_udf("array<double>")
    def mass(loc: pa.Array, scale: pa.Array) -> pa.Array:
        none, kinds, place = _kinds(loc, scale)
        made = [_masses(k.real, k.imag, low, high) for k in np.array_split(kinds, len(kinds) // CHUNK + 1)]
        values = np.concatenate(made)[place].reshape(-1)
        ends = np.append(0, np.cumsum(np.where(none, 0, high - low + 1)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array(none))

    return mass(loc.cast("double"), scale.cast("double"))


def integer_lattice(rows: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows (.., loc, scale) times the integers low..high with their Normal mass; tails go to the ends.

    The steps of the distribution function are columns of their own, so that generated code computes each once.
    """
    x = rows.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))
    ends = {"_a": -0.5, "_b": 0.5}
    x = x.withColumns({n: (F.col("k") + d - F.col("loc")) / F.col("scale") for n, d in ends.items()})
    x = x.withColumns({f"{n}z": F.abs(n) / math.sqrt(2) for n in ends})
    x = x.withColumns({f"{n}t": 1 / (1 + F.col(f"{n}z") / 2) for n in ends})
    x = x.withColumns({f"{n}y": _tail(F.col(f"{n}z"), F.col(f"{n}t")) for n in ends})
    cdf = lambda n: F.when(F.col(n) > 0, 1 - F.col(f"{n}y")).otherwise(F.col(f"{n}y"))
    mass = F.when(F.col("k") == high, F.lit(1.0)).otherwise(cdf("_b")) - F.when(F.col("k") == low, F.lit(0.0)).otherwise(cdf("_a"))
    return x.withColumn("mass", mass).select(*rows.columns, "k", "mass")


def lattice_correction(history: DataFrame, pseudo: float = 200.0, least: int = 400, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Observed over expected mass per integer with pseudo rows, kept in 0.25..4; one for all below `least` rows.

    history: rows with loc, scale and actual. Outcomes are rounded to integers, and those beyond the ends count there.
    """
    known = history.where((F.col("scale") > 0) & F.col("loc").isNotNull() & F.col("actual").isNotNull())
    hit = F.greatest(F.lit(low), F.least(F.lit(high), F.rint("actual"))).cast("int")
    got = integer_lattice(known.select("loc", "scale", hit.alias("hit")), low, high)
    # combined before the shuffle: one row per integer leaves a task
    got = got.groupBy("k").agg(F.sum("mass").alias("expected"), F.count_if(F.col("hit") == F.col("k")).alias("observed"), F.count("*").alias("rows"))
    share = F.col("expected") / F.col("rows")
    ratio = F.greatest(F.lit(0.25), F.least(F.lit(4.0), (F.col("observed") + pseudo * share) / F.greatest(F.col("expected") + pseudo * share, F.lit(1e-12))))
    return got.select("k", "observed", "expected", F.when(F.col("rows") >= least, ratio).otherwise(1.0).alias("ratio"))


def _by_place(ratios: DataFrame, low: int, high: int) -> list[float]:
    found = {r["k"]: r["ratio"] for r in ratios.select("k", "ratio").collect()}  # high - low + 1 rows
    return [float(found.get(k, 1.0)) for k in range(low, high + 1)]


def corrected_lattice(rows: DataFrame, ratios: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows (.., loc, scale) with `corrected` and `cdf`, arrays over low..high: mass times ratio, normalised in the row, and its running sum.

    The ratios are one number per integer of the lattice and go into the expression.
    """
    by_place = F.lit(_by_place(ratios, low, high))
    x = rows.withColumn("_m", F.zip_with(lattice_mass(F.col("loc"), F.col("scale"), low, high), by_place, lambda m, r: m * r))
    # a sum in a column of its own would be put back into the lambda, and be made once per integer
    total = F.aggregate("_m", F.lit(0.0), lambda a, m: a + m)
    x = x.withColumn("corrected", _let(total, lambda s: F.transform("_m", lambda m: m / s)))
    run = F.aggregate("corrected", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c")), lambda a, m: F.struct((a["s"] + m).alias("s"), F.array_append(a["c"], a["s"] + m).alias("c")), lambda a: a["c"])
    return x.withColumn("cdf", run).drop("_m")


def discrete_crps(corrected: DataFrame, key: list[str], low: int = LOW) -> DataFrame:
    """Sum over the lattice of the squared distance of cdf and outcome, within the row; the cdf is run along, not built, which would copy it at every integer."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(low).alias("k"), F.lit(0.0).alias("crps"))

    def step(a: Column, m: Column) -> Column:
        run = a["s"] + m
        return F.struct(run.alias("s"), (a["k"] + 1).alias("k"), (a["crps"] + F.pow(run - F.when(F.col("actual") <= a["k"], 1.0).otherwise(0.0), F.lit(2))).alias("crps"))

    return corrected.select(*key, F.aggregate("corrected", start, step, lambda a: a["crps"]).alias("crps"))


def corrected_crps(rows: DataFrame, ratios: DataFrame, key: list[str], low: int = LOW, high: int = HIGH) -> DataFrame:
    """(key, crps): discrete_crps() of corrected_lattice(), without the lattice of every row.

    Rows of a batch with the same loc and scale have one lattice, and a row's score is read from its sums: that of the squared cdf, and that of
    the cdf from the outcome on. A null outcome is beyond the lattice.
    """
    by_place = np.array(_by_place(ratios, low, high))
    n = len(by_place)

    @F.arrow_udf("double")
    def crps(loc: pa.Array, scale: pa.Array, actual: pa.Array) -> pa.Array:
        none, kinds, place = _kinds(loc, scale)
        got = np.zeros(len(none))
        y = actual.to_numpy(zero_copy_only=False)[~none]
        first = np.where(np.isnan(y), n, np.clip(np.ceil(y) - low, 0, n)).astype(int)
        for at in np.array_split(np.argsort(place, kind="stable"), len(place) // CHUNK + 1):
            own, which = np.unique(place[at], return_inverse=True)
            m = _masses(kinds[own].real, kinds[own].imag, low, high) * by_place
            cdf = np.cumsum(m / m.sum(1, keepdims=True), 1)
            beyond = np.append(np.cumsum(cdf[:, ::-1], 1)[:, ::-1], np.zeros((len(own), 1)), 1)  # from each integer on
            got[np.flatnonzero(~none)[at]] = np.square(cdf).sum(1)[which] - 2 * beyond[which, first[at]] + n - first[at]
        return pa.array(got, mask=none)

    double = [F.col(c).cast("double") for c in ("loc", "scale", "actual")]
    return rows.select(*key, crps(*double).alias("crps"))


def key_number_mass(corrected: DataFrame, numbers: list[int], low: int = LOW) -> DataFrame:
    """Modelled and observed share at chosen integers, either sign."""
    at = [F.struct(F.lit(n).alias("number"), F.get("corrected", F.lit(s * n - low)).alias("m"), (F.col("actual") == s * n).cast("int").alias("o")) for n in numbers for s in (1, -1)]
    x = corrected.select(F.explode(F.array(*at)).alias("x")).select("x.*")
    return x.groupBy("number").agg(F.avg("m").alias("modelled"), F.avg("o").alias("observed"))


def line_grid_scores(rows: DataFrame, lines: list[float]) -> DataFrame:
    """Mean win, push, loss, three-way Brier score and log loss of Normal rows (loc, scale, actual) against a fixed grid of lines, and how reliable the win probability is: its weighted gap over ten bins."""
    x = rows.withColumn("line", F.explode(F.lit([float(v) for v in lines])))
    win, push, loss = settlement(F.col("loc"), F.col("scale"), F.col("line"))
    x = x.withColumns({"win": win, "push": push, "loss": loss})
    hit = lambda c: c.cast("int")
    w, p, lo = hit(F.col("actual") > F.col("line")), hit(F.col("actual") == F.col("line")), hit(F.col("actual") < F.col("line"))
    brier = F.pow(F.col("win") - w, F.lit(2)) + F.pow(F.col("push") - p, F.lit(2)) + F.pow(F.col("loss") - lo, F.lit(2))
    safe = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    log_loss = -F.ln(safe(F.when(w == 1, F.col("win")).when(p == 1, F.col("push")).otherwise(F.col("loss"))))
    x = x.withColumns({"_w": w, "_p": p, "_b": brier, "_l": log_loss, "_bin": F.least(F.floor(F.col("win") * 10), F.lit(9))})
    names = ["win", "push", "_w", "_p", "_b", "_l"]
    bins = x.groupBy("line", "_bin").agg(F.count("*").alias("c"), *[F.sum(c).alias(c) for c in names])
    total = lambda c: F.sum(c) / F.sum("c")
    return bins.groupBy("line").agg(
        F.sum("c").alias("n"), *[total(c).alias(k) for c, k in zip(names, ["win", "push", "won", "pushed", "brier", "log_loss"])], (F.sum(F.abs(F.col("_w") - F.col("win"))) / F.sum("c")).alias("gap")
    )
