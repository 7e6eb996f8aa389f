"""Queries of Normal distributions, lattices, cross-line prices and reports, with twins that write the same arithmetic in SQL. Importing this module registers them."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tidewater.operators import distributions as dist
from tidewater.operators import crossline, features, quotes
from tidewater.plans.fixtures import AS_OF
from tidewater.plans.more import ASOF, usable
from tidewater.plans.queries import BEST, CONS, DEC, PAIRS, PRICED, d6, pairs, query, r6, rounded
from tidewater.plans.third import BRACKET, HI, cross, histogram, lattice, lines, normal_rows
from tidewater.plans.third import LOSS as LATTICE_LOSS
from tidewater.plans.third import WIN as LATTICE_WIN


def cdf_sql(x: str) -> str:
    """normal_cdf() in SQL."""
    z = f"(abs({x}) / {math.sqrt(2)!r}e0)"
    t = f"(1e0 / (1e0 + {z} / 2e0))"
    power = repr(dist.ERFC[-1]) + "e0"
    for c in reversed(dist.ERFC[:-1]):
        power = f"({power} * {t} + {c!r}e0)"
    tail = f"({t} * exp({power} - {z} * {z}) / 2e0)"
    return f"(CASE WHEN ({x}) > 0 THEN 1e0 - {tail} ELSE {tail} END)"


def six(**columns: str) -> str:
    return ", ".join(f"{d6(sql)} AS {name}" for name, sql in columns.items())


#: Rows of normal_rows(): each season's games with the Normal fit of the seasons before.
NR = """, ft AS (SELECT fold, avg(a - actual) AS mean, greatest(0.25e0, stddev_pop(a - actual)) AS sd
        FROM (SELECT DISTINCT season AS fold FROM predictions WHERE season BETWEEN 1996 AND 2001) s JOIN predictions p ON p.season < fold GROUP BY fold),
    nr AS (SELECT game_id, season, actual, a - mean AS loc, sd AS scale FROM predictions JOIN ft ON season = fold)"""


# ---- Normal rows


@query("d10_normal_cdf", f"""SELECT l_orderkey, l_linenumber, {d6('z')} AS z, {d6(cdf_sql('z'))} AS cdf
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 1000 AS DOUBLE) / 100 - 5 AS z FROM lineitem)""")  # fmt: skip
def _(v):
    z = (F.col("l_orderkey") % 1000).cast("double") / 100 - 5
    return v("lineitem").select("l_orderkey", "l_linenumber", r6(z).alias("z"), r6(dist.normal_cdf(z)).alias("cdf"))


HIGH, LOW = cdf_sql("(3.5e0 - loc) / scale"), cdf_sql("(2.5e0 - loc) / scale")


@query("d13_settlement", f"{NR} SELECT game_id, {six(win=f'1 - {HIGH}', push=f'{HIGH} - {LOW}', loss=LOW)} FROM nr", ("predictions",))
def _(v):
    win, push, loss = dist.settlement(F.col("loc"), F.col("scale"), F.lit(3.0))
    return normal_rows(v).select("game_id", r6(win).alias("win"), r6(push).alias("push"), r6(loss).alias("loss"))


QUANTILES = ", ".join(f"{NormalDist().inv_cdf(i / 50)!r}e0" for i in range(1, 50))
SCORED = f"""{NR}, zz AS (SELECT *, (actual - loc) / scale AS z FROM nr),
    sc AS (SELECT *, ln(scale) + z * z / 2 + {0.5 * math.log(2 * math.pi)!r}e0 AS nll, {cdf_sql('z')} AS pit,
           scale * list_sum(list_transform([{QUANTILES}], lambda q, i: (z - q) * (i / 50e0 - CASE WHEN z < q THEN 1e0 ELSE 0e0 END))) * 2 / 49 AS crps FROM zz)"""
INSIDE = {p: f"{NormalDist().inv_cdf(0.5 + p / 200)!r}e0" for p in dist.LEVELS}


@query("d14_proper_scores", f"""{SCORED} SELECT season, count(*) AS n, {six(nll='avg(nll)', crps='avg(crps)', pit='avg(pit)')},
    {six(**{f'in_{p}': f'avg(CAST(abs(z) <= {q} AS INTEGER))' for p, q in INSIDE.items()})} FROM sc GROUP BY season""", ("predictions",))  # fmt: skip
def _(v):
    s = dist.proper_scores(F.col("actual"), F.col("loc"), F.col("scale"))
    got = normal_rows(v).groupBy("season").agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in s.items()])
    return rounded(got, *s)


@query("e7_distribution_summary", f"""{SCORED} SELECT season, count(*) AS n, {six(nll='avg(nll)', crps='avg(crps)')},
    {', '.join(f'count(*) FILTER (least(floor(pit * 10), 9) = {b}) AS pit_{b}' for b in range(10))},
    {six(**{f'in_{p}': f'avg(CAST(abs(z) <= {q} AS INTEGER))' for p, q in INSIDE.items()}, **{f'width_{p}': f'avg(2 * {q} * scale)' for p, q in INSIDE.items()})} FROM sc GROUP BY season""", ("predictions",))  # fmt: skip
def _(v):
    got = dist.distribution_summary(normal_rows(v), ["season"])
    return rounded(got, "nll", "crps", *[f"{k}_{p}" for k in ("in", "width") for p in dist.LEVELS])


LINES = [-14, -7.5, -7, -3.5, -3, 0.5, 3, 3.5, 7, 10]
AT = lambda d: cdf_sql(f"(line + {d} - loc) / scale")
GRID = f"""{NR}, li AS (SELECT *, unnest({[float(x) for x in LINES]}) AS line FROM nr), hl AS (SELECT *, line = floor(line) AS whole FROM li),
    wl AS (SELECT *, CASE WHEN whole THEN {AT('0.5e0')} ELSE {AT('0e0')} END AS hi, CASE WHEN whole THEN {AT('-0.5e0')} ELSE {AT('0e0')} END AS lo FROM hl),
    wp AS (SELECT *, 1 - hi AS win, hi - lo AS push, lo AS loss, CAST(actual > line AS INTEGER) AS w, CAST(actual = line AS INTEGER) AS p, CAST(actual < line AS INTEGER) AS l FROM wl),
    bi AS (SELECT line, least(floor(win * 10), 9) AS bin, count(*) AS c, sum(w) AS sw, sum(win) AS swin FROM wp GROUP BY ALL), ga AS (SELECT line, sum(abs(sw - swin)) / sum(c) AS gap FROM bi GROUP BY line)"""


@query("d18_line_grid_scores", f"""{GRID} SELECT line, count(*) AS n, {six(win='avg(win)', push='avg(push)', won='avg(w)', pushed='avg(p)', brier='avg(power(win - w, 2) + power(push - p, 2) + power(loss - l, 2))',
    log_loss='avg(-ln(greatest(1e-6, least(1 - 1e-6, CASE WHEN w = 1 THEN win WHEN p = 1 THEN push ELSE loss END))))', gap='any_value(gap)')} FROM wp JOIN ga USING (line) GROUP BY line""", ("predictions",))  # fmt: skip
def _(v):
    return rounded(dist.line_grid_scores(normal_rows(v), LINES), "win", "push", "won", "pushed", "brier", "log_loss", "gap")


# ---- lattices

MASS = f"CASE WHEN k = 80 THEN 1e0 ELSE {cdf_sql('(k + 0.5e0 - loc) / scale')} END - CASE WHEN k = -80 THEN 0e0 ELSE {cdf_sql('(k - 0.5e0 - loc) / scale')} END"
LATTICE = f"{NR}, la AS (SELECT game_id, season, actual, k, {MASS} AS mass FROM nr, range(-80, 81) t(k))"
RATIOS = f"""{LATTICE}, ex AS (SELECT k, sum(mass) AS expected, count(*) FILTER (greatest(-80, least(80, round_even(actual, 0))) = k) AS observed, count(*) AS n FROM la WHERE season < 1999 GROUP BY k),
    ra AS (SELECT *, CASE WHEN n >= 400 THEN greatest(0.25e0, least(4e0, (observed + 200 * expected / n) / greatest(expected + 200 * expected / n, 1e-12))) ELSE 1e0 END AS ratio FROM ex)"""
CORRECTED = f"""{RATIOS}, ms AS (SELECT la.*, mass * ratio AS m FROM la JOIN ra ON ra.k = la.k WHERE season >= 1999),
    co AS (SELECT *, m / sum(m) OVER (PARTITION BY game_id) AS corrected FROM ms),
    cu AS (SELECT *, sum(corrected) OVER (PARTITION BY game_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM co)"""


@query("d15_integer_lattice", f"{LATTICE} SELECT game_id, {six(total='sum(mass)', peak='max(mass)')}, count(*) AS points FROM la GROUP BY game_id", ("predictions",))
def _(v):
    return rounded(lattice(v).groupBy("game_id").agg(F.sum("mass").alias("total"), F.count("*").alias("points"), F.max("mass").alias("peak")), "total", "peak")


def early(v):
    return normal_rows(v).where("season < 1999")


def late(v):
    return normal_rows(v).where("season >= 1999")


def corrected(v):
    return dist.corrected_lattice(late(v), dist.lattice_correction(early(v)))


@query("d16_lattice_correction", f"{RATIOS} SELECT CAST(k AS INTEGER) AS k, observed, {six(expected='expected', ratio='ratio')} FROM ra", ("predictions",))
def _(v):
    return rounded(dist.lattice_correction(early(v)), "expected", "ratio")


@query("d17_corrected_lattice", f"{CORRECTED} SELECT game_id, {six(crps='sum(power(cdf - CASE WHEN actual <= k THEN 1 ELSE 0 END, 2))')} FROM cu GROUP BY game_id", ("predictions",))
def _(v):
    return rounded(dist.corrected_crps(late(v), dist.lattice_correction(early(v)), ["game_id"]), "crps")


@query("d19_key_number_mass", f"{CORRECTED} SELECT CAST(abs(k) AS INTEGER) AS number, {six(modelled='avg(corrected)', observed='avg(CAST(actual = k AS INTEGER))')} FROM cu WHERE abs(k) IN (3, 7, 10, 14) GROUP BY abs(k)", ("predictions",))
def _(v):
    return rounded(dist.key_number_mass(corrected(v), [3, 7, 10, 14]), "modelled", "observed")


# ---- cross-line prices

CENTRE = f"""{ASOF}, {PAIRS}, {BRACKET}, y0 AS (SELECT event_id, market, book_id, center, greatest(0.5e0, least(2e0, 1 / (1 + overround))) AS w FROM ce),
    u0 AS (SELECT *, sum(w) OVER (PARTITION BY event_id, market ORDER BY center, book_id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY event_id, market) / 2 AS mid FROM y0),
    t0 AS (SELECT *, min(center) FILTER (run >= mid) OVER (PARTITION BY event_id, market) AS wm FROM u0), d0 AS (SELECT *, abs(center - wm) AS dev FROM t0),
    e0 AS (SELECT *, median(dev) OVER (PARTITION BY event_id, market) AS mad FROM d0),
    f0 AS (SELECT *, w * CASE WHEN dev > 0 THEN least(1, greatest(0.5e0, mad * 2.2239e0) / dev) ELSE 1 END AS inf FROM e0),
    rc AS (SELECT event_id, market, count(*) AS books, sum(center * inf) / sum(inf) AS center FROM f0 GROUP BY ALL HAVING count(*) >= 2),
    hs AS (SELECT market, value, n / sum(n) OVER (PARTITION BY market) AS w FROM hi)"""


def settled(offers: str, key: str) -> str:
    """SQL of settle_at() over rows `offers` with market, line and center."""
    return f"(SELECT {key}, sum(({LATTICE_WIN}) * w) AS win, sum(({LATTICE_LOSS}) * w) AS loss FROM (SELECT {key}, center + value - line AS y, line <> floor(line) AS half, w FROM {offers} JOIN hs USING (market)) GROUP BY ALL)"


OFFERS = "(SELECT DISTINCT ce.event_id, ce.market, ce.line, rc.center, rc.books FROM ce JOIN rc ON rc.event_id = ce.event_id AND rc.market = ce.market)"


@query("d4_cross_line_price", f"""{CENTRE}, st AS {settled(OFFERS, 'event_id, market, line, center, books')}
    SELECT event_id, market, line, books, {six(center='center', win='win', loss='loss', push='1 - win - loss')} FROM st""", ("quotes", "predictions"))  # fmt: skip
def _(v):
    return rounded(cross(v), "center", "win", "push", "loss")


MODAL = """(SELECT event_id, market, CASE WHEN market = 1 THEN 0 - line ELSE line END AS line FROM (SELECT event_id, market, line, count(*) AS n FROM p WHERE reason IS NULL AND market > 0 GROUP BY ALL)
    JOIN (SELECT event_id, market, median(line) AS med FROM p WHERE reason IS NULL AND market > 0 GROUP BY ALL) USING (event_id, market)
    QUALIFY row_number() OVER (PARTITION BY event_id, market ORDER BY n DESC, abs(line - med), line) = 1)"""
OWN = f"(SELECT ce.event_id, ce.market, ce.book_id, ce.line AS own, mo.line, ce.center, row_number() OVER () AS r FROM ce JOIN {MODAL} mo ON mo.event_id = ce.event_id AND mo.market = ce.market)"


@query("d5_project_books", f"""{CENTRE}, st AS {settled(OWN, 'r, event_id, market, line')}, q AS (SELECT *, win / nullif(win + loss, 0) AS q FROM st)
    SELECT event_id, market, line, count(*) AS books, {six(dispersion='max(q) - min(q)', mean_q='avg(q)')} FROM q GROUP BY ALL""", ("quotes", "predictions"))  # fmt: skip
def _(v):
    """Every book's own centre settled at its market's modal line; dispersion over books."""
    own = dist.infer_center(lines(v), histogram(v)).select("event_id", "market", "book_id", "center")
    best = quotes.modal_line(pairs(v).where("market > 0")).select("event_id", "market", crossline.threshold(F.col("market"), F.col("line")).alias("line"))
    at = dist.settle_at(own.join(best, quotes.MARKET), histogram(v)).withColumn("q", F.try_divide("win", F.col("win") + F.col("loss")))
    got = at.groupBy("event_id", "market", "line").agg(F.count("*").alias("books"), (F.max("q") - F.min("q")).alias("dispersion"), F.avg("q").alias("mean_q"))
    return rounded(got, "dispersion", "mean_q")


@query("d20_market_line_probabilities", f""", z AS (SELECT game_id, season, a, actual - a AS r FROM predictions), fo AS (SELECT DISTINCT p.season AS fold FROM predictions p WHERE season <= 2001),
    fr AS (SELECT fold, r FROM fo JOIN z ON season < fold WHERE season < 2001), b AS (SELECT fold, greatest(0.35e0, 1.06e0 * stddev_pop(r) * pow(count(*), -0.2e0)) AS h FROM fr GROUP BY fold),
    n AS (SELECT fold, CAST(floor(r * 4 + 0.5) AS BIGINT) AS k, count(*) AS n FROM fr GROUP BY ALL),
    g AS (SELECT fold, k + o AS k, sum(n * exp(-power(o / 4e0 / h, 2) / 2)) AS w FROM n JOIN b USING (fold), range(-400, 401) t(o) WHERE abs(o) <= ceil(h * 16) GROUP BY ALL),
    c AS (SELECT fold, k / 4e0 AS x, sum(w) OVER (PARTITION BY fold ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY fold) AS cdf FROM g),
    e AS (SELECT fold, min(x) AS lo, max(x) AS hi FROM c GROUP BY fold),
    q AS (SELECT game_id, e.fold, greatest(lo, least(hi, floor((game_id % 15 - 7 - a) * 4 + 0.5) / 4)) AS x FROM z JOIN e ON z.season = e.fold)
    SELECT game_id, CAST(q.fold AS INTEGER) AS fold, {six(p_over='1 - cdf')} FROM q JOIN c ON c.fold = q.fold AND c.x = q.x""", ("predictions",))  # fmt: skip
def _(v):
    """Each season's own earlier residuals as a kernel grid, evaluated at the market's line of every game."""
    p = v("predictions").withColumn("r", F.col("actual") - F.col("a"))
    folds = p.where("season < 2001").withColumn("fold", F.explode(F.sequence(F.col("season").cast("int") + 1, F.lit(2001)))).select("fold", "r")
    grid = dist.fit_kernel_grid(folds, ["fold"], "r")
    at = p.select("game_id", F.col("season").cast("int").alias("fold"), (F.floor((F.col("game_id") % 15 - 7 - F.col("a")) * 4 + 0.5) / 4).alias("x"))
    edge = grid.groupBy("fold").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = at.join(edge, "fold").withColumn("x", F.greatest("lo", F.least("hi", "x"))).join(grid, ["fold", "x"])
    return rounded(got.select("game_id", "fold", (1 - F.col("cdf")).alias("p_over")), "p_over")


OFFERED = f"""st AS {settled(OFFERS, 'event_id, market, line, center, books')},
    sd AS (SELECT ce.event_id, ce.market, book_id, ce.line, books, side, CASE side WHEN 1 THEN o1 ELSE o2 END AS odds, CASE side WHEN 1 THEN win ELSE loss END AS win, CASE side WHEN 1 THEN loss ELSE win END AS loss
        FROM ce JOIN st ON st.event_id = ce.event_id AND st.market = ce.market AND st.line = ce.line, (VALUES (1), (2)) x(side)),
    ev AS (SELECT *, win * (price - 1) - loss AS ev, coalesce(win / nullif(win + loss, 0), 0) - 1 / price AS edge FROM (SELECT *, {DEC} AS price FROM sd)),
    rb AS (SELECT *, count(*) OVER (PARTITION BY event_id, market, side) AS offers FROM ev
        QUALIFY row_number() OVER (PARTITION BY event_id, market, side ORDER BY round(ev, 9) DESC, round(edge, 9) DESC, price DESC, book_id DESC, line DESC) = 1)"""
SPREAD = f"""ow AS (SELECT rb.event_id, rb.market, rb.side, rb.line, ce.center, row_number() OVER () AS r FROM rb JOIN ce ON ce.event_id = rb.event_id AND ce.market = rb.market),
    so AS {settled('ow', 'r, event_id, market, side')},
    ds AS (SELECT event_id, market, side, max(win / nullif(win + loss, 0)) - min(win / nullif(win + loss, 0)) AS dispersion FROM so GROUP BY ALL)"""


@query("d4_best_offer", f"""{CENTRE}, {OFFERED}, {SPREAD} SELECT event_id, market, CAST(side AS BIGINT) AS side, book_id, line, odds, offers, books, {six(win='win', loss='loss', ev='ev', edge='edge', dispersion='dispersion')}
    FROM rb JOIN ds USING (event_id, market, side)""", ("quotes", "predictions"))  # fmt: skip
def _(v):
    got = crossline.best_offers(crossline.centered(lines(v), histogram(v)), histogram(v))
    return rounded(got.select("event_id", "market", "side", "book_id", "line", "odds", "offers", "books", "win", "loss", "ev", "edge", "dispersion"), "win", "loss", "ev", "edge", "dispersion")


#: Histograms of earlier seasons: the key of a market is season * 10 + market.
EARLIER = """pk AS (SELECT p.* REPLACE (season * 10 + market AS market) , market AS kind FROM p JOIN games ON game_id = event_id),
    hv AS (SELECT season, m AS market, floor((a - actual) * 4 + 0.5) / 4 + m - 1 AS value FROM predictions, (VALUES (1), (2)) t(m)),
    ha AS (SELECT s.season * 10 + market AS market, value, count(*) AS n FROM (SELECT DISTINCT season FROM games) s JOIN hv ON hv.season < s.season GROUP BY ALL),
    hi AS (SELECT * FROM ha QUALIFY sum(n) OVER (PARTITION BY market) >= 300)"""
BACK = CENTRE.replace(HI, EARLIER).replace("CASE WHEN market = 1 THEN 0 - line ELSE line END AS line, overround", "CASE WHEN kind = 1 THEN 0 - line ELSE line END AS line, overround").replace("FROM p WHERE reason IS NULL AND market > 0", "FROM pk WHERE reason IS NULL AND kind > 0")


@query("a20_cross_line_backtest", f"""{BACK}, {OFFERED}, go AS (SELECT rb.*, season, CASE WHEN rb.market % 10 = 1 THEN margin ELSE total END - line AS y FROM rb JOIN games ON game_id = event_id)
    SELECT event_id, season, market % 10 AS market, CAST(side AS BIGINT) AS side, book_id, line, odds, {six(ev='ev', edge='edge', realized='CASE WHEN y = 0 THEN 0 WHEN (y > 0) = (side = 1) THEN price - 1 ELSE -1 END')} FROM go""", ("quotes", "predictions", "games"))  # fmt: skip
def _(v):
    p = v("predictions").withColumn("market", F.explode(F.lit([1, 2])))
    residuals = p.select("season", "market", (F.floor((F.col("a") - F.col("actual")) * 4 + 0.5) / 4 + F.col("market") - 1).alias("value"))
    results = v("games").select(F.col("game_id").alias("event_id"), "season", "margin", "total")
    got = crossline.backtest(lines(v), residuals, results)
    return rounded(got.select("event_id", "season", "market", "side", "book_id", "line", "odds", "ev", "edge", "realized"), "ev", "edge", "realized")


# ---- reports


@query("a18_slate_summary", f"""{ASOF}, {PAIRS}, {CONS}, {BEST}, {PRICED}, g AS (SELECT start, market, event_id, line, max(books) AS books FROM x GROUP BY ALL)
    SELECT start, market, count(*) AS groups, CAST(sum(books) AS BIGINT) AS books FROM g GROUP BY start, market""", ("quotes",))  # fmt: skip
def _(v):
    return quotes.slate_summary(quotes.price_markets(v("quotes"), AS_OF), "start")


KEYS = ["season", "cohort", "slate", "horizon", "market"]
SETS = "(season, horizon, market), (horizon, market)"
REPORT = """count(*) AS requested, count(*) FILTER (usable) AS usable, floor(1e8 * avg(usable::INT) + 0.5) / 1e6 AS coverage_pct, quantile_disc(distance, 0.5) AS distance_p50, quantile_disc(distance, 0.9) AS distance_p90,
    floor(1e8 * avg(eligible::INT) + 0.5) / 1e6 AS fidelity_pct, min(supported) AS supported_min, quantile_disc(supported, 0.5) AS supported_p50, max(supported) AS supported_max,
    floor(1e8 * avg((supported >= 2)::INT) + 0.5) / 1e6 AS two_books_pct, floor(1e8 * avg((supported >= 3)::INT) + 0.5) / 1e6 AS three_books_pct, floor(1e8 * sum(complete) / nullif(sum(books), 0) + 0.5) / 1e6 AS completeness_pct,
    count(*) FILTER (mapping = 'reliable') AS reliable_mappings, count(*) FILTER (mapping = 'ambiguous') AS ambiguous_mappings, count(*) FILTER (mapping = 'missing') AS missing_mappings"""
RECORDS = """re AS (SELECT event_id % 5 AS season, CASE WHEN event_id % 3 = 0 THEN 'fbs_vs_fbs' ELSE 'other' END AS cohort, event_id % 4 AS slate, event_id % 2 AS horizon, market, complete >= 2 AS usable,
    CASE WHEN event_id % 11 <> 0 THEN event_id % 700 END AS distance, coalesce(event_id % 11 <> 0 AND event_id % 700 <= 300, false) AS eligible, complete + incomplete AS books, complete, complete AS supported,
    CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous' ELSE 'reliable' END AS mapping
    FROM (SELECT event_id, market, count(*) FILTER (reason IS NULL) AS complete, count(*) FILTER (reason IS NOT NULL) AS incomplete FROM p GROUP BY ALL))"""
SHOWN = "CAST(season AS DOUBLE) AS season, cohort, CAST(slate AS DOUBLE) AS slate, CAST(horizon AS DOUBLE) AS horizon, CAST(market AS DOUBLE) AS market"
NUMBERS = ["requested", "usable", "distance_p50", "distance_p90", "supported_min", "supported_p50", "supported_max", "reliable_mappings", "ambiguous_mappings", "missing_mappings"]


@query("a9_coverage_report", f"""{ASOF}, {PAIRS}, {RECORDS},
    al AS (SELECT 'all' AS scope, season, cohort, slate, horizon, market, {REPORT} FROM re GROUP BY GROUPING SETS ({SETS}, (cohort, horizon, market), (season, slate, horizon, market))
           UNION ALL SELECT 'primary', season, NULL, NULL, horizon, market, {REPORT} FROM re WHERE cohort = 'fbs_vs_fbs' GROUP BY GROUPING SETS ({SETS}))
    SELECT scope, {SHOWN}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMBERS)}, coverage_pct, fidelity_pct, two_books_pct, three_books_pct, completeness_pct FROM al""", ("quotes",))  # fmt: skip
def _(v):
    e = F.col("event_id")
    near = (e % 11 != 0) & (e % 700 <= 300)
    re = usable(v).select(
        (e % 5).alias("season"), F.when(e % 3 == 0, "fbs_vs_fbs").otherwise("other").alias("cohort"), (e % 4).alias("slate"), (e % 2).alias("horizon"), "market", "usable", F.when(e % 11 != 0, e % 700).alias("distance"),
        near.alias("eligible"), (F.col("complete") + F.col("incomplete")).alias("books"), "complete", F.col("complete").alias("supported"), F.when(e % 7 == 0, "missing").when(e % 7 == 1, "ambiguous").otherwise("reliable").alias("mapping"),
    )
    got = quotes.coverage_report(re, F.col("cohort") == "fbs_vs_fbs")
    return got.withColumns({c: F.col(c).cast("double") for c in [*NUMBERS, "season", "slate", "horizon", "market"]})


@query("g11_horizons_identical", """, t AS (SELECT game_id, h, CASE h WHEN 'a' THEN a ELSE b END AS x, CASE WHEN game_id % 9 = 0 AND h = 'a' THEN NULL ELSE week END AS w FROM predictions, (VALUES ('a'), ('b')) u(h) WHERE h = 'a' OR game_id % 50 <> 0),
    o AS (SELECT game_id, count(DISTINCT h) AS k, count(DISTINCT x) + max((x IS NULL)::INT) > 1 AS dx, count(DISTINCT w) + max((w IS NULL)::INT) > 1 AS dw FROM t GROUP BY game_id)
    SELECT 'x' AS feature, count(*) FILTER (dx) AS different, count(*) FILTER (k < 2) AS incomplete, count(*) AS keys FROM o UNION ALL SELECT 'w', count(*) FILTER (dw), count(*) FILTER (k < 2), count(*) FROM o""", ("predictions",))  # fmt: skip
def _(v):
    p = v("predictions")
    a = p.select("game_id", F.lit("a").alias("horizon"), F.col("a").alias("x"), F.when(F.col("game_id") % 9 != 0, F.col("week")).alias("w"))
    b = p.where("game_id % 50 <> 0").select("game_id", F.lit("b").alias("horizon"), F.col("b").alias("x"), F.col("week").alias("w"))
    return features.horizons_identical(a.unionByName(b), ["game_id"], ["x", "w"])
