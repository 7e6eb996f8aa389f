"""Boosted regression trees of many folds and budgets at once, from histograms over quantile bins.

Rows of a season with the same bins have the same scores in every model, so they are one row with their number and the sum of their targets.
All trees of all models grow together. In one pass over these rows every task counts, for each model, the rows and the residuals of the nodes that are being
split by feature and bin. The driver sums the counts of the tasks and picks the splits: what it holds depends on the number of models, their depth, the
features and the bins, not on the rows. Scores of finished trees are written to the rows now and then, so that a pass goes through few trees.
Up to a fixed number of distinct rows no pass is a job of its own: each model's rows are then one group, which grows its trees without the others.
A missing or non-finite value has the lowest bin.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.folds import present

BINS = 32
#: Passes after which scores are written to the rows.
WRITE = 24
#: Most distinct rows that a model's group may have, some 100 bytes each; beyond them the passes are Spark jobs over all tasks.
ALONE = 1 << 20
#: Rows that a task takes at once.
CHUNK = 1 << 17


@dataclass(frozen=True)
class Budget:
    name: str
    depth: int
    rounds: int
    rate: float
    smallest: int
    l2: float


#: Depth, trees, learning rate, smallest leaf and penalty of the three budgets; fixed values.
BUDGETS = (Budget("conservative", 3, 500, 0.03, 20, 15.0), Budget("balanced", 5, 300, 0.05, 20, 8.0), Budget("flexible", 7, 200, 0.07, 30, 15.0))


@dataclass
class Tree:
    """Nodes 1 .. 2 ** (depth + 1) - 1, the children of node k being 2k and 2k + 1. feature -1: a leaf with its value."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def sprout(depth: int) -> Tree:
        n = 1 << (depth + 1)
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def down(self, cols: np.ndarray, at: np.ndarray, level: int) -> None:
        """Moves the rows in nodes of a level one level down; those in leaves stay. One comparison of all rows per node is cheaper than a search per row."""
        for k in range(1 << level, 2 << level):
            if self.feature[k] >= 0:
                right = (cols[self.feature[k]] > self.bin[k]).astype(at.dtype)
                at += (at == k) * (right + at.dtype.type(k))

    def nodes(self, cols: np.ndarray, depth: int) -> np.ndarray:
        """The node of every row `depth` levels down, or the leaf that it ends in before. cols: the bins, a line per feature."""
        at = np.ones(cols.shape[1], np.min_scalar_type(len(self.feature) - 1))
        for level in range(depth):
            self.down(cols, at, level)
        return at


@dataclass
class Model:
    """What is known of one fold and budget. fresh: trees whose scores are not in the rows yet; now: the tree that grows, at `level`."""

    fold: int
    budget: Budget
    base: float
    trained_on: int
    trees: list[Tree] = field(default_factory=list)
    fresh: list[Tree] = field(default_factory=list)
    now: Tree | None = None
    level: int = 0

    def ends(self) -> bool:
        return len(self.trees) >= self.budget.rounds

    def scores(self, cols: np.ndarray, trees: list[Tree]) -> np.ndarray:
        total = np.zeros(cols.shape[1])
        for t in trees:
            total += t.value[t.nodes(cols, self.budget.depth)]
        return total


def edges(rows: DataFrame, features: list[str], before: int, bins: int = BINS) -> list[list[float]]:
    """Ascending bin edges of every feature: approximate quantiles of the seasons before the first fold, so that no fold sees a later one."""
    shares = [i / bins for i in range(1, bins)]
    if not features:
        return []
    got = rows.where(F.col("season") < before).agg(*[F.percentile_approx(present(c), shares, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(x or [])) for x in got]


def binned(rows: DataFrame, features: list[str], found: list[list[float]], label: str) -> DataFrame:
    """(label, season, y, b0, b1, ..): bin 0 is missing, bin k + 1 lies above k edges."""

    cell = lambda c, e: F.when(present(c).isNull(), 0).otherwise(1 + F.size(F.filter(F.lit(e) if e else F.array().cast("array<double>"), lambda x: x < present(c))))
    return rows.select(F.col(label), F.col("season").cast("long").alias("season"), F.col("actual").cast("double").alias("y"), *[cell(c, e).cast("int").alias(f"b{i}") for i, (c, e) in enumerate(zip(features, found, strict=True))])


def _matrix(batch: pa.RecordBatch | pa.Table, p: int) -> np.ndarray:
    """The bins, a line per feature."""
    at = batch.schema.get_field_index("b0")
    return np.stack([batch.column(at + i).to_numpy() for i in range(p)]).astype(np.uint8) if p else np.zeros((0, batch.num_rows), np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _training(batch: pa.RecordBatch, live: list[tuple[int, Model]], p: int, first: int | None) -> Iterator[tuple[int, Model, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, model, bins, number of rows, residuals) of every model on the rows of a batch that it is trained on."""
    season = batch.column(0).to_numpy()
    order = np.argsort(season, kind="stable")
    season, y, c, cols = season[order], batch.column(1).to_numpy()[order], batch.column(2).to_numpy().astype(float)[order], _matrix(batch, p)[:, order]
    scores = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
    for k, m in live:
        on = slice(0 if first is None else np.searchsorted(season, first), np.searchsorted(season, m.fold))
        if on.start < on.stop:
            own = cols[:, on]
            yield k, m, own, c[on], y[on] - c[on] * (scores[order[on], k] + m.scores(own, m.fresh))


def _count(n: np.ndarray, r: np.ndarray, cols: np.ndarray, at: np.ndarray, c: np.ndarray, rest: np.ndarray, level: int) -> None:
    """Adds the rows and residuals of the nodes of a level, by node, feature and bin, to n and r."""
    start, width = 1 << level, BINS + 1
    slot = at.astype(np.intp) * width
    for f in range(len(cols)):
        here = slot + cols[f]
        for into, weight in ((n, c), (r, rest)):  # rows in leaves above stay there
            into[:, f] += np.bincount(here, weight, 2 * start * width)[start * width :].reshape(start, width)


def _blank(m: Model, p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((1 << m.level, p, BINS + 1)), np.zeros((1 << m.level, p, BINS + 1))


def _fitted(m: Model, cols: np.ndarray, y: np.ndarray, c: np.ndarray) -> Model:
    """m with all its trees, from the rows that it is trained on."""
    rest = y - c * m.base
    while not m.ends():
        tree, at = m.now, m.now.nodes(cols, 0)
        while m.now is tree:
            level, (n, r) = m.level, _blank(m, len(cols))
            _count(n, r, cols, at, c, rest, level)
            _grow(m, n, r)
            tree.down(cols, at, level)
        rest -= c * tree.value[at]
    return m


def _histograms(rows: DataFrame, models: list[Model], p: int, first: int | None, alone: bool) -> DataFrame:
    """(found): pickled, of every task with rows {model: (n, r)}, the rows and residuals of the nodes to be split by node, feature and bin; alone: {model: itself, grown} of every model's group."""
    live = [(k, replace(m, trees=[])) for k, m in enumerate(models) if not m.ends()]
    put = lambda found: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])
    names = ["season", "y", "n", *[f"b{i}" for i in range(p)]]

    def whole(group: pa.Table) -> pa.Table:
        k, group = group.column("model")[0].as_py(), group.combine_chunks()
        cols = _matrix(group, p)
        order = np.lexsort((group.column("season").to_numpy(), *cols))  # sums don't depend on how Spark dealt the rows
        y, c = group.column("y").to_numpy()[order], group.column("n").to_numpy().astype(float)[order]
        return pa.Table.from_batches([put({k: _fitted(replace(models[k], trees=[]), np.ascontiguousarray(cols[:, order]), y, c)})])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in _chunks(batches):
            for k, m, cols, c, rest in _training(batch, live, p, first):
                _count(*found.setdefault(k, _blank(m, p)), cols, m.now.nodes(cols, m.level), c, rest, m.level)
        if found:
            yield put(found)

    if not alone:
        return rows.select(*names, "score").mapInArrow(run, "found binary")
    on = lambda m: (F.col("season") < m.fold) & (F.col("season") >= first if first is not None else F.lit(True))
    dealt = rows.select(*names, F.explode(F.array_compact(F.array(*[F.when(on(m), F.lit(k)) for k, m in live]))).alias("model"))
    return dealt.repartitionByRange(len(live), "model").groupBy("model").applyInArrow(whole, "found binary")


def _grow(m: Model, n: np.ndarray, r: np.ndarray) -> None:
    """Takes the best splits of one level into the tree that grows; a tree at its depth, or without any split left, is done.

    n, r: rows and residuals by node, feature and bin. Equal gains go to the first feature, then the lowest bin.
    """
    rate, l2, smallest = m.budget.rate, m.budget.l2, m.budget.smallest
    part = lambda r, n: np.divide(r * r, n + l2, out=np.zeros(np.broadcast(r, n).shape), where=n + l2 > 0)
    leaf = lambda r, n: rate * r / (n + l2) if n + l2 else 0.0
    ln, lr = np.cumsum(n, 2), np.cumsum(r, 2)
    all_n, all_r = ln[:, :, -1:], lr[:, :, -1:]
    rn, rr = all_n - ln, all_r - lr
    gain = np.round(part(lr, ln) + part(rr, rn) - part(all_r, all_n), 9)
    gain = np.where((n > 0) & (ln >= smallest) & (rn >= smallest) & (gain > 0), gain, -1.0).reshape(len(n), -1)
    split = False
    for i, at in enumerate(np.argmax(gain, 1)):
        k = (1 << m.level) + i
        # the sums of a node are the same under every feature; the first one's are taken
        own_n, own_r = all_n[i, 0, 0], all_r[i, 0, 0]
        if own_n:
            m.now.value[k] = leaf(own_r, own_n)
        if gain[i, at] > 0:
            split = True
            f, b = divmod(int(at), n.shape[2])
            m.now.feature[k], m.now.bin[k] = f, b
            m.now.value[2 * k], m.now.value[2 * k + 1] = leaf(lr[i, f, b], ln[i, f, b]), leaf(own_r - lr[i, f, b], own_n - ln[i, f, b])
    m.level += 1
    if m.level == m.budget.depth or not split:
        m.trees.append(m.now)
        m.fresh.append(m.now)
        m.now, m.level = Tree.sprout(m.budget.depth), 0


def _scored(rows: DataFrame, models: list[Model], p: int) -> DataFrame:
    """rows with the scores of fresh trees added."""
    names, models = rows.columns, [replace(m, trees=[]) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            cols = _matrix(batch, p)
            score = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, len(models)).copy()
            for k, m in enumerate(models):
                score[:, k] += m.scores(cols, m.fresh)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(models)), pa.array(score.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names)

    return rows.mapInArrow(run, rows.schema)


def boosted_models(rows: DataFrame, p: int, seasons: list[int], budgets: list[Budget], folder: str, first: int | None = None) -> list[Model]:
    """A model of every season and budget, fitted on binned rows of the seasons before it (from `first` on); seasons without such rows have none."""
    spark = rows.sparkSession
    known = rows.where("y is not null") if first is None else rows.where((F.col("season") >= first) & F.col("y").isNotNull())
    sums = known.where(F.col("season") < max(seasons)).groupBy("season").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()  # one row per season
    models = []
    for s in seasons:
        n, total = sum(x["n"] for x in sums if x["season"] < s), sum(x["s"] for x in sums if x["season"] < s)
        models += [Model(s, b, total / n, n, now=Tree.sprout(b.depth)) for b in budgets if n]
    if not models or not p:
        return models

    path, turn = f"{folder}/boosted-{uuid.uuid4().hex}", itertools.count()

    def written(df: DataFrame) -> DataFrame:
        """df, written over what was written before last."""
        at = f"{path}/{next(turn) % 2}"
        df.write.mode("overwrite").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    alike = known.where(F.col("season") < max(seasons)).groupBy("season", *[f"b{i}" for i in range(p)]).agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    rows = written(alike.select("season", "y", "n", *[f"b{i}" for i in range(p)], F.array(*[F.lit(m.base) for m in models]).alias("score")))
    if rows.count() <= ALONE:
        grown = {k: m for x in _histograms(rows, models, p, first, True).collect() for k, m in pickle.loads(x["found"]).items()}
        return [grown.get(k, m) for k, m in enumerate(models)]
    passes = 0
    while not all(m.ends() for m in models):
        total: dict[int, list] = {}
        for x in _histograms(rows, models, p, first, False).collect():  # one row per task
            for k, (n, r) in pickle.loads(x["found"]).items():
                total[k] = [total[k][0] + n, total[k][1] + r] if k in total else [n, r]
        for k, (n, r) in total.items():
            _grow(models[k], n, r)
        passes += 1
        if passes % WRITE == 0:
            rows = written(_scored(rows, models, p))
            for m in models:
                m.fresh = []
    return models


def boosted_folds(rows: DataFrame, features: list[str], seasons: list[int], folder: str, budgets: list[Budget] = BUDGETS, first: int | None = None, label: str = "game_id") -> DataFrame:
    """(game_id, season, actual, budget, trained_on, prediction): every season predicted by boosted trees fitted on the seasons before it.

    rows: game_id, season, actual, features. Rows without actual train nothing and are predicted; missing and non-finite features have a bin of
    their own below all others; a season without training rows gets none. No row or value of a season changes what an earlier one is given.
    Intermediate tables go to folder, which all executors share.
    """
    found = edges(rows if first is None else rows.where(F.col("season") >= first), features, min(seasons))
    bins, p = binned(rows, features, found, label), len(features)
    models = boosted_models(bins, p, seasons, list(budgets), folder, first)
    asked = bins.where(F.col("season").isin(seasons))
    kind = dict(asked.dtypes)[label]

    def alike(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different rows of bins, and the place of each row among them."""
        if not p:
            return cols, slice(None)
        own, place = np.unique(cols, axis=1, return_inverse=True)
        return np.ascontiguousarray(own), place.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):  # a step down a tree costs a few calls, however few rows
            season, cols = batch.column(1).to_numpy(), _matrix(batch, p)
            for m in models:
                on = np.flatnonzero(season == m.fold)
                if len(on):
                    take = batch.take(pa.array(on))
                    own, place = alike(cols[:, on])
                    score = m.base + m.scores(own, m.trees)[place]
                    yield pa.RecordBatch.from_arrays(
                        [take.column(0), take.column(1), take.column(2), pa.array([m.budget.name] * len(on)), pa.array(np.full(len(on), m.trained_on)), pa.array(score)],
                        [label, "season", "actual", "budget", "trained_on", "prediction"],
                    )

    return asked.mapInArrow(run, f"{label} {kind}, season long, actual double, budget string, trained_on long, prediction double")


def market_trees(rows: DataFrame, features: list[str], market: str, seasons: list[int], first: int, folder: str, budget: Budget = BUDGETS[0]) -> DataFrame:
    """Two tree models of every season from `first` on: on what the market's number leaves over, and on the target with that number as a feature."""
    rest = boosted_folds(rows.withColumn("actual", F.col("actual") - F.col(market)), features, seasons, folder, [budget], first)
    own = rows.select("game_id", F.col(market).cast("double").alias("_m"), F.col("actual").cast("double").alias("_a"))
    rest = rest.join(own, "game_id").select("game_id", "season", F.col("_a").alias("actual"), "trained_on", (F.col("prediction") + F.col("_m")).alias("prediction"), F.lit("residual").alias("variant"))
    both = boosted_folds(rows, [*features, market], seasons, folder, [budget], first)
    return rest.unionByName(both.drop("budget").withColumn("variant", F.lit("market_as_feature")))
