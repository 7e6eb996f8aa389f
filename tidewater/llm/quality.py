"""Quality classifier: random Fourier features, ridge from summed normal equations, isotonic calibration.

Statistics of a document pass through random cosines, whose inner products approximate a Gaussian kernel. Tasks sum
their rows' normal equations, so what reaches the driver has the size of the features, not of the data. A
second, disjoint part of the labelled rows gives the calibration: raw scores are counted in bins, and adjacent
bins are pooled until the share of label 1 grows with the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import NULL_ID, ROW, blocks, cut, numbered, real_id, texts

#: Random features, ridge penalty per row, kernel width in standard deviations, bins of the calibration.
FEATURES, PENALTY, WIDTH, BINS = 256, 1e-4, 2.5, 512
#: A model is fitted on at most about this many labelled rows, chosen by the hash of their ids.
MOST_LABELLED = 400_000
#: Tasks that sum normal equations; each sends one matrix of FEATURES squared.
SUMS = 8
THRESHOLD = 0.3
SEED = 7

_LINES = re.compile(r"[^\n]+")
NAMES = [
    "log_chars", "log_words", "mean_word", "distinct_words", "top_word", "repeat_next", "upper", "digit", "mark", "odd_mark", "space",
    "word_end_mark", "pipe", "line_length", "distinct_lines", "short_words", "long_words", "letters", "sentence_ends", "distinct_pairs", "all_upper",
]


def statistics(text: str) -> list[float]:
    """Numbers that describe a text: its length, its words and how they repeat, its characters, its lines."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = _LINES.findall(text)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.bincount(_KIND[np.minimum(raw, 255)], minlength=8) / chars
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(text)), np.log1p(len(words)), size.mean(), len(counts) / n ** 0.8, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words[1:], words)) / n, kind[1], kind[2], kind[3], kind[4], kind[5],
        sum(not w[-1].isalnum() for w in words) / n, text.count("|") / n, np.log1p(chars / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), float((size <= 3).mean()), float((size >= 9).mean()), kind[0],
        sum(w[-1] in ".!?" for w in words) / n, pairs / max(1, n - 1), sum(w.isupper() for w in words) / n,
    ]


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: lower-case letters and everything above Latin-1
    for c in range(256):
        s = chr(c)
        kind[c] = 5 if s.isspace() else 1 if s.isupper() else 2 if s.isdigit() else 0 if s.isalpha() else 3 if s in ".,;:!?'\"()-" else 4
    return kind


_KIND = _kinds()


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, x, *more): the statistics of every row's whole text; more names columns of docs, integers, to go with it."""
    names = ["id", "x", *more]
    schema = "id long, x array<double>" + "".join(f", `{name}` long" for name in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, values in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.nan_to_num(np.array([statistics(t) for t in values], np.float64).reshape(-1, len(NAMES)))
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(NAMES))
                carried = [c.slice(at, len(ids)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), *carried], names)
                at += len(ids)

    return texts(docs, id_col, text_col, *more).mapInArrow(run, schema)


class Model:
    """Standardising, random cosines, ridge weights, calibration knots."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0.0, 1.0 / width, (len(mean), features)) / np.sqrt(len(mean) / 8)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.knots = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: knots (mean x, share) of blocks whose share grows. Input is sorted by x, one entry per bin."""
    stack: list[list[float]] = []
    for a, p, n in zip(x, positive, total):
        stack.append([a * n, p, n])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            last = stack.pop()
            stack[-1] = [s + t for s, t in zip(stack[-1], last)]
    s = np.array(stack)
    return s[:, 0] / s[:, 2], s[:, 1] / s[:, 2]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
    return x, batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)


def fit(stats: DataFrame, labelled: DataFrame, features: int = FEATURES, most: int = MOST_LABELLED) -> Model:
    """A model from (id, x) and (id, y); ids whose fold is 4 calibrate, the others fit the ridge. See MOST_LABELLED for the bound.

    Without labelled rows, or with one label only, every score is the share of label 1 (one half without any).
    """
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # bounded by `most` rows; in an order of their own, so that reruns sum alike
    data = cut(stats.join(labelled, "id").repartition(SUMS, "id").sortWithinPartitions("id", "x"), "labelled")
    tune, hold = data.where("fold <> 4"), data.where("fold = 4")
    size = len(NAMES)
    sums = tune.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]).first()
    if not sums[0]:
        return Model(np.zeros(size), np.ones(size), features)
    model = Model(np.round(np.array(sums[1 : size + 1], float), 9), np.round(np.array(sums[size + 1 :], float), 9), features)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            x, y = _rows(batch)
            phi = model.phi(x)
            total += phi.T @ np.hstack([phi, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    total = sum(np.frombuffer(r["s"]).reshape(features + 1, features + 2) for r in tune.mapInArrow(normal, "s binary").collect())  # SUMS matrices
    n = total[-1, -2]
    penalty = np.eye(features + 1) * PENALTY * n
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    used = hold if hold.limit(1).count() else tune

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((3, BINS))
        for batch in batches:
            x, y = _rows(batch)
            raw = model.raw(x)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            for row, w in enumerate((raw, y, np.ones(len(y)))):
                np.add.at(count[row], at, w)
        yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary())], ["s"])

    count = sum(np.frombuffer(r["s"]).reshape(3, BINS) for r in used.mapInArrow(bins, "s binary").collect())
    full = count[2] > 0
    raw, positive, seen = count[0][full] / count[2][full], count[1][full], count[2][full]
    knots = isotonic(raw, positive, seen)
    model.knots = np.concatenate([[-1.0], knots[0], [2.0]]), np.concatenate([[max(0.0, knots[1][0] - 1e-3)], knots[1], [min(1.0, knots[1][-1] + 1e-3)]])
    return model


def fold(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; score: 0 to 1, higher where label 1 is likelier.

    Labels teach only where crc32(doc_id) mod 5 is not 0; held_out marks the rest. Scores come from the text alone: null and
    empty texts have the statistics of an empty one. Null labels and ids teach nothing, of labels that repeat an id the largest counts; repeated rows are
    scored each, a null id stays null (not held out); empty tables are fine; other columns are not read.
    """
    stats = cut(document_statistics(docs, id_col, text_col), "statistics")
    held = F.when(F.col("id") == NULL_ID, False).otherwise(fold(F.col("id")) == 0)
    got = _scores(stats, labels, label, ["id"])
    return got.select(real_id("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores(stats: DataFrame, labels: DataFrame, label: str, carry: list[str]) -> DataFrame:
    """(*carry, score) for every row of the statistics; carry names columns of theirs, integers."""
    key = F.col("doc_id").cast("long")
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(key.alias("id")).agg(F.max(label).cast("double").alias("y"))
    taught = taught.withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    model = fit(stats.select("id", "x"), taught)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.round(model.score(x), 9))], [*carry, "score"])

    return stats.select("x", *carry).mapInArrow(run, "".join(f"`{name}` long, " for name in carry) + "score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects, all columns kept.

    Every row goes or stays by its own text: a null text counts as empty, equal texts share their verdict, repeated
    rows stay as often as they are there, and neither null nor repeated ids touch other rows. Texts of any length
    are read whole. Without usable labels every score is one half, so all rows stay at the threshold used here. An empty table
    gives an empty one; other columns may have any name but those of ROW.
    """
    rows = numbered(docs)
    stats = cut(document_statistics(rows, id_col, text_col, *ROW), "statistics")
    bad = _scores(stats, labels, label, ROW).where(F.col("score") < threshold).select(*ROW)
    return rows.join(bad, ROW, "left_anti").drop(*ROW)
