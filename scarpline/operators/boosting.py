"""Multiclass gradient boosting on binned features, several settings at once.

Features are cut at approximate quantiles into at most ``BINS`` bins. A round
grows one tree per class on the softmax gradients, level by level: one pass
over the binned rows adds up gradient and second-derivative sums per (model,
class, node, feature, bin), tasks reduce them, and the driver picks the split
of every node. One pass serves all classes of all models, so a grid over folds
and settings costs as many passes as its largest model. The driver only sees
those sums; their number depends on the models, not on the rows.

Rows are held in blocks, one record a block, whose columns lie together, so a
pass costs little more than its sums. Scores of the finished rounds are stored
with the rows every ``REFRESH`` rounds; the rounds since then are recomputed in
each pass, all their trees at once (``Walk``). Features are looked up and summed
two by two: a pair has ``BINS`` x ``BINS`` bins, whose sums over either side
are those of its features.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from scarpline.sources import shared

# The functions below travel to the workers by value: these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
REFRESH = 5
SMOOTH = 1.0  # added to the second derivatives of a leaf
LEAST_WEIGHT = 1.0  # second-derivative sum that both sides of a split need
QUANTILE_ERROR = 0.001
DIRECT = 64  # tasks whose sums go straight to the driver
BLOCK_ROWS, BLOCK_BYTES = 8_192, 1 << 20  # most rows and bytes of scores of a block
# Blocks are large records: few at a time are read and sent, and scores hardly compress.
READING = {
    "spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.compression.codec": "none",
}


@dataclass
class Tree:
    """A perfect binary tree on bins: feature and last left bin per inner node, value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Place of every row of bins among the nodes of a level (the leaves by default); fastest if the columns of ``x`` lie together."""
        depth = int(np.log2(len(self.feature) + 1)) if depth is None else depth
        at, turns = np.zeros(len(x), dtype=np.uint8 if depth <= 8 else np.int64), []
        for level in range(depth):
            right = [x[:, f] > c for f, c in zip(*(v[2**level - 1 : 2 ** (level + 1) - 1] for v in (self.feature, self.cut.astype(np.uint8))), strict=True)]
            for turn in reversed(turns):  # of each two nodes the one that the row went to
                right = [a ^ (turn & (a ^ b)) for a, b in zip(right[::2], right[1::2], strict=True)]
            turns.append(right[0])
            at += at
            at |= right[0].view(np.uint8)
        return at.astype(np.int64)


def pair_bins(x: np.ndarray) -> np.ndarray:
    """(pair, row): joint bins of each two features; ``x``: (feature, row). A last feature alone is paired with zeros."""
    out = x[::2].astype(np.int64) * BINS
    out[: len(x) // 2] += x[1::2]
    return out


class Walk:
    """Values of many small trees at once, by bits.

    Bit i of a byte stands for leaf i of a tree. A bin of a feature leaves the
    leaves that its nodes can still reach; what all features leave is one leaf.
    """

    DEPTH = 3  # a byte has eight leaves
    ROWS = 2_048  # rows walked at a time, so that their bytes stay in the processor's cache
    ROUNDS = 10

    def __init__(self, rounds: list[list[Tree]], features: int):
        """``rounds``: of each round the trees of all scores."""
        self.parts = [self._tables(rounds[i : i + self.ROUNDS], features) for i in range(0, len(rounds), self.ROUNDS)]

    @classmethod
    def _tables(cls, rounds: list[list[Tree]], features: int) -> tuple[list[np.ndarray], np.ndarray] | list[list[Tree]]:
        trees = [t for grown in rounds for t in grown]
        if any(len(t.value) > 2**cls.DEPTH for t in trees):
            return rounds
        nodes, leaves, every = 2**cls.DEPTH - 1, 2**cls.DEPTH, np.arange(len(trees))
        feature, cut, value = np.zeros((len(trees), nodes), np.int64), np.full((len(trees), nodes), 255), np.zeros((len(trees), 256))
        for i, t in enumerate(trees):  # a shorter tree goes left below its ends
            feature[i, : len(t.feature)], cut[i, : len(t.cut)] = t.feature, t.cut
            value[i, 1 << (np.arange(len(t.value)) * (leaves // len(t.value)))] = t.value
        reach = np.full((features + features % 2, BINS, len(trees)), 255, np.uint8)
        for node in range(nodes):
            level = (node + 1).bit_length() - 1
            half = leaves >> (level + 1)  # leaves of either side
            left = ((1 << half) - 1) << ((node + 1 - 2**level) * 2 * half)
            right = np.arange(BINS) > cut[:, node, None]
            reach[feature[:, node], :, every] &= np.where(right, 255 ^ left, 255 ^ (left << half)).astype(np.uint8)
        pairs = [(a[:, None] & b).reshape(BINS * BINS, len(trees)) for a, b in zip(reach[::2], reach[1::2], strict=True)]
        return pairs, value

    def add(self, s: np.ndarray, x: np.ndarray, pairs: np.ndarray) -> None:
        """Adds the values of every row to ``s`` (score, row). ``x``: (feature, row) and ``pairs``: its joint bins."""
        for part in self.parts:
            if isinstance(part, list):
                for grown in part:
                    for k, t in enumerate(grown):
                        s[k] += t.value[t.leaves(x.T)]
                continue
            tables, value = part
            for at in range(0, s.shape[1], self.ROWS):
                own = pairs[:, at : at + self.ROWS]
                left = tables[0].take(own[0], axis=0)
                for table, places in zip(tables[1:], own[1:], strict=True):
                    left &= table.take(places, axis=0)
                left, to = np.ascontiguousarray(left.T), s[:, at : at + self.ROWS]
                for i in range(len(value)):
                    to[i % len(s)] += value[i].take(left[i])


def empty_tree(depth: int) -> Tree:
    """All rows go left and score nothing."""
    return Tree(np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255, dtype=np.int64), np.zeros(2**depth))


@dataclass(frozen=True)
class Setting:
    """Depth and rate of a model, and the fold that its training leaves out (None: no fold)."""

    depth: int
    rate: float
    without: int | None = None


@dataclass
class Trained:
    """Per setting the rounds of one tree per class."""

    edges: list[np.ndarray]
    labels: tuple[str, ...]
    rounds: dict[Setting, list[list[Tree]]] = field(default_factory=dict)


def quantile_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature, from an approximate quantile sketch."""
    shares = [i / bins for i in range(1, bins)]
    return [np.unique(q) for q in rows.approxQuantile(features, shares, QUANTILE_ERROR)]


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, one row per record; values that are no number fall in the first bin."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), dtype=np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        c = np.asarray(c, dtype=np.float64)
        out[:, i] = np.where(np.isnan(c), 0, np.searchsorted(e, c, side="left"))
    return out


def block_rows(scores: int) -> int:
    """Rows of a block whose rows have so many scores."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * scores)))


def softmax(scores: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


@contextmanager
def _reading(spark: SparkSession) -> Iterator[None]:
    """The session's settings for blocks, and then those from before."""
    before = {k: spark.conf.get(k) for k in READING}
    try:
        for k, v in READING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Rows:
    """Blocks of the binned rows with the scores of all models: x, y, fold, s. No scores yet: s is empty.

    Stored scores are those of the other classes less that of the first: only differences matter.
    """

    def __init__(self, df: DataFrame, settings: list[Setting], classes: int, features: int):
        self.df, self.settings, self.classes, self.features = df, settings, classes, features
        self.tasks = df.rdd.getNumPartitions()

    def _scored(self, pending: list[list[list[Tree]]]):
        """Decodes the blocks of batches and adds the rounds that are not stored yet: x (feature, row), pairs (pair, row), y, fold, s (model, class, row)."""
        models, classes, features = len(self.settings), self.classes, self.features

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, tuple[np.ndarray, ...]]]:
            walk = Walk([[t for model in grown for t in model] for grown in pending], features)
            for batch in batches:
                for i, packed in enumerate(zip(*batch.columns, strict=True)):
                    x, y, fold, s = (np.frombuffer(v.as_buffer(), dtype=kind) for v, kind in zip(packed, ("u1", "<i4", "<i4", "<f4"), strict=True))
                    x = x.reshape(features, len(y))
                    pairs, scores = pair_bins(x), np.zeros((models, classes, len(y)))
                    if len(s):
                        scores[:, 1:] = s.reshape(models, classes - 1, len(y))
                    walk.add(scores.reshape(models * classes, len(y)), x, pairs)
                    yield batch, i, (x, pairs, y, fold, scores)

        return decode

    def store(self, pending: list[list[list[Tree]]]) -> None:
        """Write the rows anew with the pending rounds added to their scores."""
        decode = self._scored(pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, i, (*_, s) in decode(batches):
                columns = [batch.column(c).slice(i, 1) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([(s[:, 1:] - s[:, :1]).astype("<f4").tobytes()], pa.binary())], names=["x", "y", "fold", "s"])

        with _reading(self.df.sparkSession):
            before, self.df = self.df, shared.store(self.df.mapInArrow(run, self.df.schema), "boosting")
        shared.remove(before)

    def sums(self, pending: list[list[list[Tree]]], growing: list[list[Tree]], level: int, active: list[int]) -> np.ndarray:
        """(model, class, node, feature, bin, 2): gradient and second-derivative sums of a level."""
        decode, classes, features, settings = self._scored(pending), self.classes, self.features, self.settings
        nodes = 2**level
        shape = (len(active), classes, nodes, features, BINS, 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joint = (features + 1) // 2
            out = np.zeros((len(active), classes, joint, nodes * BINS * BINS), np.complex128)  # gradient and second derivative
            for _, _, (x, pairs, y, fold, s) in decode(batches):
                used: dict[int | None, tuple] = {}  # rows of a training part, the same for all its models
                for a, m in enumerate(active):
                    without = settings[m].without
                    if without not in used:
                        use = slice(None) if without is None else np.flatnonzero(fold != without)
                        used[without] = use, x[:, use].T, pairs[:, use], y[use]
                    use, own, bins, hot = used[without]
                    p = softmax(s[m] if without is None else s[m].take(use, axis=1), axis=0)
                    for k in range(classes):
                        both = np.empty(len(hot), np.complex128)
                        np.subtract(p[k], hot == k, out=both.real)
                        np.maximum(p[k] * (1 - p[k]), 1e-16, out=both.imag)
                        at = growing[m][k].leaves(own, level) * BINS**2 if level else 0
                        for i in range(joint):
                            np.add.at(out[a, k, i], bins[i] + at, both)
            grid = out.reshape(len(active), classes, joint, nodes, BINS, BINS)
            whole = np.stack([grid.sum(axis=5), grid.sum(axis=4)], axis=3).reshape(len(active), classes, 2 * joint, nodes, BINS)[:, :, :features]
            whole = np.stack([whole.real, whole.imag], axis=-1).transpose(0, 1, 3, 2, 4, 5)
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for v in batch.column(0):
                    out += np.frombuffer(v.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = self.df.mapInArrow(run, "sums binary")
        if self.tasks > DIRECT:  # sums of many tasks are added in tasks first
            slot = F.pmod(F.spark_partition_id(), F.lit(int(self.tasks**0.5)))
            parts = parts.repartition(int(self.tasks**0.5), slot).mapInArrow(add, "sums binary")
        with _reading(self.df.sparkSession):
            found = parts.toArrow().column(0)
        return sum((np.frombuffer(v.as_buffer()).reshape(shape) for v in found), np.zeros(shape))


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and the (g, h) sums of both sides for every node; ``sums``: (node, feature, bin, 2).

    A node without a worthwhile split sends all rows left. Equal gains take the
    first feature and bin.
    """
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    worth = lambda v: v[..., 0] ** 2 / (v[..., 1] + SMOOTH)
    gain = worth(left) + worth(right) - worth(whole)
    gain = np.where((left[..., 1] >= LEAST_WEIGHT) & (right[..., 1] >= LEAST_WEIGHT), gain, -np.inf)
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(sums))
    feature, cut = best // sums.shape[2], best % sums.shape[2]
    one, two = left[rows, feature, cut], right[rows, feature, cut]
    none = ~(flat[rows, best] > 1e-9)
    feature, cut = np.where(none, 0, feature), np.where(none, 255, cut)
    one = np.where(none[:, None], whole[:, 0, 0], one)
    two = np.where(none[:, None], 0.0, two)
    return feature, cut, one, two


def train(rows: DataFrame, features: list[str], label: Column, labels: tuple[str, ...], settings: list[Setting], rounds: int, fold: Column | None = None) -> Trained:
    """Train all settings over the same passes. ``label`` is the index of the class; rows without one are left out."""
    edges = quantile_edges(rows, features)
    models, classes = len(settings), len(labels)

    size = block_rows(models * classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                x = to_bins([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(edges))], edges)
                y, fold = (batch.column(len(edges) + i).to_numpy(zero_copy_only=False).astype("<i4") for i in (0, 1))
                packed = [x.T.tobytes(), y.tobytes(), fold.tobytes(), b""]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed], names=["x", "y", "fold", "s"])

    chosen = rows.select(*[F.col(c).cast("double") for c in features], label.cast("int").alias("y"), F.coalesce((F.lit(-1) if fold is None else fold).cast("int"), F.lit(-1)).alias("fold"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if chosen.rdd.getNumPartitions() < cores:  # every pass reads these rows, so a small table is spread once
        chosen = chosen.repartition(cores)
    binned = shared.store(chosen.filter("y IS NOT NULL").mapInArrow(run, "x binary, y binary, fold binary, s binary"), "boosting")
    data = _Rows(binned, settings, classes, len(features))
    out = Trained(edges, tuple(labels), {s: [] for s in settings})
    pending: list[list[list[Tree]]] = []
    for _ in range(rounds):
        growing = [[empty_tree(s.depth) for _ in labels] for s in settings]
        for level in range(max(s.depth for s in settings)):
            active = [m for m, s in enumerate(settings) if s.depth > level]
            sums = data.sums(pending, growing, level, active)
            for a, m in enumerate(active):
                for k in range(classes):
                    tree, first = growing[m][k], 2**level - 1
                    feature, cut, one, two = best_splits(sums[a, k])
                    tree.feature[first : first + 2**level], tree.cut[first : first + 2**level] = feature, cut
                    if level == settings[m].depth - 1:
                        ends = np.stack([one, two], axis=1).reshape(-1, 2)
                        tree.value[:] = -settings[m].rate * ends[:, 0] / (ends[:, 1] + SMOOTH)
        for m, s in enumerate(settings):
            out.rounds[s].append(growing[m])
        pending.append(growing)
        if len(pending) == REFRESH:
            data.store(pending)
            pending = []
    return out


# --- scoring -------------------------------------------------------------------------


@dataclass(frozen=True)
class SoftmaxModel:
    """Trees of one setting, one per class and round."""

    labels: tuple[str, ...]
    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    rounds: tuple[tuple[Tree, ...], ...]

    @property
    def members(self) -> tuple[tuple[Tree, ...], ...]:
        """The trees of every class."""
        return tuple(tuple(r[k] for r in self.rounds) for k in range(len(self.labels)))

    def first(self, rounds: int) -> SoftmaxModel:
        """The model as it was after so many rounds."""
        return SoftmaxModel(self.labels, self.features, self.edges, self.rounds[:rounds])

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        x = np.ascontiguousarray(to_bins(columns, list(self.edges)).T)
        s = np.zeros((len(self.labels), x.shape[1]))
        Walk([list(grown) for grown in self.rounds], len(x)).add(s, x, pair_bins(x))
        return softmax(s, axis=0).T

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``class_probability``, in the order of the labels, and ``predicted``."""

        @pandas_udf("array<double>")
        def shares(features: pd.DataFrame) -> pd.Series:
            return pd.Series(list(self.probabilities([features[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in features.columns])))

        scored = df.withColumn("class_probability", shares(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])))
        best = F.array_position("class_probability", F.array_max("class_probability")).cast("int")
        return scored.withColumn("predicted", F.element_at(F.array(*[F.lit(x) for x in self.labels]), best))

    def save(self, path: str) -> None:
        """Labels, edges and trees below one folder; an earlier model there is replaced."""
        spark = SparkSession.getActiveSession()
        put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        put(list(enumerate(self.labels)), "place int, label string", "labels")
        put([(i, f, e.tolist()) for i, (f, e) in enumerate(zip(self.features, self.edges, strict=True))], "place int, feature string, edges array<double>", "edges")
        trees = [(i, k, t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for i, grown in enumerate(self.rounds) for k, t in enumerate(grown)]
        put(trees, "round int, class int, feature array<bigint>, cut array<bigint>, value array<double>", "trees")

    @classmethod
    def load(cls, path: str) -> SoftmaxModel:
        """A stored model; its rows number classes, features and trees."""
        read = lambda name, *order: SparkSession.getActiveSession().read.parquet(f"{path}/{name}").orderBy(*order).collect()
        labels, edges, trees = read("labels", "place"), read("edges", "place"), read("trees", "round", "class")
        grown = [Tree(np.array(r["feature"]), np.array(r["cut"]), np.array(r["value"])) for r in trees]
        n = len(labels)
        return cls(tuple(r["label"] for r in labels), tuple(r["feature"] for r in edges), tuple(np.array(r["edges"]) for r in edges), tuple(tuple(grown[i : i + n]) for i in range(0, len(grown), n)))


def model_of(trained: Trained, setting: Setting, features: list[str]) -> SoftmaxModel:
    return SoftmaxModel(trained.labels, tuple(features), tuple(trained.edges), tuple(tuple(r) for r in trained.rounds[setting]))
