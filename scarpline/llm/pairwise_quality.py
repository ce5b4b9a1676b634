"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of text features. Each pair of a
preferred and a rejected labelled document asks that the first be stronger;
the weights minimise the logistic loss on feature differences (Newton steps
with a ridge). Strengths are then cut at a score quantile: the one that
rejects as large a share of the fitted sample as the labels reject. The score
is a logistic curve through ``CUT`` at that quantile.

Fitting reads a bounded sample of labelled rows (``sample`` of each class,
chosen by a hash of the id); features are computed in tasks, only they reach
the driver. Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scarpline.llm import common

CUT = 0.3
SAMPLE = 8_000  # labelled rows of each class
PAIRS_PER_ROW = 6
RIDGE = 1e-3

_GROUPS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "blank": b" \t", "line": b"\n",
    "stop": b".,;:'\"()-", "shout": b"!?", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "bar": b"|", "high": bytes(range(128, 256)),
}
FEATURES = (
    *_GROUPS, "log_bytes", "log_words", "mean_word", "long_word", "distinct", "top_word", "twice", "short_word",
    "capital_word", "mark_end", "repeated_line", "short_line", "spread_word",
)


def features(text: bytes) -> list[float]:
    """Numbers between about 0 and 1 that describe a whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    n = max(len(text), 1)
    shares = [float(counts[list(g)].sum()) / n for g in _GROUPS.values()]
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    k = max(len(lines), 1)
    return [
        *shares, math.log1p(len(text)) / 12, math.log1p(len(words)) / 10, min(float(lengths.mean()), 30) / 30,
        float((lengths > 15).sum()) / m, len(seen) / m ** 0.8, (seen.most_common(1)[0][1] / m if seen else 0.0),
        sum(map(bytes.__eq__, words, words[1:])) / m, float((lengths < 3).sum()) / m,
        sum(w[:1].isupper() for w in words) / m, sum(w[-1:] in b"!*$%&#|" for w in words) / m,
        1 - len(set(lines)) / k if lines else 0.0, sum(len(x) < 40 for x in lines) / k, min(float(lengths.std()), 30) / 30,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, rejected_share: float, pairs_per_row: int = PAIRS_PER_ROW) -> Model:
    """Weights from pairs of each row with rows of the other class; no pairs give weights of zero."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    preferred, rejected = np.flatnonzero(good), np.flatnonzero(~good)
    weights = np.zeros(x.shape[1])
    if len(preferred) and len(rejected):
        draw = np.random.default_rng(7)
        n = pairs_per_row * max(len(preferred), len(rejected))
        d = z[draw.choice(preferred, n)] - z[draw.choice(rejected, n)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(d @ weights, -40, 40)))
            gradient = d.T @ (p - 1) / n + RIDGE * weights
            curvature = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(weights))
            step = np.linalg.solve(curvature, gradient)
            weights = weights - step
            if np.abs(step).max() < 1e-6:
                break
    strength = z @ weights
    cut = -math.inf
    if len(preferred) and len(rejected):
        # quantile of the sample, weighted back to the shares of the labels
        share = np.where(good, (1 - rejected_share) / len(preferred), rejected_share / len(rejected))
        order = np.argsort(strength, kind="stable")
        at = int(np.searchsorted(np.cumsum(share[order]), rejected_share))
        at = min(max(at, 0), len(order) - 2)
        cut = float(strength[order[at]] + strength[order[at + 1]]) / 2
    return Model(mean, scale, weights, cut if math.isfinite(cut) else -1.0)


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_rows(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["quality", "x"]
            )

    return rows.select("quality", "text").mapInArrow(run, "quality int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents of each class for which ``learn`` (on doc_id) holds.

    A document with several labels counts once, with the lowest. NULL labels
    or ids are not used.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(learn)
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x sample rows
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = _featured(own.join(chosen, "doc_id")).collect()
    if not rows:
        n = len(FEATURES)
        return Model(np.zeros(n), np.ones(n), np.zeros(n), -1.0)
    x = np.array([r["x"] for r in rows])
    good = np.array([r["quality"] == 1 for r in rows])
    return fit(x, good, totals.get(0, 0) / max(sum(totals.values()), 1))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text (NULL: empty); ``out`` replaces a column of that name."""
    rows = docs.drop(out)
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_rows(batches, text):
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Rows whose id has remainder 0 are held out of the learning. Without labels
    of both classes every score is above the cut. Repeated rows repeat, no
    rows give no rows, other columns are not read.
    """
    held_out = common.id_remainder("doc_id") == 0
    model = train(docs, labels, ~held_out, sample, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = score(rows, model).drop("text")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
