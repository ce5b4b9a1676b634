"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are chosen far apart from a bounded sample. A vector
is described by its ``PREFIX`` nearest pivots; its inverted lists are those of
every choice of ``SHARED`` of them, so two vectors meet in a list exactly when
they share that many pivots. A pair that shares more meets in several lists and
is judged only in the list of its smallest shared pivots. Every pair so found
is verified by its cosine in double precision. All rows are indexed; only the
pivots come from the sample. Vectors near each other but with fewer common
pivots are missed; the tests measure the recall against brute force.

Crowded places. Vectors with the same pivots are first gathered into balls of
at most half the angle of the threshold: all members of a ball link with each
other by the triangle inequality, so their links are counted, not listed. Lists
then hold balls. Two balls link wholly, not at all, or are compared member by
member. Lists longer than ``BLOCK`` balls are dealt as pairs of blocks. Tasks
return link counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scarpline.llm import common

SAMPLE = 2_000  # rows that the pivots are chosen from
PIVOTS, PREFIX, SHARED = 256, 6, 3
APART = 0.5  # largest cosine of two pivots
BLOCK = 1_024  # rows of one side of a comparison
SHORT = 16  # balls of a list whose pairs are compared together with those of other lists
SLACK = 1e-6  # radians within which bounds are not trusted


# Vectors


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the usable vectors of a batch, by length."""
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[: len(column)]
    sizes = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), 0)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        rows = flat[starts[at][:, None] + np.arange(size)]
        usable = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
        if usable.any():
            yield at[usable], rows[usable]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), kind) for v in column])


def choose_pivots(sample: np.ndarray, count: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample at most ``apart`` alike, filled up with random directions."""
    size = sample.shape[1]
    kept = np.empty((0, size))
    for x in _unit(sample) if len(sample) else ():
        if len(kept) < count and (not len(kept) or (kept @ x).max() <= apart):
            kept = np.vstack([kept, x])
    return np.vstack([kept, _random_pivots(size, count)])[:count]


def _random_pivots(size: int, count: int) -> np.ndarray:
    return _unit(np.random.default_rng(size).normal(size=(count, size)))


def _pivots(rows: DataFrame) -> np.ndarray | None:
    """Pivots from the rows of smallest content hash, so that partitions do not matter."""
    filled = rows.filter(F.size("v") > 0).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow()
    found = [m for c in filled.column(0).chunks for _, m in _matrices(c)]
    if not found:
        return None
    size = Counter({s: sum(len(m) for m in found if m.shape[1] == s) for s in {m.shape[1] for m in found}}).most_common(1)[0][0]
    return choose_pivots(np.concatenate([m for m in found if m.shape[1] == size]))


def prefixes(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each row, ascending."""
    near = np.argsort(-(_unit(rows) @ pivots.T), axis=1, kind="stable")[:, :PREFIX]
    return np.sort(near, axis=1)


def _indexed(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """(row, size, near, vec): the description of every usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, m in _matrices(batch.column(1)):
                size = m.shape[1]
                near = prefixes(m, pivots if size == pivots.shape[1] else _random_pivots(size, PIVOTS))
                columns = [
                    pa.array(ids[at]), pa.array(np.full(len(at), size)), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in m.astype(kind)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "near", "vec"])

    return rows.select("row", "v").mapInArrow(run, "row bigint, size bigint, near array<int>, vec binary")


# Runs of equal keys in sorted partitions


def _per_run(rows: DataFrame, keys: list[str], judge, schema: str) -> DataFrame:
    """``judge(run)`` gives record batches for every run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, keys):
            for low, high in zip(cuts, cuts[1:]):
                yield from judge(rows.slice(low, high - low))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# Balls


def gather(unit: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, centre) of balls of at most that angle that cover all rows, each row once."""
    rest = np.arange(len(unit))
    while len(rest):
        middle = unit[rest].sum(axis=0)
        for centre in (middle, unit[rest[0]]):
            length = np.sqrt((centre * centre).sum())
            inside = _angle(unit[rest] @ (centre / max(length, 1e-300))) <= limit
            if inside.sum() > 1 or centre is not middle:
                break
        inside[0] |= not inside.any()
        members = rest[inside]
        yield members, unit[members[0]] if len(members) == 1 else centre / length
        rest = rest[~inside]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _balls(described: DataFrame, limit: float, kind: str) -> DataFrame:
    """(row, ball, size, near, centre, radius, weight); the last four only where row = ball."""
    groups = described.groupBy("size", "near").agg(F.count(F.lit(1)).alias("n"))
    single = groups.filter("n = 1").select("size", "near")
    alone = described.join(single, ["size", "near"], "left_semi")
    alone = alone.select("row", F.col("row").alias("ball"), "size", "near", F.col("vec").alias("centre"), F.lit(0.0).alias("radius"), F.lit(1).cast("bigint").alias("weight"))
    dealt = described.join(groups.filter("n > 1"), ["size", "near"])
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / BLOCK))
    dealt = dealt.select("row", "size", "near", "vec", F.xxhash64("size", "near").alias("place"), part.alias("part"))

    def judge(run: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, vectors = run.column("row").to_numpy(), run.column("vec").combine_chunks()
        sizes, near = run.column("size").to_numpy(), run.column("near").combine_chunks()
        pivots = np.stack(near.to_numpy(zero_copy_only=False))
        label = np.unique(np.column_stack([sizes, pivots]), axis=0, return_inverse=True)[1].ravel()  # places may share a hash
        for group in range(label.max() + 1):
            own = np.flatnonzero(label == group)
            unit = _unit(_unpacked(vectors.take(pa.array(own)), kind))
            for members, centre in gather(unit, limit):
                whole = len(members)
                if whole > 1:  # the centre as it is stored
                    packed = centre.astype(kind)
                    radius = float(_angle(unit[members] @ _unit(packed[None, :])[0]).max()) + SLACK
                    packed = packed.tobytes()
                else:
                    packed, radius = vectors[int(own[members[0]])].as_py(), 0.0
                if radius > limit + 3 * SLACK:
                    raise ValueError("a stored centre left its ball")
                ids = np.sort(rows[own[members]])
                first = np.arange(whole) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), pa.array(np.full(whole, ids[0])), pa.array(np.full(whole, sizes[own[0]]), mask=~first),
                        pa.array([pivots[own[0]].tolist() if f else None for f in first], pa.list_(pa.int32())),
                        pa.array([packed if f else None for f in first], pa.binary()),
                        pa.array(np.full(whole, radius), mask=~first), pa.array(np.full(whole, whole), mask=~first),
                    ],
                    names=["row", "ball", "size", "near", "centre", "radius", "weight"],
                )

    schema = "row bigint, ball bigint, size bigint, near array<int>, centre binary, radius double, weight bigint"
    return alone.unionByName(_per_run(dealt, ["place", "part"], judge, schema))


# Lists


def _smaller_shared(near: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Bit words of the pivots of each row that are smaller than the largest one chosen for it and not chosen."""
    words = np.zeros((len(near), PIVOTS // 64), dtype=np.uint64)
    counts = (near < chosen[:, -1:]) & (near[:, :, None] != chosen[:, None, :]).all(axis=2)
    at = np.nonzero(counts)
    np.bitwise_or.at(words, (at[0], near[at] // 64), np.uint64(1) << (near[at] % 64).astype(np.uint64))
    return words


def _met(balls: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(what, a, b, n): links of balls. 0: ball a has n links more; 1: a and b are linked; 2: a and b need a closer look."""
    theta = float(np.arccos(threshold))
    choices = list(combinations(range(PREFIX), SHARED))
    lists = [sum(F.col("near")[i].cast("bigint") * PIVOTS**e for e, i in enumerate(c)) for c in choices]
    placed = balls.select("ball", F.explode(F.array(*[l + F.col("size") * PIVOTS**SHARED for l in lists])).alias("list"))
    shared = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = placed.join(shared, "list").select("ball", "list", F.pmod(F.xxhash64("ball"), parts).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    dealt = dealt.select("ball", "list", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    full = dealt.join(balls.select("ball", "near", "centre", "radius", "weight"), "ball")

    def told(*found: tuple[int, np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        what = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int32)
        columns = [np.concatenate([f[i] for f in found]).astype(np.int64) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(what), *map(pa.array, columns)], names=["what", "a", "b", "n"])

    def judged(cosine: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs link wholly, and which need a closer look."""
        angle = _angle(cosine)
        linked = np.where(reach == 0, cosine >= threshold, angle + reach <= theta - SLACK)
        return linked, (reach > 0) & ~linked & (angle - reach <= theta + SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, ["list", "low", "high"]):
            ids, weight, radius, own, low, high, key = (rows.column(c).to_numpy() for c in ("ball", "weight", "radius", "own", "low", "high", "list"))
            unit = _unit(_unpacked(rows.column("centre").combine_chunks(), kind))
            chosen = np.stack([key // PIVOTS**e % PIVOTS for e in range(SHARED)], axis=1)
            words = _smaller_shared(np.stack(rows.column("near").to_numpy()), chosen)
            sizes = np.diff(cuts)
            number = np.repeat(np.arange(len(sizes)), sizes)
            short = ((sizes <= SHORT) & (low[cuts[:-1]] == high[cuts[:-1]]))[number]

            pairs = [np.empty((2, 0), dtype=np.int64)]  # of all short lists of the batch at once
            for lag in range(1, min(SHORT, len(ids))):
                at = np.flatnonzero(short[:-lag] & (number[:-lag] == number[lag:]))
                pairs.append(np.stack([at, at + lag]))
            x, y = np.concatenate(pairs, axis=1)
            first = ((words[x] & words[y]) != 0).any(axis=1)
            x, y = x[~first], y[~first]
            linked, open_ = judged(np.einsum("ij,ij->i", unit[x], unit[y]), radius[x] + radius[y])
            a, b = ids[x], ids[y]
            yield told(
                (0, a[linked], b[linked] * 0, weight[y][linked]), (0, b[linked], a[linked] * 0, weight[x][linked]),
                (1, a[linked], b[linked], a[linked] * 0), (2, a[open_], b[open_], a[open_] * 0),
            )
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end - start < 2 or short[start]:
                    continue
                span = np.arange(start, end)
                one, two = span[own[span] == low[start]], span[own[span] == high[start]]
                if not len(one) or not len(two):
                    continue
                first = np.zeros((len(one), len(two)), dtype=bool)
                for w in words.T:
                    first |= (w[one][:, None] & w[two][None, :]) != 0
                ours = ~first & ((ids[one][:, None] < ids[two][None, :]) if low[start] == high[start] else True)
                linked, open_ = (ours & f for f in judged(unit[one] @ unit[two].T, radius[one][:, None] + radius[two][None, :]))
                count = np.zeros(len(ids), dtype=np.int64)
                np.add.at(count, one, linked @ weight[two])
                np.add.at(count, two, linked.T @ weight[one])
                some = np.flatnonzero(count)
                whole = np.zeros((len(span), len(span)), dtype=bool)
                whole[np.ix_(one - start, two - start)] |= linked
                label = common.spanning(whole | whole.T)
                joined = np.flatnonzero(label != np.arange(len(label)))
                x, y = np.nonzero(open_)
                yield told(
                    (0, ids[some], some * 0, count[some]), (1, ids[span[joined]], ids[span[label[joined]]], joined * 0),
                    (2, ids[one[x]], ids[two[y]], x * 0),
                )

    keys = ["list", "low", "high"]
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "what int, a bigint, b bigint, n bigint")


def _looked_at(pairs: DataFrame, members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(what, a, b, n) of pairs of balls compared member by member. 0: row a has n links more; 1: balls a and b are linked."""
    one, two = (pairs.join(members.withColumnRenamed("ball", side), side).withColumn("second", F.lit(side == "b")) for side in "ab")

    def judge(run: pa.Table) -> Iterator[pa.RecordBatch]:
        second = run.column("second").to_numpy(zero_copy_only=False).astype(bool)
        rows = run.column("row").to_numpy()
        unit = _unit(_unpacked(run.column("vec").combine_chunks(), kind))
        near = unit[~second] @ unit[second].T >= threshold
        if near.any():
            ids = np.concatenate([rows[~second], rows[second], run.column("a").to_numpy()[:1]])
            counts = np.concatenate([near.sum(axis=1), near.sum(axis=0), [0]])
            other = np.where(np.arange(len(ids)) == len(ids) - 1, run.column("b").to_numpy()[0], 0)
            what = (np.arange(len(ids)) == len(ids) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(ids), pa.array(other), pa.array(counts)], names=["what", "a", "b", "n"])

    return _per_run(one.unionByName(two), ["a", "b"], judge, "what int, a bigint, b bigint, n bigint")


def classes(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links join rows whose cosine in double precision reaches ``threshold``
    (0.5 at least). Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing, nor do vectors of different
    length. Rows are told apart by a stored number: repeated ids and repeated
    rows are rows of their own and link, and rows with a NULL id link others.
    The component is the smallest id reached; a row without an id in a
    component without ids has a NULL component and is kept. No rows give no
    rows; other columns are not read.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold must be at least 0.5 and below 1")
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    v = F.col(embedding) if kind == "<f4" else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).withColumn("row", F.monotonically_increasing_id())
    rows = common.stored(rows)
    pivots = _pivots(rows)
    if pivots is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    described = common.stored(_indexed(rows, pivots, kind))
    balls = common.stored(_balls(described, float(np.arccos(threshold)) / 2 - 4 * SLACK, kind))
    heads = balls.filter("row = ball")
    met = common.stored(_met(heads.select("ball", "size", "near", "centre", "radius", "weight"), threshold, kind))
    members = described.join(balls.select("row", "ball"), "row").select("row", "ball", "vec")
    closer = common.stored(_looked_at(met.filter("what = 2").select("a", "b"), members, threshold, kind))
    both = met.filter("what = 1").select("a", "b").unionByName(closer.filter("what = 1").select("a", "b"))
    reached = common.components(both)

    of_ball = met.filter("what = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("ball_links"))
    of_row = closer.filter("what = 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("row_links"))
    known = heads.select("ball", F.col("weight")).join(of_ball, "ball", "left").join(reached.withColumnRenamed("id", "ball"), "ball", "left")
    known = known.select("ball", (F.col("weight") - 1 + F.coalesce("ball_links", F.lit(0))).alias("ball_links"), F.coalesce("component", "ball").alias("part"))
    placed = rows.select("row", "vec_id").join(balls.select("row", "ball"), "row", "left").join(of_row, "row", "left").join(known, "ball", "left")
    placed = common.stored(placed.select("vec_id", (F.coalesce("ball_links", F.lit(0)) + F.coalesce("row_links", F.lit(0))).alias("n_links"), F.coalesce("part", "row").alias("part")))
    least = placed.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "part").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
