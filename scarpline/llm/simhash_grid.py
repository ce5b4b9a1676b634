"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint is cut into segments and each segment is replaced by its number
of set bits. The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints, so it is a lower bound to search by.

Exact search (``link``, ``spanning_links``): segments of two bits, packed in place. The vectors
are cut into ``GROUPS`` groups of segments. Two vectors within Manhattan
distance r differ in at most r groups, so they agree in some choice of
``GROUPS - r`` groups: each choice with its counts is a grid cell, and the
pairs of a cell pass the Manhattan bound and then the exact Hamming distance.
Equal fingerprints are collapsed before. A cell gives edges that span its
groups, so no two fingerprints that links connect come apart.

Similarity search (``near_links``): near-duplicates at similarity 0.8 differ in
about 15 % of the bits, too far for cells that lose nothing. Fingerprints of
shingle sets are as wide as their grid asks for. All rows meet in a coarse grid
first: a cell is the counts of few segments, so few tables have the expected
recall (a parameter) and a row is shuffled few times. A large cell is cut inside
its task by counts of further segments, of the ``REACH_WORDS`` words that a row
brings along. Rows that are left together pass the Manhattan bound of the counts
of these words, then the exact Hamming distance, and are then verified on the
whole shingle sets. Each row is verified with one neighbour first; rows with
several neighbours meet a second time, in a grid of tables of
``table_segments`` segments, where only pairs that these links leave apart are
looked for. There a cell tells of each part its nearest neighbour and one part that it
reaches, so a crowd gives rows in proportion to its size. The nearest are
verified, and what they leave apart is compared in blocks, which return edges
that span the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scarpline.llm import common
from scarpline.operators import skew

SEED = 42
BLOCK = 100_000  # shingles hashed at a time
GROUPS, GROUP_BITS = 8, 8
LOW_BITS = 0x5555555555555555
TABLE_SEGMENTS = 6  # segments of a table of the similarity search, at least
CROWD = 40_000  # unrelated rows that share a cell of a table with a row, on average and at most
TINY = 16  # sets of fewer shingles get further tables
TIES, TINY_TIES = 1.05, 1.24  # how far the share of differing bits exceeds the angle, as even votes count as 0
TINY_TABLE_TIES = 1.32  # the same for agreeing segments: of four and five shingles 0.66 agree
SPREAD = 4.5  # standard deviations that a distance may exceed its expectation
REACH_WORDS, EARLY_WORDS = 4, 2  # words compared, and those first compared alone
NEAR_BLOCK = 524_288  # fingerprints of one side of a cell of the similarity search
COARSER = 2  # segments that a cell of the coarse grid has less than a table
OWN_SEGMENTS, CELL_TABLES = 3, 4  # segments by which a coarse cell is cut, and times it is
CUT_ROWS = 2_048  # rows of a coarse cell that are compared without a cut
TILE = 512  # fingerprints of one side of a comparison inside a cell
SET_BLOCK = 256  # shingle sets of one side of a comparison
GROUP_SHINGLES = 1_000_000  # shingles of one side of a group
ROW_SHINGLES = 50  # shingles that a row counts as besides its own
LINKS = 500_000  # pairs of parts of a cell held at a time
CELL_BITS, BLOCK_BITS = 25, 18  # of a key: the cell and the two blocks that meet
COLUMNS = 4_096  # shingles counted at a time
CELL_BLOCK = 1_024  # fingerprints of one side of a comparison
CELL_SHORT = 16  # fingerprints of a cell whose pairs are compared together with those of other cells


# Fingerprints


def _shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    last = len(words) - k + 1
    if words and last < 1:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    for at in range(0, max(last, 0), BLOCK):
        part = words[at : min(at + BLOCK, last) + k - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(k)], strict=False))
        yield np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """A further 64-bit hash of a hash; number 0 is the hash itself."""
    if i == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, k: int, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set where over half the shingle hashes set it."""
    counts, total = np.zeros(64 * words, dtype=np.int64), 0
    for h in _shingle_hashes(text, k):
        wide = np.stack([_mixed(h, i) for i in range(words)], axis=1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(h), 8 * words), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return np.packbits(2 * counts > total).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every text as a long; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_rows(batches):
            found = [fingerprint(t, k) for t in texts]
            fps = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# Exact search within a small Hamming distance


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed in place."""
    low, high = (F.shiftrightunsigned(fp, n).bitwiseAND(F.lit(LOW_BITS)) for n in (0, 1))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed count vectors (fields hold 0, 1 or 2)."""
    x = a.bitwiseXOR(b)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(LOW_BITS))
    return F.bit_count(x.bitwiseAND(F.lit(LOW_BITS))) + 2 * F.bit_count(high)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def cells(counts: Column, radius: int) -> Column:
    """The cells of a count vector: one for each choice of groups that may agree."""
    out = []
    for number, chosen in enumerate(combinations(range(GROUPS), GROUPS - radius)):
        mask = sum(((1 << GROUP_BITS) - 1) << (GROUP_BITS * g) for g in chosen)
        out.append(F.xxhash64(F.lit(number), counts.bitwiseAND(F.lit(_signed(mask)))))
    return F.array(*out)


def link(fps: DataFrame, radius: int = 4) -> DataFrame:
    """All pairs (a, b) of different fingerprints at most ``radius`` bits apart.

    ``fps`` has distinct non-null longs ``fp``. Needs radius < GROUPS. Lists
    every pair, so it is for data without crowded places; groups need only
    ``spanning_links``.
    """
    placed = fps.select("fp", F.explode(cells(segment_counts(F.col("fp")), radius)).alias("cell"))
    a = placed.select(F.col("fp").alias("a"), "cell")
    b = placed.select(F.col("fp").alias("b"), "cell")
    x, y = F.col("a"), F.col("b")
    bound = manhattan(segment_counts(x), segment_counts(y)) <= radius
    met = a.join(b, "cell").filter((x < y) & bound & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    return met.select("a", "b").distinct()


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _count_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of the bit counts of two-bit segments."""
    low = np.uint64(LOW_BITS)

    def counts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = v & low, (v >> np.uint64(1)) & low
        return one ^ two, one & two

    (a1, a2), (b1, b2) = counts(x), counts(y)
    odd, even = a1 ^ b1, (a2 ^ b2) & ~(a1 ^ b1)  # segments whose counts differ by one, by two
    return _popcount(odd) + 2 * _popcount(even & low)


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints are within the radius: first the distance of their bit counts, then the exact one."""
    out = _count_distance(x, y) <= radius
    return out & (_popcount(x ^ y) <= radius)


def spanning_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most ``radius`` bits connect.

    ``fps`` has distinct non-null longs ``fp``. Needs radius < GROUPS. Each
    cell is judged where its rows meet and ties every fingerprint to the
    smallest that it reaches over links in the cell, so a crowded cell of n fingerprints gives fewer than n rows, not all its
    pairs. Cells of more than ``CELL_BLOCK`` fingerprints are dealt as pairs
    of blocks.
    """
    placed = fps.select("fp", F.explode(cells(segment_counts(F.col("fp")), radius)).alias("cell"))
    large = common.stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_BLOCK))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / CELL_BLOCK)
    dealt = placed.join(large, "cell", "left").select("cell", "fp", F.pmod(F.xxhash64("fp"), parts).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")

    def told(fp: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        joined = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[label[joined]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, ["cell", "low", "high"]):
            fp, own, low, high = (rows.column(c).to_numpy() for c in ("fp", "own", "low", "high"))
            bits, sizes = fp.view(np.uint64), np.diff(cuts)
            number = np.repeat(np.arange(len(sizes)), sizes)
            short = ((sizes <= CELL_SHORT) & (low[cuts[:-1]] == high[cuts[:-1]]))[number]
            pairs = [np.empty((2, 0), dtype=np.int64)]  # of all short cells of the batch at once
            for lag in range(1, min(CELL_SHORT, len(fp))):
                at = np.flatnonzero(short[:-lag] & (number[:-lag] == number[lag:]))
                pairs.append(np.stack([at, at + lag]))
            x, y = np.concatenate(pairs, axis=1)
            near = _near(bits[x], bits[y], radius)
            yield told(fp, common.spanning_pairs(len(fp), x[near], y[near]))
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end - start < 2 or short[start]:
                    continue
                part, own_part = bits[start:end], own[start:end]
                one, two = np.flatnonzero(own_part == low[start]), np.flatnonzero(own_part == high[start])
                whole = np.zeros((len(part), len(part)), dtype=bool)
                if len(one) and len(two):
                    whole[np.ix_(one, two)] |= _near(part[one][:, None], part[two][None, :], radius)
                yield told(fp[start:end], common.spanning(whole | whole.T))

    keys = ["cell", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, k: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    The component is the smallest id reachable over links of fingerprints at
    most ``radius`` bits apart, equal ones included. NULL text is empty; texts
    without words have fingerprint zero and link like any other. Fingerprints
    are the nodes, so a row without an id links others and takes their
    component, NULL where it reaches no id. Repeated rows repeat, no rows give
    no rows, other columns are not read.
    """
    found = common.cut(fingerprints(docs, k, doc_id, text))
    named = common.cut(found.groupBy("fp").agg(F.min("doc_id").alias("node")))
    reached = common.components(spanning_links(named.select("fp"), radius))
    parts = named.join(reached, named["fp"] == reached["id"], "left").select("fp", "node", F.coalesce("component", "fp").alias("part"))
    parts = common.cut(parts)
    least = parts.groupBy("part").agg(F.min("node").alias("component_id"))
    of_fp = parts.join(least, "part").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity


def differing(similarity: float, ties: float) -> float:
    """Largest expected share of differing bits of two sets at the similarity: equal sizes, widened by ``ties``."""
    return ties * math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_segments(rows: int) -> int:
    """Segments of a table; unrelated counts of a segment agree in 3 of 8 cases."""
    return max(TABLE_SEGMENTS, math.ceil(math.log(max(rows, 1) / CROWD) / math.log(8 / 3)))


def agreeing(similarity: float, ties: float) -> float:
    """Share of two-bit segments with equal counts: no bit differs, or both do and change places."""
    p = differing(similarity, ties)
    return (1 - p) ** 2 + p * p / 2


def own_segments(similarity: float, recall: float) -> int:
    """Segments by which coarse cells are cut: fewer than ``OWN_SEGMENTS`` where the words at hand would not do for the recall."""
    agree = agreeing(similarity, TINY_TABLE_TIES)
    return next(n for n in range(OWN_SEGMENTS, -1, -1) if not n or (1 - agree**n) ** (REACH_WORDS * (32 // n)) <= (1 - recall) / 10)


def coarse_words(similarity: float, recall: float, segments: int, ties: float) -> int:
    """Words, besides those at hand, whose coarse cells have the expected recall at exactly the similarity.

    Cells take turns with ``REACH_WORDS * (32 // own) // CELL_TABLES`` sets of
    cuts, so cells with the same cuts fail together where these do.
    """
    agree, own, shared = agreeing(similarity, ties), own_segments(similarity, recall), segments - COARSER
    turns = REACH_WORDS * (32 // own) // CELL_TABLES if own else 1
    uncut = (1 - agree**own) ** CELL_TABLES if own else 0.0
    words, missed = 0, 1.0
    while missed > 1 - recall:
        words += 1
        cells = words * (32 // shared)
        uses = [cells // turns + (t < cells % turns) for t in range(turns)]
        missed = math.prod(uncut + (1 - uncut) * (1 - agree**shared) ** n for n in uses)
    return words


def word_count(similarity: float, recall: float, segments: int, ties: float) -> int:
    """Fingerprint words whose tables, and whose coarse cells, have the expected recall at exactly the similarity."""
    tables = math.log(1 - recall) / math.log(1 - agreeing(similarity, ties) ** segments)
    return max(REACH_WORDS + coarse_words(similarity, recall, segments, ties), math.ceil(tables / (32 // segments)))


def reach(similarity: float, words: int) -> int:
    """Bits that fingerprints of ``words`` words at the similarity may differ in."""
    n, p = 64 * words, differing(similarity, TINY_TIES)
    return math.ceil(n * p + SPREAD * math.sqrt(n * p * (1 - p)))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, no words none."""
    found = list(_shingle_hashes(text, k))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def set_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of a set's fingerprint; a bit is set where over half the shingle hashes set it."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(shingles), 255):  # counts of a stretch fit a byte, eight are added at once
        with np.errstate(over="ignore"):
            z = shingles[at : at + 255, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)


def _signed_rows(rows: DataFrame, k: int, words: int, tiny_words: int) -> DataFrame:
    """(id, digest, n, fp): digest, size and fingerprint of the shingle set. ``rows``: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                (batch, texts), = common.text_rows([whole.slice(at, 500)])
                digests, sizes, fps = [], [], []
                for text in texts:
                    own = shingle_set(text, k)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    fps.append(set_fingerprint(own, tiny_words if len(own) < TINY else words).view(np.int64))
                arrays = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "n", "fp"])

    return rows.mapInArrow(run, "id bigint, digest binary, n bigint, fp array<bigint>")


def table_cells(fp: Column, segments: int) -> Column:
    """The cells of a wide fingerprint: the counts of ``segments`` segments, one cell for each such stretch of a word.

    A cell is the number of its table and the counts below it: few bytes, as each row is shuffled with each of its cells.
    """
    bits, tables = 2 * segments, 32 // segments

    def of_word(w: Column, i: Column) -> Column:
        counts = segment_counts(w)
        own = [F.shiftrightunsigned(counts, bits * t).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) for t in range(tables)]
        return F.array(*[F.shiftleft(i.cast("bigint") * tables + t, bits) + c for t, c in enumerate(own)])

    return F.flatten(F.transform(fp, of_word))


def _met_in_cells(fps: DataFrame, cells: Column, others: list[str]) -> DataFrame:
    """Rows of each cell together, sorted by ``others``: (key, side, id, others, words). ``fps``: id, fp, others.

    Cells of more than ``NEAR_BLOCK`` rows are dealt as pairs of blocks: side 0
    meets side 1; side 2 is both. Their number is bounded by the cells of a table.
    """
    words = [F.col("fp")[i].alias(f"w{i}") for i in range(REACH_WORDS)]
    placed = fps.select("id", *(c for c in others if c != "id"), *words, F.explode(cells).alias("cell"))
    sizes = fps.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    large = common.stored(sizes.filter(F.col("m") > NEAR_BLOCK))
    parts = F.ceil(F.coalesce("m", F.lit(1)) / NEAR_BLOCK)
    own, other = F.col("own"), F.col("other")
    dealt = placed.join(F.broadcast(large), "cell", "left").withColumn("own", F.pmod(F.xxhash64("id"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    key = F.col("cell") + F.shiftleft(F.least(own, other), CELL_BITS) + F.shiftleft(F.greatest(own, other), CELL_BITS + BLOCK_BITS)
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    keep = ["id", *(c for c in others if c != "id"), *(f"w{i}" for i in range(REACH_WORDS))]
    return dealt.select(key.alias("key"), side.alias("side"), *keep).repartition("key").sortWithinPartitions("key", *others)


def _distance(words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum((_popcount(w[x] ^ w[y]) for w in words), np.zeros(len(x), np.int64))


def near_pairs(words: list[np.ndarray], x: np.ndarray, y: np.ndarray, early: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), in order, of different rows ``x[i]``, ``y[j]`` within the radius.

    Few words alone tell most rows apart; of the others first the distance of
    the segment counts, which is never more, and then the exact one is taken.
    """
    i, j = np.nonzero(np.bitwise_count(words[0][x][:, None] ^ words[0][y][None, :]) <= early)
    for w in words[1:EARLY_WORDS]:
        near = np.bitwise_count(w[x[i]] ^ w[y[j]]) <= early
        i, j = i[near], j[near]
    near = x[i] != y[j]
    i, j = i[near], j[near]
    for distance in (_count_distance, lambda a, b: _popcount(a ^ b)):
        near = sum((distance(w[x[i]], w[y[j]]) for w in words), np.zeros(len(i), np.int64)) <= radius
        i, j = i[near], j[near]
    return i, j


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _cut_cell(words: list[np.ndarray], start: int, end: int, number: int, own: int) -> Iterator[np.ndarray]:
    """The places of a coarse cell, if many: those with equal counts in one of ``CELL_TABLES`` tables of ``own`` segments.

    Cells of different ``number`` take turns with the tables of the words at hand.
    """
    places = np.arange(start, end)
    if len(places) <= CUT_ROWS or not own:
        yield places
        return
    low, of_word = np.uint64(LOW_BITS), 32 // own
    for t in range(number * CELL_TABLES, (number + 1) * CELL_TABLES):
        word, at = divmod(t % (len(words) * of_word // CELL_TABLES * CELL_TABLES), of_word)
        w = words[word][start:end] >> np.uint64(2 * own * at)
        one, two = w & low, (w >> np.uint64(1)) & low
        counts = ((one ^ two) | (one & two) << np.uint64(1)) & np.uint64((1 << 2 * own) - 1)
        order = np.argsort(counts, kind="stable")
        yield from np.split(places[order], np.flatnonzero(np.diff(counts[order])) + 1)


def neighbours(fps: DataFrame, segments: int, early: int, radius: int, own: int = OWN_SEGMENTS, coarse: Column | None = None) -> DataFrame:
    """(id, lead, several) of every row with a neighbour: another row of a coarse cell within the radius.

    The lead is the nearest neighbour in most cells; ``several``: there is
    another one. A row is compared until it has two in a cell, so a
    crowd of near rows is not compared pair by pair. Coarse cells are the
    counts of ``segments - COARSER`` segments of ``coarse`` words after those
    that a row brings along (all of them, if not given); ``own``: of ``_cut_cell``.
    """
    shared = segments - COARSER
    beyond = F.slice("fp", REACH_WORDS + 1, F.size("fp") - REACH_WORDS if coarse is None else coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, ["key"]):
            keys, ids, side = (rows.column(c).to_numpy() for c in ("key", "id", "side"))
            words = [rows.column(f"w{i}").to_numpy().view(np.uint64) for i in range(REACH_WORDS)]
            out = [np.empty((3, 0), dtype=np.int64)]
            cells = zip(cuts[:-1].tolist(), cuts[1:].tolist(), ((keys[cuts[:-1]] & ((1 << CELL_BITS) - 1)) >> 2 * shared).tolist())
            for places in (p for start, end, number in cells if end - start > 1 for p in _cut_cell(words, start, end, number, own)):
                if len(places) < 2:
                    continue
                one, two = (places[v] for v in _sides(side[places]))
                for x, y in [(one, two)] if len(one) == len(two) == len(places) else [(one, two), (two, one)]:
                    for at in range(0, len(x), TILE):
                        part = x[at : at + TILE]
                        first, times = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                        least = np.full(len(part), 64 * REACH_WORDS + 1)
                        for other in range(0, len(y), TILE):
                            still = np.flatnonzero(times < 2)
                            if not len(still):
                                break
                            columns = y[other : other + TILE]
                            i, j = near_pairs(words, part[still], columns, early, radius)
                            bits = _distance(words, part[still[i]], columns[j])
                            order = np.lexsort((j, bits, i))
                            got, place, n = np.unique(i[order], return_index=True, return_counts=True)
                            place = order[place]
                            nearer = bits[place] < least[still[got]]
                            first[still[got[nearer]]] = columns[j[place[nearer]]]
                            least[still[got[nearer]]] = bits[place[nearer]]
                            times[still[got]] += n
                        met = times > 0
                        out.append(np.stack([ids[part[met]], ids[first[met]], (times[met] > 1).astype(np.int64)]))
            a, b, several = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(several)], names=["id", "lead", "several"])

    found = _met_in_cells(fps, table_cells(beyond, shared), ["id"]).mapInArrow(run, "id bigint, lead bigint, several bigint")
    found = found.groupBy("id", "lead").agg(F.count(F.lit(1)).alias("m"), F.max("several").alias("several"))
    lead = F.max_by("lead", F.struct("m", -F.col("lead"))).alias("lead")
    return found.groupBy("id").agg(lead, ((F.max("several") > 0) | (F.count(F.lit(1)) > 1)).alias("several"))


def _met_before(words: list[np.ndarray], i: np.ndarray, j: np.ndarray, key: int, segments: int) -> np.ndarray:
    """Whether rows that share the cell of ``key`` share one of an earlier table of the words at hand."""
    bits, tables, low = 2 * segments, 32 // segments, np.uint64(LOW_BITS)
    table = (key & ((1 << CELL_BITS) - 1)) >> bits
    left = np.arange(len(i))
    for t in range(min(table, tables * len(words))):
        a, b = (words[t // tables][v[left]] >> np.uint64(bits * (t % tables)) for v in (i, j))
        (a1, a2), (b1, b2) = ((v & low, v >> np.uint64(1) & low) for v in (a, b))
        apart = ((a1 ^ a2) ^ (b1 ^ b2)) | ((a1 & a2) ^ (b1 & b2))
        left = left[apart & np.uint64((1 << bits) - 1) != 0]
    out = np.ones(len(i), dtype=bool)
    out[left] = False
    return out


def across(fps: DataFrame, segments: int, early: int, radius: int) -> DataFrame:
    """(part, id, nearest, bits, reached): parts with a neighbour in another part, once a cell. ``fps``: id, fp, part.

    A pair of neighbours counts in one cell that they share, with few
    exceptions. ``id`` and ``nearest`` are the nearest such pair of the part in
    the cell, ``bits`` its distance, and ``reached`` the first part of the cell
    that such pairs reach: these edges connect what all those pairs connect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, ["key"]):
            keys, ids, side, parts = (rows.column(c).to_numpy() for c in ("key", "id", "side", "part"))
            words = [rows.column(f"w{i}").to_numpy().view(np.uint64) for i in range(REACH_WORDS)]
            out = [np.empty((5, 0), dtype=np.int64)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if parts[start] == parts[end - 1]:  # sorted by part
                    continue
                size = end - start
                one, two = (v + start for v in _sides(side[start:end]))
                both = len(one) == len(two) == size
                own, number = np.unique(parts[start:end], return_inverse=True)
                far = np.int64(64 * REACH_WORDS + 1) * size * size
                nearest, label = np.full(len(own), far), np.arange(len(own))  # distance and places of a pair as one number
                held = [np.empty((2, 0), dtype=np.int64)]
                for at in range(0, len(one), TILE):
                    x = one[at : at + TILE]
                    for other in range(at if both else 0, len(two), TILE):
                        y = two[other : other + TILE]
                        if parts[x[0]] == parts[x[-1]] == parts[y[0]] == parts[y[-1]]:
                            continue
                        i, j = near_pairs(words, x, y, early, radius)
                        i, j = x[i], y[j]
                        differ = parts[i] != parts[j]
                        i, j = i[differ], j[differ]
                        fresh = ~_met_before(words, i, j, int(keys[start]), segments)
                        i, j = i[fresh], j[fresh]
                        bits = _distance(words, i, j) * size * size
                        i, j = i - start, j - start
                        np.minimum.at(nearest, number[i], bits + i * size + j)
                        np.minimum.at(nearest, number[j], bits + j * size + i)
                        held.append(np.stack([number[i], number[j]]))
                        if sum(h.shape[1] for h in held) > LINKS:
                            label = common.spanning_pairs(len(own), *np.concatenate([*held, [np.arange(len(own)), label]], axis=1))
                            held = held[:1]
                label = common.spanning_pairs(len(own), *np.concatenate([*held, [np.arange(len(own)), label]], axis=1))
                met = np.flatnonzero(nearest < far)
                pair, i = nearest[met] % (size * size), ids[start:end]
                out.append(np.stack([own[met], i[pair // size], i[pair % size], nearest[met] // (size * size), own[label[met]]]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.concatenate(out, axis=1)], names=["part", "id", "nearest", "bits", "reached"])

    return _met_in_cells(fps, table_cells(F.col("fp"), segments), ["part", "id"]).mapInArrow(run, "part bigint, id bigint, nearest bigint, bits bigint, reached bigint")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of shared elements of every set of ``one`` with every set of ``two``."""
    every = [*one, *two]
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, place, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    met = times[place] > 1
    owner, place = owner[met], place[met]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):  # a bounded stretch of elements at a time
        start, end = np.searchsorted(place, [low, low + COLUMNS])
        held = np.zeros((len(every), COLUMNS), dtype=np.float32)
        held[owner[start:end], place[start:end] - low] = 1
        out += (held[: len(one)] @ held[len(one) :].T).astype(np.int64)
    return out


def similar_sets(one: list[np.ndarray], two: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets reach the Jaccard similarity."""
    both = shared_counts(one, two)
    whole = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - both
    return both / np.maximum(whole, 1) >= similarity


def _links_in_groups(groups: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the parts that pairs at the similarity between the sides of a group connect.

    ``groups``, stored: key, side, id, part, with few shingles to a side; ``texts``: id,
    text. Few groups are broadcast, so that texts are shuffled once, by key. Every such pair that the fingerprints leave and that is still apart is
    compared on the whole shingle sets; a group gives fewer edges than parts.
    """
    if skew.fits_broadcast(groups):
        groups = F.broadcast(groups)
    full = groups.join(texts, "id").select("key", "side", "id", "part", "text")
    early, radius = reach(similarity, 1), reach(similarity, REACH_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in common.stretches(batches, ["key"]):
            ids, side, part = (rows.column(c).to_numpy() for c in ("id", "side", "part"))
            packed = rows.column("text").combine_chunks().cast(pa.large_binary())
            found = [np.empty((2, 0), dtype=np.int64)]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                one, two = _sides(side[start:end])
                own, shown, label = np.unique(part[start:end], return_index=True, return_inverse=True)
                if len(own) < 2 or not len(one) or not len(two):
                    continue
                sets = [shingle_set(packed[i].as_py() or b"", k) for i in range(start, end)]
                words = list(np.stack([set_fingerprint(s, REACH_WORDS) for s in sets], axis=1))
                both = len(one) == len(two) == end - start
                for at in range(0, len(one), SET_BLOCK):
                    for other in range(at if both else 0, len(two), SET_BLOCK):
                        x, y = one[at : at + SET_BLOCK], two[other : other + SET_BLOCK]
                        i, j = near_pairs(words, x, y, early, radius)
                        i, j = x[i], y[j]
                        apart = label[i] != label[j]
                        x, y = np.unique(i[apart]), np.unique(j[apart])
                        if not len(x):
                            continue
                        i, j = np.nonzero(similar_sets([sets[v] for v in x], [sets[v] for v in y], similarity))
                        joined = common.spanning_pairs(len(own), label[x[i]], label[y[j]])
                        told = np.flatnonzero(joined != np.arange(len(own)))
                        found.append(np.stack([ids[start + shown[joined[told]]], ids[start + shown[told]]]))
                        label = joined[label]
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return full.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def _stars(pairs: DataFrame) -> DataFrame:
    """Groups (key, side, id, part) of rows and their lead: at most about ``SET_BLOCK`` rows each. ``pairs``: id, lead."""
    pairs = pairs.select(F.greatest("id", "lead").alias("id"), F.least("id", "lead").alias("lead")).distinct()
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SET_BLOCK).alias("_parts"))
    placed = pairs.join(sizes, "lead").select("id", "lead", F.xxhash64("lead", F.pmod(F.xxhash64("id"), F.col("_parts"))).alias("key"))
    leads = placed.select("key", F.lit(0).alias("side"), F.col("lead").alias("id")).distinct()
    return placed.select("key", F.lit(1).alias("side"), "id").unionByName(leads).withColumn("part", F.col("id"))


def _apart(rows: DataFrame) -> DataFrame:
    """Groups (key, side, id, part) in which all rows of a crowd in different parts meet. ``rows``: id, part, crowd, n (shingles).

    Rows of a crowd of one part are left out. A crowd of up to ``GROUP_SHINGLES``
    is one group, so each of its rows comes once. Larger ones are dealt as
    pairs of blocks; a part that fills blocks has its own, which do not meet
    each other.
    """
    weight = F.sum(F.col("n") + ROW_SHINGLES).alias("weight")
    parts = rows.groupBy("crowd", "part").agg(weight)
    several = parts.groupBy("crowd").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("weight").alias("whole")).filter("low < high")
    large = (F.col("weight") > GROUP_SHINGLES) & (F.col("whole") > GROUP_SHINGLES)
    owned = parts.join(several, "crowd").withColumn("pool", ~large).withColumn("owner", F.xxhash64("crowd", F.when(large, F.col("part"))))
    sizes = owned.groupBy("owner").agg(F.ceil(F.sum("weight") / GROUP_SHINGLES).alias("blocks"))
    owned = owned.join(sizes, "owner").select("crowd", "part", "owner", "pool", "blocks")
    placed = rows.join(owned, ["crowd", "part"]).withColumn("block", F.xxhash64("owner", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    placed = common.stored(placed.select("id", "part", "crowd", "owner", "pool", "block"))
    blocks = placed.select("crowd", "owner", "pool", "block").distinct()
    others = blocks.select("crowd", F.col("owner").alias("owner2"), F.col("block").alias("block2"))
    pairs = blocks.join(others, "crowd").filter("block <= block2 and (owner <> owner2 or pool)").withColumn("key", F.xxhash64("block", "block2"))
    sides = F.when(F.col("block") == F.col("block2"), F.array(F.struct(F.lit(2).alias("side"), F.col("block"))))
    sides = sides.otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("block")), F.struct(F.lit(1).alias("side"), F.col("block2").alias("block"))))
    return pairs.select("key", F.explode(sides).alias("s")).select("key", "s.side", "s.block").join(placed, "block").select("key", "side", "id", "part")


def _picked(rows: DataFrame, number: str, ids: DataFrame, among: bool) -> DataFrame:
    """The rows whose ``number`` is (or is not) among ``ids`` (id).

    The ids go to the rows as one bit each, in words of 64, so the rows, which
    hold the texts, are not shuffled. Numbers that follow each other take 16
    bytes for 64 rows at most.
    """
    chunk, mask = f"{number}chunk", f"{number}mask"
    place = lambda c: F.col(c).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place("id"))
    masks = ids.groupBy(F.shiftright("id", 6).alias(chunk)).agg(F.bit_or(bit).alias(mask))
    found = rows.withColumn(chunk, F.shiftright(number, 6)).join(F.broadcast(masks), chunk, "left")
    hit = F.coalesce(F.getbit(mask, place(number)) == 1, F.lit(False))
    return found.filter(hit if among else ~hit).select(*(f"`{c}`" for c in rows.columns))


def near_links(docs: DataFrame, k: int, similarity: float, recall: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) among ids: their components are those of all pairs at the similarity.

    Equal shingle sets are collapsed to the smallest id. Candidates are
    neighbours in the grid; ``recall`` is the expected share found of pairs at
    exactly the similarity. Each row is verified with its lead, which settles
    rows without another neighbour. Of the others, each part so far with a
    neighbour in another one is verified with the nearest; parts that reach
    each other over neighbours are a crowd, and its pairs that are still in
    different parts are compared on the whole sets, in
    blocks. Ids must be distinct (an id with two
    texts would be one node); rows without an id are left out, NULL text is
    empty, and texts without words are equal to each other.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    segments = table_segments(rows.count())
    width, tiny = (word_count(similarity, recall, segments, ties) for ties in (TIES, TINY_TABLE_TIES))
    bounds = segments, reach(similarity, 1), reach(similarity, REACH_WORDS)
    signed = common.stored(_signed_rows(rows, k, width, tiny))
    least = common.stored(signed.groupBy("digest", "n").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")))
    equal = signed.select("digest", "n", F.col("id").alias("b")).join(least.filter("m > 1"), ["digest", "n"]).filter("a <> b").select("a", "b")
    of_set = _picked(signed, "id", least.select(F.col("a").alias("id")), True)

    wide, small = (coarse_words(similarity, recall, segments, ties) for ties in (TIES, TINY_TABLE_TIES))
    coarse = F.when(F.col("n") < TINY, small).otherwise(wide)
    led = common.stored(neighbours(of_set.select("id", "n", "fp"), *bounds, own_segments(similarity, recall), coarse))
    texts = common.stored(_picked(rows, "id", led.select("id"), True), "zstd")
    first = common.cut(_links_in_groups(common.stored(_stars(led)), texts, k, similarity))

    part = common.components(first).withColumnRenamed("component", "part")
    open_ = led.filter("several").select("id").join(part, "id", "left").select("id", F.coalesce("part", "id").alias("part"))
    open_ = common.stored(open_.join(_picked(signed, "id", led.filter("several").select("id"), True).select("id", "n", "fp"), "id"))
    met = common.stored(across(open_.select("id", "fp", "part"), *bounds))
    leads = met.groupBy("part").agg(F.min(F.struct("bits", "id", F.col("nearest").alias("lead"))).alias("p")).select("p.id", "p.lead")
    stars = common.stored(_stars(leads))
    second = common.cut(_links_in_groups(stars, _picked(texts, "id", stars.select("id"), True), k, similarity))

    links = first.unionByName(second)
    part = common.components(links).withColumnRenamed("component", "now")
    crowds = common.components(met.select(F.col("part").alias("a"), F.col("reached").alias("b")))
    crowds = open_.select("id", "n", "part").join(crowds.select(F.col("id").alias("part"), F.col("component").alias("crowd")), "part")
    crowds = common.stored(crowds.join(part, "id", "left").select("id", "n", "crowd", F.coalesce("now", "id").alias("part")))
    groups = common.stored(_apart(crowds))
    return equal.unionByName(links).unionByName(_links_in_groups(groups, _picked(texts, "id", groups.select("id"), True), k, similarity))


def drop_near_duplicates(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Keep the row with the smallest id of every near-duplicate group.

    Groups are the components of the pairs with that Jaccard similarity of
    shingle sets. Rows are told apart by a stored number, so of rows that
    repeat an id each belongs to the group of its own text, and of equal ids
    in a group one stays. Rows with a NULL id are kept. NULL text is empty;
    texts without words are one group. No rows give no rows; columns pass
    unchanged.
    """
    number = "_row"
    while any(c.lower().startswith(number) for c in docs.columns):
        number += "_"
    rows = common.stored(docs.withColumn(number, F.monotonically_increasing_id()), "zstd")
    known = rows.filter(F.col(doc_id).isNotNull())
    groups = common.components(near_links(known, k, similarity, recall, number, text))
    placed = groups.join(known.select(F.col(number).alias("id"), F.col(doc_id).alias("doc")), "id")
    first = placed.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("first"))
    gone = common.cut(placed.join(first, "component").filter("id <> first.id").select("id"))
    return _picked(rows, number, gone, False).drop(number)
