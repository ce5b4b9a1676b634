"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are compared in lower case without
punctuation. Shared runs of ``SEED_WORDS`` words, found by a rolling hash and
verified, are the seeds. Seeds on one diagonal form maximal matches; the
longest match whose words are still unmarked becomes a tile, overlapping
matches are cut back, and so on down to ``SEED_WORDS`` words. Tiles may come in
any order, so reordered passages count. A document holds an item when tiles
cover at least a given share of the item's words. An item of fewer words than a
seed must occur whole, as one run.

The benchmark is the query set: it is cut into blocks of a bounded number of
items, each block is broadcast and meets all documents in one pass without a
shuffle. Only documents with a seed reach the tiling.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scarpline.llm import common

SEED_WORDS = 5
BLOCK_ITEMS = 5_000
COVERAGE = 0.5
MANY_PAIRS = 256  # pairs of places from which on items are told apart first
_BASE = np.uint64(0x100000001B3)
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _rolling(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SEED_WORDS word numbers."""
    n = len(ids) - SEED_WORDS + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED_WORDS if n > 0 else 0):
            out = out * _BASE + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return out


class Items:
    """A block of benchmark items with its vocabulary and seeds."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            own = words(text)
            self.ids.append(item_id)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], dtype=np.int64))
        hashes = [_rolling(w) for w in self.words]
        self.seeds = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        self.at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.at = self.seeds[order], self.item[order], self.at[order]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.short: dict[int, list[int]] = defaultdict(list)  # items without a seed by their first word
        for i in np.flatnonzero((self.sizes > 0) & (self.sizes < SEED_WORDS)).tolist():
            self.short[int(self.words[i][0])].append(i)
        self.first = np.array(sorted(self.short), dtype=np.int64)

    def _short_matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for word in np.intersect1d(ids, self.first).tolist():
            places = np.flatnonzero(ids == word)
            for item in self.short[word]:
                own = self.words[item]
                there = places[places <= len(ids) - len(own)]
                if any(np.array_equal(ids[p : p + len(own)], own) for p in there.tolist()):
                    yield item, len(own), 1

    def _reachable(self, low: np.ndarray, high: np.ndarray, coverage: float) -> np.ndarray:
        """Whether the seeds met, wherever they stand, cover enough of each item: tiles cannot cover more."""
        met = np.zeros(len(self.seeds) + 1, dtype=np.int64)
        np.add.at(met, low, 1)
        np.add.at(met, high, -1)
        some = np.flatnonzero(np.cumsum(met[:-1]) > 0)
        covered = np.zeros(self.starts[-1] + 1, dtype=np.int64)
        place = self.starts[self.item[some]] + self.at[some]
        np.add.at(covered, place, 1)
        np.add.at(covered, place + SEED_WORDS, -1)
        whole = np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)]
        return whole[self.starts[1:]] - whole[self.starts[:-1]] >= coverage * self.sizes

    def matches(self, text: bytes, coverage: float = 0.0) -> Iterator[tuple[int, int, int]]:
        """(item number, words covered, tiles) of every item with a seed in the text.

        Items that cannot reach the coverage may be left out: where seeds and
        their places in the text are many, these are told apart before pairs of
        places are listed.
        """
        own = words(text)
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(-1)), dtype=np.int64, count=len(own))
        if len(self.first):
            yield from self._short_matches(ids)
        hashes = _rolling(ids)
        if not len(hashes) or not len(self.seeds):
            return
        unknown = np.r_[0, np.cumsum(ids < 0)]
        complete = np.flatnonzero(unknown[SEED_WORDS:] == unknown[:-SEED_WORDS])
        low = np.searchsorted(self.seeds, hashes[complete], "left")
        high = np.searchsorted(self.seeds, hashes[complete], "right")
        met = np.flatnonzero(high > low)
        reachable = self._reachable(low[met], high[met], coverage) if (high - low).sum() > MANY_PAIRS else None
        diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
        for place, a, b in zip(complete[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
            for k in range(a, b) if reachable is None else (a + np.flatnonzero(reachable[self.item[a:b]])).tolist():
                item, at = int(self.item[k]), int(self.at[k])
                if np.array_equal(self.words[item][at : at + SEED_WORDS], ids[place : place + SEED_WORDS]):
                    diagonals[item, place - at].append(place)
        by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for (item, shift), places in diagonals.items():
            start = last = places[0]
            for place in [*places[1:], None]:
                if place is None or place != last + 1:
                    by_item[item].append((start, start - shift, last - start + SEED_WORDS))
                    start = place
                last = place
        for item, found in by_item.items():
            yield item, *tile(found)


def tile(found: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Greedy tiling of (place in text, place in item, length): (words covered, tiles)."""
    heap = [(-n, t, p) for t, p, n in found]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), 0
    while heap:
        n, t, p = heapq.heappop(heap)
        free = [t + k not in in_text and p + k not in in_item for k in range(-n)]
        if all(free):
            in_text.update(range(t, t - n))
            in_item.update(range(p, p - n))
            tiles += 1
            continue
        start = None
        for k, f in enumerate([*free, False]):
            if f and start is None:
                start = k
            elif not f and start is not None:
                if k - start >= SEED_WORDS:
                    heapq.heappush(heap, (start - k, t + start, p + start))
                start = None
    return len(in_item), tiles


@lru_cache(maxsize=2)
def _items(rows: tuple[tuple[int, bytes], ...]) -> Items:
    return Items(list(rows))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage) of every pair that reaches the coverage.

    NULL texts are empty; items without words match nothing. Rows with a NULL
    id on either side take part and keep their NULL. A repeated document or
    item gives one row each; equal items are compared once. Empty tables give
    no rows. Other columns are not read.
    """
    queries = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), common.whole(item_text).cast("binary").alias("t"))
    distinct = _distinct_items(queries)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, q bigint, n_words bigint, n_covered bigint, n_tiles bigint, coverage double"
    out = None
    for sent in _blocks(distinct, block_items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _items(sent.value)
            for batch, texts in common.text_rows(batches):
                found = []
                for d, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                    for item, covered, tiles in items.matches(t, coverage):
                        n = len(items.words[item])
                        if covered >= coverage * n:
                            found.append((d, items.ids[item], n, covered, tiles, covered / n))
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "q", "n_words", "n_covered", "n_tiles", "coverage"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    members = queries.join(distinct, "t").select("q", "item_id")
    return out.join(members, "q").select("doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage")


def _distinct_items(queries: DataFrame) -> DataFrame:
    """(t, q): a number for every different item text."""
    return common.stored(queries.select("t").distinct().withColumn("q", F.monotonically_increasing_id()))


def _blocks(distinct: DataFrame, block_items: int) -> Iterator:
    """Broadcasts of (number, text) tuples, about ``block_items`` items each."""
    blocks = max(1, -(-distinct.count() // block_items))
    dealt = distinct.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    for block in range(blocks):
        held = tuple((r["q"], bytes(r["t"])) for r in dealt.filter(F.col("b") == block).collect())  # one block
        yield distinct.sparkSession.sparkContext.broadcast(held)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS,
    doc_id: str = "doc_id", text: str = "text", item_text: str = "text",
) -> DataFrame:
    """The documents that hold no benchmark item.

    Every row is judged by its own text, whatever its id: rows that repeat an
    id or have none stay or go each for itself. NULL texts are empty and stay;
    an empty benchmark removes nothing; columns pass unchanged.
    """
    place = docs.columns.index(text)
    for sent in _blocks(_distinct_items(benchmark.select(common.whole(item_text).cast("binary").alias("t"))), block_items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _items(sent.value)
            for batch in batches:
                texts = batch.column(place).cast(pa.large_binary()).to_pylist()
                holds = lambda t: any(covered >= coverage * len(items.words[i]) for i, covered, _ in items.matches(t, coverage))
                yield batch.filter(pa.array([not holds(t or b"") for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
