"""Removal of repeated passages by suffix arrays.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier: in a row of smaller document id, in an earlier row of the same id, or
before it in the same row. Every row has a stored number, so rows that share an
id, or have none, are told apart.

1. Anchors. Every ``LENGTH``-byte window has an anchor: its ``K``-byte
   substring of smallest hash. Equal windows have equal anchors at the same
   place, and neighbouring windows mostly share one, so a text falls into
   regions of windows with one anchor (about one in 39 bytes). Only anchors met
   twice can hold a repeat. Each input task first combines its own occurrences,
   so a common anchor reaches the next step once a task.
2. Regions whose bytes are those of an earlier one are repeats as they stand.
   Where an anchor has several different regions, a passage begins or ends:
   the bytes of these regions go on to the suffix arrays.
3. Shards by anchor. Each shard builds a suffix array of its regions by
   Larsson-Sadakane prefix doubling, common prefixes by Kasai's permuted form,
   and keeps the earliest of each class of windows with a common prefix of
   ``LENGTH`` bytes.
4. An anchor with more than ``SHARD_REGIONS`` regions is dealt to several
   shards. The windows that these keep are merged by their sorted digests and
   binary search.

All steps are lossless: the windows judged are exactly those of the whole
texts. Digests of regions and anchors are 64 bits each and used together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scarpline.llm import common

LENGTH, K = 100, 24
SPAN = LENGTH - K + 1  # places of the anchor in a window
CHUNK = 1 << 21  # bytes of text or regions handled at a time
SHARD_REGIONS = 4096
_BASE = 0x9E3779B97F4A7C15
ALONE, SEVERAL, REGION, REPEAT = 0, 1, 2, 3


# Suffix arrays


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zero past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def _seven(text: np.ndarray) -> np.ndarray:
    """Seven symbols from each place as one number; past the end is below every byte."""
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    out = np.zeros(len(text), np.int64)
    for k in range(7):
        out |= padded[k : k + len(text)] << np.int64(9 * (6 - k))
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Ranks are the first slot of a group. A round sorts only the suffixes that
    share a group, by the rank of the suffix ``depth`` places on. A suffix that
    ends sorts before its extensions.
    """
    n = len(text)
    key, depth = _seven(text), 7
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[sa] = starts[np.cumsum(first) - 1]
    sizes = np.diff(np.r_[starts, n])
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))  # slots of shared groups
    while len(active):
        here = sa[active]
        ahead = here + depth
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sort_key = (rank[here] << np.int64(32)) + after
        order = np.argsort(sort_key, kind="stable")
        here, sort_key = here[order], sort_key[order]
        sa[active] = here
        new = np.ones(len(here), bool)
        new[1:] = sort_key[1:] != sort_key[:-1]
        starts = np.flatnonzero(new)
        rank[here] = active[starts][np.cumsum(new) - 1]
        sizes = np.diff(np.r_[starts, len(here)])
        active = active[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order.

    In text order the value falls by one from place to place as long as the
    bytes before both suffixes agree. Only where they differ is it measured.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    left = np.where((places > 0) & (before > 0), text[np.maximum(places - 1, 0)] == text[np.maximum(before - 1, 0)], False)
    measured = np.flatnonzero(~left)
    key = _eight(text)
    found = np.zeros(len(measured), np.int64)
    open_ = np.flatnonzero(before[measured] >= 0)
    while len(open_):
        i, j = measured[open_] + found[open_], before[measured[open_]] + found[open_]
        inside = np.maximum(i, j) < n
        differ = np.where(inside, key[np.minimum(i, n - 1)] ^ key[np.minimum(j, n - 1)], np.uint64(1) << np.uint64(63))
        same = np.zeros(len(open_), np.int64)
        for k in range(8):
            same += (differ >> np.uint64(56 - 8 * k)) == 0
        found[open_] = np.minimum(found[open_] + same, n - np.maximum(measured[open_], before[measured[open_]]))
        open_ = open_[(same == 8) & (np.maximum(i, j) + 8 <= n)]
    values = np.zeros(n, np.int64)
    values[measured] = found
    last = np.maximum.accumulate(np.where(left, 0, places))
    by_place = np.maximum(values[last] - (places - last), 0)
    return by_place[sa]


# Anchors and regions of the texts


def _hashes(text: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the K bytes from each place, mixed; the last K - 1 places are void."""
    with np.errstate(over="ignore"):
        b = np.uint64(_BASE | 1)
        h, powers = text.astype(np.uint64) + np.uint64(1), b
        level = {1: (h, powers)}
        for width in (2, 4, 8, 16):
            half, p = level[width // 2]
            h = half.copy()
            h[: len(h) - width // 2] = half[: len(h) - width // 2] * p + half[width // 2 :]
            level[width] = (h, p * p)
        out = level[16][0].copy()
        if len(out) > 16:
            out[: len(out) - 16] = level[16][0][: len(out) - 16] * level[8][1] + level[8][0][16:]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def regions(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of all regions of the joined texts.

    ``ends`` are the ends of the texts; no window crosses one.
    """
    n = len(text)
    if n < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _hashes(text)
    bits = np.uint64(max(n, 2).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        best[: len(best) - width] = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    rest = SPAN - width
    windows = n - LENGTH + 1
    anchor = (np.minimum(best[:windows], best[rest : rest + windows]) & low).astype(np.int64)
    valid = np.ones(windows, bool)
    starts = np.r_[0, ends[:-1]]
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        valid[max(s, e - LENGTH + 1) : min(e, windows)] = False
    kept = np.flatnonzero(valid)
    if not len(kept):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    a = anchor[kept]
    new = np.r_[True, (a[1:] != a[:-1]) | (kept[1:] != kept[:-1] + 1)]
    at = np.flatnonzero(new)
    return h[a[at]], kept[at], np.diff(np.r_[at, len(kept)])


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


_ROW = "key bigint, h bigint, r bigint, doc bigint, row bigint, start bigint, n bigint, kind bigint"
_NAMES = ["key", "h", "r", "doc", "row", "start", "n", "kind"]


def _judged(h: np.ndarray, r: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences in order of (h, r, doc, row, start): later than an equal region; the anchor has several regions."""
    new_h, new_r = _first_of(h), _first_of(h, r)
    group = np.cumsum(new_h) - 1
    several = (np.bincount(group, weights=new_r) > 1) | (np.bincount(group, weights=told) > 0)
    return ~new_r, several[group]


def _spread(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (row * np.int64(0x5851F42D4C957F2D) + start) * np.int64(0x5851F42D4C957F2D)


def occurrences(rows: DataFrame) -> DataFrame:
    """Regions of all texts, combined within each input task. ``rows``: doc, row, text."""

    def chunk(docs: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        joined = b"".join(t for *_, t in docs)
        sizes = np.array([len(t) for *_, t in docs], np.int64)
        ends = np.cumsum(sizes)
        h, first, n = regions(np.frombuffer(joined, np.uint8), ends)
        if not len(h):
            return
        text_no = np.searchsorted(ends, first, "right")
        doc, row = (np.array([d[c] for d in docs], np.int64)[text_no] for c in (0, 1))
        digest = xxhash.xxh3_64_intdigest
        stops = first + n + LENGTH - 1
        r = np.array([digest(joined[a:b]) for a, b in zip(first.tolist(), stops.tolist(), strict=True)], np.uint64).view(np.int64)
        h, start = h.view(np.int64), first - (ends - sizes)[text_no]
        order = np.lexsort((start, row, doc, r, h))
        h, r, doc, row, start, n = (c[order] for c in (h, r, doc, row, start, n))
        later, several = _judged(h, r, np.zeros(len(h), bool))
        kind = np.where(later, REPEAT, np.where(~several, ALONE, np.where(_first_of(h), SEVERAL, REGION)))
        key = np.where(kind >= REGION, _spread(row, start), h)
        for at in range(0, len(h), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (key, h, r, doc, row, start, n, kind)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                (batch, texts), = common.text_rows([whole.slice(at, 500)])
                for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                    if len(text) >= LENGTH:
                        held.append((doc, row, text))
                        size += len(text)
                    if size >= CHUNK:
                        yield from chunk(held)
                        held, size = [], 0
        yield from chunk(held)

    return rows.select("doc", "row", "text").mapInArrow(run, _ROW)


def repeats_and_regions(found: DataFrame) -> DataFrame:
    """Regions that repeat an earlier one, and regions whose bytes must be compared.

    Open occurrences come sorted by anchor, region and place. From one batch to the
    next only the last region of the last anchor is held, however often an
    anchor occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((8, 0), np.int64)  # the held row; its last field: 1 where it was handed on
        for batch in batches:
            rows = np.stack([*[batch.column(c).to_numpy() for c in _NAMES[1:]], np.zeros(batch.num_rows, np.int64)])
            settled = rows[6] >= REGION
            own = np.concatenate([rest, rows[:, ~settled]], axis=1)
            later, several = _judged(own[0], own[1], own[6] == SEVERAL)
            own[6] = np.where(later, REPEAT, np.where(several, REGION, ALONE))
            if own.shape[1]:
                at = np.flatnonzero(~later)[-1:]
                rest = own[:, at]
                rest[6], rest[7] = np.where(several[at], SEVERAL, ALONE), several[at]
            out = np.concatenate([rows[:, settled], own[:, (own[6] != ALONE) & (own[7] == 0)]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[k]) for k in (0, 2, 3, 4, 5, 6)], names=["h", "doc", "row", "start", "n", "kind"])

    # settled rows come first and by place, which also stores them small
    h, r = (F.when(F.col("kind") < REGION, F.col(c)) for c in ("h", "r"))
    dealt = found.repartition("key").sortWithinPartitions(h, r, "doc", "row", "start")
    return dealt.mapInArrow(run, "h bigint, doc bigint, row bigint, start bigint, n bigint, kind bigint")


# Shards


def shard_windows(parts: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, row, window, place in the joined regions, repeats an earlier one) of all windows of some regions."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    region = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(text)) - begin[region]
    valid = offset + LENGTH <= sizes[region]
    group = np.cumsum(lcp < LENGTH)
    kept = valid[sa]
    place, group = sa[kept], group[kept]
    of = region[place]
    d, o, w = doc[of], row[of], start[of] + offset[place]
    order = np.lexsort((w, o, d, group))
    return d[order], o[order], w[order], place[order], ~_first_of(group[order])


def _runs(row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (row, first, number) of consecutive ones."""
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], window[at], np.diff(np.r_[at, len(row)])


_OUT = "row bigint, start bigint, n bigint, doc bigint, digest bigint"


def _out(row: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray | None = None, digest: np.ndarray | None = None) -> pa.RecordBatch:
    others = [pa.nulls(len(row), pa.int64()) if c is None else pa.array(c) for c in (doc, digest)]
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start), pa.array(n), *others], names=["row", "start", "n", "doc", "digest"])


def compare_regions(regions_: DataFrame) -> DataFrame:
    """Windows that repeat an earlier one of their shard; of split anchors also the others, with a digest.

    ``regions_``: h, salt, split, doc, row, start, bytes. Shards are whole (h, salt)
    groups, a few at a time.
    """

    def shard(parts: list[bytes], doc: list[int], row: list[int], start: list[int], split: list[bool]) -> Iterator[pa.RecordBatch]:
        d, o, w, place, repeat = shard_windows(parts, *(np.array(c, np.int64) for c in (doc, row, start)))
        if repeat.any():
            yield _out(*_runs(o[repeat], w[repeat]))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        open_ = ~repeat & np.repeat(np.array(split, bool), sizes)[place]
        if open_.any():
            joined = b"".join(parts)
            digest = np.array([xxhash.xxh3_64_intdigest(joined[p : p + LENGTH]) for p in place[open_].tolist()], np.uint64)
            yield _out(o[open_], w[open_], np.ones(int(open_.sum()), np.int64), d[open_], digest.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for h, salt, split, doc, row, start, part in zip(*columns, strict=True):
                if size >= CHUNK // 2 and (h, salt) != last:
                    yield from shard(*held)
                    held, size = [[], [], [], [], []], 0
                for values, x in zip(held, (part, doc, row, start, split), strict=True):
                    values.append(x)
                size, last = size + len(part), (h, salt)
        if held[0]:
            yield from shard(*held)

    dealt = regions_.select("h", "salt", "split", "doc", "row", "start", "bytes").repartition("h", "salt").sortWithinPartitions("h", "salt")
    return dealt.mapInArrow(run, _OUT)


def merge_shards(windows: DataFrame) -> DataFrame:
    """Of windows kept by several shards, those whose digest an earlier window has.

    Windows come sorted by digest; only the last digest is held between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(0, np.int64)
        for batch in batches:
            digest, row, start = (batch.column(c).to_numpy() for c in ("digest", "row", "start"))
            repeat = (np.searchsorted(digest, digest, "left") < np.arange(len(digest))) | np.isin(digest, last)
            if repeat.any():
                yield _out(*_runs(row[repeat], start[repeat]))
            last = digest[-1:] if len(digest) else last

    dealt = windows.select("digest", "doc", "row", "start").repartition("digest").sortWithinPartitions("digest", "doc", "row", "start")
    return dealt.mapInArrow(run, _OUT)


def _cut_regions(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the regions asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "split", "doc", "row", "start", "bytes"]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                (batch, text_list), = common.text_rows([whole.slice(at, 200)])
                out: list[list] = [[] for _ in names]
                columns = [batch.column(c).to_pylist() for c in ("doc", "row", "asked")]
                for doc, row_no, asked_, text in zip(*columns, text_list, strict=True):
                    for a in asked_:
                        row = (a["h"], a["salt"], a["split"], doc, row_no, a["start"], text[a["start"] : a["start"] + a["n"] + LENGTH - 1])
                        for values, x in zip(out, row, strict=True):
                            values.append(x)
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    counts = asked.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SHARD_REGIONS)
    shards = F.ceil(F.col("m") / SHARD_REGIONS)
    salt = F.coalesce(F.pmod(F.xxhash64("row", "start"), shards), F.lit(0))
    dealt = asked.join(counts, "h", "left").select("row", F.struct("h", salt.alias("salt"), F.col("m").isNotNull().alias("split"), "start", "n").alias("a"))
    by_row = dealt.groupBy("row").agg(F.collect_list("a").alias("asked"))
    met = texts.join(by_row, "row").select("doc", "row", "text", "asked")
    return met.mapInArrow(run, "h bigint, salt bigint, split boolean, doc bigint, row bigint, start bigint, bytes binary")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(row, start, n): runs of windows that also start earlier. ``texts``: doc, row, text."""
    judged = common.stored(repeats_and_regions(occurrences(texts)))
    asked = judged.filter(F.col("kind") == REGION).select("h", "doc", "row", "start", "n")
    compared = common.stored(compare_regions(_cut_regions(asked, texts)))
    merged = merge_shards(compared.filter("digest IS NOT NULL"))
    parts = (judged.filter(F.col("kind") == REPEAT), compared.filter("digest IS NULL"), merged)
    out = [p.select("row", "start", "n") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, doc, row, text) with a stored row number; ``doc`` is the id to order by, a NULL id counts as the largest."""
    own = F.col(doc_id).cast("bigint")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(2**63 - 1)).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return common.stored(rows)


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans covered by runs (first window, number of windows), merged."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        end = start + n + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): removed byte spans and the bytes left of every row.

    NULL text is empty; texts under LENGTH bytes are never cut. Of rows that
    share an id, or have none, those that come first are the earlier ones. No
    rows give no rows. Other columns are not read.
    """
    texts = numbered(docs, doc_id, text)
    runs = repeated_windows(texts).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    met = texts.join(runs, "row", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                (batch, texts), = common.text_rows([whole.slice(at, 500)])
                spans, kept = [], []
                for own, data in zip(batch.column(2).to_pylist(), texts, strict=True):
                    cuts = [(a, min(b, len(data))) for a, b in covered([(x["start"], x["n"]) for x in own or []]) if a < len(data)]
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                    edges = [0, *[x for c in cuts for x in c], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                removed = pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), sizes, removed, pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return met.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of what is left of every document."""
    rows = remove_repeats(docs)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
