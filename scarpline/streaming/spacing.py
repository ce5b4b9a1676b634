"""Events kept at least a fixed time apart per key.

The first event of a key is kept; a later one is kept when it comes at least
``gap`` seconds after the last kept one. This is the cooldown of repeated
alerts.

The rule is sequential along a key, so a key is cut into time blocks:

1. per (key, block): the last kept instant on leaving the block, as a step
   function of the first instant that the block may keep;
2. per key over its blocks: the first instant each block may keep;
3. per (key, block): replay from that instant.

Steps 1 and 3 walk partitions sorted by key, block and time with the instants
of one block in memory; step 2 receives only the steps of the functions. All
times are integer microseconds. NULL keys are a key of their own, events
without a time are not events.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The functions below travel to the workers by value: these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GAP_S = 300.0
BLOCK_S = 3600.0
_EVER = -(1 << 62)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def chain(times: list[int], free: int, gap: int) -> list[int]:
    """Times kept from a sorted stretch when nothing before ``free`` may be kept."""
    kept, i = [], bisect_left(times, free)
    while i < len(times):
        kept.append(times[i])
        i = bisect_left(times, times[i] + gap, i)
    return kept


def steps(times: list[int], reach: int, gap: int) -> list[tuple[int, int]]:
    """(latest first instant, last kept instant), one for each different last instant.

    Only first instants before ``reach`` and the one after can occur.
    """
    n, last = len(times), [0] * len(times)
    after = np.searchsorted(np.array(times, dtype=np.int64), np.array(times, dtype=np.int64) + gap).tolist()
    for i in range(n - 1, -1, -1):
        last[i] = times[i] if after[i] == n else last[after[i]]
    count = min(n, bisect_left(times, reach) + 1)
    return [(times[i], last[i]) for i in range(count) if i + 1 == count or last[i + 1] != last[i]]


def _stretches(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Columns of consecutive rows with the same keys, over the borders of batches."""
    held: dict[str, np.ndarray] | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        if held is not None:
            columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
        changed = np.zeros(len(columns[keys[0]]), dtype=bool)
        for k in keys:
            changed[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(changed).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield tuple(columns[k][low] for k in keys), {c: v[low:high] for c, v in columns.items()}
        held = {c: v[cuts[-1] :] for c, v in columns.items()}
    if held is not None:
        yield tuple(held[k][0] for k in keys), held


def _collected(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _walk(df: DataFrame, keys: list[str], then: list[str], rows: Callable, schema: str, dealt: list[str]) -> DataFrame:
    """Run ``rows(key values, stretch)`` over each stretch of a sorted partition."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _collected((row for key, part in _stretches(batches, keys) for row in rows(key, part)), columns)

    return df.repartition(*dealt).sortWithinPartitions(*keys, *then).mapInPandas(run, schema)


def keep_spaced(events: DataFrame, key: str, gap_s: float = GAP_S, block_s: float = BLOCK_S, ts: str = "ts") -> DataFrame:
    """(k, at_us) for each kept instant."""
    if block_s < gap_s:
        raise ValueError("a block must be at least as long as the gap")
    gap, block_us = int(gap_s * 1e6), int(block_s * 1e6)
    text = F.col(key).cast("string")
    marked = F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text)).alias("m")
    instants = events.select(marked, micros(ts).alias("at_us")).filter("at_us IS NOT NULL").distinct()
    instants = instants.withColumn("block", F.floor(F.col("at_us") / F.lit(block_us)).cast("bigint"))

    def leave(at: tuple, part: dict[str, np.ndarray]) -> Iterator[tuple]:
        for opening, leaving in steps(part["at_us"].tolist(), int(at[1]) * block_us + gap, gap):
            yield at[0], at[1], opening, leaving

    def connect(at: tuple, part: dict[str, np.ndarray]) -> Iterator[tuple]:
        block, opening, leaving = (part[c].tolist() for c in ("block", "opening", "leaving"))
        free, low = _EVER, 0
        while low < len(block):
            high = bisect_right(block, block[low], low)
            i = bisect_left(opening, free, low, high)
            if i < high:
                yield at[0], block[low], free
                free = leaving[i] + gap
            low = high

    def replay(at: tuple, part: dict[str, np.ndarray]) -> Iterator[tuple]:
        for kept in chain(part["at_us"].tolist(), int(part["free"][0]), gap):
            yield at[0], kept

    left = _walk(instants, ["m", "block"], ["at_us"], leave, "m string, block bigint, opening bigint, leaving bigint", ["m", "block"])
    opened = _walk(left, ["m"], ["block", "opening"], connect, "m string, block bigint, free bigint", ["m"])
    known = instants.join(opened, ["m", "block"])
    kept = _walk(known, ["m", "block"], ["at_us"], replay, "m string, at_us bigint", ["m", "block"])
    return kept.select(F.when(F.col("m") != "", F.expr("substring(m, 2)")).alias("k"), "at_us")


def keep_spaced_stream(events: DataFrame, key: str, gap_s: float = GAP_S, lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Stream form: one number of state per key, dropped once it cannot matter.

    A micro-batch is bounded by the source (files per trigger). Its events
    arrive in chunks; only the distinct instants of a key are held for sorting.
    """

    gap = int(gap_s * 1e6)

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.unique(np.concatenate([np.unique(c["at_us"].to_numpy()) for c in chunks])).tolist()
        free = state.get[0] + gap if state.exists else _EVER
        kept = chain(times, free, gap)
        if kept:
            state.update((kept[-1],))
        expiry_ms = (state.get[0] + gap) // 1000 + 1
        if expiry_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry_ms)
        else:
            state.remove()
        if kept:
            yield pd.DataFrame({"k": k[0], "at_us": kept})

    rows = events.withWatermark(ts, lateness).select(F.col(key).cast("string").alias("k"), ts, micros(ts).alias("at_us"))
    return rows.groupBy("k").applyInPandasWithState(
        step, "k string, at_us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
