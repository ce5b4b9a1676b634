"""Bounded state of streams: the newest events of each holder, the newest samples of each band.

Both keep their state in the engine's RocksDB store, one entry list per key,
and never more than the window asks for. Before the shuffle every task trims
what it has read in the same way, so a key that fills a third of a micro-batch
sends a window's worth of rows per task, not all of its rows. The state itself
is read back with the engine's state reader; no table of all events is kept.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processors below travel to the workers by value: these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the state store that lists and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_state(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entries of a list state as of the last finished micro-batch: key and list columns."""
    with rocksdb(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/progress").select("key.*", "list_element.*")


def run_state(stream: DataFrame, path: str, trigger: dict | None = None) -> None:
    """Run an update-mode query whose result is its state; what it emits is dropped."""
    with rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{path}/progress")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()


# --- newest events per holder ------------------------------------------------------------


EVENT = "at_us bigint, event_id bigint, event_type string"


class NewestEvents(StatefulProcessor):
    """Keeps the newest ``keep`` events of a holder; a holder idle for ``idle_us`` is forgotten."""

    def __init__(self, keep: int, idle_us: int | None):
        self.keep, self.idle_us = keep, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.recent.get()) if self.recent.exists() else []
        before = held
        for pdf in rows:
            fresh = zip(pdf["at_us"].tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist())
            held = heapq.nlargest(self.keep, [*held, *fresh], key=lambda e: (e[0], e[1]))
        if self.idle_us is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            expiry = (held[0][0] + self.idle_us) // 1000 + 1
            if expiry <= timerValues.getCurrentWatermarkInMs():
                self.recent.clear()
                return
            self.handle.registerTimer(expiry)
        if held != before:
            self.recent.put(held)
            yield pd.DataFrame({"kept": [len(held)], "newest_us": [held[0][0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def _newest_of_task(keep: int, batch_keys: int = 50_000):
    """Trims a task's rows to the newest ``keep`` of each holder, at most ``batch_keys`` holders at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            pdf = pdf.sort_values(["at_us", "event_id"], ascending=False, kind="stable")
            held = pdf.groupby("holder", dropna=False, sort=False).head(keep)
            if len(held) > batch_keys * keep:
                yield held
                held = None
        if held is not None:
            yield held

    return run


def newest_events(events: DataFrame, keep: int, holder: str = "user_id", ts: str = "ts", idle: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Stream whose state ``recent`` is the newest events of each marked holder (event time, then event id).

    Events without a time are not events. ``idle`` (an interval) lets a holder
    be forgotten once the watermark has passed its newest event by that much.
    """
    rows = events.filter(F.col(ts).isNotNull())
    if idle is not None:
        rows = rows.withWatermark(ts, lateness)
    text = F.col(holder).cast("string")
    marked = F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text))  # a NULL holder is a holder of its own
    columns = [marked.alias("holder"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), "event_id", "event_type"]
    if idle is None:
        kept = rows.select(*columns).mapInPandas(_newest_of_task(keep), f"holder string, {EVENT}")
        processor, mode = NewestEvents(keep, None), "None"
    else:  # event time must stay visible to the engine, so rows are not trimmed before
        seconds = events.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).alias("us"))
        kept, processor, mode = rows.select(*columns, ts), NewestEvents(keep, seconds.first()["us"]), "EventTime"
    return kept.groupBy("holder").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="kept bigint, newest_us bigint", outputMode="Update", timeMode=mode,
    )


def unmarked(kind: str, column: str = "holder") -> Column:
    """The holder that a mark stands for."""
    return F.when(F.col(column) != "", F.expr(f"substring({column}, 2)")).cast(kind)


# --- newest samples per band -------------------------------------------------------------


def summary_schema(bins: int) -> str:
    return ", ".join(["sample_id bigint", *[f"b{i} bigint" for i in range(1, bins + 1)], "n bigint", "total double", "squares double"])


def _merged(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Sums per (band, sample), newest samples of each band only."""
    sums = pdf.groupby(["band", "sample_id"], as_index=False, sort=True).sum()
    return sums.groupby("band", sort=False).tail(window)


def _sample_summaries(edges: list[float], window: int):
    """Bin counts and power sums of a task's values per (band, sample), trimmed to the newest samples of each band."""
    bins = len(edges) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            x = pdf["value"].to_numpy(dtype=np.float64, na_value=np.nan)
            known = ~np.isnan(x)
            place = np.searchsorted(edges, x, side="right")
            place = np.where(x == edges[-1], bins, place)
            out = {"band": pdf["band"].to_numpy(), "sample_id": pdf["sample_id"].to_numpy()}
            out |= {f"b{i}": ((place == i) & known).astype(np.int64) for i in range(1, bins + 1)}
            out |= {"n": known.astype(np.int64), "total": np.where(known, x, 0.0), "squares": np.where(known, x * x, 0.0)}
            fresh = _merged(pd.DataFrame(out), window)
            held = fresh if held is None else _merged(pd.concat([held, fresh], ignore_index=True), window)
        if held is not None and len(held):
            yield held

    return run


class NewestSamples(StatefulProcessor):
    """A ring of at most ``window`` sample summaries of a band, the newest by sample id."""

    def __init__(self, window: int, bins: int):
        self.window, self.bins = window, bins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", summary_schema(self.bins))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {int(r[0]): tuple(r) for r in self.ring.get()} if self.ring.exists() else {}
        for pdf in rows:
            for row in pdf.drop(columns="band").itertuples(index=False, name=None):
                old = held.get(row[0])
                held[row[0]] = row if old is None else (row[0], *[a + b for a, b in zip(old[1:], row[1:], strict=True)])
            held = {i: held[i] for i in heapq.nlargest(self.window, held)}
        whole = [tuple([*map(int, r[: self.bins + 2]), *map(float, r[self.bins + 2 :])]) for r in held.values()]
        self.ring.put(whole)
        columns = ["sample_id", *[f"b{i}" for i in range(1, self.bins + 1)], "n", "total", "squares"]
        yield pd.DataFrame(whole, columns=columns).assign(ring_band=int(key[0]))[["ring_band", *columns]]

    def close(self) -> None:
        pass


def newest_samples(bands: DataFrame, edges: list[float], window: int) -> DataFrame:
    """Stream of the whole ring of every band that a micro-batch touches. ``bands``: sample_id, band, value.

    Values outside the edges count in the moments but in no bin; NULL values
    count nowhere; rows without a sample or band are not observations.
    """
    bins = len(edges) - 1
    rows = bands.filter("sample_id IS NOT NULL AND band IS NOT NULL").select(F.col("band").cast("int").alias("band"), F.col("sample_id").cast("bigint").alias("sample_id"), F.col("value").cast("double").alias("value"))
    trimmed = rows.mapInPandas(_sample_summaries(edges, window), f"band int, {summary_schema(bins)}")
    return trimmed.groupBy("band").transformWithStateInPandas(
        statefulProcessor=NewestSamples(window, bins), outputStructType=f"ring_band int, {summary_schema(bins)}", outputMode="Update", timeMode="None",
    )


def run_rings(rings: DataFrame, path: str, report, trigger: dict | None = None) -> DataFrame:
    """Run the ring stream; returns the rings as of its end.

    The table of rings holds each band once: a micro-batch replaces the bands it
    touches. ``report(rings)`` is computed after every micro-batch and stored
    under its number, so that a repeated micro-batch replaces its report.
    """
    spark = rings.sparkSession

    def current() -> DataFrame:
        return spark.read.schema(rings.schema).parquet(f"{path}/rings")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.repartition("ring_band").write.partitionBy("ring_band").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rings")
        report(current()).write.mode("overwrite").parquet(f"{path}/reports/batch={batch_id}")

    with rocksdb(spark):
        query = (
            rings.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/progress")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()
    return current()
