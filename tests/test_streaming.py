"""Streams over several micro-batches against batch or brute-force results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import drift
from scarpline.sources import shared
from scarpline.streaming import monitors, runner, spacing


def brute(rows, gap):
    kept, last = set(), {}
    for k, t in sorted(set(rows), key=lambda r: r[1]):
        if k not in last or t - last[k] >= gap:
            kept.add((k, t))
            last[k] = t
    return kept


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(7)
    hot = [("hot", float(t)) for t in rng.integers(0, 20000, 1000)]
    rest = [(f"k{i % 30}", float(t)) for i, t in enumerate(rng.integers(0, 20000, 300))]
    edge = [("edge", float(t)) for t in (0, 299, 300, 599, 600, 3600, 3899, 3900)]
    return [(k, 1.6e9 + t) for k, t in hot + rest + edge]


def test_keep_spaced_in_blocks(spark, log):
    df = spark.createDataFrame(log, "k string, s double").withColumn("ts", F.timestamp_seconds("s"))
    for block in (300.0, 1200.0, 86400.0):
        out = spacing.keep_spaced(df, "k", gap_s=300.0, block_s=block).collect()
        assert len(out) == len(set(out))
        assert {(r["k"], r["at_us"] / 1e6) for r in out} == brute(log, 300.0)


def test_null_and_empty_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 0), (None, 100), (None, 400), ("", 0), ("", 1), ("x", None)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = {(r["k"], r["at_us"] // 1_000_000) for r in spacing.keep_spaced(df, "k", gap_s=300.0).collect()}
    assert out == {(None, 0), (None, 400), ("", 0)}


def parts(spark, df, order, n, purpose):
    """Write df as n files in time order, so that a stream reads n batches."""
    path = shared.folder(spark, purpose)
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        chunk = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path


def test_cooldown_stream_over_batches(spark, log):
    df = spark.createDataFrame(log, "k string, s double").withColumn("ts", F.timestamp_seconds("s")).select("k", "ts")
    path = parts(spark, df, "ts", 5, "log")
    stream = runner.read_table_stream(spark, path, "part", df.schema, max_files=1)
    out = runner.run_append(spacing.keep_spaced_stream(stream, "k", 300.0), shared.folder(spark, "spaced")).collect()
    assert {(r["k"], r["at_us"] / 1e6) for r in out} == brute(log, 300.0)


def test_event_buffer_over_batches(spark):
    df = spark.range(1000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 17).cast("long").alias("user_id"), F.lit("view").alias("event_type")
    )
    path = parts(spark, df, "ts", 4, "events")
    stream = runner.read_table_stream(spark, path, "part", df.schema, max_files=1)
    streamed = {(r["user_id"], r["event_id"]) for r in monitors.recent_events_stream(stream, shared.folder(spark, "buffer")).collect()}
    batch = {(r["user_id"], r["event_id"]) for r in monitors.recent_events(df).collect()}
    assert streamed == batch


def test_tables_of_one_file_and_of_part_files_are_streams(spark, tmp_path):
    df = spark.range(90).select("id", (F.col("id") % 7).alias("k"))
    df.repartition(3).write.parquet(str(tmp_path / "parts" / "t.parquet"))
    df.limit(1).write.parquet(str(tmp_path / "parts" / "other.parquet"))
    (tmp_path / "single").mkdir()
    df.toPandas().to_parquet(tmp_path / "single" / "t.parquet")
    for kind in ("parts", "single"):
        stream = runner.read_table_stream(spark, str(tmp_path / kind), "t.parquet", df.schema, max_files=1)
        out = runner.run_append(stream, shared.folder(spark, "tables"))
        assert sorted(map(tuple, out.collect())) == [(i, i % 7) for i in range(90)]


def test_drift_over_batches(spark):
    df = spark.range(300 * 8).select(
        F.floor(F.col("id") / 8).alias("sample_id"), (F.col("id") % 2).cast("int").alias("band"), (F.col("id") % 8).cast("int").alias("pos"),
        (F.sin(F.col("id") * 1.7) * 2.5).alias("value"),
    )
    path = parts(spark, df, "sample_id", 4, "bands")
    stream = runner.read_table_stream(spark, path, "part", df.schema, max_files=1)
    streamed = {r["band"]: r for r in monitors.drift_report(monitors.drift_state(stream, shared.folder(spark, "drift"))).collect()}
    for r in drift.band_report(df, drift.baseline(spark, [0.0] * 2, [1.0] * 2)).collect():
        s = streamed[r["band"]]
        assert (s["psi"], s["mean"], s["std"]) == (pytest.approx(r["psi"]), pytest.approx(r["mean"]), pytest.approx(r["std"]))


def test_rate_violations_over_batches(spark):
    df = spark.range(900).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 5 < 4, 1).otherwise(2).cast("long").alias("user_id"))
    path = parts(spark, df, "ts", 3, "requests")
    stream = runner.read_table_stream(spark, path, "part", df.schema, max_files=1)
    streamed = {(r["window_start"], r["user_id"], r["rejected"]) for r in monitors.rate_violations_stream(stream, shared.folder(spark, "rates"), limit=40).collect()}
    batch = {(r["window_start"], r["user_id"], r["rejected"]) for r in monitors.rate_violations(monitors.request_rates(df), 40).collect()}
    assert streamed == batch and len(batch) == 15


def test_a_stopped_stream_goes_on(spark, log):
    """Two of five batches, a stop, then the rest with the same path: the batch answer."""
    df = spark.createDataFrame(log, "k string, s double").withColumn("ts", F.timestamp_seconds("s")).select("k", "ts")
    path, target = parts(spark, df, "ts", 5, "restart"), shared.folder(spark, "restarted")

    def stream():
        return spacing.keep_spaced_stream(runner.read_table_stream(spark, path, "part", df.schema, max_files=1), "k", 300.0)

    query = (
        stream().writeStream.outputMode("append").format("parquet").option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/progress").trigger(processingTime="0 seconds").start()
    )
    while query.lastProgress is None or query.lastProgress["batchId"] < 1:
        query.awaitTermination(0.2)
    query.stop()
    out = runner.run_append(stream(), target).collect()
    assert {(r["k"], r["at_us"] / 1e6) for r in out} == brute(log, 300.0) and len(out) == len(set(out))
