"""Streams with bounded state: every micro-batch and restarts against batch results."""

import glob
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import drift
from scarpline.sources import shared
from scarpline.streaming import buffers, monitors, runner
from tests.test_streaming import parts


@pytest.fixture(scope="module")
def events(spark):
    draw = np.random.default_rng(11)
    rows = [(i, float(draw.integers(0, 50_000)), None if i % 40 == 0 else 1 if i % 3 == 0 else int(draw.integers(2, 60)), "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string")
    return df.select("event_id", F.when(F.col("event_id") % 97 != 5, F.timestamp_seconds(F.col("s") + 1.6e9)).alias("ts"), "user_id", "event_type")


def held(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["user_id"]].add((r["event_id"], r["ts"], r["event_type"]))
    return out


def test_buffer_after_restarts(spark, events):
    """Files in arrival order, newer and older events mixed; stopped and started again after each half."""
    source, out = parts(spark, events.filter("event_id < 1500"), "event_id", 3, "buffer-source"), shared.folder(spark, "buffer")
    stream = lambda: runner.read_table_stream(spark, source, "part", events.schema, max_files=1)
    first = monitors.recent_events_stream(stream(), out, keep=7)
    assert held(first) == held(monitors.recent_events(events.filter("event_id < 1500 AND ts IS NOT NULL"), 7))
    events.filter("event_id >= 1500").repartition(2).write.mode("append").parquet(source)
    second = monitors.recent_events_stream(stream(), out, keep=7)
    expected = held(monitors.recent_events(events.filter("ts IS NOT NULL"), 7))
    assert held(second) == expected and second.count() <= 7 * len(expected)


def test_idle_holders_are_forgotten(spark):
    rows = [(1, 0, 5), (2, 10, 6), (3, 100_000, 7), (4, 200_000, 7), (5, 300_000, 7)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("x").alias("event_type"))
    source, out = parts(spark, df, "ts", 5, "idle-source"), shared.folder(spark, "idle")
    left = monitors.recent_events_stream(runner.read_table_stream(spark, source, "part", df.schema, max_files=1), out, idle="1 hour")
    assert {r["user_id"] for r in left.collect()} == {7}


@pytest.fixture(scope="module")
def bands(spark):
    draw = np.random.default_rng(5)
    rows = []
    for sample in range(60):
        for band in range(4):
            if band == 3 and sample % 7:
                continue  # a band that few samples have
            rows += [(sample, band, None if draw.random() < 0.05 else float(draw.normal(0, 1.5))) for _ in range(6)]
    rows += [(3, 0, v) for v in (-3.0, 3.0, 1.2000000000000002, 9.0)] + [(None, 1, 0.5), (5, None, 0.5)]
    return spark.createDataFrame(rows, "sample_id long, band int, value double")


def near(a, b):
    assert {r["band"] for r in a} == {r["band"] for r in b}
    for x, y in zip(sorted(a, key=lambda r: r["band"]), sorted(b, key=lambda r: r["band"]), strict=True):
        for c in ("psi", "mean", "std"):
            assert (x[c] is None) == (y[c] is None) and (x[c] is None or abs(x[c] - y[c]) < 1e-9)


@pytest.mark.parametrize("order", ["sample_id", "hash(value)"])
def test_drift_after_every_micro_batch(spark, bands, order):
    """Each stored report equals the batch report over the files read so far; the rings stay within the window."""
    df = bands.withColumn("o", F.expr(order))
    source, out = shared.folder(spark, "bands"), shared.folder(spark, "rings")
    rows = df.orderBy("o").collect()
    size = -(-len(rows) // 3)
    window = 10
    for i in range(3):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).drop("o").coalesce(1).write.mode("append").parquet(source)
        stream = runner.read_table_stream(spark, source, "part", bands.schema, max_files=1)
        state = monitors.drift_state(stream, out, window=window, bins=10)
        whole = spark.createDataFrame(rows[: (i + 1) * size], df.schema).drop("o").filter("sample_id IS NOT NULL AND band IS NOT NULL")
        expected = drift.summarise(drift.last_samples(whole, window), ["band"]).withColumn("psi", drift.psi_of_counts())
        near(monitors.drift_report(state).collect(), expected.collect())
        stored = sorted(glob.glob(f"{out.removeprefix('file:')}/reports/batch=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
        near(spark.read.parquet(stored[-1]).collect(), expected.collect())
        assert spark.read.parquet(f"{out}/rings").count() <= window * 4
        assert len(stored) == i + 1


def test_summaries_of_a_task_are_trimmed():
    import pandas as pd

    run = buffers._sample_summaries(drift.edges(10), 3)
    chunks = [pd.DataFrame({"band": 0, "sample_id": range(a, a + 50), "value": 0.1}) for a in (0, 50, 20)]
    out = pd.concat(run(iter(chunks)))
    assert out["sample_id"].tolist() == [97, 98, 99] and out["n"].tolist() == [1, 1, 1]
    kept = pd.concat(buffers._newest_of_task(2)(iter([pd.DataFrame({"holder": [1, 1, None, 1], "at_us": [1, 3, 2, 2], "event_id": [1, 2, 3, 4], "event_type": "x"})])))
    assert sorted(kept["event_id"]) == [2, 3, 4]


def test_joined_alerts_with_late_and_missing_signals(spark):
    """Three streams in four micro-batches; complete sets equal the batch join, incomplete ones wait for the watermark."""
    schema = {"models": "trip_id long, s long, ml_risk string", "routes": "trip_id long, s long, route_risk string", "images": "trip_id long, s long, landslide boolean, flooding boolean, road_damage boolean"}
    levels = ["LOW", "Medium", "HIGH", "odd"]
    rows = {
        "models": [(t, t * 60, levels[t % 4]) for t in range(80)],
        "routes": [(t, t * 60 + (3000 if t % 7 == 0 else 120), levels[t % 3]) for t in range(80) if t % 5],
        "images": [(t, t * 60 - 200, t % 11 == 0, t % 4 == 0, None) for t in range(80) if t % 6],
    }
    far = {"models": (-1, 10**6, None), "routes": (-1, 10**6, None), "images": (-1, 10**6, None, None, None)}
    tables, streams, folders = {}, {}, {}
    for name, data in rows.items():
        df = spark.createDataFrame([*data, far[name]], schema[name]).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_600_000_000)).drop("s")
        tables[name] = df
        folders[name] = parts(spark, df, "ts", 4, f"signals-{name}")
        streams[name] = runner.read_table_stream(spark, folders[name], "part", df.schema, max_files=1)
    for name, df in tables.items():  # a second, later mark lets the second join follow
        df.filter("trip_id = -1").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).coalesce(1).write.mode("append").parquet(folders[name])
    order = ("models", "routes", "images")
    batch = monitors.joined_alerts(*[tables[n] for n in order])
    streamed = monitors.joined_alerts_stream(*[streams[n] for n in order], shared.folder(spark, "joined"))
    key = lambda df: sorted(str(r.asDict()) for r in df.filter("trip_id >= 0").collect())
    expected = key(batch)
    gone = {r["trip_id"] for r in batch.collect()} - {-1} - {r["trip_id"] for r in streamed.collect()}
    assert gone == set()
    assert key(streamed) == expected and len(expected) == 80
    out = {r["trip_id"]: r for r in streamed.filter("trip_id >= 0").collect()}
    assert out[35]["missing"] == ["route"] and out[30]["missing"] == ["route", "image"] and out[1]["missing"] == []
    assert out[7]["missing"] == ["route"] and out[3]["overall_risk"] is None  # too far apart; an unreadable level


def test_signals_behind_the_watermark_are_late(spark):
    models = [(1, 0), (2, 50_000), (3, 60_000)]
    routes = [(9, 100_000), (9, 100_001), (2, 50_000), (3, 60_000)]  # in this order of arrival: 2 comes after the watermark has passed it
    m = spark.createDataFrame(models, "trip_id long, s long").select("trip_id", F.timestamp_seconds(F.col("s") + 1_600_000_000).alias("ts"), F.lit("LOW").alias("ml_risk"))
    image = spark.createDataFrame([(1, 0), (9, 100_000)], "trip_id long, s long").select("trip_id", F.timestamp_seconds(F.col("s") + 1_600_000_000).alias("ts"), *[F.lit(False).alias(f) for f in ("landslide", "flooding", "road_damage")])
    folders = {}
    for name, df in (("m", m), ("i", image)):
        folders[name] = (parts(spark, df, "ts", 1, f"late-{name}"), df.schema)
    r = spark.createDataFrame([(n, t, s) for n, (t, s) in enumerate(routes)], "n long, trip_id long, s long")
    r = r.select("n", "trip_id", F.timestamp_seconds(F.col("s") + 1_600_000_000).alias("ts"), F.lit("HIGH").alias("route_risk"))
    folders["r"] = (parts(spark, r, "n", 4, "late-r"), r.schema)
    streams = [runner.read_table_stream(spark, folders[k][0], "part", folders[k][1], max_files=1) for k in ("m", "r", "i")]
    out = monitors.joined_alerts_stream(*streams, shared.folder(spark, "late")).collect()
    assert {(r["trip_id"], tuple(r["missing"])) for r in out} == {(1, ("route",)), (2, ("route", "image"))}  # 3 still waits
