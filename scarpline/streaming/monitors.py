"""Streaming drift, event buffers, rate limits, request metrics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.functions.levels import probability_level
from scarpline.operators import drift, risk_rules
from scarpline.streaming import buffers, runner

# Limits of the service.
RATE_LIMIT = 60
BUFFER = 20
SHOWN = 5
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


# --- drift over the newest samples ---------------------------------------------------


def drift_state(bands: DataFrame, path: str, window: int = drift.WINDOW, bins: int = drift.BINS) -> DataFrame:
    """Bin counts and power sums of the newest samples of a stream, one row per (sample, band).

    Each band holds a ring of at most ``window`` samples, and the newest
    samples over all bands are among those of the rings. A report is stored
    after every micro-batch below ``path``/reports.
    """
    report = lambda rings: drift_report(drift.last_samples(_of_band(rings), window), bins)
    rings = buffers.run_rings(buffers.newest_samples(bands, drift.edges(bins), window), path, report)
    return drift.last_samples(_of_band(rings), window)


def _of_band(rings: DataFrame) -> DataFrame:
    return rings.withColumnRenamed("ring_band", "band")


def drift_report(state: DataFrame, bins: int = drift.BINS) -> DataFrame:
    """PSI, mean and deviation per band from merged sample summaries."""
    n, mean = F.sum("n"), F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    merged = state.groupBy("band").agg(
        *[F.sum(f"b{i}").alias(f"b{i}") for i in range(1, bins + 1)], mean.alias("mean"), (F.sum("squares") / F.nullif(n, F.lit(0))).alias("_square")
    )
    variance = F.greatest(F.col("_square") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return merged.select("band", drift.psi_of_counts(bins).alias("psi"), "mean", F.sqrt(variance).alias("std"))


# --- recent events per holder ----------------------------------------------------------


def recent_events(events: DataFrame, keep: int = BUFFER) -> DataFrame:
    """Batch form: the newest events per holder; trimmed before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= keep)


def recent_events_stream(events: DataFrame, path: str, keep: int = BUFFER, idle: str | None = None) -> DataFrame:
    """Stream form: the state of the stream holds the buffers, at most ``keep`` events per holder."""
    buffers.run_state(buffers.newest_events(events, keep, idle=idle), path)
    held = buffers.read_state(events.sparkSession, path, "recent")
    return held.select("event_id", F.timestamp_micros("at_us").alias("ts"), buffers.unmarked(dict(events.dtypes)["user_id"]).alias("user_id"), "event_type")


# --- rates and request metrics -----------------------------------------------------------


def _window_start() -> Column:
    return F.col("window.start").alias("window_start")


def request_rates(requests: DataFrame, minutes: int = 1) -> DataFrame:
    counts = requests.groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(_window_start(), "user_id", "requests")


def rate_violations(rates: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Clients above the limit and how many of their requests are rejected."""
    return rates.filter(F.col("requests") > limit).withColumn("rejected", F.col("requests") - limit)


def rate_violations_stream(requests: DataFrame, path: str, limit: int = RATE_LIMIT, minutes: int = 1, lateness: str = "10 minutes") -> DataFrame:
    rates = request_rates(requests.withWatermark("ts", lateness), minutes)
    return rate_violations(runner.run_update(rates, path, ["window_start", "user_id"]), limit)


def request_metrics(requests: DataFrame, width: str = "1 day") -> DataFrame:
    """Counters, duration sum and cumulative duration buckets per endpoint."""
    buckets = [F.count_if(F.col("duration_s") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in DURATION_BUCKETS]
    grouped = requests.groupBy(F.window("ts", width), "method", "endpoint", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.count("exception_type").alias("exceptions"), F.sum("duration_s").alias("duration_sum"), *buckets
    )
    return grouped.select(_window_start(), *[c for c in grouped.columns if c != "window"])


def request_metrics_stream(requests: DataFrame, path: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    metrics = request_metrics(requests.withWatermark("ts", lateness), width)
    return runner.run_update(metrics, path, ["window_start", "method", "endpoint", "status"])


def exception_counts(requests: DataFrame) -> DataFrame:
    failed = requests.filter(F.col("exception_type").isNotNull())
    return failed.groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))


# --- alerts ------------------------------------------------------------------------------


def alerts_from_readings(readings: DataFrame) -> DataFrame:
    """Alert columns for readings (report_id, ts, probability)."""
    tier = probability_level(F.col("probability"))
    three = F.when(tier == "VERY_HIGH", "HIGH").when(tier == "MODERATE", "MEDIUM").otherwise(tier)
    rated = readings.withColumn("overall_risk", three)
    return risk_rules.notification(risk_rules.alert(rated), keep=["report_id", "ts"]).filter("display")


def alerts_stream(readings: DataFrame, path: str, lateness: str = "10 minutes") -> DataFrame:
    """Append-only alerts; a report repeated within the lateness alerts once."""
    unique = readings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["report_id"])
    return runner.run_append(alerts_from_readings(unique), path)


def joined_alerts(models: DataFrame, route_levels: DataFrame, images: DataFrame, apart: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Alerts from model, route and image signals of a trip that arrive on their own streams.

    ``models``: trip_id, ts, ml_risk. ``route_levels``: trip_id, ts, route_risk.
    ``images``: trip_id, ts and the flags. A route or image signal belongs to a
    model signal of its trip at most ``apart`` from it. Complete sets alert at
    once; the others once the watermark shows that nothing can follow, with the
    absent signals named and counted as LOW. Signals older than the watermark
    are late and left out. State is bounded by the signals of the interval and
    the lateness. The same function joins tables.
    """
    m = models.withWatermark("ts", lateness)
    r = route_levels.select(F.col("trip_id").alias("r_trip"), F.col("ts").alias("r_ts"), "route_risk").withWatermark("r_ts", lateness)
    i = images.select(F.col("trip_id").alias("i_trip"), F.col("ts").alias("i_ts"), *risk_rules.FLAGS).withWatermark("i_ts", lateness)
    bound = F.expr(f"INTERVAL {apart}")
    close = lambda other: (F.col(other) >= F.col("ts") - bound) & (F.col(other) <= F.col("ts") + bound)
    met = m.join(r, (F.col("trip_id") == F.col("r_trip")) & close("r_ts"), "left_outer").select("trip_id", "ts", "ml_risk", "r_trip", "route_risk")
    met = met.join(i, (F.col("trip_id") == F.col("i_trip")) & close("i_ts"), "left_outer")
    absent = {"route": F.col("r_trip").isNull(), "image": F.col("i_trip").isNull()}
    rated = met.withColumns(
        {
            "missing": F.array_compact(F.array(*[F.when(gone, F.lit(name)) for name, gone in absent.items()])),
            "route_risk": F.when(absent["route"], "LOW").otherwise(F.col("route_risk")),
            "image_risk": F.when(absent["image"], "LOW").otherwise(risk_rules.image_level("A")),
        }
    )
    alerted = risk_rules.alert(risk_rules.explanation(risk_rules.overall_risk(rated)))
    return alerted.select(
        "trip_id", "ts", "ml_risk", "route_risk", "image_risk", "overall_risk", "summary",
        F.lit("SAFETY_ALERT").alias("type"), "alert_level", "message", F.col("alert_required").alias("display"), "missing",
    )


def joined_alerts_stream(models: DataFrame, route_levels: DataFrame, images: DataFrame, path: str, apart: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Stream form. Each of the two joins passes on the watermark one micro-batch later, so incomplete sets follow two micro-batches after it."""
    return runner.run_append(joined_alerts(models, route_levels, images, apart, lateness), path)
