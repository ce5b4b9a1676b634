"""Distribution drift of normalised band values against a standard normal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Monitor settings.
WINDOW = 100
BINS = 10
LOW, HIGH = -3.0, 3.0
PSI_LIMIT = 0.2
FLOOR = 1e-10


def edges(bins: int = BINS) -> list[float]:
    step = (HIGH - LOW) / bins
    return [LOW + step * i for i in range(bins)] + [HIGH]


def expected_shares(bins: int = BINS) -> list[float]:
    """Normal probability of each bin, rescaled to sum to one."""
    cdf = [0.5 * (1.0 + math.erf(e / math.sqrt(2.0))) for e in edges(bins)]
    raw = [b - a for a, b in zip(cdf, cdf[1:])]
    total = sum(raw)
    return [x / total for x in raw]


def last_samples(bands: DataFrame, window: int = WINDOW) -> DataFrame:
    """Values of the newest samples (highest ids); the window size bounds the broadcast.

    Distinct ids are found by partial aggregation before the top-N.
    """
    newest = bands.select("sample_id").distinct().orderBy(F.desc("sample_id")).limit(window)
    return bands.join(F.broadcast(newest), "sample_id", "left_semi")


def last_values(bands: DataFrame, window: int = WINDOW) -> DataFrame:
    """The newest values per band; row_number <= n trims before the shuffle."""
    w = Window.partitionBy("band").orderBy(F.desc("sample_id"), F.desc("pos"))
    return bands.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window).drop("_rn")


def bin_of(value: Column, bins: int = BINS) -> Column:
    """1..bins; the last bin includes its upper edge; NULL outside the range.

    Compares with the edges themselves: an arithmetic bucket would put values
    such as 1.2 on the other side of an edge that is 1.2000000000000002.
    """
    reached = [(value >= F.lit(e)).cast("int") for e in edges(bins)[:-1]]
    return F.when(value.between(LOW, HIGH), sum(reached[1:], reached[0]))


def histogram(bands: DataFrame, bins: int = BINS) -> DataFrame:
    """(band, bin, n, share) of the in-range values, empty bins included."""
    counts = bands.select("band", bin_of(F.col("value"), bins).alias("bin")).groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("band").distinct().select("band", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    inside = counts.filter("bin IS NOT NULL")
    totals = inside.groupBy("band").agg(F.sum("n").alias("total"))
    full = grid.join(inside, ["band", "bin"], "left").join(totals, "band", "left")
    n = F.coalesce("n", F.lit(0))
    share = F.when(F.col("total") > 0, n.cast("double") / F.col("total").cast("double")).otherwise(0.0)
    return full.select("band", "bin", n.alias("n"), share.alias("share"))


def expected_table(spark: SparkSession, bins: int = BINS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(expected_shares(bins), start=1)), "bin int, expected double")


def _term(actual: Column, expected: Column) -> Column:
    a = F.when(actual == 0, FLOOR).otherwise(actual)
    e = F.when(expected == 0, FLOOR).otherwise(expected)
    return (a - e) * F.log(a / e)


def psi(shares: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per band from histogram shares."""
    expected = F.broadcast(expected_table(shares.sparkSession, bins))
    return shares.join(expected, "bin").groupBy("band").agg(F.sum(_term(F.col("share"), F.col("expected"))).alias("psi"))


def summarise(bands: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Per key: bin counts and moments. Mergeable, so it also serves streams."""
    b = bin_of(F.col("value"), bins)
    return bands.groupBy(*keys).agg(
        *[F.count_if(b == i).alias(f"b{i}") for i in range(1, bins + 1)],
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )


def psi_of_counts(bins: int = BINS) -> Column:
    """PSI from the bin-count columns of ``summarise``, without a join."""
    counts = [F.col(f"b{i}").cast("double") for i in range(1, bins + 1)]
    total = sum(counts[1:], counts[0])
    terms = [_term(F.when(total > 0, c / total).otherwise(0.0), F.lit(e)) for c, e in zip(counts, expected_shares(bins))]
    return sum(terms[1:], terms[0])


def baseline(spark: SparkSession, means: list[float], stds: list[float]) -> DataFrame:
    if len(means) != len(stds):
        raise ValueError("band_means and band_stds must have the same length")
    return spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(means, stds))], "band int, mean double, std double")


def baseline_check(baseline_table: DataFrame) -> DataFrame:
    """Bands of a stored baseline, and whether every band has both numbers."""
    return baseline_table.agg(
        F.count(F.lit(1)).alias("bands"), (F.count("mean") == F.count("std")).alias("lengths_match"), F.count_distinct("band").alias("distinct_bands")
    )


def band_report(bands: DataFrame, baseline_table: DataFrame | None, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """PSI, mean and deviation per baseline band over the newest samples.

    Bands without data report 0, 0, 1. Without a baseline there are no rows.
    """
    recent = last_samples(bands, window)
    stats = summarise(recent, ["band"], bins).withColumn("psi", psi_of_counts(bins))
    if baseline_table is None:
        return stats.select("band", "psi", "mean", "std").limit(0)
    wanted = F.broadcast(baseline_table.select("band"))
    out = wanted.join(stats, "band", "left")
    return out.select("band", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"))


def verdict(bands: DataFrame, baseline_table: DataFrame | None, window: int = WINDOW, limit: float = PSI_LIMIT) -> DataFrame:
    """One row: baseline present, drift found, bands, newest samples counted."""
    report = band_report(bands, baseline_table, window)
    summary = report.agg(
        F.lit(baseline_table is not None).alias("baseline_available"),
        F.coalesce(F.bool_or(F.col("psi") > limit), F.lit(False)).alias("drift_detected"),
        F.count(F.lit(1)).alias("bands"), F.count_if(F.col("psi") > limit).alias("drifting_bands"),
    )
    samples = bands.select("sample_id").distinct().limit(window).agg(F.count(F.lit(1)).alias("sample_count"))
    return summary.join(F.broadcast(samples), how="inner")
