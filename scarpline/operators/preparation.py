"""Labelled environment rows: validation, scaling and reproducible splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scarpline.functions.text import count_true, strip, to_number
from scarpline.operators.dataset_qa import run_rules
from scarpline.operators.skew import hash_rank

# Feature columns, target and physical ranges.
FEATURES = (
    "rainfall_mm", "soil_moisture_pct", "slope_deg", "elevation_m",
    "temperature_c", "river_level_m", "vegetation_index", "landslide_history",
)
TARGET = "risk_level"
LABELS = ("LOW", "MEDIUM", "HIGH")
PHYSICAL_RANGES = {
    "rainfall_mm": (0, None),
    "soil_moisture_pct": (0, 100),
    "slope_deg": (0, None),
    "elevation_m": (0, None),
    "river_level_m": (0, None),
    "vegetation_index": (0, 1),
}
SEED = 42
TEST_SHARE = 0.2


def labelled_check(df: DataFrame) -> DataFrame:
    """Violations of the labelled table, before labels are normalised."""
    missing = [c for c in (*FEATURES, TARGET) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    rules = [("ERROR", "empty dataset", (F.count(F.lit(1)) == 0).cast("bigint"))]
    rules += [("ERROR", f"missing {c}", count_true(F.col(c).isNull())) for c in (*FEATURES, TARGET)]
    rules += [("ERROR", f"non-numeric {c}", count_true(F.col(c).isNotNull() & to_number(F.col(c)).isNull())) for c in FEATURES]
    rules.append(("ERROR", "invalid risk level", count_true(~F.col(TARGET).isin(*LABELS))))
    return run_rules(df, "labelled_table", rules)


def raise_on_findings(findings: DataFrame) -> None:
    """Turn findings into an exception; the message names every error."""
    found = findings.filter("severity = 'ERROR'").select(F.concat_ws(": ", "detail", F.col("n").cast("string")).alias("m"))
    message = found.agg(F.array_join(F.array_sort(F.collect_list("m")), "; ")).first()[0]
    if message:
        raise ValueError(message)


def normalise_labels(df: DataFrame, keep=()) -> DataFrame:
    """Fixed column order, numbers typed, label trimmed and upper-cased."""
    numbers = [to_number(F.col(c)).alias(c) for c in FEATURES]
    return df.select(*keep, *numbers, F.upper(strip(F.col(TARGET).cast("string"))).alias(TARGET))


def range_check(df: DataFrame) -> DataFrame:
    rules = []
    for c, (low, high) in PHYSICAL_RANGES.items():
        number = to_number(F.col(c))
        rules.append(("ERROR", f"{c} below {low}", count_true(number < low)))
        if high is not None:
            rules.append(("ERROR", f"{c} above {high}", count_true(number > high)))
    flag = to_number(F.col("landslide_history"))
    rules.append(("ERROR", "landslide_history not 0 or 1", count_true(~F.coalesce(flag.isin(0.0, 1.0), F.lit(False)))))
    return run_rules(df, "physical_ranges", rules)


def feature_columns(df: DataFrame, keep=()) -> DataFrame:
    return df.select(*keep, *FEATURES)


def target_column(df: DataFrame, keep=()) -> DataFrame:
    return df.select(*keep, TARGET)


def scaling_statistics(df: DataFrame, columns=FEATURES) -> DataFrame:
    """One row of means and population deviations; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    stats = df.agg(*aggs)
    return stats.withColumns({f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns})


def scale(df: DataFrame, columns=FEATURES, statistics: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation with one-row broadcast statistics."""
    stats = scaling_statistics(df, columns) if statistics is None else statistics
    joined = df.join(F.broadcast(stats), how="inner")
    scaled = {c: (F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def column_means(df: DataFrame, columns=FEATURES) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([], list(columns), "feature", "mean")


def stratified_split(df: DataFrame, key: str = "env_id", label: str = TARGET, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split``: the first ceil(share * n) rows of each label in hash order test."""
    ranked = hash_rank(df, label, F.col(key), seed)
    cut = F.ceil(F.col("label_total") * F.lit(test_share))
    return ranked.withColumn("split", F.when(F.col("hash_rank") <= cut, "test").otherwise("train")).drop("hash_rank", "label_total")


def stratified_folds(df: DataFrame, key: str = "env_id", label: str = TARGET, k: int = 3, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1, balanced within each label."""
    ranked = hash_rank(df, label, F.col(key), seed)
    return ranked.withColumn("fold", ((F.col("hash_rank") - 1) % k).cast("int")).drop("hash_rank", "label_total")


def class_distribution(df: DataFrame, by=(), label: str = TARGET) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def training_gate(df: DataFrame) -> DataFrame:
    """NULL counts that must be zero before training."""
    missing = [c for c in (*FEATURES, TARGET) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing training columns: {missing}")
    rules = [("ERROR", f"null {c}", count_true(F.col(c).isNull())) for c in (*FEATURES, TARGET)]
    return run_rules(df, "training_gate", rules)
