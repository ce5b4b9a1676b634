"""Report, alert and zone tables: defaults, required columns and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Keys, required columns and defaults of the relational tables.
KEYS = {"reports": ("report_id",), "alerts": ("alert_id",), "risk_zones": ("zone_id",)}
REQUIRED = {
    "reports": ("report_id", "latitude", "longitude", "hazard_type", "description"),
    "alerts": ("alert_id", "severity"),
    "risk_zones": ("zone_id", "latitude", "longitude"),
}
DEFAULTS = {
    "reports": {"user_id": "citizen-anon", "severity": "MEDIUM", "status": "PENDING"},
    "alerts": {"is_active": True},
    "risk_zones": {"radius_meters": 500.0},
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its column defaults filled in."""
    return with_defaults(spark.read.parquet(path), name)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int) -> DataFrame:
    """The same table from a database, read in key ranges by parallel tasks."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions
    )
    return with_defaults(reader.load(), name)


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    present = {c: x for c, x in DEFAULTS[name].items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in present.items()}) if present else df


def table_check(df: DataFrame, name: str) -> DataFrame:
    """Uniqueness and required columns as a check, since they are no constraint."""
    keys = KEYS[name]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED[name]])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"))
    return groups.agg(
        F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_required"),
    )
