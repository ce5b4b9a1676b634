"""Feature and metadata tables handed to modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scarpline.functions.text import to_number
from scarpline.operators.contracts import FEATURE_ORDER, NUMERIC

# Column lists and the feature manifest.
REQUIRED = (
    "landslide_id", "latitude", "longitude", "ndvi", "ndvi_status", "elevation_m", "elevation_status",
    "slope_deg", "slope_status", "aspect_deg", "aspect_status", "data_source_type",
)
METADATA_COLUMNS = (
    "landslide_id", "date", "location", "district", "state", "country", "source", "source_url", "severity",
    "description", "data_quality_status", "ndvi_status", "rainfall_24h", "rainfall_3d", "rainfall_7d",
    "rainfall_status", "elevation_status", "slope_status", "aspect_status", "feature_extraction_status",
)
SUMMARISED = ("ndvi", "elevation_m", "slope_deg", "aspect_deg")
# name: (type, units, low, high, purpose)
MANIFEST = {
    "landslide_id": ("string", None, None, None, "Traceability to original historical record"),
    "latitude": ("float", "decimal degrees", -90.0, 90.0, "Spatial coordinate (Y)"),
    "longitude": ("float", "decimal degrees", -180.0, 180.0, "Spatial coordinate (X)"),
    "ndvi": ("float", None, -1.0, 1.0, "Vegetation health indicator from satellite imagery"),
    "elevation_m": ("float", "meters", None, None, "Terrain height from digital elevation model"),
    "slope_deg": ("float", "degrees", 0.0, 90.0, "Terrain steepness derived from elevation"),
    "aspect_deg": ("float", "degrees", 0.0, 360.0, "Terrain orientation (direction slope faces)"),
    "data_source_type": ("string", None, None, None, "Distinguishes synthetic/demo data from real observations"),
}


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    """The same frame; raises when a required column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def feature_projection(df: DataFrame) -> DataFrame:
    """Eight columns in contract order, numbers coerced to NULL when unreadable."""
    return require_columns(df).select(*[to_number(F.col(c)).alias(c) if c in NUMERIC else F.col(c) for c in FEATURE_ORDER])


def metadata_projection(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in METADATA_COLUMNS if c in df.columns])


def manifest_with_statistics(features: DataFrame, manifest=MANIFEST) -> DataFrame:
    """The manifest, each feature with its observed range and violations."""
    number = lambda c: F.col(c) if manifest[c][0] == "float" else F.lit(None).cast("double")
    aggs = []
    for name, (_, _, low, high, _) in manifest.items():
        out = (F.col(name) < low) | (F.col(name) > high) if low is not None else F.lit(False)
        aggs.append(
            F.struct(
                F.count(name).alias("valid"), F.min(number(name)).alias("observed_min"),
                F.max(number(name)).alias("observed_max"), F.count_if(out).alias("out_of_range"),
            ).alias(name)
        )
    totals = features.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"), F.lit(kind).alias("data_type"), F.lit(units).cast("string").alias("units"),
                F.lit(low).cast("double").alias("valid_min"), F.lit(high).cast("double").alias("valid_max"),
                F.lit(purpose).alias("purpose"), F.col(name).alias("s"),
            )
            for name, (kind, units, low, high, purpose) in manifest.items()
        ]
    )
    return totals.select(F.explode(rows).alias("f")).select(
        "f.feature", "f.data_type", "f.units", "f.valid_min", "f.valid_max", "f.purpose", "f.s.*"
    )


def missing_summary(features: DataFrame, columns=SUMMARISED) -> DataFrame:
    """(feature, valid, missing) per summarised column, one pass."""
    totals = features.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    long = totals.unpivot(["total"], list(columns), "feature", "valid")
    return long.select("feature", "valid", (F.col("total") - F.col("valid")).alias("missing"))
