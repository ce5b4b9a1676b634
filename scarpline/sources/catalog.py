"""Dataset inventories, metadata sidecars, registry and manifest outputs."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Dataset kinds by file suffix.
KINDS = {".tif": "raster", ".tiff": "raster", ".csv": "csv", ".geojson": "vector", ".json": "json"}
UPLOAD_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
UPLOAD_MIME_TYPES = ("image/jpeg", "image/png", "image/webp")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def kind_of(path: Column) -> Column:
    out = None
    for end, kind in KINDS.items():
        out = F.when(suffix(path) == end, kind) if out is None else out.when(suffix(path) == end, kind)
    return out.otherwise("other")


def dataset_id(path: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.translate(path, "/.", "__"))


def with_dataset_id(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset_id", dataset_id(F.col("path")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, modified) of every file below a folder, at any depth; paths are relative to it.

    Only names, sizes and times are read. Files without bytes are not listed, and files whose names begin with a dot
    or an underscore count as hidden and are left out.
    """
    base = urlsplit(root).path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    return found.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def file_inventory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Id, type by suffix and size of every file below a folder."""
    return describe_files(list_files(spark, root), prefix)


def describe_files(listed: DataFrame, prefix: str = "") -> DataFrame:
    """Id, type by suffix and size of every file of a listing (path, size_bytes)."""
    return listed.select(dataset_id(F.col("path"), prefix).alias("dataset_id"), "path", kind_of(F.col("path")).alias("kind"), "size_bytes")


def join_sidecars(datasets: DataFrame, sidecars: DataFrame, default_module: str = "M2-A") -> DataFrame:
    """Module, purpose and status from the sidecar with the same stem."""
    keyed = with_dataset_id(datasets).withColumn("stem", stem(F.col("path")))
    joined = keyed.join(sidecars, "stem", "left").drop("stem")
    return joined.withColumns(
        {
            "module": F.coalesce("module", F.lit(default_module)),
            "purpose": F.coalesce("purpose", F.lit("unknown")),
            "status": F.coalesce("status", F.lit("unknown")),
            "kind": kind_of(F.col("path")),
        }
    )


def registry(described: DataFrame, target_crs: str = "EPSG:4326") -> DataFrame:
    """Registry entries of all datasets without an error."""
    return described.filter(~F.col("has_error")).select(
        "dataset_id", "module", "purpose", "path",
        F.col("kind").alias("format"),
        F.coalesce("crs", F.lit("unknown")).alias("original_crs"),
        F.when(F.col("crs").isNotNull(), F.lit(target_crs)).alias("integration_crs"),
        "status",
    )


def manifest(described: DataFrame, target_crs: str = "EPSG:4326") -> DataFrame:
    """The fifteen-column integration manifest."""
    return described.filter(~F.col("has_error")).select(
        "dataset_id", "module",
        F.col("purpose").alias("dataset_name"),
        F.col("path").alias("file_path"),
        F.col("kind").alias("file_format"),
        F.coalesce("crs", F.lit("unknown")).alias("crs"),
        F.when(F.col("crs").isNotNull(), F.lit(target_crs)).alias("integration_crs"),
        F.when(F.col("kind").isin("raster", "vector"), "yes").otherwise("no").alias("spatial"),
        F.coalesce(F.col("row_count").cast("string"), F.lit("N/A")).alias("record_count"),
        "min_x", "max_x", "min_y", "max_y", "status",
        F.lit("").alias("notes"),
    )


def upload_check(uploads: DataFrame, limit_mb: float = 10.0) -> DataFrame:
    """Accept or reject each upload by extension, MIME type and size."""
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    reason = (
        F.when(F.coalesce(F.col("file_name"), F.lit("")) == "", "no_file_name")
        .when(~extension.isin(*UPLOAD_EXTENSIONS), "bad_extension")
        .when(~F.col("mime_type").isin(*UPLOAD_MIME_TYPES), "bad_mime_type")
        .when(F.col("size_bytes") > int(limit_mb * 1024 * 1024), "too_large")
    )
    return uploads.select("upload_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, kind, rows, column_no, column, dtype), one row per column."""
    parts = []
    for name, df in tables.items():
        fields = F.array(
            *[
                F.struct(F.lit(i).alias("column_no"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"))
                for i, f in enumerate(df.schema, start=1)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        rows = counted.select(F.lit(name).alias("dataset"), "row_count", F.explode(fields).alias("f"))
        parts.append(rows.select("dataset", "row_count", "f.column_no", "f.column_name", "f.dtype"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """Distinct top-level key sets of JSON objects, or list lengths."""
    c = F.col(column)
    keys = F.array_join(F.sort_array(F.json_object_keys(c)), ",")
    length = F.json_array_length(c)
    shape = F.when(length.isNotNull(), "list").when(keys.isNotNull(), "object").otherwise("other")
    return df.select(shape.alias("shape"), keys.alias("keys"), length.alias("length")).groupBy("shape", "keys", "length").agg(
        F.count(F.lit(1)).alias("n")
    )
