"""CSV sources and sinks of the incident and labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scarpline.functions.text import null_token
from scarpline.operators.preparation import FEATURES, TARGET
from scarpline.operators.validation import INCIDENT_COLUMNS

_CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def text_schema(columns=INCIDENT_COLUMNS, leading=()) -> T.StructType:
    return T.StructType([*leading, *[T.StructField(c, T.StringType()) for c in columns]])


def read_incidents(spark: SparkSession, path: str, leading=(), quoted_newlines: bool = False) -> DataFrame:
    """All columns as text with missing-value tokens turned into NULL.

    Files split by blocks unless ``quoted_newlines`` asks for whole-file
    parsing of records that contain line breaks.
    """
    raw = spark.read.options(**_CSV, multiLine=quoted_newlines).schema(text_schema(leading=leading)).csv(path)
    return raw.withColumns({c: null_token(F.col(c)) for c in INCIDENT_COLUMNS})


def read_cleaned(spark: SparkSession, path: str, leading=()) -> DataFrame:
    """The cleaned stage: dates stay text, coordinates are doubles."""
    columns = (*INCIDENT_COLUMNS, "data_quality_status")
    fields = [T.StructField(c, T.DoubleType() if c in ("latitude", "longitude") else T.StringType()) for c in columns]
    return spark.read.options(**_CSV).schema(T.StructType([*leading, *fields])).csv(path)


def read_labelled(spark: SparkSession, path: str, leading=()) -> DataFrame:
    """Eight numbers and a label."""
    fields = [T.StructField(c, T.IntegerType() if c == "landslide_history" else T.DoubleType()) for c in FEATURES]
    return spark.read.options(**_CSV).schema(T.StructType([*leading, *fields, T.StructField(TARGET, T.StringType())])).csv(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Stage output as parquet, or as CSV for exchange."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.format(fmt).save(path)
