"""Checks on raw incident records (all columns are text).

A record is identified by an ordinal column. Counts and findings come from
flag columns evaluated in one scan; only duplicate ids need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.functions.text import count_true, is_missing, outside, strip, to_iso_date, to_number
from scarpline.operators.skew import add_totals

# The field groups of an incident record.
REQUIRED = ("landslide_id", "date", "latitude", "longitude")
RECOMMENDED = ("location", "district", "state", "country", "source", "source_url")
OPTIONAL = ("severity", "description")
INCIDENT_COLUMNS = (
    "landslide_id", "date", "latitude", "longitude", "location", "district",
    "state", "country", "source", "source_url", "severity", "description",
)
COORDINATE_RANGES = {"latitude": (-90, 90), "longitude": (-180, 180)}
PREVIEW_ROWS = 10


def _absent_or_missing(df: DataFrame, field: str) -> Column:
    return is_missing(F.col(field)) if field in df.columns else F.lit(True)


def missing_counts(df: DataFrame, fields) -> DataFrame:
    """(field, missing_count) for fields that are blank or absent anywhere."""
    totals = df.agg(*[count_true(_absent_or_missing(df, f)).alias(f) for f in fields])
    return totals.unpivot([], list(fields), "field", "missing_count").filter("missing_count > 0")


def required_field_counts(df: DataFrame) -> DataFrame:
    return missing_counts(df, REQUIRED)


def recommended_field_counts(df: DataFrame) -> DataFrame:
    return missing_counts(df, RECOMMENDED)


def with_duplicate_flag(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Add ``is_repeat``: a trimmed id seen before, in ordinal order.

    The first ordinal of each id comes from a partial aggregate joined back,
    so an id that fills a third of the table stays spread over all tasks.
    """
    keyed = df.withColumn("_id_key", strip(F.col("landslide_id")))
    first = add_totals(keyed, ["_id_key"], [F.min(ordinal).alias("_first")])
    return first.withColumn("is_repeat", F.coalesce(F.col(ordinal) > F.col("_first"), F.lit(False))).drop("_first", "_id_key")


def duplicate_id_records(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Second and later records of an id."""
    return with_duplicate_flag(df, ordinal).filter("is_repeat").select(ordinal, strip(F.col("landslide_id")).alias("landslide_id"))


def coordinate_flags(df: DataFrame, field: str) -> dict[str, Column]:
    """invalid: not a number or out of range; absent: no value at all."""
    low, high = COORDINATE_RANGES[field]
    c = F.col(field)
    number = to_number(c)
    return {
        "not_number": c.isNotNull() & number.isNull(),
        "out_of_range": outside(number, low, high),
        "absent": c.isNull(),
    }


def coordinate_check(df: DataFrame, field: str, ordinal: str = "ordinal") -> DataFrame:
    """Records whose latitude or longitude is missing or invalid, with outcome."""
    flags = coordinate_flags(df, field)
    outcome = (
        F.when(flags["absent"], "missing")
        .when(flags["not_number"], "not_numeric")
        .when(flags["out_of_range"], "out_of_range")
    )
    severity = F.when(F.col("outcome") == "missing", "WARNING").otherwise("ERROR")
    found = df.select(ordinal, F.col(field).alias("value"), outcome.alias("outcome"))
    return found.filter("outcome IS NOT NULL").select(ordinal, "value", "outcome", severity.alias("severity"))


def date_invalid(c: Column) -> Column:
    """Missing dates count as invalid too."""
    return c.isNull() | to_iso_date(c).isNull()


def date_check(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Records whose date is not strictly year-month-day."""
    d = F.col("date")
    bad = df.filter(date_invalid(d))
    return bad.select(ordinal, d.alias("value"), F.when(d.isNull(), "missing").otherwise("bad_format").alias("outcome"))


def with_outcomes(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Add ``has_error``, ``has_warning``, ``is_repeat`` and count columns."""
    out = with_duplicate_flag(df, ordinal)
    lat, lon = coordinate_flags(df, "latitude"), coordinate_flags(df, "longitude")
    invalid = sum((f["not_number"] | f["out_of_range"]).cast("int") for f in (lat, lon))
    absent = sum(f["absent"].cast("int") for f in (lat, lon))
    missing_required = _any([_absent_or_missing(df, f) for f in REQUIRED])
    missing_recommended = _any([_absent_or_missing(df, f) for f in RECOMMENDED])
    return out.select(
        "*",
        invalid.alias("invalid_coordinates"),
        absent.alias("missing_coordinates"),
        date_invalid(F.col("date")).alias("invalid_date"),
        (missing_required | F.col("is_repeat") | (invalid > 0) | date_invalid(F.col("date"))).alias("has_error"),
        (missing_recommended | (absent > 0)).alias("has_warning"),
    )


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def record_outcomes(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row of counters; a record can carry both an error and a warning."""
    marked = with_outcomes(df, ordinal)
    repeated = F.when(F.col("is_repeat"), strip(F.col("landslide_id")))
    return marked.agg(
        F.count(F.lit(1)).alias("total_records"),
        count_true(~F.col("has_error") & ~F.col("has_warning")).alias("valid_records"),
        count_true(F.col("has_error")).alias("records_with_errors"),
        count_true(F.col("has_warning")).alias("records_with_warnings"),
        F.count_distinct(repeated).alias("duplicate_ids"),
        F.coalesce(F.sum("missing_coordinates"), F.lit(0)).alias("missing_coordinates"),
        F.coalesce(F.sum("invalid_coordinates"), F.lit(0)).alias("invalid_coordinates"),
        count_true(F.col("invalid_date")).alias("invalid_dates"),
    )


def findings(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per finding: (ordinal, rule_no, severity, message)."""
    src = with_duplicate_flag(df, ordinal)
    prefix = F.concat(F.lit("Record "), F.col(ordinal).cast("string"), F.lit(": "))
    rules: list[tuple[str, Column, Column]] = []

    def rule(severity: str, cond: Column, *parts) -> None:
        text = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        rules.append((severity, cond, F.concat(prefix, *text)))

    for field in REQUIRED:
        rule("ERROR", _absent_or_missing(df, field), f"Missing required field '{field}'")
    rule("ERROR", F.col("is_repeat"), "Duplicate landslide ID '", strip(F.col("landslide_id")), "'")
    for field, (low, high) in COORDINATE_RANGES.items():
        flags = coordinate_flags(df, field)
        rule("ERROR", flags["not_number"], f"Invalid {field} value '", F.col(field), "'")
        rule("ERROR", flags["out_of_range"], f"Invalid {field} ", strip(F.col(field)), f" (must be between {low} and {high})")
        rule("WARNING", flags["absent"], f"Missing {field}")
    d = F.col("date")
    rule("ERROR", d.isNotNull() & date_invalid(d), "Invalid date format '", strip(d), "' (expected YYYY-MM-DD)")
    rule("ERROR", d.isNull(), "Missing date")
    for field in RECOMMENDED:
        rule("WARNING", _absent_or_missing(df, field), f"Missing recommended field '{field}'")

    hits = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(i).alias("rule_no"), F.lit(sev).alias("severity"), msg.alias("message")))
                for i, (sev, cond, msg) in enumerate(rules, start=1)
            ]
        )
    )
    return src.select(ordinal, F.explode(hits).alias("f")).select(ordinal, "f.rule_no", "f.severity", "f.message")


def findings_preview(df: DataFrame, ordinal: str = "ordinal", shown: int = PREVIEW_ROWS) -> DataFrame:
    """The first findings of each severity and how many more there are.

    ``row_number() <= n`` keeps n rows per map task before the shuffle.
    """
    found = findings(df, ordinal)
    w = Window.partitionBy("severity").orderBy(ordinal, "rule_no")
    first = found.withColumn("line", F.row_number().over(w)).filter(F.col("line") <= shown)
    totals = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shown)
    more = totals.select(
        "severity",
        F.lit(shown + 1).alias("line"),
        F.concat(F.lit("... and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("message"),
    )
    return first.select("severity", "line", "message").unionByName(more)


def counters_report(counters: DataFrame, section: str) -> DataFrame:
    """A one-row counter table as (section, metric, value) rows."""
    casted = counters.select([F.col(c).cast("bigint").alias(c) for c in counters.columns])
    long = casted.unpivot([], casted.columns, "metric", "value")
    return long.select(F.lit(section).alias("section"), "metric", "value")
