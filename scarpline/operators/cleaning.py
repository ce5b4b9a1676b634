"""Standardising incident records and deciding which ones need review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scarpline.functions.text import count_true, is_missing, outside, squash, strip, to_any_date, to_number
from scarpline.operators.skew import add_totals
from scarpline.operators.validation import COORDINATE_RANGES, INCIDENT_COLUMNS
from scarpline.sources import shared

# Free-text fields that are normalised.
TEXT_FIELDS = ("location", "district", "state", "country", "source", "source_url", "severity", "description")


def normalise_text(df: DataFrame, fields=TEXT_FIELDS) -> DataFrame:
    """Collapse whitespace; blanks stay as they are. Adds ``text_changes``."""
    present = [f for f in fields if f in df.columns]
    staged = df.withColumns({f"_new_{f}": F.when(is_missing(F.col(f)), F.col(f)).otherwise(squash(F.col(f))) for f in present})
    changed = reduce(lambda a, b: a + b, [_changed(f, F.col(f"_new_{f}")) for f in present], F.lit(0))
    counted = staged.withColumn("text_changes", changed)
    return counted.select([F.col(f"_new_{c}").alias(c) if c in present else F.col(c) for c in [*df.columns, "text_changes"]])


def _changed(field: str, new):
    old = F.col(field)
    return F.coalesce(((old != new) & (old != "")).cast("int"), F.lit(0))


def trim_ids(df: DataFrame) -> DataFrame:
    """Strip the id. Adds ``id_changed``."""
    new = F.when(is_missing(F.col("landslide_id")), F.col("landslide_id")).otherwise(strip(F.col("landslide_id")))
    return df.select("*", _changed("landslide_id", new).alias("id_changed")).withColumn("landslide_id", new)


def standardise_dates(df: DataFrame) -> DataFrame:
    """ISO text for the first layout that fits. Adds ``date_parsed``, ``date_unreadable``."""
    parsed = F.col("_parsed")
    staged = df.withColumn("_parsed", to_any_date(F.col("date")))
    flagged = staged.withColumns(
        {"date_parsed": parsed.isNotNull(), "date_unreadable": ~is_missing(F.col("date")) & parsed.isNull()}
    )
    return flagged.withColumn("date", F.coalesce(parsed.cast("string"), F.col("date"))).drop("_parsed")


def clean_coordinate(df: DataFrame, field: str) -> DataFrame:
    """Double or NULL. Adds ``<field>_missing``, ``_invalid``, ``_converted``.

    Converted means that the text was not the plain decimal form of its value
    (sign, exponent, leading or trailing zeros).
    """
    low, high = COORDINATE_RANGES[field]
    c, number, missing, invalid = (F.col(x) for x in (field, "_number", f"{field}_missing", f"{field}_invalid"))
    staged = df.withColumns({"_number": to_number(c), f"{field}_missing": is_missing(c)})
    staged = staged.withColumn(f"{field}_invalid", ~missing & (number.isNull() | outside(number, low, high)))
    plain = strip(c).rlike(r"^-?(0|[1-9]\d*)\.(0|\d*[1-9])$")
    staged = staged.withColumn(f"{field}_converted", ~missing & ~invalid & ~plain)
    return staged.withColumn(field, F.when(~invalid, number)).drop("_number")


def clean_columns(df: DataFrame) -> DataFrame:
    """All row-wise steps, no shuffle."""
    out = standardise_dates(trim_ids(normalise_text(df)))
    return clean_coordinate(clean_coordinate(out, "latitude"), "longitude")


def exact_duplicate_count(df: DataFrame, columns=INCIDENT_COLUMNS) -> DataFrame:
    """Second and later copies of a row; partial aggregation absorbs hot copies."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_rows"))


def flag_duplicate_ids(df: DataFrame, base: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Add ``duplicate_id``: every member of a repeated non-blank id."""
    filled = F.count_if(~is_missing(F.col("landslide_id"))).alias("_members")
    counted = add_totals(df, ["landslide_id"], [filled], base, worth=F.col("_members") > 1)
    return counted.withColumn("duplicate_id", F.coalesce(F.col("_members") > 1, F.lit(False))).drop("_members")


def flag_same_place_and_date(df: DataFrame, base: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Add ``spatial_duplicate``: all members of a shared (date, lat, lon)."""
    keys = ["date", "latitude", "longitude"]
    counted = add_totals(df, keys, [F.count(F.lit(1)).alias("_same")], base, worth=F.col("_same") > 1)
    return counted.withColumn("spatial_duplicate", F.coalesce(F.col("_same") > 1, F.lit(False))).drop("_same")


def clean(df: DataFrame) -> DataFrame:
    """Cleaned records with ``data_quality_status`` and the evidence flags.

    The row-wise steps run once and are stored; keys are counted on, and flags
    joined to, the stored columns.
    """
    return flag_records(shared.store(clean_columns(df), "cleaned"))


def flag_records(tidy: DataFrame) -> DataFrame:
    """Evidence flags and status of cleaned columns."""
    out = flag_same_place_and_date(flag_duplicate_ids(tidy), base=tidy)
    review = reduce(
        lambda a, b: a | b,
        [
            F.col(f)
            for f in (
                "date_unreadable", "latitude_missing", "latitude_invalid",
                "longitude_missing", "longitude_invalid", "duplicate_id", "spatial_duplicate",
            )
        ],
    )
    return out.withColumn("data_quality_status", F.when(review, "REVIEW_REQUIRED").otherwise("CLEAN"))


def clean_table(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The cleaned table without evidence flags."""
    return clean(df).select(ordinal, *INCIDENT_COLUMNS, "data_quality_status")


def cleaning_counters(df: DataFrame) -> DataFrame:
    """The eleven counters of a cleaning run, one row."""
    tidy = shared.store(clean_columns(df), "cleaned")
    cleaned = flag_records(tidy)
    n = lambda flag: count_true(F.col(flag))
    counters = cleaned.agg(
        F.count(F.lit(1)).alias("total_records"),
        count_true(F.col("data_quality_status") == "CLEAN").alias("records_cleaned"),
        count_true(F.col("data_quality_status") == "REVIEW_REQUIRED").alias("records_require_review"),
        n("duplicate_id").alias("duplicate_landslide_ids"),
        n("spatial_duplicate").alias("possible_spatial_duplicates"),
        (n("latitude_missing") + n("longitude_missing")).alias("missing_required_values"),
        (n("latitude_invalid") + n("longitude_invalid")).alias("invalid_coordinates"),
        n("date_unreadable").alias("invalid_dates"),
        n("date_parsed").alias("dates_standardized"),
        (n("latitude_converted") + n("longitude_converted")).alias("coordinates_converted"),
        F.coalesce(F.sum(F.col("text_changes") + F.col("id_changed")), F.lit(0)).alias("text_fields_normalized"),
    )
    copies = exact_duplicate_count(tidy)
    return counters.join(F.broadcast(copies), how="inner")
