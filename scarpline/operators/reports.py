"""Report, alert, zone, work-item and fact queries over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.functions.levels import probability_level
from scarpline.functions.rounding import round_exact
from scarpline.functions.text import is_missing
from scarpline.operators.skew import attach_totals, positions
from scarpline.sources import shared

# Fixed values.
STATUSES = ("PENDING", "UNDER_REVIEW", "VERIFIED", "REJECTED", "RESOLVED")
MAX_PAGE = 100
DEFAULT_PAGE = 50
ANONYMOUS = "citizen-anon"
DEFAULT_SEVERITY = "MEDIUM"
VALUE_CHARS = 380
BUCKET_SPAN = 100_000  # values of the update number in a bucket of within_budget
BUDGET_CHARS = 2200
ELLIPSIS = "…"
PRIORITY_ORDER = {"high": 1, "medium": 2, "low": 3}


# --- reports -------------------------------------------------------------------


def listing(reports: DataFrame, status: str | None = None, hazard_type: str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Newest first, one page. Paging is the feature; the id breaks ties."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset at least 0")
    out = reports
    if status:
        out = out.filter(F.col("status") == status.upper())
    if hazard_type:
        out = out.filter(F.contains(F.lower("hazard_type"), F.lit(hazard_type.lower())))
    return out.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def by_key(reports: DataFrame, key: str) -> DataFrame:
    """Report id equal to the key, or numeric id when the key is all digits."""
    match = F.col("report_id") == key
    return reports.filter(match | (F.col("id") == int(key)) if key.isdigit() else match)


def by_keys(reports: DataFrame, keys: DataFrame) -> DataFrame:
    """The same lookup for a table of keys: two equi-joins instead of an OR."""
    text = reports.join(keys, reports["report_id"] == keys["key"]).select("key", *reports.columns)
    digits = keys.filter(F.col("key").rlike(r"^\d+$")).select("key", F.col("key").try_cast("bigint").alias("_id"))
    number = reports.join(digits, reports["id"] == digits["_id"]).select("key", *reports.columns)
    return text.unionByName(number).distinct()


def assign_ids(submissions: DataFrame, existing: int, year: int, order: list[Column] | None = None) -> DataFrame:
    """Sequential ids after the existing reports, without a single-task window."""
    numbered = positions(submissions, order or [F.col("created_at"), F.col("ordinal")])
    text = F.format_string(f"LSR-{year}-%04d", F.col("position") + existing)
    return numbered.withColumn("report_id", text).drop("position")


def submission_errors() -> Column:
    """First violated limit of a submission; NULL when it is acceptable."""
    d = F.length("description")
    return (
        F.when(~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False)), "latitude")
        .when(~F.coalesce(F.col("longitude").between(-180, 180), F.lit(False)), "longitude")
        .when(~F.coalesce(d.between(5, 2000), F.lit(False)), "description")
        .when(F.length("location_name") > 255, "location_name")
        .when(F.col("hazard_type").isNull(), "hazard_type")
    )


def with_defaults(submissions: DataFrame) -> DataFrame:
    """Ingest defaults of accepted submissions; rejected ones keep the reason."""
    at = lambda c: F.format_string("%.4f", round_exact(F.col(c), 4))
    place = F.concat(F.lit("Coordinates ("), at("latitude"), F.lit(", "), at("longitude"), F.lit(")"))
    named = F.when(F.col("location_name") != "", F.col("location_name"))
    return submissions.withColumns(
        {
            "rejected_for": submission_errors(),
            "user_id": F.lit(ANONYMOUS),
            "location_name": F.coalesce(named, place),
            "severity": F.coalesce("severity", F.lit(DEFAULT_SEVERITY)),
            "status": F.lit(STATUSES[0]),
            "updated_at": F.col("created_at"),
        }
    )


def valid_status() -> Column:
    return F.upper("status").isin(*STATUSES)


def apply_status_updates(reports: DataFrame, updates: DataFrame) -> DataFrame:
    """Reports with their latest valid update.

    Updates are reduced to one row per report by a partial aggregate first, so
    both sides of the join are unique on the id.
    """
    order = F.struct("updated_at", "update_id")
    latest = updates.filter(valid_status()).groupBy("report_id").agg(
        F.max_by(F.upper("status"), order).alias("_status"), F.max("updated_at").alias("_at")
    )
    joined = reports.join(latest, "report_id", "left")
    changed = joined.withColumns(
        {"status": F.coalesce("_status", "status"), "updated_at": F.coalesce(F.col("_at"), F.col("created_at"))}
    )
    return changed.select(*reports.columns, "updated_at")


def rejected_updates(updates: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Invalid status '"), F.coalesce("status", F.lit("")), F.lit("'. Allowed: " + ", ".join(STATUSES)))
    return updates.filter(~F.coalesce(valid_status(), F.lit(False))).select("update_id", "report_id", message.alias("reason"))


def with_image_url(df: DataFrame, base: str) -> DataFrame:
    path = F.when(F.col("image_path") != "", F.col("image_path"))
    return df.withColumn("image_url", F.concat(F.lit(base.rstrip("/") + "/"), path))


def text_search(reports: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in id, type, place or description."""
    needle = text.strip().lower()
    if not needle:
        return reports
    hit = F.lit(False)
    for c in ("report_id", "hazard_type", "location_name", "description"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return reports.filter(hit)


# --- alerts and zones ------------------------------------------------------------


def active_alerts(alerts: DataFrame, severity: str | None = None, active_only: bool = True) -> DataFrame:
    out = alerts.filter("is_active") if active_only else alerts
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    return out.orderBy(F.desc("issued_at"), F.desc("id"))


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def critical_alerts(alerts: DataFrame, shown: int | None = 2) -> DataFrame:
    """CRITICAL or HIGH active alerts, newest first; a page shows the first two."""
    out = active_alerts(alerts).filter(F.col("severity").isin("CRITICAL", "HIGH"))
    return out.limit(shown) if shown is not None else out


def zones(risk_zones: DataFrame, level: str | None = None) -> DataFrame:
    out = risk_zones.withColumn("risk_level", probability_level(F.col("risk_probability")))
    return out.filter(F.col("risk_level") == level) if level and level != "ALL" else out


# --- work items --------------------------------------------------------------------


def priority_rank() -> Column:
    out = None
    for name, rank in PRIORITY_ORDER.items():
        cond = F.col("priority") == name
        out = F.when(cond, rank) if out is None else out.when(cond, rank)
    return out.otherwise(4)


def work_list(tasks: DataFrame) -> DataFrame:
    """high, medium, low, other; then due date with missing dates first."""
    ranked = tasks.withColumn("priority_rank", priority_rank())
    return ranked.orderBy("priority_rank", F.asc_nulls_first("due_date"), "id")


def assignments_by_due_date(assignments: DataFrame) -> DataFrame:
    return assignments.orderBy(F.asc_nulls_first("due_date"), "id")


def due_plan(tasks: DataFrame, assignments: DataFrame, date: str) -> DataFrame:
    """Open tasks and assignments without a date or due by the date."""

    def due(df: DataFrame, kind: str) -> DataFrame:
        open_items = df.filter((F.col("status") != "completed") & (F.col("due_date").isNull() | (F.col("due_date") <= date)))
        return open_items.select(F.lit(kind).alias("kind"), "id", "title", "due_date", "status")

    return due(tasks, "task").unionByName(due(assignments, "assignment"))


def apply_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update, completion and deletion in one join.

    A NULL argument keeps the column. ``changes`` has one row per task.
    """
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in ("title", "priority", "due_date", "complete", "deleted")])
    joined = tasks.join(c, "id", "left").filter(~F.coalesce("_deleted", F.lit(False)))
    done = F.when(F.col("_complete"), "completed").otherwise(F.col("status"))
    merged = {x: F.coalesce(f"_{x}", x) for x in ("title", "priority", "due_date")}
    return joined.withColumns({**merged, "status": done}).select(*tasks.columns)


# --- facts ---------------------------------------------------------------------------


def shorten(c: Column, limit: int = VALUE_CHARS) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit(ELLIPSIS))).otherwise(c)


def latest_facts(updates: DataFrame, order: str = "update_id") -> DataFrame:
    """Newest value per (owner, category, key) and when it last changed.

    Blank updates are skipped and an update that repeats the stored value does
    not count as a change. The last use of every value is a partial aggregate;
    what is newest, and what was newest before it, follows from those few rows.
    """
    keys = ["owner", "category", "fact_key"]
    kept = updates.filter(~is_missing(F.col("value"))).withColumn("value", shorten(F.col("value")))
    last = kept.groupBy(*keys, "value").agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    last = shared.store(last, "last-values")
    now = last.groupBy(*keys).agg(F.max("_last").alias("_newest"), F.max_by("value", "_last").alias("_now"), F.sum("_rows").alias("_n"))
    now = now.select(*[F.col(k).alias(f"_{k}") for k in keys], "_newest", "_now", "_n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    other = F.max(F.when(F.col("_last") < F.col("_newest"), F.col("_last"))).alias("_other")
    facts = last.join(now, same).groupBy(*keys).agg(F.any_value("_now").alias("_now"), F.any_value("_n").alias("_n"), other)
    told = attach_totals(kept.select(*keys, order), keys, facts, null_keys=True)
    run = F.when(F.col("_other").isNull() | (F.col(order) > F.col("_other")), F.col(order))
    return told.groupBy(*keys).agg(F.any_value("_now").alias("value"), F.min(run).alias("updated"))


def within_budget(facts: DataFrame, budget: int = BUDGET_CHARS, span: int = BUCKET_SPAN) -> DataFrame:
    """Newest facts of each owner whose running size fits the budget.

    Facts are cut into buckets of ``span`` values of ``updated``. Bucket sums
    are a partial aggregate; their running sums tell which buckets begin
    within the budget, and only rows of those are ordered, each bucket alone.
    A NULL category, key or value has no length.
    """
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    rows = facts.withColumn("_size", length("category") + length("fact_key") + length("value"))
    rows = rows.withColumn("_bucket", F.coalesce(F.floor(F.col("updated") / span), F.lit(-1)))
    newer = Window.partitionBy("owner").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("owner", "_bucket").agg(F.sum("_size").alias("_sum"))
    begins = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(newer), F.lit(0))).filter(F.col("_before") <= budget)
    begins = begins.select(F.col("owner").alias("_owner"), F.col("_bucket").alias("_b"), "_before")
    met = rows.join(begins, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("owner", "_bucket").orderBy(F.desc("updated"), "category", "fact_key")
    running = F.col("_before") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    kept = met.withColumn("running_chars", running).filter(F.col("running_chars") <= budget)
    return kept.select(*facts.columns, "running_chars")
