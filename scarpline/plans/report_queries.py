"""Reports, alerts, zones, work items and facts."""

from pyspark.sql import functions as F

from scarpline.operators import reports
from scarpline.plans.registry import check_view, query
from scarpline.plans.risk_queries import TIERS

_STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {a}"


def stamp(c: str, alias: str | None = None) -> str:
    return _STAMP.format(c=c, a=alias or c)


def stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


_LIST = f"id, report_id, hazard_type, status, {stamp('created_at')}"


@query(
    "report_page", "B1", "reports",
    f"SELECT {_LIST} FROM (SELECT * FROM reports WHERE status = 'VERIFIED' AND hazard_type ILIKE '%rock%' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5) r",
)
def _(v):
    out = reports.listing(v("reports"), status="verified", hazard_type="ROCK", limit=20, offset=5)
    return stamped(out.select("id", "report_id", "hazard_type", "status", "created_at"), "created_at")


@query(
    "reports_by_key", "B2", "reports",
    """+k AS (SELECT report_id AS key FROM reports WHERE id % 50 = 0 UNION SELECT CAST(id AS VARCHAR) FROM reports WHERE id % 50 = 1 UNION SELECT 'none')
SELECT k.key, r.id, r.report_id FROM k JOIN reports r ON r.report_id = k.key OR r.id = TRY_CAST(k.key AS BIGINT)""",
)
def _(v):
    r = v("reports")
    keys = r.filter("id % 50 = 0").select(F.col("report_id").alias("key"))
    keys = keys.union(r.filter("id % 50 = 1").select(F.col("id").cast("string"))).union(v.spark.sql("SELECT 'none' AS key"))
    return reports.by_keys(r, keys).select("key", "id", "report_id")


@query(
    "assigned_report_ids", "B3", "submissions",
    "SELECT ordinal, printf('LSR-2026-%04d', row_number() OVER (ORDER BY created_at, ordinal) + 3) AS report_id FROM submissions",
)
def _(v):
    rows = v("submissions").select("ordinal", "created_at")
    return reports.assign_ids(rows, existing=3, year=2026).select("ordinal", "report_id")


@query(
    "ingest_defaults", "B4", "submissions",
    f"""SELECT ordinal, CASE WHEN NOT latitude BETWEEN -90 AND 90 THEN 'latitude' WHEN NOT longitude BETWEEN -180 AND 180 THEN 'longitude' WHEN length(description) NOT BETWEEN 5 AND 2000 THEN 'description' END AS rejected_for,
  'citizen-anon' AS user_id, coalesce(nullif(location_name, ''), printf('Coordinates (%.4f, %.4f)', latitude, longitude)) AS location_name, coalesce(severity, 'MEDIUM') AS severity,
  'PENDING' AS status, {stamp('created_at', 'updated_at')} FROM submissions""",
)
def _(v):
    out = stamped(reports.with_defaults(v("submissions")), "updated_at")
    return out.select("ordinal", "rejected_for", "user_id", "location_name", "severity", "status", "updated_at")


_ALLOWED = ", ".join(f"'{s}'" for s in reports.STATUSES)


@query(
    "status_after_updates", "B5", "reports status_updates",
    f"""+u AS (SELECT report_id, arg_max(upper(status), update_id) AS s, max(updated_at) AS at FROM status_updates WHERE upper(status) IN ({_ALLOWED}) GROUP BY report_id)
SELECT r.report_id, coalesce(u.s, r.status) AS status, {stamp('coalesce(u.at, r.created_at)', 'updated_at')} FROM reports r LEFT JOIN u ON r.report_id = u.report_id""",
)
def _(v):
    out = reports.apply_status_updates(v("reports"), v("status_updates"))
    return stamped(out.select("report_id", "status", "updated_at"), "updated_at")


@query(
    "rejected_status_updates", "B5", "status_updates",
    f"SELECT update_id, report_id, 'Invalid status ''' || status || '''. Allowed: {', '.join(reports.STATUSES)}' AS reason FROM status_updates WHERE upper(status) NOT IN ({_ALLOWED})",
)
def _(v):
    return reports.rejected_updates(v("status_updates"))


@query("image_urls", "B6", "submissions", "SELECT ordinal, 'http://host/' || image_path AS image_url FROM submissions")
def _(v):
    return reports.with_image_url(v("submissions"), "http://host/").select("ordinal", "image_url")


@query(
    "report_search", "B7", "reports",
    "SELECT id FROM reports WHERE contains(lower(report_id), 'site 1') OR contains(lower(hazard_type), 'site 1') OR contains(lower(location_name), 'site 1') OR contains(lower(description), 'site 1')",
)
def _(v):
    return reports.text_search(v("reports"), " Site 1").select("id")


@query("active_alerts", "B8", "alerts", f"SELECT id, alert_id, severity, {stamp('issued_at')} FROM alerts WHERE is_active AND severity = 'HIGH'")
def _(v):
    return stamped(reports.active_alerts(v("alerts"), "high").select("id", "alert_id", "severity", "issued_at"), "issued_at")


@query("alert_by_id", "B9", "alerts", "SELECT id, alert_id, severity FROM alerts WHERE alert_id = 'ALT-4'")
def _(v):
    return reports.alert_by_id(v("alerts"), "ALT-4").select("id", "alert_id", "severity")


@query(
    "critical_alerts", "B10", "alerts",
    f"SELECT alert_id, severity, {stamp('issued_at')} FROM (SELECT * FROM alerts WHERE is_active AND severity IN ('CRITICAL', 'HIGH') ORDER BY issued_at DESC, id DESC LIMIT 2) a",
)
def _(v):
    return stamped(reports.critical_alerts(v("alerts")).select("alert_id", "severity", "issued_at"), "issued_at")


@query("zones_by_level", "B11", "risk_zones", f"SELECT zone_id, risk_level FROM (SELECT zone_id, {TIERS.format(c='risk_probability')} AS risk_level FROM risk_zones) z WHERE risk_level = 'HIGH'")
def _(v):
    return reports.zones(v("risk_zones"), "HIGH").select("zone_id", "risk_level")


@query(
    "work_list", "B12", "work_tasks",
    "SELECT id, title, priority, due_date, status, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS priority_rank FROM work_tasks",
)
def _(v):
    return reports.work_list(v("work_tasks"))


@query("assignments_by_due_date", "B13", "work_assignments", "SELECT id, title, subject, due_date, status FROM work_assignments ORDER BY due_date NULLS FIRST, id")
def _(v):
    return reports.assignments_by_due_date(v("work_assignments"))


@query(
    "due_plan", "B14", "work_tasks work_assignments",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, id, title, due_date, status FROM {src} WHERE status <> 'completed' AND (due_date IS NULL OR due_date <= '2024-06-15')"
        for kind, src in (("task", "work_tasks"), ("assignment", "work_assignments"))
    ),
)
def _(v):
    return reports.due_plan(v("work_tasks"), v("work_assignments"), "2024-06-15")


@query(
    "work_changes", "B15", "work_tasks work_changes",
    """SELECT t.id, coalesce(c.title, t.title) AS title, coalesce(c.priority, t.priority) AS priority, coalesce(c.due_date, t.due_date) AS due_date,
  CASE WHEN c.complete THEN 'completed' ELSE t.status END AS status FROM work_tasks t LEFT JOIN work_changes c ON t.id = c.id WHERE NOT coalesce(c.deleted, false)""",
)
def _(v):
    return reports.apply_changes(v("work_tasks"), v("work_changes"))


_SHORT = "CASE WHEN length(value) > 380 THEN rtrim(substr(value, 1, 380)) || '…' ELSE value END"
check_view(
    "changes", "facts",
    f"""SELECT *, lag(value) OVER (PARTITION BY owner, category, fact_key ORDER BY update_id) IS DISTINCT FROM value AS changed
FROM (SELECT update_id, owner, category, fact_key, {_SHORT} AS value FROM facts WHERE value IS NOT NULL AND regexp_replace(value, '^\\s+|\\s+$', '', 'g') <> '') f""",
)
check_view(
    "fact_state", "changes",
    "SELECT owner, category, fact_key, arg_max(value, update_id) AS value, max(update_id) FILTER (WHERE changed) AS updated FROM changes GROUP BY 1, 2, 3",
)


@query("latest_facts", "B16", "fact_state", "SELECT owner, category, fact_key, md5(value) AS value, updated FROM fact_state")
def _(v):
    return reports.latest_facts(v("facts")).withColumn("value", F.md5("value"))


@query(
    "facts_within_budget", "B16", "fact_state",
    """SELECT owner, category, fact_key, updated, running_chars FROM (SELECT *, CAST(sum(length(category) + length(fact_key) + length(value)) OVER (PARTITION BY owner ORDER BY updated DESC, category, fact_key) AS BIGINT) AS running_chars FROM fact_state) t
WHERE running_chars <= 2200""",
)
def _(v):
    return reports.within_budget(reports.latest_facts(v("facts"))).select("owner", "category", "fact_key", "updated", "running_chars")
