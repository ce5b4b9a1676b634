"""Record validation and cleaning."""

from pyspark.sql import functions as F

from scarpline.operators import cleaning, validation
from scarpline.plans.registry import check_view, query
from scarpline.sources import shared

_MISSING = "({c} IS NULL OR regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '')"


def miss(c: str) -> str:
    return _MISSING.format(c=c)


def n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


LAT, LON = "TRY_CAST(latitude AS DOUBLE)", "TRY_CAST(longitude AS DOUBLE)"
STRICT_DATE = "try_strptime(trim(date), '%Y-%m-%d')"
ANY_DATE = (
    "coalesce(try_strptime(trim(date), '%Y-%m-%d'), try_strptime(trim(date), '%Y/%m/%d'), try_strptime(trim(date), '%d-%m-%Y'), "
    "try_strptime(trim(date), '%m/%d/%Y'), try_strptime(trim(date), '%d/%m/%Y'))"
)


def _unpivot_missing(fields) -> str:
    parts = [f"SELECT '{f}' AS field, {n(miss(f))} AS missing_count FROM incidents" for f in fields]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE missing_count > 0"


check_view(
    "marked", "incidents",
    f"""
SELECT *, row_number() OVER (PARTITION BY trim(landslide_id) ORDER BY ordinal) > 1 AND landslide_id IS NOT NULL AS is_repeat,
  CASE WHEN latitude IS NOT NULL AND ({LAT} IS NULL OR {LAT} < -90 OR {LAT} > 90) THEN 1 ELSE 0 END
  + CASE WHEN longitude IS NOT NULL AND ({LON} IS NULL OR {LON} < -180 OR {LON} > 180) THEN 1 ELSE 0 END AS bad_coords,
  CASE WHEN latitude IS NULL THEN 1 ELSE 0 END + CASE WHEN longitude IS NULL THEN 1 ELSE 0 END AS no_coords,
  date IS NULL OR {STRICT_DATE} IS NULL AS bad_date,
  {' OR '.join(miss(f) for f in validation.REQUIRED)} AS req_missing,
  {' OR '.join(miss(f) for f in validation.RECOMMENDED)} AS rec_missing
FROM incidents
""",
)

_OUTCOMES = """
SELECT count(*) AS total_records,
  count(*) FILTER (WHERE NOT (req_missing OR is_repeat OR bad_coords > 0 OR bad_date) AND NOT (rec_missing OR no_coords > 0)) AS valid_records,
  count(*) FILTER (WHERE req_missing OR is_repeat OR bad_coords > 0 OR bad_date) AS records_with_errors,
  count(*) FILTER (WHERE rec_missing OR no_coords > 0) AS records_with_warnings,
  count(DISTINCT CASE WHEN is_repeat THEN trim(landslide_id) END) AS duplicate_ids,
  CAST(sum(no_coords) AS BIGINT) AS missing_coordinates, CAST(sum(bad_coords) AS BIGINT) AS invalid_coordinates,
  count(*) FILTER (WHERE bad_date) AS invalid_dates
FROM marked
"""


@query("required_field_counts", "V1", "incidents", _unpivot_missing(validation.REQUIRED))
def _(v):
    return validation.required_field_counts(v("incidents"))


@query(
    "duplicate_id_records", "V2", "marked",
    "SELECT ordinal, trim(landslide_id) AS landslide_id FROM marked WHERE is_repeat",
)
def _(v):
    return validation.duplicate_id_records(v("incidents"))


def _coord_sql(field: str, low: int, high: int) -> str:
    num = f"TRY_CAST({field} AS DOUBLE)"
    return f"""
SELECT ordinal, {field} AS value, outcome, CASE WHEN outcome = 'missing' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM (
  SELECT ordinal, {field}, CASE WHEN {field} IS NULL THEN 'missing' WHEN {num} IS NULL THEN 'not_numeric'
    WHEN {num} < {low} OR {num} > {high} THEN 'out_of_range' END AS outcome FROM incidents) t
WHERE outcome IS NOT NULL"""


@query("latitude_check", "V3", "incidents", _coord_sql("latitude", -90, 90))
def _(v):
    return validation.coordinate_check(v("incidents"), "latitude")


@query("longitude_check", "V4", "incidents", _coord_sql("longitude", -180, 180))
def _(v):
    return validation.coordinate_check(v("incidents"), "longitude")


@query(
    "strict_date_check", "V5", "incidents",
    f"""SELECT ordinal, date AS value, CASE WHEN date IS NULL THEN 'missing' ELSE 'bad_format' END AS outcome
FROM incidents WHERE date IS NULL OR {STRICT_DATE} IS NULL""",
)
def _(v):
    return validation.date_check(v("incidents"))


@query("recommended_field_counts", "V6", "incidents", _unpivot_missing(validation.RECOMMENDED))
def _(v):
    return validation.recommended_field_counts(v("incidents"))


@query("record_outcomes", "V7", "marked", _OUTCOMES)
def _(v):
    return validation.record_outcomes(v("incidents"))


def _finding_rules() -> str:
    rules = [("ERROR", miss(f), f"'Missing required field ''{f}'''") for f in validation.REQUIRED]
    rules.append(("ERROR", "is_repeat", "'Duplicate landslide ID ''' || trim(landslide_id) || ''''"))
    for f, (lo, hi) in validation.COORDINATE_RANGES.items():
        num = f"TRY_CAST({f} AS DOUBLE)"
        rules.append(("ERROR", f"{f} IS NOT NULL AND {num} IS NULL", f"'Invalid {f} value ''' || {f} || ''''"))
        rules.append(("ERROR", f"{num} < {lo} OR {num} > {hi}", f"'Invalid {f} ' || trim({f}) || ' (must be between {lo} and {hi})'"))
        rules.append(("WARNING", f"{f} IS NULL", f"'Missing {f}'"))
    rules.append(("ERROR", f"date IS NOT NULL AND {STRICT_DATE} IS NULL", "'Invalid date format ''' || trim(date) || ''' (expected YYYY-MM-DD)'"))
    rules.append(("ERROR", "date IS NULL", "'Missing date'"))
    rules += [("WARNING", miss(f), f"'Missing recommended field ''{f}'''") for f in validation.RECOMMENDED]
    parts = [
        f"SELECT ordinal, {i} AS rule_no, '{sev}' AS severity, 'Record ' || ordinal || ': ' || {msg} AS message FROM marked WHERE {cond}"
        for i, (sev, cond, msg) in enumerate(rules, start=1)
    ]
    return "\nUNION ALL ".join(parts)


check_view("findings", "marked", _finding_rules())


@query("validation_findings", "V8", "findings", "SELECT * FROM findings")
def _(v):
    return validation.findings(v("incidents"))


@query(
    "validation_findings_preview", "V8", "findings",
    """SELECT severity, line, message FROM (SELECT severity, message, row_number() OVER (PARTITION BY severity ORDER BY ordinal, rule_no) AS line FROM findings) t WHERE line <= 10
UNION ALL SELECT severity, 11, '... and ' || (n - 10) || ' more' FROM (SELECT severity, count(*) AS n FROM findings GROUP BY severity) c WHERE n > 10""",
)
def _(v):
    return validation.findings_preview(v("incidents"))


# --- cleaning ---------------------------------------------------------------

_TEXT = cleaning.TEXT_FIELDS


def _squashed(f: str) -> str:
    return f"CASE WHEN {miss(f)} THEN {f} ELSE trim(regexp_replace({f}, '\\s+', ' ', 'g')) END"


def _changes() -> str:
    return " + ".join(f"CASE WHEN {f} IS NOT NULL AND {f} <> '' AND {f} <> {_squashed(f)} THEN 1 ELSE 0 END" for f in _TEXT)


check_view(
    "tidy", "incidents",
    f"""
SELECT ordinal, trim(landslide_id) AS landslide_id,
  coalesce(strftime({ANY_DATE}, '%Y-%m-%d'), date) AS date,
  CASE WHEN {LAT} BETWEEN -90 AND 90 THEN {LAT} END AS latitude, CASE WHEN {LON} BETWEEN -180 AND 180 THEN {LON} END AS longitude,
  {', '.join(f'{_squashed(f)} AS {f}' for f in _TEXT)},
  {_changes()} AS text_changes,
  CASE WHEN landslide_id <> trim(landslide_id) THEN 1 ELSE 0 END AS id_changed,
  {ANY_DATE} IS NOT NULL AS date_parsed, NOT {miss('date')} AND {ANY_DATE} IS NULL AS date_unreadable,
  {miss('latitude')} AS latitude_missing, {miss('longitude')} AS longitude_missing,
  NOT {miss('latitude')} AND ({LAT} IS NULL OR {LAT} NOT BETWEEN -90 AND 90) AS latitude_invalid,
  NOT {miss('longitude')} AND ({LON} IS NULL OR {LON} NOT BETWEEN -180 AND 180) AS longitude_invalid
FROM incidents
""",
)
check_view(
    "cleaned", "tidy",
    """
SELECT *, CASE WHEN date_unreadable OR latitude_missing OR latitude_invalid OR longitude_missing OR longitude_invalid OR duplicate_id OR spatial_duplicate
  THEN 'REVIEW_REQUIRED' ELSE 'CLEAN' END AS data_quality_status
FROM (SELECT *, landslide_id IS NOT NULL AND landslide_id <> '' AND count(*) OVER (PARTITION BY landslide_id) > 1 AS duplicate_id,
        date IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND count(*) OVER (PARTITION BY date, latitude, longitude) > 1 AS spatial_duplicate
      FROM tidy) t
""",
)


@query(
    "normalised_text", "C1", "tidy",
    f"SELECT ordinal, {', '.join(_TEXT)}, text_changes FROM tidy",
)
def _(v):
    return cleaning.normalise_text(v("incidents")).select("ordinal", *_TEXT, "text_changes")


@query("trimmed_ids", "C2", "tidy", "SELECT ordinal, landslide_id, id_changed FROM tidy")
def _(v):
    return cleaning.trim_ids(v("incidents")).select("ordinal", "landslide_id", "id_changed")


@query("standardised_dates", "C3", "tidy", "SELECT ordinal, date, date_parsed, date_unreadable FROM tidy")
def _(v):
    return cleaning.standardise_dates(v("incidents")).select("ordinal", "date", "date_parsed", "date_unreadable")


for _field, _id in (("latitude", "C4"), ("longitude", "C5")):

    def _run(v, field=_field):
        return cleaning.clean_coordinate(v("incidents"), field).select("ordinal", field, f"{field}_missing", f"{field}_invalid")

    query(f"cleaned_{_field}", _id, "tidy", f"SELECT ordinal, {_field}, {_field}_missing, {_field}_invalid FROM tidy")(_run)


_PLAIN = r"'^-?(0|[1-9]\d*)\.(0|\d*[1-9])$'"


@query(
    "coordinate_conversions", "C6", "incidents",
    f"""SELECT {' , '.join(
        f"count(*) FILTER (WHERE {num} BETWEEN -{hi} AND {hi} AND NOT regexp_matches(trim({f}), {_PLAIN})) AS {f}_converted"
        for f, num, hi in (('latitude', LAT, 90), ('longitude', LON, 180)))} FROM incidents""",
)
def _(v):
    df = v("incidents")
    for field in ("latitude", "longitude"):
        df = cleaning.clean_coordinate(df, field)
    return df.agg(*[F.count_if(F.col(f"{f}_converted")).alias(f"{f}_converted") for f in ("latitude", "longitude")])


_ALL = ", ".join(validation.INCIDENT_COLUMNS)


@query(
    "exact_duplicate_rows", "C7", "tidy",
    f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS exact_duplicate_rows FROM (SELECT count(*) AS n FROM tidy GROUP BY {_ALL}) t",
)
def _(v):
    return cleaning.exact_duplicate_count(cleaning.clean_columns(v("incidents")))


@query("duplicate_ids", "C8", "cleaned", "SELECT ordinal, landslide_id, duplicate_id FROM cleaned")
def _(v):
    return cleaning.flag_duplicate_ids(cleaning.trim_ids(v("incidents"))).select("ordinal", "landslide_id", "duplicate_id")


@query("same_place_and_date", "C9", "cleaned", "SELECT ordinal, date, latitude, longitude, spatial_duplicate FROM cleaned")
def _(v):
    tidy = shared.store(cleaning.clean_columns(v("incidents")).select("ordinal", "date", "latitude", "longitude"), "cleaned")
    return cleaning.flag_same_place_and_date(tidy).select("ordinal", "date", "latitude", "longitude", "spatial_duplicate")


@query("cleaned_incidents", "C10", "cleaned", f"SELECT ordinal, {_ALL}, data_quality_status FROM cleaned")
def _(v):
    return cleaning.clean_table(v("incidents"))


_COUNTERS = f"""
SELECT count(*) AS total_records, {n("data_quality_status = 'CLEAN'")} AS records_cleaned, {n("data_quality_status <> 'CLEAN'")} AS records_require_review,
  {n('duplicate_id')} AS duplicate_landslide_ids, {n('spatial_duplicate')} AS possible_spatial_duplicates,
  {n('latitude_missing')} + {n('longitude_missing')} AS missing_required_values, {n('latitude_invalid')} + {n('longitude_invalid')} AS invalid_coordinates,
  {n('date_unreadable')} AS invalid_dates, {n('date_parsed')} AS dates_standardized,
  (SELECT count(*) FILTER (WHERE {LAT} BETWEEN -90 AND 90 AND NOT regexp_matches(trim(latitude), {_PLAIN}))
        + count(*) FILTER (WHERE {LON} BETWEEN -180 AND 180 AND NOT regexp_matches(trim(longitude), {_PLAIN})) FROM incidents) AS coordinates_converted,
  CAST(sum(text_changes + id_changed) AS BIGINT) AS text_fields_normalized,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM tidy GROUP BY {_ALL}) t) AS exact_duplicate_rows
FROM cleaned
"""


@query("cleaning_counters", "C11", "cleaned", _COUNTERS)
def _(v):
    return cleaning.cleaning_counters(v("incidents"))


_OUTCOME_NAMES = (
    "total_records", "valid_records", "records_with_errors", "records_with_warnings",
    "duplicate_ids", "missing_coordinates", "invalid_coordinates", "invalid_dates",
)


@query(
    "validation_report", "S16", "marked",
    f"+o AS ({_OUTCOMES}) " + " UNION ALL ".join(f"SELECT 'summary' AS section, '{m}' AS metric, {m} AS value FROM o" for m in _OUTCOME_NAMES),
)
def _(v):
    return validation.counters_report(validation.record_outcomes(v("incidents")), "summary")
