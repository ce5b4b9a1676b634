"""Dataset checks on the feature table and the hand-over contract."""

from pyspark.sql import functions as F

from scarpline.operators import contracts, dataset_qa, ml_tables
from scarpline.plans.incident_queries import STRICT_DATE, n
from scarpline.plans.registry import check_view, query
from scarpline.plans.spatial_queries import features as extracted, points

LAYERS = dataset_qa.LAYER_COLUMNS


def found(check: str, source: str, rules) -> str:
    parts = [f"SELECT '{check}' AS check_name, '{sev}' AS severity, '{detail}' AS detail, CAST({agg} AS BIGINT) AS n FROM {source}" for sev, detail, agg in rules]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE n > 0"


def features(v):
    """The feature table as the checks receive it."""
    return extracted(v)


def layer(v):
    """Point layer in which some records are shifted and some stand under another key."""
    shifted = F.col("ordinal") % 13 == 0
    moved = points(v).withColumn("longitude", F.when(shifted, F.col("longitude") + 0.5).otherwise(F.col("longitude")))
    other = F.col("ordinal") % 101 == 0
    renamed = moved.withColumns(
        {
            "landslide_id": F.when(other, F.concat(F.lit("moved-"), F.col("landslide_id"))).otherwise(F.col("landslide_id")),
            "ordinal": F.when(other, -F.col("ordinal") - 1).otherwise(F.col("ordinal")),
        }
    )
    return renamed.withColumn("geometry", F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")))


check_view(
    "layer", "points",
    """SELECT * REPLACE (CASE WHEN ordinal % 13 = 0 THEN longitude + 0.5 ELSE longitude END AS longitude,
  CASE WHEN ordinal % 101 = 0 THEN 'moved-' || landslide_id ELSE landslide_id END AS landslide_id,
  CASE WHEN ordinal % 101 = 0 THEN -ordinal - 1 ELSE ordinal END AS ordinal) FROM points""",
)
_PRESENT = [c for c in dataset_qa.EXPECTED_COLUMNS if c != "data_quality_status"]
_STRUCTURAL = [("WARNING", "missing column data_quality_status", "1")]
_STRUCTURAL += [("WARNING", f"empty column {c}", f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END") for c in _PRESENT]
_sql_structural = " UNION ALL ".join(
    [f"SELECT 'structural' AS check_name, 'WARNING' AS severity, 'missing column data_quality_status' AS detail, CAST(1 AS BIGINT) AS n",
     found("structural", "features", _STRUCTURAL[1:])]
)


@query("structural_check", "Q1", "features", _sql_structural)
def _(v):
    return dataset_qa.structural(features(v))


_IDS = [
    ("ERROR", "missing landslide_id", n("landslide_id IS NULL")),
    ("ERROR", "duplicate landslide_id", "count(*) - count(DISTINCT landslide_id) - CASE WHEN count(*) > count(landslide_id) THEN 1 ELSE 0 END"),
]


@query("id_check", "Q2", "features", found("ids", "features", _IDS))
def _(v):
    return dataset_qa.ids(features(v))


@query("duplicated_id_list", "Q2", "features", "SELECT landslide_id, count(*) AS n FROM features WHERE landslide_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return dataset_qa.duplicated_ids(features(v))


_DATES = [
    ("WARNING", "missing date", n("date IS NULL")),
    ("ERROR", "invalid date", n(f"date IS NOT NULL AND {STRICT_DATE} IS NULL")),
    ("WARNING", "before year 2016", n(f"year({STRICT_DATE}) < 2016")),
    ("WARNING", "after year 2018", n(f"year({STRICT_DATE}) > 2018")),
]


@query("date_plausibility", "Q3", "features", found("dates", "features", _DATES))
def _(v):
    return dataset_qa.dates(features(v), years=(2016, 2018))


_COORDS = []
for _f, _hi in (("latitude", 90), ("longitude", 180)):
    _num = f"TRY_CAST({_f} AS DOUBLE)"
    _COORDS += [
        ("ERROR", f"non-numeric {_f}", n(f"{_f} IS NOT NULL AND {_num} IS NULL")),
        ("WARNING", f"missing {_f}", n(f"{_f} IS NULL")),
        ("ERROR", f"{_f} out of range", n(f"{_num} < -{_hi} OR {_num} > {_hi}")),
    ]


@query("coordinate_range_check", "Q4", "incidents", found("coordinates", "incidents", _COORDS))
def _(v):
    return dataset_qa.coordinates(v("incidents"))


check_view(
    "matched", "features layer",
    """SELECT coalesce(f.ordinal, g.ordinal) AS ordinal, f.ordinal IS NOT NULL AS in_table, g.ordinal IS NOT NULL AS in_layer,
  f.latitude AS t_lat, f.longitude AS t_lon, g.latitude AS g_lat, g.longitude AS g_lon,
  f.ordinal IS NOT NULL AND g.ordinal IS NOT NULL AND (abs(g.latitude - f.latitude) > 1e-10 OR abs(g.longitude - f.longitude) > 1e-10) AS differs
FROM features f FULL OUTER JOIN layer g ON f.ordinal = g.ordinal""",
)
_MATCH = [
    ("WARNING", "record count difference", f"abs({n('in_table')} - {n('in_layer')})"),
    ("WARNING", "coordinate mismatch", n("differs")),
]


@query("table_layer_match", "Q5", "matched", found("spatial_match", "matched", _MATCH))
def _(v):
    return dataset_qa.spatial_match(features(v), layer(v))


@query("first_coordinate_mismatches", "Q5", "matched", "SELECT ordinal, t_lat, t_lon, g_lat, g_lon FROM matched WHERE differs ORDER BY ordinal LIMIT 5")
def _(v):
    return dataset_qa.first_mismatches(features(v), layer(v))


# Ranges tighter than the real ones, so that the demonstration layers violate them.
_TIGHT = {"ndvi": (-0.4, 0.9), "elevation_m": (None, None), "slope_deg": (1, None), "aspect_deg": (0, 300)}
_RANGES = []
for _f, (_lo, _hi) in _TIGHT.items():
    if _lo is not None:
        _RANGES.append(("ERROR", f"{_f} below {_lo}", n(f"{_f} < CAST({_lo} AS DOUBLE)")))
    if _hi is not None:
        _RANGES.append(("ERROR", f"{_f} above {_hi}", n(f"{_f} > CAST({_hi} AS DOUBLE)")))


@query("feature_range_check", "Q6", "features", found("feature_ranges", "features", _RANGES))
def _(v):
    return dataset_qa.feature_ranges(features(v), _TIGHT)


@query(
    "status_value_consistency", "Q7", "features",
    found("status_consistency", "(SELECT * REPLACE (CASE WHEN ordinal % 9 <> 0 THEN ndvi END AS ndvi) FROM features) f",
          [("WARNING", f"{c} extracted but missing", n(f"{x}_status = 'EXTRACTED' AND {c} IS NULL")) for x, c in LAYERS.items()]),
)
def _(v):
    holed = features(v).withColumn("ndvi", F.when(F.col("ordinal") % 9 != 0, F.col("ndvi")))
    return dataset_qa.status_consistency(holed)


@query(
    "missing_statistics", "Q8", "features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS total, count({c}) AS valid, count(*) - count({c}) AS missing, "
        f"round_even(CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 2) AS missing_pct FROM features"
        for c in dataset_qa.IMPORTANT
    ),
)
def _(v):
    return dataset_qa.missing_statistics(features(v))


_FEATURE_COLUMNS = ", ".join(_PRESENT)


_DUPLICATES = (
    "SELECT * FROM ("
    f"SELECT 'duplicates' AS check_name, 'WARNING' AS severity, 'duplicate rows' AS detail, CAST(sum(m - 1) AS BIGINT) AS n FROM (SELECT count(*) AS m FROM features GROUP BY {_FEATURE_COLUMNS}) a"
    " UNION ALL SELECT 'duplicates', 'WARNING', 'duplicate ids', CAST(sum(m - 1) AS BIGINT) FROM (SELECT count(*) AS m FROM features GROUP BY landslide_id) b"
    " UNION ALL SELECT 'duplicates', 'WARNING', 'duplicate coordinates', CAST(sum(m - 1) AS BIGINT) FROM (SELECT count(*) AS m FROM features GROUP BY latitude, longitude) c) t WHERE n > 0"
)


@query("duplicate_audit", "Q9", "features", _DUPLICATES)
def _(v):
    return dataset_qa.duplicates(features(v))


_PROVENANCE = (
    found("provenance", "features", [
        ("WARNING", "no record is marked", f"CASE WHEN {n(chr(39).join(['data_source_type = ', 'SYNTHETIC_DEMO', '']))} = 0 THEN count(*) END"),
        ("WARNING", "records without the mark", n("data_source_type <> ''SYNTHETIC_DEMO''".replace("''", "'"))),
    ]) + " UNION ALL SELECT 'provenance', 'INFO', 'other value ' || data_source_type, count(*) FROM features WHERE data_source_type <> 'SYNTHETIC_DEMO' GROUP BY data_source_type"
)


@query("provenance_audit", "Q10", "features", _PROVENANCE)
def _(v):
    return dataset_qa.provenance(features(v))


_ID_DIFFERENCES = """SELECT 'table' AS side, landslide_id FROM (SELECT DISTINCT landslide_id FROM features WHERE landslide_id IS NOT NULL EXCEPT SELECT landslide_id FROM layer) a
UNION ALL SELECT 'layer', landslide_id FROM (SELECT DISTINCT landslide_id FROM layer WHERE landslide_id IS NOT NULL EXCEPT SELECT landslide_id FROM features) b"""


@query("id_differences", "Q11", "features layer", _ID_DIFFERENCES)
def _(v):
    return dataset_qa.id_differences(features(v), layer(v))


_EX = " + ".join(f"CASE WHEN {x}_status = 'EXTRACTED' THEN 1 ELSE 0 END" for x in LAYERS)
_TAMPER = "CASE WHEN ordinal % 17 = 3 THEN 'complete ' WHEN ordinal % 17 = 4 THEN 'UNKNOWN' WHEN ordinal % 17 = 5 THEN 'PARTIAL' ELSE feature_extraction_status END"


@query(
    "extraction_status_consistency", "Q12", "features",
    found("extraction_status", f"(SELECT upper(trim({_TAMPER})) AS s, {_EX} AS k FROM features) f", [
        ("WARNING", "unexpected status values", "count(DISTINCT CASE WHEN s NOT IN ('COMPLETE', 'PARTIAL', 'NO_FEATURES', 'REVIEW_REQUIRED') THEN s END)".replace("'", "'")),
        ("WARNING", "inconsistent records", n("(s = 'COMPLETE' AND k < 4) OR (s = 'PARTIAL' AND k IN (0, 4)) OR (s = 'NO_FEATURES' AND k > 0)")),
    ]),
)
def _(v):
    return dataset_qa.extraction_consistency(features(v).withColumn("feature_extraction_status", F.expr(_TAMPER)))


@query(
    "rainfall_handling", "Q13", "features",
    found("rainfall", "(SELECT CASE WHEN ordinal % 8 = 0 THEN 'EXTRACTED' ELSE rainfall_status END AS rs, CASE WHEN ordinal % 8 = 0 THEN 1.5 END AS rain FROM features) f", [
        ("WARNING", "records without the mark", f"CASE WHEN {n(chr(39).join(['rs = ', 'NOT_SPATIALLY_MAPPABLE', '']))} > 0 THEN {n(chr(39).join(['rs <> ', 'NOT_SPATIALLY_MAPPABLE', '']))} END"),
        ("INFO", "values in rainfall_24h", "count(rain)"),
    ]),
)
def _(v):
    eighth = F.col("ordinal") % 8 == 0
    changed = features(v).withColumns(
        {
            "rainfall_status": F.when(eighth, "EXTRACTED").otherwise(F.col("rainfall_status")),
            "rainfall_24h": F.when(eighth, 1.5),
        }
    )
    return dataset_qa.rainfall(changed)


def _contains_any(fragments) -> str:
    return " OR ".join(f"contains(lower(column_name), '{x}')" for x in fragments)


@query(
    "leaking_column_names", "Q14", "column_lists",
    f"SELECT DISTINCT dataset_id, column_name FROM column_lists WHERE {_contains_any(dataset_qa.LEAKAGE_FRAGMENTS)}",
)
def _(v):
    return dataset_qa.leakage(v("column_lists").select("dataset_id", "column_name"))


_AUDIT = " UNION ALL ".join([
    "SELECT check_name, severity FROM (" + _sql_structural + ") q1",
    "SELECT check_name, severity FROM (" + found("ids", "features", _IDS) + ") q2",
    "SELECT check_name, severity FROM (" + found("dates", "features", _DATES) + ") q3",
    "SELECT check_name, severity FROM (" + found("spatial_match", "matched", _MATCH) + ") q5",
    "SELECT check_name, severity FROM (" + found("feature_ranges", "features", _RANGES) + ") q6",
])


@query(
    "audit_verdict", "Q15", "features matched",
    f"""+a AS ({_AUDIT})
SELECT check_name, CASE WHEN bool_or(severity = 'ERROR') THEN 'FAIL' WHEN bool_or(severity = 'WARNING') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status,
  count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings FROM a GROUP BY check_name
UNION ALL SELECT 'OVERALL', CASE WHEN bool_or(severity = 'ERROR') THEN 'FAIL' WHEN bool_or(severity = 'WARNING') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END,
  count(*) FILTER (WHERE severity = 'ERROR'), count(*) FILTER (WHERE severity = 'WARNING') FROM a""",
)
def _(v):
    f = features(v)
    parts = [
        dataset_qa.structural(f), dataset_qa.ids(f), dataset_qa.dates(f, years=(2016, 2018)),
        dataset_qa.spatial_match(f, layer(v)), dataset_qa.feature_ranges(f, _TIGHT),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dataset_qa.verdict(out)


_REAL_RANGES = []
for _f, (_lo, _hi) in dataset_qa.FEATURE_RANGES.items():
    if _lo is not None:
        _REAL_RANGES.append(("ERROR", f"{_f} below {_lo}", n(f"{_f} < {_lo}")))
    if _hi is not None:
        _REAL_RANGES.append(("ERROR", f"{_f} above {_hi}", n(f"{_f} > {_hi}")))
_REAL_YEARS = [r for r in _DATES if "year" not in r[1]] + [
    ("WARNING", "before year 1900", n(f"year({STRICT_DATE}) < 1900")),
    ("WARNING", "after year 2030", n(f"year({STRICT_DATE}) > 2030")),
]
_WRONG = n("(s = 'COMPLETE' AND k < 4) OR (s = 'PARTIAL' AND k IN (0, 4)) OR (s = 'NO_FEATURES' AND k > 0)")
_FULL_AUDIT = " UNION ALL ".join(
    f"SELECT check_name, severity, detail, n FROM ({part}) p{i}"
    for i, part in enumerate([
        _sql_structural,
        found("ids", "features", _IDS),
        found("dates", "features", _REAL_YEARS),
        found("coordinates", "features", _COORDS),
        found("spatial_match", "matched", _MATCH),
        found("feature_ranges", "features", _REAL_RANGES),
        found("status_consistency", "features", [("WARNING", f"{c} extracted but missing", n(f"{x}_status = 'EXTRACTED' AND {c} IS NULL")) for x, c in LAYERS.items()]),
        _DUPLICATES,
        _PROVENANCE,
        found("extraction_status", f"(SELECT feature_extraction_status AS s, {_EX} AS k FROM features) f", [("WARNING", "inconsistent records", _WRONG)]),
        found("rainfall", "features", [("WARNING", "records without the mark", n("rainfall_status <> 'NOT_SPATIALLY_MAPPABLE'")), ("INFO", "values in rainfall_24h", "count(rainfall_24h)")]),
        f"SELECT 'cross_dataset' AS check_name, 'WARNING' AS severity, 'ids only in ' || side AS detail, count(*) AS n FROM ({_ID_DIFFERENCES}) d GROUP BY side",
    ])
)


@query("full_audit", "Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q9 Q10 Q11 Q12 Q13 Q14", "matched features layer", _FULL_AUDIT)
def _(v):
    return dataset_qa.audit(features(v), layer(v))


# --- ML tables ---------------------------------------------------------------


@query("required_column_gate", "F1", "features", "SELECT ordinal FROM features")
def _(v):
    return ml_tables.require_columns(features(v)).select("ordinal")


_ML = ", ".join(contracts.FEATURE_ORDER)
_META = ", ".join(c for c in ml_tables.METADATA_COLUMNS if c != "data_quality_status")


@query("ml_features", "F2", "features", f"SELECT {_ML} FROM features")
def _(v):
    return ml_tables.feature_projection(features(v))


@query("ml_metadata", "F3", "features", f"SELECT {_META} FROM features")
def _(v):
    return ml_tables.metadata_projection(features(v))


def _manifest_sql() -> str:
    parts = []
    for name, (kind, units, low, high, purpose) in ml_tables.MANIFEST.items():
        num = name if kind == "float" else "CAST(NULL AS DOUBLE)"
        q = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
        bad = f"count(*) FILTER (WHERE {name} < {low} OR {name} > {high})" if low is not None else "CAST(0 AS BIGINT)"
        u = "CAST(NULL AS VARCHAR)" if units is None else f"'{units}'"
        parts.append(
            f"SELECT '{name}' AS feature, '{kind}' AS data_type, {u} AS units, {q(low)} AS valid_min, {q(high)} AS valid_max, '{purpose}' AS purpose, "
            f"count({name}) AS valid, min({num}) AS observed_min, max({num}) AS observed_max, {bad} AS out_of_range FROM features"
        )
    return " UNION ALL ".join(parts)


@query("feature_manifest", "F4", "features", _manifest_sql())
def _(v):
    return ml_tables.manifest_with_statistics(ml_tables.feature_projection(features(v)))


@query(
    "missing_summary", "F5", "features",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS valid, count(*) - count({c}) AS missing FROM features" for c in ml_tables.SUMMARISED),
)
def _(v):
    return ml_tables.missing_summary(ml_tables.feature_projection(features(v)))


# --- contract ----------------------------------------------------------------

_ORDER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(contracts.FEATURE_ORDER, start=1))
_KNOWN = ", ".join(f"'{c}'" for c in contracts.FEATURE_ORDER)


@query(
    "schema_contract", "K1", "column_lists",
    f"""SELECT dataset_id, 8 - count(DISTINCT CASE WHEN column_name IN ({_KNOWN}) THEN column_name END) AS missing, count(*) FILTER (WHERE column_name NOT IN ({_KNOWN})) AS unexpected,
  count(*) = 8 AND bool_and(coalesce(position = CASE column_name {_ORDER} END, false)) AS order_matches FROM column_lists GROUP BY dataset_id""",
)
def _(v):
    return contracts.schema_contract(v("column_lists"))


@query(
    "type_contract", "K2", "features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{'numeric' if c in contracts.NUMERIC else 'string'}' AS expected, true AS passed, CAST(0 AS BIGINT) AS unreadable"
        for c in (*contracts.NUMERIC, *contracts.TEXT)
    ),
)
def _(v):
    return contracts.type_contract(ml_tables.feature_projection(features(v)))


def _checks(rows) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, k = 0 AS passed, CAST(k AS BIGINT) AS n FROM (SELECT {agg} AS k FROM {src}) t{i}" for i, (name, agg, src) in enumerate(rows)
    )


@query(
    "range_contract", "K3", "incidents",
    _checks([
        ("latitude in range", n("NOT coalesce(TRY_CAST(latitude AS DOUBLE) BETWEEN -90 AND 90, false)"), "incidents"),
        ("longitude in range", n("NOT coalesce(TRY_CAST(longitude AS DOUBLE) BETWEEN -180 AND 180, false)"), "incidents"),
    ]),
)
def _(v):
    return contracts.range_contract(v("incidents"))


def _handover(v):
    """Metadata in which a few records stand under another id."""
    f = features(v)
    other = F.when(F.col("ordinal") % 23 == 5, F.concat(F.lit("lost-"), F.col("landslide_id"))).otherwise(F.col("landslide_id"))
    return ml_tables.feature_projection(f), ml_tables.metadata_projection(f.withColumn("landslide_id", other))


_META_SRC = "(SELECT * REPLACE (CASE WHEN ordinal % 23 = 5 THEN 'lost-' || landslide_id ELSE landslide_id END AS landslide_id) FROM features) m"


@query(
    "marker_contract", "K4", "features",
    _checks([
        ("all rows marked as demo", n("data_source_type <> 'SYNTHETIC_DEMO'"), "features"),
        ("all rainfall unmappable", n("rainfall_status <> 'NOT_SPATIALLY_MAPPABLE'"), _META_SRC),
    ]),
)
def _(v):
    return contracts.marker_contract(*_handover(v))


_COUNT_CHECKS = [
    ("expected record count", "abs(count(*) - 1000)", "features"),
    ("metadata rows match features", "abs((SELECT count(*) FROM features) - count(*))", _META_SRC),
]


@query("row_count_contract", "K5", "features", _checks(_COUNT_CHECKS))
def _(v):
    return contracts.row_count_contract(*_handover(v), expected=1000)


@query(
    "name_leakage_contract", "K6", "column_lists",
    " UNION ALL ".join(
        [f"SELECT '{rule}' AS rule, dataset_id, column_name FROM column_lists WHERE {_contains_any(fr)}" for rule, fr in contracts.NAME_RULES.items()]
        + [f"SELECT '{rule}' AS rule, dataset_id, column_name FROM column_lists WHERE column_name IN ({', '.join(repr(x) for x in names)})"
           for rule, names in contracts.EXACT_NAME_RULES.items()]
    ),
)
def _(v):
    return contracts.name_contract(v("column_lists"))


_TRACE = [
    ("ids found in metadata", "count(*)", f"(SELECT landslide_id FROM features EXCEPT SELECT landslide_id FROM {_META_SRC}) d"),
    ("historical columns kept", "0 * count(*)", "features"),
]


_FILES = [("source files present", "CASE WHEN count(*) > 0 THEN 0 ELSE 1 END", "datasets")]


@query("traceability_contract", "K8", "features datasets", _checks([*_TRACE, *_FILES]))
def _(v):
    return contracts.traceability(*_handover(v), files=v("datasets"))


@query(
    "contract_summary", "K7", "features",
    "+r AS (" + _checks([
        *_COUNT_CHECKS, *_TRACE,
        ("all rows marked as demo", n("data_source_type <> 'SYNTHETIC_DEMO'"), "features"),
        ("all rainfall unmappable", n("rainfall_status <> 'NOT_SPATIALLY_MAPPABLE'"), _META_SRC),
        ("latitude in range", n("NOT coalesce(latitude BETWEEN -90 AND 90, false)"), "features"),
        ("longitude in range", n("NOT coalesce(longitude BETWEEN -180 AND 180, false)"), "features"),
    ]) + """) SELECT count(*) FILTER (WHERE passed) + 12 AS checks_passed, count(*) + 12 AS checks_total,
  CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS result FROM r""",
)
def _(v):
    f, m = _handover(v)
    return contracts.summary(contracts.contract(f, m, expected=1000))
