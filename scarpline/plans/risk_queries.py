"""Risk levels, signals, alerts, decisions and location rules."""

from pyspark.sql import functions as F

from scarpline.functions import levels
from scarpline.operators import risk_rules as rules
from scarpline.plans.registry import query

_BARE = "upper(trim({c}, ' ' || chr(9) || chr(10)))"
NORMAL = f"CASE WHEN {_BARE} = 'MODERATE' THEN 'MEDIUM' WHEN {_BARE} IN ('LOW', 'MEDIUM', 'HIGH') THEN {_BARE} END"
RANK = "CASE {c} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 END"
TIERS = "CASE WHEN {c} >= CAST(0.75 AS DOUBLE) THEN 'VERY_HIGH' WHEN {c} >= CAST(0.55 AS DOUBLE) THEN 'HIGH' WHEN {c} >= CAST(0.35 AS DOUBLE) THEN 'MODERATE' ELSE 'LOW' END"
SCORE = "CASE WHEN {c} < 40 THEN 'LOW' WHEN {c} < 70 THEN 'MEDIUM' ELSE 'HIGH' END"


def case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in table.items()) + " END"


def highest(*columns: str) -> str:
    ranks = [RANK.format(c=c) for c in columns]
    known = " AND ".join(f"({r}) IS NOT NULL" for r in ranks)
    return f"CASE WHEN {known} THEN CASE greatest({', '.join(ranks)}) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END END"


@query("score_levels", "R1", "signals", f"SELECT trip_id, {SCORE.format(c='level_score')} AS risk_level FROM signals")
def _(v):
    return v("signals").select("trip_id", levels.score_level(F.col("level_score")).alias("risk_level"))


@query(
    "probability_levels", "R2", "risk_zones signals",
    f"SELECT 'zone' AS kind, id, {TIERS.format(c='risk_probability')} AS risk_level FROM risk_zones UNION ALL SELECT 'trip', trip_id, {TIERS.format(c='probability')} FROM signals",
)
def _(v):
    zones = v("risk_zones").select(F.lit("zone").alias("kind"), "id", levels.probability_level(F.col("risk_probability")).alias("risk_level"))
    trips = v("signals").select(F.lit("trip").alias("kind"), F.col("trip_id").alias("id"), levels.probability_level(F.col("probability")).alias("risk_level"))
    return zones.unionByName(trips)


@query("normalised_levels", "R3", "signals", f"SELECT trip_id, {NORMAL.format(c='ml_risk')} AS level FROM signals")
def _(v):
    return v("signals").select("trip_id", levels.normal_level(F.col("ml_risk")).alias("level"))


@query(
    "invalid_levels", "R3", "signals",
    f"SELECT ml_risk AS value, count(*) AS n FROM signals WHERE ({NORMAL.format(c='ml_risk')}) IS NULL GROUP BY ml_risk",
)
def _(v):
    return rules.invalid_levels(v("signals"), "ml_risk")


@query(
    "mixed_type_levels", "R4", "signals",
    f"""SELECT trip_id, CASE WHEN upper(level_text) IN ('LOW', 'MEDIUM', 'HIGH') THEN upper(level_text)
  WHEN level_text IS NULL THEN {SCORE.format(c='level_score')} END AS level FROM signals""",
)
def _(v):
    return v("signals").select("trip_id", levels.mixed_level(F.col("level_text"), F.col("level_score")).alias("level"))


_OVERALL = f"""SELECT trip_id, ml_risk, route_risk, image_risk, {highest('ml_risk', 'route_risk', 'image_risk')} AS overall_risk
FROM (SELECT trip_id, {NORMAL.format(c='ml_risk')} AS ml_risk, route_risk, image_risk FROM signals) s"""


@query("overall_risk", "R5", "signals", _OVERALL)
def _(v):
    return rules.overall_risk(v("signals")).select("trip_id", "ml_risk", "route_risk", "image_risk", "overall_risk")


@query("risk_ranks", "R6", "signals", f"SELECT trip_id, {RANK.format(c='route_risk')} AS risk_value FROM signals")
def _(v):
    return v("signals").select("trip_id", levels.rank(F.col("route_risk")).alias("risk_value"))


DETECTED = "array_to_string(list_filter([CASE WHEN landslide THEN 'LANDSLIDE' END, CASE WHEN flooding THEN 'FLOODING' END, CASE WHEN road_damage THEN 'ROAD_DAMAGE' END], lambda x: x IS NOT NULL), ',')"
IMAGE_A = "CASE WHEN landslide OR flooding THEN 'HIGH' WHEN road_damage THEN 'MEDIUM' ELSE 'LOW' END"
IMAGE_B = "CASE WHEN landslide OR (flooding AND road_damage) THEN 'HIGH' WHEN flooding OR road_damage THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "image_warnings", "R7", "image_flags",
    f"""SELECT trip_id, {DETECTED} AS detected_conditions, {IMAGE_A} AS warning_level,
  CASE {IMAGE_A} WHEN 'HIGH' THEN 'WARNING' WHEN 'MEDIUM' THEN 'CAUTION' ELSE 'SAFE' END AS action, landslide OR flooding OR road_damage AS warning_detected FROM image_flags""",
)
def _(v):
    out = rules.image_warning(v("image_flags")).drop(*rules.FLAGS)
    return out.withColumn("detected_conditions", F.array_join("detected_conditions", ","))


@query(
    "image_risk_scores", "R8", "image_flags",
    f"""SELECT trip_id, {IMAGE_B} AS risk_level, CASE WHEN landslide THEN 90 WHEN flooding AND road_damage THEN 80 WHEN flooding OR road_damage THEN 60 ELSE 10 END AS risk_score,
  {DETECTED} AS detected_conditions, CAST(landslide AS INT) + CAST(flooding AS INT) + CAST(road_damage AS INT) AS condition_count FROM image_flags""",
)
def _(v):
    out = rules.image_risk(v("image_flags")).drop(*rules.FLAGS)
    return out.withColumn("detected_conditions", F.array_join("detected_conditions", ","))


REASON_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} = '{lv}' THEN '{t}' END" for c, lv, t in rules.REASONS) + "], lambda x: x IS NOT NULL)"
SUMMARY = f"'Overall risk is ' || overall_risk || '. ' || CASE WHEN len({REASON_LIST}) = 0 THEN '{rules.NO_REASON}' ELSE array_to_string({REASON_LIST}, ' ') END"


@query("risk_explanations", "R9", "signals", f"SELECT trip_id, overall_risk, {SUMMARY} AS summary FROM ({_OVERALL}) o")
def _(v):
    return rules.explanation(rules.overall_risk(v("signals"))).select("trip_id", "overall_risk", "summary")


_ALERT = f"""SELECT trip_id, overall_risk, overall_risk IN ('MEDIUM', 'HIGH') AS alert_required, {case('overall_risk', rules.ALERT_LEVELS)} AS alert_level,
  {case('overall_risk', rules.ALERT_MESSAGES['basic'])} AS message FROM ({_OVERALL}) o"""


@query("alert_rules", "R10", "signals", _ALERT)
def _(v):
    out = rules.alert(rules.overall_risk(v("signals")))
    return out.select("trip_id", "overall_risk", "alert_required", "alert_level", "message")


@query(
    "routing_alerts", "R10", "signals",
    f"""SELECT trip_id, route_risk AS risk_level, {case('route_risk', rules.ALERT_MESSAGES['routing'])} || CASE WHEN trip_id % 2 = 0 THEN '{rules.REROUTE_SUFFIX}' ELSE '' END AS message FROM signals""",
)
def _(v):
    df = v("signals").withColumn("reroute", F.col("trip_id") % 2 == 0)
    return rules.alert(df, level="route_risk", style="routing", reroute="reroute").select("trip_id", F.col("route_risk").alias("risk_level"), "message")


@query(
    "notifications", "R11", "signals",
    f"SELECT trip_id, 'SAFETY_ALERT' AS type, alert_level AS level, overall_risk AS risk, message, alert_required AS display FROM ({_ALERT}) a",
)
def _(v):
    return rules.notification(rules.alert(rules.overall_risk(v("signals"))), keep=["trip_id"])


@query(
    "decisions", "R12", "signals",
    f"""SELECT trip_id, image_risk IN ('MEDIUM', 'HIGH') AS alert_required, {case('image_risk', rules.ALERT_LEVELS)} AS alert_level, route_risk = 'HIGH' AND trip_id % 2 = 0 AS reroute_required,
  CASE WHEN route_risk = 'HIGH' AND trip_id % 2 = 0 THEN 'REROUTE' ELSE 'CONTINUE' END AS route_action, {case('image_risk', rules.PRIORITIES)} AS priority FROM signals""",
)
def _(v):
    df = v("signals").withColumn("safer_route_available", F.col("trip_id") % 2 == 0)
    out = rules.decision(df, final="image_risk")
    return out.select("trip_id", "alert_required", "alert_level", "reroute_required", "route_action", "priority")


@query("environment_fields", "R13", "env", f"SELECT env_id, {', '.join(rules.ENVIRONMENT_FIELDS)} FROM env")
def _(v):
    return rules.environment_fields(v("env"), keep=["env_id"])


DISTANCE = "abs(latitude - CAST(11.41 AS DOUBLE)) + abs(longitude - CAST(76.69 AS DOUBLE))"


def band_sql(bands, field: str) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"
    whens = " ".join(f"WHEN d < CAST({limit} AS DOUBLE) THEN {q(a[field])}" for limit, a in bands if limit is not None)
    return f"CASE {whens} ELSE {q(bands[-1][1][field])} END AS {field}"


@query(
    "environment_by_distance", "R14", "reports",
    f"SELECT id, {', '.join(band_sql(rules.ENVIRONMENT_BANDS, f) for f in rules.ENVIRONMENT_BANDS[0][1])} FROM (SELECT id, {DISTANCE} AS d FROM reports) r",
)
def _(v):
    return rules.environment_at(v("reports").select("id", "latitude", "longitude")).drop("latitude", "longitude")


FACTORS = (
    "CASE WHEN latitude BETWEEN CAST(11.35 AS DOUBLE) AND CAST(11.45 AS DOUBLE) THEN '" + "|".join((*rules.WET_FACTORS, *rules.COMMON_FACTORS))
    + "' ELSE '" + "|".join((*rules.DRY_FACTORS, *rules.COMMON_FACTORS)) + "' END AS factors"
)
_RISK_COLS = ", ".join(band_sql(rules.RISK_BANDS, f) for f in rules.RISK_BANDS[0][1])


@query(
    "risk_by_distance", "R15", "reports",
    f"SELECT id, {_RISK_COLS}, {FACTORS} FROM (SELECT id, latitude, {DISTANCE} AS d FROM reports) r",
)
def _(v):
    out = rules.risk_at(v("reports").select("id", "latitude", "longitude")).drop("latitude", "longitude")
    return out.withColumn("factors", F.array_join("factors", "|"))


@query(
    "batch_coordinate_scores", "R16", "coordinates",
    f"""+k AS (SELECT *, CAST(printf('%.4f', latitude) AS DOUBLE) AS lat_key, CAST(printf('%.4f', longitude) AS DOUBLE) AS lon_key FROM coordinates),
f AS (SELECT lat_key, lon_key, arg_min(latitude, ordinal) AS latitude, arg_min(longitude, ordinal) AS longitude FROM k GROUP BY 1, 2),
s AS (SELECT lat_key, lon_key, {_RISK_COLS}, {FACTORS} FROM (SELECT *, {DISTANCE} AS d FROM f) x)
SELECT k.ordinal, k.request_id, s.* FROM k JOIN s ON k.lat_key = s.lat_key AND k.lon_key = s.lon_key""",
)
def _(v):
    out = rules.score_coordinates(v("coordinates")).drop("latitude", "longitude")
    return out.withColumn("factors", F.array_join("factors", "|"))


@query(
    "batch_request_check", "R16", "coordinates",
    """SELECT request_id, count(*) AS items, count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)) AS invalid_items,
  count(*) BETWEEN 1 AND 9 AND count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)) = 0 AS accepted
FROM (SELECT * REPLACE (request_id + CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END AS request_id) FROM coordinates) c GROUP BY request_id""",
)
def _(v):
    moved = F.col("request_id") + F.when(F.col("ordinal") % 7 == 0, 1).otherwise(0)  # requests of different sizes
    return rules.request_check(v("coordinates").withColumn("request_id", moved), high=9)


@query(
    "nested_levels", "R17", "responses",
    """SELECT request_id, upper(coalesce(json_extract_string(body, '$.risk_level'), json_extract_string(body, '$.final_risk'),
  CASE WHEN json_type(body, '$.risk') = 'VARCHAR' THEN json_extract_string(body, '$.risk') END,
  json_extract_string(body, '$.risk.risk_level'), json_extract_string(body, '$.risk.final_risk'))) AS level FROM responses""",
)
def _(v):
    return v("responses").select("request_id", rules.nested_level(F.col("body")).alias("level"))


@query(
    "confidence_bands", "M7", "predictions",
    f"""SELECT env_id, {case('actual', {k: s for k, (s, _) in rules.LEVEL_STATUS.items()})} AS status, {case('actual', {k: a for k, (_, a) in rules.LEVEL_STATUS.items()})} AS action,
  CASE WHEN confidence >= CAST(0.8 AS DOUBLE) THEN 'HIGH CONFIDENCE' WHEN confidence >= CAST(0.6 AS DOUBLE) THEN 'MODERATE CONFIDENCE' ELSE 'LOW CONFIDENCE' END AS confidence_level FROM predictions""",
)
def _(v):
    return rules.confidence_band(v("predictions"), level="actual").select("env_id", "status", "action", "confidence_level")


_PROB = "least(greatest(CAST(printf('%.2f', coalesce(rainfall, 100) / CAST(200 AS DOUBLE) * CAST(0.6 AS DOUBLE) + coalesce(slope, 25) / CAST(60 AS DOUBLE) * CAST(0.4 AS DOUBLE)) AS DOUBLE), CAST(0.05 AS DOUBLE)), CAST(0.98 AS DOUBLE))"


@query(
    "heuristic_probability", "M13 R2", "ml_requests",
    f"SELECT request_id, risk_probability, {TIERS.format(c='risk_probability')} AS risk_level FROM (SELECT request_id, {_PROB} AS risk_probability FROM ml_requests) m",
)
def _(v):
    out = rules.heuristic_probability(v("ml_requests"))
    return out.select("request_id", "risk_probability", levels.probability_level(F.col("risk_probability")).alias("risk_level"))


_FACTOR_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN coalesce({name}, CAST({rules.FEATURE_DEFAULTS[name]} AS DOUBLE)) {op} CAST({limit} AS DOUBLE) THEN '{text}' END" for name, op, limit, text in rules.FEATURE_FACTORS
) + "], lambda x: x IS NOT NULL)"


@query(
    "feature_factors", "M14", "ml_requests",
    f"SELECT request_id, CASE WHEN len({_FACTOR_LIST}) = 0 THEN '{rules.NO_FACTOR}' ELSE array_to_string({_FACTOR_LIST}, '|') END AS factors FROM ml_requests",
)
def _(v):
    return rules.feature_factors(v("ml_requests")).select("request_id", F.array_join("factors", "|").alias("factors"))
