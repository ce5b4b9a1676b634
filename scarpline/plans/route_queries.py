"""Route ranking, rerouting and whole trip assessments."""

from pyspark.sql import functions as F

from scarpline.operators import risk_rules, routes
from scarpline.plans.registry import check_view, query
from scarpline.plans.risk_queries import IMAGE_A, IMAGE_B, NORMAL, SCORE, SUMMARY, case, highest

_COMPUTED = "least(CAST(100 AS DOUBLE), round_even(risk * CAST(0.8 AS DOUBLE) + least(distance * 2, 20), 0))"


def _level(c: str, middle: str = "MEDIUM") -> str:
    return SCORE.format(c=c).replace("MEDIUM", middle)


check_view("scored", "routes", f"SELECT *, {_COMPUTED} AS risk_score FROM routes")


def _trip_view(source: str, risk: str) -> str:
    return f"""SELECT trip_id, max(CASE WHEN is_current THEN route END) AS cur, max(CASE WHEN is_current THEN {risk} END) AS cur_risk,
  arg_min(route, {risk} * 10 + ordinal) AS best, min({risk}) AS best_risk, arg_min(distance, {risk} * 10 + ordinal) AS best_distance,
  arg_min(route, {risk} * 10 + ordinal) FILTER (WHERE NOT is_current) AS alt, min({risk}) FILTER (WHERE NOT is_current) AS alt_risk,
  arg_min(route, {risk} * 10 + ordinal) FILTER (WHERE {risk} < 70) AS safe FROM {source} GROUP BY trip_id"""


check_view("trips", "routes", _trip_view("routes", "risk"))
check_view("trips_scored", "scored", _trip_view("scored", "risk_score"))


@query("route_levels", "T1", "routes", f"SELECT trip_id, ordinal, route, {_level('risk')} AS risk_level FROM routes")
def _(v):
    return routes.classify(v("routes")).select("trip_id", "ordinal", "route", "risk_level")


@query("computed_route_risk", "T2", "scored", f"SELECT trip_id, ordinal, risk_score, {_level('risk_score')} AS risk_level FROM scored")
def _(v):
    return routes.with_computed_risk(v("routes")).select("trip_id", "ordinal", "risk_score", "risk_level")


@query(
    "safest_routes", "T3", "trips",
    f"SELECT trip_id, best AS safest_route, best_risk AS safest_risk, {_level('best_risk')} AS safest_level, best_distance AS safest_distance FROM trips",
)
def _(v):
    return routes.safest(v("routes"))


_CATEGORY = "CASE WHEN risk < 40 THEN 'safe_routes' WHEN risk < 70 THEN 'moderate_routes' ELSE 'risky_routes' END"


@query("route_categories", "T4", "routes", f"SELECT trip_id, {_CATEGORY} AS category, ordinal, route FROM routes")
def _(v):
    return routes.categories(v("routes"))


@query(
    "route_category_sizes", "T4", "routes",
    "SELECT trip_id, count(*) FILTER (WHERE risk < 40) AS safe_routes, count(*) FILTER (WHERE risk >= 40 AND risk < 70) AS moderate_routes, count(*) FILTER (WHERE risk >= 70) AS risky_routes FROM routes GROUP BY trip_id",
)
def _(v):
    return routes.category_sizes(v("routes"))


@query(
    "route_recommendations", "T5", "routes",
    """SELECT trip_id, ordinal, CASE WHEN risk < 40 THEN 'SAFE ROUTE' WHEN risk < 70 THEN 'USE WITH CAUTION' ELSE 'AVOID IF POSSIBLE' END AS recommendation,
  CASE WHEN risk < 40 THEN 'PROCEED' WHEN risk < 70 THEN 'CAUTION' ELSE 'WARNING' END AS status FROM routes""",
)
def _(v):
    return routes.recommendation(v("routes")).select("trip_id", "ordinal", "recommendation", "status")


@query(
    "route_alternatives", "T6", "routes trips",
    """SELECT r.trip_id, t.cur AS current_route, t.cur_risk AS current_risk, r.route AS alternative_route, r.risk, r.route = t.alt AS is_safest
FROM routes r JOIN trips t ON r.trip_id = t.trip_id WHERE NOT r.is_current AND r.risk < t.cur_risk""",
)
def _(v):
    return routes.alternatives(v("routes"))


@query(
    "reroute_rule_a", "T7", "trips",
    f"""SELECT trip_id, cur AS current_route, cur_risk >= 70 AND safe IS NOT NULL AS rerouted, CASE WHEN cur_risk < 70 THEN cur ELSE safe END AS recommended_route,
  CASE WHEN cur_risk < 70 THEN '{routes.REASONS['calm']}' WHEN safe IS NULL THEN '{routes.REASONS['stuck']}' ELSE '{routes.REASONS['moved']}' END AS reason FROM trips""",
)
def _(v):
    return routes.reroute(v("routes"), "A")


def _reroute_sql(source: str, stay: str, status: str) -> str:
    moved = "cur_risk >= 70 AND coalesce(alt_risk < cur_risk, false)"
    return f"""SELECT trip_id, cur AS current_route, cur_risk AS current_risk, {_level('cur_risk')} AS current_level, {moved} AS rerouted,
  CASE WHEN {moved} THEN alt ELSE {stay} END AS recommended_route, CASE WHEN {moved} THEN '{routes.REROUTE}' ELSE '{status}' END AS status FROM {source}"""


_B = _reroute_sql("trips", "cur", routes.STAY)
_C = _reroute_sql("trips_scored", "NULL", routes.NO_REROUTE)


@query("reroute_rule_b", "T8", "trips", _B)
def _(v):
    return routes.reroute(v("routes"), "B")


@query("reroute_rule_c", "T9", "trips_scored", _C)
def _(v):
    return routes.reroute(routes.with_computed_risk(v("routes")), "C", risk="risk_score")


@query(
    "route_comparison", "T10", "routes trips",
    """SELECT b.trip_id, b.route AS recommended_route, o.route AS alternative_route, round((b.distance - o.distance) / o.distance * 100, 6) AS longer_pct,
  round(CASE WHEN o.risk > 0 THEN (o.risk - b.risk) / o.risk * 100 END, 6) AS less_exposure_pct
FROM trips t JOIN routes b ON b.trip_id = t.trip_id AND b.route = t.best
JOIN (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY distance, ordinal) AS rn FROM (SELECT r.* FROM routes r JOIN trips t ON r.trip_id = t.trip_id AND r.route <> t.best) x) o
  ON o.trip_id = t.trip_id AND o.rn = 1""",
)
def _(v):
    out = routes.comparison(v("routes"))
    return out.withColumns({c: F.round(c, 6) for c in ("longer_pct", "less_exposure_pct")})


_JOINED = "SELECT f.*, s.ml_risk FROM image_flags f JOIN signals s ON f.trip_id = s.trip_id"
_SIGNALS_A = f"""SELECT j.trip_id, {NORMAL.format(c='j.ml_risk')} AS ml_risk, {_level('m.current_risk')} AS route_risk, {IMAGE_A} AS image_risk, m.recommended_route, m.rerouted
FROM ({_JOINED}) j JOIN ({_B}) m ON j.trip_id = m.trip_id"""


@query(
    "trip_assessment_a", "R18", "image_flags signals trips",
    f"""SELECT trip_id, ml_risk, route_risk, image_risk, overall_risk, {SUMMARY} AS summary, recommended_route, rerouted, 'SAFETY_ALERT' AS type,
  {case('overall_risk', risk_rules.ALERT_LEVELS)} AS alert_level, {case('overall_risk', risk_rules.ALERT_MESSAGES['basic'])} AS message, overall_risk IN ('MEDIUM', 'HIGH') AS display
FROM (SELECT *, {highest('ml_risk', 'route_risk', 'image_risk')} AS overall_risk FROM ({_SIGNALS_A}) a) o""",
)
def _(v):
    requests = v("image_flags").join(v("signals").select("trip_id", "ml_risk"), "trip_id")
    return routes.assess_a(requests, v("routes"))


_SIGNALS_B = f"""SELECT j.trip_id, {NORMAL.format(c='j.ml_risk')} AS ml_risk, {IMAGE_B} AS image_risk, m.current_level AS route_risk, m.recommended_route, m.status
FROM ({_JOINED}) j JOIN ({_C}) m ON j.trip_id = m.trip_id"""


@query(
    "trip_assessment_b", "R19", "image_flags signals trips_scored",
    f"""SELECT trip_id, ml_risk, image_risk, route_risk, final_risk, recommended_route, status, final_risk IN ('MEDIUM', 'HIGH') AS alert_required,
  {case('final_risk', risk_rules.ALERT_LEVELS)} AS alert_level, rr AS reroute_required, CASE WHEN rr THEN 'REROUTE' ELSE 'CONTINUE' END AS route_action,
  {case('final_risk', risk_rules.PRIORITIES)} AS priority, {case('final_risk', risk_rules.ALERT_MESSAGES['routing'])} || CASE WHEN rr THEN '{risk_rules.REROUTE_SUFFIX}' ELSE '' END AS message
FROM (SELECT *, {highest('ml_risk', 'image_risk', 'route_risk')} AS final_risk, route_risk = 'HIGH' AND recommended_route IS NOT NULL AS rr FROM ({_SIGNALS_B}) b) o""",
)
def _(v):
    requests = v("image_flags").join(v("signals").select("trip_id", "ml_risk"), "trip_id")
    return routes.assess_b(requests, v("routes"))
