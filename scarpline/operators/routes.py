"""Route rules per trip: (trip_id, ordinal, route, distance, risk, is_current).

A trip has a handful of routes, and everything about it is one grouped
aggregate: the safest route is ``min_by`` over (risk, ordinal), so ties go to
the route listed first and no self-join or window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scarpline.functions.levels import open_score_level, score_level
from scarpline.operators import risk_rules
from scarpline.operators.skew import add_totals

# Texts and cut points.
RECOMMENDATIONS = ((40.0, "SAFE ROUTE", "PROCEED"), (70.0, "USE WITH CAUTION", "CAUTION"), (None, "AVOID IF POSSIBLE", "WARNING"))
REROUTE, STAY, NO_REROUTE = "REROUTE RECOMMENDED", "STAY ON CURRENT ROUTE", "NO REROUTE REQUIRED"
REASONS = {
    "calm": "Current route is not high risk.",
    "stuck": "No safe alternative route available.",
    "moved": "Current route is high risk.",
}
SAFE_BELOW = 70.0


def classify(routes: DataFrame) -> DataFrame:
    """Add ``risk_level``; NULL marks a score outside 0..100."""
    return routes.withColumn("risk_level", score_level(F.col("risk")))


def computed_score(km: Column, environmental: Column) -> Column:
    """min(100, round(0.8 * environment + min(2 * km, 20))), half to even."""
    valid = (km >= 0) & environmental.between(0, 100)
    score = F.least(F.lit(100.0), F.bround(environmental * 0.8 + F.least(km * 2, F.lit(20.0)), 0))
    return F.when(valid, score)


def with_computed_risk(routes: DataFrame) -> DataFrame:
    """Replace the environmental risk by the computed route score and level."""
    score = computed_score(F.col("distance"), F.col("risk"))
    return routes.withColumn("risk_score", score).withColumn("risk_level", open_score_level(F.col("risk_score")))


def recommendation(routes: DataFrame) -> DataFrame:
    r = F.col("risk")
    (a, *ra), (b, *rb), (_, *rc) = RECOMMENDATIONS
    pick = lambda i: F.when(r < a, ra[i]).when(r < b, rb[i]).otherwise(rc[i])
    return routes.withColumns({"recommendation": pick(0), "status": pick(1)})


def _first(value: Column, risk: Column, condition: Column | None = None) -> Column:
    order = F.struct(risk, F.col("ordinal"))
    return F.min_by(value, order if condition is None else F.when(condition, order))


def trips(routes: DataFrame, risk: str = "risk") -> DataFrame:
    """One row per trip: current route, safest route and safest alternative."""
    r = F.col(risk)
    route = F.struct(F.col("route").alias("route"), r.alias("risk"), F.col("distance").alias("distance"))
    base = routes.groupBy("trip_id").agg(
        F.min_by(route, F.when(F.col("is_current"), F.col("ordinal"))).alias("current"),
        _first(route, r).alias("safest"),
        _first(route, r, ~F.col("is_current")).alias("other"),
        _first(route, r, r < SAFE_BELOW).alias("safe"),
    )
    better = F.col("other.risk") < F.col("current.risk")
    # The cheapest other route is strictly lower whenever any other route is.
    return base.withColumn("alternative", F.when(better, F.col("other"))).drop("other")


def safest(routes: DataFrame) -> DataFrame:
    t = trips(routes)
    return t.select(
        "trip_id",
        F.col("safest.route").alias("safest_route"), F.col("safest.risk").alias("safest_risk"),
        score_level(F.col("safest.risk")).alias("safest_level"), F.col("safest.distance").alias("safest_distance"),
    )


def categories(routes: DataFrame) -> DataFrame:
    """The category of every route, as rows: a projection without a shuffle."""
    level = score_level(F.col("risk"), middle="MODERATE")
    names = {"LOW": "safe_routes", "MODERATE": "moderate_routes", "HIGH": "risky_routes"}
    return routes.select("trip_id", risk_rules.lookup(level, names).alias("category"), "ordinal", "route")


def category_sizes(routes: DataFrame) -> DataFrame:
    grouped = categories(routes).groupBy("trip_id")
    return grouped.agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("safe_routes", "moderate_routes", "risky_routes")])


def alternatives(routes: DataFrame) -> DataFrame:
    """Routes with strictly lower risk than the trip's current one, as rows.

    Facts of the trip are attached by the skew-aware aggregate join, so a trip
    with very many routes is never gathered in one task.
    """
    order = F.struct("risk", "ordinal")
    facts = [
        F.max(F.when(F.col("is_current"), F.col("risk"))).alias("current_risk"),
        F.max(F.when(F.col("is_current"), F.col("route"))).alias("current_route"),
        F.min(F.when(~F.col("is_current"), order)).alias("_best"),
    ]
    lower = add_totals(routes, ["trip_id"], facts).filter(~F.col("is_current") & (F.col("risk") < F.col("current_risk")))
    return lower.select(
        "trip_id", "current_route", "current_risk", F.col("route").alias("alternative_route"), "risk",
        (F.col("ordinal") == F.col("_best.ordinal")).alias("is_safest"),
    )


def reroute(routes: DataFrame, ruleset: str, risk: str = "risk") -> DataFrame:
    """Reroute decision per trip.

    A: current HIGH, take the safest route below 70, else none.
    B: current HIGH and a strictly lower route exists, else stay.
    C: as B, but no recommendation when nothing changes.
    """
    t = trips(routes, risk)
    level = open_score_level(F.col("current.risk"))
    high = level == "HIGH"
    current, safe, alternative = F.col("current.route"), F.col("safe.route"), F.col("alternative.route")
    if ruleset == "A":
        moved = high & safe.isNotNull()
        return t.select(
            "trip_id", current.alias("current_route"), moved.alias("rerouted"),
            F.when(~high, current).otherwise(safe).alias("recommended_route"),
            F.when(~high, REASONS["calm"]).when(safe.isNull(), REASONS["stuck"]).otherwise(REASONS["moved"]).alias("reason"),
        )
    moved = high & alternative.isNotNull()
    stay, status = (current, STAY) if ruleset == "B" else (F.lit(None).cast("string"), NO_REROUTE)
    return t.select(
        "trip_id", current.alias("current_route"), F.col("current.risk").alias("current_risk"), level.alias("current_level"),
        moved.alias("rerouted"), F.when(moved, alternative).otherwise(stay).alias("recommended_route"),
        F.when(moved, REROUTE).otherwise(status).alias("status"),
    )


def comparison(routes: DataFrame) -> DataFrame:
    """Safest route against the shortest other one: extra length, less exposure."""
    route = F.struct("route", "risk", "distance", "ordinal")
    tagged = add_totals(routes, ["trip_id"], [_first(route, F.col("risk")).alias("r")])
    other = F.when(F.col("ordinal") != F.col("r.ordinal"), F.struct("distance", "ordinal"))
    s = tagged.groupBy("trip_id").agg(F.any_value("r").alias("r"), F.min_by(route, other).alias("o"))
    longer = (F.col("r.distance") - F.col("o.distance")) / F.col("o.distance") * 100.0
    less = F.when(F.col("o.risk") > 0, (F.col("o.risk") - F.col("r.risk")) / F.col("o.risk") * 100.0)
    return s.select(
        "trip_id", F.col("r.route").alias("recommended_route"), F.col("o.route").alias("alternative_route"),
        longer.alias("longer_pct"), less.alias("less_exposure_pct"),
    )


# --- whole assessments ---------------------------------------------------------


def assess_a(trips_table: DataFrame, routes: DataFrame) -> DataFrame:
    """Signals, explanation, reroute (B), alert and notification per trip.

    ``trips_table``: trip_id, ml_risk and the image flags. Trips are unique on
    both sides of the join.
    """
    moves = reroute(routes, "B")
    joined = trips_table.join(moves, "trip_id")
    rated = joined.withColumns({"image_risk": risk_rules.image_level("A"), "route_risk": score_level(F.col("current_risk"))})
    explained = risk_rules.explanation(risk_rules.overall_risk(rated))
    alerted = risk_rules.alert(explained)
    return alerted.select(
        "trip_id", "ml_risk", "route_risk", "image_risk", "overall_risk", "summary", "recommended_route", "rerouted",
        F.lit("SAFETY_ALERT").alias("type"), "alert_level", "message", F.col("alert_required").alias("display"),
    )


def assess_b(trips_table: DataFrame, routes: DataFrame) -> DataFrame:
    """Computed route scores, image rule B, reroute (C), decision and alert."""
    moves = reroute(with_computed_risk(routes), "C", risk="risk_score")
    joined = trips_table.join(moves, "trip_id")
    rated = joined.withColumns(
        {
            "ml_risk": F.upper("ml_risk"),
            "image_risk": risk_rules.image_level("B"),
            "route_risk": F.col("current_level"),
            "safer_route_available": F.col("recommended_route").isNotNull(),
        }
    )
    final = risk_rules.overall_risk(rated, name="final_risk")
    decided = risk_rules.decision(final)
    alerted = risk_rules.alert(decided, level="final_risk", style="routing", reroute="reroute_required")
    return alerted.select(
        "trip_id", "ml_risk", "image_risk", "route_risk", "final_risk", "recommended_route", "status",
        "alert_required", "alert_level", "reroute_required", "route_action", "priority", "message",
    )
