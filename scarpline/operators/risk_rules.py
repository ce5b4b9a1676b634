"""Risk signals, their combination, explanations, alerts and decisions.

All rules are column expressions on a request table; ``ruleset`` arguments
keep the variants that differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scarpline.functions.geo import rounded_key
from scarpline.functions.levels import choose, highest, normal_level
from scarpline.functions.rounding import round_exact
from scarpline.functions.text import strip
from scarpline.operators.skew import skew_join

# Texts and tables that results must carry verbatim.
REASONS = (
    ("ml_risk", "HIGH", "ML environmental prediction indicates high risk."),
    ("ml_risk", "MEDIUM", "ML environmental prediction indicates moderate risk."),
    ("route_risk", "HIGH", "Route analysis indicates a high-risk route."),
    ("route_risk", "MEDIUM", "Route analysis indicates moderate route risk."),
    ("image_risk", "HIGH", "Image analysis detected a high-risk condition."),
    ("image_risk", "MEDIUM", "Image analysis detected a moderate-risk condition."),
)
NO_REASON = "No elevated risk signals were detected."
ALERT_LEVELS = {"HIGH": "CRITICAL", "MEDIUM": "WARNING", "LOW": "INFO"}
ALERT_MESSAGES = {
    "basic": {
        "HIGH": "HIGH RISK detected. Immediate safety attention is recommended.",
        "MEDIUM": "MEDIUM RISK detected. Proceed with caution.",
        "LOW": "LOW RISK detected. No immediate safety alert is required.",
    },
    "routing": {
        "HIGH": "HIGH RISK detected. Immediate safety attention is recommended.",
        "MEDIUM": "MEDIUM RISK detected. Caution is recommended.",
        "LOW": "LOW RISK detected. Conditions are currently safe.",
    },
}
REROUTE_SUFFIX = " Rerouting is recommended."
PRIORITIES = {"HIGH": "IMMEDIATE", "MEDIUM": "HIGH", "LOW": "NORMAL"}
LEVEL_STATUS = {"HIGH": ("HIGH RISK", "WARNING"), "MEDIUM": ("MEDIUM RISK", "CAUTION"), "LOW": ("LOW RISK", "SAFE")}
ENVIRONMENT_FIELDS = (
    "rainfall_mm", "soil_moisture_pct", "slope_deg", "elevation_m",
    "temperature_c", "river_level_m", "vegetation_index", "landslide_history",
)
CENTRE = (11.41, 76.69)
# (upper bound of the distance band, attributes); the last band is open.
ENVIRONMENT_BANDS = (
    (0.08, dict(location_name="Ooty Catchment", rainfall=145.0, temperature=16.5, humidity=89.0, slope=37.0, elevation=2240.0, ndvi=0.43, soil_saturation_pct=86.0)),
    (0.2, dict(location_name="Nilgiris Slope Basin", rainfall=118.0, temperature=19.0, humidity=82.0, slope=31.0, elevation=1850.0, ndvi=0.52, soil_saturation_pct=74.0)),
    (None, dict(location_name="Foothills Transition Zone", rainfall=55.0, temperature=26.0, humidity=68.0, slope=14.0, elevation=620.0, ndvi=0.65, soil_saturation_pct=42.0)),
)
RISK_BANDS = (
    (0.08, dict(location_name="Ooty Valley Escarpment", risk_probability=0.82, risk_level="VERY_HIGH", confidence=0.91)),
    (0.2, dict(location_name="Nilgiris Mountain Corridor", risk_probability=0.68, risk_level="HIGH", confidence=0.87)),
    (0.5, dict(location_name="Lower Ghat Foothills", risk_probability=0.44, risk_level="MODERATE", confidence=0.84)),
    (None, dict(location_name="Regional Plateau", risk_probability=0.21, risk_level="LOW", confidence=0.89)),
)
WET_LATITUDES = (11.35, 11.45)
WET_FACTORS = ("Saturated colluvial regolith on steep slope", "24h cumulative rainfall exceeding 120mm threshold")
DRY_FACTORS = ("Moderate antecedent moisture index",)
COMMON_FACTORS = ("Toe erosion near road embankments", "Historical landslide inventory hotspot")
FEATURE_FACTORS = (
    ("rainfall", ">", 120.0, "24h cumulative rainfall exceeding 120mm threshold"),
    ("slope", ">", 30.0, "Slope gradient exceeding 30 degrees"),
    ("elevation", ">", 2000.0, "High elevation area (>2000m)"),
    ("ndvi", "<", 0.3, "Low vegetation density (NDVI < 0.3)"),
)
NO_FACTOR = "Environmental factors within normal ranges"
FEATURE_DEFAULTS = {"rainfall": 100.0, "slope": 25.0, "elevation": 2240.0, "ndvi": 0.43}


def lookup(level: Column, table: dict) -> Column:
    """Value of a small fixed mapping; NULL for unknown levels."""
    out = None
    for k, value in table.items():
        out = F.when(level == k, value) if out is None else out.when(level == k, value)
    return out


# --- image flags -------------------------------------------------------------

FLAGS = ("landslide", "flooding", "road_damage")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def detected_conditions() -> Column:
    return F.array_compact(F.array(*[F.when(_flag(f), F.lit(f.upper())) for f in FLAGS]))


def image_level(ruleset: str = "A") -> Column:
    """A: flooding alone is HIGH. B: flooding alone is MEDIUM."""
    slide, flood, road = (_flag(f) for f in FLAGS)
    if ruleset == "A":
        return F.when(slide | flood, "HIGH").when(road, "MEDIUM").otherwise("LOW")
    return F.when(slide | (flood & road), "HIGH").when(flood | road, "MEDIUM").otherwise("LOW")


def image_warning(df: DataFrame) -> DataFrame:
    """Rule set A with conditions and the recommended action."""
    level = image_level("A")
    return df.withColumns(
        {
            "detected_conditions": detected_conditions(),
            "warning_level": level,
            "action": lookup(level, {"HIGH": "WARNING", "MEDIUM": "CAUTION", "LOW": "SAFE"}),
            "warning_detected": F.size(detected_conditions()) > 0,
        }
    )


def image_risk(df: DataFrame) -> DataFrame:
    """Rule set B with a score."""
    slide, flood, road = (_flag(f) for f in FLAGS)
    score = F.when(slide, 90).when(flood & road, 80).when(flood | road, 60).otherwise(10)
    return df.withColumns(
        {
            "risk_level": image_level("B"),
            "risk_score": score,
            "detected_conditions": detected_conditions(),
            "condition_count": F.size(detected_conditions()),
        }
    )


# --- combination and explanation ---------------------------------------------


def overall_risk(df: DataFrame, name: str = "overall_risk", signals=("ml_risk", "route_risk", "image_risk")) -> DataFrame:
    """Normalise three signals and take the highest; NULL when any is invalid."""
    normal = df.withColumns({s: normal_level(F.col(s)) for s in signals})
    return normal.withColumn(name, highest(*[F.col(s) for s in signals]))


def invalid_levels(df: DataFrame, column: str) -> DataFrame:
    """Values that cannot be read as a level, with their frequency."""
    bad = df.filter(normal_level(F.col(column)).isNull())
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def explanation(df: DataFrame) -> DataFrame:
    """Add ``reasons`` and a one-line ``summary``."""
    hits = F.array_compact(F.array(*[F.when(F.col(c) == level, F.lit(text)) for c, level, text in REASONS]))
    staged = df.withColumn("_hits", hits)
    reasons = F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.array(F.lit(NO_REASON)))
    out = staged.withColumn("reasons", reasons).drop("_hits")
    text = F.concat(F.lit("Overall risk is "), F.col("overall_risk"), F.lit(". "), F.array_join("reasons", " "))
    return out.withColumn("summary", text)


# --- alerts and decisions ------------------------------------------------------


def alert(df: DataFrame, level: str = "overall_risk", style: str = "basic", reroute: str | None = None) -> DataFrame:
    """Add ``alert_required``, ``alert_level`` and ``message``."""
    risk = F.upper(strip(F.col(level)))
    message = lookup(risk, ALERT_MESSAGES[style])
    if reroute is not None:
        message = F.concat(message, F.when(F.col(reroute), REROUTE_SUFFIX).otherwise(""))
    return df.withColumns(
        {"alert_required": risk.isin("MEDIUM", "HIGH"), "alert_level": lookup(risk, ALERT_LEVELS), "message": message}
    )


def notification(df: DataFrame, keep=(), risk: str = "overall_risk") -> DataFrame:
    """Five-column payload; all alert fields must be present."""
    missing = [c for c in ("alert_required", "alert_level", "message", risk) if c not in df.columns]
    if missing:
        raise ValueError("Missing alert fields: " + ", ".join(missing))
    return df.select(
        *keep, F.lit("SAFETY_ALERT").alias("type"), F.col("alert_level").alias("level"), F.col(risk).alias("risk"),
        "message", F.col("alert_required").alias("display"),
    )


def decision(df: DataFrame, final: str = "final_risk", route: str = "route_risk", safer: str = "safer_route_available") -> DataFrame:
    level = F.upper(F.col(final))
    reroute = (F.upper(F.col(route)) == "HIGH") & F.col(safer)
    return df.withColumns(
        {
            "alert_required": level.isin("MEDIUM", "HIGH"),
            "alert_level": lookup(level, ALERT_LEVELS),
            "reroute_required": reroute,
            "route_action": F.when(reroute, "REROUTE").otherwise("CONTINUE"),
            "priority": lookup(level, PRIORITIES),
        }
    )


def confidence_band(df: DataFrame, level: str = "risk_level", confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    bands = F.when(c >= 0.80, "HIGH CONFIDENCE").when(c >= 0.60, "MODERATE CONFIDENCE").otherwise("LOW CONFIDENCE")
    return df.withColumns(
        {
            "status": lookup(F.col(level), {k: s for k, (s, _) in LEVEL_STATUS.items()}),
            "action": lookup(F.col(level), {k: a for k, (_, a) in LEVEL_STATUS.items()}),
            "confidence_level": bands,
        }
    )


# --- environment and location rules --------------------------------------------


def environment_fields(df: DataFrame, keep=()) -> DataFrame:
    missing = [c for c in ENVIRONMENT_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing environmental fields: {', '.join(missing)}")
    return df.select(*keep, *ENVIRONMENT_FIELDS)


def centre_distance() -> Column:
    return F.abs(F.col("latitude") - CENTRE[0]) + F.abs(F.col("longitude") - CENTRE[1])


def by_band(distance: Column, bands, field: str) -> Column:
    """Attribute of the first band whose upper bound exceeds the distance."""
    *bounded, (_, last) = bands
    return choose([(distance < F.lit(limit), F.lit(attributes[field])) for limit, attributes in bounded], F.lit(last[field]))


def environment_at(points: DataFrame) -> DataFrame:
    d = F.col("_d")
    staged = points.withColumn("_d", centre_distance())
    return staged.withColumns({f: by_band(d, ENVIRONMENT_BANDS, f) for f in ENVIRONMENT_BANDS[0][1]}).drop("_d")


def location_factors() -> Column:
    wet = F.col("latitude").between(*WET_LATITUDES)
    texts = lambda *t: F.array(*[F.lit(x) for x in t])
    return F.when(wet, texts(*WET_FACTORS, *COMMON_FACTORS)).otherwise(texts(*DRY_FACTORS, *COMMON_FACTORS))


def risk_at(points: DataFrame) -> DataFrame:
    d = F.col("_d")
    staged = points.withColumn("_d", centre_distance())
    out = {f: by_band(d, RISK_BANDS, f) for f in RISK_BANDS[0][1]}
    return staged.withColumns({**out, "factors": location_factors()}).drop("_d")


def score_coordinates(requests: DataFrame, scorer=risk_at, ordinal: str = "ordinal") -> DataFrame:
    """Score each distinct 4-decimal coordinate once and answer every item.

    The first item of a key is the one that is scored. The answer goes back
    to all items by a join that spreads very frequent coordinates.
    """
    keys = ["lat_key", "lon_key"]
    keyed = requests.select("*", *rounded_key(F.col("latitude"), F.col("longitude")))
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct("latitude", "longitude"), F.col(ordinal)).alias("p"))
    scored = scorer(first.select(*keys, "p.latitude", "p.longitude")).drop("latitude", "longitude")
    return skew_join(keyed, scored, keys, row_id=[ordinal])


def request_check(requests: DataFrame, low: int = 1, high: int = 100) -> DataFrame:
    """Size and coordinate limits per batch request."""
    valid = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    grouped = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(~valid).alias("invalid_items"))
    return grouped.withColumn("accepted", F.col("items").between(low, high) & (F.col("invalid_items") == 0))


def heuristic_probability(df: DataFrame) -> DataFrame:
    """Fallback score from rainfall and slope; absent features take defaults."""
    rain = F.coalesce("rainfall", F.lit(FEATURE_DEFAULTS["rainfall"]))
    slope = F.coalesce("slope", F.lit(FEATURE_DEFAULTS["slope"]))
    score = rain / 200.0 * 0.6 + slope / 60.0 * 0.4
    staged = df.withColumn("_score", score)
    return staged.withColumn("risk_probability", F.least(F.greatest(round_exact(F.col("_score"), 2), F.lit(0.05)), F.lit(0.98))).drop("_score")


def feature_factors(df: DataFrame) -> DataFrame:
    tests = []
    for name, op, limit, text in FEATURE_FACTORS:
        c = F.coalesce(name, F.lit(FEATURE_DEFAULTS[name]))
        tests.append(F.when(c > limit if op == ">" else c < limit, F.lit(text)))
    staged = df.withColumn("_hits", F.array_compact(F.array(*tests)))
    return staged.withColumn("factors", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.array(F.lit(NO_FACTOR)))).drop("_hits")


def nested_level(body: Column) -> Column:
    """First of risk_level, final_risk, risk, risk.risk_level, risk.final_risk.

    Plain (non-JSON) text is itself the level. NULL when nothing is found.
    """
    at = lambda path: F.get_json_object(body, path)
    risk = at("$.risk")
    plain = F.when(~F.ltrim(body).startswith("{"), body)
    text_risk = F.when(~F.ltrim(risk).startswith("{"), risk)
    found = F.coalesce(plain, at("$.risk_level"), at("$.final_risk"), text_risk, at("$.risk.risk_level"), at("$.risk.final_risk"))
    return F.upper(found)
