"""Point layers, raster sampling, extents, terrain and proximity."""

from pyspark.sql import functions as F

from scarpline.operators import cleaning, spatial
from scarpline.plans import flagship
from scarpline.plans.registry import check_view, query
from scarpline.sources import catalog, geojson

G = spatial.DEMO_GRID
_LAT, _LON = "TRY_CAST(latitude AS DOUBLE)", "TRY_CAST(longitude AS DOUBLE)"
_REASON = f"""CASE WHEN latitude IS NULL OR trim(latitude) = '' THEN 'missing_latitude' WHEN longitude IS NULL OR trim(longitude) = '' THEN 'missing_longitude'
  WHEN {_LAT} IS NULL OR {_LON} IS NULL THEN 'non_numeric' WHEN {_LAT} NOT BETWEEN -90 AND 90 THEN 'invalid_latitude'
  WHEN {_LON} NOT BETWEEN -180 AND 180 THEN 'invalid_longitude' END"""

check_view("points", "incidents", f"SELECT * REPLACE ({_LAT} AS latitude, {_LON} AS longitude, trim(landslide_id) AS landslide_id) FROM incidents WHERE {_REASON} IS NULL")
check_view(
    "cells_wide", "raster_cells",
    "SELECT row, col, " + ", ".join(f"max(value) FILTER (WHERE layer = '{x}') AS {x}" for x in spatial.LAYER_COLUMNS) + " FROM raster_cells GROUP BY row, col",
)


def _status(layer: str) -> str:
    return (
        f"CASE WHEN NOT (r BETWEEN 0 AND {G.height - 1} AND c BETWEEN 0 AND {G.width - 1}) THEN 'OUTSIDE_RASTER' "
        f"WHEN w.{layer} IS NULL THEN 'ERROR' WHEN w.{layer} = {G.nodata} THEN 'NODATA' ELSE 'EXTRACTED' END AS {layer}_status"
    )


check_view(
    "sampled", "points cells_wide",
    f"""
SELECT p.* EXCLUDE (r, c), {', '.join(f'CASE WHEN w.{x} <> {G.nodata} THEN w.{x} END AS {col}, {_status(x)}' for x, col in spatial.LAYER_COLUMNS.items())}
FROM (SELECT *, CAST(floor((CAST({G.max_y!r} AS DOUBLE) - latitude) / CAST({G.pixel!r} AS DOUBLE)) AS INT) AS r,
        CAST(floor((longitude - CAST({G.min_x!r} AS DOUBLE)) / CAST({G.pixel!r} AS DOUBLE)) AS INT) AS c FROM points) p
LEFT JOIN cells_wide w ON p.r = w.row AND p.c = w.col
""",
)
_STATUSES = [f"{x}_status" for x in spatial.LAYER_COLUMNS]
_EXTRACTED = " + ".join(f"CASE WHEN {s} = 'EXTRACTED' THEN 1 ELSE 0 END" for s in _STATUSES)
check_view(
    "features", "sampled",
    f"""
SELECT *, CAST(NULL AS DOUBLE) AS rainfall_24h, CAST(NULL AS DOUBLE) AS rainfall_3d, CAST(NULL AS DOUBLE) AS rainfall_7d, 'NOT_SPATIALLY_MAPPABLE' AS rainfall_status,
  CASE WHEN {_EXTRACTED} = 4 THEN 'COMPLETE' WHEN {_EXTRACTED} > 0 THEN 'PARTIAL' ELSE 'NO_FEATURES' END AS feature_extraction_status,
  CASE WHEN ordinal % 50 = 7 THEN 'REAL' ELSE 'SYNTHETIC_DEMO' END AS data_source_type
FROM sampled
""",
)


def points(v):
    return spatial.point_layer(cleaning.trim_ids(v("incidents")).drop("id_changed"))


def features(v):
    """Feature table whose provenance marker differs for a few records."""
    tag = F.when(F.col("ordinal") % 50 == 7, "REAL").otherwise("SYNTHETIC_DEMO")
    return spatial.feature_table(points(v), v("raster_cells"), G, tag)


@query(
    "feature_status_by_level", "G4 G8 R1", "features",
    """SELECT feature_extraction_status, risk_level, count(*) AS points, round(avg(elevation_m), 6) AS mean_elevation_m FROM (
  SELECT *, CASE WHEN slope_deg IS NULL THEN 'UNKNOWN' WHEN least(100, slope_deg * 2) >= 70 THEN 'HIGH' WHEN least(100, slope_deg * 2) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM features) t
GROUP BY 1, 2""",
)
def _(v):
    return flagship.status_by_level(v)


@query("point_layer", "G1", "points", "SELECT ordinal, landslide_id, 'Point' AS geometry_type, longitude AS x, latitude AS y FROM points")
def _(v):
    xy = F.col("geometry.coordinates")
    return points(v).select("ordinal", "landslide_id", F.col("geometry.type").alias("geometry_type"), xy[0].alias("x"), xy[1].alias("y"))


@query(
    "point_exclusions", "G2", "cleaned",
    f"""SELECT count(*) AS total_input_records, count(*) FILTER (WHERE reason IS NULL) AS valid_coordinate_records,
  count(*) FILTER (WHERE reason = 'missing_latitude') AS missing_latitude, count(*) FILTER (WHERE reason = 'missing_longitude') AS missing_longitude,
  count(*) FILTER (WHERE reason IN ('invalid_latitude', 'non_numeric')) AS invalid_latitude, count(*) FILTER (WHERE reason IN ('invalid_longitude', 'non_numeric')) AS invalid_longitude,
  count(*) FILTER (WHERE reason IS NOT NULL) AS records_excluded, CAST(0 AS BIGINT) AS review_required_count
FROM (SELECT {_REASON} AS reason FROM incidents) t""",
)
def _(v):
    return spatial.exclusion_counts(v("incidents"))


@query(
    "coordinate_order_check", "G3", "points",
    """SELECT count(*) FILTER (WHERE longitude NOT BETWEEN -180 AND 180) AS bad_x, count(*) FILTER (WHERE latitude NOT BETWEEN -90 AND 90) AS bad_y,
  CAST(0 AS BIGINT) AS not_point, 0 AS bad_crs FROM points""",
)
def _(v):
    return spatial.coordinate_order_check(points(v))


_VALUES = ", ".join(spatial.LAYER_COLUMNS.values())


@query("raster_point_samples", "G4", "features", f"SELECT ordinal, {_VALUES} FROM features")
def _(v):
    return features(v).select("ordinal", *spatial.LAYER_COLUMNS.values())


@query("extraction_statuses", "G5", "features", f"SELECT ordinal, {', '.join(_STATUSES)} FROM features")
def _(v):
    return features(v).select("ordinal", *_STATUSES)


@query(
    "rainfall_placeholder", "G6", "features",
    "SELECT ordinal, rainfall_24h, rainfall_3d, rainfall_7d, rainfall_status FROM features",
)
def _(v):
    return features(v).select("ordinal", "rainfall_24h", "rainfall_3d", "rainfall_7d", "rainfall_status")


@query(
    "provenance_tag", "G7", "sidecars",
    "SELECT CASE WHEN bool_or(status = 'SYNTHETIC_DEMO_DATA') THEN 'SYNTHETIC_DEMO' ELSE 'REAL' END AS data_source_type FROM sidecars",
)
def _(v):
    return spatial.provenance(v("sidecars"))


@query("overall_extraction_status", "G8", "features", "SELECT ordinal, feature_extraction_status FROM features")
def _(v):
    return features(v).select("ordinal", "feature_extraction_status")


_SUMMARY = [*_STATUSES, "rainfall_status", "feature_extraction_status", "data_source_type"]


@query(
    "extraction_summary", "G9", "features",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS status, count(*) AS n FROM features GROUP BY {m}" for m in _SUMMARY),
)
def _(v):
    return spatial.extraction_summary(features(v))


@query(
    "dataset_extent", "G10", "incidents",
    f"""SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM (SELECT {_LON} AS x, {_LAT} AS y FROM incidents) t
WHERE x IS NOT NULL AND y IS NOT NULL""",
)
def _(v):
    return spatial.table_extent(v("incidents").select("longitude", "latitude"))


check_view("descriptors", "datasets", "SELECT *, replace(replace(path, '/', '_'), '.', '_') AS dataset_id FROM datasets")


@query(
    "crs_compatibility", "G11", "descriptors",
    """SELECT dataset_id, CASE WHEN NOT has_error THEN crs END AS original_crs, CASE WHEN crs IS NOT NULL AND NOT has_error THEN 'EPSG:4326' END AS integration_crs,
  coalesce(crs <> 'EPSG:4326' AND NOT has_error, false) AS needs_reprojection FROM descriptors""",
)
def _(v):
    return spatial.crs_compatibility(catalog.with_dataset_id(v("datasets")))


_EXTENT = """SELECT boxes, CASE WHEN boxes < 2 THEN 'insufficient_data' WHEN x0 < x1 AND y0 < y1 THEN 'YES' ELSE 'NO' END AS overlap, x0, y0, x1, y1
FROM (SELECT count(*) AS boxes, max(min_x) AS x0, max(min_y) AS y0, min(max_x) AS x1, min(max_y) AS y1 FROM datasets WHERE min_x IS NOT NULL AND NOT has_error) t"""


@query(
    "common_extent", "G12", "datasets",
    f"""SELECT boxes, overlap, CASE WHEN overlap = 'YES' THEN x0 END AS min_x, CASE WHEN overlap = 'YES' THEN y0 END AS min_y,
  CASE WHEN overlap = 'YES' THEN x1 END AS max_x, CASE WHEN overlap = 'YES' THEN y1 END AS max_y, CASE WHEN overlap = 'YES' THEN (x1 - x0) * (y1 - y0) END AS area FROM ({_EXTENT}) e""",
)
def _(v):
    return spatial.common_extent(v("datasets"))


@query(
    "integration_status", "G13", "datasets",
    f"""SELECT any_error, overlap, CASE WHEN any_error THEN 'BLOCKED' WHEN overlap = 'NO' THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status
FROM (SELECT bool_or(has_error) AS any_error FROM datasets) a, ({_EXTENT}) e""",
)
def _(v):
    return spatial.integration_status(v("datasets"))


@query(
    "raster_window_stats", "G14", "terrain_cells",
    """SELECT round(min(value), 6) AS sample_min, round(max(value), 6) AS sample_max, round(avg(value), 6) AS sample_mean
FROM terrain_cells WHERE row < 100 AND col < 100 AND value <> -9999""",
)
def _(v):
    out = spatial.window_stats(v("terrain_cells"), [])
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


_STEP_Y = 0.005 * 111000.0


def _diff(w: str, along: str, step: str) -> str:
    p, q = f"lag(value) OVER {w}", f"lead(value) OVER {w}"
    return f"""CASE WHEN lag({along}) OVER {w} = {along} - 1 AND lead({along}) OVER {w} = {along} + 1 THEN ({q} - {p}) / (2 * {step})
      WHEN lead({along}) OVER {w} = {along} + 1 THEN ({q} - value) / {step} WHEN lag({along}) OVER {w} = {along} - 1 THEN (value - {p}) / {step} END"""


@query(
    "terrain_slope_aspect", "G15", "terrain_cells",
    f"""SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg,
  round(CASE WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 6) AS aspect_deg
FROM (SELECT row, col, {_diff('wc', 'col', f'({_STEP_Y!r} * cos(radians(27.7)))')} AS dx, {_diff('wr', 'row', repr(_STEP_Y))} AS dy
      FROM terrain_cells WINDOW wc AS (PARTITION BY row ORDER BY col), wr AS (PARTITION BY col ORDER BY row)) t""",
)
def _(v):
    out = spatial.terrain(v("terrain_cells"))
    return out.select("row", "col", F.round("slope_deg", 6).alias("slope_deg"), F.round("aspect_deg", 6).alias("aspect_deg"))


@query(
    "formula_raster", "G16", "terrain_cells",
    """SELECT row, col, layer, CASE layer WHEN 'elevation' THEN CAST(500 + (ij * 10) % 3500 AS DOUBLE) WHEN 'slope' THEN CAST((ij * 5) % 450 AS DOUBLE) / CAST(10 AS DOUBLE)
  WHEN 'aspect' THEN CAST((ij * 5) % 360 AS DOUBLE) ELSE CAST(ij % 150 - 50 AS DOUBLE) / CAST(100 AS DOUBLE) END AS value
FROM (SELECT row, col, CAST(row AS BIGINT) * col AS ij FROM terrain_cells) c,
  (SELECT 'ndvi' AS layer UNION ALL SELECT 'elevation' UNION ALL SELECT 'slope' UNION ALL SELECT 'aspect') l""",
)
def _(v):
    return spatial.formula_layers(v("terrain_cells"))


@query(
    "distinct_grid_keys", "G17", "coordinates",
    "SELECT lat_key, lon_key, count(*) AS n FROM (SELECT CAST(printf('%.4f', latitude) AS DOUBLE) AS lat_key, CAST(printf('%.4f', longitude) AS DOUBLE) AS lon_key FROM coordinates) t GROUP BY 1, 2",
)
def _(v):
    return spatial.grid_keys(v("coordinates"))


_DIST = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(z.latitude - w.latitude) / 2), 2)
  + cos(radians(w.latitude)) * cos(radians(z.latitude)) * pow(sin(radians(z.longitude - w.longitude) / 2), 2))))"""


@query(
    "zone_crossings", "G18", "waypoints risk_zones",
    f"SELECT DISTINCT w.trip_id, z.zone_id FROM waypoints w, risk_zones z WHERE {_DIST} <= z.radius_meters",
)
def _(v):
    return spatial.zone_crossings(v("waypoints"), v("risk_zones"))


@query(
    "zone_crossings_per_trip", "G18", "waypoints risk_zones",
    f"""+x AS (SELECT DISTINCT w.trip_id, z.zone_id FROM waypoints w, risk_zones z WHERE {_DIST} <= z.radius_meters)
SELECT t.trip_id, count(x.zone_id) AS zones_crossed FROM (SELECT DISTINCT trip_id FROM waypoints) t LEFT JOIN x ON t.trip_id = x.trip_id GROUP BY t.trip_id""",
)
def _(v):
    return spatial.crossings_per_trip(v("waypoints"), v("risk_zones"))


@query(
    "polygon_crossings", "G18", "waypoints zone_polygons",
    """SELECT DISTINCT w.trip_id, z.zone_id FROM waypoints w, zone_polygons z
WHERE w.latitude > z.latitude - 0.0078125 AND w.latitude < z.latitude + 0.015625
  AND abs(w.longitude - z.longitude) < 0.0078125 * (z.latitude + 0.015625 - w.latitude) / 0.0234375""",
)
def _(v):
    polygons = v("zone_polygons").select("zone_id", geojson.polygon_rings(F.col("polygon")).alias("rings"))
    return spatial.polygon_hits(v("waypoints"), polygons)


check_view(
    "way_legs", "waypoints",
    """SELECT trip_id, ordinal, latitude AS lat1, longitude AS lon1, coalesce(lead(latitude) OVER t, latitude) AS lat2, coalesce(lead(longitude) OVER t, longitude) AS lon2
FROM waypoints WINDOW t AS (PARTITION BY trip_id ORDER BY ordinal)""",
)
_TO = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat} - z_lat) / 2), 2)
  + cos(radians(z_lat)) * cos(radians({lat})) * pow(sin(radians({lon} - z_lon) / 2), 2))))"""
_NEAREST = f"""least({_TO.format(lat='lat1 + t * (lat2 - lat1)', lon='lon1 + t * (lon2 - lon1)')}, {_TO.format(lat='lat1', lon='lon1')}, {_TO.format(lat='lat2', lon='lon2')})"""


@query(
    "route_zone_crossings", "G18", "way_legs risk_zones",
    f"""+p AS (SELECT w.*, zone_id, z.latitude AS z_lat, z.longitude AS z_lon, radius_meters, cos(radians(z.latitude)) AS f FROM way_legs w, risk_zones z
  WHERE greatest(lat1, lat2) >= z.latitude - radius_meters / 110000 AND least(lat1, lat2) <= z.latitude + radius_meters / 110000
    AND greatest(lon1, lon2) >= z.longitude - 1.1 * radius_meters / 110000 AND least(lon1, lon2) <= z.longitude + 1.1 * radius_meters / 110000),
q AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((z_lon - lon1) * f * ((lon2 - lon1) * f) + (z_lat - lat1) * (lat2 - lat1))
  / nullif(((lon2 - lon1) * f) * ((lon2 - lon1) * f) + (lat2 - lat1) * (lat2 - lat1), 0))), 0) AS t FROM p)
SELECT DISTINCT trip_id, zone_id FROM q WHERE {_NEAREST} <= radius_meters""",
)
def _(v):
    return spatial.route_crossings(v("waypoints"), v("risk_zones"))


def _ring_sql(ring: int, corners: list[tuple[str, str]]) -> str:
    ends = list(zip(corners, corners[1:] + corners[:1]))
    return " UNION ALL ".join(
        f"SELECT zone_id, {ring} AS ring, longitude + {a} AS x3, latitude + {b} AS y3, longitude + {c} AS x4, latitude + {d} AS y4 FROM zone_shapes" for (a, b), (c, d) in ends
    )


def _turn(a: str, b: str, c: str) -> str:
    return f"sign((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"


_H = "CAST({} AS DOUBLE)"
_OUT = [(_H.format(a), _H.format(b)) for a, b in ((-0.0078125, -0.0078125), (0.0078125, -0.0078125), (0, 0.015625))]
_HOLE = [(_H.format(a), _H.format(b)) for a, b in ((-0.001953125, -0.001953125), (0.001953125, -0.001953125), (0, 0.00390625))]


@query(
    "route_polygon_crossings", "G18", "way_legs zone_shapes",
    f"""+e AS ({_ring_sql(0, _OUT)} UNION ALL {_ring_sql(1, _HOLE)}),
l AS (SELECT trip_id, ordinal, lon1 AS x1, lat1 AS y1, lon2 AS x2, lat2 AS y2 FROM way_legs),
c AS (SELECT l.*, z.zone_id FROM l, zone_shapes z WHERE greatest(x1, x2) >= z.longitude - 0.0078125 AND least(x1, x2) <= z.longitude + 0.0078125
  AND greatest(y1, y2) >= z.latitude - 0.0078125 AND least(y1, y2) <= z.latitude + 0.015625),
m AS (SELECT trip_id, zone_id, ordinal, count(*) FILTER (WHERE (y3 > y1) <> (y4 > y1) AND x1 < (x4 - x3) * (y1 - y3) / nullif(y4 - y3, 0) + x3) AS inside,
  count(*) FILTER (WHERE greatest(x1, x2) >= least(x3, x4) AND greatest(x3, x4) >= least(x1, x2) AND greatest(y1, y2) >= least(y3, y4) AND greatest(y3, y4) >= least(y1, y2)
    AND {_turn('3', '4', '1')} * {_turn('3', '4', '2')} <= 0 AND {_turn('1', '2', '3')} * {_turn('1', '2', '4')} <= 0) AS met
  FROM c JOIN e USING (zone_id) GROUP BY ALL)
SELECT DISTINCT trip_id, zone_id FROM m WHERE inside % 2 = 1 OR met > 0""",
)
def _(v):
    polygons = v("zone_shapes").select("zone_id", geojson.polygon_rings(F.col("polygon")).alias("rings"))
    return spatial.route_polygon_crossings(v("waypoints"), polygons)


@query(
    "route_zones_per_trip", "G18", "way_legs risk_zones",
    f"""+p AS (SELECT w.*, zone_id, z.latitude AS z_lat, z.longitude AS z_lon, radius_meters, cos(radians(z.latitude)) AS f FROM way_legs w, risk_zones z
  WHERE greatest(lat1, lat2) >= z.latitude - radius_meters / 110000 AND least(lat1, lat2) <= z.latitude + radius_meters / 110000),
q AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((z_lon - lon1) * f * ((lon2 - lon1) * f) + (z_lat - lat1) * (lat2 - lat1))
  / nullif(((lon2 - lon1) * f) * ((lon2 - lon1) * f) + (lat2 - lat1) * (lat2 - lat1), 0))), 0) AS t FROM p),
x AS (SELECT DISTINCT trip_id, zone_id FROM q WHERE {_NEAREST} <= radius_meters)
SELECT t.trip_id, count(x.zone_id) AS zones_crossed FROM (SELECT DISTINCT trip_id FROM waypoints) t LEFT JOIN x ON t.trip_id = x.trip_id GROUP BY t.trip_id""",
)
def _(v):
    return spatial.crossings_per_trip(v("waypoints"), v("risk_zones"), whole_way=True)


@query(
    "near_preset_points", "G19", "waypoints risk_zones",
    """SELECT w.trip_id, w.ordinal, z.zone_id AS preset_id FROM waypoints w, risk_zones z
WHERE abs(w.latitude - z.latitude) < 0.005 AND abs(w.longitude - z.longitude) < 0.005""",
)
def _(v):
    presets = v("risk_zones").withColumnRenamed("zone_id", "preset_id")
    return spatial.near_presets(v("waypoints"), presets).select("trip_id", "ordinal", "preset_id")
