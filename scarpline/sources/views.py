"""Hazard views computed from the base tables.

The base tables hold no hazard data, so every registered query runs on one of
these views. A view is one SQL text that Spark and DuckDB both accept; base
tables appear as ``{name}`` and other views by their name. All of them are
row-wise projections of a base table, so they grow with it and columns prune
and filters push down to the parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["incidents"] = """
SELECT o_orderkey AS ordinal,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL
       WHEN o_orderkey % 23 = 0 THEN concat('LS-', CAST(o_orderkey - 1 AS STRING))
       ELSE concat(' LS-', CAST(o_orderkey AS STRING), ' ') END AS landslide_id,
  CASE WHEN o_orderkey % 37 = 0 THEN '2020-13-01' WHEN o_orderkey % 43 = 0 THEN NULL
       WHEN k % 5 = 0 THEN concat(y, '/', m, '/', d) WHEN k % 5 = 1 THEN concat(d, '-', m, '-', y)
       WHEN k % 5 = 2 THEN concat(m, '/', d, '/', y) WHEN k % 5 = 3 THEN concat(d, '/', m, '/', y)
       ELSE concat(y, '-', m, '-', d) END AS date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '123.4' WHEN o_orderkey % 29 = 0 THEN 'abc'
       ELSE CAST(CAST(2057260 + (k * 7919) % 1174390 AS DOUBLE) / CAST(100000 AS DOUBLE) AS STRING) END AS latitude,
  CASE WHEN o_orderkey % 47 = 0 THEN '  ' WHEN o_orderkey % 53 = 0 THEN '-200'
       ELSE CAST(CAST(7603220 + (k * 6007) % 1433170 AS DOUBLE) / CAST(100000 AS DOUBLE) AS STRING) END AS longitude,
  concat('  Site   ', CAST(k % 97 AS STRING), ' ') AS location,
  CASE WHEN k % 9 = 0 THEN NULL ELSE concat('District ', CAST(k % 12 AS STRING)) END AS district,
  concat('State ', CAST(k % 5 AS STRING)) AS state, 'Country' AS country, 'Archive' AS source,
  concat('https://example.com/', CAST(k AS STRING)) AS source_url,
  CASE WHEN k % 4 = 0 THEN 'Low' WHEN k % 4 = 1 THEN 'Medium' WHEN k % 4 = 2 THEN 'High' END AS severity,
  'Generated record' AS description
FROM (SELECT o_orderkey, k, CAST(2015 + k % 6 AS STRING) AS y,
        lpad(CAST(1 + k % 12 AS STRING), 2, '0') AS m, lpad(CAST(1 + k % 28 AS STRING), 2, '0') AS d
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM {orders}) a) b
"""

# A fixed 50 x 50 demonstration raster; only ever joined to table data.
VIEWS["raster_cells"] = """
SELECT l.layer, CAST(i AS INT) AS row, CAST(j AS INT) AS col,
  CAST(CASE WHEN i = 49 AND j = 49 THEN CAST(-9999 AS DOUBLE)
       WHEN l.layer = 'elevation' THEN CAST(500 + (i * j * 10) % 3500 AS DOUBLE)
       WHEN l.layer = 'slope' THEN CAST((i * j * 5) % 450 AS DOUBLE) / CAST(10 AS DOUBLE)
       WHEN l.layer = 'aspect' THEN CAST((i * j * 5) % 360 AS DOUBLE)
       ELSE CAST((i * j) % 150 - 50 AS DOUBLE) / CAST(100 AS DOUBLE) END AS DOUBLE) AS value
FROM (SELECT n % 50 AS j, CAST((n - n % 50) / 50 AS BIGINT) AS i FROM range(2500) AS t(n)) g
CROSS JOIN (SELECT 'ndvi' AS layer UNION ALL SELECT 'elevation' UNION ALL SELECT 'slope' UNION ALL SELECT 'aspect') l
"""

# Raster strips whose number of rows grows with the orders table.
VIEWS["terrain_cells"] = """
SELECT CAST((o_orderkey - o_orderkey % 100) / 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
  CASE WHEN o_orderkey % 211 = 210 THEN CAST(-9999 AS DOUBLE)
       ELSE CAST(500 + (o_orderkey * 7919) % 3500 AS DOUBLE) END AS value
FROM {orders}
"""

VIEWS["env"] = """
SELECT o_orderkey AS env_id, CAST((k * 37) % 201 AS DOUBLE) AS rainfall_mm, CAST((k * 53) % 101 AS DOUBLE) AS soil_moisture_pct,
  CAST((k * 29) % 61 AS DOUBLE) AS slope_deg, CAST((k * 71) % 2501 AS DOUBLE) AS elevation_m, CAST(10 + (k * 13) % 26 AS DOUBLE) AS temperature_c,
  CAST((k * 17) % 61 AS DOUBLE) / CAST(10 AS DOUBLE) AS river_level_m, CAST((k * 43) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS vegetation_index,
  CAST(k % 2 AS INT) AS landslide_history,
  CASE WHEN ((k * 37) % 201) * 3 + ((k * 29) % 61) * 7 < 400 THEN 'LOW' WHEN ((k * 37) % 201) * 3 + ((k * 29) % 61) * 7 < 700 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
FROM (SELECT o_orderkey, o_orderkey AS k FROM {orders}) a
"""

# The same readings as untyped text with defects, for the gates and checks.
VIEWS["env_raw"] = """
SELECT env_id, CASE WHEN env_id % 61 = 0 THEN NULL WHEN env_id % 67 = 0 THEN 'wet' ELSE CAST(CAST(rainfall_mm AS INT) AS STRING) END AS rainfall_mm,
  CAST(CAST(CASE WHEN env_id % 71 = 0 THEN soil_moisture_pct + 100 ELSE soil_moisture_pct END AS INT) AS STRING) AS soil_moisture_pct,
  CAST(CAST(CASE WHEN env_id % 73 = 0 THEN slope_deg - 100 ELSE slope_deg END AS INT) AS STRING) AS slope_deg,
  CAST(CAST(CASE WHEN env_id % 79 = 0 THEN elevation_m - 3000 ELSE elevation_m END AS INT) AS STRING) AS elevation_m,
  CAST(CAST(temperature_c AS INT) AS STRING) AS temperature_c,
  CAST(CASE WHEN env_id % 83 = 0 THEN river_level_m - CAST(10 AS DOUBLE) ELSE river_level_m END AS STRING) AS river_level_m,
  CAST(CASE WHEN env_id % 89 = 0 THEN vegetation_index + CAST(2 AS DOUBLE) ELSE vegetation_index END AS STRING) AS vegetation_index,
  CASE WHEN env_id % 97 = 0 THEN '2' ELSE CAST(landslide_history AS STRING) END AS landslide_history,
  CASE WHEN env_id % 59 = 0 THEN NULL WHEN env_id % 53 = 0 THEN ' low ' WHEN env_id % 47 = 0 THEN 'EXTREME' ELSE risk_level END AS risk_level
FROM env
"""

VIEWS["routes"] = """
SELECT o_orderkey AS trip_id, CAST(j + 1 AS INT) AS ordinal, concat('Route ', CASE WHEN j = 0 THEN 'A' WHEN j = 1 THEN 'B' ELSE 'C' END) AS route,
  CAST(1 + (o_orderkey * 7 + j * 5) % 20 AS DOUBLE) AS distance, CAST((o_orderkey * 31 + j * 37) % 101 AS DOUBLE) AS risk,
  o_orderkey % 3 = j AS is_current
FROM {orders} CROSS JOIN range(3) AS t(j)
"""

# Trips and zones fill tiles of one size, so their density does not grow with the tables.
VIEWS["waypoints"] = """
SELECT o_orderkey AS trip_id, CAST(j + 1 AS INT) AS ordinal,
  CAST(1120000 + 40000 * (tile % 40) + (o_orderkey * 7919 + j * 311) % 40000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude,
  CAST(7640000 + 50000 * (CAST((tile - tile % 40) / 40 AS BIGINT) % 150) + (o_orderkey * 6007 + j * 173) % 50000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude
FROM (SELECT o_orderkey, CAST((o_orderkey - o_orderkey % 60000) / 60000 AS BIGINT) AS tile FROM {orders}) o CROSS JOIN range(4) AS t(j)
"""

VIEWS["image_flags"] = """
SELECT o_orderkey AS trip_id, o_orderkey % 11 = 0 AS landslide, o_orderkey % 5 = 0 AS flooding, o_orderkey % 4 = 0 AS road_damage FROM {orders}
"""

VIEWS["signals"] = """
SELECT o_orderkey AS trip_id,
  CASE o_orderkey % 7 WHEN 0 THEN concat(chr(9), 'low', chr(10)) WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'moderate' WHEN 4 THEN 'EXTREME' WHEN 5 THEN 'LOW' END AS ml_risk,
  CASE o_orderkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS route_risk,
  CASE (o_orderkey % 25 - o_orderkey % 5) / 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS image_risk,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'high' WHEN o_orderkey % 9 = 3 THEN ' LOW' ELSE 'Medium' END AS level_text,
  CAST((o_orderkey * 31) % 101 AS DOUBLE) AS level_score,
  CAST((o_orderkey * 61) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS probability
FROM {orders}
"""

VIEWS["responses"] = """
SELECT o_orderkey AS request_id,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('{{"risk_level": "', lower(lvl), '", "final_risk": "low"}}')
    WHEN 1 THEN concat('{{"final_risk": "', lower(lvl), '"}}')
    WHEN 2 THEN concat('{{"risk": "', lvl, '"}}')
    WHEN 3 THEN concat('{{"risk": {{"risk_level": "', lvl, '"}}}}')
    WHEN 4 THEN concat('{{"risk": {{"final_risk": "', lower(lvl), '"}}}}')
    ELSE '{{"score": 12}}' END AS body
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS lvl FROM {orders}) a
"""

VIEWS["reports"] = """
SELECT event_id AS id, concat('LSR-2024-', lpad(CAST(event_id AS STRING), 6, '0')) AS report_id, concat('citizen-', CAST(user_id AS STRING)) AS user_id,
  CAST(1120000 + (event_id * 7919) % 40000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude, CAST(7640000 + (event_id * 6007) % 50000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('Site ', CAST(event_id % 97 AS STRING)) END AS location_name,
  CASE event_type WHEN 'click' THEN 'Road crack' WHEN 'error' THEN 'Landslide' WHEN 'purchase' THEN 'Rockfall' WHEN 'signup' THEN 'Water seepage' ELSE 'Fallen debris' END AS hazard_type,
  concat('Observation of ', event_type) AS description,
  CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'UNDER_REVIEW' WHEN 2 THEN 'VERIFIED' WHEN 3 THEN 'REJECTED' ELSE 'RESOLVED' END AS status, ts AS created_at
FROM {events}
"""

# Coordinates with many repeats, in requests of ten.
VIEWS["coordinates"] = """
SELECT event_id AS ordinal, CAST((event_id - event_id % 10) / 10 AS BIGINT) AS request_id,
  CASE WHEN event_id % 3 = 0 THEN CAST(11.41 AS DOUBLE) ELSE CAST(1090000 + (user_id * 7919) % 100000 AS DOUBLE) / CAST(100000 AS DOUBLE) END
    + CAST(event_id % 2 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS latitude,
  CASE WHEN event_id % 3 = 0 THEN CAST(76.69 AS DOUBLE) ELSE CAST(7640000 + (user_id * 6007) % 60000 AS DOUBLE) / CAST(100000 AS DOUBLE) END AS longitude
FROM {events}
"""

VIEWS["alerts"] = """
SELECT event_id AS id, concat('ALT-', CAST(event_id AS STRING)) AS alert_id,
  CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, ts AS issued_at, event_id % 3 <> 0 AS is_active
FROM {events}
"""

VIEWS["risk_zones"] = """
SELECT s_suppkey AS id, concat('ZONE-', CAST(s_suppkey AS STRING)) AS zone_id,
  CAST(1120000 + 40000 * (tile % 40) + (s_suppkey * 3571) % 40000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude,
  CAST(7640000 + 50000 * (CAST((tile - tile % 40) / 40 AS BIGINT) % 150) + (s_suppkey * 4217) % 50000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude,
  CAST(500 + (s_suppkey * 271) % 2001 AS DOUBLE) AS radius_meters, CAST((s_suppkey * 61) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_probability
FROM (SELECT s_suppkey, CAST((s_suppkey - s_suppkey % 100) / 100 AS BIGINT) AS tile FROM {supplier}) s
"""

VIEWS["zone_polygons"] = """
SELECT id, zone_id, latitude, longitude,
  concat('{{"type": "Polygon", "coordinates": [[[', CAST(longitude - CAST(0.0078125 AS DOUBLE) AS STRING), ', ', CAST(latitude - CAST(0.0078125 AS DOUBLE) AS STRING), '], [',
    CAST(longitude + CAST(0.0078125 AS DOUBLE) AS STRING), ', ', CAST(latitude - CAST(0.0078125 AS DOUBLE) AS STRING), '], [',
    CAST(longitude AS STRING), ', ', CAST(latitude + CAST(0.015625 AS DOUBLE) AS STRING), '], [',
    CAST(longitude - CAST(0.0078125 AS DOUBLE) AS STRING), ', ', CAST(latitude - CAST(0.0078125 AS DOUBLE) AS STRING), ']]]}}') AS polygon
FROM risk_zones
"""

# Triangles with a triangular hole.
VIEWS["zone_shapes"] = """
SELECT zone_id, latitude, longitude, substr(polygon, 1, length(polygon) - 2) || ', [[' ||
    CAST(longitude - CAST(0.001953125 AS DOUBLE) AS STRING) || ', ' || CAST(latitude - CAST(0.001953125 AS DOUBLE) AS STRING) || '], [' ||
    CAST(longitude + CAST(0.001953125 AS DOUBLE) AS STRING) || ', ' || CAST(latitude - CAST(0.001953125 AS DOUBLE) AS STRING) || '], [' ||
    CAST(longitude AS STRING) || ', ' || CAST(latitude + CAST(0.00390625 AS DOUBLE) AS STRING) || '], [' ||
    CAST(longitude - CAST(0.001953125 AS DOUBLE) AS STRING) || ', ' || CAST(latitude - CAST(0.001953125 AS DOUBLE) AS STRING) || ']]]}}' AS polygon
FROM zone_polygons
"""

VIEWS["uploads"] = """
SELECT page_id AS upload_id,
  concat('photo_', CAST(page_id AS STRING), CASE page_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.gif' ELSE '' END) AS file_name,
  CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/gif' ELSE 'text/html' END AS mime_type,
  CAST(length(html) AS BIGINT) * 4096 AS size_bytes
FROM {pages}
"""

# Dataset descriptors: one row per part, with boxes that all share a core.
VIEWS["datasets"] = """
SELECT p_partkey AS ordinal, concat(CASE p_partkey % 3 WHEN 0 THEN 'm2a/' WHEN 1 THEN 'm2b/' ELSE 'gis/' END, replace(p_name, ' ', '/'), '_', CAST(p_partkey AS STRING),
    CASE p_partkey % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.csv' WHEN 2 THEN '.geojson' WHEN 3 THEN '.json' ELSE '.txt' END) AS path,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs,
  CASE WHEN p_partkey % 5 < 3 THEN CAST(70 + p_partkey % 5 AS DOUBLE) END AS min_x, CASE WHEN p_partkey % 5 < 3 THEN CAST(10 + p_partkey % 4 AS DOUBLE) END AS min_y,
  CASE WHEN p_partkey % 5 < 3 THEN CAST(80 + p_partkey % 6 AS DOUBLE) END AS max_x, CASE WHEN p_partkey % 5 < 3 THEN CAST(20 + p_partkey % 3 AS DOUBLE) END AS max_y,
  CASE WHEN p_partkey % 5 IN (1, 2) THEN CAST(p_size AS BIGINT) END AS row_count, p_partkey % 401 = 400 AS has_error
FROM {part}
"""

VIEWS["sidecars"] = """
SELECT concat(CASE WHEN p_partkey % 2 = 1 THEN 'unlisted/' WHEN p_partkey % 3 = 0 THEN 'm2a/' WHEN p_partkey % 3 = 1 THEN 'm2b/' ELSE 'gis/' END, replace(p_name, ' ', '/'), '_', CAST(p_partkey AS STRING)) AS stem,
  CASE WHEN p_partkey % 4 = 0 THEN 'M2-A' END AS module, lower(p_type) AS purpose,
  CASE WHEN p_partkey % 8 < 4 THEN 'SYNTHETIC_DEMO_DATA' ELSE 'VERIFIED' END AS status
FROM {part}
"""

# Column names as a hand-over might list them, one list per order.
VIEWS["column_lists"] = """
SELECT o_orderkey AS dataset_id, CAST(j + 1 AS INT) AS position,
  CASE WHEN o_orderkey % 11 = 0 AND j = 7 THEN 'note' WHEN o_orderkey % 13 = 0 AND j = 3 THEN 'risk_score' WHEN o_orderkey % 17 = 0 AND j = 4 THEN 'scaled_elevation'
       WHEN o_orderkey % 19 = 0 AND j = 5 THEN 'test_split' WHEN o_orderkey % 7 = 0 AND j = 1 THEN 'longitude' WHEN o_orderkey % 7 = 0 AND j = 2 THEN 'latitude'
       WHEN o_orderkey % 29 = 0 AND j = 6 THEN 'rainfall_24h' WHEN o_orderkey % 37 = 0 AND j = 6 THEN 'class'
       ELSE CASE j WHEN 0 THEN 'landslide_id' WHEN 1 THEN 'latitude' WHEN 2 THEN 'longitude' WHEN 3 THEN 'ndvi' WHEN 4 THEN 'elevation_m'
              WHEN 5 THEN 'slope_deg' WHEN 6 THEN 'aspect_deg' ELSE 'data_source_type' END END AS column_name
FROM {orders} CROSS JOIN range(8) AS t(j)
"""

VIEWS["pixels"] = """
SELECT vec_id AS patch_id, CAST(pos AS INT) AS pixel, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) / CAST(2 AS DOUBLE) + x * CAST(2 AS DOUBLE))) AS prob,
  CASE WHEN x > 0 AND (vec_id + pos) % 3 <> 0 THEN 1 WHEN (vec_id + pos) % 17 = 0 THEN 1 ELSE 0 END AS target FROM {vectors} v
"""

VIEWS["band_values"] = """
SELECT vec_id AS sample_id, CAST(pos % 14 AS INT) AS band, CAST(pos AS INT) AS pos, x * CAST(8 AS DOUBLE) AS value FROM {vectors} v
"""

# 8 x 8 single-band patches with their masks.
VIEWS["patch_pixels"] = """
SELECT vec_id AS patch_id, CAST((pos - pos % 8) / 8 AS INT) AS row, CAST(pos % 8 AS INT) AS col, x AS value,
  CASE WHEN (vec_id + pos) % 401 = 0 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END AS target FROM {vectors} v
"""

VIEWS["work_tasks"] = """
SELECT o_orderkey AS id, concat('Task ', CAST(o_orderkey AS STRING)) AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'someday' END AS priority,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('2024-', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) END AS due_date,
  CASE WHEN o_orderkey % 5 = 0 THEN 'completed' ELSE 'pending' END AS status
FROM {orders}
"""

VIEWS["work_assignments"] = """
SELECT c_custkey AS id, concat('Assignment ', CAST(c_custkey AS STRING)) AS title, c_mktsegment AS subject,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('2024-', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) END AS due_date,
  CASE WHEN c_custkey % 4 = 0 THEN 'completed' ELSE 'pending' END AS status
FROM {customer}
"""

VIEWS["work_changes"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 = 3 THEN concat('Renamed ', CAST(o_orderkey AS STRING)) END AS title,
  CASE WHEN o_orderkey % 12 = 6 THEN 'high' END AS priority, CASE WHEN o_orderkey % 12 = 9 THEN '2025-01-01' END AS due_date,
  o_orderkey % 15 = 0 AS complete, o_orderkey % 21 = 0 AS deleted
FROM {orders}
"""

VIEWS["status_updates"] = """
SELECT event_id AS update_id, concat('LSR-2024-', lpad(CAST((event_id * 3) % 5000 AS STRING), 6, '0')) AS report_id,
  CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'under_review' WHEN 2 THEN 'Verified' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'RESOLVED' WHEN 5 THEN 'closed' ELSE 'done' END AS status,
  ts AS updated_at
FROM {events}
"""

VIEWS["submissions"] = """
SELECT event_id AS ordinal, latitude, longitude, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE concat('Site ', CAST(event_id % 97 AS STRING)) END AS location_name,
  CASE event_id % 3 WHEN 0 THEN 'Landslide' WHEN 1 THEN 'Rockfall' ELSE 'Road crack' END AS hazard_type,
  CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE concat('Observation of ', event_type) END AS description,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'HIGH' END AS severity,
  CASE WHEN event_id % 10 = 0 THEN concat('uploads/', CAST(event_id AS STRING), '.jpg') END AS image_path, ts AS created_at
FROM (SELECT event_id, event_type, ts, CAST(1120000 + (event_id * 7919) % 40000 AS DOUBLE) / CAST(100000 AS DOUBLE) + CASE WHEN event_id % 41 = 0 THEN 90 ELSE 0 END AS latitude,
        CAST(7640000 + (event_id * 6007) % 50000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude FROM {events}) e
"""

VIEWS["facts"] = """
SELECT doc_id AS update_id, doc_id % 40 AS owner, lang AS category, concat('key-', CAST(doc_id % 24 AS STRING)) AS fact_key,
  CASE WHEN doc_id % 9 = 0 THEN '   ' WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS value
FROM {documents}
"""

VIEWS["access_log"] = """
SELECT event_id AS request_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  concat('/', event_type) AS endpoint, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN 404 ELSE 200 END AS status,
  CAST(value AS DOUBLE) / CAST(100 AS DOUBLE) AS duration_s, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'TimeoutError' ELSE 'KeyError' END END AS exception_type
FROM {events}
"""

VIEWS["ml_requests"] = """
SELECT event_id AS request_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 37) % 251 AS DOUBLE) END AS rainfall,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((event_id * 29) % 61 AS DOUBLE) END AS slope,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 71) % 3001 AS DOUBLE) END AS elevation,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST((event_id * 43) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS ndvi
FROM {events}
"""

VIEWS["predictions"] = """
SELECT env_id, risk_level AS actual,
  CASE env_id % 10 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE risk_level END AS predicted_a,
  CASE env_id % 8 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE risk_level END AS predicted_b,
  CAST((env_id * 31) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM env
"""

_SPARK_VECTORS = "(SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x)"
_DUCK_VECTORS = "(SELECT vec_id, label, p AS pos, CAST(embedding[p + 1] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(64) AS t(p))"

DEPENDS = {name: [other for other in VIEWS if other != name and re.search(rf"\bFROM {other}\b", text)] for name, text in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the parquet tables in ``sf_dir``."""
    text = VIEWS[name].replace("{vectors}", _SPARK_VECTORS)
    frames = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for other in DEPENDS[name]:
        text = re.sub(rf"\bFROM {other}\b", "FROM {" + other + "}", text)
        frames[other] = view(spark, sf_dir, other)
    return spark.sql(text, **frames)


def duck_ctes(names: list[str]) -> list[tuple[str, str]]:
    """(name, text) pairs for DuckDB in dependency order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out:
            return
        for other in DEPENDS[name]:
            add(other)
        text = VIEWS[name].replace("{vectors}", _DUCK_VECTORS)
        out[name] = text.format(**{t: t for t in TABLES}).strip()

    for name in names:
        add(name)
    return list(out.items())
