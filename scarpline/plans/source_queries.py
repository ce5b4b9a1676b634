"""Sources and sinks, each written and read back in the shared folder."""

from pyspark.sql import functions as F, types as T

from scarpline.operators import cleaning, spatial, validation
from scarpline.plans.registry import check_view, query
from scarpline.plans.spatial_queries import points
from scarpline.sources import catalog, collections, geojson, incidents, rasters, relational, shared
from scarpline.sources.views import TABLES

_ALL = ", ".join(validation.INCIDENT_COLUMNS)
_ORDINAL = (T.StructField("ordinal", T.LongType()),)


@query("incident_csv_scan", "S1", "incidents", f"SELECT ordinal, {_ALL} FROM incidents")
def _(v):
    path = shared.folder(v.spark, "incident-csv")
    incidents.write_stage(v("incidents"), path, "csv")
    return incidents.read_incidents(v.spark, path, leading=_ORDINAL)


@query("cleaned_csv_scan", "S2 S14", "cleaned", f"SELECT ordinal, {_ALL}, data_quality_status FROM cleaned")
def _(v):
    path = shared.folder(v.spark, "cleaned-csv")
    incidents.write_stage(cleaning.clean_table(v("incidents")), path, "csv")
    return incidents.read_cleaned(v.spark, path, leading=_ORDINAL)


@query("labelled_csv_scan", "S3", "env", "SELECT * FROM env")
def _(v):
    path = shared.folder(v.spark, "labelled-csv")
    incidents.write_stage(v("env"), path, "csv")
    return incidents.read_labelled(v.spark, path, leading=(T.StructField("env_id", T.LongType()),))


@query("geojson_point_scan", "S4", "points", "SELECT ordinal, landslide_id, longitude AS x, latitude AS y, 'Point' AS geometry_type FROM points")
def _(v):
    path = shared.folder(v.spark, "points-geojson")
    geojson.write_points(points(v), ["ordinal", "landslide_id"], path)
    return geojson.read_points(v.spark, path, T.StructType([*_ORDINAL, T.StructField("landslide_id", T.StringType())]))


@query("geojson_collection_scan", "S4", "points", "SELECT ordinal, landslide_id, longitude AS x, latitude AS y, 'Point' AS geometry_type FROM points")
def _(v):
    path = shared.folder(v.spark, "collections-geojson")
    geojson.write_collections(points(v), ["ordinal", "landslide_id"], F.floor(F.col("ordinal") / 500), path)
    return geojson.read_points(v.spark, path, T.StructType([*_ORDINAL, T.StructField("landslide_id", T.StringType())]), collection=True)


@query("geojson_range_scan", "S4", "points", "SELECT ordinal, landslide_id, longitude AS x, latitude AS y, 'Point' AS geometry_type FROM points")
def _(v):
    """Documents of up to 20,000 ordinals, each read by several tasks."""
    path = shared.folder(v.spark, "ranges-geojson")
    geojson.write_collections(points(v), ["ordinal", "landslide_id"], F.floor(F.col("ordinal") / 20_000), path)
    return collections.read_collections(v.spark, path, T.StructType([*_ORDINAL, T.StructField("landslide_id", T.StringType())]), range_bytes=256 << 10)


@query(
    "geojson_point_features", "S5", "points",
    """SELECT '{"type":"Feature","properties":{"ordinal":' || ordinal || ',"landslide_id":' || CASE WHEN landslide_id IS NULL THEN 'null' ELSE '"' || landslide_id || '"' END
  || '},"geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']}}' AS value FROM points""",
)
def _(v):
    return geojson.point_features(points(v), ["ordinal", "landslide_id"])


@query(
    "polygon_corners", "S6", "zone_polygons",
    """SELECT zone_id, CAST(p AS INT) AS corner, CAST(json_extract(polygon, '$.coordinates[0][' || p || '][0]') AS DOUBLE) AS x, CAST(json_extract(polygon, '$.coordinates[0][' || p || '][1]') AS DOUBLE) AS y
FROM zone_polygons, range(4) AS g(p)""",
)
def _(v):
    rings = v("zone_polygons").select("zone_id", geojson.polygon_rings(F.col("polygon")).alias("rings"))
    corners = rings.select("zone_id", F.posexplode(F.col("rings")[0]).alias("corner", "p"))
    return corners.select("zone_id", "corner", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(
    "raster_source", "S7", "terrain_cells",
    "SELECT row, col, value, CAST(77 AS DOUBLE) + (col + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE) AS x, CAST(31 AS DOUBLE) - (row + CAST(0.5 AS DOUBLE)) * CAST(0.25 AS DOUBLE) AS y FROM terrain_cells WHERE value <> -9999",
)
def _(v):
    path = shared.folder(v.spark, "raster")
    rasters.write_raster(v("terrain_cells"), spatial.Grid(77.0, 31.0, 0.25, 100, 1 << 30), path)
    cells, grid = rasters.read_raster(v.spark, path)
    centre = lambda c: (F.col(c) + 0.5) * grid.pixel
    return cells.filter(F.col("value") != grid.nodata).withColumns({"x": grid.min_x + centre("col"), "y": grid.max_y - centre("row")})


_SPLIT = "CASE WHEN {k} % 5 < 3 THEN 'train' WHEN {k} % 5 = 3 THEN 'val' ELSE 'test' END"
_IMAGES = f"SELECT {_SPLIT.format(k='o_orderkey')} AS split, concat('image_', CAST(o_orderkey AS STRING), '.h5') AS file_name FROM {{orders}}"
_MASKS = f"SELECT {_SPLIT.format(k='o_orderkey')} AS split, concat('mask_', CAST(o_orderkey AS STRING), '.h5') AS file_name FROM {{orders}} WHERE o_orderkey % 5 < 4 AND o_orderkey % 100 <> 3"
check_view("image_files", "", _IMAGES.format(orders="orders"))
check_view("mask_files", "", _MASKS.format(orders="orders"))
check_view(
    "pairs", "image_files mask_files",
    """SELECT coalesce(i.split, m.split) AS split, coalesce(i.n, m.n) AS pair_no, i.file_name AS image, m.file_name AS mask
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY file_name) AS n FROM image_files) i
FULL OUTER JOIN (SELECT *, row_number() OVER (PARTITION BY split ORDER BY file_name) AS n FROM mask_files) m ON i.split = m.split AND i.n = m.n""",
)


def _pairs(v):
    orders = v("orders")
    return rasters.pair_by_position(v.spark.sql(_IMAGES, orders=orders), v.spark.sql(_MASKS, orders=orders))


@query("image_mask_pairs", "S8", "pairs", "SELECT split, pair_no, image, mask FROM pairs")
def _(v):
    return _pairs(v)


@query("image_mask_counts", "S8", "pairs", "SELECT split, count(image) AS images, count(mask) AS masks, count(image) = count(mask) AS counts_match FROM pairs GROUP BY split")
def _(v):
    return rasters.pairing_report(_pairs(v))


_FILES = """SELECT concat('layer_', CAST((p_partkey - p_partkey % 6) / 6 AS BIGINT)) AS layer,
  concat('dem_', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 7 = 3 THEN '_phase5_1' ELSE '' END, '.tif') AS file_name FROM {part}"""


@query(
    "layer_versions", "S9", "",
    f"""WITH f AS ({_FILES.format(part='part')}) SELECT layer, arg_min(file_name, CASE WHEN contains(file_name, 'phase5_1') THEN '0' ELSE '1' END || file_name) AS file_name,
  bool_or(contains(file_name, 'phase5_1')) AS corrected FROM f GROUP BY layer""",
)
def _(v):
    return rasters.choose_versions(v.spark.sql(_FILES, part=v("part")))


@query(
    "file_inventory", "S10", "uploads",
    """SELECT translate(file_name, '/.', '__') AS dataset_id, file_name AS path, 'other' AS kind, size_bytes FROM uploads""",
)
def _(v):
    return catalog.describe_files(v("uploads").select(F.col("file_name").alias("path"), "size_bytes"))


@query(
    "dataset_inventory", "S10", "datasets",
    """SELECT translate(path, '/.', '__') AS dataset_id, path,
  CASE ordinal % 5 WHEN 0 THEN 'raster' WHEN 1 THEN 'csv' WHEN 2 THEN 'vector' WHEN 3 THEN 'json' ELSE 'other' END AS kind, row_count AS size_bytes FROM datasets""",
)
def _(v):
    return catalog.describe_files(v("datasets").select("path", F.col("row_count").alias("size_bytes")))


@query(
    "written_file_inventory", "S10", "datasets",
    """SELECT module || '_' || kind AS folder, kind, files FROM (SELECT split_part(path, '/', 1) AS module,
  CASE ordinal % 5 WHEN 0 THEN 'raster' WHEN 1 THEN 'csv' WHEN 2 THEN 'vector' WHEN 3 THEN 'json' ELSE 'other' END AS kind, count(*) AS n FROM datasets GROUP BY ALL) t
CROSS JOIN (SELECT CAST(1 AS BIGINT) AS files)""",
)
def _(v):
    """Parts written one folder per module and kind, listed again from the file system."""
    kind = catalog.kind_of(F.col("path"))
    parts = v("datasets").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("module"), kind.alias("kind"), "path", "row_count")
    root = shared.folder(v.spark, "inventory")
    parts.repartition("module", "kind").write.partitionBy("module", "kind").json(root)
    piece = lambda key: F.regexp_extract("path", f"{key}=([^/]+)", 1)
    listed = catalog.list_files(v.spark, root).filter("size_bytes > 0").select(piece("module").alias("module"), piece("kind").alias("kind"))
    counted = listed.groupBy("module", "kind").agg(F.count(F.lit(1)).alias("files"))
    return counted.select(F.concat_ws("_", "module", "kind").alias("folder"), "kind", "files")


check_view(
    "described", "descriptors sidecars",
    """SELECT d.*, coalesce(s.module, 'M2-A') AS module, coalesce(s.purpose, 'unknown') AS purpose, coalesce(s.status, 'unknown') AS status,
  CASE d.ordinal % 5 WHEN 0 THEN 'raster' WHEN 1 THEN 'csv' WHEN 2 THEN 'vector' WHEN 3 THEN 'json' ELSE 'other' END AS kind
FROM descriptors d LEFT JOIN sidecars s ON regexp_replace(d.path, '\\.[^./]+$', '') = s.stem""",
)


def _described(v):
    return catalog.join_sidecars(v("datasets"), v("sidecars"))


@query("sidecar_join", "S11", "described", "SELECT dataset_id, module, purpose, status, kind FROM described")
def _(v):
    return _described(v).select("dataset_id", "module", "purpose", "status", "kind")


_INTEGRATION = "CASE WHEN crs IS NOT NULL THEN 'EPSG:4326' END AS integration_crs"


@query(
    "registry_entries", "S12", "described",
    f"SELECT dataset_id, module, purpose, path, kind AS format, coalesce(crs, 'unknown') AS original_crs, {_INTEGRATION}, status FROM described WHERE NOT has_error",
)
def _(v):
    path = shared.folder(v.spark, "registry-json")
    entries = catalog.registry(_described(v))
    incidents.write_stage(entries, path, "json")
    return v.spark.read.schema(entries.schema).json(path)


@query(
    "integration_manifest", "S13", "described",
    f"""SELECT dataset_id, module, purpose AS dataset_name, path AS file_path, kind AS file_format, coalesce(crs, 'unknown') AS crs, {_INTEGRATION},
  CASE WHEN kind IN ('raster', 'vector') THEN 'yes' ELSE 'no' END AS spatial, coalesce(CAST(row_count AS VARCHAR), 'N/A') AS record_count, min_x, max_x, min_y, max_y, status, CAST(NULL AS VARCHAR) AS notes
FROM described WHERE NOT has_error""",
)
def _(v):
    path = shared.folder(v.spark, "manifest-csv")
    rows = catalog.manifest(_described(v))
    incidents.write_stage(rows, path, "csv")
    read = v.spark.read.schema(rows.schema).option("header", True).csv(path)
    return read.withColumn("notes", F.when(F.col("notes") != "", F.col("notes")))


@query("stage_parquet_sink", "S14", "points", "SELECT ordinal, longitude, latitude FROM points")
def _(v):
    path = shared.folder(v.spark, "stage")
    incidents.write_stage(points(v), path)
    return v.spark.read.parquet(path).select("ordinal", "longitude", "latitude")


def _check_sql(name: str) -> str:
    (key,) = relational.KEYS[name]
    missing = " OR ".join(f"{c} IS NULL" for c in relational.REQUIRED[name])
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, count(*) - count(DISTINCT {key}) AS repeated_keys, count(*) FILTER (WHERE {missing}) AS missing_required FROM {name}"


@query("relational_tables", "S15", "reports alerts risk_zones", " UNION ALL ".join(_check_sql(t) for t in relational.KEYS))
def _(v):
    parts = []
    for name in relational.KEYS:
        path = shared.folder(v.spark, name)
        v(name).write.parquet(path)
        parts.append(relational.table_check(relational.read_table(v.spark, path, name), name))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_COUNTERS = ("records_cleaned", "records_require_review", "duplicate_landslide_ids", "possible_spatial_duplicates", "invalid_dates", "dates_standardized")


@query(
    "cleaning_report", "S16", "cleaned",
    "+k AS (SELECT count(*) FILTER (WHERE data_quality_status = 'CLEAN') AS records_cleaned, count(*) FILTER (WHERE data_quality_status <> 'CLEAN') AS records_require_review,"
    " count(*) FILTER (WHERE duplicate_id) AS duplicate_landslide_ids, count(*) FILTER (WHERE spatial_duplicate) AS possible_spatial_duplicates,"
    " count(*) FILTER (WHERE date_unreadable) AS invalid_dates, count(*) FILTER (WHERE date_parsed) AS dates_standardized FROM cleaned) "
    + " UNION ALL ".join(f"SELECT 'cleaning' AS section, '{c}' AS metric, {c} AS value FROM k" for c in _COUNTERS),
)
def _(v):
    return validation.counters_report(cleaning.cleaning_counters(v("incidents")).select(*_COUNTERS), "cleaning")


@query(
    "upload_manifest_check", "S17", "uploads",
    """SELECT upload_id, reason IS NULL AS accepted, reason FROM (SELECT upload_id, CASE WHEN coalesce(file_name, '') = '' THEN 'no_file_name' WHEN lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) NOT IN ('jpg', 'jpeg', 'png', 'webp') THEN 'bad_extension'
  WHEN mime_type NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'bad_mime_type' WHEN size_bytes > 10485760 THEN 'too_large' END AS reason FROM uploads) u""",
)
def _(v):
    return catalog.upload_check(v("uploads"))


_TYPES = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"


def _profile_sql(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS row_count, CAST(row_number() OVER () AS INT) AS column_no, {columns} FROM (DESCRIBE {t}) d" for t in TABLES
    )


@query("dataset_profile", "S18", "", _profile_sql("column_name"))
def _(v):
    return catalog.profile({t: v(t) for t in TABLES}).drop("dtype")


@query("dataset_types", "S18", "", _profile_sql(f"column_name, {_TYPES} AS dtype"))
def _(v):
    return catalog.profile({t: v(t) for t in TABLES})


@query(
    "json_profile", "S18", "",
    "SELECT 'object' AS shape, array_to_string(list_sort(json_keys(props)), ',') AS keys, CAST(NULL AS INT) AS length, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def _(v):
    return catalog.json_profile(v("events"), "props")
