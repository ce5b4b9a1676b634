"""File sources and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from scarpline.functions.geo import Grid
from scarpline.operators import spatial
from scarpline.sources import catalog, geojson, incidents, rasters, relational, shared


def test_csv_null_tokens_and_spaces(spark, tmp_path):
    path = tmp_path / "raw.csv"
    names = ",".join(incidents.INCIDENT_COLUMNS)
    path.write_text(names + '\n" LS-1 ",NA,null,12.5,"a, ""b""",N/A,,x,y,z,None,"two  words"\n')
    row = incidents.read_incidents(spark, str(path)).first()
    assert (row["landslide_id"], row["date"], row["latitude"], row["longitude"]) == (" LS-1 ", None, None, "12.5")
    assert (row["location"], row["district"], row["state"], row["severity"], row["description"]) == ('a, "b"', None, None, None, "two  words")


def test_geojson_collection_and_lines(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"landslide_id": "LS-1"}, "geometry": {"type": "Point", "coordinates": [84.5, 28.25]}}
    document = tmp_path / "one.geojson"
    document.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(feature) + "\n")
    schema = T.StructType([T.StructField("landslide_id", T.StringType())])
    expected = ("LS-1", 84.5, 28.25, "Point")
    assert [tuple(r) for r in geojson.read_points(spark, str(document), schema, collection=True).collect()] == [expected] * 2
    assert [tuple(r) for r in geojson.read_points(spark, str(lines), schema).collect()] == [expected]


def test_polygon_text(spark):
    df = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',), ('{"type":"Point","coordinates":[1,2]}',), ("x",)], "p string")
    rings = [r[0] for r in df.select(geojson.polygon_rings(F.col("p"))).collect()]
    assert rings == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], None, None]


def test_raster_round_trip(spark):
    cells = spark.range(6).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    path = shared.folder(spark, "raster-test")
    rasters.write_raster(cells, Grid(1.0, 2.0, 0.5, 3, 2), path)
    back, grid = rasters.read_raster(spark, path)
    assert grid == Grid(1.0, 2.0, 0.5, 3, 2) and back.count() == 6
    stats = spatial.window_stats(back.withColumn("layer", F.lit("a")), ["layer"]).first()
    assert (stats["sample_min"], stats["sample_max"], stats["sample_mean"]) == (0.0, 5.0, 2.5)


def test_file_inventory(spark, tmp_path):
    os.makedirs(tmp_path / "sub.dir")
    (tmp_path / "sub.dir" / "dem.tif").write_bytes(b"12345")
    (tmp_path / "meta.json").write_text("{}")
    out = {r["dataset_id"]: (r["kind"], r["size_bytes"]) for r in catalog.file_inventory(spark, str(tmp_path), "M2A_").collect()}
    assert out == {"M2A_sub_dir_dem_tif": ("raster", 5), "M2A_meta_json": ("json", 2)}


def test_versions_prefer_corrected(spark):
    files = spark.createDataFrame([("dem", "dem_b.tif"), ("dem", "dem_z_phase5_1.tif"), ("slope", "slope_b.tif"), ("slope", "slope_a.tif")], "layer string, file_name string")
    out = {r["layer"]: (r["file_name"], r["corrected"]) for r in rasters.choose_versions(files).collect()}
    assert out == {"dem": ("dem_z_phase5_1.tif", True), "slope": ("slope_a.tif", False)}


def test_pairing_with_absent_masks(spark):
    images = spark.createDataFrame([("train", f"i{n}") for n in range(3)] + [("test", "t0")], "split string, file_name string")
    masks = spark.createDataFrame([("train", f"m{n}") for n in range(2)], "split string, file_name string")
    pairs = {(r["split"], r["pair_no"]): (r["image"], r["mask"]) for r in rasters.pair_by_position(images, masks).collect()}
    assert pairs == {("train", 1): ("i0", "m0"), ("train", 2): ("i1", "m1"), ("train", 3): ("i2", None), ("test", 1): ("t0", None)}


def test_relational_defaults_and_keys(spark):
    df = spark.createDataFrame([("R1", 1.0, 2.0, "x", "text", None), ("R1", None, 2.0, "x", "text", "LOW")], "report_id string, latitude double, longitude double, hazard_type string, description string, severity string")
    filled = relational.with_defaults(df, "reports")
    assert [r["severity"] for r in filled.collect()] == ["MEDIUM", "LOW"]
    out = relational.table_check(df, "reports").first()
    assert (out["row_count"], out["repeated_keys"], out["missing_required"]) == (2, 1, 1)


def test_shared_folder_follows_the_session(spark):
    a, b = shared.folder(spark, "x"), shared.folder(spark, "x")
    assert a != b and os.path.dirname(a) == os.path.dirname(b)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert a.startswith(configured)


@pytest.mark.parametrize("name, mime, size, reason", [("a.jpg", "image/jpeg", 1, None), ("a.gif", "image/gif", 1, "bad_extension"), ("a.png", "text/html", 1, "bad_mime_type"), ("a.png", "image/png", 11 << 20, "too_large"), ("", "image/png", 1, "no_file_name"), ("a.png", None, 1, None)])
def test_uploads(spark, name, mime, size, reason):
    df = spark.createDataFrame([(1, name, mime, size)], "upload_id int, file_name string, mime_type string, size_bytes long")
    assert catalog.upload_check(df).first()["reason"] == reason
