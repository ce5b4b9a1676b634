"""Literal inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from scarpline.functions import levels, text
from scarpline.functions.geo import Grid, in_ring
from scarpline.functions.rounding import round_exact
from scarpline.operators import (
    cleaning, contracts, dataset_qa, drift, ml_tables, pixels, preparation, risk_rules, routes, spatial, validation,
)

RAW = "ordinal long, " + ", ".join(f"{c} string" for c in validation.INCIDENT_COLUMNS)


def incident(n, id_, date, lat, lon, severity="High"):
    return (n, id_, date, lat, lon, "Hill  road", "D", "S", "C", "Archive", "https://example.com", severity, "text")


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        incident(1, "LS-1", "2020-05-15", "28.3949", "84.1240"),
        incident(2, "LS-2", "2019-08-20", "30.0668", "79.0193"),
        incident(3, "LS-3", "2021-07-10", "27.5330", "88.5122", None),
        incident(4, "LS-4", "2018-06-05", None, "77.1734"),
        incident(5, "LS-5", "2022-09-12", "26.2006", "92.9376"),
    ]
    return spark.createDataFrame(rows, RAW)


def one(df):
    return df.first().asDict()


def test_record_outcomes(raw):
    out = one(validation.record_outcomes(raw))
    assert (out["valid_records"], out["records_with_errors"], out["records_with_warnings"], out["missing_coordinates"]) == (4, 1, 1, 1)


def test_cleaning_counters(raw):
    out = one(cleaning.cleaning_counters(raw))
    assert (out["total_records"], out["records_cleaned"], out["records_require_review"]) == (5, 4, 1)
    assert (out["missing_required_values"], out["dates_standardized"]) == (1, 5)


def test_duplicate_pairs(spark):
    twice = [incident(1, "A", "2020-01-01", "1", "2"), incident(2, " A ", "2020-01-02", "3", "4"), incident(3, "B", "2020-01-03", "5", "6")]
    assert one(cleaning.cleaning_counters(spark.createDataFrame(twice, RAW)))["duplicate_landslide_ids"] == 2
    same = [incident(1, "A", "2020-01-01", "1", "2"), incident(2, "A", "2020-01-01", "1", "2")]
    out = one(cleaning.cleaning_counters(spark.createDataFrame(same, RAW)))
    assert (out["exact_duplicate_rows"], out["possible_spatial_duplicates"]) == (1, 2)


def test_missing_column_counts_every_record(raw):
    out = {r["field"]: r["missing_count"] for r in validation.recommended_field_counts(raw.drop("source_url")).collect()}
    assert out == {"source_url": 5}


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2020-5-7", "2020-05-07"), ("2020/05/07", "2020-05-07"), ("07-05-2020", "2020-05-07"), ("05/06/2020", "2020-05-06"),
        ("25/06/2020", "2020-06-25"), ("2020-13-01", None), ("30-02-2020", None), ("20-5-7", None), ("2020-05/07", None), (" 2020-05-07 ", "2020-05-07"),
        ("2020-001-5", None), ("2020-05-07T10", None), ("", None),
    ],
)
def test_dates(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.to_any_date(F.col("v")).cast("string")).first()[0] == expected


@pytest.mark.parametrize(
    "value, expected",
    [("1.5", 1.5), (" -2 ", -2.0), ("1e3", 1000.0), ("inf", math.inf), ("1.5d", None), ("0x1p3", None), ("abc", None), ("nan", None), ("", None), ("1_0", None)],
)
def test_numbers(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.to_number(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("digits", [2, 4])
def test_round_exact_is_python_rounding(spark, digits):
    values = [i / 1000 + d for i in range(0, 2000, 5) for d in (0.0, 0.00005, 1e-9)] + [11.41005, 76.69, 0.545, 0.295, 2.675, -1.005]
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    out = df.select("x", round_exact(F.col("x"), digits).alias("r")).collect()
    assert all(r["r"] == round(r["x"], digits) for r in out)


def test_raster_golden_points(spark):
    cells = spark.sql("""
        SELECT layer, CAST(i AS INT) AS row, CAST(j AS INT) AS col, CAST(CASE layer WHEN 'elevation' THEN 500 + (i * j * 10) % 3500
          WHEN 'slope' THEN ((i * j * 5) % 450) / 10.0 WHEN 'aspect' THEN (i * j * 5) % 360 ELSE ((i * j) % 150 - 50) / 100.0 END AS DOUBLE) AS value
        FROM (SELECT id AS i FROM range(50)) CROSS JOIN (SELECT id AS j FROM range(50)) CROSS JOIN VALUES ('ndvi'), ('elevation'), ('slope'), ('aspect') AS l(layer)""")
    g = spatial.DEMO_GRID
    at = lambda r, c: (g.max_y - (r + 0.5) * g.pixel, g.min_x + (c + 0.5) * g.pixel)
    spots = [(14, 33), (11, 28), (4, 4), (35, 45), (60, 2)]
    points = spark.createDataFrame([(i, *at(r, c)) for i, (r, c) in enumerate(spots)], "ordinal int, latitude double, longitude double")
    expected = [(-0.38, 1620, 6, 150), (-0.42, 3580, 19, 100), (-0.34, 660, 8, 80), (0.25, 2250, 22.5, 315), (None,) * 4]
    for limit in ("10m", "-1"):  # broadcast and shuffle plans agree
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        out = spatial.sample_layers(points, cells, g).orderBy("ordinal").collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert [(r["ndvi"], r["elevation_m"], r["slope_deg"], r["aspect_deg"]) for r in out] == expected
        assert [r["ndvi_status"] for r in out] == ["EXTRACTED"] * 4 + ["OUTSIDE_RASTER"]


def test_absent_layer_has_no_data_source(spark):
    cells = spark.createDataFrame([("ndvi", 0, 0, 0.5)], "layer string, row int, col int, value double")
    points = spark.createDataFrame([(0.5, 0.5)], "latitude double, longitude double")
    out = spatial.sample_layers(points, cells, Grid(0.0, 1.0, 1.0, 1, 1), available=["ndvi"]).first()
    assert (out["ndvi_status"], out["slope_status"], out["slope_deg"]) == ("EXTRACTED", "NO_DATA_SOURCE", None)


def test_terrain_matches_gradient(spark):
    np = pytest.importorskip("numpy")
    height, width = 21, 17
    dem = np.array([[(i * j * 37) % 101 + 3.0 * i for j in range(width)] for i in range(height)])
    step_y = 0.005 * 111000.0
    dy, dx = np.gradient(dem, step_y, step_y * math.cos(math.radians(27.7)))
    slope = np.degrees(np.arctan(np.sqrt(dx**2 + dy**2)))
    aspect = (np.degrees(np.arctan2(-dx, dy)) + 360) % 360
    cells = spark.createDataFrame([(i, j, float(dem[i, j])) for i in range(height) for j in range(width)], "row int, col int, value double")
    out = spatial.terrain(cells, tile=5).collect()
    assert len(out) == height * width
    for r in out:
        assert r["slope_deg"] == pytest.approx(slope[r["row"], r["col"]], abs=1e-9)
        assert r["aspect_deg"] == pytest.approx(aspect[r["row"], r["col"]], abs=1e-9)


def test_in_ring(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0], [0.0, 0.0]]
    rows = [(1.0, 1.0, True), (2.0, 3.0, False), (3.5, 3.0, True), (5.0, 1.0, False)]
    df = spark.createDataFrame([(x, y, e, ring) for x, y, e in rows], "x double, y double, e boolean, ring array<array<double>>")
    assert all(r["e"] == r["got"] for r in df.select("e", in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("got")).collect())


def test_crowded_zone_cell(spark):
    points = spark.createDataFrame([(i, 1, 11.41 + (i % 10) * 1e-5, 76.69) for i in range(3000)] + [(9999, 1, 12.0, 77.0)], "trip_id long, ordinal int, latitude double, longitude double")
    zones = spark.createDataFrame([("a", 11.41, 76.69, 500.0), ("b", 11.41, 76.73, 2500.0), ("c", 12.0, 77.0, 10.0)], "zone_id string, latitude double, longitude double, radius_meters double")
    out = spatial.zone_crossings(points, zones).groupBy("zone_id").count().collect()
    assert {r["zone_id"]: r["count"] for r in out} == {"a": 3000, "c": 1}


def test_population_scaling(spark):
    values = [180.0, 20.0, 95.0, 40.0]
    rows = [(i, x, *[float(i)] * 6, 1) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "env_id int, " + ", ".join(f"{c} double" for c in preparation.FEATURES[:-1]) + ", landslide_history int")
    mean = sum(values) / 4
    std = math.sqrt(sum((x - mean) ** 2 for x in values) / 4)
    out = preparation.scale(df).orderBy("env_id").collect()
    assert [r["rainfall_mm"] for r in out] == pytest.approx([(x - mean) / std for x in values], abs=1e-12)
    assert [r["landslide_history"] for r in out] == [0.0] * 4  # a constant column stays finite


ROUTES = "trip_id int, ordinal int, route string, distance double, risk double, is_current boolean"


def trip(*risks, current="B"):
    return [(1, i, n, 5.0 + i, float(r), n == current) for i, (n, r) in enumerate(zip("ABC", risks), start=1)]


def test_computed_route_risk(spark):
    df = spark.createDataFrame([(5.0, 30.0), (8.0, 85.0), (6.0, 55.0), (-1.0, 10.0), (1.0, 101.0)], "distance double, risk double")
    out = [(r["risk_score"], r["risk_level"]) for r in routes.with_computed_risk(df).collect()]
    assert out == [(34.0, "LOW"), (84.0, "HIGH"), (56.0, "MEDIUM"), (None, None), (None, None)]


def test_reroute_rules(spark):
    df = spark.createDataFrame(trip(30, 85, 55), ROUTES)
    assert one(routes.safest(df))["safest_route"] == "A"
    assert [one(routes.reroute(df, rule))["recommended_route"] for rule in "ABC"] == ["A", "A", "A"]
    stuck = spark.createDataFrame(trip(90, 85, 75), ROUTES)
    a = one(routes.reroute(stuck, "A"))
    assert (a["rerouted"], a["recommended_route"]) == (False, None)
    assert one(routes.reroute(stuck, "B"))["recommended_route"] == "C"
    calm = spark.createDataFrame(trip(30, 60, 55), ROUTES)
    assert [one(routes.reroute(calm, rule))["recommended_route"] for rule in "ABC"] == ["B", "B", None]
    tie = spark.createDataFrame(trip(50, 85, 50), ROUTES)
    assert one(routes.safest(tie))["safest_route"] == "A"


SIGNALS = [
    ("LOW", "LOW", "LOW", "LOW"), ("MEDIUM", "LOW", "LOW", "MEDIUM"), ("HIGH", "LOW", "LOW", "HIGH"), ("LOW", "HIGH", "LOW", "HIGH"),
    ("LOW", "LOW", "HIGH", "HIGH"), ("HIGH", "HIGH", "LOW", "HIGH"), ("HIGH", "MEDIUM", "HIGH", "HIGH"), (" moderate ", "LOW", "LOW", "MEDIUM"), ("bad", "LOW", "LOW", None),
]


def test_highest_signal(spark):
    df = spark.createDataFrame(SIGNALS, "ml_risk string, image_risk string, route_risk string, expected string")
    assert all(r["overall_risk"] == r["expected"] for r in risk_rules.overall_risk(df).collect())


def test_image_rule_sets(spark):
    df = spark.createDataFrame([(False, True, False), (False, True, True), (False, False, True), (True, False, False), (None, False, False)], "landslide boolean, flooding boolean, road_damage boolean")
    out = df.select(risk_rules.image_level("A").alias("a"), risk_rules.image_level("B").alias("b")).collect()
    assert [r["a"] for r in out] == ["HIGH", "HIGH", "MEDIUM", "HIGH", "LOW"]
    assert [r["b"] for r in out] == ["MEDIUM", "HIGH", "MEDIUM", "HIGH", "LOW"]
    assert [r["risk_score"] for r in risk_rules.image_risk(df).collect()] == [60, 80, 60, 90, 10]


def test_whole_assessment(spark):
    request = spark.createDataFrame([(1, "HIGH", False, True, False)], "trip_id int, ml_risk string, landslide boolean, flooding boolean, road_damage boolean")
    out = one(routes.assess_b(request, spark.createDataFrame(trip(30, 85, 55), ROUTES)))
    assert (out["image_risk"], out["final_risk"], out["alert_level"], out["priority"]) == ("MEDIUM", "HIGH", "CRITICAL", "IMMEDIATE")
    assert out["message"].endswith("Rerouting is recommended.")


def test_invalid_level_can_raise(spark):
    df = spark.createDataFrame([("bad",)], "v string")
    with pytest.raises(Exception, match="invalid level"):
        df.select(levels.require(levels.normal_level(F.col("v")), "invalid level")).collect()


def test_nested_levels(spark):
    cases = [('{"risk_level": "high"}', "HIGH"), ('{"risk": {"final_risk": "Low"}}', "LOW"), ('{"risk": "medium"}', "MEDIUM"), ("high", "HIGH"), ('{"x": 1}', None)]
    df = spark.createDataFrame(cases, "body string, expected string")
    assert all(r["expected"] == r["got"] for r in df.select("expected", risk_rules.nested_level(F.col("body")).alias("got")).collect())


def test_metric_golden_values(spark):
    counts = spark.createDataFrame([(165418, 9013616, 101898, 57948)], "tp long, tn long, fp long, fn long")
    out = one(pixels.with_metrics(counts))
    assert [round(out[m], 5) for m in ("precision", "recall", "iou", "dice")] == [0.61881, 0.74057, 0.50857, 0.67424]


def test_threshold_sweep_equals_direct_counts(spark):
    rows = [(i / 400, int(i * 7 % 5 < 2)) for i in range(401)] + [(t / 20, 1) for t in range(21)]
    df = spark.createDataFrame(rows, "prob double, target int")
    for r in pixels.threshold_counts(df).collect():
        t = r["threshold"]
        assert (r["tp"], r["fp"]) == (sum(p >= t and y == 1 for p, y in rows), sum(p >= t and y == 0 for p, y in rows))
        assert (r["fn"], r["tn"]) == (sum(p < t and y == 1 for p, y in rows), sum(p < t and y == 0 for p, y in rows))


def test_rotation_is_counter_clockwise(spark):
    np = pytest.importorskip("numpy")
    image = np.arange(16).reshape(4, 4)
    df = spark.createDataFrame([(1, i, j, int(image[i, j])) for i in range(4) for j in range(4)], "patch_id int, row int, col int, value int")
    for k in range(4):
        turned = np.rot90(image, k)
        assert all(turned[r["row"], r["col"]] == r["value"] for r in pixels.rotate(df, k, 4, 4).collect())


def test_histogram_edges_and_verdict(spark):
    np = pytest.importorskip("numpy")
    values = [-3.0, 3.0, 3.0001, -3.1, 0.0, 0.6, 2.4, -0.6, 1.2]
    df = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(values)], "sample_id long, band int, pos int, value double")
    got = {r["bin"]: r["n"] for r in drift.histogram(df).collect()}
    expected, _ = np.histogram(values, bins=np.linspace(-3, 3, 11))
    assert [got[i] for i in range(1, 11)] == list(expected)
    assert one(drift.verdict(df, None))["baseline_available"] is False
    out = one(drift.verdict(df, drift.baseline(spark, [0.0, 0.0], [1.0, 1.0])))
    assert out["baseline_available"] and out["drift_detected"] and out["bands"] == 2 and out["sample_count"] == 9
    with pytest.raises(ValueError):
        drift.baseline(spark, [0.0], [1.0, 2.0])


def test_audit_verdict_of_clean_features(raw, spark):
    points = spatial.point_layer(cleaning.clean_table(raw))
    cells = spark.createDataFrame([(name, r, c, 0.5) for name in spatial.LAYER_COLUMNS for r in range(50) for c in range(50)], "layer string, row int, col int, value double")
    grid = Grid(70.0, 40.0, 0.5, 50, 50)
    features = spatial.feature_table(points, cells, grid)
    found = dataset_qa.audit(features, points)
    overall = {r["check_name"]: r["status"] for r in dataset_qa.verdict(found).collect()}
    assert overall["OVERALL"] == "PASS_WITH_WARNINGS"  # the rainfall columns are empty
    ml, meta = ml_tables.feature_projection(features), ml_tables.metadata_projection(features)
    assert one(contracts.summary(contracts.contract(ml, meta, expected=4)))["result"] == "PASS"


def test_gates_raise(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for call in (ml_tables.require_columns, preparation.labelled_check, preparation.training_gate, risk_rules.environment_fields, risk_rules.notification):
        with pytest.raises(ValueError):
            call(df)


def test_rounding_of_large_values(spark):
    rows = [(1e300,), (float(2**60),), (-1e17,), (0.545,), (2.5,), (float("inf"),)]
    out = [r[0] for r in spark.createDataFrame(rows, "x double").select(round_exact(F.col("x"), 2)).collect()]
    assert out == [round(x, 2) if abs(x) < 1e308 else x for (x,) in rows]
