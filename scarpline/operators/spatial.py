"""Point layers, raster sampling, extents and proximity joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.functions.geo import (
    METRES_PER_DEGREE,
    Grid,
    haversine_m,
    in_ring,
    in_rings,
    leg_meets_rings,
    metres_to_leg,
    point,
    rounded_key,
    valid_lat,
    valid_lon,
)
from scarpline.functions.text import count_true, is_missing, to_number
from scarpline.operators.skew import skew_join

# The demonstration grid, its layers and the target reference system.
DEMO_GRID = Grid(min_x=77.0322, max_y=31.3165, pixel=(89.3639 - 77.0322) / 50, width=50, height=50)
LAYER_COLUMNS = {"ndvi": "ndvi", "elevation": "elevation_m", "slope": "slope_deg", "aspect": "aspect_deg"}
NOT_ATTEMPTED = ("NO_DATA_SOURCE", "NOT_SPATIALLY_MAPPABLE")
TARGET_CRS = "EPSG:4326"
LEG_BLOCK = 10_000  # ordinals of a trip that one window holds
CELL_SLACK = 1e-9  # degrees by which a leg's rows in a column are widened


# --- point layer -----------------------------------------------------------

def exclusion_reason() -> Column:
    """Why a record cannot become a point; NULL when it can. First test wins."""
    lat, lon = F.col("latitude"), F.col("longitude")
    lat_n, lon_n = to_number(lat), to_number(lon)
    return (
        F.when(is_missing(lat), "missing_latitude")
        .when(is_missing(lon), "missing_longitude")
        .when(lat_n.isNull() | lon_n.isNull(), "non_numeric")
        .when(~valid_lat(lat_n), "invalid_latitude")
        .when(~valid_lon(lon_n), "invalid_longitude")
    )


def point_layer(df: DataFrame) -> DataFrame:
    """Records with usable coordinates, plus a Point(lon, lat) geometry."""
    # Missing and unreadable text is NULL here, so two comparisons decide, and
    # the pushed-down filter stays short.
    kept = df.filter((F.abs(to_number(F.col("latitude"))) <= 90) & (F.abs(to_number(F.col("longitude"))) <= 180))
    numeric = kept.withColumns({"latitude": to_number(F.col("latitude")), "longitude": to_number(F.col("longitude"))})
    return numeric.withColumn("geometry", point(F.col("longitude"), F.col("latitude")))


def exclusion_counts(df: DataFrame) -> DataFrame:
    """One row of layer counters; a non-numeric pair adds to both sides."""
    r = df.select("*", exclusion_reason().alias("_reason"))
    reason = F.col("_reason")
    review = F.col("data_quality_status") == "REVIEW_REQUIRED" if "data_quality_status" in df.columns else F.lit(False)
    return r.agg(
        F.count(F.lit(1)).alias("total_input_records"),
        count_true(reason.isNull()).alias("valid_coordinate_records"),
        count_true(reason == "missing_latitude").alias("missing_latitude"),
        count_true(reason == "missing_longitude").alias("missing_longitude"),
        count_true(reason.isin("invalid_latitude", "non_numeric")).alias("invalid_latitude"),
        count_true(reason.isin("invalid_longitude", "non_numeric")).alias("invalid_longitude"),
        count_true(reason.isNotNull()).alias("records_excluded"),
        count_true(reason.isNull() & review).alias("review_required_count"),
    )


def coordinate_order_check(layer: DataFrame, crs: str = TARGET_CRS) -> DataFrame:
    """Violations of X = longitude, Y = latitude, Point type and the CRS."""
    x, y = F.col("geometry.coordinates")[0], F.col("geometry.coordinates")[1]
    return layer.agg(
        count_true(~valid_lon(x)).alias("bad_x"),
        count_true(~valid_lat(y)).alias("bad_y"),
        count_true(F.col("geometry.type") != "Point").alias("not_point"),
        F.lit(0 if crs == TARGET_CRS else 1).alias("bad_crs"),
    )


# --- raster sampling -------------------------------------------------------

def sample_layers(points: DataFrame, cells: DataFrame, grid: Grid, layers=LAYER_COLUMNS, available=None) -> DataFrame:
    """Value and status of the cell under every point, for all layers at once.

    Layers sharing a grid are pivoted to one row per cell, so a point is joined
    once, not once per layer. Points cluster in few cells, so the join is the
    skew-aware one; the optimiser broadcasts the cells where they are small. A
    cell that is given more than once counts with its smallest value.
    """
    present = [name for name in layers if available is None or name in available]
    wide = (
        cells.groupBy(F.col("row").alias("_r"), F.col("col").alias("_c"))
        .pivot("layer", present)
        .agg(F.min("value"))
        .select("_r", "_c", *[F.col(name).alias(f"_{name}") for name in present])
    )
    keyed = points.withColumns({"_r": grid.row_of(F.col("latitude")), "_c": grid.col_of(F.col("longitude"))})
    joined = skew_join(keyed, wide, ["_r", "_c"], "left")
    inside = grid.contains(F.col("_r"), F.col("_c"))
    out = {}
    for name, column in layers.items():
        status_name = f"{name}_status"
        if name not in present:
            out[column], out[status_name] = F.lit(None).cast("double"), F.lit("NO_DATA_SOURCE")
            continue
        value = F.col(f"_{name}")
        nodata = value == F.lit(grid.nodata)
        out[status_name] = (
            F.when(~inside, "OUTSIDE_RASTER").when(value.isNull(), "ERROR").when(nodata, "NODATA").otherwise("EXTRACTED")
        )
        out[column] = F.when(inside & ~nodata, value)
    return joined.withColumns(out).drop("_r", "_c", *[f"_{name}" for name in present])


def rainfall_placeholder(df: DataFrame, has_source: bool = True) -> DataFrame:
    """Rainfall series have no position: NULL values and a status saying so."""
    status = "NOT_SPATIALLY_MAPPABLE" if has_source else "NO_DATA_SOURCE"
    empty = F.lit(None).cast("double")
    return df.withColumns(
        {"rainfall_24h": empty, "rainfall_3d": empty, "rainfall_7d": empty, "rainfall_status": F.lit(status)}
    )


def provenance(sidecars: DataFrame) -> DataFrame:
    """SYNTHETIC_DEMO if any contributing layer says so, else REAL (one row)."""
    any_demo = F.coalesce(F.bool_or(F.col("status") == "SYNTHETIC_DEMO_DATA"), F.lit(False))
    return sidecars.agg(F.when(any_demo, "SYNTHETIC_DEMO").otherwise("REAL").alias("data_source_type"))


def overall_status(statuses: list[Column]) -> Column:
    attempted = F.filter(F.array(*statuses), lambda s: ~s.isin(*NOT_ATTEMPTED))
    extracted = F.size(F.filter(attempted, lambda s: s == "EXTRACTED"))
    tried = F.size(attempted)
    return (
        F.when((extracted == tried) & (tried > 0), "COMPLETE")
        .when(extracted > 0, "PARTIAL")
        .when(tried > 0, "NO_FEATURES")
        .otherwise("NO_DATA_SOURCES")
    )


def feature_table(points: DataFrame, cells: DataFrame, grid: Grid, source_type: Column | str = "SYNTHETIC_DEMO") -> DataFrame:
    """Point layer to feature table: samples, statuses and provenance."""
    sampled = rainfall_placeholder(sample_layers(points, cells, grid))
    statuses = [F.col(f"{name}_status") for name in LAYER_COLUMNS] + [F.col("rainfall_status")]
    tag = F.lit(source_type) if isinstance(source_type, str) else source_type
    return sampled.withColumns({"feature_extraction_status": overall_status(statuses), "data_source_type": tag})


def extraction_summary(features: DataFrame) -> DataFrame:
    """(metric, status, n) for every status column, in one aggregation."""
    columns = [c for c in features.columns if c.endswith("_status") and c != "data_quality_status"] + ["data_source_type"]
    long = features.select(*columns).unpivot([], columns, "metric", "status")
    return long.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"))


# --- extents and integration ----------------------------------------------

def table_extent(df: DataFrame) -> DataFrame:
    """Bounding box from the first columns named like lat / lon."""
    lat = next((c for c in df.columns if "lat" in c.lower()), None)
    lon = next((c for c in df.columns if "lon" in c.lower()), None)
    if lat is None or lon is None:
        raise ValueError("no coordinate columns")
    pairs = df.select(to_number(F.col(lon)).alias("x"), to_number(F.col(lat)).alias("y")).dropna()
    return pairs.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def crs_compatibility(datasets: DataFrame, target: str = TARGET_CRS) -> DataFrame:
    known = F.col("crs").isNotNull() & ~F.col("has_error")
    return datasets.select(
        "dataset_id",
        F.when(known, F.col("crs")).alias("original_crs"),
        F.when(known, F.lit(target)).alias("integration_crs"),
        (known & (F.col("crs") != target)).alias("needs_reprojection"),
    )


def common_extent(datasets: DataFrame) -> DataFrame:
    """Intersection of all boxes: YES with its area, NO, or insufficient_data."""
    boxed = datasets.filter(F.col("min_x").isNotNull() & ~F.col("has_error"))
    edges = boxed.agg(
        F.count(F.lit(1)).alias("boxes"),
        F.max("min_x").alias("min_x"), F.max("min_y").alias("min_y"),
        F.min("max_x").alias("max_x"), F.min("max_y").alias("max_y"),
    )
    overlaps = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))
    verdict = F.when(F.col("boxes") < 2, "insufficient_data").when(overlaps, "YES").otherwise("NO")
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    yes = F.col("overlap") == "YES"
    return edges.withColumn("overlap", verdict).select(
        "boxes", "overlap",
        *[F.when(yes, F.col(c)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")],
        F.when(yes, area).alias("area"),
    )


def integration_status(datasets: DataFrame) -> DataFrame:
    """BLOCKED on any error, REVIEW_REQUIRED without overlap, else READY."""
    errors = datasets.agg(F.coalesce(F.bool_or("has_error"), F.lit(False)).alias("any_error"))
    both = errors.join(F.broadcast(common_extent(datasets).select("overlap")), how="inner")
    status = F.when(F.col("any_error"), "BLOCKED").when(F.col("overlap") == "NO", "REVIEW_REQUIRED").otherwise("READY")
    return both.select("any_error", "overlap", status.alias("status"))


# --- raster algebra --------------------------------------------------------

def window_stats(cells: DataFrame, keys: list[str], nodata: float = -9999.0, size: int = 100) -> DataFrame:
    """min / max / mean of the valid cells in the upper left window."""
    part = cells.filter((F.col("row") < size) & (F.col("col") < size) & (F.col("value") != nodata))
    aggs = [F.min("value").alias("sample_min"), F.max("value").alias("sample_max"), F.avg("value").alias("sample_mean")]
    return part.groupBy(*keys).agg(*aggs) if keys else part.agg(*aggs)


def terrain(cells: DataFrame, pixel_deg: float = 0.005, lat_deg: float = 27.7, tile: int = 256) -> DataFrame:
    """Slope and aspect in degrees by central differences, one-sided at edges.

    The raster is cut into tiles with a one-cell halo, so one shuffle of about
    1 + 4 / tile copies of the data serves both directions: the tile hash also
    satisfies the row and column windows. No task holds a whole row or column.
    """
    step_y = pixel_deg * METRES_PER_DEGREE
    step_x = step_y * math.cos(math.radians(lat_deg))
    r, c = F.col("row"), F.col("col")
    tr, tc = F.floor(r / tile).cast("int"), F.floor(c / tile).cast("int")

    def halo(condition: Column, dr: int, dc: int) -> Column:
        return F.when(condition, F.struct((tr + dr).alias("tr"), (tc + dc).alias("tc"), F.lit(False).alias("own")))

    copies = F.array_compact(
        F.array(
            F.struct(tr.alias("tr"), tc.alias("tc"), F.lit(True).alias("own")),
            halo(r % tile == 0, -1, 0), halo(r % tile == tile - 1, 1, 0),
            halo(c % tile == 0, 0, -1), halo(c % tile == tile - 1, 0, 1),
        )
    )
    tiled = cells.select("row", "col", "value", F.explode(copies).alias("t")).select("row", "col", "value", "t.tr", "t.tc", "t.own")
    tiled = tiled.repartition("tr", "tc")

    def gradient(along: str, across: str, step: float) -> Column:
        w = Window.partitionBy("tr", "tc", across).orderBy(along)
        near = lambda fn, d: F.when(fn(along).over(w) == F.col(along) + d, fn("value").over(w))
        before, after = near(F.lag, -1), near(F.lead, 1)
        return (
            F.when(before.isNotNull() & after.isNotNull(), (after - before) / F.lit(2 * step))
            .when(after.isNotNull(), (after - F.col("value")) / F.lit(step))
            .when(before.isNotNull(), (F.col("value") - before) / F.lit(step))
        )

    slopes = tiled.withColumn("dz_dx", gradient("col", "row", step_x)).withColumn("dz_dy", gradient("row", "col", step_y))
    dx, dy = F.col("dz_dx"), F.col("dz_dy")
    aspect = F.degrees(F.atan2(-dx, dy))
    return slopes.filter("own").select(
        "row", "col",
        F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope_deg"),
        F.pmod(aspect + 360, F.lit(360.0)).alias("aspect_deg"),
    )


def formula_layers(cells: DataFrame) -> DataFrame:
    """Deterministic demonstration layers from the cell indices."""
    ij = F.col("row").cast("bigint") * F.col("col").cast("bigint")
    layers = F.map_from_arrays(
        F.array(*[F.lit(x) for x in LAYER_COLUMNS]),
        F.array(
            (ij % 150 - 50).cast("double") / 100.0,
            (500 + (ij * 10) % 3500).cast("double"),
            ((ij * 5) % 450).cast("double") / 10.0,
            ((ij * 5) % 360).cast("double"),
        ),
    )
    return cells.select("row", "col", F.explode(layers).alias("layer", "value"))


# --- proximity -------------------------------------------------------------

def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def zone_crossings(waypoints: DataFrame, zones: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """(trip_id, zone_id) pairs where a waypoint lies within a zone's circle.

    Zones are expanded to the grid cells their box touches; a waypoint belongs
    to one cell, so candidates come from an equi-join on cells. Crowded cells
    are salted. The exact great-circle test follows the join.
    """
    dlat = F.col("radius_meters") / F.lit(110000.0)
    dlon = dlat / F.cos(F.radians(F.least(F.abs(F.col("latitude")) + dlat, F.lit(89.0))))
    span = lambda c, d: F.sequence(_bucket(c - d, cell_deg), _bucket(c + d, cell_deg))
    z = zones.select(
        "zone_id", F.col("latitude").alias("z_lat"), F.col("longitude").alias("z_lon"), "radius_meters",
        span(F.col("longitude"), dlon).alias("xs"), F.explode(span(F.col("latitude"), dlat)).alias("gy"),
    ).withColumn("gx", F.explode("xs")).drop("xs")
    w = waypoints.select(
        "trip_id", "latitude", "longitude",
        _bucket(F.col("longitude"), cell_deg).alias("gx"), _bucket(F.col("latitude"), cell_deg).alias("gy"),
    )
    near = skew_join(w, z, ["gx", "gy"], "inner")
    distance = haversine_m(F.col("latitude"), F.col("longitude"), F.col("z_lat"), F.col("z_lon"))
    return near.filter(distance <= F.col("radius_meters")).select("trip_id", "zone_id").distinct()


def crossings_per_trip(waypoints: DataFrame, zones: DataFrame, whole_way: bool = False) -> DataFrame:
    """Number of zones each trip crosses, at its waypoints or on its whole way; trips without any are kept."""
    met = route_crossings(waypoints, zones) if whole_way else zone_crossings(waypoints, zones)
    counts = met.groupBy("trip_id").agg(F.count(F.lit(1)).alias("zones_crossed"))
    trips = waypoints.select("trip_id").distinct()
    return trips.join(counts, "trip_id", "left").select("trip_id", F.coalesce("zones_crossed", F.lit(0)).alias("zones_crossed"))


def polygon_hits(waypoints: DataFrame, polygons: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """(trip_id, zone_id) pairs where a waypoint lies inside a zone polygon.

    ``polygons`` carries ``rings``; the first ring is the outline.
    """
    ring = F.col("ring")
    z = polygons.select("zone_id", F.col("rings")[0].alias("ring"))
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    span = lambda a: F.sequence(_bucket(F.array_min(a), cell_deg), _bucket(F.array_max(a), cell_deg))
    z = z.select("zone_id", "ring", F.explode(span(xs)).alias("gx"), span(ys).alias("gys"))
    z = z.select("zone_id", "ring", "gx", F.explode("gys").alias("gy"))
    w = waypoints.select(
        "trip_id", "latitude", "longitude",
        _bucket(F.col("longitude"), cell_deg).alias("gx"), _bucket(F.col("latitude"), cell_deg).alias("gy"),
    )
    near = skew_join(w, z, ["gx", "gy"], "inner")
    return near.filter(in_ring(F.col("longitude"), F.col("latitude"), ring)).select("trip_id", "zone_id").distinct()


def legs(waypoints: DataFrame, block: int = LEG_BLOCK) -> DataFrame:
    """(trip_id, ordinal, lat1, lon1, lat2, lon2): the way from each waypoint to the next of its trip.

    The last waypoint is a leg without length, so a trip of one waypoint has
    one. Waypoints without a position are skipped; equal ordinals follow each
    other by position. A trip is cut into blocks of ordinals, so that one of
    any length stays spread; the first waypoint of a block ends the last leg of
    the block before.
    """
    order, place = ["ordinal", "latitude", "longitude"], F.struct("latitude", "longitude")
    known = waypoints.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("trip_id", *order)
    known = known.withColumn("_block", F.coalesce(F.floor(F.col("ordinal") / F.lit(block)), F.lit(-(1 << 40))))
    inside = Window.partitionBy("trip_id", "_block").orderBy(*order)
    firsts = known.groupBy(F.col("trip_id").alias("_trip"), F.col("_block").alias("_b")).agg(F.min_by(place, F.struct(*order)).alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("_trip").orderBy("_b"))).drop("_first")
    joined = known.withColumn("_next", F.lead(place).over(inside)).join(firsts, F.col("trip_id").eqNullSafe(F.col("_trip")) & (F.col("_block") == F.col("_b")))
    end = F.coalesce("_next", "_after", place)
    return joined.select(
        "trip_id", "ordinal", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"),
        end["latitude"].alias("lat2"), end["longitude"].alias("lon2"),
    )


def leg_cells(trip_legs: DataFrame, cell_deg: float) -> DataFrame:
    """Every grid cell that a leg touches, as ``gx``, ``gy``: column by column the rows that it passes there."""
    west, east = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    columns = trip_legs.withColumn("gx", F.explode(F.sequence(_bucket(west, cell_deg), _bucket(east, cell_deg))))
    slope = F.when(F.col("lon2") != F.col("lon1"), (F.col("lat2") - F.col("lat1")) / (F.col("lon2") - F.col("lon1")))
    at = lambda x: F.col("lat1") + slope * (x - F.col("lon1"))
    left, right = F.greatest(west, F.col("gx") * F.lit(cell_deg)), F.least(east, (F.col("gx") + 1) * F.lit(cell_deg))
    low = F.coalesce(F.least(at(left), at(right)), F.least("lat1", "lat2")) - F.lit(CELL_SLACK)
    high = F.coalesce(F.greatest(at(left), at(right)), F.greatest("lat1", "lat2")) + F.lit(CELL_SLACK)
    return columns.withColumn("gy", F.explode(F.sequence(_bucket(low, cell_deg), _bucket(high, cell_deg))))


def _box_cells(boxes: DataFrame, cell_deg: float) -> DataFrame:
    """Every grid cell of a box (west, south, east, north)."""
    rows = boxes.withColumn("gy", F.explode(F.sequence(_bucket(F.col("south"), cell_deg), _bucket(F.col("north"), cell_deg))))
    return rows.withColumn("gx", F.explode(F.sequence(_bucket(F.col("west"), cell_deg), _bucket(F.col("east"), cell_deg))))


def _legs_near(trip_legs: DataFrame, boxes: DataFrame, cell_deg: float) -> DataFrame:
    """(leg, zone columns) whose boxes overlap, once for each cell that both touch."""
    near = skew_join(leg_cells(trip_legs, cell_deg), _box_cells(boxes, cell_deg), ["gx", "gy"], "inner")
    overlap = (
        (F.greatest("lon1", "lon2") >= F.col("west")) & (F.least("lon1", "lon2") <= F.col("east"))
        & (F.greatest("lat1", "lat2") >= F.col("south")) & (F.least("lat1", "lat2") <= F.col("north"))
    )
    return near.filter(overlap)


def route_crossings(waypoints: DataFrame, zones: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """(trip_id, zone_id) pairs where any part of a trip's way lies within a zone's circle.

    Unlike ``zone_crossings`` this also finds legs that pass through a zone
    without a waypoint in it. Legs are listed in the grid cells they touch and
    zones in those of their box; the exact distance from centre to leg decides.
    Zones without a centre or radius are met by no way.
    """
    dlat = F.col("radius_meters") / F.lit(110000.0)
    dlon = dlat / F.cos(F.radians(F.least(F.abs(F.col("z_lat")) + dlat, F.lit(89.0))))
    z = zones.select("zone_id", F.col("latitude").alias("z_lat"), F.col("longitude").alias("z_lon"), "radius_meters")
    z = z.filter("z_lat IS NOT NULL AND z_lon IS NOT NULL AND radius_meters >= 0")
    z = z.withColumns({"west": F.col("z_lon") - dlon, "east": F.col("z_lon") + dlon, "south": F.col("z_lat") - dlat, "north": F.col("z_lat") + dlat})
    near = _legs_near(legs(waypoints), z, cell_deg)
    distance = metres_to_leg(*[F.col(c) for c in ("z_lat", "z_lon", "lat1", "lon1", "lat2", "lon2")])
    return near.filter(distance <= F.col("radius_meters")).select("trip_id", "zone_id").distinct()


def route_polygon_crossings(waypoints: DataFrame, polygons: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """(trip_id, zone_id) pairs where a trip's way enters, leaves, touches or stays in a zone polygon.

    ``polygons`` carries ``rings``: the outline and any holes. A way that stays
    inside a hole does not cross. Only boxes are dealt to grid cells; the rings
    join the candidates once. Polygons without rings are met by no way.
    """
    corners = F.transform("rings", lambda ring: F.struct(
        F.array_min(F.transform(ring, lambda p: p[0])).alias("w"), F.array_max(F.transform(ring, lambda p: p[0])).alias("e"),
        F.array_min(F.transform(ring, lambda p: p[1])).alias("s"), F.array_max(F.transform(ring, lambda p: p[1])).alias("n"),
    ))
    z = polygons.select("zone_id", "rings").filter("size(rings) > 0")
    outline = z.withColumn("box", corners).select(
        "zone_id", F.array_min("box.w").alias("west"), F.array_max("box.e").alias("east"), F.array_min("box.s").alias("south"), F.array_max("box.n").alias("north")
    )
    near = _legs_near(legs(waypoints), outline.dropna(), cell_deg).select("trip_id", "lon1", "lat1", "lon2", "lat2", "zone_id").distinct()
    whole = skew_join(near, z, ["zone_id"], "inner")
    ends = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    hit = leg_meets_rings(*ends, F.col("rings")) | in_rings(*ends[:2], F.col("rings"))
    return whole.filter(hit).select("trip_id", "zone_id").distinct()


def near_presets(points: DataFrame, presets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Points within the tolerance box of a preset, by banded equi-join.

    Buckets are as wide as the tolerance, so a preset is listed in the 3 x 3
    buckets around it and every match is found exactly once.
    """
    around = lambda c: F.sequence(_bucket(c, tolerance) - 1, _bucket(c, tolerance) + 1)
    p = presets.select(
        "preset_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"),
        F.explode(around(F.col("latitude"))).alias("gy"), around(F.col("longitude")).alias("xs"),
    ).withColumn("gx", F.explode("xs")).drop("xs")
    w = points.withColumns({"gx": _bucket(F.col("longitude"), tolerance), "gy": _bucket(F.col("latitude"), tolerance)})
    near = skew_join(w, p, ["gx", "gy"], "inner")
    close = (F.abs(F.col("latitude") - F.col("p_lat")) < tolerance) & (F.abs(F.col("longitude") - F.col("p_lon")) < tolerance)
    return near.filter(close).drop("gx", "gy", "p_lat", "p_lon")


def grid_keys(points: DataFrame, digits: int = 4) -> DataFrame:
    """Distinct rounded coordinates with the number of points on each."""
    keys = rounded_key(F.col("latitude"), F.col("longitude"), digits)
    return points.select(*keys).groupBy("lat_key", "lon_key").agg(F.count(F.lit(1)).alias("n"))
