"""Hand-over contract of the ML tables, as (check_name, passed, n) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from scarpline.functions.text import to_number
from scarpline.operators.dataset_qa import DEMO_MARK, UNMAPPABLE, column_names

# The contract.
FEATURE_ORDER = (
    "landslide_id", "latitude", "longitude", "ndvi", "elevation_m", "slope_deg", "aspect_deg", "data_source_type",
)
NUMERIC = ("latitude", "longitude", "ndvi", "elevation_m", "slope_deg", "aspect_deg")
TEXT = ("landslide_id", "data_source_type")
NAME_RULES = {
    "prediction": ("prediction", "predicted", "forecast", "estimate"),
    "risk": ("risk", "hazard", "danger", "vulnerability"),
    "confidence": ("confidence", "certainty", "probability", "likelihood"),
    "split": ("train", "test", "split", "fold"),
    "scaling": ("scaled", "normalized", "standardized", "zscore"),
}
EXACT_NAME_RULES = {
    "target": ("target", "label", "class", "severity", "risk", "probability"),
    "rainfall": ("rainfall", "rainfall_24h", "rainfall_3d", "rainfall_7d"),
}
HISTORICAL = ("date", "location", "district", "state", "country")


def schema_contract(lists: DataFrame, expected=FEATURE_ORDER) -> DataFrame:
    """Missing, unexpected and misplaced columns per data set.

    ``lists`` holds (dataset_id, position, column_name). The expected list is
    a few names, so it is compared inside one grouped aggregate: no join.
    """
    known = F.col("column_name").isin(*expected)
    order = F.create_map(*[F.lit(x) for pair in ((c, i) for i, c in enumerate(expected, start=1)) for x in pair])
    placed = F.coalesce(order[F.col("column_name")] == F.col("position"), F.lit(False))
    found = lists.groupBy("dataset_id").agg(
        F.count_distinct(F.when(known, F.col("column_name"))).alias("present"),
        F.count_if(~known).alias("unexpected"),
        F.count_if(~placed).alias("misplaced"),
        F.count(F.lit(1)).alias("columns"),
    )
    size = len(expected)
    return found.select(
        "dataset_id",
        (F.lit(size) - F.col("present")).alias("missing"),
        "unexpected",
        ((F.col("misplaced") == 0) & (F.col("columns") == size)).alias("order_matches"),
    )


def type_contract(df: DataFrame, numeric=NUMERIC, text=TEXT) -> DataFrame:
    """Declared type and number of values that do not read as that type."""
    types = {f.name: f.dataType for f in df.schema}
    rows = []
    for name in (*numeric, *text):
        wants_number = name in numeric
        is_number = isinstance(types.get(name), T.NumericType)
        fits = is_number if wants_number else isinstance(types.get(name), T.StringType)
        c = F.col(name)
        unread = F.count_if(c.isNotNull() & to_number(c).isNull()) if wants_number else F.lit(0).cast("bigint")
        rows.append((name, "numeric" if wants_number else "string", fits, unread))
    totals = df.agg(*[unread.alias(name) for name, _, _, unread in rows])
    out = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("expected"), F.lit(fits).alias("passed"), F.col(name).alias("unreadable"))
            for name, kind, fits, _ in rows
        ]
    )
    return totals.select(F.explode(out).alias("f")).select("f.*")


def _result(name: str, n):
    return F.struct(F.lit(name).alias("check_name"), (n == 0).alias("passed"), n.cast("bigint").alias("n"))


def _results(totals: DataFrame, results) -> DataFrame:
    return totals.select(F.explode(F.array(*results)).alias("f")).select("f.*")


def range_contract(df: DataFrame) -> DataFrame:
    """Coordinates in range; a NULL fails."""
    bad = lambda c, hi: F.count_if(~F.coalesce(to_number(F.col(c)).between(-hi, hi), F.lit(False)))
    totals = df.agg(bad("latitude", 90).alias("lat"), bad("longitude", 180).alias("lon"))
    return _results(totals, [_result("latitude in range", F.col("lat")), _result("longitude in range", F.col("lon"))])


def marker_contract(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every row carries the demo mark and the rainfall status."""
    other = lambda c, want: F.count_if(~F.coalesce(F.col(c) == want, F.lit(False)))
    a = features.agg(other("data_source_type", DEMO_MARK).alias("n"))
    b = metadata.agg(other("rainfall_status", UNMAPPABLE).alias("n"))
    return _results(a, [_result("all rows marked as demo", F.col("n"))]).unionByName(
        _results(b, [_result("all rainfall unmappable", F.col("n"))])
    )


def row_count_contract(features: DataFrame, metadata: DataFrame, expected: int | None = None) -> DataFrame:
    a = features.agg(F.count(F.lit(1)).alias("features"))
    b = metadata.agg(F.count(F.lit(1)).alias("metadata"))
    both = a.join(F.broadcast(b), how="inner")
    results = [_result("metadata rows match features", F.abs(F.col("features") - F.col("metadata")))]
    if expected is not None:
        results.insert(0, _result("expected record count", F.abs(F.col("features") - F.lit(expected))))
    return _results(both, results)


def name_contract(lists: DataFrame) -> DataFrame:
    """(rule, dataset_id, column_name) for every forbidden name."""
    name = F.lower("column_name")
    rules = [
        (rule, reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in fragments]))
        for rule, fragments in NAME_RULES.items()
    ] + [(rule, F.col("column_name").isin(*names)) for rule, names in EXACT_NAME_RULES.items()]
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]))
    return lists.select(F.explode(hits).alias("rule"), "dataset_id", "column_name")


def traceability(features: DataFrame, metadata: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Ids on both sides, historical columns kept, a source file present.

    Ids are made distinct before the anti-joins, so hot ids cost one row.
    """
    f = features.select("landslide_id").distinct()
    m = metadata.select("landslide_id").distinct()
    lost = f.join(m, f["landslide_id"].eqNullSafe(m["landslide_id"]), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    out = _results(lost, [_result("ids found in metadata", F.col("n"))])
    gone = [c for c in (*HISTORICAL, "severity") if c not in metadata.columns]
    rows = metadata.agg(F.count(F.lit(1)).alias("rows"))
    out = out.unionByName(_results(rows, [_result("historical columns kept", F.when(F.col("rows") >= 0, F.lit(len(gone))))]))
    if files is not None:
        listed = files.agg(F.when(F.count(F.lit(1)) > 0, 0).otherwise(1).alias("n"))
        out = out.unionByName(_results(listed, [_result("source files present", F.col("n"))]))
    return out


def contract(features: DataFrame, metadata: DataFrame, expected: int | None = None) -> DataFrame:
    """All checks of one feature / metadata pair."""
    lists = column_names(features).withColumn("dataset_id", F.lit(0).cast("bigint"))
    shape = schema_contract(lists)
    parts = [
        _results(
            shape,
            [
                _result("all expected features exist", F.col("missing")),
                _result("no unexpected features", F.col("unexpected")),
                _result("feature order", F.when(F.col("order_matches"), 0).otherwise(1)),
            ],
        ),
        type_contract(features).select(
            F.concat(F.lit("type of "), "column_name").alias("check_name"), "passed", F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("n")
        ),
        range_contract(features),
        marker_contract(features, metadata),
        row_count_contract(features, metadata, expected),
        traceability(features, metadata),
    ]
    names = name_contract(lists).agg(F.count(F.lit(1)).alias("n"))
    parts.append(_results(names, [_result("no forbidden names", F.col("n"))]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("passed")).alias("checks_passed"),
        F.count(F.lit(1)).alias("checks_total"),
        F.when(F.coalesce(F.bool_and("passed"), F.lit(True)), "PASS").otherwise("FAIL").alias("result"),
    )
