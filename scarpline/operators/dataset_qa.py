"""Quality checks on the feature table.

Every check returns (check_name, severity, detail, n) rows and only reports
findings with n > 0. Each is one or two aggregations over the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scarpline.functions.text import count_true, outside, strip, to_iso_date, to_number
from scarpline.operators.spatial import LAYER_COLUMNS
from scarpline.sources import shared

# Columns, ranges and name fragments of the checks.
EXPECTED_COLUMNS = (
    "landslide_id", "date", "latitude", "longitude", "location", "district", "state", "country",
    "source", "source_url", "severity", "description", "data_quality_status",
    "ndvi", "ndvi_status", "rainfall_24h", "rainfall_3d", "rainfall_7d", "rainfall_status",
    "elevation_m", "elevation_status", "slope_deg", "slope_status", "aspect_deg", "aspect_status",
    "feature_extraction_status", "data_source_type",
)
FEATURE_RANGES = {"ndvi": (-1, 1), "elevation_m": (None, None), "slope_deg": (0, None), "aspect_deg": (0, 360)}
IMPORTANT = ("landslide_id", "date", "latitude", "longitude", "ndvi", "elevation_m", "slope_deg", "aspect_deg")
LEAKAGE_FRAGMENTS = (
    "risk", "risk_score", "risk_label", "prediction", "predicted", "model_", "train", "test",
    "split", "scaled", "normalized", "confidence", "probability", "target", "label",
)
EXTRACTION_STATUSES = ("COMPLETE", "PARTIAL", "NO_FEATURES", "REVIEW_REQUIRED")
DEMO_MARK = "SYNTHETIC_DEMO"
UNMAPPABLE = "NOT_SPATIALLY_MAPPABLE"
YEARS = (1900, 2030)
SHOWN_MISMATCHES = 5


Rules = list[tuple[str, str, Column]]


def run_rules(df: DataFrame, check: str, rules: Rules) -> DataFrame:
    """Findings with n > 0 of (severity, detail, aggregate) rules; one pass over the data."""
    return run_checks(df, {check: rules})


def run_checks(df: DataFrame, checks: dict[str, Rules]) -> DataFrame:
    """Findings of several checks of one table in a single aggregate."""
    flat = [(check, *rule) for check, rules in checks.items() for rule in rules]
    totals = df.agg(*[agg.alias(f"r{i}") for i, (*_, agg) in enumerate(flat)])
    rows = F.array(
        *[
            F.struct(
                F.lit(check).alias("check_name"), F.lit(sev).alias("severity"), F.lit(detail).alias("detail"),
                F.col(f"r{i}").cast("bigint").alias("n"),
            )
            for i, (check, sev, detail, _) in enumerate(flat)
        ]
    )
    return totals.select(F.explode(rows).alias("f")).select("f.*").filter("n > 0")


def _schema_findings(df: DataFrame, check: str, rows: list[tuple[str, str, int]]) -> DataFrame:
    """Findings about the column list, which is metadata of the table."""
    schema = "check_name string, severity string, detail string, n bigint"
    return df.sparkSession.createDataFrame([(check, sev, detail, n) for sev, detail, n in rows if n > 0], schema)


def structural(df: DataFrame, expected=EXPECTED_COLUMNS, ignore=("ordinal", "geometry")) -> DataFrame:
    """Empty table, missing or repeated column names, empty columns and rows."""
    data, found = _column_findings(df, expected, ignore)
    return found.unionByName(run_rules(df.select(*data), "structural", _structural_rules(data)))


def _column_findings(df: DataFrame, expected, ignore) -> tuple[list[str], DataFrame]:
    """The columns that can be checked, and findings about the column list."""
    names = [c for c in df.columns if c not in ignore]
    repeated = sorted({c for c in names if names.count(c) > 1})
    missing = [c for c in expected if c not in names]
    found = _schema_findings(
        df, "structural",
        [("WARNING", "missing column " + c, 1) for c in missing] + [("ERROR", "repeated column " + c, 1) for c in repeated],
    )
    return [c for c in names if c not in repeated], found


def _structural_rules(data: list[str]) -> Rules:
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in data])
    rules = [("ERROR", "empty dataset", (F.count(F.lit(1)) == 0).cast("bigint"))]
    rules += [
        ("WARNING", "empty column " + c, ((F.count(c) == 0) & (F.count(F.lit(1)) > 0)).cast("bigint")) for c in data
    ]
    rules.append(("WARNING", "empty rows", count_true(all_null)))
    return rules


def ids(df: DataFrame) -> DataFrame:
    """Missing ids, and repeats counted from the second occurrence on."""
    groups = df.groupBy("landslide_id").agg(F.count(F.lit(1)).alias("m"))
    return run_rules(
        groups, "ids",
        [
            ("ERROR", "missing landslide_id", F.sum(F.when(F.col("landslide_id").isNull(), F.col("m")))),
            ("ERROR", "duplicate landslide_id", F.sum(F.col("m") - 1)),
        ],
    )


def duplicated_ids(df: DataFrame) -> DataFrame:
    groups = df.groupBy("landslide_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.filter((F.col("n") > 1) & F.col("landslide_id").isNotNull())


def dates(df: DataFrame, years=YEARS) -> DataFrame:
    return run_rules(df, "dates", _date_rules(years))


def _date_rules(years=YEARS) -> Rules:
    d = to_iso_date(F.col("date"))
    year = F.year(d)
    return [
        ("WARNING", "missing date", count_true(F.col("date").isNull())),
        ("ERROR", "invalid date", count_true(F.col("date").isNotNull() & d.isNull())),
        ("WARNING", f"before year {years[0]}", count_true(year < years[0])),
        ("WARNING", f"after year {years[1]}", count_true(year > years[1])),
    ]


def coordinates(df: DataFrame) -> DataFrame:
    return run_rules(df, "coordinates", _coordinate_rules())


def _coordinate_rules() -> Rules:
    rules = []
    for field, (low, high) in {"latitude": (-90, 90), "longitude": (-180, 180)}.items():
        c, number = F.col(field), to_number(F.col(field))
        rules += [
            ("ERROR", f"non-numeric {field}", count_true(c.isNotNull() & number.isNull())),
            ("WARNING", f"missing {field}", count_true(c.isNull())),
            ("ERROR", f"{field} out of range", count_true(outside(number, low, high))),
        ]
    return rules


def layer_match(table: DataFrame, layer: DataFrame, key: str = "ordinal", tolerance: float = 1e-10) -> DataFrame:
    """Table and point layer compared record by record on a unique key."""
    t = table.select(key, F.lit(True).alias("in_table"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"))
    xy = F.col("geometry.coordinates")
    g = layer.select(
        key, F.lit(True).alias("in_layer"), F.col("geometry.type").alias("g_type"), xy[1].alias("g_lat"), xy[0].alias("g_lon")
    )
    both = t.join(g, key, "full")
    return both.select("*", coordinate_differs(tolerance).alias("differs"))


def coordinate_differs(tolerance: float) -> Column:
    present = F.col("in_table") & F.col("in_layer") & (F.col("g_type") == "Point")
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance, F.lit(True))
    return F.coalesce(present & (off("g_lat", "t_lat") | off("g_lon", "t_lon")), F.lit(False))


def spatial_match(table: DataFrame, layer: DataFrame, key: str = "ordinal", crs: str = "EPSG:4326") -> DataFrame:
    both = layer_match(table, layer, key)
    known_crs = "EPSG:4326" in crs or "CRS84" in crs
    rows = F.count("in_table") - F.count("in_layer")
    return run_rules(
        both, "spatial_match",
        [
            ("WARNING", "record count difference", F.abs(rows)),
            ("ERROR", "non-Point geometry", count_true(F.col("in_layer") & (F.col("g_type") != "Point"))),
            ("WARNING", "unexpected CRS", F.lit(0 if known_crs else 1)),
            ("WARNING", "coordinate mismatch", count_true(F.col("differs"))),
        ],
    )


def first_mismatches(table: DataFrame, layer: DataFrame, key: str = "ordinal", shown: int = SHOWN_MISMATCHES) -> DataFrame:
    """The report shows only the first few mismatching records."""
    return layer_match(table, layer, key).filter("differs").select(key, "t_lat", "t_lon", "g_lat", "g_lon").orderBy(key).limit(shown)


def feature_ranges(df: DataFrame, ranges=FEATURE_RANGES) -> DataFrame:
    return run_rules(df, "feature_ranges", _range_rules(ranges))


def _range_rules(ranges=FEATURE_RANGES) -> Rules:
    rules = []
    for field, (low, high) in ranges.items():
        c, number = F.col(field), to_number(F.col(field))
        rules.append(("ERROR", f"non-numeric {field}", count_true(c.isNotNull() & number.isNull())))
        rules.append(("ERROR", f"infinite {field}", count_true(F.abs(number) == F.lit(float("inf")))))
        if low is not None:
            rules.append(("ERROR", f"{field} below {low}", count_true(number < low)))
        if high is not None:
            rules.append(("ERROR", f"{field} above {high}", count_true(number > high)))
    return rules


def status_consistency(df: DataFrame, layers=LAYER_COLUMNS) -> DataFrame:
    """EXTRACTED without a value; a value under a failed status is allowed."""
    return run_rules(df, "status_consistency", _status_rules(layers))


def _status_rules(layers=LAYER_COLUMNS) -> Rules:
    return [
        (
            "WARNING", f"{value} extracted but missing",
            count_true((F.upper(strip(F.col(f"{name}_status"))) == "EXTRACTED") & F.col(value).isNull()),
        )
        for name, value in layers.items()
    ]


def missing_statistics(df: DataFrame, fields=IMPORTANT) -> DataFrame:
    """(feature, total, valid, missing, missing_pct) of the present fields."""
    present = [f for f in fields if f in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(f).alias(f) for f in present])
    long = totals.unpivot(["total"], present, "feature", "valid")
    share = (F.col("total") - F.col("valid")).cast("double") / F.col("total").cast("double") * 100.0
    pct = F.when(F.col("total") > 0, F.bround(share, 2)).otherwise(0.0)
    return long.select("feature", "total", "valid", (F.col("total") - F.col("valid")).alias("missing"), pct.alias("missing_pct"))


def duplicates(df: DataFrame, ignore=("ordinal", "geometry")) -> DataFrame:
    """Repeated rows, ids and coordinate pairs, counted from the second copy on.

    Every row gives one key of each kind, so the table is read and grouped
    once. A row's key is the digest of its JSON text, in which a missing value
    has no field; coordinates count only where both are present.
    """
    plain = lambda f: F.col(f.name) + F.lit(0.0) if f.dataType.typeName() in ("double", "float") else F.col(f.name)  # -0.0 is 0.0
    columns = [plain(f).alias(f.name) for f in df.schema if f.name not in ignore]
    place = F.concat_ws("|", F.col("latitude") + F.lit(0.0), F.col("longitude") + F.lit(0.0))
    keys = [
        F.sha2(F.to_json(F.struct(*columns)), 256), F.col("landslide_id").cast("string"),
        F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place),
    ]
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate(keys)])
    groups = df.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("m"))
    extra = lambda i, need_all: F.sum(F.when((F.col("kind") == i) & (F.col("key").isNotNull() | F.lit(not need_all)), F.col("m") - 1))
    rules = [("duplicate rows", False), ("duplicate ids", False), ("duplicate coordinates", True)]
    return run_rules(groups, "duplicates", [("WARNING", detail, extra(i, need)) for i, (detail, need) in enumerate(rules)])


def provenance(df: DataFrame, mark: str = DEMO_MARK) -> DataFrame:
    return run_rules(df, "provenance", _provenance_rules(mark)).unionByName(_other_marks(df, mark))


def _provenance_rules(mark: str = DEMO_MARK) -> Rules:
    marked, rows = count_true(F.col("data_source_type") == mark), F.count(F.lit(1))
    return [
        ("WARNING", "no record is marked", F.when(marked == 0, rows)),
        ("WARNING", "records without the mark", F.when(marked > 0, rows - marked)),
        *[("INFO", f"missing {c}", count_true(F.col(c).isNull())) for c in ("source", "source_url", "description")],
    ]


def _other_marks(df: DataFrame, mark: str = DEMO_MARK) -> DataFrame:
    other = F.coalesce("data_source_type", F.lit("(missing)"))
    values = df.filter(other != mark).groupBy(other.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return values.select(
        F.lit("provenance").alias("check_name"), F.lit("INFO").alias("severity"),
        F.concat(F.lit("other value "), F.col("v")).alias("detail"), "n",
    )


def id_differences(table: DataFrame, layer: DataFrame) -> DataFrame:
    """(side, landslide_id) for ids found on one side only.

    Distinct first, so a repeated id is one row before the anti-joins.
    """
    left = table.select("landslide_id").dropna().distinct()
    right = layer.select("landslide_id").dropna().distinct()
    only = lambda a, b, side: a.join(b, "landslide_id", "left_anti").select(F.lit(side).alias("side"), "landslide_id")
    return only(left, right, "table").unionByName(only(right, left, "layer"))


def extraction_consistency(df: DataFrame, layers=LAYER_COLUMNS) -> DataFrame:
    return run_rules(df, "extraction_status", _extraction_rules(layers))


def _extraction_rules(layers=LAYER_COLUMNS) -> Rules:
    status = F.upper(strip(F.col("feature_extraction_status")))
    extracted = F.size(F.filter(F.array(*[F.col(f"{x}_status") for x in layers]), lambda s: F.upper(strip(s)) == "EXTRACTED"))
    whole = len(layers)
    wrong = (
        ((status == "COMPLETE") & (extracted < whole))
        | ((status == "PARTIAL") & extracted.isin(0, whole))
        | ((status == "NO_FEATURES") & (extracted > 0))
    )
    unexpected = F.count_distinct(F.when(~status.isin(*EXTRACTION_STATUSES), status))
    return [("WARNING", "unexpected status values", unexpected), ("WARNING", "inconsistent records", count_true(wrong))]


def rainfall(df: DataFrame, mark: str = UNMAPPABLE) -> DataFrame:
    return run_rules(df, "rainfall", _rainfall_rules(mark))


def _rainfall_rules(mark: str = UNMAPPABLE) -> Rules:
    marked, rows = count_true(F.col("rainfall_status") == mark), F.count(F.lit(1))
    return [
        ("WARNING", "no record is marked", F.when(marked == 0, rows)),
        ("WARNING", "records without the mark", F.when(marked > 0, rows - marked)),
        *[("INFO", f"values in {c}", F.count(c)) for c in ("rainfall_24h", "rainfall_3d", "rainfall_7d")],
    ]


def names_with_fragments(names: DataFrame, fragments, column: str = "column_name") -> DataFrame:
    """Names that contain any fragment, each reported once."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(column)), F.lit(x)) for x in fragments])
    return names.filter(hit).distinct()


def column_names(df: DataFrame) -> DataFrame:
    """The column list of a table as rows."""
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("column_name", T.StringType())])
    return df.sparkSession.createDataFrame(list(enumerate(df.columns, start=1)), schema)


def leakage(names: DataFrame, fragments=LEAKAGE_FRAGMENTS) -> DataFrame:
    return names_with_fragments(names, fragments)


def verdict(findings: DataFrame) -> DataFrame:
    """Status per check and overall: FAIL, PASS_WITH_WARNINGS or PASS.

    A check that is absent from the findings has passed.
    """
    ranks = F.when(F.col("severity") == "ERROR", 3).when(F.col("severity") == "WARNING", 2).otherwise(1)
    status = lambda r: F.when(r == 3, "FAIL").when(r == 2, "PASS_WITH_WARNINGS").otherwise("PASS")
    graded = findings.withColumn("rank", ranks)
    per_check = graded.groupBy(F.col("check_name")).agg(
        status(F.max("rank")).alias("status"), count_true(F.col("rank") == 3).alias("errors"), count_true(F.col("rank") == 2).alias("warnings")
    )
    overall = graded.agg(
        F.lit("OVERALL").alias("check_name"), status(F.coalesce(F.max("rank"), F.lit(1))).alias("status"),
        count_true(F.col("rank") == 3).alias("errors"), count_true(F.col("rank") == 2).alias("warnings"),
    )
    return per_check.unionByName(overall)


def audit(table: DataFrame, layer: DataFrame, key: str = "ordinal") -> DataFrame:
    """All findings of a feature table against its point layer.

    Both are stored first. All row checks are one aggregate over the table;
    only the checks that group or join read it again.
    """
    table, layer = shared.store(table, "audited"), shared.store(layer, "audited-layer")
    data, columns = _column_findings(table, EXPECTED_COLUMNS, ("ordinal", "geometry"))
    row_checks = {
        "structural": _structural_rules(data), "dates": _date_rules(), "coordinates": _coordinate_rules(),
        "feature_ranges": _range_rules(), "status_consistency": _status_rules(), "provenance": _provenance_rules(),
        "extraction_status": _extraction_rules(), "rainfall": _rainfall_rules(),
    }
    parts = [columns, run_checks(table, row_checks), _other_marks(table), ids(table), spatial_match(table, layer, key), duplicates(table)]
    differences = id_differences(table, layer).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    parts.append(
        differences.select(
            F.lit("cross_dataset").alias("check_name"), F.lit("WARNING").alias("severity"),
            F.concat(F.lit("ids only in "), F.col("side")).alias("detail"), "n",
        )
    )
    leaking = leakage(column_names(table)).select("column_name")
    parts.append(
        leaking.select(
            F.lit("leakage").alias("check_name"), F.lit("WARNING").alias("severity"),
            F.concat(F.lit("column "), F.col("column_name")).alias("detail"), F.lit(1).cast("bigint").alias("n"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts)
