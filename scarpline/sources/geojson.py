"""GeoJSON points and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

POLYGON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    ]
)
POINT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]
)


def polygon_rings(c: Column) -> Column:
    """Ring array of a polygon held as GeoJSON text; NULL for other shapes."""
    shape = F.from_json(c, POLYGON)
    return F.when(shape["type"] == "Polygon", shape["coordinates"])


def point_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature text per row with a ``geometry`` struct."""
    props = F.struct(*properties)
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.col("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_points(df: DataFrame, properties: list[str], path: str) -> None:
    """Line-delimited features: every task writes and reads its own part."""
    point_features(df, properties).write.mode("overwrite").text(path)


def write_collections(df: DataFrame, properties: list[str], document: Column, path: str) -> None:
    """FeatureCollection documents, one file each; ``document`` must bound their size."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col("geometry"))
    grouped = df.groupBy(document.alias("_document")).agg(F.collect_list(feature).alias("features"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"))
    texts = grouped.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))
    texts.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_points(spark: SparkSession, path: str, properties: T.StructType, collection: bool = False) -> DataFrame:
    """Properties plus ``x``, ``y`` and ``geometry_type``.

    ``collection=False`` reads line-delimited features and splits by blocks.
    ``collection=True`` reads FeatureCollection documents; each document is one
    record of one task, so it suits small files only.
    """
    feature = T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", properties),
            T.StructField("geometry", POINT),
        ]
    )
    if collection:
        document = T.StructType([T.StructField("features", T.ArrayType(feature))])
        rows = spark.read.schema(document).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    else:
        rows = spark.read.schema(feature).json(path)
    xy = F.col("geometry.coordinates")
    return rows.select("properties.*", xy[0].alias("x"), xy[1].alias("y"), F.col("geometry.type").alias("geometry_type"))
