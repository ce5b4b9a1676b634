"""The flagship query: raw incidents to sampled features and risk levels."""

from pyspark.sql import DataFrame, functions as F

from scarpline.functions.levels import open_score_level
from scarpline.operators import spatial


def status_by_level(v) -> DataFrame:
    """Counts of points by extraction status and slope-driven risk level.

    One scan, one broadcast join to the pivoted raster, one partial aggregate.
    """
    points = spatial.point_layer(v("incidents")).select("ordinal", "latitude", "longitude")
    features = spatial.feature_table(points, v("raster_cells"), spatial.DEMO_GRID)
    slope = F.col("slope_deg")
    score = F.when(slope.isNotNull(), F.least(F.lit(100.0), slope * 2.0))
    level = F.coalesce(open_score_level(score), F.lit("UNKNOWN"))
    return features.groupBy("feature_extraction_status", level.alias("risk_level")).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg("elevation_m"), 6).alias("mean_elevation_m")
    )
