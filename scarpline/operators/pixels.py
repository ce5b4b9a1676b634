"""Pixel-level tables: patch checks, band statistics and segmentation metrics.

Pixels: (patch_id, pixel, prob, target). Bands: (sample_id, band, pos, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.functions.text import count_true

# Fixed values.
EPSILON = 1e-8
MIN_STD = 1e-8
METRICS = ("precision", "recall", "specificity", "f1_score", "iou", "dice", "accuracy")


# --- patches and bands ---------------------------------------------------------


def patch_check(bands: DataFrame, bands_expected: int, values_expected: int) -> DataFrame:
    """Band count, value count and non-finite values per sample."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    per_band = bands.groupBy("sample_id", "band").agg(F.count(F.lit(1)).alias("n"), count_true(~finite).alias("bad"))
    grouped = per_band.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("bands"), F.sum("n").alias("values"), F.sum("bad").alias("non_finite")
    )
    valid = (F.col("bands") == bands_expected) & (F.col("values") == values_expected) & (F.col("non_finite") == 0)
    return grouped.withColumn("valid", valid)


def mask_check(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Mask values must be 0 or 1 and cover the whole patch."""
    grouped = pixels.groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("pixels"), count_true(~F.coalesce(F.col("target").isin(0, 1), F.lit(False))).alias("bad_values"),
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"),
    )
    shape = (F.col("height") == height) & (F.col("width") == width) & (F.col("pixels") == height * width)
    return grouped.withColumn("valid", shape & (F.col("bad_values") == 0))


def band_statistics(bands: DataFrame) -> DataFrame:
    """Mean and population deviation per band; a vanishing deviation becomes 1."""
    stats = bands.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") < MIN_STD, 1.0).otherwise(F.col("std")))


def batch_band_statistics(bands: DataFrame, batch: Column) -> DataFrame:
    """Mean of batch means and mean of batch deviations per band."""
    each = bands.withColumn("_batch", batch).groupBy("_batch", "band").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    stats = each.groupBy("band").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") < MIN_STD, 1.0).otherwise(F.col("std")))


def normalise_bands(bands: DataFrame, statistics: DataFrame) -> DataFrame:
    """(x - mean) / std."""
    joined = bands.join(statistics, "band")
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).select(*bands.columns)


# --- augmentation by index arithmetic --------------------------------------------


def flip(pixels: DataFrame, horizontal: bool, height: int, width: int) -> DataFrame:
    if horizontal:
        return pixels.withColumn("col", width - 1 - F.col("col"))
    return pixels.withColumn("row", height - 1 - F.col("row"))


def rotated(row: Column, col: Column, k: Column, height: int, width: int) -> tuple[Column, Column]:
    """Target (row, col) of k counter-clockwise quarter turns of a square patch."""
    if height != width:
        raise ValueError("per-row turns need square patches")
    last = width - 1
    new_row = F.when(k == 1, last - col).when(k == 2, last - row).when(k == 3, col).otherwise(row)
    new_col = F.when(k == 1, row).when(k == 2, last - col).when(k == 3, last - row).otherwise(col)
    return new_row, new_col


def rotate(pixels: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """k counter-clockwise quarter turns, 0..3."""
    if k not in (0, 1, 2, 3):
        raise ValueError("k must be 0, 1, 2, or 3")
    r, c = F.col("row"), F.col("col")
    targets = {
        0: (r, c),
        1: (width - 1 - c, r),
        2: (height - 1 - r, width - 1 - c),
        3: (c, height - 1 - r),
    }
    new_row, new_col = targets[k]
    return pixels.withColumns({"row": new_row, "col": new_col})


def _draw(key: Column, seed: int, purpose: str) -> Column:
    """A reproducible number in [0, 1) per key: the first 8 hex digits of md5."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}-{purpose}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_augmentation(
    pixels: DataFrame, size: int, seed: int = 42, p_flip: float = 0.5, p_rotate: float = 0.5
) -> DataFrame:
    """Flip and turn each patch with given probabilities, image and mask alike."""
    key = F.col("patch_id")
    flips = _draw(key, seed, "flip") < p_flip
    horizontal = _draw(key, seed, "axis") < 0.5
    turns = F.when(_draw(key, seed, "rotate") < p_rotate, F.floor(_draw(key, seed, "turns") * 3).cast("int") + 1).otherwise(0)
    last = size - 1
    chosen = pixels.withColumns({"_f": flips, "_h": horizontal, "_k": turns})
    row, col = F.col("row"), F.col("col")
    flipped = chosen.withColumns(
        {
            "_r": F.when(F.col("_f") & ~F.col("_h"), last - row).otherwise(row),
            "_c": F.when(F.col("_f") & F.col("_h"), last - col).otherwise(col),
        }
    )
    new_row, new_col = rotated(F.col("_r"), F.col("_c"), F.col("_k"), size, size)
    return flipped.withColumns({"row": new_row, "col": new_col}).drop("_f", "_h", "_k", "_r", "_c")


def random_split(df: DataFrame, key: str, validation_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Row-wise train / validation assignment without a shuffle."""
    return df.withColumn("split", F.when(_draw(F.col(key), seed, "split") < validation_share, "validation").otherwise("train"))


# --- confusion counts and metrics -------------------------------------------------


def confusion(pixels: DataFrame, threshold: float = 0.5, keys=()) -> DataFrame:
    hit = F.col("prob") >= F.lit(float(threshold))
    yes = F.col("target") == 1
    aggs = [
        count_true(hit & yes).alias("tp"), count_true(~hit & ~yes).alias("tn"),
        count_true(hit & ~yes).alias("fp"), count_true(~hit & yes).alias("fn"),
    ]
    return pixels.groupBy(*keys).agg(*aggs) if keys else pixels.agg(*aggs)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Segmentation metrics from tp, tn, fp, fn; epsilon in every denominator."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    basic = counts.withColumns(
        {
            "precision": tp / (tp + fp + EPSILON),
            "recall": tp / (tp + fn + EPSILON),
            "specificity": tn / (tn + fp + EPSILON),
            "iou": tp / (tp + fp + fn + EPSILON),
            "dice": tp * 2.0 / (tp * 2.0 + fp + fn + EPSILON),
            "accuracy": (tp + tn) / (tp + tn + fp + fn + EPSILON),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return basic.withColumn("f1_score", p * 2.0 * r / (p + r + EPSILON))


def threshold_counts(pixels: DataFrame, steps: int = 20) -> DataFrame:
    """Confusion counts at thresholds 0, 1/steps, ..., 1 in one pass.

    Every pixel falls into one bucket: the number of thresholds it reaches.
    (bucket, target) counts are at most 2 * (steps + 2) rows, and a reverse
    running sum over them replaces a scan per threshold.
    """
    p = F.col("prob")
    near = F.floor(p * steps).cast("int")
    reached = lambda i: i.cast("double") / F.lit(float(steps)) <= p
    last = F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1)
    bucketed = pixels.select(F.least(last, F.lit(steps)).alias("bucket"), (F.col("target") == 1).alias("yes"))
    counts = bucketed.groupBy("bucket").agg(count_true(F.col("yes")).alias("pos"), count_true(~F.col("yes")).alias("neg"))
    grid = pixels.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    full = counts.unionByName(grid).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = full.withColumns(
        {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "_p": F.sum("pos").over(whole), "_n": F.sum("neg").over(whole)}
    )
    return run.filter("bucket >= 0").select(
        (F.col("bucket").cast("double") / F.lit(float(steps))).alias("threshold"),
        "tp", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"),
    )


def threshold_sweep(pixels: DataFrame, steps: int = 20) -> DataFrame:
    return with_metrics(threshold_counts(pixels, steps))


def best_threshold(pixels: DataFrame, steps: int = 20) -> DataFrame:
    """The sweep row with the highest Dice; the lowest threshold wins ties."""
    return threshold_sweep(pixels, steps).orderBy(F.desc("dice"), "threshold").limit(1)


def image_probability(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Image probability: the maximum, with mean and positive share beside it."""
    p = F.col("prob")
    return pixels.groupBy("patch_id").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(p))).alias("probability"),
        F.avg(p).alias("mean_probability"),
        F.avg((p > F.lit(float(threshold))).cast("double")).alias("positive_share"),
    )


def confidence_statistics(pixels: DataFrame) -> DataFrame:
    """Mean, deviation, maximum and mean binary entropy per image."""
    p = F.col("prob")
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return pixels.groupBy("patch_id").agg(
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.max(p).alias("max"), (-F.avg(part(p) + part(1 - p))).alias("entropy")
    )


def batch_dice(pixels: DataFrame, batch: Column, threshold: float = 0.5) -> DataFrame:
    """Mean over batches of the Dice of strictly thresholded predictions."""
    hit, yes = (F.col("prob") > threshold).cast("bigint"), F.col("target").cast("bigint")
    each = pixels.groupBy(batch.alias("batch")).agg(F.sum(hit * yes).alias("both"), F.sum(hit + yes).alias("either"))
    dice = each.select((F.col("both").cast("double") * 2.0 / (F.col("either").cast("double") + EPSILON)).alias("dice"))
    return dice.agg(F.count(F.lit(1)).alias("batches"), F.avg("dice").alias("dice"))


def loss_metrics(
    pixels: DataFrame, smooth: float = 1.0, alpha: float = 0.25, gamma: float = 2.0, clamp: float = 1e-6,
    bce_weight: float = 0.5, dice_weight: float = 0.5,
) -> DataFrame:
    """Soft Dice, binary cross entropy, their blend and focal loss as metrics."""
    t = F.col("target").cast("double")
    p = F.greatest(F.lit(clamp), F.least(F.lit(1.0 - clamp), F.col("prob")))
    bce = -(t * F.log(p) + (1 - t) * F.log(1 - p))
    p_t = t * p + (1 - t) * (1 - p)
    weight = t * alpha + (1 - t) * (1 - alpha)
    totals = pixels.agg(
        F.sum(F.col("prob") * t).alias("both"), (F.sum("prob") + F.sum(t)).alias("either"),
        F.avg(bce).alias("bce"), F.avg(weight * F.pow(1 - p_t, gamma) * bce).alias("focal"),
    )
    dice = 1.0 - (F.col("both") * 2.0 + smooth) / (F.col("either") + smooth)
    return totals.select(
        dice.alias("dice_loss"), F.col("bce").alias("bce_loss"), F.col("focal").alias("focal_loss"),
        (F.col("bce") * bce_weight + dice * dice_weight).alias("blended_loss"),
    )
