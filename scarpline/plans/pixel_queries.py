"""Patch checks, band statistics, segmentation metrics and drift."""

from pyspark.sql import functions as F

from scarpline.operators import drift, pixels
from scarpline.plans.incident_queries import n
from scarpline.plans.registry import check_view, query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


@query(
    "patch_validation", "I1", "band_values",
    """SELECT sample_id, count(DISTINCT band) AS bands, count(*) AS values, count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS non_finite,
  count(DISTINCT band) = 14 AND count(*) = 64 AND count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) = 0 AS valid
FROM (SELECT sample_id, band, CASE WHEN (sample_id + pos) % 501 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS value FROM band_values) b GROUP BY sample_id""",
)
def _(v):
    broken = F.when((F.col("sample_id") + F.col("pos")) % 501 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return pixels.patch_check(v("band_values").withColumn("value", broken), bands_expected=14, values_expected=64)


@query(
    "mask_validation", "I2", "patch_pixels",
    """SELECT patch_id, count(*) AS pixels, count(*) FILTER (WHERE target NOT IN (0, 1)) AS bad_values, max(row) + 1 AS height, max(col) + 1 AS width,
  max(row) = 7 AND max(col) = 7 AND count(*) = 64 AND count(*) FILTER (WHERE target NOT IN (0, 1)) = 0 AS valid FROM patch_pixels GROUP BY patch_id""",
)
def _(v):
    return pixels.mask_check(v("patch_pixels"), 8, 8)


check_view("band_stats", "band_values", "SELECT band, avg(value) AS mean, stddev_pop(value) AS std FROM band_values GROUP BY band")


@query("band_statistics", "I3", "band_stats", f"SELECT band, {r6('mean', 'mean')}, {r6('std', 'std')} FROM band_stats")
def _(v):
    return rounded(pixels.band_statistics(v("band_values")), "mean", "std")


@query(
    "batch_band_statistics", "I4", "band_values",
    f"""SELECT band, {r6('avg(m)', 'mean')}, {r6('avg(s)', 'std')} FROM (SELECT CAST(floor(sample_id / 16) AS BIGINT) AS b, band, avg(value) AS m, stddev_pop(value) AS s FROM band_values GROUP BY 1, 2) t
GROUP BY band""",
)
def _(v):
    out = pixels.batch_band_statistics(v("band_values"), F.floor(F.col("sample_id") / 16))
    return rounded(out, "mean", "std")


@query(
    "normalised_bands", "I5", "band_values band_stats",
    f"SELECT v.sample_id, v.band, v.pos, {r6('(v.value - s.mean) / s.std', 'value')} FROM band_values v JOIN band_stats s ON v.band = s.band",
)
def _(v):
    bands = v("band_values")
    return rounded(pixels.normalise_bands(bands, pixels.band_statistics(bands)), "value")


@query("horizontal_flip", "I6", "patch_pixels", f"SELECT patch_id, row, 7 - col AS col, {r6('value', 'value')}, target FROM patch_pixels")
def _(v):
    return rounded(pixels.flip(v("patch_pixels"), True, 8, 8), "value")


@query("vertical_flip", "I6", "patch_pixels", f"SELECT patch_id, 7 - row AS row, col, {r6('value', 'value')}, target FROM patch_pixels")
def _(v):
    return rounded(pixels.flip(v("patch_pixels"), False, 8, 8), "value")


@query("quarter_turn", "I6", "patch_pixels", f"SELECT patch_id, 7 - col AS row, row AS col, {r6('value', 'value')}, target FROM patch_pixels")
def _(v):
    return rounded(pixels.rotate(v("patch_pixels"), 1, 8, 8), "value")


def draw(purpose: str, key: str = "patch_id") -> str:
    return f"(CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '-42-{purpose}'), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


@query(
    "random_augmentation", "I7", "patch_pixels",
    f"""+c AS (SELECT *, {draw('flip')} < 0.5 AS f, {draw('axis')} < 0.5 AS h, CASE WHEN {draw('rotate')} < 0.5 THEN CAST(floor({draw('turns')} * 3) AS INT) + 1 ELSE 0 END AS k FROM patch_pixels),
d AS (SELECT *, CASE WHEN f AND NOT h THEN 7 - row ELSE row END AS r, CASE WHEN f AND h THEN 7 - col ELSE col END AS c2 FROM c)
SELECT patch_id, CASE k WHEN 1 THEN 7 - c2 WHEN 2 THEN 7 - r WHEN 3 THEN c2 ELSE r END AS row, CASE k WHEN 1 THEN r WHEN 2 THEN 7 - c2 WHEN 3 THEN 7 - r ELSE c2 END AS col, {r6('value', 'value')}, target FROM d""",
)
def _(v):
    return rounded(pixels.random_augmentation(v("patch_pixels"), 8), "value")


@query(
    "random_validation_split", "I8", "patch_pixels",
    f"SELECT DISTINCT patch_id, CASE WHEN {draw('split')} < CAST(0.2 AS DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM patch_pixels",
)
def _(v):
    return pixels.random_split(v("patch_pixels").select("patch_id").distinct(), "patch_id")


def counts(t: str) -> str:
    return (
        f"{n(f'prob >= {t} AND target = 1')} AS tp, {n(f'prob < {t} AND target = 0')} AS tn, "
        f"{n(f'prob >= {t} AND target = 0')} AS fp, {n(f'prob < {t} AND target = 1')} AS fn"
    )


_E = "CAST(1e-8 AS DOUBLE)"
_BASIC = {
    "precision": f"tp / (CAST(tp + fp AS DOUBLE) + {_E})",
    "recall": f"tp / (CAST(tp + fn AS DOUBLE) + {_E})",
    "specificity": f"tn / (CAST(tn + fp AS DOUBLE) + {_E})",
    "iou": f"tp / (CAST(tp + fp + fn AS DOUBLE) + {_E})",
    "dice": f"2 * tp / (CAST(2 * tp + fp + fn AS DOUBLE) + {_E})",
    "accuracy": f"(tp + tn) / (CAST(tp + tn + fp + fn AS DOUBLE) + {_E})",
}


def metrics(source: str, keep: str = "") -> str:
    inner = ", ".join(f'{e} AS "{m}"' for m, e in _BASIC.items())
    outer = ", ".join(r6(f'"{m}"', f'"{m}"') for m in _BASIC)
    f1 = f'2 * "precision" * "recall" / ("precision" + "recall" + {_E})'
    return f"SELECT {keep}tp, tn, fp, fn, {outer}, {r6(f1, 'f1_score')} FROM (SELECT *, {inner} FROM ({source}) c) m"


_HALF = "CAST(0.5 AS DOUBLE)"


@query("confusion_counts", "I9", "pixels", f"SELECT {counts(_HALF)} FROM pixels")
def _(v):
    return pixels.confusion(v("pixels"))


@query("segmentation_metrics", "I10", "pixels", metrics(f"SELECT {counts(_HALF)} FROM pixels"))
def _(v):
    return rounded(pixels.with_metrics(pixels.confusion(v("pixels"))), *pixels.METRICS)


_SWEEP = f"SELECT t AS threshold, {counts('t')} FROM pixels, (SELECT CAST(i AS DOUBLE) / CAST(20 AS DOUBLE) AS t FROM range(21) AS g(i)) s GROUP BY t"


@query("threshold_sweep", "I11", "pixels", metrics(_SWEEP, "threshold, "))
def _(v):
    return rounded(pixels.threshold_sweep(v("pixels")), *pixels.METRICS)


_FINE = f"SELECT t AS threshold, {counts('t')} FROM pixels, (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS t FROM range(101) AS g(i)) s GROUP BY t"


@query("fine_threshold_sweep", "I11", "pixels", _FINE)
def _(v):
    return pixels.threshold_counts(v("pixels"), steps=100)


@query("best_threshold", "I12", "pixels", metrics(_SWEEP, "threshold, ") + " ORDER BY m.dice DESC, threshold LIMIT 1")
def _(v):
    return rounded(pixels.best_threshold(v("pixels")), *pixels.METRICS)


@query(
    "image_probabilities", "I13", "pixels",
    f"SELECT patch_id, {r6('max(prob)', 'probability')}, {r6('avg(prob)', 'mean_probability')}, {r6('avg(CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END)', 'positive_share')} FROM pixels GROUP BY patch_id",
)
def _(v):
    return rounded(pixels.image_probability(v("pixels")), "probability", "mean_probability", "positive_share")


_ENTROPY = "-avg(CASE WHEN prob > 0 THEN prob * ln(prob) ELSE 0 END + CASE WHEN prob < 1 THEN (1 - prob) * ln(1 - prob) ELSE 0 END)"


@query(
    "confidence_statistics", "I14", "pixels",
    f"SELECT patch_id, {r6('avg(prob)', 'mean')}, {r6('stddev_pop(prob)', 'std')}, {r6('max(prob)', 'max')}, {r6(_ENTROPY, 'entropy')} FROM pixels GROUP BY patch_id",
)
def _(v):
    return rounded(pixels.confidence_statistics(v("pixels")), "mean", "std", "max", "entropy")


@query(
    "batch_dice", "I15", "pixels",
    f"""SELECT count(*) AS batches, {r6('avg(d)', 'dice')} FROM (SELECT 2 * sum(CASE WHEN prob > 0.5 AND target = 1 THEN 1 ELSE 0 END)
  / (CAST(sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END + target) AS DOUBLE) + {_E}) AS d FROM pixels GROUP BY floor(patch_id / 16)) t""",
)
def _(v):
    return rounded(pixels.batch_dice(v("pixels"), F.floor(F.col("patch_id") / 16)), "dice")


_P = "greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), prob))"


@query(
    "loss_metrics", "I16", "pixels",
    f"""SELECT {r6('d', 'dice_loss')}, {r6('b', 'bce_loss')}, {r6('f', 'focal_loss')}, {r6('0.5 * b + 0.5 * d', 'blended_loss')} FROM (
  SELECT 1 - (2 * sum(prob * target) + 1) / (sum(prob) + sum(target) + 1) AS d, avg(-ln(pt)) AS b, avg(w * pow(1 - pt, 2) * -ln(pt)) AS f
  FROM (SELECT prob, target, CASE WHEN target = 1 THEN {_P} ELSE 1 - {_P} END AS pt, CASE WHEN target = 1 THEN 0.25 ELSE 0.75 END AS w FROM pixels) p) t""",
)
def _(v):
    return rounded(pixels.loss_metrics(v("pixels")), "dice_loss", "bce_loss", "focal_loss", "blended_loss")


# --- drift ---------------------------------------------------------------------

check_view(
    "recent", "band_values",
    "SELECT * FROM band_values WHERE sample_id IN (SELECT DISTINCT sample_id FROM band_values ORDER BY sample_id DESC LIMIT 100)",
)
_EDGES = drift.edges()
_BIN = "CASE " + " ".join(
    f"WHEN value >= CAST({a!r} AS DOUBLE) AND value {'<=' if i == drift.BINS else '<'} CAST({b!r} AS DOUBLE) THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]), start=1)
) + " END"
check_view("binned", "recent", f"SELECT band, {_BIN} AS bin FROM recent")
check_view(
    "shares", "binned",
    """SELECT g.band, g.bin, count(b.bin) AS n, CASE WHEN t.total > 0 THEN CAST(count(b.bin) AS DOUBLE) / CAST(t.total AS DOUBLE) ELSE 0 END AS share
FROM (SELECT band, CAST(i + 1 AS INT) AS bin FROM (SELECT DISTINCT band FROM binned) d, range(10) AS r(i)) g
JOIN (SELECT band, count(bin) AS total FROM binned GROUP BY band) t ON t.band = g.band LEFT JOIN binned b ON b.band = g.band AND b.bin = g.bin GROUP BY g.band, g.bin, t.total""",
)
_EXPECTED = "(VALUES " + ", ".join(f"({i}, CAST({e!r} AS DOUBLE))" for i, e in enumerate(drift.expected_shares(), start=1)) + ") e(bin, expected)"
check_view(
    "psi", "shares",
    f"SELECT s.band, sum(((CASE WHEN share = 0 THEN 1e-10 ELSE share END) - expected) * ln((CASE WHEN share = 0 THEN 1e-10 ELSE share END) / expected)) AS psi FROM shares s JOIN {_EXPECTED} ON s.bin = e.bin GROUP BY s.band",
)
check_view(
    "band_drift", "psi recent",
    """SELECT b.band, coalesce(p.psi, 0) AS psi, coalesce(m.mean, 0) AS mean, coalesce(m.std, 1) AS std FROM (SELECT CAST(i AS INT) AS band FROM range(15) AS r(i)) b
LEFT JOIN psi p ON p.band = b.band LEFT JOIN (SELECT band, avg(value) AS mean, stddev_pop(value) AS std FROM recent GROUP BY band) m ON m.band = b.band""",
)


def fifteen_bands(v):
    """A baseline with one band that never receives data."""
    return drift.baseline(v.spark, [0.0] * 15, [1.0] * 15)


@query("observation_window", "D1", "recent", f"SELECT sample_id, band, pos, {r6('value', 'value')} FROM recent")
def _(v):
    return rounded(drift.last_samples(v("band_values")), "value").select("sample_id", "band", "pos", "value")


@query(
    "last_values_per_band", "D1", "band_values",
    f"SELECT sample_id, band, pos, {r6('value', 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sample_id DESC, pos DESC) AS rn FROM band_values) t WHERE rn <= 100",
)
def _(v):
    return rounded(drift.last_values(v("band_values")), "value").select("sample_id", "band", "pos", "value")


@query("band_histogram", "D2", "shares", f"SELECT band, bin, n, {r6('share', 'share')} FROM shares")
def _(v):
    return rounded(drift.histogram(drift.last_samples(v("band_values"))), "share")


@query(
    "expected_against_observed", "D3", "shares",
    f"SELECT s.band, s.bin, {r6('share', 'share')}, {r6('expected', 'expected')} FROM shares s JOIN {_EXPECTED} ON s.bin = e.bin",
)
def _(v):
    observed = drift.histogram(drift.last_samples(v("band_values")))
    joined = observed.join(F.broadcast(drift.expected_table(v.spark)), "bin")
    return rounded(joined.select("band", "bin", "share", "expected"), "share", "expected")


@query("stability_index", "D4", "psi", f"SELECT band, {r6('psi', 'psi')} FROM psi")
def _(v):
    return rounded(drift.psi(drift.histogram(drift.last_samples(v("band_values")))), "psi")


@query("band_drift_report", "D5", "band_drift", f"SELECT band, {r6('psi', 'psi')}, {r6('mean', 'mean')}, {r6('std', 'std')} FROM band_drift")
def _(v):
    return rounded(drift.band_report(v("band_values"), fifteen_bands(v)), "psi", "mean", "std")


@query(
    "drift_verdict", "D5", "band_drift recent",
    """SELECT true AS baseline_available, bool_or(psi > 0.2) AS drift_detected, count(*) AS bands, count(*) FILTER (WHERE psi > 0.2) AS drifting_bands,
  (SELECT count(DISTINCT sample_id) FROM recent) AS sample_count FROM band_drift""",
)
def _(v):
    return drift.verdict(v("band_values"), fifteen_bands(v))


@query(
    "baseline_check", "D6", "band_stats",
    "SELECT count(*) AS bands, count(mean) = count(std) AS lengths_match, count(DISTINCT band) AS distinct_bands FROM band_stats",
)
def _(v):
    return drift.baseline_check(pixels.band_statistics(v("band_values")))
