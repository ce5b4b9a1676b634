"""Model training, scoring and evaluation."""

from pyspark.sql import functions as F

from scarpline.operators import models, preparation as prep
from scarpline.plans.pixel_queries import r6, rounded
from scarpline.plans.registry import check_view, query
from scarpline.sources import shared

LABELS = prep.LABELS


def _split(v):
    """Train and test rows, stored once because training reads them many times."""
    rows = shared.store(prep.stratified_split(v("env")), "split")
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


# Rows to score, from the label counts: the split puts ceil(share * n) rows of each label into the test part.
_TEST_ROWS = f"(SELECT CAST(sum(ceil(n * CAST({prep.TEST_SHARE} AS DOUBLE))) AS BIGINT) FROM (SELECT risk_level, count(*) AS n FROM env GROUP BY risk_level) c)"
_FACTS_SQL = f"SELECT {_TEST_ROWS} AS row_count, TRUE AS labels_complete, TRUE AS sums_right, TRUE AS confident, TRUE AS accurate"
ACCURACY_BOUND = 0.8


def _facts(scored):
    """One row of facts that hold for any proper classifier, and whether it is accurate enough."""
    p = F.col("probabilities")
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in sorted(LABELS)])
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bool_and(F.array_sort(F.map_keys(p)) == names).alias("labels_complete"),
        F.bool_and(F.abs(total - 1.0) < 1e-6).alias("sums_right"),
        F.bool_and(F.col("confidence") == F.array_max(F.map_values(p))).alias("confident"),
        (F.avg((F.col("actual") == F.col("risk_level")).cast("double")) >= ACCURACY_BOUND).alias("accurate"),
    )


def _keep():
    return ("env_id", F.col("risk_level").alias("actual"))


@query("random_forest_training", "M1", "env", _FACTS_SQL)
def _(v):
    train, test = _split(v)
    return _facts(models.score(models.train_forest(train), test, keep=_keep()))


@query("boosted_tree_training", "M2", "env", _FACTS_SQL)
def _(v):
    train, test = _split(v)
    return _facts(models.score(models.train_boosted(train), test, keep=_keep()))


_SETTINGS = [(a, b, c) for a in models.GRID["maxIter"] for b in models.GRID["maxDepth"] for c in models.GRID["stepSize"]]


@query(
    "cross_validated_grid", "M4", "",
    " UNION ALL ".join(f"SELECT {i} AS candidate, {a} AS maxIter, {b} AS maxDepth, CAST({c} AS DOUBLE) AS stepSize, TRUE AS good" for i, (a, b, c) in enumerate(_SETTINGS)),
)
def _(v):
    folded = shared.store(prep.stratified_folds(v("env")), "folds")
    _, table = models.grid_search(folded)
    return table.select("candidate", "maxIter", "maxDepth", "stepSize", (F.col("macro_f1") >= 0.6).alias("good"))


@query(
    "label_encoding", "M3", "env",
    "SELECT env_id, CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 END AS label, risk_level AS decoded FROM env",
)
def _(v):
    indexed = models.label_indexer(v("env")).transform(v("env"))
    return indexed.select("env_id", F.col("label").cast("int").alias("label"), models.label_of_index(F.col("label")).alias("decoded"))


@query("label_encoding_expression", "M3", "env", "SELECT env_id, CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 END AS label FROM env")
def _(v):
    return v("env").select("env_id", models.label_index(F.col("risk_level")).alias("label"))


@query(
    "balanced_class_weights", "M1", "env",
    f"SELECT risk_level, {r6('CAST((SELECT count(*) FROM env) AS DOUBLE) / (3 * count(*))', 'weight')}, count(*) AS n FROM env GROUP BY risk_level",
)
def _(v):
    out = models.balanced_weights(v("env")).groupBy("risk_level").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "weight")


@query("batch_scoring", "M6", "env", _FACTS_SQL.replace("TRUE AS accurate", "TRUE AS accurate, TRUE AS unchanged"))
def _(v):
    """Scores of a model that was stored and loaded again, next to those before."""
    train, test = _split(v)
    model, path = models.train_forest(train), shared.folder(v.spark, "forest")
    models.save_forest(model, path)
    scored = models.score(models.load_forest(path), test, keep=_keep())
    before = models.score(model, test).select("env_id", F.col("risk_level").alias("b"))
    same = scored.join(before, "env_id").agg((F.count_if(F.col("risk_level") == F.col("b")) == F.count(F.lit(1))).alias("unchanged"))
    return _facts(scored).join(same)


_RANKED = {f: (i + 1) / 36.0 for i, f in enumerate(prep.FEATURES)}


@query(
    "top_risk_factors", "M8", "env",
    " UNION ALL ".join(
        f"SELECT env_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST({w!r} AS DOUBLE) AS importance FROM env" for f, w in sorted(_RANKED.items(), key=lambda x: -x[1])[:3]
    ),
)
def _(v):
    ranking = v.spark.createDataFrame(list(_RANKED.items()), "feature string, importance double")
    return models.top_factors(ranking, v("env").select("env_id", *[F.col(c).cast("double").alias(c) for c in prep.FEATURES])).drop("factor")


@query("feature_importances", "M8", "", f"SELECT CAST({len(prep.FEATURES)} AS BIGINT) AS features, TRUE AS sum_is_one, TRUE AS none_negative")
def _(v):
    ranking = models.importances(models.train_forest(_split(v)[0]))
    return ranking.agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1.0) < 1e-6).alias("sum_is_one"), F.bool_and(F.col("importance") >= 0).alias("none_negative")
    )


@query("prediction_accuracy", "M9", "predictions", f"SELECT {r6('avg(CASE WHEN actual = predicted_a THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM predictions")
def _(v):
    return rounded(models.accuracy(v("predictions"), "actual", "predicted_a"), "accuracy")


@query(
    "confusion_matrix", "M10", "predictions",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{a}' AS actual, " + ", ".join(f"count(*) FILTER (WHERE predicted_a = '{p}') AS predicted_{p.lower()}" for p in LABELS) + f" FROM predictions WHERE actual = '{a}'"
        for i, a in enumerate(LABELS, start=1)
    ),
)
def _(v):
    return models.confusion_matrix(v("predictions"), "actual", "predicted_a")


def _class_view(col: str) -> str:
    return f"""SELECT c.label, tp, pred, sup, CASE WHEN pred > 0 THEN CAST(tp AS DOUBLE) / CAST(pred AS DOUBLE) ELSE 0 END AS p, CASE WHEN sup > 0 THEN CAST(tp AS DOUBLE) / CAST(sup AS DOUBLE) ELSE 0 END AS r
FROM (SELECT l.label, count(*) FILTER (WHERE actual = l.label AND {col} = l.label) AS tp, count(*) FILTER (WHERE {col} = l.label) AS pred, count(*) FILTER (WHERE actual = l.label) AS sup
  FROM predictions, (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) l(label) GROUP BY l.label) c"""


for _m in ("a", "b"):
    check_view(f"classes_{_m}", "predictions", _class_view(f"predicted_{_m}"))
    check_view(f"scores_{_m}", f"classes_{_m}", f"SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM classes_{_m}")


@query(
    "classification_report", "M11", "scores_a",
    f"""SELECT label AS row, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1')}, sup AS support FROM scores_a
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM scores_a
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(sup) AS BIGINT) FROM scores_a
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6), round(sum(f * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM scores_a""",
)
def _(v):
    return rounded(models.report(v("predictions"), "actual", "predicted_a"), "precision", "recall", "f1")


@query(
    "model_comparison", "M12", "scores_a scores_b",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, {r6('sum(tp) / sum(sup)', 'accuracy')}, {r6('avg(p)', 'macro_precision')}, {r6('avg(r)', 'macro_recall')}, {r6('avg(f)', 'macro_f1')} FROM scores_{m}" for m in ("a", "b")
    ),
)
def _(v):
    out = models.compare(v("predictions"), {"a": "predicted_a", "b": "predicted_b"})
    return rounded(out, "accuracy", "macro_precision", "macro_recall", "macro_f1")
