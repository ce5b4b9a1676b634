"""Training, scoring and evaluation of tabular risk models with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scarpline.operators import boosting
from scarpline.operators.preparation import FEATURES, LABELS, SEED, TARGET

# Training settings.
FOREST_TREES = 100
TASK_ROWS = 250_000  # training rows of a task of a forest, each held with its weight in every tree
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE = 100, 3, 0.1
FOLDS = 3
GRID = {"maxIter": (50, 100), "maxDepth": (2, 3), "stepSize": (0.05, 0.1)}
TOP_FACTORS = 3
FEATURE_NAMES = {
    "rainfall_mm": "Rainfall", "soil_moisture_pct": "Soil Moisture", "slope_deg": "Slope",
    "elevation_m": "Elevation", "temperature_c": "Temperature", "river_level_m": "River Level",
    "vegetation_index": "Vegetation Index", "landslide_history": "Landslide History",
}


# --- training ------------------------------------------------------------------------


def label_index(label: Column, labels=None) -> Column:
    """Index of a label in alphabetical order, as an expression."""
    ordered = sorted(labels or LABELS)
    out = None
    for i, name in enumerate(ordered):
        out = F.when(label == name, i) if out is None else out.when(label == name, i)
    return out


def label_of_index(index: Column, labels=None) -> Column:
    ordered = sorted(labels or LABELS)
    return F.element_at(F.array(*[F.lit(x) for x in ordered]), index.cast("int") + 1)


def label_indexer(df: DataFrame, label: str = TARGET):
    """Fitted alphabetical indexer; invalid labels fail the job."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(df)


def balanced_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Add ``weight`` = n / (k * n_c); one row per class is broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    per_class = counts.join(F.broadcast(totals), how="inner")
    weights = per_class.select(label, (F.col("_all").cast("double") / (F.col("_k") * F.col("_n")).cast("double")).alias("weight"))
    return df.join(F.broadcast(weights), label)


def _assembler(output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol=output)


def train_forest(train: DataFrame, trees: int = FOREST_TREES, seed: int = SEED) -> PipelineModel:
    """Scaled random forest with balanced class weights."""
    indexer = label_indexer(train)
    stages = [
        indexer,
        _assembler("raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, seed=seed, weightCol="weight"),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
    ]
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // TASK_ROWS))
    return Pipeline(stages=stages).fit(balanced_weights(train.select(TARGET, *FEATURES)).repartition(tasks))


def train_boosted(
    train: DataFrame, maxIter: int = BOOST_ROUNDS, maxDepth: int = BOOST_DEPTH, stepSize: float = BOOST_RATE, labels=LABELS
) -> boosting.SoftmaxModel:
    """Jointly boosted trees of all classes, the classes in alphabetical order."""
    setting = boosting.Setting(maxDepth, stepSize)
    ordered = tuple(sorted(labels))
    trained = boosting.train(train, list(FEATURES), label_index(F.col(TARGET), labels), ordered, [setting], maxIter)
    return boosting.model_of(trained, setting, list(FEATURES))


def macro_f1(df: DataFrame, actual: str = TARGET, predicted: str = "predicted", labels=LABELS) -> float:
    """Unweighted mean of the per-class F1 scores (one row to the driver)."""
    row = confusion_counts(df, actual, predicted, labels).first()
    scores = []
    for c in labels:
        size = sum(row[f"{c}|{p}"] for p in labels) + sum(row[f"{a}|{c}"] for a in labels)
        scores.append(2.0 * row[f"{c}|{c}"] / size if size else 0.0)
    return sum(scores) / len(scores)


def grid_search(folded: DataFrame, grid=None, folds: int = FOLDS) -> tuple[boosting.SoftmaxModel, DataFrame]:
    """Cross-validated boosted-tree grid on the ``fold`` column.

    Returns the best model of all rows and one row per setting with its mean
    macro F1. The models of all depths, rates and left-out folds, and those of
    all rows, grow over the same passes, and a model of fewer rounds is the
    beginning of one of more.
    Rows of a fold are scored once for all settings and counted in one
    aggregate. Equal scores take the first setting.
    """
    candidates = [{}]
    for name, values in (grid or GRID).items():
        candidates = [{**c, name: x} for c in candidates for x in values]
    ordered = tuple(sorted(LABELS))
    shapes = list(dict.fromkeys((c["maxDepth"], c["stepSize"]) for c in candidates))
    settings = [boosting.Setting(d, r, fold) for d, r in shapes for fold in (*range(folds), None)]
    label = label_index(F.col(TARGET))
    trained = boosting.train(folded, list(FEATURES), label, ordered, settings, max(c["maxIter"] for c in candidates), F.col("fold"))

    per_fold = []
    for fold in range(folds):
        rows = folded.filter(F.col("fold") == fold).select(TARGET, *FEATURES)
        for i, c in enumerate(candidates):
            setting = boosting.Setting(c["maxDepth"], c["stepSize"], fold)
            scored = boosting.model_of(trained, setting, list(FEATURES)).first(c["maxIter"]).transform(rows)
            rows = scored.withColumnRenamed("predicted", f"p{i}").drop("class_probability")
        names = F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(f"p{i}").alias("predicted")) for i in range(len(candidates))])
        per_fold.append(rows.select(F.lit(fold).alias("fold"), TARGET, F.explode(names).alias("c")).select("fold", TARGET, "c.*"))
    counts = reduce(lambda a, b: a.unionByName(b), per_fold).groupBy("candidate", "fold", TARGET, "predicted").agg(F.count(F.lit(1)).alias("n"))
    table = {(r["candidate"], r["fold"], r[TARGET], r["predicted"]): r["n"] for r in counts.collect()}  # candidates x folds x classes x classes

    def f1(i: int, fold: int, name: str) -> float:
        size = sum(table.get((i, fold, name, p), 0) + table.get((i, fold, p, name), 0) for p in LABELS)
        return 2.0 * table.get((i, fold, name, name), 0) / size if size else 0.0

    means = [sum(f1(i, fold, name) for fold in range(folds) for name in LABELS) / (folds * len(LABELS)) for i in range(len(candidates))]
    rows = [(i, *c.values(), m) for i, (c, m) in enumerate(zip(candidates, means))]
    schema = "candidate int, maxIter int, maxDepth int, stepSize double, macro_f1 double"
    best = candidates[means.index(max(means))]
    whole = boosting.model_of(trained, boosting.Setting(best["maxDepth"], best["stepSize"]), list(FEATURES)).first(best["maxIter"])
    return whole, folded.sparkSession.createDataFrame(rows, schema)


def save_forest(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_forest(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- scoring ---------------------------------------------------------------------------


def score(model: PipelineModel | boosting.SoftmaxModel, df: DataFrame, keep=("env_id",)) -> DataFrame:
    """Label, probability per label and confidence of the predicted label."""
    scored = model.transform(df)
    if isinstance(model, boosting.SoftmaxModel):
        labels, p = model.labels, F.col("class_probability")
    else:
        labels, p = model.stages[-1].getLabels(), vector_to_array("probability")
    staged = scored.withColumn("probabilities", F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p))
    confidence = F.element_at("probabilities", F.col("predicted"))
    return staged.select(*keep, F.col("predicted").alias("risk_level"), "probabilities", confidence.alias("confidence"))


def importances(model: PipelineModel, names=FEATURES) -> DataFrame:
    """(feature, importance) of a fitted forest; one row per feature."""
    trained = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = [(n, float(x)) for n, x in zip(names, trained.featureImportances.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def top_factors(ranking: DataFrame, values: DataFrame, keep=("env_id",), k: int = TOP_FACTORS) -> DataFrame:
    """The k most important features with each row's value, as text.

    The ranking is one row per feature, so only k names reach the rows.
    """
    best = ranking.orderBy(F.desc("importance"), "feature").limit(k).collect()
    factors = F.array(
        *[
            F.struct(
                F.lit(r["feature"]).alias("feature"), F.col(r["feature"]).alias("value"), F.lit(r["importance"]).alias("importance"),
                F.format_string(
                    "%s: %s (model importance %.2f%%).", F.lit(FEATURE_NAMES[r["feature"]]), F.col(r["feature"]).cast("string"), F.lit(r["importance"] * 100)
                ).alias("factor"),
            )
            for r in best
        ]
    )
    return values.select(*keep, F.explode(factors).alias("f")).select(*keep, "f.*")


# --- evaluation --------------------------------------------------------------------------


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, actual: str, predicted: str, labels=LABELS) -> DataFrame:
    """One row of k * k counts: a single partial aggregate over the data."""
    cell = lambda a, p: F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}|{p}")
    return df.agg(*[cell(a, p) for a in labels for p in labels])


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted", labels=LABELS) -> DataFrame:
    """Rows and columns in fixed label order, empty cells as 0."""
    one = confusion_counts(df, actual, predicted, labels)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(a).alias("actual"), *[F.col(f"`{a}|{p}`").alias(f"predicted_{p.lower()}") for p in labels])
            for i, a in enumerate(labels, start=1)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(0.0)


def report(df: DataFrame, actual: str = "actual", predicted: str = "predicted", labels=LABELS) -> DataFrame:
    """Per-class precision, recall, F1, support with the average rows.

    Everything derives from the k * k counts, so the data are read once.
    """
    one = confusion_counts(df, actual, predicted, labels)
    cell = lambda a, p: F.col(f"`{a}|{p}`")
    total = lambda cells: reduce(lambda x, y: x + y, cells)
    staged = one.select(
        *[
            x
            for c in labels
            for x in (
                cell(c, c).alias(f"tp_{c}"),
                total([cell(a, c) for a in labels]).alias(f"pred_{c}"),
                total([cell(c, p) for p in labels]).alias(f"sup_{c}"),
            )
        ]
    )
    scored = staged.select("*", *[_ratio(F.col(f"tp_{c}"), F.col(f"pred_{c}")).alias(f"p_{c}") for c in labels], *[_ratio(F.col(f"tp_{c}"), F.col(f"sup_{c}")).alias(f"r_{c}") for c in labels])
    f1 = lambda c: _ratio(F.col(f"p_{c}") * F.col(f"r_{c}") * 2.0, F.col(f"p_{c}") + F.col(f"r_{c}"))
    scored = scored.select("*", *[f1(c).alias(f"f_{c}") for c in labels], total([F.col(f"sup_{c}") for c in labels]).alias("n"))

    def row(name, p, r, f, support):
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.alias("support"))

    macro = lambda x: total([F.col(f"{x}_{c}") for c in labels]) / float(len(labels))
    weighted = lambda x: _ratio(total([F.col(f"{x}_{c}") * F.col(f"sup_{c}") for c in labels]), F.col("n"))
    right = _ratio(total([F.col(f"tp_{c}") for c in labels]), F.col("n"))
    rows = [row(c, F.col(f"p_{c}"), F.col(f"r_{c}"), F.col(f"f_{c}"), F.col(f"sup_{c}")) for c in labels]
    rows.append(row("accuracy", right, right, right, F.col("n")))
    rows.append(row("macro avg", macro("p"), macro("r"), macro("f"), F.col("n")))
    rows.append(row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n")))
    return scored.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def compare(df: DataFrame, models: dict[str, str], actual: str = "actual") -> DataFrame:
    """Accuracy and macro scores of several prediction columns side by side."""
    parts = []
    for name, column in models.items():
        r = report(df, actual, column)
        picked = r.groupBy().agg(
            F.max(F.when(F.col("row") == "accuracy", F.col("f1"))).alias("accuracy"),
            F.max(F.when(F.col("row") == "macro avg", F.col("precision"))).alias("macro_precision"),
            F.max(F.when(F.col("row") == "macro avg", F.col("recall"))).alias("macro_recall"),
            F.max(F.when(F.col("row") == "macro avg", F.col("f1"))).alias("macro_f1"),
        )
        parts.append(picked.select(F.lit(name).alias("model"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)
