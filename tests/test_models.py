"""Training and scoring invariants on the labelled rows."""

import pytest
from pyspark.sql import functions as F

from scarpline.operators import models, preparation as prep
from scarpline.plans.registry import Inputs
from scarpline.sources import shared


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return shared.store(prep.stratified_split(Inputs(spark, sf_dir)("env")), "split-test")


def check(scored, n):
    out = scored.collect()
    assert len(out) == n
    for r in out:
        assert sum(r["probabilities"].values()) == pytest.approx(1.0, abs=1e-4)
        assert set(r["probabilities"]) == set(prep.LABELS)
        assert r["confidence"] == max(r["probabilities"].values()) == r["probabilities"][r["risk_level"]]


def test_forest_and_boosted_scores(rows):
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    n = test.count()
    forest = models.train_forest(train, trees=20)
    check(models.score(forest, test), n)
    boosted = models.train_boosted(train, maxIter=5)
    scored = models.score(boosted, test, keep=("env_id", F.col("risk_level").alias("actual")))
    check(scored, n)
    assert scored.select(F.avg((F.col("actual") == F.col("risk_level")).cast("double"))).first()[0] > 0.8
    ranking = models.importances(forest)
    assert ranking.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    factors = models.top_factors(ranking, test.select("env_id", *[F.col(c).cast("double").alias(c) for c in prep.FEATURES]))
    assert factors.count() == 3 * n
    assert factors.filter("factor NOT LIKE '%: % (model importance %'").count() == 0


def test_grid_search_covers_the_grid(spark, sf_dir):
    folded = shared.store(prep.stratified_folds(Inputs(spark, sf_dir)("env")), "folds-test")
    best, table = models.grid_search(folded, grid={"maxIter": (1, 2), "maxDepth": (2,)}.copy() | {"stepSize": (0.1,)}, folds=2)
    assert table.count() == 2 and table.filter("macro_f1 > 0.4").count() == 2
    assert len(best.members) == 3


def test_report_handles_absent_classes(spark):
    df = spark.createDataFrame([("LOW", "LOW"), ("LOW", "MEDIUM")], "actual string, predicted string")
    out = {r["row"]: r for r in models.report(df).collect()}
    assert (out["LOW"]["precision"], out["LOW"]["recall"], out["HIGH"]["f1"], out["accuracy"]["f1"]) == (1.0, 0.5, 0.0, 0.5)


def test_weights_join_keeps_the_rows_of_a_label_apart(spark, rows):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = models.balanced_weights(rows)
        plan = weighted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    assert weighted.count() == rows.count()


def test_forest_rows_are_dealt_by_their_number(rows, monkeypatch):
    seen = []

    class Spy:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())

    monkeypatch.setattr(models, "Pipeline", Spy)
    monkeypatch.setattr(models, "TASK_ROWS", 20, raising=False)
    models.train_forest(rows)
    assert seen == [-(-rows.count() // 20)]
