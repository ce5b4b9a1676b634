"""Headline plans compile, and both ways of the size-checked joins agree."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bench import HEADLINE
from scarpline.operators import dataset_qa, reports, skew
from scarpline.plans.registry import Inputs, load


@pytest.mark.parametrize("name", HEADLINE)
def test_headline_compiles(spark, sf_dir, name):
    """Without the interpreted fallback a stage that is too large to compile fails."""
    key = "spark.sql.codegen.fallback"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        load()[name].run(Inputs(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(key, before)


ROWS = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 50}", None if i % 7 == 0 else i % 5, i % 11) for i in range(6000)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, k string, j long, x long").cache()


@pytest.mark.parametrize("size", [0, skew.BROADCAST_BYTES])
@pytest.mark.parametrize("null_keys", [False, True])
@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_totals_salted_and_broadcast(table, size, null_keys, keys):
    place = {"id": 0, "k": 1, "j": 2, "x": 3}
    key = lambda r: tuple(r[place[k]] for k in keys)
    sums = defaultdict(int)
    for r in ROWS:
        sums[key(r)] += r[3]
    known = lambda r: null_keys or None not in key(r)
    for worth, least in ((None, -1), (F.col("s") > 500, 500)):
        out = skew.add_totals(table, keys, [F.sum("x").alias("s")], null_keys=null_keys, task_rows=200, worth=worth, broadcast_bytes=size)
        expected = Counter((r, sums[key(r)] if known(r) and sums[key(r)] > least else None) for r in ROWS)
        assert Counter(((r["id"], r["k"], r["j"], r["x"]), r["s"]) for r in out.collect()) == expected


def test_beyond_the_broadcast_size_rows_are_salted(table):
    plan = skew.add_totals(table, ["k"], [F.count(F.lit(1)).alias("n")], task_rows=200, broadcast_bytes=0)
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()
    plan = skew.add_totals(table, ["k"], [F.count(F.lit(1)).alias("n")], task_rows=200)
    assert "_salt" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_salted_and_broadcast(spark, table, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, y long")
    both = [skew.skew_join(table, right, ["k"], how, row_id=["id"], task_rows=300, broadcast_bytes=b).collect() for b in (0, skew.BROADCAST_BYTES)]
    assert Counter(map(tuple, both[0])) == Counter(map(tuple, both[1])) and both[0]


def test_duplicates_with_nulls(spark):
    rows = [("a", None, 1.0), ("a", 1.0, None), ("a", None, 1.0), (None, 0.0, 2.0), (None, -0.0, 2.0), ("b", float("nan"), 2.0), ("b", float("nan"), 2.0)]
    found = {r["detail"]: r["n"] for r in dataset_qa.duplicates(spark.createDataFrame(rows, "landslide_id string, latitude double, longitude double")).collect()}
    assert found == {"duplicate rows": 3, "duplicate ids": 4, "duplicate coordinates": 2}


def test_facts_with_repeats(spark):
    rows = [(1, 9, "c", "k", "old"), (2, 9, "c", "k", "new"), (3, 9, "c", "k", "old"), (4, 9, "c", "k", "old"), (5, 9, None, None, "x"), (6, 9, None, None, "x")]
    out = reports.latest_facts(spark.createDataFrame(rows, "update_id long, owner long, category string, fact_key string, value string")).collect()
    assert {(r["category"], r["value"], r["updated"]) for r in out} == {("c", "old", 3), (None, "x", 5)}
