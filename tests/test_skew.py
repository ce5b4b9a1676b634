"""Skew helpers against brute force, with one key holding a third of all rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scarpline.operators import reports, routes, skew

HOT = 3000


@pytest.fixture(scope="module")
def rows():
    return [(i, None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"k{i % 700}"), i * 7 % 101) for i in range(HOT * 3)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, x long").cache()


def test_heavy_keys_are_few(table):
    heavy = {r["k"]: (r["_n"], r["_salts"]) for r in skew.heavy_keys(table, ["k"], task_rows=500).collect()}
    assert set(heavy) == {"hot", None}
    assert all(n / 500 <= salts < n / 500 + 1 for n, salts in heavy.values())
    assert skew.heavy_keys(table, ["k"]).count() == 0  # at the usual task size


@pytest.mark.parametrize("task_rows", [500, skew.TASK_ROWS])
@pytest.mark.parametrize("null_keys", [False, True])
def test_add_totals(table, rows, task_rows, null_keys):
    counts, sums = Counter(r[1] for r in rows), defaultdict(int)
    for _, k, x in rows:
        sums[k] += x
    out = skew.add_totals(table, ["k"], [F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")], task_rows=task_rows, null_keys=null_keys).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = (None, None) if r["k"] is None and not null_keys else (counts[r["k"]], sums[r["k"]])
        assert (r["n"], r["s"]) == expected


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join(spark, table, rows, how):
    right = [("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)]
    small = spark.createDataFrame(right, "k string, y long")
    matches = defaultdict(list)
    for k, y in right:
        matches[k].append(y)
    out = skew.skew_join(table, small, ["k"], how, row_id=["id"], task_rows=300).collect()
    if how in ("left", "inner"):
        expected = [(i, y) for i, k, _ in rows for y in (matches.get(k) or ([None] if how == "left" else []))]
        assert sorted((r["id"], r["y"] or 0) for r in out) == sorted((i, y or 0) for i, y in expected)
    else:
        wanted = {i for i, k, _ in rows if (k in matches) == (how == "left_semi")}
        assert sorted(r["id"] for r in out) == sorted(wanted)


def test_skew_join_refuses_right_joins(table):
    with pytest.raises(ValueError):
        skew.skew_join(table, table, ["k"], "right")


def test_totals_worth_knowing(table):
    out = skew.add_totals(table, ["k"], [F.count(F.lit(1)).alias("n")], worth=F.col("n") > 12)
    counts = {r["k"]: r["n"] for r in out.select("k", "n").distinct().collect()}
    assert counts["hot"] > 2000 and all(n is None or n > 12 for n in counts.values())


def test_one_coordinate_is_spread(spark):
    """Points on one place, a third of all, get many salts and are still joined once."""
    points = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("cell"))
    cells = spark.range(3000).select(F.col("id").alias("cell"), (F.col("id") * 2).alias("value"))
    out = skew.skew_join(points, cells, ["cell"], "left", task_rows=50)
    assert out.count() == 3000 and out.filter("value = cell * 2").count() == 3000
    assert skew.heavy_keys(points, ["cell"], 50).first()["_salts"] >= 20


def test_hash_rank(table, rows):
    labelled = table.withColumn("label", F.when(F.col("id") % 10 < 7, "a").otherwise("b"))
    out = skew.hash_rank(labelled, "label", F.col("id"), 42, digits=2).collect()
    for label in ("a", "b"):
        ids = [i for i, _, _ in rows if (i % 10 < 7) == (label == "a")]
        ids.sort(key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())
        rank = {i: n for n, i in enumerate(ids, start=1)}
        got = {r["id"]: (r["hash_rank"], r["label_total"]) for r in out if r["label"] == label}
        assert got == {i: (rank[i], len(ids)) for i in ids}


def test_positions(table, rows):
    out = skew.positions(table.select("id", "x"), [F.col("x"), F.col("id")]).collect()
    ordered = sorted((x, i) for i, _, x in rows)
    assert {r["id"]: r["position"] for r in out} == {i: n for n, (_, i) in enumerate(ordered, start=1)}


def test_hot_trip_routes(spark):
    """A trip with thousands of routes, next to small ones."""
    data = [(1, j + 1, f"R{j}", 1.0 + j % 9, float(90 - j % 50), j == 0) for j in range(2000)]
    data += [(t, j + 1, f"R{j}", 5.0, float(20 * j + t % 7), j == 2) for t in range(2, 60) for j in range(3)]
    df = spark.createDataFrame(data, "trip_id long, ordinal int, route string, distance double, risk double, is_current boolean")
    trips = defaultdict(list)
    for row in data:
        trips[row[0]].append(row)
    expected = set()
    for t, rs in trips.items():
        current = next(r for r in rs if r[5])
        lower = [r for r in rs if not r[5] and r[4] < current[4]]
        best = min(lower, key=lambda r: (r[4], r[1])) if lower else None
        expected |= {(t, r[2], r is best) for r in lower}
    out = routes.alternatives(df).collect()
    assert {(r["trip_id"], r["alternative_route"], r["is_safest"]) for r in out} == expected


def test_facts_budget_with_hot_owner(spark):
    updates = [(i, 1 if i % 3 else 2, "c", f"k{i % 400}", f"value {i % 7}" if i % 5 else "  ") for i in range(4000)]
    state = {}
    for i, owner, cat, key, value in updates:
        if value.strip() and state.get((owner, cat, key), (None,))[0] != value:
            state[(owner, cat, key)] = (value, i)
    expected = set()
    for owner in (1, 2):
        entries = sorted(((-u, c, k, v) for (o, c, k), (v, u) in state.items() if o == owner))
        total = 0
        for u, c, k, v in entries:
            total += len(c) + len(k) + len(v)
            if total > reports.BUDGET_CHARS:
                break
            expected.add((owner, k, -u))
    df = spark.createDataFrame(updates, "update_id long, owner long, category string, fact_key string, value string")
    out = reports.within_budget(reports.latest_facts(df)).collect()
    assert {(r["owner"], r["fact_key"], r["updated"]) for r in out} == expected


def test_many_small_facts_fit_the_budget(spark):
    """2000 facts of one character fit a budget of 2200; NULL text has no length."""
    rows = [(i, 1, "", "", "v") for i in range(2000)]
    facts = spark.createDataFrame(rows, "updated long, owner long, category string, fact_key string, value string")
    assert reports.within_budget(facts).count() == 2000
    assert reports.within_budget(facts, span=7).count() == 2000
    blank = facts.withColumn("category", F.lit(None).cast("string"))
    assert reports.within_budget(blank).count() == 2000
    longer = facts.withColumn("value", F.lit("abc"))
    assert reports.within_budget(longer, span=100).count() == 733
    updates = spark.createDataFrame([(1, 1, None, "k", "a"), (2, 1, None, "k", "b"), (3, None, "", "", "c")], "update_id long, owner long, category string, fact_key string, value string")
    assert {(r["owner"], r["value"]) for r in reports.latest_facts(updates).collect()} == {(1, "b"), (None, "c")}
    assert reports.within_budget(reports.latest_facts(updates)).count() == 2


def test_rejected_updates_name_a_missing_status(spark):
    updates = spark.createDataFrame([(1, "r", None), (2, "r", "odd")], "update_id long, report_id string, status string")
    reasons = {r["update_id"]: r["reason"] for r in reports.rejected_updates(updates).collect()}
    assert reasons[1].startswith("Invalid status ''") and reasons[2].startswith("Invalid status 'odd'")
