"""FeatureCollections read in byte ranges against the whole document parsed at once."""

import json
import random

import pytest

from scarpline.sources import collections

AWKWARD = ['plain', 'brace } and {', 'quote " and \\', '\\\\"', ']}],[{', 'é ü 漢字', '', '"type": "Feature"', "\\" * 9, 'line\nbreak']


def document(draw, n, indent=None):
    rows = [
        {"type": "Feature", "properties": {"id": i, "name": draw.choice(AWKWARD) + draw.choice(AWKWARD), "more": {"deep": [{"a": "}"}]}}, "geometry": {"type": "Point", "coordinates": [i / 7, -i / 3]}}
        for i in range(n)
    ]
    whole = {"type": "FeatureCollection", "crs": {"properties": {"name": "x {"}}, "bbox": [0, 1, 2, 3], "features": rows, "tail": {"type": "Other"}}
    return json.dumps(whole, indent=indent, ensure_ascii=bool(n % 2)), rows


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 10**6])
def test_ranges_of_any_size_cut_the_same_features(size):
    draw = random.Random(size)
    text, rows = document(draw, 12 if size > 2 else 5, indent=1 if size == 7 else None)
    data = text.encode()
    state, depth, found = collections.OUT, 0, []
    for start in range(0, len(data), size):
        part = data[start : start + size]
        texts, open_ = collections.features(part, state, depth, len(part))
        if open_ is not None:
            texts, open_ = collections.features(data[start:], state, depth, len(part))
        found += texts
        end, more = collections.walk(part, state)
        state, depth = end, depth + more
    assert (state, depth) == (collections.OUT, 0)
    kept = [json.loads(t) for t in found]
    assert [r for r in kept if r.get("type") == "Feature"] == rows


def test_reads_equal_the_line_form(spark, tmp_path):
    draw = random.Random(1)
    (tmp_path / "a dir").mkdir()
    expected = set()
    for name, n in (("one.geojson", 300), ("a dir/two.geojson", 41), ("none.geojson", 0)):
        text, rows = document(draw, n)
        (tmp_path / name).write_text(text)
        expected |= {(r["properties"]["id"], r["properties"]["name"], *r["geometry"]["coordinates"], "Point") for r in rows}
    from pyspark.sql import types as T

    properties = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    for size in (500, 1 << 20):
        out = collections.read_collections(spark, str(tmp_path), properties, size).collect()
        assert {tuple(r) for r in out} == expected and len(out) == 341


def test_ranges_are_dealt_over_many_tasks(spark, tmp_path):
    text, rows = document(random.Random(3), 400)
    (tmp_path / "one.geojson").write_text(text)
    cores = spark.sparkContext.defaultParallelism
    out = collections.feature_texts(spark, str(tmp_path), len(text) // (2 * cores))
    assert out.rdd.getNumPartitions() >= cores
    assert sorted(json.loads(r["value"])["properties"]["id"] for r in out.collect() if '"Feature"' in r["value"]) == list(range(400))
