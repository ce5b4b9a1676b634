"""Every registered query with checking SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

from scarpline.plans.registry import Inputs, load
from scarpline.sources.views import TABLES

REGISTRY = load()
CHECKED = sorted(name for name, q in REGISTRY.items() if q.sql)
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "text", "boolean": "bool"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_duckdb(spark, sf_dir, duck, name):
    q = REGISTRY[name]
    df = q.run(Inputs(spark, sf_dir))
    cur = duck.execute(q.sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    ours = sorted([norm(r[c]) for c in order] for r in df.collect())
    theirs = sorted([norm(r[columns.index(c)]) for c in order] for r in cur.fetchall())
    assert ours == theirs


def test_every_view_query_is_named_once():
    assert len(REGISTRY) == len(set(REGISTRY))
    assert all(q.ids for q in REGISTRY.values())
