"""Registered queries: name, inventory ids, Spark callable and checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from scarpline.sources import views

FAMILIES = (
    "incident_queries", "spatial_queries", "quality_queries", "feature_queries", "model_queries",
    "risk_queries", "route_queries", "pixel_queries", "source_queries", "report_queries", "stream_queries",
)


class Inputs:
    """Views and base tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        return views.table(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
CHECK_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def check_view(name: str, needs: str, text: str) -> None:
    """An SQL-only intermediate of the checking queries."""
    CHECK_VIEWS[name] = (tuple(needs.split()), text.strip())


def _ctes(needs: list[str]) -> str:
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out:
            return
        if name in CHECK_VIEWS:
            parents, text = CHECK_VIEWS[name]
            for p in parents:
                add(p)
            out[name] = text
        elif name in views.VIEWS:
            for n, text in views.duck_ctes([name]):
                out.setdefault(n, text)

    for name in needs:
        add(name)
    return ",\n".join(f"{n} AS (\n{t}\n)" for n, t in out.items())


def query(name: str, ids: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query. ``needs`` names the views its checking SQL reads."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        text = None
        if sql is not None:
            ctes = _ctes(needs.split())
            body = sql.strip()
            if recursive:
                text = f"WITH RECURSIVE {ctes + ',' if ctes else ''}\n{body}"
            elif ctes:
                text = f"WITH {ctes}{',' if body.startswith('+') else ''}\n{body.lstrip('+')}"
            else:
                text = body
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ids, fn, text)
        return fn

    return wrap


def load() -> dict[str, Query]:
    for family in FAMILIES:
        import_module(f"scarpline.plans.{family}")
    return REGISTRY
