"""Feature preparation on labelled environment rows."""

from pyspark.sql import functions as F

from scarpline.operators import preparation as prep
from scarpline.plans.incident_queries import n
from scarpline.plans.quality_queries import found
from scarpline.plans.registry import check_view, query

_FEATURES = ", ".join(prep.FEATURES)


def num(c: str) -> str:
    return f"TRY_CAST({c} AS DOUBLE)"


_LABELLED = [("ERROR", f"missing {c}", n(f"{c} IS NULL")) for c in (*prep.FEATURES, prep.TARGET)]
_LABELLED += [("ERROR", f"non-numeric {c}", n(f"{c} IS NOT NULL AND {num(c)} IS NULL")) for c in prep.FEATURES]
_LABELLED.append(("ERROR", "invalid risk level", n("risk_level NOT IN ('LOW', 'MEDIUM', 'HIGH')")))


@query("labelled_table_check", "P1", "env_raw", found("labelled_table", "env_raw", _LABELLED))
def _(v):
    return prep.labelled_check(v("env_raw"))


@query(
    "normalised_labels", "P2", "env_raw",
    f"SELECT env_id, {', '.join(f'{num(c)} AS {c}' for c in prep.FEATURES)}, upper(trim(risk_level)) AS risk_level FROM env_raw",
)
def _(v):
    return prep.normalise_labels(v("env_raw"), keep=["env_id"])


_RANGE = []
for _c, (_lo, _hi) in prep.PHYSICAL_RANGES.items():
    _RANGE.append(("ERROR", f"{_c} below {_lo}", n(f"{num(_c)} < {_lo}")))
    if _hi is not None:
        _RANGE.append(("ERROR", f"{_c} above {_hi}", n(f"{num(_c)} > {_hi}")))
_RANGE.append(("ERROR", "landslide_history not 0 or 1", n("NOT coalesce(TRY_CAST(landslide_history AS DOUBLE) IN (0, 1), false)")))


@query("physical_range_check", "P3", "env_raw", found("physical_ranges", "env_raw", _RANGE))
def _(v):
    return prep.range_check(v("env_raw"))


@query("model_features", "P4", "env", f"SELECT env_id, {_FEATURES} FROM env")
def _(v):
    return prep.feature_columns(v("env"), keep=["env_id"])


@query("model_target", "P4", "env", "SELECT env_id, risk_level FROM env")
def _(v):
    return prep.target_column(v("env"), keep=["env_id"])


check_view(
    "scaled", "env",
    "SELECT env_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in prep.FEATURES) + " FROM env",
)


@query("standard_scaling", "P5", "scaled", "SELECT env_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in prep.FEATURES) + " FROM scaled")
def _(v):
    out = prep.scale(v("env")).select("env_id", *prep.FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in prep.FEATURES})


@query(
    "scaled_means", "P6", "scaled",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(avg({c})), 6) AS mean_abs FROM scaled" for c in prep.FEATURES),
)
def _(v):
    return prep.column_means(prep.scale(v("env"))).select("feature", F.round(F.abs("mean"), 6).alias("mean_abs"))


check_view(
    "ranked", "env",
    "SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY md5(CAST(env_id AS VARCHAR) || '-42')) AS rk, count(*) OVER (PARTITION BY risk_level) AS total FROM env",
)
check_view("split_rows", "ranked", "SELECT *, CASE WHEN rk <= ceil(total * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ranked")


@query("stratified_split", "P7", "split_rows", "SELECT env_id, risk_level, split FROM split_rows")
def _(v):
    return prep.stratified_split(v("env")).select("env_id", "risk_level", "split")


@query("class_distribution", "P8", "split_rows", "SELECT split, risk_level, count(*) AS n FROM split_rows GROUP BY 1, 2")
def _(v):
    return prep.class_distribution(prep.stratified_split(v("env")), by=["split"])


_GATE = [("ERROR", f"null {c}", n(f"{num(c)} IS NULL")) for c in prep.FEATURES] + [("ERROR", "null risk_level", n("risk_level IS NULL"))]


@query("training_null_gate", "P9", "env_raw", found("training_gate", "env_raw", _GATE))
def _(v):
    return prep.training_gate(prep.normalise_labels(v("env_raw")))


@query("stratified_folds", "M5", "ranked", "SELECT env_id, risk_level, CAST((rk - 1) % 3 AS INT) AS fold FROM ranked")
def _(v):
    return prep.stratified_folds(v("env")).select("env_id", "risk_level", "fold")
