"""Helpers that keep joins and rankings even when one key holds most rows.

A key is heavy when it has more rows than one task should get: ``TASK_ROWS``,
or the rows of all keys divided by ``MAX_HEAVY`` where that is more, so there
are never more than ``MAX_HEAVY`` heavy keys. That list is what is broadcast.

A side is broadcast only after it has been stored and its size is known to be
at most ``BROADCAST_BYTES``; beyond that heavy keys are salted.

``skew_join``   cuts each heavy key of the large side into as many salts as its
                count asks for.
``add_totals``  per-key aggregates attached to every row: partial aggregation
                first, then one join, never a window over the key.
``hash_rank``   exact rank within a label in a reproducible hash order.
``positions``   exact global row number in a sort order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.sources import shared

TASK_ROWS = 1_000_000
MAX_HEAVY = 50_000
BROADCAST_BYTES = 8 << 20  # of compressed files
HASH_DIGITS = 4


def _same(keys: list[str], left: str = "", right: str = "_h_", nulls: bool = True) -> Column:
    equal = [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) if nulls else F.col(f"{left}{k}") == F.col(f"{right}{k}") for k in keys]
    return reduce(lambda a, b: a & b, equal)


def _heavy(counts: DataFrame, task_rows: int) -> DataFrame:
    """Rows of ``counts`` (with ``_n``) that are heavy, and their number of salts."""
    total = counts.agg(F.sum("_n").alias("_total"))
    limit = F.greatest(F.lit(task_rows), F.ceil(total.scalar() / F.lit(MAX_HEAVY)))
    return counts.withColumn("_salts", F.ceil(F.col("_n") / limit)).filter(F.col("_salts") > 1)


def heavy_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, _n, _salts) of the keys with more rows than one task should get."""
    return _heavy(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), task_rows)


def fits_broadcast(stored: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the files of a stored table are small enough to send it to every executor."""
    return int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def _salted_left(df: DataFrame, heavy: DataFrame, keys: list[str], row_id: list[str] | None) -> DataFrame:
    """``df`` with ``_salt``: 0 for light keys, for heavy ones taken from the content, so a re-run task gives every row the same."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in row_id or df.columns])
    met = df.join(F.broadcast(heavy), _same(keys), "left").drop(*[f"_h_{k}" for k in keys])
    return met.withColumn("_salt", F.pmod(content, F.coalesce("_salts", F.lit(1)))).drop("_salts")


def _every_salt(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    row_id: list[str] | None = None,
    task_rows: int = TASK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join whose left side may hold a few very frequent keys.

    The right side is stored; where it is small it is broadcast and the left
    side is read once and not shuffled. Otherwise the left keys are counted,
    rows of a heavy key get a salt, and the matching right rows are repeated
    once per salt. ``row_id`` names columns that tell rows apart; by default
    all columns feed the salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} would repeat the salted side")
    right = shared.store(right, "join-side")
    if fits_broadcast(right, broadcast_bytes):
        return left.join(F.broadcast(right), keys, how)
    heavy = shared.store(heavy_keys(left, keys, task_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_salts"), "heavy-keys")
    salted_right = right.join(F.broadcast(heavy), _same(keys), "left").drop(*[f"_h_{k}" for k in keys])
    salted_right = salted_right.withColumn("_salt", _every_salt(F.coalesce("_salts", F.lit(1)))).drop("_salts")
    return _salted_left(left, heavy, keys, row_id).join(salted_right, keys + ["_salt"], how).drop("_salt")


def add_totals(
    df: DataFrame,
    keys: list[str],
    aggs: list[Column],
    base: DataFrame | None = None,
    null_keys: bool = False,
    task_rows: int = TASK_ROWS,
    worth: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach per-key aggregates to every row.

    ``base`` may name a cheaper frame with the same rows to aggregate. Rows
    with a NULL key get NULL totals unless ``null_keys`` counts NULL as a key.
    ``worth`` keeps only totals for which it holds; the rows of other keys get
    NULLs.
    """
    totals = (df if base is None else base).groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    return attach_totals(df, keys, totals, null_keys, task_rows, worth, broadcast_bytes)


def attach_totals(
    df: DataFrame,
    keys: list[str],
    totals: DataFrame,
    null_keys: bool = False,
    task_rows: int = TASK_ROWS,
    worth: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join totals, one row per key with its number of rows ``_n``, to every row of ``df``.

    The totals are stored once. Where they are small one broadcast join
    attaches them and ``df`` is not shuffled. Otherwise one join does, its
    heavy keys salted and their totals repeated once per salt.
    """
    names = [c for c in totals.columns if c not in keys and c != "_n"]
    kept = F.lit(True) if worth is None else F.coalesce(worth, F.lit(False))
    if not null_keys:
        kept = kept & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # totals that are not worth keeping stay only where their rows must be salted
    told = totals.withColumn("_kept", kept).filter(F.col("_kept") | (F.col("_n") > task_rows))
    values = [F.when(F.col("_kept"), F.col(n)).alias(f"_t_{n}") for n in names]
    told = shared.store(told.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *values, "_n"), "totals")
    columns = [*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_t_{n}").alias(n) for n in names]]
    if fits_broadcast(told, broadcast_bytes):
        return df.join(F.broadcast(told), _same(keys), "left").select(*columns)
    heavy = shared.store(_heavy(told, task_rows).select(*[f"_h_{k}" for k in keys], "_salts"), "heavy-keys")
    again = heavy.select(*[F.col(f"_h_{k}").alias(f"_k_{k}") for k in keys], "_salts")
    repeated = told.join(F.broadcast(again), _same(keys, "_h_", "_k_"), "left").withColumn("_salt_t", _every_salt(F.coalesce("_salts", F.lit(1))))
    repeated = repeated.select(*[f"_h_{k}" for k in keys], *[f"_t_{n}" for n in names], "_salt_t")
    met = _salted_left(df, heavy, keys, None).join(repeated, _same(keys) & (F.col("_salt") == F.col("_salt_t")), "left")
    return met.select(*columns)


def hash_rank(
    df: DataFrame, label: str, key: Column, seed: int, name: str = "hash_rank", digits: int = HASH_DIGITS
) -> DataFrame:
    """Rank 1..n of each row within its label, ordered by md5(key-seed).

    The key must identify a row. The leading hex digits cut every label into
    16^digits even buckets; bucket counts give each bucket its offset, so no
    task ever sorts a whole label. Also adds ``label_total``. The offset join
    reuses the partitioning of the ranking window.
    """
    h = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    rows = df.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, digits))
    counts = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy(label)
    before = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(label).alias("_label"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(by_label).alias("label_total"),
    )
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_h")
    ranked = rows.withColumn("_rn", F.row_number().over(in_bucket))
    joined = ranked.join(
        offsets, ranked[label].eqNullSafe(offsets["_label"]) & (ranked["_bucket"] == offsets["_b"])
    )
    return joined.withColumn(name, F.col("_rn") + F.col("_offset")).drop("_h", "_bucket", "_rn", "_offset", "_label", "_b")


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global 1-based row number in ``order`` without a single-task window.

    Range partitioning plus a local sort fixes the order; the sorted rows are
    written once to the shared folder so that range bounds cannot change
    between the counting pass and the numbering pass (and lost executors only
    re-read a file). Partition counts then give every partition its offset.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    stored = shared.store(numbered, "positions")
    part = F.shiftright("_id", 33)
    index = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, index + F.col("_offset") + 1)
        .drop("_id", "_part", "_offset")
    )
