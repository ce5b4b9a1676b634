"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FILE_ROWS = 500_000  # edges of a file of a round
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which outlives executors.

    ``spark.checkpoint.dir`` names it. Only where that is unset a folder below
    the warehouse is used.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small intermediate by a checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Materialise a large intermediate as a compressed table in the shared folder."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each Arrow batch with its texts as UTF-8 bytes (NULL: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        yield batch, [v or b"" for v in values]


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, over the borders of batches, and where the runs begin and end."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        changed = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            values = rows.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(changed)])
        if len(cuts) > 1:
            yield rows.slice(0, cuts[-1]).combine_chunks(), cuts
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def spanning(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row it reaches."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def spanning_pairs(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row it reaches over the pairs (x, y)."""
    label = np.arange(n)
    while len(x):
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id that has an edge.

    ``edges`` has long columns ``a`` and ``b``. Alternating large-star and
    small-star rounds over joins and partial aggregates; each round is
    checkpointed in as many files as its rows ask for, nothing but a row count
    and a checksum reaches the driver.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(links)
    files = max(1, -(-before[0] // FILE_ROWS))  # a round has about as many edges as the first
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lows, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(lows, "a")
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(lows.select("a", F.col("m").alias("b"))).distinct().coalesce(files))
        after = state(links)
        if after == before:
            break
        before = after
    ids = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return ids.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
