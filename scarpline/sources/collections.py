"""GeoJSON FeatureCollections of any size, read in byte ranges by many tasks.

A document is one JSON text, so where a range begins inside a string or at what
depth is not known from the range alone. Two passes settle it:

1. every range is walked once for each of the three ways it may begin (outside a
   string, inside one, behind a backslash) and told as where it ends and how much
   deeper; the few numbers of a file are chained in order;
2. every range, now with its true beginning, cuts out the features that begin in
   it and reads on past its end to finish the last one.

Files are opened with ``pyarrow.fs``, so any store that it knows can be read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scarpline.sources.geojson import POINT

# The functions below travel to the workers by value: these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
OUT, IN, ESCAPED = 0, 1, 2
FEATURE_DEPTH = 2  # below the document and its list of features
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.DOTALL)  # a lone quote opens a string that does not end
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)


def _begin(data: bytes, state: int) -> int | None:
    """Where the text outside strings begins; None if the string goes on past the data."""
    at = 1 if state == ESCAPED else 0
    if state == OUT:
        return 0
    end = _REST.match(data, min(at, len(data)))
    return end.end() if end else None


def _ends_in(data: bytes, at: int) -> int:
    """State behind unfinished text that begins inside a string at ``at``."""
    tail = data[at:]
    return ESCAPED if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else IN


def walk(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, change of depth) of a range that begins in ``state``."""
    at = _begin(data, state)
    if at is None:
        return _ends_in(data, 1 if state == ESCAPED and data else 0) if data else state, 0
    depth = 0
    for token in _TOKEN.finditer(data, at):
        if token[0] == b'"':
            return _ends_in(data, token.end()), depth
        c = data[token.start()]
        depth += (c in b"{[") - (c in b"}]")
    return OUT, depth


def features(data: bytes, state: int, depth: int, length: int) -> tuple[list[bytes], int | None]:
    """Texts of the objects that begin at the depth of features within ``length`` bytes; where an unfinished one begins."""
    at, found, start = _begin(data, state), [], None
    if at is None:
        return [], None
    for token in _TOKEN.finditer(data, at):
        if token[0] == b'"':
            break
        c = data[token.start()]
        if c in b"{[":
            if c == ord("{") and depth == FEATURE_DEPTH:
                if token.start() >= length:
                    return found, None
                start = token.start()
            depth += 1
        elif c in b"}]":
            depth -= 1
            if depth == FEATURE_DEPTH and start is not None:
                found.append(data[start : token.end()])
                start = None
    return found, start


def _open(path: str):
    """A file by the path that Spark's listing gives it, which is not encoded as an address."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store.open_input_file(unquote(name))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"], strict=True):
            with _open(path) as f:
                data = f.read_at(int(end - start), int(start))
            row = [path, start, end]
            for state in (OUT, IN, ESCAPED):
                row += walk(data, state)
            out.append(row)
        yield pd.DataFrame(out, columns=["path", "start", "end", "s0", "d0", "s1", "d1", "s2", "d2"])


def _chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """True state and depth at the beginning of every range of a file."""
    pdf = pdf.sort_values("start", ignore_index=True)
    state, depth, out = OUT, 0, []
    for row in pdf.itertuples(index=False):
        out.append((row.path, row.start, row.end, state, depth))
        state, depth = getattr(row, f"s{state}"), depth + getattr(row, f"d{state}")
    return pd.DataFrame(out, columns=["path", "start", "end", "state", "depth"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end, state, depth in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            length, more = end - start, 1 << 16
            with _open(path) as f:
                whole = f.size()
                data = f.read_at(length, start)
                found, open_ = features(data, state, depth, length)
                tail, at = data[open_:] if open_ is not None else b"", start + len(data)
                while open_ is not None and at < whole:  # the last feature goes on in later ranges
                    tail += f.read_at(min(more, whole - at), at)
                    at, more = min(at + more, whole), more * 2
                    last, open_ = features(tail, OUT, FEATURE_DEPTH, 1)
                    found += last
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in found], pa.string())], names=["value"])


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): the text of every object in a list at the top of the documents of a file or folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "start", F.least("length", F.col("start") + range_bytes).alias("end"))
    number, total = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / range_bytes)), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # a given number of tasks is kept, while rows of three numbers dealt by key would be put together into one task
    tasks = max(1, min(int(number), max(spark.sparkContext.defaultParallelism, -(-int(total) // RANGE_BYTES))))
    told = ranges.repartition(tasks).mapInPandas(_summaries, "path string, start bigint, end bigint, s0 int, d0 bigint, s1 int, d1 bigint, s2 int, d2 bigint")
    known = told.groupBy("path").applyInPandas(_chained, "path string, start bigint, end bigint, state int, depth bigint")
    return known.repartition(tasks).select("path", "start", "end", "state", "depth").mapInArrow(_cut, "value string")


def read_collections(spark: SparkSession, path: str, properties: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Properties plus ``x``, ``y`` and ``geometry_type`` of every Feature of FeatureCollection documents."""
    feature = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", properties), T.StructField("geometry", POINT)])
    rows = feature_texts(spark, path, range_bytes).select(F.from_json("value", feature).alias("f")).select("f.*").filter("type = 'Feature'")
    xy = F.col("geometry.coordinates")
    return rows.select("properties.*", xy[0].alias("x"), xy[1].alias("y"), F.col("geometry.type").alias("geometry_type"))
