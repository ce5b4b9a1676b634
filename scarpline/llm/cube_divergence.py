"""How far the word use of sources diverges, by three-dimensional cube partitioning.

Each language keeps the terms of at least ``LEAST_DOCS`` of its documents. A
source gives every kept term a smoothed share of 10^9, and two sources diverge
by the sum of floor((p - q)^2 / q) over all kept terms, in exact integers.

The work is a cube of (group block, group block, term block) cells. The counts
of a source are replicated to the cells of its block with every other block;
a cell holds at most about ``GROUPS`` x ``TERMS`` counts of either side,
computes the partial divergences of its pairs in both directions, and the
partial sums are reduced along the term axis. Terms that occur in neither block
of a cell all contribute the same amount and are added at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.llm import common

LEAST_DOCS = 3
TOP_TERMS = 200
GROUPS, TERMS = 32, 8_192  # of a block
HELD = 400_000  # counts that a task gathers before it passes them on
PIECE = 1 << 20  # bytes of a text split at a time
SCALE_STEP, SCALE_STEPS = 1_000, 3  # 10^9, by long division

_LETTER = [chr(b).isalpha() if b < 128 else True for b in range(256)]
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if _LETTER[b] else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


# Counting


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text: runs of ASCII letters and other characters above 127, A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(_TO_TERMS).split()
        at = end


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents. The empty term marks every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (language, origin), (n, seen) in held.items():
                found = list(n)
                columns = [
                    pa.array([language] * len(found), pa.string()), pa.array([origin] * len(found), pa.string()), pa.array(found, pa.binary()),
                    pa.array([n[t] for t in found], pa.int64()), pa.array([seen[t] for t in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch, texts in common.text_rows(batches):
            for language, origin, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, seen = held.setdefault((language, origin), (Counter({b"": 0}), Counter({b"": 0})))
                own: set[bytes] = set()
                for part in terms(t):
                    n.update(part)
                    own.update(part)
                seen.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from told()
                held = {}
        yield from told()

    rows = docs.select(common.whole(lang).alias("lang"), common.whole(source).alias("source"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# Exact shares and divergences


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / total) for n + 1 <= total; exact for totals below 9e15."""
    rest, out = n + 1, np.zeros_like(n + total)
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // total
        rest = rest % total
    return out + 1


def share(n: Column, total: Column) -> Column:
    """The same as a column."""
    rest, out = n + 1, F.lit(0).cast("bigint")
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# The cube


def _cells(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each count and cell that needs it; rows without a term tell every cell its groups."""

    def dealt(rows: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("source"), "group_blocks")
        rows = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1)))
        return rows.select("lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "slice", "source", "term", "n", "total", "kept", "own")

    counts = dealt(entries.withColumn("slice", F.pmod(F.xxhash64("term"), "term_blocks")))
    marks = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)))
    return counts.unionByName(dealt(marks.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("bigint")})))


def _partial(cell: pa.Table) -> pa.Table:
    """Divergences of all pairs of a cell over its terms, both directions."""
    marks, counts = cell.filter(pc.is_null(cell.column("term"))), cell.filter(pc.is_valid(cell.column("term")))
    names = marks.column("source").to_pylist()
    own, total, kept = (marks.column(c).to_numpy() for c in ("own", "total", "kept"))
    low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
    number = {name: i for i, name in enumerate(names)}
    term = counts.column("term").combine_chunks().dictionary_encode()
    n = np.zeros((len(names), len(term.dictionary)), dtype=np.int64)
    if counts.num_rows:
        source = counts.column("source").combine_chunks().dictionary_encode()
        at = np.array([number[s] for s in source.dictionary.to_pylist()])[source.indices.to_numpy()]
        n[at, term.indices.to_numpy()] = counts.column("n").to_numpy()
    out = []
    if kept.max(initial=0):
        whole = (total + kept)[:, None]
        p, p0 = shares(n, whole), shares(np.zeros_like(whole), whole)[:, 0]
    for i, name in enumerate(names):
        others = np.flatnonzero(own == (low if own[i] == high else high)) if low != high else np.arange(len(names))
        others = others[others != i]
        if kept.max(initial=0):
            q, q0 = p[others], p0[others]
            sums, rest = ((p[i] - q) ** 2 // q).sum(axis=1), (p0[i] - q0) ** 2 // q0
        else:
            sums = rest = np.zeros(len(others), dtype=np.int64)
        out += [(name, names[j], int(s), int(r)) for j, s, r in zip(others, sums, rest, strict=True)]
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table(
        {
            "lang": pa.array([cell.column("lang")[0].as_py()] * len(out), pa.string()),
            "source": pa.array(columns[0], pa.string()), "item": pa.array(columns[1], pa.string()),
            "sums": pa.array(columns[2], pa.int64()), "rest": pa.array(columns[3], pa.int64()),
            "met": pa.array([n.shape[1]] * len(out), pa.int64()), "kept": pa.array([int(kept.max(initial=0))] * len(out), pa.int64()),
        }
    )


def pair_divergences(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    schema = "lang string, source string, item string, sums bigint, rest bigint, met bigint, kept bigint"
    partial = _cells(entries, groups).groupBy("lang", "low", "high", "slice").applyInArrow(_partial, schema)
    reduced = partial.groupBy("lang", "source", "item").agg(F.sum("sums").alias("sums"), F.max("rest").alias("rest"), F.sum("met").alias("met"), F.max("kept").alias("kept"))
    return reduced.select("lang", "source", "item", (F.col("sums") + (F.col("kept") - F.col("met")) * F.col("rest")).alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: the divergence of a source from each other source of its
    language, all ranks. Part ``term``: the terms that a source uses more than
    its language does, with their divergence, the first 200. NULL text,
    language and source are empty texts; a text without terms still makes its
    group occur; a language without kept terms has pairs of value 0. Ties are
    ranked by item in UTF-8 order, repeated rows count as documents of their
    own, long texts are split piecewise, no rows give no rows, other columns
    are not read. A source's counts fill one row of a cell at most, whatever
    share of the rows it holds.
    """
    counts = common.stored(term_counts(docs, lang, source, text))
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    kept = common.stored(kept.select("lang", "term", F.col("n").alias("lang_n")))
    entries = common.stored(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source")
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("members"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(many, "lang").join(of_lang, "lang", "left")
    groups = groups.select(
        "lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "kept", "lang_total")],
        F.ceil(F.col("members") / GROUPS).alias("group_blocks"),
        F.greatest(F.ceil(F.coalesce("kept", F.lit(0)) / TERMS), F.lit(1)).cast("bigint").alias("term_blocks"),
    )
    groups = common.cut(groups)
    known = entries.join(groups, ["lang", "source"])

    p, q = share(F.col("n"), F.col("total") + F.col("kept")), share(F.col("lang_n"), F.col("lang_total") + F.col("kept"))
    over = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    top = _ranked(over, "term").filter(F.col("rank") <= TOP_TERMS)
    return _ranked(pair_divergences(known, groups), "pair").unionByName(top)


SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN s USING (lang, source)),
f AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
  CAST(1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1) // (CAST(g.n AS HUGEINT) + v) AS HUGEINT) AS p,
  CAST(1 + 1000000000 * (CAST(k.ln AS HUGEINT) + 1) // (CAST(v.ln AS HUGEINT) + v) AS HUGEINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM z QUALIFY part = 'pair' OR rank <= 200"""
