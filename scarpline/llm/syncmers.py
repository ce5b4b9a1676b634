"""Document fingerprints from closed syncmers (DataFrame functions only).

Symbols are the words of the text. A k-mer of ``K`` words is selected when the
smallest hash among its inner ``S``-word substrings lies at its first or last
place. Selection depends on the k-mer alone, so an edit elsewhere never moves
an anchor. ``placed_anchors`` keeps every anchor with its place, for matching
passages by position. The fingerprint is the set of all anchor values in
order, 32 bits each, written as hex. Likeness is the Jaccard similarity of the
whole sets.

A text with fewer than ``K`` words has one anchor, a hash of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.llm import common

K, S = 4, 2
SKETCH = None  # smallest anchors kept of a text; None keeps all
_WIDTH = 8
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed_anchors(text: Column) -> Column:
    """(place, anchor) of every closed syncmer: the number of its first word from 1, and its 32-bit value."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def inner(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))

    def selected(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(s) - (K - S))
        at = lambda i: F.element_at(s, i.cast("int"))
        edge = lambda i: F.least(at(i), at(i + (K - S))) <= at(i + 1)
        value = lambda i: F.xxhash64(at(i), at(i + (K - S))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(F.filter(places, edge), lambda i: F.struct(i.cast("int").alias("place"), value(i).alias("anchor")))

    none = F.array().cast("array<struct<place:int,anchor:bigint>>")
    return _let(hashes, lambda h: _let(inner(h), lambda s: F.when(F.size(s) > K - S, selected(s)).otherwise(none)))


def anchors(text: Column) -> Column:
    """The sketch of a text: sorted distinct 32-bit anchor values."""
    alone = F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))

    def kept(a: Column) -> Column:
        whole = F.sort_array(F.array_distinct(F.transform(a, lambda p: p["anchor"])))
        return whole if SKETCH is None else F.slice(whole, 1, SKETCH)

    return _let(placed_anchors(text), lambda a: F.when(F.size(a) > 0, kept(a)).otherwise(alone))


def written(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v)), _WIDTH, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors in the union, among its smallest where sketches are cut."""
    both = F.array_intersect(a, b)
    if SKETCH is None:
        return F.size(both) / (F.size(a) + F.size(b) - F.size(both))
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(both, union)) / F.size(union)


def _longs(values: list[int | None]) -> str:
    return "array(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in values) + ")"


def range_number(doc_id: Column, cuts: list[int], block: int = 128) -> Column:
    """How many cut points reach the id. Two steps, so a row is compared with few of many cut points."""
    falling = sorted(set(cuts), reverse=True)
    blocks = [falling[k : k + block] for k in range(0, len(falling), block)] or [[]]

    def reach(points: Column) -> Column:
        return F.size(F.filter(points, lambda p: p >= doc_id))

    at = F.greatest(reach(F.expr(_longs([b[0] for b in blocks if b])).cast("array<bigint>")), F.lit(1))
    inside = F.element_at(F.expr("array(" + ", ".join(map(_longs, blocks)) + ")").cast("array<array<bigint>>"), at)
    return (at - 1) * block + reach(inside)


def _with_next(docs: DataFrame, rows_a_range: int, max_ranges: int) -> DataFrame:
    """Each row with the text of the next one by descending id.

    Ids are cut into ranges of about ``rows_a_range`` rows (at most
    ``max_ranges`` cut points and range heads reach the driver; beyond them
    ranges grow and their sort spills). The head of each range is also sent to
    the range before it, as a closing row, so the successor is always found
    inside one range.
    """
    n = docs.count()
    steps = max(1, min(max_ranges, -(-n // rows_a_range)))
    shares = [k / steps for k in range(1, steps)]
    cuts = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 20 * steps))).first()[0] if shares else None
    # range 0 holds the largest ids, NULL ids come last
    place = F.when(F.col("doc_id").isNull(), F.lit(steps)).otherwise(range_number(F.col("doc_id"), cuts or []))
    placed = docs.withColumn("_range", place)
    heads = placed.groupBy("_range").agg(F.max("doc_id").alias("head")).orderBy("_range").collect()
    before: list[int | None] = [None] * (steps + 1)
    firsts: list[int | None] = [None] * (steps + 1)
    for k, row in enumerate(heads):  # the first one closes the last
        before[row["_range"]], firsts[row["_range"]] = heads[k - 1]["_range"], row["head"]
    of_range = lambda values: F.element_at(F.expr(_longs(values)), F.col("_range") + 1)
    is_head = F.col("doc_id").eqNullSafe(of_range(firsts))
    closing = F.struct(of_range(before).cast("int").alias("_range"), F.lit(True).alias("_closing"))
    own = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_closing"))
    copies = placed.withColumn("_at", F.explode(F.when(is_head, F.array(own, closing)).otherwise(F.array(own))))
    copies = copies.withColumn("_range", F.col("_at._range")).withColumn("_closing", F.col("_at._closing")).drop("_at")
    order = Window.partitionBy("_range").orderBy("_closing", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return copies.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("_closing")).drop("_closing", "_range")


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_a_range: int = 1500, max_ranges: int = 16_384
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends in the beginning of the next document. NULL text is
    empty; an empty text has the anchor of the empty text. Repeated ids are
    ordered by a hash of their text; a single row follows itself. No rows give
    no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.whole(text).alias("text"))
    rows = _with_next(rows, rows_a_range, max_ranges)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = (F.col("n_chars") - third).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    sketches = {"sketch": anchors(F.col("text")), "edited_sketch": anchors(F.col("edited")), "next_sketch": anchors(F.col("next_text"))}
    return rows.withColumns(sketches).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
