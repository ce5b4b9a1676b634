"""Conversation prefix trie by fixed-length block hashing.

A conversation is a sequence of turns; every distinct prefix is a node. Turns
are hashed with their position, so that the exclusive or of the hashes of a
prefix (two times 64 bits) names its node and the names along a conversation
are running sums of block digests:

1. Turns are cut into blocks of ``BLOCK`` turns. Conversations are grouped by
   (name of the prefix before, block digest): equal blocks under equal prefixes
   become one row with its number of conversations and smallest id.
2. A block without siblings has no boundary inside: its turns are nodes as they
   stand. Where siblings diverge, and only there, blocks are split into turns
   and the turns grouped by name.
3. Sums over subtrees double the distance at each round: a node passes what it
   has gathered from below to its ancestor at distance 1, 2, 4, ... and takes
   over that ancestor's pointer. The number of rounds is the logarithm of the
   depth.

A conversation of any length stays distributed: positions come from a global
range sort, and prefixes from sums over segments of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.llm import common
from scarpline.operators.skew import positions

BLOCK = 4  # turns
SEGMENT = 4_096  # blocks summed in one window
REACH, FAMILY, HEADS = 9, 5, 8  # fixed values of the rebuilt data: h = crc32(id) % 9, base = id - id % 5
SLICE_BITS = 13  # ids of a digest joined at a time


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, d, bytes): digest of role and text, and UTF-8 bytes of the text, of every turn with an id."""
    who, said = common.whole(role), common.whole(text)
    rows = conversations.filter(F.col(conv_id).isNotNull())
    return rows.select(
        F.col(conv_id).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("d"),
        F.octet_length(said).cast("bigint").alias("bytes"),
    )


def placed_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, d, bytes) with pos from 0; NULL turns first, ties in the order of the digest."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("d")]
    numbered = positions(_turns(conversations, conv_id, turn, role, text), order, "number")
    first = numbered.groupBy("c").agg(F.min("number").alias("first"))
    return numbered.join(first, "c").select("c", (F.col("number") - F.col("first")).cast("bigint").alias("pos"), "d", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and (c, turns) of the rebuilt conversations: the first h turns of the base, then the own turns from h on."""
    sizes = common.cut(turns.groupBy("c").agg(F.count(F.lit(1)).alias("own")))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % REACH
    convs = sizes.select("c", "own", (F.col("c") - F.col("c") % FAMILY).alias("base"), h.alias("h"))
    lent = sizes.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = convs.join(lent, "base", "left")
    convs = convs.select("c", "base", "h", "own", F.least("h", F.coalesce("there", F.lit(0).cast("bigint"))).alias("head"))
    convs = common.cut(convs.withColumn("turns", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("bigint"))))
    tail = turns.join(convs.select("c", "h", "head"), "c").filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "d", "bytes")
    heads = turns.filter(F.col("pos") < HEADS).withColumnRenamed("c", "base")
    head = heads.join(convs.filter("head > 0").select("base", "c", "head"), "base").filter("pos < head").select("c", "pos", "d", "bytes")
    return head.unionByName(tail), convs.select("c", "turns")


def _xor(old: Column, new: Column) -> Column:
    return old.bitwiseXOR(new)


def _blocks(turns: DataFrame) -> DataFrame:
    """(c, block, before1, before2, own1, own2, items): one row for each block of each conversation."""
    named = turns.select(
        "c", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"),
        F.struct("pos", F.xxhash64("pos", "d").alias("x1"), F.xxhash64(F.lit("second"), "d", "pos").alias("x2"), "bytes").alias("item"),
    )
    blocks = named.groupBy("c", "block").agg(
        F.sort_array(F.collect_list("item")).alias("items"), F.bit_xor("item.x1").alias("own1"), F.bit_xor("item.x2").alias("own2")
    )
    blocks = common.stored(blocks.withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("bigint")))
    segments = blocks.groupBy("c", "segment").agg(F.bit_xor("own1").alias("all1"), F.bit_xor("own2").alias("all2"))
    zero = F.lit(0).cast("bigint")

    def earlier(column: str, window) -> Column:
        return F.coalesce(F.bit_xor(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), zero)

    by_conv, by_segment = Window.partitionBy("c").orderBy("segment"), Window.partitionBy("c", "segment").orderBy("block")
    starts = segments.select("c", "segment", *[earlier(f"all{i}", by_conv).alias(f"start{i}") for i in (1, 2)])
    inside = blocks.select("*", *[earlier(f"own{i}", by_segment).alias(f"inside{i}") for i in (1, 2)])
    return inside.join(starts, ["c", "segment"]).select(
        "c", "block", "own1", "own2", "items", *[_xor(F.col(f"start{i}"), F.col(f"inside{i}")).alias(f"before{i}") for i in (1, 2)]
    )


def _nodes(blocks: DataFrame) -> DataFrame:
    """(k1, k2, depth, up1, up2, conv_id, n_convs, bytes) of every node below the root."""
    key = ["block", "before1", "before2"]
    distinct = blocks.groupBy(*key, "own1", "own2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.first("items").alias("items"))
    distinct = common.stored(distinct)
    siblings = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("siblings"))

    def name(i: int, upto: Column) -> Column:
        return F.aggregate(F.slice("items", F.lit(1), upto), F.col(f"before{i}"), lambda a, t: a.bitwiseXOR(t[f"x{i}"]))

    within = F.transform(
        "items",
        lambda t, at: F.struct(
            (t["pos"] + 1).alias("depth"), name(1, at + 1).alias("k1"), name(2, at + 1).alias("k2"),
            name(1, at).alias("up1"), name(2, at).alias("up2"), t["bytes"].alias("bytes"),
        ),
    )
    refined = distinct.join(siblings, key).select("siblings", "n_convs", "conv_id", F.explode(within).alias("t")).select("siblings", "n_convs", "conv_id", "t.*")
    alone = refined.filter("siblings = 1").drop("siblings")
    met = refined.filter("siblings > 1").groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("depth", "up1", "up2", "bytes")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    return alone.unionByName(met)


def _subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) over subtrees. ``nodes``: k1, k2, up1, up2, depth, leaf, saved.

    After round i a node holds the sums over its descendants nearer than 2^i,
    and its pointer is its ancestor at distance 2^i.
    """
    held = nodes.select("k1", "k2", F.col("up1").alias("a1"), F.col("up2").alias("a2"), "depth", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step = 1
    while step <= depth:
        linked = held.filter(F.col("depth") >= step)
        sent = linked.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = held.filter(F.col("depth") >= step).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        gathered = held.join(sent, ["k1", "k2"], "left")
        far = 2 * step <= depth
        columns = ["k1", "k2", "depth", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")]
        if far:
            gathered = gathered.join(above, ["a1", "a2"], "left")
            columns += [F.when(F.col("depth") >= 2 * step, F.col(f"b{i}")).alias(f"a{i}") for i in (1, 2)]
        held = common.stored(gathered.select(*columns))
        step *= 2
    return held.select("k1", "k2", "n_leaves", "saved_tokens")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): hash of the ascending ids of the conversations that end at a node.

    Ids are joined in slices of bounded width first. A node with one slice is
    hashed as it stands; the slices of the others pass through one running
    hash in order, a few at a time.
    """
    slices = ends.groupBy("k1", "k2", F.shiftright("c", SLICE_BITS).alias("slice")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids"))
    slices = common.stored(slices)
    count = slices.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    parts = slices.join(count, ["k1", "k2"])
    one = parts.filter("n = 1").select("k1", "k2", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running, done = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "ids")], strict=True):
                if (k1, k2) != at:
                    if running is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
        if running is not None:
            done.append((*at, running.hexdigest()))
        k1, k2, digest = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest, pa.string())], names=["k1", "k2", "ends_sha256"])

    many = parts.filter("n > 1").select("k1", "k2", "slice", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "slice")
    return one.unionByName(many.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string"))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    NULL roles and texts are empty; NULL turns come first, turns of one number
    in the order of their digests, repeated rows are turns of their own. Rows
    without an id belong to no conversation and make no node. A table without
    conversations gives no rows, not even a root. ``rebuild`` lets every
    conversation begin like the first of its family of ids (a remainder as SQL
    takes it, with the sign of the id). Other columns are not read.
    """
    turns = common.stored(placed_turns(conversations, conv_id, turn, role, text))
    if rebuild:
        turns, convs = rebuilt(turns)
    else:
        convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("turns"))
    blocks = common.stored(_blocks(turns))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("turns").alias("deepest"))
    root = common.cut(root.filter("n_convs > 0"))
    top = root.select("n_convs", "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("up1"), none.alias("up2"), zero.alias("bytes"))
    nodes = common.stored(_nodes(blocks).unionByName(top))

    children = nodes.filter("depth > 0").groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    saved, leaf = (F.col("n_convs") - 1) * F.col("bytes"), (F.col("n_children") == 0).cast("bigint")
    nodes = common.stored(nodes.withColumns({"saved": saved, "leaf": leaf}))
    deepest = root.select("deepest").first()
    sums = _subtree_sums(nodes, deepest[0] if deepest else 0)

    last = blocks.groupBy("c").agg(F.bit_xor("own1").alias("k1"), F.bit_xor("own2").alias("k2"))
    ends = convs.select("c").join(last, "c", "left").select("c", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"))
    parents = nodes.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["k1", "k2"]).join(_end_digests(ends), ["k1", "k2"], "left").join(parents, ["up1", "up2"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295)"""
SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
s AS (SELECT c.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY own, pos) FILTER (WHERE own IS NOT NULL), []) AS seq,
  coalesce(list(strlen(text) ORDER BY own, pos) FILTER (WHERE own IS NOT NULL), []) AS sizes FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(seq) AS n, d, list_aggregate(seq[1:d], 'string_agg', '') AS key, list_aggregate(seq[1:d - 1], 'string_agg', '') AS up, sizes[d] AS size
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT coalesce(key, '') AS key, min(conv_id) AS conv_id, d AS depth, CASE WHEN d > 0 THEN coalesce(any_value(up), '') END AS up, count(*) AS n_convs,
  (count(*) - 1) * coalesce(any_value(size), 0) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY coalesce(key, ''), d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.key),
b AS (SELECT substr(key, 1, 32 * CAST(a AS INT)) AS key, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN b USING (key) LEFT JOIN n q ON q.key = m.up"""
