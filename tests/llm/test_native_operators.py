"""Sharding, URL filter, fingerprints and personal data against plain Python or SQL."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scarpline.llm import hash_tree, pii, queries, syncmers, url_lm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:  # clashing names
        for name in ("shard", "slot", "kind", "spans", "_spans", "sketch", "row", "token", "score", "fp", "_range"):
            df = df.withColumn(name, F.lit(name))
    return df


AWKWARD = [(5, None), (4, ""), (3, "one"), (3, "one"), (2, "a b c d e f g " * 4000), (None, "no id"), (7, "x" * 120_000), (8, "é ñ ü")]


# Sharding


def test_one_more_shard_only_takes_rows(spark):
    rows = hash_tree.shard_rows(table(spark, [(i, f"text {i}") for i in range(3000)])).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 40 < moved < 120
    for s in range(40):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 40 < len(own) < 120


def test_weights_move_rows_only_at_the_changed_leaf(spark):
    tree = hash_tree.even_tree(8, 2, 4)
    heavy = [hash_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    df = spark.range(4000).select(hash_tree.place(F.col("id"), tree).alias("a"), hash_tree.place(F.col("id"), heavy).alias("b"))
    pairs = [tuple(r) for r in df.collect()]
    assert all(a == b or b == 5 for a, b in pairs)
    assert 0.25 < sum(b == 5 for _, b in pairs) / 4000 < 0.35


def test_sharding_of_awkward_rows(spark):
    rows = hash_tree.shard_rows(table(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].size == 16 and by_id[5].text_crc32 == 0
    assert by_id[8].size == 16 + len("é ñ ü".encode()) and by_id[8].text_crc32 == zlib.crc32("é ñ ü".encode())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert hash_tree.shard_rows(table(spark, [])).count() == 0


# URLs


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/en/12", "https://a.com/fr/", "http://b.com/de/1", "x://org", "x://notorg/", "http://h.net#a/b?c", "a://b?c://d/e"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("verdict", F.lit("no")).withColumn("grams", F.lit(1))
    got = {r.page_id: r for r in url_lm.judge(df).collect()}
    assert len(got) == len(urls)
    expected = [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"),
        ("a.com", "/fr/", "com/fr/"), ("b.com", "/de/1", "com/de/"), ("org", "", None), ("notorg", "/", None), ("h.net", "", None), ("b", "", None),
    ]
    for k, (host, path, rule) in enumerate(expected):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict in ("allow", "block")
    assert [got[k].verdict for k in (3, 4, 5, 6)] == ["block", "block", "allow", "block"]
    assert url_lm.judge(df.limit(0)).count() == 0


def test_ratio_separates_what_the_rules_teach(spark):
    rnd = random.Random(1)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.org/{word('abcde')}") for i in range(300)]
    rows += [(300 + i, f"http://x.com/de/{word('uvwxyz')}") for i in range(300)]
    rows += [(600 + i, f"http://{word('abcde')}.net/{word('abcde')}") for i in range(50)] + [(650 + i, f"http://y.net/de/{word('uvwxyz')}") for i in range(50)]
    got = {r.page_id: r for r in url_lm.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert sum(got[i].verdict == "allow" for i in range(600, 650)) > 45
    assert sum(got[i].verdict == "block" for i in range(650, 700)) > 45


# Fingerprints


def plain_sketch(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(F.col("text"))).first()[0]


def test_next_and_edited_texts(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = [(i * 3, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150)))) for i in range(60)] + [(500, None), (501, ""), (502, "ß" * 50_000)]
    got = {r.doc_id: r for r in syncmers.fingerprints(table(spark, rows), rows_a_range=7).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (d, text), (nd, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ([x[i : i + 8] for i in range(0, len(x), 8)] for x in (got[d].fingerprint, got[nd].fingerprint))
        union = sorted({*a, *b})[: syncmers.SKETCH]
        assert got[d].near_next == pytest.approx(len([x for x in union if x in a and x in b]) / len(union))
    long_ones = [got[d] for d, t in rows if t and t.count(" ") > 60]
    assert sum(r.near_edited for r in long_ones) / len(long_ones) > 0.35
    assert max(r.near_next for r in long_ones) < 0.1


def test_range_number_counts_the_cut_points(spark):
    cuts = [-5, 0, 0, *range(10, 900, 7)]
    ids = [-9, -5, -4, 0, 9, 10, 11, 500, 891, 899, 900, 2**62]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for given, block in ((cuts, 128), (cuts, 4), (cuts[:1], 4), ([], 4)):
        got = rows.select("doc_id", syncmers.range_number(F.col("doc_id"), given, block).alias("n")).collect()
        assert {r.doc_id: r.n for r in got} == {i: sum(c >= i for c in set(given)) for i in ids}


def test_anchors_do_not_depend_on_their_surroundings(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(30)]
    inner = " ".join(words[:12])
    one, two = plain_sketch(spark, "p q r " + inner), plain_sketch(spark, inner + " s t u v")
    own = set(plain_sketch(spark, inner))
    assert own <= set(one) and own <= set(two)


def test_fingerprints_of_awkward_rows(spark):
    rows = syncmers.fingerprints(table(spark, AWKWARD), rows_a_range=2).collect()
    assert len(rows) == len(AWKWARD)
    threes = [r for r in rows if r.doc_id == 3]
    assert threes[0].fingerprint == threes[1].fingerprint
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert syncmers.fingerprints(table(spark, [])).count() == 0
    alone = syncmers.fingerprints(table(spark, [(1, "a b c d e f")])).first()
    assert alone.near_next == 1.0


# Personal data

PIECES = [
    "a.b@c.de ", "x@y", "@", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "1.2.3.4", "256.1.1.1", "1.2.3", "+1 (555) 123-4567", "+12",
    "12 34 ", "00000000000000", " 9", "9", "-", "GB82WEST12345698765432", " social 123-45-6789", "123-45-6789", "é", "\n", "+", ".", "A", "_",
    "1.2.3.4.5.6.7.8", "@b.c_d@e.f", "b.c_d@e.f", "card ", "5500 0000 0000 0004",
]


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    rnd = random.Random(4)
    texts = [None, "", "1" * 30_000, "a" * 50_000, "1.2." * 5000] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    path = tmp_path_factory.mktemp("pii")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(path / "documents.parquet")
    return str(path), texts


def test_spans_match_sql(spark, mixed):
    path, _ = mixed
    ours = queries.QUERIES["op3_personal_data"](spark, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    theirs = con.sql(queries.SQL["op3_personal_data"]).df().sort_values("doc_id").reset_index(drop=True)[list(ours.columns)]
    assert (ours.astype(str) == theirs.astype(str)).all().all()


def test_masking_keeps_the_rest(spark):
    rows = table(spark, [(1, "to a.b@c.de, now"), (2, None), (3, ""), (4, "ip 1.2.3.4@x.yz end")]).withColumn("n_chars", F.lit(0).cast("bigint"))
    got = {r.doc_id: r for r in pii.mask(rows).collect()}
    assert got[1].text == "to [EMAIL], now" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == ""
    assert got[4].text == "ip [EMAIL] end"
    assert pii.report(table(spark, [])).count() == 0


@pytest.mark.parametrize("digits,good", [("4111111111111111", True), ("4111111111111112", False), ("00000000000000", True)])
def test_luhn(spark, digits, good):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] is good


def test_mod97(spark):
    assert spark.range(1).select(pii.mod97(F.lit("GB82WEST12345698765432")), pii.mod97(F.lit("GB83WEST12345698765432"))).first() == (True, False)
