"""Quality, passage removal, language model, tokens, tiling and near-duplicates against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scarpline.llm import byte_bpe, common, pairwise_quality, simhash_grid, suffix_dedup, suffix_tree_lm, tiling

AWKWARD = [(5, None), (4, ""), (3, "one"), (3, "one"), (2, "a b c d e f g " * 4000), (None, "no id"), (7, "x" * 120_000), (8, "é ñ ü")]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:  # clashing names
        for name in ("score", "_score", "quality", "held_out", "fp", "cell", "leader", "component", "row", "token", "doc", "start", "ids"):
            df = df.withColumn(name, F.lit(name))
    return df


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 120))) for _ in range(n)]


# Quality


def test_ranking_finds_the_rejected(spark):
    good = prose(1, 200)
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in prose(2, 60)] + ["buy " * 80] * 20
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 280, 2)] + [(0, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in pairwise_quality.classify(table(spark, rows), labels).collect()}
    assert len(got) == 280
    right = sum((got[i].predicted == 1) == (i < 200) for i in range(280))
    assert right >= 272
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = pairwise_quality.classify(table(spark, AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and all(r.predicted == 1 for r in rows)
    one_class = spark.createDataFrame([(2, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert pairwise_quality.classify(table(spark, AWKWARD), one_class).count() == len(AWKWARD)
    assert pairwise_quality.classify(table(spark, []), labels).count() == 0


# Repeated passages


@pytest.mark.parametrize("alphabet", [b"ab", b"\x00a", b"a"])
def test_suffix_array_and_common_prefixes(alphabet):
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(1, 50)
        t = bytes(rnd.choice(alphabet) for _ in range(n))
        text = np.frombuffer(t, np.uint8)
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
        lcp = suffix_dedup.common_prefixes(text, sa).tolist()
        for k in range(1, n):
            a, b = t[sa[k - 1] :], t[sa[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed_by_force(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        t = (text or "").encode()
        marks = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                marks[i : i + 100] = b"\1" * 100
            seen.add(t[i : i + 100])
        spans = sum(marks[i] and not (i and marks[i - 1]) for i in range(len(t)))
        out[d] = (len(t), sum(marks), spans, hashlib.sha256(bytes(b for b, m in zip(t, marks) if not m)).hexdigest())
    return out


def passages(seed):
    rnd = random.Random(seed)
    texts = prose(seed, 40)
    line = prose(seed + 1, 1)[0][:170]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7]) for i in range(20)]  # copies
    rows += [(200 + i, texts[3][: rnd.randint(90, 200)] + " é " + line + texts[i][50:180]) for i in range(25)]  # a common line
    rows += [(300, "z" * 5000), (301, "z" * 300 + line), (302, None), (303, ""), (304, "ab" * 700), (305, texts[1] + texts[1])]
    return rows


@pytest.mark.parametrize("limit", [4096, 6])
def test_removal_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", limit)
    rows = passages(11)
    got = suffix_dedup.digests(table(spark, rows).repartition(5)).collect()
    expected = removed_by_force(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert any(v[1] for v in expected.values())


def test_removal_is_exact_across_batches(spark, monkeypatch):
    """Groups of one anchor or digest that run over many small batches."""
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", 3)
    rows = passages(12)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = suffix_dedup.digests(table(spark, rows).repartition(30)).collect()
    finally:
        spark.conf.set(size, before)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_by_force(rows)


def test_removal_from_awkward_rows(spark):
    got = suffix_dedup.digests(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id: r.n_removed for r in got}[7] == 120_000 - 1  # the second window covers all but one byte
    assert suffix_dedup.digests(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_rows_that_share_an_id_keep_one_copy(spark, monkeypatch, limit):
    """Every passage stays once, also among rows of one id and rows without an id; the largest id is no NULL."""
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", limit)
    texts = [t + " " + u for t, u in zip(prose(71, 12), prose(72, 12), strict=True)]
    top = 2**63 - 1
    rows = [(d, t) for t in texts[:3] for d in (7, 7, None, None)] + [(None, t) for t in texts[3:8]] + [(8, t) for t in texts[5:10]] * 2
    rows += [(None, texts[10][:150] + texts[11]), (None, texts[11]), (top, texts[10])]
    got = suffix_dedup.remove_repeats(table(spark, rows).coalesce(1)).collect()
    order = sorted(range(len(rows)), key=lambda k: (top if rows[k][0] is None else rows[k][0], k))
    force = removed_by_force([(n, rows[k][1]) for n, k in enumerate(order)])
    expected = sorted((str(rows[k][0]), *force[n]) for n, k in enumerate(order))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == expected
    assert any(r.doc_id == 7 and r.n_removed == 0 for r in got)


# Language model


def test_base_score_and_tree(spark):
    rows = [(i, t + (" The the THE" if i % 2 else "")) for i, t in enumerate(prose(21, 200))] + [(900, None), (901, ""), (902, "never-seen-word"), (903, "ü\x0bé\x1cx")]
    got = {r.doc_id: r for r in suffix_tree_lm.score(table(spark, rows), frequent=50).collect()}
    assert len(got) == len(rows)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in (t or "").encode().lower().split())
    end = sum(not h for h in held.values())
    n, v = counts.total() + end, len(counts) + 1
    for d, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in words), end])
        assert (got[d].held_out, got[d].n_tokens, got[d].train_tokens) == (held[d], len(words) + 1, n)
        assert got[d].n_known == sum(counts[w] > 0 for w in words) + 1
        assert got[d].base_score == pytest.approx(base)
        assert math.isfinite(got[d].score) and got[d].score < 0
    again = {r.doc_id: r.score for r in suffix_tree_lm.score(table(spark, rows)).collect()}
    assert all(again[d] == pytest.approx(got[d].score) for d, _ in rows)  # lookup and join agree


def test_tree_is_a_distribution(spark):
    grams = spark.createDataFrame([(b"abab",), (b"abac",), (b"zz",)], "token binary")
    tree = suffix_tree_lm.grow(suffix_tree_lm.count_grams(grams))
    context = (ord("a") << 8) | (ord(" ") << 16)
    total = 10 ** tree.log10(np.array([context | s for s in range(256)]))
    assert total.sum() == pytest.approx(1.0)
    states = suffix_tree_lm.word_states(np.random.default_rng(1).integers(0, 50, (4, 9)).astype(float))
    assert (10**states).sum(axis=1) == pytest.approx(1.0)


def word_tree_by_force(texts, tokens):
    """log10 probability of the symbols of a text, every context tested against the next shorter one."""
    lm = suffix_tree_lm
    number = {t: k for k, t in enumerate(tokens)}
    symbols = lambda t: [lm.OPENING, *(number.get(w, lm.SYMBOLS + lm.word_class(w)) for w in t.encode().lower().split()), lm.TEXT_END]
    met, root = {}, Counter()
    for t in texts:
        s = symbols(t)
        root.update(s[1:])
        for i in range(1, len(s)):
            for d in range(1, min(i, lm.WORD_DEPTH) + 1):
                met.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    total, width = sum(root.values()), lm.TEXT_END + 1

    def retained(context):
        own = met.get(context, Counter())
        seen, up = sum(own.values()), met[context[1:]] if len(context) > 1 else None
        if seen < lm.MIN_COUNT:
            return False
        before = (lambda s: up[s] / sum(up.values())) if up else (lambda s: (root[s] + 0.5) / (total + 0.5 * width))
        return sum(n * math.log(n / seen / before(s)) for s, n in own.items()) > lm.GAIN * len(own) * math.log(seen)

    known = {c for c in met if retained(c)}

    def p(context, s):
        if not context:
            return (root[s] + 0.5) / (total + 0.5 * width)
        up = p(context[1:], s)
        return (met[context][s] + lm.WORD_PRIOR * up) / (sum(met[context].values()) + lm.WORD_PRIOR) if context in known else up

    def score(t):
        s = symbols(t)
        return sum(math.log10(p(tuple(s[max(0, i - lm.WORD_DEPTH) : i]), s[i])) for i in range(1, len(s)))

    return score, known


@pytest.mark.parametrize("entries,positions", [(4_000_000, 4_000_000), (0, 50)])
def test_word_contexts_of_all_lengths_count(spark, monkeypatch, entries, positions):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    few, many = words[:6], words[200:206]
    follow = {pair: rnd.choice(words) for pair in [(a, b) for a in few for b in many] + [(b, a) for a in few for b in many]}
    texts = []
    for _ in range(600):
        t = [rnd.choice(words)]
        for _ in range(rnd.randint(0, 12)):
            a, b = rnd.choice(few), rnd.choice(many)
            kind = rnd.random()  # a word that follows from the two before it, or from the first and third
            t += [a, b, follow[a, b]] if kind < 0.5 else [a, "w210", b, follow[b, a]] if kind < 0.9 else [rnd.choice(words), "é" * rnd.randint(1, 3)]
        texts.append(" ".join(t))
    texts += ["", None, "w1 w200"]
    learn = [i % 5 != 1 for i in range(len(texts))]
    counts = Counter(w for t, own in zip(texts, learn) if own for w in (t or "").encode().split())
    monkeypatch.setattr(suffix_tree_lm, "ENTRIES", entries)
    monkeypatch.setattr(suffix_tree_lm, "POSITIONS", positions)
    tokens = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:250]]
    own = suffix_tree_lm.WordSymbols(tokens)
    rows = [(i, g, bytearray(own.of((t or "").encode().split()).tobytes())) for i, (t, g) in enumerate(zip(texts, learn))]
    sequences = spark.createDataFrame(rows, "row bigint, learn boolean, symbols binary").repartition(3)
    pairs = suffix_tree_lm.count_pairs(sequences)
    states = suffix_tree_lm.word_states(pairs)
    longer = suffix_tree_lm.grow_words(sequences, pairs, states)
    scored = suffix_tree_lm.word_scores(sequences, states, longer).groupBy("row").agg(F.sum("tree").alias("tree")).collect()
    score, known = word_tree_by_force([t or "" for t, g in zip(texts, learn) if g], tokens)
    assert {len(c) for c in known} >= {1, 2, 3}  # contexts of every length are retained
    assert len(scored) == len(texts)
    for r in scored:
        assert r["tree"] == pytest.approx(score(texts[r["row"]] or ""))


def test_language_model_of_awkward_rows(spark):
    assert suffix_tree_lm.score(table(spark, AWKWARD)).count() == len(AWKWARD)
    assert suffix_tree_lm.score(table(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = suffix_tree_lm.score(table(spark, [(held, "no training texts")])).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.base_score == 0.0


# Tokens


def test_tokens_equal_the_public_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    sets = ["abc ABC'st\n\t  ", "éñü漢字 12٣½ ", "".join(map(chr, range(1, 0x250))), "🎉👩‍👩‍👧 ‍"]
    texts = ["".join(rnd.choice(rnd.choice(sets)) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["<|endoftext|>", "a" * 5000, None]
    got = {r.doc_id: r for r in byte_bpe.encode(table(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    assert byte_bpe.digests(table(spark, AWKWARD), path, public_tokenizers.PATTERN).count() == len(AWKWARD)
    assert byte_bpe.digests(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


# Tiling


def coverage_by_force(item, text):
    """Greedy string tiling as first published: longest match first, over all position pairs."""
    p, t = tiling.words(item.encode()), tiling.words(text.encode())
    marked_p, marked_t = [False] * len(p), [False] * len(t)
    while True:
        best = (tiling.SEED_WORDS - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not marked_p[i + k] and not marked_t[j + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        k, j, i = best[0], -best[1], -best[2]
        if k < tiling.SEED_WORDS:
            return sum(marked_p)
        for x in range(k):
            marked_p[i + x] = marked_t[j + x] = True


def test_tiles_match_brute_force(spark):
    items = [t[:160] for t in prose(31, 8)]
    rnd = random.Random(8)
    docs = []
    for k in range(60):
        words = items[k % 8].split()
        third = len(words) // 3
        moved = words[2 * third :] + words[:third] + words[third : 2 * third]
        docs.append((k, " ".join([prose(k, 1)[0], *(moved if k % 3 else words[: rnd.randint(0, len(words))]), "tail, TAIL"])))
    docs += [(100, None), (101, ""), (102, items[0].upper().replace(" ", ", "))]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in tiling.overlaps(table(spark, docs), bench, coverage=0.01, block_items=3).collect()}
    expected = {}
    for d, t in docs:
        for i, item in enumerate(items):
            covered = coverage_by_force(item, t or "")
            if covered:
                expected[d, i] = covered
    assert got == expected
    left = {r.doc_id for r in tiling.decontaminate(table(spark, docs), bench).collect()}
    assert 102 not in left and {100, 101} <= left
    assert not left & {k for k in range(60) if k % 3}  # reordered passages


def test_tiling_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "f g a b c")], "item_id bigint, text string")
    rows = tiling.overlaps(table(spark, AWKWARD), bench).collect()
    assert {r.doc_id for r in rows} == {2} and len(rows) == 3
    assert tiling.overlaps(table(spark, AWKWARD), bench.limit(0)).count() == 0
    assert tiling.overlaps(table(spark, []), bench).count() == 0
    assert tiling.decontaminate(table(spark, AWKWARD), bench).count() == len(AWKWARD) - 1


# Near-duplicates


def fingerprint_by_force(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(text, rnd, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = "edit"
    return " ".join(words)


def groups_by_force(ids, near):
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_classes_match_brute_force(spark):
    rnd = random.Random(9)
    texts = prose(41, 60)
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(1000 + i, edited(texts[i % 5], rnd, i % 4)) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "two words"), (2004, "Two WORDS")]
    got = {r.doc_id: r for r in simhash_grid.classes(table(spark, rows)).collect()}
    fps = {d: fingerprint_by_force(t) for d, t in rows}
    expected = groups_by_force(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", expected[d]) for d in fps}
    assert len(set(expected.values())) < len(rows)


def test_grid_loses_no_link(spark):
    rnd = random.Random(10)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for n in (3, 4, 5):
            g = f
            for b in rnd.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = {(r.a, r.b) for r in simhash_grid.link(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 4}
    assert got == expected


def test_manhattan_distance_of_packed_counts(spark):
    rnd = random.Random(12)
    rows = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(50)]
    counts = [simhash_grid.segment_counts(F.col(c)) for c in "ab"]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", simhash_grid.manhattan(*counts)).collect()
    for a, b, d in got:
        assert d == sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)) <= (a ^ b).bit_count()


def test_one_row_of_each_near_duplicate_group_stays(spark):
    rnd = random.Random(13)
    texts = [" ".join(prose(50 + i, 3)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, edited(texts[i % 8], rnd, 1)) for i in range(60)] + [(300 + i, texts[9]) for i in range(50)]
    left = {r.doc_id for r in simhash_grid.drop_near_duplicates(table(spark, rows).repartition(6)).collect()}
    assert left == set(range(40))


def near_groups_by_force(rows, k=5, similarity=0.8):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = {d: shingles(t) for d, t in rows}
    return groups_by_force(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) >= similarity)


def chained(seed, chains, steps, words_a_text=200, words_a_step=17):
    """Copies of copies: each exchanges a further stretch, so that only neighbours are near; ids in mixed order."""
    rnd = random.Random(seed)
    fresh = lambda n: ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(chains):
        words = fresh(words_a_text)
        for step in range(steps):
            texts.append(" ".join(words))
            at = step * words_a_step
            words = words[:at] + fresh(words_a_step) + words[at + words_a_step :]
    return list(zip(rnd.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_chained_copies_are_one_group(spark, parts):
    rows = chained(61, 12, 8)
    expected = near_groups_by_force(rows)
    assert len(set(expected.values())) == 12
    left = {r.doc_id for r in simhash_grid.drop_near_duplicates(table(spark, rows).repartition(parts)).collect()}
    assert left == set(expected.values())


def test_near_duplicates_are_verified(spark):
    """Pairs on both sides of the similarity, most of them close to it."""
    rnd = random.Random(62)
    fresh = lambda n: ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(200):
        words = fresh(204)
        n = 10 + i % 20  # exchanged at the end: similarity (200 - n) / (200 + n), 0.8 at n = 22
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 204 - n] + fresh(n)))]
    expected = near_groups_by_force(rows)
    left = {r.doc_id for r in simhash_grid.drop_near_duplicates(table(spark, rows)).collect()}
    assert left == set(expected.values())
    assert 200 < len(left) < 400


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash_grid.classes(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash_grid.classes(table(spark, [])).count() == 0
    left = [r.doc_id for r in simhash_grid.drop_near_duplicates(table(spark, AWKWARD)).collect()]
    assert None in left and 4 in left and 5 not in left
    assert simhash_grid.drop_near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 100), (300, 200), (400, 400)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[300] == 100 and 400 not in got
