"""Conversation trie, source divergence and pivot index against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.llm import block_trie, cube_divergence, pivot_index, queries, suffix_tree_lm

# Conversation trie


def plain_trie(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(np.fmod(c, 5))
        built[c] = tuple((own.get(base, [])[:h] if rebuild else []) + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
        leaves = sum(not children[x] for x in below)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves, saved, digest))
    return Counter(out)


def conversations(seed, n=60, ids=None):
    draw = np.random.default_rng(seed)
    ids = ids or list(range(n))
    rows = []
    for c in ids:
        for t in range(int(draw.integers(1, 12))):
            rows.append((c, t, ["user", "assistant", None][int(draw.integers(3))], ["a", "bé", "", None, "long " * 40][int(draw.integers(5)) if t > 2 else 0]))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,block,segment", [(1, 4, 4096), (2, 1, 3), (3, 3, 2)])
def test_trie_matches_plain(spark, monkeypatch, seed, block, segment):
    monkeypatch.setattr(block_trie, "BLOCK", block)
    monkeypatch.setattr(block_trie, "SEGMENT", segment)
    rows = conversations(seed)
    found = block_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, found)) == plain_trie(rows)


def test_trie_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(block_trie, "SLICE_BITS", 3)
    rows = [(c, t, "user", f"t{t}") for c in range(100, 180) for t in range(9)]  # one large group of copies
    rows += [(7, None, None, None), (7, None, "", ""), (7, 1, "x", "tie"), (7, 1, "y", "tie"), (7, 1, "y", "tie")]
    rows += [(None, 1, "user", "no id"), (-3, 0, "user", "minus"), (-5, 0, "user", "base"), (13, 5, "u", "w" * 100_000)]
    rows += [(20, t, "user", str(t)) for t in range(60)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", c long, depth long, d long").repartition(3)
    for rebuild in (True, False):
        found = block_trie.trie(df, rebuild=rebuild).collect()
        assert Counter(map(tuple, found)) == plain_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    assert block_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert block_trie.trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)).collect() == []


# Source divergence


def plain_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= 3}
        count = {None: Counter(t for d in own for t in d[2] if t in kept)}
        for s in {d[1] for d in own}:
            count[s] = Counter(t for d in own if d[1] == s for t in d[2] if t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        for s in p:
            if s is None:
                continue
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o not in (s, None)]
            top = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, limit in (("pair", pairs, None), ("term", top, 200)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return Counter(out)


def sources(seed, n=300):
    draw = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(80)] + ["É", "é", "Straße", "o'clock", "x1y"]
    rows = []
    for _ in range(n):
        text = " ".join(words[int(draw.zipf(1.5)) % len(words)] for _ in range(int(draw.integers(0, 40))))
        rows.append((["en", "de", None, ""][int(draw.integers(4))], ["hot", "a", "b", None, "c", "d", "e"][max(0, int(draw.integers(-4, 7)))], text))
    return rows


@pytest.mark.parametrize("groups,terms,held", [(32, 8192, 400_000), (2, 7, 50), (1, 1000, 1)])
def test_audit_matches_plain(spark, monkeypatch, groups, terms, held):
    for name, value in (("GROUPS", groups), ("TERMS", terms), ("HELD", held)):
        monkeypatch.setattr(cube_divergence, name, value)
    rows = sources(groups)
    found = cube_divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)).collect()
    assert Counter(map(tuple, found)) == plain_audit(rows)


def test_audit_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(cube_divergence, "PIECE", 16)
    rows = [(None, None, None), ("en", "s1", ""), ("en", "s2", None), ("fr", "only", "un"), ("es", "a", "uno"), ("es", "b", "dos 123")]
    rows += [("de", s, "Wörter " * 50 + "ÄHNLICH ähnlich aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" + "c" * 100) for s in ("x", "y", "y", None)]
    df = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], "lang string, source string, text string, term string, n long, kept long")
    assert Counter(map(tuple, cube_divergence.audit(df).collect())) == plain_audit(rows)
    assert cube_divergence.audit(df.limit(0)).collect() == []


def test_shares_are_exact():
    draw = np.random.default_rng(5)
    total = draw.integers(1, 9 * 10**15, 1000)
    n = (total * draw.random(1000)).astype(np.int64) - 1
    n = np.clip(n, 0, total - 1)
    assert cube_divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]


# SQL of both


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_cube_divergences"])
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.SQL[name])
    assert [d[0] for d in cur.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(cur.fetchall())


# Pivot index


def plain_links(rows, threshold=0.95):
    vectors = [None if v is None or not len(v) or None in v or not np.isfinite(v).all() or not np.any(v) else np.asarray(v, dtype=np.float64) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    for size in {len(v) for v in vectors if v is not None}:
        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
        m = np.stack([vectors[i] / np.abs(vectors[i]).max() for i in at])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        link[np.ix_(at, at)] = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    part = np.arange(n)
    while True:
        low = np.minimum(part, np.where(link, part[None, :], n).min(axis=1))
        if (low == part).all():
            break
        part = low
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(part == part[i]) if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec_id, int(link[i].sum()), least, vec_id == least))
    return Counter(out)


def near(draw, centre, cosine, n):
    centre = centre / np.linalg.norm(centre)
    noise = draw.normal(size=(n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * noise


def planted(seed, size=64):
    draw = np.random.default_rng(seed)
    parts = [draw.normal(size=(600, size))]
    parts += [near(draw, draw.normal(size=size), c, n) for c, n in ((0.995, 700), (0.994, 60), (0.999, 5), (0.994, 30))]
    parts.append(np.repeat(draw.normal(size=(1, size)), 40, axis=0) * np.arange(1, 41)[:, None])
    m = np.concatenate(parts).astype(np.float32)
    return [(int(i), v.tolist()) for i, v in zip(draw.permutation(len(m)), m, strict=True)]


@pytest.mark.parametrize("block,short,parts", [(1024, 16, 4), (64, 16, 1), (32, 2, 17)])
def test_links_match_brute_force(spark, monkeypatch, block, short, parts):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    monkeypatch.setattr(pivot_index, "SHORT", short)
    rows = planted(parts)
    found = pivot_index.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)).collect()
    assert Counter(map(tuple, found)) == plain_links(rows)


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(9)
    base = draw.normal(size=(1500, 64))
    pairs = np.concatenate([base] + [np.concatenate([near(draw, x, 0.951, 1) for x in base])])
    rows = [(i, v.tolist()) for i, v in enumerate(pairs)]
    found = pivot_index.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    links = sum(n * c for (_, n, _, _), c in plain_links(rows).items())
    assert links >= 3000 and 0.9 * links <= found["n_links"].sum() <= links


def test_chains_and_large_rings(spark):
    draw = np.random.default_rng(4)
    a, b = np.linalg.qr(draw.normal(size=(64, 2)))[0].T
    angle = np.linspace(0, 1.2, 400)  # every vector links to those within 18 degrees only
    rows = [(i, v.tolist()) for i, v in enumerate(np.cos(angle)[:, None] * a + np.sin(angle)[:, None] * b)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(near(draw, a, 0.976, 300))]
    found = pivot_index.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).toPandas()
    links = sum(n * c for (_, n, _, _), c in plain_links(rows).items())
    assert 0.9 * links <= found["n_links"].sum() <= links


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0])]
    rows += [(9, one), (9, one), (8, [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.001]), (7, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (11, [1e-300, 2e-300, 3e-300])]
    rows += [(None, [-1.0, 0.0, 0.0]), (None, None), (12, [-5.0]), (13, [-2.0]), (14, [3.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row long, ball long")
    found = Counter(map(tuple, pivot_index.classes(df).collect()))
    expected = Counter({(i, n, c, True if i is None and c is None else k if i is not None else False): m for (i, n, c, k), m in plain_links(rows).items()})
    assert found == expected
    assert pivot_index.classes(df.limit(0)).collect() == []
    assert {tuple(r) for r in pivot_index.classes(df.filter("vec_id <= 6")).collect()} == {(i, 0, i, True) for i in range(1, 7)}


# SimHash components in crowded cells


@pytest.mark.parametrize("block,short,parts", [(1024, 16, 3), (16, 4, 1), (40, 2, 17)])
def test_spanning_links_connect_what_pairs_connect(spark, monkeypatch, block, short, parts):
    from scarpline.llm import common, simhash_grid

    monkeypatch.setattr(simhash_grid, "CELL_BLOCK", block)
    monkeypatch.setattr(simhash_grid, "CELL_SHORT", short)
    draw = np.random.default_rng(block)
    centres = draw.integers(0, 2**63, 6)
    fps = {int(c) ^ sum(1 << int(b) for b in draw.choice(63, int(draw.integers(0, 4)), replace=False)) for c in centres[:3] for _ in range(120)}  # dense groups
    chain = int(centres[3])
    for i in range(15):  # each two bits further: far ends are connected, not near
        fps.add(chain)
        chain ^= 0b11 << (4 * i)
    fps |= {int(x) for x in draw.integers(0, 2**63, 100)} | {0, 3, 31}
    signed = sorted(fps)
    near = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin(a ^ b).count("1") <= 4}
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(parts)
    found = {tuple(sorted((r.a, r.b))) for r in simhash_grid.spanning_links(df).collect()}
    assert len(found) < len(near)
    part = {f: f for f in signed}

    def top(f):
        while part[f] != f:
            f = part[f]
        return f

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        part[y] = x
    reached = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(list(found), "a bigint, b bigint")).collect()}
    assert {f: reached.get(f, f) for f in signed} == {f: top(f) for f in signed}


def test_rows_without_ids_link_others(spark):
    """Two texts that are linked only through the fingerprint of a row without an id."""
    from scarpline.llm import simhash_grid

    fps = [(1, 0b0), (None, 0b1111), (2, 0b11111111), (None, 1 << 40 | 0xFFF << 44)]
    df = spark.createDataFrame(fps, "doc_id bigint, fp bigint")
    whole = simhash_grid.fingerprints
    try:
        simhash_grid.fingerprints = lambda docs, *_: docs
        out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_grid.classes(df).collect()}
    finally:
        simhash_grid.fingerprints = whole
    assert out[(1, "0" * 16)] == out[(2, "00000000000000ff")] == out[(None, "000000000000000f")] == 1
    assert [v for k, v in out.items() if k[1].startswith("00fff1")] == [None]


# Near-duplicate groups in crowded bands


def shingle_jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return 1.0 if x == y else len(x & y) / max(len(x | y), 1)


@pytest.mark.parametrize("block,columns,parts", [(256, 4096, 3), (16, 64, 1), (24, 1000, 17)])
def test_crowded_bands_equal_brute_force(spark, monkeypatch, block, columns, parts):
    """A hot group of edited copies most of whose pairs are below the similarity, with chains and repeated ids."""
    from scarpline.llm import simhash_grid

    monkeypatch.setattr(simhash_grid, "SET_BLOCK", block)
    monkeypatch.setattr(simhash_grid, "COLUMNS", columns)
    draw = np.random.default_rng(parts)
    base = [f"w{i}" for i in draw.integers(0, 500, 150)]

    def edited(n):
        out = list(base)
        for at in draw.choice(150, n, replace=False):
            out[at] = f"x{draw.integers(10**6)}"
        return " ".join(out)

    texts = [edited(int(draw.integers(1, 7))) for _ in range(90)] + [" ".join(base)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain[i * 8] = f"y{i}"
        texts.append(" ".join(chain))
    texts += ["", None, "a b", "A  b", "other text of some six words", " "]
    rows = [(int(i), t) for i, t in enumerate(texts)] + [(3, "a text of its own under an id that repeats"), (None, texts[0]), (3, texts[3])]
    order = draw.permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], 1) for i in order], "doc_id long, text string, _row int").repartition(parts)
    kept = Counter((r["doc_id"], r["text"], r["_row"]) for r in simhash_grid.drop_near_duplicates(df, similarity=0.8).collect())

    known = [r for r in rows if r[0] is not None]
    part = list(range(len(known)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            if shingle_jaccard(known[i][1] or "", known[j][1] or "") >= 0.8 and top(i) != top(j):
                part[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(known):
        groups.setdefault(top(i), []).append(r)
    assert Counter(r[0] for r in kept.elements()) == Counter([min(r[0] for r in g) for g in groups.values()] + [None])
    for r in kept.elements():
        assert r[0] is None or any((r[0], r[1]) in g for g in groups.values())


def test_set_fingerprints():
    from scarpline.llm import simhash_grid

    draw = np.random.default_rng(5)
    for n in (0, 1, 4, 255, 256, 700):
        shingles = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        alone = np.concatenate([simhash_grid.set_fingerprint(shingles[i : i + 1], 3) for i in range(n)] or [np.empty(0, np.uint64)]).reshape(n, 3)
        expected = [sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in alone[:, w]) > n) for w in range(3)]
        assert simhash_grid.set_fingerprint(shingles, 3).tolist() == expected
        assert len({*alone.ravel().tolist()}) == 3 * n


@pytest.mark.parametrize("block,tile,segments", [(65_536, 512, 6), (20, 8, 6), (65_536, 16, 7)])
def test_near_duplicates_meet_in_the_grid_of_segment_counts(spark, monkeypatch, block, tile, segments):
    """Neighbours are the rows with equal counts in a table and within the radius; a lead is one, the flag tells of a second."""
    from scarpline.llm import simhash_grid

    monkeypatch.setattr(simhash_grid, "NEAR_BLOCK", block)
    monkeypatch.setattr(simhash_grid, "TILE", tile)
    draw = np.random.default_rng(segments)
    sets = []
    for size in [1] * 40 + [2] * 20 + [7] * 4 + [60]:  # rows alone, pairs, groups
        base = draw.integers(0, 2**64, 90, dtype=np.uint64)
        for _ in range(size):
            own = base.copy()
            own[draw.choice(90, int(draw.integers(0, 12)) if size > 1 else 0, replace=False)] = 0
            sets.append(np.unique(np.concatenate([own[own > 0], draw.integers(0, 2**64, 3, dtype=np.uint64)])))
    words = simhash_grid.word_count(0.8, 0.9999, segments, simhash_grid.TIES)
    early, radius = simhash_grid.reach(0.8, 1), simhash_grid.reach(0.8, simhash_grid.REACH_WORDS)
    fps = [[int(w) for w in simhash_grid.set_fingerprint(s, words)] for s in sets]
    counts = [tuple((w >> at & 3).bit_count() for w in fp for at in range(0, 64, 2)) for fp in fps]
    starts = [32 * w + segments * t for w in range(words) for t in range(32 // segments)]
    n_words = simhash_grid.REACH_WORDS

    def near(a, b):
        apart = [(x ^ y).bit_count() for x, y in zip(fps[a][:n_words], fps[b][:n_words], strict=True)]
        met = any(counts[a][s : s + segments] == counts[b][s : s + segments] for s in starts)
        return a != b and met and sum(apart) <= radius and max(apart[: simhash_grid.EARLY_WORDS]) <= early

    expected = {a: [b for b in range(len(sets)) if near(a, b)] for a in range(len(sets))}
    df = spark.createDataFrame([(i, np.array(fp, np.uint64).view(np.int64).tolist()) for i, fp in enumerate(fps)], "id bigint, fp array<bigint>")
    got = {r["id"]: (r["lead"], r["several"]) for r in simhash_grid.neighbours(df, segments, early, radius).collect()}
    assert set(got) == {a for a, b in expected.items() if b}
    assert all(lead in expected[a] and several == (len(expected[a]) > 1) for a, (lead, several) in got.items())
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert both / (len(sets[a]) + len(sets[b]) - both) < 0.8 or b in expected[a]


@pytest.mark.parametrize("cut", [1, 2_048])
def test_coarse_cells_find_pairs_with_few_copies(spark, monkeypatch, cut):
    """Pairs at the similarity are found, whether their cells are cut or not; a row is shuffled 40 times (65 with a cell a table)."""
    from scarpline.llm import simhash_grid

    monkeypatch.setattr(simhash_grid, "CUT_ROWS", cut, raising=False)
    shuffled, met_in_cells = [], simhash_grid._met_in_cells

    def counted(*args):
        out = met_in_cells(*args)
        shuffled.append(out.count())
        return out

    monkeypatch.setattr(simhash_grid, "_met_in_cells", counted)
    draw = np.random.default_rng(cut)
    words, pairs = simhash_grid.word_count(0.8, 0.9999, 6, simhash_grid.TIES), 1500
    one = draw.integers(0, 2, (pairs, 64 * words), dtype=np.uint8)
    two = one ^ (draw.random(one.shape) < simhash_grid.differing(0.8, simhash_grid.TIES))
    fps = np.packbits(np.concatenate([one, two]), axis=1, bitorder="little").view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(fps)), "id bigint, fp array<bigint>")
    bounds = 6, simhash_grid.reach(0.8, 1), simhash_grid.reach(0.8, simhash_grid.REACH_WORDS)
    extra = [F.lit(5)] if hasattr(simhash_grid, "coarse_words") else []
    if extra:
        assert simhash_grid.coarse_words(0.8, 0.9999, 6, simhash_grid.TIES) == 5
        extra = [simhash_grid.own_segments(0.8, 0.9999), *extra]
    leads = {r["id"]: r["lead"] for r in simhash_grid.neighbours(df, *bounds, *extra).collect()}
    assert sum(leads.get(i) != (i + pairs) % (2 * pairs) for i in range(2 * pairs)) <= 4
    assert shuffled == [40 * 2 * pairs]


def test_cut_cells_and_shuffled_groups_equal_brute_force(spark, monkeypatch):
    """The same groups where cells are cut and groups are too many to be sent to the texts."""
    from scarpline.llm import simhash_grid

    monkeypatch.setattr(simhash_grid, "CUT_ROWS", 4)
    monkeypatch.setattr(simhash_grid.skew, "fits_broadcast", lambda *_: False)
    test_crowded_bands_equal_brute_force(spark, monkeypatch, 65_536, 16, 3)


def test_pairs_of_blocks_equal_brute_force(spark, monkeypatch):
    """The same groups where a crowd fills many blocks, and parts have blocks of their own."""
    from scarpline.llm import simhash_grid

    monkeypatch.setattr(simhash_grid, "GROUP_SHINGLES", 1500)
    monkeypatch.setattr(simhash_grid, "neighbours", lambda fps, *_: fps.select("id", F.col("id").alias("lead"), F.lit(True).alias("several")))  # none is linked before
    test_crowded_bands_equal_brute_force(spark, monkeypatch, 16, 64, 3)


@pytest.mark.parametrize("block,tile,links", [(65_536, 512, 500_000), (40, 8, 10)])
def test_a_crowd_gives_rows_in_proportion(spark, monkeypatch, block, tile, links):
    """Parts that neighbours connect stay connected; rows made grow with a crowd, not with its square."""
    from scarpline.llm import common, simhash_grid

    monkeypatch.setattr(simhash_grid, "NEAR_BLOCK", block)
    monkeypatch.setattr(simhash_grid, "TILE", tile)
    monkeypatch.setattr(simhash_grid, "LINKS", links)
    segments, early, radius = 6, simhash_grid.reach(0.8, 1), simhash_grid.reach(0.8, simhash_grid.REACH_WORDS)
    made = []
    for n in (100, 400):
        draw = np.random.default_rng(n)
        centres = draw.integers(0, 2**64, (3, 13), dtype=np.uint64)
        fps = []
        for i in range(n):
            fp = centres[0 if i % 10 else 1 + i % 3 % 2].copy()
            for b in draw.choice(13 * 64, 60, replace=False):
                fp[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            fps.append(fp)
        parts = [i if i % 3 else 0 for i in range(n)]
        counts = [tuple((int(w) >> at & 3).bit_count() for w in fp for at in range(0, 64, 2)) for fp in fps]
        starts = [32 * w + segments * t for w in range(13) for t in range(32 // segments)]
        near = {}
        for a in range(n):
            for b in range(a):
                apart = [(int(x) ^ int(y)).bit_count() for x, y in zip(fps[a][:4], fps[b][:4], strict=True)]
                if parts[a] != parts[b] and sum(apart) <= radius and max(apart[:2]) <= early and any(counts[a][s : s + segments] == counts[b][s : s + segments] for s in starts):
                    near[a, b] = near[b, a] = sum(apart)
        df = spark.createDataFrame([(i, fp.view(np.int64).tolist(), parts[i]) for i, fp in enumerate(fps)], "id bigint, fp array<bigint>, part bigint")
        got = simhash_grid.across(df, segments, early, radius).collect()
        for r in got:
            assert near[r["id"], r["nearest"]] == r["bits"] and parts[r["id"]] == r["part"] != parts[r["nearest"]]

        def parts_of(edges):
            x, y = np.array(edges, dtype=np.int64).reshape(-1, 2).T
            return common.spanning_pairs(n, x, y).tolist()

        assert parts_of([(r["part"], r["reached"]) for r in got]) == parts_of([(parts[a], parts[b]) for a, b in near])
        made.append(len(got))
    if block > 400:
        assert made[1] < 8 * made[0]  # 4 times the rows, 16 times the pairs


def test_a_row_of_a_crowd_comes_to_its_group_once(spark):
    from scarpline.llm import simhash_grid

    rows = [(i, i, 1, 100) for i in range(3000)] + [(3000 + i, 3000, 2, 100) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, part bigint, crowd bigint, n bigint")
    got = Counter(r["id"] for r in simhash_grid._apart(df).collect())
    assert got == Counter(range(3000))  # rows of one part need no comparison


def test_texts_that_stay_are_not_shuffled(spark):
    """The rows that are kept are told by bits sent to them, whatever the size from which joins are not broadcast."""
    from scarpline.llm import simhash_grid

    rows = [(i, f"a text of some words {i // 2 if i % 5 else i} and of {i // 2} more") for i in range(200)] + [(None, "x"), (-5, "y z"), (2**62, "y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash_grid.drop_near_duplicates(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning(_row" in line]
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    first = {}
    for d, t in rows:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    assert {r["doc_id"] for r in got} == {*first.values(), None} and len(got) == len(first) + 1
    ids = spark.createDataFrame([(v,) for v in (0, 63, 64, -1, 2**62, -(2**63))], "id bigint")
    every = spark.createDataFrame([(v,) for v in (0, 1, 62, 63, 64, 65, -1, -2, 2**62, 2**62 + 1, -(2**63))], "a bigint")
    assert {r["a"] for r in simhash_grid._picked(every, "a", ids, True).collect()} == {0, 63, 64, -1, 2**62, -(2**63)}
    assert {r["a"] for r in simhash_grid._picked(every, "a", ids, False).collect()} == {1, 62, 65, -2, 2**62 + 1}


def test_small_sets_at_the_similarity_are_found(spark):
    """Pairs of four and five, and of nine shingles, where even votes make more bits differ."""
    from scarpline.llm import simhash_grid

    from scarpline.llm import simhash_grid

    rows = []
    for i in range(150):
        words = [f"{i}x{j}" for j in range(13)]
        rows += [(4 * i, " ".join(words[:9])), (4 * i + 1, " ".join(words[:8])), (4 * i + 2, " ".join([*words[:9], "a", *words[9:12], f"b{i}"])), (4 * i + 3, " ".join([*words[:9], "a", *words[9:12], "c"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_force = {d for d, _ in rows if d % 4 in (0, 2)}
    assert shingle_jaccard(rows[0][1], rows[1][1]) == 0.8 <= shingle_jaccard(rows[2][1], rows[3][1])
    assert shingle_jaccard(rows[0][1], rows[2][1]) < 0.8
    assert {r["doc_id"] for r in simhash_grid.drop_near_duplicates(df).collect()} == by_force


def test_shared_counts():
    from scarpline.llm import simhash_grid

    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 300, int(n)).astype(np.uint64)) for n in (0, 1, 50, 200, 120)]
    out = simhash_grid.shared_counts(sets, sets[1:])
    assert out.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]


# Benchmark tiles: short items, repeated ids, common seeds


def test_short_items_and_repeated_ids(spark):
    from scarpline.llm import tiling

    docs = [(1, "say one two three here"), (5, "the whole BENCHMARK passage of seven words"), (5, "a clean text"), (None, "one  TWO, three"), (7, "one two"), (8, None), (9, "three")]
    items = [(10, "one two three"), (11, "the whole benchmark passage of seven words"), (12, "One two three!"), (None, "one two three"), (13, ""), (14, None), (15, "three")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, q int, item_id int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = Counter((r["doc_id"], r["item_id"], r["n_words"], r["n_covered"]) for r in tiling.overlaps(df, bench, block_items=2).collect())
    expected = Counter({(d, i, 3, 3): 1 for d in (1, None) for i in (10, 12, None)} | {(5, 11, 7, 7): 1} | {(d, 15, 1, 1): 1 for d in (1, None, 9)})
    assert found == expected
    kept = Counter(map(tuple, tiling.decontaminate(df, bench, block_items=2).collect()))
    assert kept == Counter([(5, "a clean text", 1, 2), (7, "one two", 1, 2), (8, None, 1, 2)])
    assert tiling.decontaminate(df, bench.limit(0)).count() == len(docs) and tiling.decontaminate(df.limit(0), bench).count() == 0


def test_common_seeds_cost_no_pairs():
    """A text that repeats a phrase which thousands of items begin with; and the same rows as without the early test."""
    import time

    from scarpline.llm import tiling

    draw = np.random.default_rng(1)
    phrase = "at the end of the"
    items = tiling.Items([(i, (phrase + " " + " ".join(f"w{x}" for x in draw.integers(0, 10**6, 15))).encode()) for i in range(5000)] + [(5000, f"{phrase} {phrase} q r s".encode())])
    text = " ".join([phrase] * 600).encode()
    start = time.perf_counter()
    found = list(items.matches(text, 0.5))
    assert time.perf_counter() - start < 1.5
    assert [(i, covered) for i, covered, _ in found if covered >= 0.5 * len(items.words[i])] == [(5000, 10)]


def test_early_test_changes_nothing(monkeypatch):
    from scarpline.llm import tiling

    draw = np.random.default_rng(2)
    items = tiling.Items([(i, " ".join(f"v{x}" for x in draw.integers(0, 4, int(draw.integers(1, 30)))).encode()) for i in range(60)])
    for _ in range(40):
        text = " ".join(f"v{x}" for x in draw.integers(0, 5, int(draw.integers(0, 200)))).encode()
        out = []
        for many in (0, 10**9):
            monkeypatch.setattr(tiling, "MANY_PAIRS", many)
            out.append(sorted(m for m in items.matches(text, 0.6) if m[1] >= 0.6 * len(items.words[m[0]])))
        assert out[0] == out[1]


# Syncmer fingerprints of whole texts


def plain_anchors(text):
    """(place, anchor) by the definition: the smallest inner pair of words lies at an edge of the four."""
    import struct

    import xxhash

    pair = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), signed(xxhash.xxh64_intdigest(struct.pack("<q", a), 42)) & (2**64 - 1)))

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[ \t-\r]+", text) if w]
    inner = [pair(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(inner) - 2):
        three = inner[i : i + 3]
        if min(three[0], three[2]) <= three[1]:
            out.append((i + 1, pair(three[0], three[2]) & 0xFFFFFFFF))
    return out


def test_all_anchors_and_exact_likeness(spark):
    from scarpline.llm import syncmers

    draw = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 3000, n))
    rows = [(5, word(20_000)), (4, word(300)), (3, "one two three"), (2, None), (1, word(90) + "\t é\n" + word(30)), (0, word(90))]
    rows[1] = (4, rows[0][1][: len(rows[0][1]) // 2])
    out = {r["doc_id"]: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), rows_a_range=2).collect()}
    sets = {}
    for d, text in rows:
        found = {a for _, a in plain_anchors(text or "")}
        ours = [int(out[d]["fingerprint"][i : i + 8], 16) for i in range(0, len(out[d]["fingerprint"]), 8)]
        assert ours == sorted(found) if found else len(ours) == 1
        sets[d] = set(ours)
    for d, nxt in zip((5, 4, 3, 2, 1, 0), (4, 3, 2, 1, 0, 5)):
        assert out[d]["near_next"] == pytest.approx(len(sets[d] & sets[nxt]) / len(sets[d] | sets[nxt]))
    assert 0.4 < out[5]["near_next"] < 0.6 and len(sets[5]) > 9000
    df = spark.createDataFrame([(rows[0][1],)], "text string")
    placed = df.select(syncmers.placed_anchors(F.col("text")).alias("p")).first()["p"]
    assert [(p["place"], p["anchor"]) for p in placed] == plain_anchors(rows[0][1])


def test_trees_of_more_states_keep_every_context(spark, monkeypatch):
    from itertools import product

    tokens = ["".join(w).encode() for w in product(["ba", "tion", "kel", "mo", "zu"], repeat=4)] + ["é".encode(), b"new"]
    words = spark.createDataFrame([(t, i % 3, 1 + i % 3) for i, t in enumerate(tokens)], "token binary, c bigint, n bigint")
    of_class = suffix_tree_lm.class_totals(words)
    got = []
    for states in (40_000, 3):
        monkeypatch.setattr(suffix_tree_lm, "STATES", states)
        tree = suffix_tree_lm.grow(suffix_tree_lm.count_grams(words.filter("c > 0")))
        got.append({bytes(r["token"]): r["s"] for r in suffix_tree_lm.spelled(words, tree, [], of_class).collect()})
        if states == 40_000:
            assert sum(len(c[0]) for c in tree.contexts[1:]) > 3
    assert got[0].keys() == got[1].keys() == set(tokens)
    assert all(abs(got[0][t] - got[1][t]) < 1e-9 for t in tokens)
