"""Joint boosting against plain numpy training of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import boosting
from scarpline.sources import shared

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 3)).round(2)
    y = np.where(x[:, 0] + x[:, 1] > 0.5, 2, np.where(x[:, 2] > 0, 1, 0))
    rows = [(*map(float, r), int(c), int(i % 3)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    rows += [(None, 0.0, 0.0, 1, 0), (float("nan"), 1.0, 1.0, 2, 1), (0.0, 0.0, 0.0, None, 2)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, fold int").repartition(5).cache()


def plain(x, y, depth, rate, rounds, classes):
    """Trees grown one after the other with sums over all rows."""
    s, out = np.zeros((len(x), classes)), []
    for _ in range(rounds):
        p, grown = boosting.softmax(s), []
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            node, tree = np.zeros(len(x), dtype=int), []
            for level in range(depth):
                nxt = node * 2
                for n in range(2**level):
                    own, best = node == n, (1e-9, None)
                    for f in range(x.shape[1]):
                        for b in range(boosting.BINS):
                            left = own & (x[:, f] <= b)
                            right = own & ~left
                            if h[left].sum() >= 1 and h[right].sum() >= 1:
                                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - g[own].sum() ** 2 / (h[own].sum() + 1)
                                if gain > best[0] + 1e-9:
                                    best = (gain, (f, b))
                    if best[1]:
                        nxt = nxt + (own & (x[:, best[1][0]] > best[1][1]))
                    tree.append(best[1])
                node = nxt
            value = np.array([-rate * g[node == n].sum() / (h[node == n].sum() + 1) for n in range(2**depth)])
            s[:, k] += 0
            grown.append((tree, value, node))
        for k, (_, value, node) in enumerate(grown):
            s[:, k] += value[node]
        out.append([(t, v) for t, v, _ in grown])
    return boosting.softmax(s), out


@pytest.mark.parametrize("refresh,direct", [(10, 64), (2, 1)])
def test_trees_equal_plain_training(data, monkeypatch, refresh, direct):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "DIRECT", direct)
    settings = [boosting.Setting(2, 0.3), boosting.Setting(3, 0.1), boosting.Setting(2, 0.3, 1)]
    trained = boosting.train(data, FEATURES, F.col("y"), ("u", "v", "w"), settings, 3, F.col("fold"))
    rows = data.filter("y IS NOT NULL").toPandas()
    for s in settings:
        used = rows[rows["fold"] != s.without] if s.without is not None else rows
        x = boosting.to_bins([used[c].to_numpy() for c in FEATURES], trained.edges)
        shares, grown = plain(x, used["y"].to_numpy(), s.depth, s.rate, 3, 3)
        model = boosting.model_of(trained, s, FEATURES)
        assert np.allclose(model.probabilities([used[c].to_numpy() for c in FEATURES]), shares, atol=1e-5)
        for ours, theirs in zip(model.rounds, grown, strict=True):
            for tree, (splits, value) in zip(ours, theirs, strict=True):
                assert [None if c == 255 else (f, c) for f, c in zip(tree.feature, tree.cut, strict=True)] == splits
                assert np.allclose(tree.value, value, atol=1e-5)


def test_fewer_rounds_are_the_beginning(data, spark, tmp_path):
    setting = boosting.Setting(2, 0.2)
    more, few = (boosting.model_of(boosting.train(data, FEATURES, F.col("y"), ("u", "v", "w"), [setting], n), setting, FEATURES) for n in (4, 2))
    cut = more.first(2)
    columns = [data.toPandas()[c].to_numpy() for c in FEATURES]
    assert np.allclose(cut.probabilities(columns), few.probabilities(columns), atol=1e-9) and len(few.members) == 3
    more.save(str(tmp_path))
    again = boosting.SoftmaxModel.load(str(tmp_path))
    assert np.allclose(again.probabilities(columns), more.probabilities(columns)) and again.labels == more.labels
    scored = again.transform(data).select("class_probability", "predicted").collect()
    assert all(abs(sum(r["class_probability"]) - 1) < 1e-9 and r["predicted"] in "uvw" for r in scored) and len(scored) == 1503


def test_rows_are_stored_in_blocks(data, monkeypatch):
    stored = []

    def store(df, purpose):
        stored.append(shared.store(df, purpose))
        return stored[-1]

    monkeypatch.setattr(boosting, "shared", type("Spy", (), {"store": staticmethod(store)}))
    boosting.train(data, FEATURES, F.col("y"), ("u", "v", "w"), [boosting.Setting(2, 0.3)], 1)
    assert stored[0].count() <= data.rdd.getNumPartitions() + data.sparkSession.sparkContext.defaultParallelism


def test_scores_are_stored_once_and_small(data, monkeypatch, tmp_path):
    kept = []
    monkeypatch.setattr(boosting, "REFRESH", 1)
    monkeypatch.setattr(shared, "folder", lambda spark, purpose: kept.append(str(tmp_path / f"with space {len(kept)}")) or kept[-1])
    spark = data.sparkSession
    before = {k: spark.conf.get(k) for k in boosting.READING}
    settings = [boosting.Setting(2, 0.3), boosting.Setting(3, 0.1)]
    boosting.train(data, FEATURES, F.col("y"), ("u", "v", "w"), settings, 2)
    assert len(kept) == 3 and [p.name for p in tmp_path.iterdir()] == ["with space 2"]  # only the newest scores stay
    sizes = spark.read.parquet(kept[-1]).select(F.sum(F.octet_length("s")), F.sum(F.octet_length("y"))).first()
    assert sizes[0] == sizes[1] * len(settings) * 2  # two differences of three classes
    assert {k: spark.conf.get(k) for k in boosting.READING} == before


@pytest.mark.parametrize("depth,features", [(3, 5), (3, 8), (4, 3)])
def test_all_trees_at_once_equal_one_by_one(depth, features):
    draw = np.random.default_rng(6)
    x = draw.integers(0, boosting.BINS, (features, 5000)).astype(np.uint8)
    rounds = []
    for i in range(boosting.Walk.ROUNDS + 2):
        sizes = [1, 2, depth if i else 3]
        rounds.append([boosting.Tree(draw.integers(0, features, 2**d - 1), draw.choice([0, 3, 10, 20, 31, 255], 2**d - 1), draw.normal(size=2**d)) for d in sizes])
    ours, theirs = np.ones((3, 5000)), np.ones((3, 5000))
    boosting.Walk(rounds, features).add(ours, x, boosting.pair_bins(x))
    for grown in rounds:
        for k, t in enumerate(grown):
            theirs[k] += t.value[t.leaves(x.T)]
    assert (ours == theirs).all()


def test_leaves_equal_a_walk_of_each_row():
    draw = np.random.default_rng(5)
    x = draw.integers(0, boosting.BINS, (200, 4)).astype(np.uint8)
    tree = boosting.Tree(draw.integers(0, 4, 7), draw.choice([3, 10, 20, 255], 7), np.zeros(8))
    for depth in range(4):
        for row, place in zip(x, tree.leaves(x, depth), strict=True):
            at = 0
            for _ in range(depth):
                at = 2 * at + 1 + int(row[tree.feature[at]] > tree.cut[at])
            assert place == at - (2**depth - 1)


def test_nothing_to_split():
    feature, cut, one, two = boosting.best_splits(np.zeros((2, 3, boosting.BINS, 2)))
    assert cut.tolist() == [255, 255] and not one.any() and not two.any()
