"""The pipeline, stage by stage, on a small fixture with planted cases."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from scarpline.llm import byte_bpe
from tests.llm.test_text_operators import edited, prose


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd = random.Random(1)
    texts = [" ".join(prose(100 + i, 3)) for i in range(60)]
    item = prose(7, 1)[0]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, edited(texts[i], rnd, 1)) for i in range(10)] + [(150, texts[20])]
    rows += [(200 + i, prose(300 + i, 1)[0] + " " + item) for i in range(5)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(prose(8, 40))]
    rows += [(400, prose(9, 1)[0] + " write to someone@mail.example.com now"), (401, None), (402, "")]
    path = tmp_path_factory.mktemp("pipeline")
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(lang="en", source="s")
    frame.assign(n_chars=frame.text.str.len().fillna(0).astype("int64")).to_parquet(path / "documents.parquet")
    labels = [(d, int(not 300 <= d < 400), 0) for d, _ in rows if d < 400]
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(path / "benchmark.parquet")
    return str(path), dict(rows)


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert not kept[0] & set(range(300, 340)) and set(range(60)) <= kept[0]
    assert kept[0] - kept[1] >= {*range(100, 110), 150} and set(range(60)) <= kept[1]
    assert kept[1] - kept[2] == set(range(200, 205))
    assert kept[2] == kept[3] == kept[4]
    out = {r.doc_id: r for r in docs.collect()}
    assert out[400].text.endswith("write to [EMAIL] now")
    path_of_ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(byte_bpe.build_model(byte_bpe.read_ranks(path_of_ranks)), public_tokenizers.PATTERN, np.arange(50256))
    for d, r in out.items():
        if d != 400:
            assert r.text == (rows[d] or "") and bytes(r.ids) == codec.encode(r.text) and r.n_tokens == len(r.ids) // 4


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    by_id = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in df.collect())
    assert by_id(corpus_pipeline.run(spark, path)) == by_id(docs)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
