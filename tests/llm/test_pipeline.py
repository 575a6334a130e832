"""The pipeline on the smallest table: which documents each stage keeps, and what becomes of their texts."""

import os

import corpus_pipeline as cp
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from stockwright.llm import secrets
from tests.llm import brute

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_order(spark, stages):
    want = spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert [d.columns for d in stages[:-1]] == [want] * 4
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]


def test_copies_leave_one(stages):
    before, after = stages[0].toPandas(), stages[1].toPandas()
    assert set(after.doc_id) <= set(before.doc_id)
    assert set(after.text) == set(after.text.drop_duplicates()) and len(after) == after.text.nunique()
    first = before.groupby("text").doc_id.min()
    assert set(after.doc_id) <= set(first)


def test_no_benchmark_windows_stay_in_place(stages):
    items = pd.read_parquet(f"{DIR}/benchmark.parquet")
    items = list(zip(items.item_id.tolist(), items.text.tolist(), strict=True))
    before = {d: h for d, _, h, *_ in brute.contamination([tuple(r) for r in stages[1].select("doc_id", "text").collect()], items)}
    after = stages[2].select("doc_id", "text").toPandas()
    clean = {d for d, h in before.items() if not h}
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    assert clean <= set(after.doc_id)
    assert all(t == texts[d] for d, t in zip(after.doc_id, after.text, strict=True) if d in clean)
    assert all(len(t) < len(texts[d]) for d, t in zip(after.doc_id, after.text, strict=True) if d not in clean)


def test_no_secret_stays(stages):
    before, after = stages[2].toPandas(), stages[3].toPandas()
    assert set(before.doc_id) == set(after.doc_id)
    kept = dict(zip(after.doc_id, after.text, strict=True))
    for d, t in zip(before.doc_id, before.text, strict=True):
        spans = secrets.spans_of(t or "")
        assert (kept[d] == t) == (not spans)
        assert all(t[a:b] not in kept[d] for a, k, b in spans if k in (1, 2))


def test_ids_are_those_of_the_library(stages):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert list(r.ids) == p.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == brute.sha(p.decode(list(r.ids)).encode())


def test_run_gives_the_same_rows(spark, stages):
    assert {(r.doc_id, r.decoded_sha256) for r in cp.run(spark, DIR).collect()} == {(r.doc_id, r.decoded_sha256) for r in stages[4].collect()}


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    import random

    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."
    a, b, c, item = prose(80), prose(90), prose(70), prose(14)
    near = a.split(" ")
    near[40] = "other"
    long = prose(30_000)
    rows = [
        (1, a), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t"), (6, "few words only"), (7, b), (7, b), (7, c), (None, b), (None, b), (8, prose(60) + " " + item + " " + prose(60)),
        (9, item + " " + item + " " + item + " " + item), (10, prose(70) + " token = Zk8vQ2mX7pLw3"), (11, long), (12, long),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, s long, key string, id string, t long, pick int, k string"
    docs = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t), "r", 1, "k", "i", 2, 3, "x") for i, t in rows], kind)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q1", item), (None, a), ("q2", None), ("q3", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x.doc_id or 0, x.n_tokens > 0) for x in cp.run(spark, str(tmp_path)).collect())
    assert got == [(0, True), (0, True), (1, True), (7, True), (7, True), (8, True), (10, True), (11, True)]
    stage, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, work in cp.STAGES[:4]:
        stage = work(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name
    kept = {x.doc_id: x for x in stage.where("doc_id in (8, 10)").collect()}
    assert item not in kept[8].text and kept[8].n_chars == len(kept[8].text) and "Zk8vQ2mX7pLw3" not in kept[10].text and kept[10].source == "web"
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).collect() == []
