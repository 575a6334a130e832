"""Language identification: n-gram counts against brute force, the learner, held-out accuracy and calibration, odd rows."""

import math
import os
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from stockwright.llm import languages as L

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, held_out boolean, lang_pred string, _text string, draw long, hash long"
REST = (True, "xx", "t", 1, 2)


def spelled(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return " " + letters.lstrip() if letters.strip() == "" else " " + " ".join(letters.split()) + " "


@pytest.mark.parametrize("text", ["", "a", "Ab  c", "ÉTÉ, 12 été!", "\U00010400\U00010428 x", "x" * 50, " 1 2 "])
def test_counts_are_those_of_all_ngrams(text):
    s = " " if not spelled(text).strip() else spelled(text)
    grams = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    f, n = L.counted(text, 1 << 30)
    assert sorted(n.tolist()) == sorted(grams.values()) and len(set(f.tolist())) == len(grams)


def test_texts_of_a_step_dont_mix():
    texts = ["ab", "", "c d", "ééé ab"]
    points, starts = L._spelled(texts)
    for i, some in enumerate(L._by_text(texts, 1 << 30)):
        f, n = L.counted(texts[i], 1 << 30)
        assert Counter(some.tolist()) == dict(zip(f.tolist(), n.tolist(), strict=True))


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(random.Random(1).choice(("the", "of", "été", "x1y")) for _ in range(4000))
    f, n = L.counted(text)
    model = L.LanguageModel(("a", "b"), np.random.default_rng(1).normal(size=(L.FEATURES, 2)).astype(np.float32), np.zeros(2), 5.0)
    want = model.predict([text, "été", text])
    monkeypatch.setattr(L, "STEP", 700)
    g, m = L.counted(text)
    assert abs(int(n.sum()) - int(m.sum())) < 60 and set(g.tolist()) >= set(f.tolist()) - {0} or len(set(f.tolist()) - set(g.tolist())) <= 2
    for (a, p), (b, q) in zip(want, model.predict([text, "été", text]), strict=True):
        assert a == b and abs(p - q) < 0.01


def test_leader_learns_and_stays_sparse():
    r = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        y = int(r.integers(3))
        noise = r.choice(np.arange(3, 200), 6, replace=False)
        rows.append((np.append(noise, y).astype(np.int32), np.append(np.full(6, 0.3), 1.0), y))
    w = L.leader_weights(rows, 200, 3, l1=0.5)
    assert np.mean([int((x @ w[f] + w[-1]).argmax()) == y for f, x, y in rows]) > 0.98
    assert (w[:3].argmax(axis=1) == np.arange(3)).all() and (w[3:-1] == 0).mean() > (L.leader_weights(rows, 200, 3, l1=0.0)[3:-1] == 0).mean()
    assert np.abs(L.leader_weights(rows, 200, 3, l1=0.5, l2=100.0)).sum() < np.abs(w).sum()


def test_temperature_is_that_of_a_scan():
    r = np.random.default_rng(3)
    y = r.integers(4, size=500)
    s = r.normal(size=(500, 4)) * 3
    s[np.arange(500), y] += 2
    loss = lambda t: np.mean(np.log(np.exp(s / t).sum(axis=1)) - s[np.arange(500), y] / t)
    assert math.isclose(L.fitted_temperature(s, y), min(np.arange(0.1, 20, 0.01), key=loss), rel_tol=0.02)
    assert L.fitted_temperature(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


@pytest.fixture(scope="module")
def predicted(spark):
    return L.op12_language_id(spark, DIR).toPandas()


def test_held_out_accuracy(predicted):
    d = pd.read_parquet(f"{DIR}/documents.parquet").set_index("doc_id")
    assert sorted(predicted.doc_id) == sorted(d.index) and predicted.score.between(0, 1).all()
    assert (predicted.held_out == predicted.doc_id.map(lambda i: crc32(str(i).encode()) % 4 == 2)).all()
    real = predicted.set_index("doc_id").join(d[["lang", "text"]])
    letters = real.text.fillna("").map(lambda t: any(map(str.isalpha, t)))
    assert (real.lang_pred[~letters] == "und").all() and (real.score[~letters] == 0).all()
    some = real[letters & real.lang.notna() & real.held_out]
    assert len(some) > 20 and (some.lang_pred == some.lang).mean() >= 0.98


def test_scores_of_short_texts_are_calibrated(spark):
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    out = d.doc_id.map(lambda i: crc32(str(i).encode()) % 4 == 2)
    model = L.train(spark.read.parquet(f"{DIR}/documents.parquet").where(~L.held_out()))
    r = random.Random(4)
    pieces = [(" ".join(w[k : k + 2]), lang) for t, lang in zip(d.text[out], d.lang[out], strict=True) if t and lang for w in [t.split()] for k in r.sample(range(len(w)), min(8, len(w)))]
    pieces = [p for p in pieces if any(map(str.isalpha, p[0]))]
    got = model.predict([p[0] for p in pieces])
    right = np.array([g[0] == p[1] for g, p in zip(got, pieces, strict=True)])
    assert right.mean() > 0.85 and abs(np.mean([g[1] for g in got]) - right.mean()) < 0.1
    assert (model.weights == 0).all(axis=1).mean() > 0.5


def test_label_source_and_id_dont_matter(spark, predicted):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = L.train(docs.where(~L.held_out()))
    blind = L.predict(docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang", "null as source"), model).toPandas()
    a, b = predicted.sort_values("doc_id"), blind.sort_values("doc_id", ascending=False)
    assert a.lang_pred.tolist() == b.lang_pred.tolist() and np.allclose(a.score, b.score)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 \n!", "de"), (None, "the house of the man", "en"), (4, "the house of the man", "en"), (4, "the house of the man", "en"), (5, "das Haus des Mannes und der Frau", "de"), (6, "nobody knows", None)]
    rows += [(7, "the man and the house " * 30_000, "en"), (8, "der Mann und das Haus " * 30_000, "de")] + [(9, "the cat of the house", "en")] * 40 + [(9, x, y) for k in range(20) for x, y in ((f"the {"abcdefghijklmnopqrstu"[k]} of a man and the house", "en"), (f"der {"abcdefghijklmnopqrstu"[k]} eines Mannes und das Haus", "de"))]
    docs = spark.createDataFrame([(*x, *REST) for x in rows], SCHEMA).repartition(3)
    model = L.train(docs, sample=1000)
    assert model.languages == ("de", "en")
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id and r.doc_id < 9 and r.doc_id != 6} == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (7, "en"), (8, "de")}
    assert L.predict(docs.limit(0), model).collect() == []
    none = L.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, none).collect()} == {("und", 0.0)}
    one = L.train(docs.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in L.predict(docs.where("doc_id in (4, 5)"), one).collect()} == {("de", 1.0)}


def test_copies_dont_fill_the_sample(spark):
    docs = spark.createDataFrame([("the same text again", "en")] * 3000 + [(f"text number {'abcdefghij'[k % 10]} {'klmnop'[k % 6]}", "en") for k in range(60)] + [("der andere Text", "de")] * 500, "text string, lang string")
    _, rows = L._sampled(docs, 100_000, L.FEATURES)
    assert len(rows) <= 2 * 62
    assert L.document_frequencies(docs)[L.counted("the")[0]].min() >= 3000
