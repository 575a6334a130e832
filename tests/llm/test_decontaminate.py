"""A test set in one part and in several gives the same as brute force: long and short items, repeats, nulls."""

import random

import pytest

from stockwright.llm import decontaminate as D
from tests.llm import brute


def planted():
    r = random.Random(4)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(f"i{k}", line(r.choice((1, 3, 9, 10, 11, 40)))) for k in range(60)] + [("i0", "two words"), ("i0", "two words"), ("dup", None), ("same", "ax AY az bx by bz cx cy cz dx dy"), ("also", "ax ay, az bx by bz cx cy cz dx")]
    docs = []
    for k in range(80):
        t = line(r.randrange(0, 60))
        for _ in range(r.randrange(0, 3)):
            t += "\n" + (r.choice(items)[1] or "").upper() + ", " + line(r.randrange(0, 5))
        docs.append((k, t))
    return docs + [(100, None), (101, ""), (102, "?!"), (103, docs[3][1]), (104, "é\u00a0" + docs[3][1])], items


@pytest.mark.parametrize("most", [D.MOST_BROADCAST, 700, 1])
def test_parts(spark, monkeypatch, most):
    docs, items = planted()
    if most == 1:
        monkeypatch.setattr(D, "PIECE", 40)  # as on the driver: items are cut there by the task's own constant
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.scanned(d, i, most=most).collect())
    want = sorted((w[0], w[1], w[2]) for w in brute.contamination(docs, [(a, b or "") for a, b in items]))
    assert [g[:3] for g in got] == want
    one = sorted((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.scanned(d, i).collect())
    assert got == one


def test_parts_are_bounded(spark):
    pieces = spark.createDataFrame([(f"i{k}", bytes([97 + k % 26]) * 50) for k in range(400)], "item string, words binary")
    parts = D.parts_of(pieces, 2000)
    sizes = [[len(r.words) for r in p.collect()] for p in parts]
    assert sum(map(len, sizes)) == 400 and len(parts) > 5 and max(sum(s) for s in sizes) <= 2000 + 50 * 20


def test_a_long_item_is_cut_without_losing_a_window():
    words = [f"w{k}" for k in range(5000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([" ".join(words), "short one"])], names=["item", "text"])
    old, D.PIECE = D.PIECE, 1000
    try:
        rows = [(i, w.split()) for b in D._cut(iter([batch]), 10) for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    finally:
        D.PIECE = old
    seen = {tuple(w[k : k + 10]) for i, w in rows if i == "a" for k in range(len(w) - 9)}
    assert len(rows) > 20 and all(len(w) >= 10 for i, w in rows if i == "a") and rows[-1] == ("b", [b"short", b"one"])
    assert seen == {tuple(x.encode() for x in words[k : k + 10]) for k in range(4991)}
