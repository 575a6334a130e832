"""Ropes against plain strings, and fill-in-middle against brute force and its own inverse."""

import hashlib
import os
import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockwright.llm import ropes

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = st.text(st.sampled_from("ab é\U0001f600\t\n\x0b  "), max_size=60)
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def height(r):
    """The height of a rope whose nodes are balanced and whose counts are those of their texts."""
    if r is None:
        return -1
    whole = ropes.text_of(r)
    assert (r.units, r.points) == (len(re.findall(UNITS, whole)), len(whole))
    if r.left is None:
        return 0
    a, b = height(r.left), height(r.right)
    assert abs(a - b) <= 1 and r.height == 1 + max(a, b)
    return r.height


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 7))
def test_leaves_hold_the_text_and_its_counts(text, size):
    r = ropes.build(text, size)
    assert ropes.text_of(r) == text
    height(r)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 7), st.integers(0, 40), st.integers(0, 40))
def test_cuts_are_those_of_the_list_of_units(text, size, i, k):
    units, r = re.findall(UNITS, text), ropes.build(text, size)
    i, k = sorted((i % (len(units) + 1), k % (len(units) + 1)))
    head, tail = ropes.split(r, k)
    a, b = ropes.split(head, i)
    assert [ropes.text_of(x) for x in (a, b, tail)] == ["".join(units[:i]), "".join(units[i:k]), "".join(units[k:])]
    for x in (a, b, tail):
        height(x)
    p, q = ropes.split(r, i, "points")
    assert (ropes.text_of(p), ropes.text_of(q)) == (text[:i], text[i:])


def test_joins_of_unequal_ropes_stay_balanced():
    rnd = random.Random(3)
    for _ in range(60):
        parts = ["x " * rnd.choice((0, 1, 3, 50, 700)) + "y" for _ in range(rnd.randrange(1, 7))]
        r = None
        for p in parts:
            r = ropes.concat(r, ropes.build(p, 4)) if rnd.random() < 0.5 else ropes.concat(ropes.build(p, 4), r)
        assert ropes.text_of(r).count("y") == len(parts)
        assert balanced(r) <= 2 * len(ropes.text_of(r)).bit_length()


def balanced(r):
    if r is None or r.left is None:
        return 0
    a, b = balanced(r.left), balanced(r.right)
    assert abs(a - b) <= 1
    return 1 + max(a, b)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 30), st.integers(0, 30), st.sampled_from(("psm", "spm")))
def test_outputs_are_rebuilt(text, i, k, form):
    r = ropes.build("<" + text + "<S", 3)
    i, k = sorted((min(i, r.units), min(k, r.units)))
    out, before, inside = ropes.rearranged(r, i, k, form)
    assert ropes.restored(ropes.text_of(out), form) == "<" + text + "<S" and before + inside <= r.points


def brute(doc_id, text):
    text = text or ""
    units, x = re.findall(UNITS, text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(y) for y in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or any(z in text for z in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(units), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text))


def test_whole_table(spark):
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    got = sorted(tuple(r) for r in ropes.op13_fill_in_middle(spark, DIR).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect())
    assert got == sorted(brute(i, t) for i, t in zip(d.doc_id.tolist(), d.text.tolist(), strict=True))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


LONG = " ".join(f"w{i % 3001}é" for i in range(60_000)) + " \n"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "one", "a <P> b", "<S>", "<M> c", LONG, LONG, " x", "y  z ", "<", "<<S"]
    rows = [(i, t) for i in range(1, 30) for t in texts] + [(None, t) for t in texts]
    return spark.createDataFrame([(i, t, "plain", 7, "o", 1, "r") for i, t in rows], "doc_id long, text string, form string, n int, output string, h1 long, restored string").repartition(4)


def test_odd_rows(spark, docs):
    made = ropes.fill_in_middle(docs)
    got = made.join(spark.createDataFrame([(1, "x")], "doc_id long, x string"), "doc_id", "left").drop("x")
    back = ropes.restore(got).collect()
    want = [brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((tuple(r)[:5] + (sha(r.output), sha(r.restored)) for r in back), key=repr) == sorted(want, key=repr)
    assert ropes.fill_in_middle(docs.limit(0)).collect() == [] == ropes.restore(made.limit(0)).collect()
    assert ropes.restore(made.select("form", made.output.substr(0, 0).cast("string").alias("output")).where("false")).columns == ["form", "output", "restored"]


def test_rates_and_seed(docs):
    assert {r.form for r in ropes.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in ropes.fill_in_middle(docs, rate=100, spm_rate=0).where("n > 1").collect()} <= {"plain", "psm"}
    a, b = ({tuple(r) for r in ropes.fill_in_middle(docs, rate=100, seed=s).select("doc_id", "n", "prefix_chars").where("n > 1000").collect()} for s in (1, 2))
    assert a != b


def test_output_without_sentinels_fails(spark):
    with pytest.raises(Exception, match="substring not found"):
        ropes.restore(spark.createDataFrame([("psm", "no marks")], "form string, output string")).collect()
    assert ropes.restore(spark.createDataFrame([("psm", None)], "form string, output string")).first().restored is None
