"""Indexed substring search against a scan."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockwright.operators import search as G


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, G.BLOCK - 1), max_size=200), st.booleans())
def test_places_come_back(places, many):
    p = np.array(sorted(places | (set(range(0, 60_000, 7)) if many else set())), np.int64)
    code = G.coded(p)
    assert G.decoded(code).tolist() == p.tolist() and len(code) <= G.BLOCK // 8


def test_grams_of_short_and_odd_texts():
    assert len(G.grams_of("ab")) == 0 == len(G.grams_of("")) and len(G.grams_of("aaaa")) == 1 and len(G.grams_of("\U0001f600é\x00b")) == 2


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abÉ_%ß\U0001f600 ") for _ in range(r.randrange(0, 14)))
    some = [(r.randrange(200_000), word(), word() if r.random() < 0.5 else None) for _ in range(3000)]
    some += [(i, "common text", None) for i in range(0, 70_000, 7)]  # a bitmap in one block, a list in another
    some += [(None, "abcommon", "x"), (5, None, None), (5, "", ""), (6, "twice", "twice"), (6, "twice", None)]
    return spark.createDataFrame(some, "id long, name string, note string").cache()


def test_search_equals_the_scan(spark, rows, tmp_path):
    terms = ["common", "É_%", "ab", "", " Mmon ", "b ß", "\U0001f600", "_%a", "no such thing", "twice", "aaa", "x"]
    index = G.build_index(rows, "id", ["name", "note"], str(tmp_path / "index"))
    got = sorted((t.term, t.id if t.id is not None else -1) for t in G.search(rows, index, "id", ["name", "note"], terms).collect())
    want = []
    for t in {t.strip().lower() for t in terms}:
        want += [(t, x.id if x.id is not None else -1) for x in rows.collect() if any(v is not None and t in v.lower() for v in (x.name, x.note)) or not t]
    assert got == sorted(want)


def test_few_files_are_read(spark, rows, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        index = G.build_index(rows, "id", ["name", "note"], str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    g = int(G.grams_of("common")[0])
    assert index.select(F.input_file_name().alias("f")).distinct().count() > 8
    one = index.where(F.col("gram") == g)
    assert one.select(F.input_file_name().alias("f")).distinct().count() == 1  # a gram's blocks lie together
    assert f"EqualTo(gram,{g})" in one._jdf.queryExecution().executedPlan().toString()
    sizes = [len(x.places) for x in one.orderBy("block").collect()]
    assert sizes[0] == G.BLOCK // 8 and sizes[1] < G.BLOCK // 8 and len(sizes) == 2


def test_empty_tables(spark, rows, tmp_path):
    none = rows.limit(0)
    index = G.build_index(none, "id", ["name"], str(tmp_path / "index"))
    assert G.search(none, index, "id", ["name"], ["common", "a"]).collect() == []


def test_texts_are_read_once_for_an_index(spark, rows, tmp_path):
    """Ranges need a look at the rows first, which shall not gather all grams twice."""
    seen = tmp_path / "seen"
    texts = rows.where("id is not null").select("id", "name")

    def counted(batches):
        for b in batches:
            with seen.open("a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    G.build_index(texts.mapInArrow(counted, texts.schema), "id", ["name"], str(tmp_path / "index"))
    assert sum(map(int, seen.read_text().split())) == texts.count()
