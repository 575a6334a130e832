"""Near copies about the similarity of the pipeline, against brute force over all pairs."""

import random
import time

import numpy as np
import pytest

from stockwright.llm import common, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def planted():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(40)]
    docs = []
    for k in range(60):
        base = [word() for _ in range(r.randrange(60, 400))] + (line if k % 3 else [])
        docs.append(base)
        for _ in range(4):
            copy = list(base)
            for i in r.sample(range(len(copy)), max(1, round(len(copy) * r.uniform(0.005, 0.05)))):
                copy[i] = word()
            docs.append(copy)
    docs += [["one", "two"], ["One", "TWO"], ["two", "one"], [], ["a", "b", "c", "d"]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def kept(docs, similarity=0.8):
    """The least ids of the groups that all pairs of at least the similarity make."""
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if jaccard(a, b) >= similarity:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(i for i in up if top(i) == i)


def test_all_pairs_are_found_and_no_other(spark):
    docs = planted()
    near = [jaccard(a, b) for k, (_, a) in enumerate(docs) for _, b in docs[:k]]
    assert sum(0.8 <= x < 0.85 for x in near) > 20 and sum(0.7 <= x < 0.8 for x in near) > 20
    got = simhash.representatives(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == kept(docs)


def test_long_texts_have_the_shingles_of_their_slices(monkeypatch):
    texts = [b"one TWO three four five six " * 9 + b"end", b"a b", b"x" * 50 + b" y", b"", b" " * 60]
    whole = [h.tolist() for h in simhash.shingle_sets(texts, 5)]
    assert [len(h) for h in whole] == [7, 1, 1, 0, 0]
    monkeypatch.setattr(simhash, "SLICE", 16)
    monkeypatch.setattr(simhash, "steps", lambda t: ((k, k + 1) for k in range(len(t))))
    assert [h.tolist() for h in simhash.shingle_sets(texts, 5)] == whole


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    docs = [(1, words("a", 90)), (2, words("a", 90) + " end"), (2, words("b", 90)), (3, words("c", 90)), (3, words("d", 90)), (3, words("d", 90)), (3, words("d", 90).upper())]
    got = simhash.representatives(spark.createDataFrame(docs, SCHEMA).repartition(2)).collect()
    assert sorted((r.doc_id, r.text[0].lower()) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]


def test_fingerprints_find_pairs_and_the_completion_the_rest(spark, monkeypatch):
    """SimHash finds near copies by itself: links of fingerprints join texts that differ little; what they miss is completed."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(600)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:599], "x"])), (2, " ".join(f"v{r.randrange(10**6)}" for _ in range(600)))]
    prints = simhash.set_hashes(spark.createDataFrame(docs, SCHEMA), 5)
    of = {x.doc_id: (x.s, x.f0) for x in prints.collect()}
    hashes = {i: next(simhash.shingle_sets([t.encode()], 5)) for i, t in docs}
    for i, h in hashes.items():
        assert of[i][1] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    links = {frozenset(x) for x in simhash.print_links(prints, 4).collect()}
    assert links == {frozenset({of[0][0], of[1][0]})}
    real, seen = simhash.print_links, []
    monkeypatch.setattr(simhash, "print_links", lambda *a: seen.append(a) or real(*a))
    assert sorted(x.doc_id for x in simhash.representatives(spark.createDataFrame(docs, SCHEMA)).collect()) == [0, 2] and len(seen) == 1


def test_texts_move_only_for_pairs_that_sizes_and_parities_allow(spark, monkeypatch):
    """Long texts that share a passage are no near copies: that is told without their texts."""
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    passage, base = words(300), words(3000)
    docs = [passage + words(3000) for _ in range(4)] + [base[:400] + passage, base, [*base[:2990], "x"]]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    s = {simhash.set_hash(h): i for i, h in enumerate(simhash.shingle_sets([t.encode() for _, t in docs], 5))}
    real, seen = simhash.verified, []
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a: seen.extend({s[x.a], s[x.b]} for x in pairs.collect()) or real(pairs, *a))
    got = simhash.representatives(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert sorted(x.doc_id for x in got) == kept(docs) == [0, 1, 2, 3, 4, 5]
    assert seen == [{5, 6}]


def test_halves_of_wide_parities_make_narrow_ones():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    wide = simhash.parities(h, 4096)
    assert [simhash.laid(wide, n).tolist() for n in (8, 16, 64)] == [simhash.parities(h, 64 * n).tolist() for n in (8, 16, 64)]


@pytest.mark.parametrize("keep", [common.written, common.saved])
def test_what_a_job_has_shuffled_goes_when_it_ends(spark, keep):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {x for x in (files.apply(k).getName() for k in range(files.size())) if x.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(common.SHUFFLES_GO)
    df = keep(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").max("id"))
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and df.count() == 7 and spark.conf.get(common.SHUFFLES_GO) == setting


def test_rows_stay_the_same_where_the_map_of_gone_rows_fills_up(spark, monkeypatch):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    docs = [(1, words("a", 90)), (2, words("a", 90) + " end"), (3, words("b", 90)), (3, words("b", 90)), (None, words("a", 90)), (None, words("a", 90)), *[(i, words(f"x{i}y", 60)) for i in range(4, 90)]]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id as id", "1 as t", "2 as place", "3 as word", "4 as v", "5 as row")
    want = sorted([1, 3, -1, -1, *range(4, 90)])
    for bits in (1 << 25, 64):
        monkeypatch.setattr(simhash, "MARKS", bits)
        got = simhash.representatives(df)
        rows = got.collect()
        assert got.columns == df.columns and sorted(-1 if x.doc_id is None else x.doc_id for x in rows) == want and {(x.t, x.place, x.word, x.v, x.row) for x in rows} == {(1, 2, 3, 4, 5)}
