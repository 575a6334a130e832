"""The prefix trie against brute force: whole table, odd rows, long and hot conversations; and walks over ranges."""

import hashlib
import os
import random
from collections import defaultdict
from itertools import groupby
from zlib import crc32

import duckdb
import pandas as pd
import pytest

from stockwright.llm import ranges, trie
from stockwright.llm.oracles import PREFIX_TRIE

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string, place int, node string, depth string, n long, part int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    key = lambda y: hashlib.sha256(f"{len(y[2].encode())}:{y[2]}:{y[3]}".encode()).hexdigest()
    own = {c: [y[2:] for y in sorted(v, key=lambda y: (y[0], y[1], key(y)))] for c, v in own.items()}
    h = {c: crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below, kids = defaultdict(list), defaultdict(int)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
        if path:
            kids[path[:-1]] += 1
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p)
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), kids[path], sum(not kids[p] for p in below[path]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=repr)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "n", "d", 2, 3) for r in rows], SCHEMA).repartition(parts)


def shared(df):
    return trie.prefix_trie(*trie.with_shared_heads(trie.numbered(df)))


def test_whole_table(spark):
    d = pd.read_parquet(f"{DIR}/conversations.parquet")
    rows = list(d[["conv_id", "turn", "role", "text"]].astype(object).itertuples(index=False, name=None))
    df = trie.op11_prefix_trie(spark, DIR)
    assert got(df) == nodes(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    theirs = con.execute(PREFIX_TRIE).fetchdf()
    assert sorted(theirs.columns) == sorted(df.columns)
    assert sorted(map(str, theirs[["conv_id", "depth", "place", "subtree_end"]].values.tolist())) == sorted(map(str, map(list, df.select("conv_id", "depth", "place", "subtree_end").collect())))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 2, "é", "ü\U0001f600"), (7, 2, "a", "tie"), (400, 5, "", "x" * 200_000), (401, 5, "", "x" * 200_000)]
    # ids whose few turns are all replaced: by those of their block's first, or by none
    rows += [(c, t, "user", f"t{t}") for c in range(1000, 1012) for t in range(c % 4 + 1)] + [(c, t, "user", f"t{t}") for c in range(2001, 2040) for t in range(2)]
    convs = rebuilt(rows)
    assert any(not v for v in convs.values())
    assert got(shared(made(spark, rows))) == nodes(convs)
    assert got(shared(made(spark, rows).limit(0))) == []
    assert got(shared(made(spark, [(2003, 0, "a", "b")]))) == nodes(rebuilt([(2003, 0, "a", "b")]))
    assert {len(v) for v in rebuilt([(2003, 0, "a", "b")]).values()} == {0}


def test_long_and_hot_conversations(spark):
    """Copies, prefixes of one another, one conversation with a third of all rows, and one first turn that nearly all share."""
    r = random.Random(5)
    long = [("user", str(r.randrange(3))) for _ in range(1100)]
    convs = {0: long, 1: long, 2: long[:33], 3: long[:32], 4: long[:31] + [("a", "z")], 5: long[:64], 6: long[:1024] + [("b", "y")] * 40}
    convs |= {c: [("system", "same")] + [("user", r.choice("ab")) for _ in range(r.randrange(4))] for c in range(10, 160)}
    rows = [(c, t, *x) for c, v in convs.items() for t, x in enumerate(v)]
    r.shuffle(rows)
    turns = trie.numbered(made(spark, rows, 8))
    sizes = turns.groupBy("conv_id").count().withColumnRenamed("count", "turns")
    plain = turns.withColumn("depth", turns.place + 1).join(sizes, "conv_id").selectExpr("conv_id", "depth", "digest", "chars", "depth = turns as last")
    df = trie.prefix_trie(plain, sizes)
    assert got(df) == nodes(convs)
    spans = sorted((x.place, x.subtree_end, x.depth) for x in df.collect())
    assert [s[0] for s in spans] == list(range(len(spans))) and spans[0][1] == len(spans) - 1
    for k, (_, end, depth) in enumerate(spans):  # an interval holds just what is deeper
        assert all(s[2] > depth for s in spans[k + 1 : end + 1]) and (end + 1 == len(spans) or spans[end + 1][2] <= depth)


@pytest.mark.parametrize("parts", (1, 3, 8))
def test_walks_over_ranges(spark, parts):
    r = random.Random(parts)
    rows = [(7 if r.random() < 0.6 else r.randrange(12), k, r.choice((b"", b"a", b"ab", b"b", b"b" * 40)) if r.random() < 0.5 else b"hot", r.randrange(9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g long, k long, b binary, v long").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        want = [(g, k, i) for g, some in groupby(sorted((x[0], x[1]) for x in rows), lambda x: x[0]) for i, (_, k) in enumerate(some)]
        assert sorted(tuple(x) for x in ranges.places(df, "g", ["k"], ["k"]).collect()) == want
        rank = {b: i for i, b in enumerate(sorted({x[2] for x in rows}))}
        assert {(x.k, x["rank"]) for x in ranges.dense_ranks(df, "b", ["k"], ["k"]).collect()} == {(x[1], rank[x[2]]) for x in rows}
        total, want = 0, {}
        for x in sorted(rows, key=lambda x: x[1]):
            total += x[3]
            want[x[1]] = total
        assert {x.k: x.upto_v for x in ranges.running_sums(df, ["k"], ["v"]).collect()} == want
        info = spark.createDataFrame([(g, g * g) for g in range(0, 12, 2)] + [(7, 49)], "g long, sq long")
        assert sorted((x.g, x.k, x.sq) for x in ranges.matched(df, info, ["g"]).collect()) == sorted((g, k, g * g) for g, k, _, _ in rows if g % 2 == 0 or g == 7)
        packs = ranges.packed(df, ["g"], "k", 16).collect()
        assert all(len(x["items"].split(",")) <= 16 for x in packs)
        joined = defaultdict(list)
        for x in sorted(packs):
            joined[x.g] += map(int, x["items"].split(","))
        assert dict(joined) == {g: sorted(x[1] for x in rows if x[0] == g) for g in {x[0] for x in rows}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
