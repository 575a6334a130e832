"""The prefix trie of conversations, in preorder.

A node is a distinct sequence of first turns. Whole conversations are ranked in lexicographic order of their turns: runs of up to
32 turns are ranked as they stand, then runs of 32 such ranks, until one rank stands for a conversation, which takes a number of
rounds logarithmic in the longest one. A node's members are then a range of ranks; nodes in the order of their least rank and depth
are in preorder, and a node's subtree ends with the last node of its greatest rank. What a subtree holds is the difference of two
running sums. Turns are told by the first 128 bits of the SHA-256 of role and text, nodes by a polynomial of their turns
modulo 2^127 - 1, of which what a range adds to a conversation that began earlier can be worked out from one row a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import table, written
from stockwright.llm.ranges import dense_ranks, flag, matched, packed, places, running_sums, walked, with_offsets

RUN = 32
#: Modulus and base of the polynomials.
MODULUS, BASE = 2**127 - 1, 0x2B7E151628AED2A6ABF7158809CF4F3D
#: Conversations of a block share their heads, of fewer than HEADS turns.
BLOCK, HEADS = 100, 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, chars): the turns of each conversation in order, from 0.

    Null turns come first; equal ones are ordered by their digests, and all count. Null roles and texts are empty. Rows without a
    conversation are no turns of any. Ids must be numbers.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)), 1, 16)
    turns = written(rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")))
    return places(turns, "conv_id", ["turn", "digest"], ["digest", "chars"])


def with_shared_heads(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, chars, last) and members (conv_id, turns) after each conversation's first h turns were replaced by
    those of its block's first conversation, h the CRC of its id modulo ``heads``; fewer if that has fewer, none if there is none.
    """
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    convs = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")))
    first = turns.where((F.col("place") < heads - 1) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    depth = F.col("depth") == F.col("turns")
    shared = convs.where("head > 0").join(first, "base").where("place < head").select("conv_id", "digest", "chars", "turns", (F.col("place") + 1).alias("depth"))
    own = matched(turns, convs, ["conv_id"]).where("place >= h").select("conv_id", "digest", "chars", "turns", (F.col("head") + F.col("place") - F.col("h") + 1).alias("depth"))
    both = shared.unionByName(own).select("conv_id", "depth", "digest", "chars", depth.alias("last"))
    return both, convs.select("conv_id", "turns")


def _chained(turns: DataFrame) -> DataFrame:
    """Each turn with ``node`` and ``parent``, and the run of digests that ends with it, if one does."""

    def walk() -> Callable[[dict], dict]:
        conv, state, begun, run = None, 0, 0, []

        def step(c: dict) -> dict:
            nonlocal conv, state, begun, run
            node, parent, count, runs = [], [], [], []
            for k, depth, digest, last in zip(*[c[x].to_pylist() for x in ("conv_id", "depth", "digest", "last")], strict=True):
                if k != conv:
                    conv, state, begun, run = k, 0, depth, []
                parent.append(state.to_bytes(16))
                state = (state * BASE + int.from_bytes(digest) + 1) % MODULUS
                node.append(state.to_bytes(16))
                count.append(depth - begun + 1)
                run.append(digest)
                runs.append(b"".join(run) if last or depth % RUN == 0 else None)
                if runs[-1] is not None:
                    run = []
            return {"node": pa.array(node, pa.binary()), "parent": pa.array(parent, pa.binary()), "count": pa.array(count, pa.int64()), "run": pa.array(runs, pa.binary())}

        return step

    # a run never crosses a border of ranges
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / RUN))
    rows = walked(rows, ["conv_id", "block"], ["conv_id", "depth"], walk, "node binary, parent binary, count long, run binary", ["conv_id", "depth", "chars", "last", "block"])
    ends = rows.groupBy("part").agg(F.min(F.struct("conv_id", "depth")).alias("first"), F.max(F.struct("conv_id", "depth", "count", "node")).alias("last")).orderBy("part").collect()
    offsets, now = {}, (None, 0)
    for r in ends:
        came = now[1] if r["first"]["depth"] > 1 else 0
        if came:
            offsets[r["part"]] = (r["first"]["conv_id"], came.to_bytes(16))
        state = int.from_bytes(r["last"]["node"])
        if r["last"]["conv_id"] == r["first"]["conv_id"]:
            state = (state + came * pow(BASE, r["last"]["count"], MODULUS)) % MODULUS
        now = (r["last"]["conv_id"], state)
    found = with_offsets(rows, offsets, "_first long, _came binary", "left")
    names = ["conv_id", "depth", "chars", "last", "block", "run"]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, parent = [], []
            for n, p, count, came in zip(*[batch.column(x).to_pylist() for x in ("node", "parent", "count", "_came")], strict=True):
                before = int.from_bytes(came) * pow(BASE, count - 1, MODULUS)
                parent.append(((int.from_bytes(p) + before) % MODULUS).to_bytes(16))
                node.append(((int.from_bytes(n) + before * BASE) % MODULUS).to_bytes(16))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(node, pa.binary()), pa.array(parent, pa.binary())], names=[*names, "node", "parent"])

    went = found.where("conv_id = _first").mapInArrow(moved, "conv_id long, depth long, chars long, last boolean, block long, run binary, node binary, parent binary")
    stayed = found.where("not conv_id <=> _first").select(*names, "node", "parent")
    return stayed.unionByName(went)


def _ranked(runs: DataFrame) -> DataFrame:
    """(conv_id, rank): the lexicographic rank of each conversation, equal ones alike. runs (conv_id, block, run, last)."""

    def walk() -> Callable[[dict], dict]:
        run: list = []

        def step(c: dict) -> dict:
            out = []
            for rank, block, last in zip(*[c[x].to_pylist() for x in ("rank", "block", "last")], strict=True):
                run.append(rank.to_bytes(8))
                out.append(b"".join(run) if last or block % RUN == RUN - 1 else None)
                if out[-1] is not None:
                    run.clear()
            return {"run": pa.array(out, pa.binary())}

        return step

    while True:
        ranks = dense_ranks(runs, "run", ["conv_id", "block"], ["conv_id", "block", "last"])
        if ranks.where("block > 0").isEmpty():
            return ranks.select("conv_id", "rank")
        rows = walked(ranks.withColumn("over", F.floor(F.col("block") / RUN)), ["conv_id", "over"], ["conv_id", "block"], walk, "run binary", ["conv_id", "over", "last"])
        runs = rows.where("run is not null").select("conv_id", F.col("over").alias("block"), "run", "last")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): the hash of the ids in order, from packs of them, one at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for k, items in zip(zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist(), strict=True), batch.column("items").to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256(items.encode())
                else:
                    digest.update(b"," + items.encode())
            yield made(out)
        yield made([(*now, digest.hexdigest())] if now is not None else [])

    def made(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "node", "ends_sha256"])

    packs = written(packed(ends, ["depth", "node"], "conv_id"))
    return packs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(work, "depth long, node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place, subtree_end).

    turns (conv_id, depth from 1, digest, chars, last) as of numbered or with_shared_heads, members (conv_id, turns) all
    conversations, even without turns. The root, at depth 0, has them all; without conversations there is no node. ``place`` is a
    node's number in preorder, the root's 0, ``subtree_end`` that of the last node below it or its own.
    """
    rows = written(_chained(turns))
    ranks = written(_ranked(rows.where("run is not null").select("conv_id", "block", "run", "last")))
    rows = matched(rows.select("conv_id", "depth", "chars", "last", "node", "parent"), ranks, ["conv_id"])
    nodes = rows.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.min("rank").alias("least"), F.max("rank").alias("greatest"),
    )
    nodes = written(nodes)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children"])
    nodes = nodes.withColumns({"one": F.lit(1).cast("long"), "leaves": flag(F.col("n_children") == 0), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = written(running_sums(nodes, ["least", "depth"], ["one", "leaves", "saved"]))
    # all nodes of a greatest rank lie on one path, whose end closes their subtrees
    ends = written(nodes.groupBy(F.col("least").alias("greatest")).agg(*[F.max(f"upto_{x}").alias(f"end_{x}") for x in ("one", "leaves", "saved")]))
    nodes = matched(nodes, ends, ["greatest"]).select(
        "depth", "node", "parent", "conv_id", "n_convs", "n_children", (F.col("end_leaves") - F.col("upto_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("end_saved") - F.col("upto_saved") + F.col("saved")).alias("saved_tokens"), F.col("upto_one").alias("place"), F.col("end_one").alias("subtree_end"),
    )
    nodes = written(nodes)
    all_ = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("depth") == 1).alias("n_children"), F.sum(flag(F.col("n_children") == 0)).alias("n_leaves"), F.sum(F.when(F.col("depth") == 1, F.col("saved_tokens"))).alias("saved_tokens"))
    root = all_.join(F.broadcast(below)).select(
        F.lit(0).cast("long").alias("depth"), F.lit("").cast("binary").alias("node"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.lit(0).cast("long").alias("place"), F.col("n").alias("subtree_end"),
    )
    first = members.agg(F.min("conv_id").alias("parent_conv_id"))
    keys = nodes.select(F.col("depth").alias("up"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = matched(nodes.where("depth > 1").withColumn("up", F.col("depth") - 1), keys, ["up", "parent"])
    out = root.unionByName(deep.select(root.columns)).unionByName(nodes.where("depth = 1").join(F.broadcast(first)).select(root.columns))
    ends = rows.where("last").select("depth", "node", "conv_id").unionByName(members.where("turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit("").cast("binary").alias("node"), "conv_id"))
    out = out.join(_ends(ends), ["depth", "node"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "place", "subtree_end")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(numbered(table(spark, sf_dir, "conversations"))))
