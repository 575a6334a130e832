"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. By the pigeonhole principle two fingerprints within a radius agree in some segment up to
a few bits, so each fingerprint looks up small Hamming balls about its segments in tables of all fingerprints, and the
complete distance of every match is verified inside the join. Links become groups by distributed connected components.
Equal fingerprints are one row throughout, so that a hot group of exact copies costs no more than one document.

The pipeline's near-duplicates are found by the same fingerprints, of five-word shingles, and each pair is verified by the Jaccard
similarity of its texts. As no fingerprint is wide enough for all pairs of that similarity, an exact completion follows: what the
fingerprints left apart is compared where it shares one of its rarest shingles, which two similar sets can't avoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockwright.llm.common import WordRun, as_bytes, is_not_space, joined, let_go, mixed, saved, steps, table, written
from stockwright.llm.components import components

SEED = 42
#: What one lookup costs, counted in comparisons of two fingerprints; only weighs the number of segments, never the result.
LOOKUP = 60
SLICE = 1 << 20
#: So many of the most frequent shingles are known to all tasks, which put them last; only weighs the work, never the result.
FREQUENT = 1 << 19
#: Words of 64 parity bits that tell most dissimilar sets apart without their texts.
PARITIES = 8
#: Bits of the map that passes over texts that no pair names, and rows that nothing removes, before they are shuffled; where it fills up, all pass.
MARKS = 1 << 25


def word_slices(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in bounded lists; each list begins with the last ``overlap`` words of the one before."""
    at, n, last = 0, len(text), []
    while at < n:
        to = at + SLICE
        while to < n and text[to : to + 1] not in b" \t\n\x0b\x0c\r":
            to += 1
        words = last + text[at:to].split()
        yield words
        at, last = to, words[len(words) - overlap :] if overlap and len(words) >= overlap else (words if overlap else [])


def simhash(text: bytes, shingle: int, parts: int = 1) -> list[int]:
    """``parts`` signed 64-bit words: a bit is set if it is in over half the shingle hashes. Only A-Z are lower-cased."""
    ones = np.zeros((parts, 64), np.int64)
    total = 0
    digest = xxhash.xxh64_intdigest
    short: list[bytes] = []
    for words in word_slices(text.lower(), shingle - 1):
        short = words if len(words) < shingle else []
        hashes = [digest(b" ".join(x), SEED) for x in zip(*[words[k:] for k in range(shingle)], strict=False)]
        h = np.array(hashes, np.uint64)
        total += len(h)
        for p in range(parts):
            if len(h):
                ones[p] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = mixed(h + np.uint64(0x9E3779B97F4A7C15))
    if not total and short:
        h, total = np.array([digest(b" ".join(short), SEED)], np.uint64), 1
        for p in range(parts):
            ones[p] += np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64)
            h = mixed(h + np.uint64(0x9E3779B97F4A7C15))
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, parts: int = 1) -> DataFrame:
    """(doc_id, f0, ...): fingerprints of every document; null and blank texts have zero."""
    names = [f"f{p}" for p in range(parts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [simhash(t, shingle, parts) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[p] for r in rows], pa.int64()) for p in range(parts)]], names=["doc_id", *names])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names))


def segments(n: int, radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(offset, width, ball radius) of the segments that make the search for n fingerprints cheapest.

    With radius = m * q + a, one of the first a + 1 of m segments differs in q bits at most, or one of the rest in q - 1.
    """

    def cut(m: int) -> list[tuple[int, int, int]]:
        q, a = divmod(radius, m)
        ends = [bits * k // m for k in range(m + 1)]
        return [(x, y - x, q if k <= a else q - 1) for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if k <= a or q > 0]

    cost = lambda s: sum(sum(comb(w, k) for k in range(r + 1)) * (LOOKUP + n / 2**w) for _, w, r in s)
    return min((cut(m) for m in range(2, max(2, min(bits // 6, radius)) + 1)), key=cost)


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def links(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b): pairs of the ids ``d`` of distinct prints (d, f0, c) within the radius that aren't of one component ``c``.

    Of a segment's value all of whose prints are of one component nothing is compared, and of others never two prints of the
    component that most of them have: one that holds a dense group costs no more than its other prints.
    """
    cuts = segments(n, radius)
    key = lambda o, w: F.shiftrightunsigned("f0", o).bitwiseAND(F.lit((1 << w) - 1))
    at = ["seg", "key"]
    tables = prints.select("d", "f0", "c", F.inline(F.array(*[F.struct(F.lit(k).alias("seg"), key(o, w).alias("key")) for k, (o, w, _) in enumerate(cuts)])))
    most = tables.groupBy(*at, "c").count().groupBy(*at).agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count("*").alias("kinds"))
    balls = F.array(*[F.struct(F.lit(k).alias("seg"), key(o, w).alias("own"), F.lit(ball(w, r)).cast("array<bigint>").alias("masks")) for k, (o, w, r) in enumerate(cuts)])
    asked = prints.select("d", "f0", "c", F.inline(balls)).select("d", "f0", "c", "seg", "own", F.explode("masks").alias("mask"))
    asked = asked.select("d", "f0", "c", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key")).join(most, at).where("kinds > 1 or most <> c")
    # a print of the most common component meets the others only
    asked = asked.select("d", "f0", "c", *at, F.explode(F.when(F.col("c") == F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("common"))
    tables = tables.join(most, at).select("d", "f0", "c", *at, (F.col("c") == F.col("most")).alias("common"))
    t, q = tables.alias("t"), asked.alias("q")
    # a pair is within the radius from either side: the smaller fingerprint asks
    near = (F.col("q.d") < F.col("t.d")) & (F.col("q.c") != F.col("t.c")) & (F.bit_count(F.col("t.f0").bitwiseXOR(F.col("q.f0"))) <= radius)
    found = t.join(q, (F.col("t.seg") == F.col("q.seg")) & (F.col("t.key") == F.col("q.key")) & (F.col("t.common") == F.col("q.common")) & near)
    return found.select(F.col("q.d").alias("a"), F.col("t.d").alias("b")).distinct()


def stars(prints: DataFrame, near: Column) -> DataFrame:
    """(a, b): links of prints to three of each bucket, by quarters of f0, for which ``near`` holds.

    A dense group is joined so by a number of links that grows with its size; the search for all links can then pass over
    pairs that are joined already, and lists no group's pairs.
    """
    quarters = [F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned("f0", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("key")) for k in range(4)]
    tables = prints.select("*", F.inline(F.array(*quarters)))
    row = F.struct(*prints.columns)
    leads = tables.groupBy("seg", "key").agg(F.min_by(row, "d").alias("x"), F.max_by(row, "d").alias("y"), F.min_by(row, F.xxhash64("d")).alias("z"))
    leads = leads.select("seg", "key", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("lead")).select("seg", "key", "lead.*")
    t, q = tables.alias("t"), leads.alias("q")
    found = t.join(q, (F.col("t.seg") == F.col("q.seg")) & (F.col("t.key") == F.col("q.key")) & (F.col("t.d") != F.col("q.d")) & near)
    return found.select(F.col("q.d").alias("a"), F.col("t.d").alias("b")).distinct()


def labelled(prints: DataFrame, group: DataFrame) -> DataFrame:
    """prints with ``c``, the component of each."""
    known = [c for c in prints.columns if c != "c"]
    return saved(prints.select(*known).join(group, F.col("d") == F.col("node"), "left").select(*known, F.coalesce("component", "d").alias("c")))


def also(group: DataFrame, links: DataFrame) -> DataFrame:
    """The components that links make of those of group."""
    return components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def distinct_prints(prints: DataFrame) -> DataFrame:
    """(f0, ..., d): each fingerprint once, with the least document id that has it; of null ids alone, none."""
    return prints.groupBy(*[c for c in prints.columns if c != "doc_id"]).agg(F.min("doc_id").alias("d")).where("d is not null")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    component_id is the least id reachable over links of at most ``radius`` differing bits, the document's own included. Null
    and blank texts have fingerprint zero and link like others. Repeated rows repeat; a row with a null id takes the
    component of its fingerprint, null if no other row has that. An empty table gives no rows.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle))
    once = saved(distinct_prints(prints))
    group = components(stars(once, F.bit_count(F.col("t.f0").bitwiseXOR(F.col("q.f0"))) <= radius))
    group = also(group, links(labelled(once, group), once.count(), radius))
    own = once.join(group, F.col("d") == F.col("node"), "left").select("f0", F.coalesce("component", "d").alias("component_id"))
    return prints.join(own, "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted. Only A-Z are lower-cased; fewer words than ``size`` are one shingle."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = is_not_space()

    def of(run: WordRun, grams: np.ndarray, t: int) -> np.ndarray:
        a, b = int(run.first[t]), int(run.first[t + 1])
        if b - a >= size:
            return np.unique(grams[a : b - size + 1])
        acc = np.array([b - a], np.uint64)
        for k in range(a, b):
            acc = joined(acc, run.hash[k : k + 1])
        return acc[: b - a]

    for a, b in steps(texts):
        if b - a > 1 or len(texts[a]) <= SLICE:
            run = WordRun(texts[a:b], word, fold)
            grams = run.grams(size)[0]
            yield from (of(run, grams, t) for t in range(b - a))
            continue
        parts, short = [], np.zeros(0, np.uint64)
        for words in word_slices(texts[a], size - 1):
            run = WordRun([b" ".join(words)], word, fold)
            h = of(run, run.grams(size)[0], 0)
            if len(words) < size:
                short = h
            else:
                parts.append(h)
        yield np.unique(np.concatenate(parts)) if parts else short


def n_leading(n: int, similarity: float) -> int:
    """How many of a set's n shingles lead it: any so many of two similar sets, in one order of all shingles, have one in common."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def frequent(texts: DataFrame, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(bits, count) of frequent shingles, sorted; only orders shingles, rare ones first.

    Counted are the shingles of least hash of each text, twice as many as lead it, so that those that lead it in place of
    frequent ones are counted too. Up to FREQUENT of them come to the driver, those of the greatest counts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [h[: 2 * n_leading(len(h), similarity)] >> np.uint64(24) for h in shingle_sets(as_bytes(batch.column(0)), size)]
            k, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

    counted = texts.select("text").mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= 8)
    counted = written(counted.withColumn("bin", F.floor(F.log2("n") * 8).cast("int")))
    least, held = 1 << 30, 0
    for r in sorted(counted.groupBy("bin").count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.bin
    got = counted.where(F.col("bin") >= least).orderBy("k").select("k", "n").toArrow()
    return got["k"].to_numpy().astype(np.uint64), got["n"].to_numpy()


def set_hash(h: np.ndarray) -> int:
    """A signed hash of a set of shingles, whatever its order."""
    return int(mixed(h + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64))


def set_print(h: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, signed: a bit is set if it is in over half of their hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), SLICE >> 6):
        ones += np.unpackbits(h[at : at + (SLICE >> 6)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of the hashes fall on each of so many bits, as words of 64."""
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def laid(wide: np.ndarray, words: int) -> np.ndarray:
    """Parities of so many words from those of a multiple of them."""
    return np.bitwise_xor.reduce(wide.reshape(-1, words), axis=0)


def set_hashes(docs: DataFrame, size: int) -> DataFrame:
    """docs (with a text) with ``s``, the hash of the text's set of shingles, its fingerprint f0, its size n and its parities in place of the text.

    A parity bit is set if an odd number of the set's shingles fall on it; two sets differ in as many shingles at least as
    their parities in bits. m0, ... are the same number of bits for all sets; w has a bit or two for each shingle, at least as
    many as these. Halves of w laid on each other are the parities of half as many bits.
    """
    names = [f"m{k}" for k in range(PARITIES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, f, n, m, w = [], [], [], [], []
            for h in shingle_sets(as_bytes(batch.column("text")), size):
                wide = parities(h, max(64 * PARITIES, 1 << (len(h) - 1).bit_length() if len(h) else 0))
                s.append(set_hash(h))
                f.append(set_print(h))
                n.append(len(h))
                m.append(laid(wide, PARITIES).view(np.int64))
                w.append(wide.tobytes())
            m = np.array(m, np.int64).reshape(-1, PARITIES)
            own = [pa.array(s, pa.int64()), pa.array(f, pa.int64()), pa.array(n, pa.int64()), *[pa.array(m[:, k]) for k in range(PARITIES)], pa.array(w, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "s", "f0", "n", *names, "w"])

    rest = [f for f in docs.schema if f.name != "text"]
    return docs.select(*[f.name for f in rest], "text").mapInArrow(work, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], "s long", "f0 long", "n long", *[f"{x} long" for x in names], "w binary"]))


def print_links(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of sets (s, f0) of at most ``radius`` differing bits, which join all that such links join."""
    once = written(sets.select(F.col("s").alias("d"), "f0"))
    star = written(stars(once, F.bit_count(F.col("t.f0").bitwiseXOR(F.col("q.f0"))) <= radius))
    return star.unionByName(links(labelled(once, components(star)), once.count(), radius))


def posts(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(key, s, at): under each leading shingle that several sets share, those sets.

    A set's leading shingles are its rarest; two sets of at least the similarity have one of them in common. ``at`` holds n and the shingle's place. Of the sets of a batch that share a key one goes to that key's
    task, for all; so a key of very many sets gathers one row a batch there. Rows may repeat.
    """
    held = texts.sparkSession.sparkContext.broadcast(frequent(texts, size, similarity))

    def leading(h: np.ndarray) -> np.ndarray:
        known, count = held.value
        n = n_leading(len(h), similarity)
        if len(known):
            bits = h >> np.uint64(24)
            at = np.minimum(np.searchsorted(known, bits), len(known) - 1)
            h = h[np.argsort(np.where(known[at] == bits, count[at], 0), kind="stable")]
        return h[:n].view(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, tuple[int, np.ndarray]] = {}
            for h in shingle_sets(as_bytes(batch.column(0)), size):
                if len(h) and (x := set_hash(h)) not in sets:
                    sets[x] = len(h), leading(h)
            if not sets:
                continue
            counts = np.array([len(k) for _, k in sets.values()])
            s = np.repeat(np.array(list(sets), np.int64), counts)
            n = np.repeat(np.array([n for n, _ in sets.values()], np.int64), counts)
            key = np.concatenate([k for _, k in sets.values()])
            at = n << 32 | (np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts))
            order = np.lexsort((s, key))
            s, key, at = s[order], key[order], at[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            run = np.cumsum(first) - 1
            many = (np.bincount(run) > 1)[run]
            elsewhere = joined(s.view(np.uint64), key.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(first, key, elsewhere)), pa.array(s), pa.array(at), pa.array(key, mask=~many)], names=["k", "s", "at", "known"])
        let_go()

    sent = texts.select("text").mapInArrow(work, "k long, s long, at long, known long")
    same = Window.partitionBy("k")
    found = sent.select("*", F.min("s").over(same).alias("lo"), F.max("s").over(same).alias("hi")).where("known is not null or lo < hi")
    return found.select(F.coalesce("known", "k").alias("key"), "s", "at")


def differ(least: Column, sizes: Column, similarity: float) -> Column:
    """Whether sets of so many shingles together, that differ in ``least`` of them or more, can't have the Jaccard similarity."""
    return least * (1 + similarity) > sizes * (1 - similarity) + 1e-6


def likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets (s, n, w) whose sizes and wide parities allow the Jaccard similarity: few others, without their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                least = int(np.bitwise_count(x ^ laid(y, len(x))).sum())
                keep.append(least * (1 + similarity) <= n * (1 - similarity) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = lambda c: sets.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"), F.col("w").alias(f"w_{c}"))
    n = F.col("n_a") + F.col("n_b")
    full = pairs.join(one("a"), "a").join(one("b"), "b").where(~differ(F.abs(F.col("n_a") - F.col("n_b")), n, similarity)).withColumn("n", n)
    return full.select("a", "b", "n", "w_a", "w_b").mapInArrow(work, "a long, b long")


def marks(ids: DataFrame) -> DataFrame:
    """(word, v): a bitmap of at most MARKS bits with the low bits of all ids ``s``: what isn't marked isn't among them."""
    word = F.shiftright(F.col("s").bitwiseAND(F.lit(MARKS - 1)), 6)
    return ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))


def named(pairs: DataFrame) -> np.ndarray:
    """The marks of all ids that pairs (a, b) name."""
    words = marks(pairs.select(F.explode(F.array("a", "b")).alias("s"))).toArrow()
    out = np.zeros(MARKS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def packed_texts(texts: DataFrame, size: int, marks: np.ndarray) -> DataFrame:
    """(s, z): of each marked set of shingles one compressed text."""
    held = texts.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw, found = as_bytes(batch.column(0)), {}
            for k, h in enumerate(shingle_sets(raw, size)):
                s = set_hash(h)
                low = s & (MARKS - 1)
                if s not in found and int(held.value[low >> 6]) >> (low & 63) & 1:
                    found[s] = pack(raw[k])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["s", "z"])

    return texts.select("text").mapInArrow(work, "s long, z binary").groupBy("s").agg(F.first("z").alias("z"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose texts have sets of shingles of at least the Jaccard similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                columns = [batch.column(k).to_pylist() for k in (2, 3)]
                once = list(dict.fromkeys(columns[0] + columns[1]))
                sets = dict(zip(once, shingle_sets([unpack(z) for z in once], size), strict=True))
                keep = []
                for x, y in zip(*columns, strict=True):
                    x, y = sets[x], sets[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        let_go()

    held = packed_texts(texts, size, named(pairs))
    full = pairs.join(held.select(F.col("s").alias("a"), F.col("z").alias("x")), "a")
    full = full.join(held.select(F.col("s").alias("b"), F.col("z").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def similar(texts: DataFrame, sets: DataFrame, size: int, similarity: float, radius: int = 4) -> DataFrame:
    """(node, component) of sets of shingles over all pairs of at least the Jaccard similarity; those without a pair aren't returned.

    sets (s, f0, n, m0, ..., w) has the fingerprint, the size and the parities of each. Links of fingerprints within the radius come first,
    verified by their texts. What they leave apart is completed: pairs are found under the first leading shingle that they have in common: what
    leads one of them before it is not in the other. Of the sets of a key the head is the one that it leads first, as the text
    is from which others were made. Each set is first held against the head with which it shares most keys, so that a dense
    group is joined by a number of pairs that grows with its size; then all pairs of different components whose places, sizes and
    parities allow it, and all that remain are verified by their texts. Texts move only for pairs that wide parities don't exclude.
    """
    shared = posts(texts, size, similarity).distinct()
    shared = written(shared.select("key", "s", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), F.shiftright("at", 32).alias("n")))
    heads = shared.groupBy("key").agg(F.min(F.struct("pos", "s", "n")).alias("h"))
    least = F.greatest(F.col("pos") + F.col("h.pos"), F.abs(F.col("n") - F.col("h.n")))
    tried = shared.join(heads, "key").where((F.col("s") != F.col("h.s")) & ~differ(least, F.col("n") + F.col("h.n"), similarity))
    best = tried.groupBy("s", F.col("h.s").alias("head")).count().groupBy("s").agg(F.max_by("head", F.struct("count", "head")).alias("b"))
    # each a job of its own: what one shuffles is gone before the next begins
    best = written(best.select(F.col("s").alias("a"), "b"))
    first = written(print_links(sets, radius)).unionByName(best)
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = written(likely(first, sets, similarity))
    group = components(verified(first, texts, size, similarity))
    own = shared.join(group, F.col("s") == F.col("node"), "left").select(*shared.columns, F.coalesce("component", "s").alias("c"))
    # keys whose sets are all of one component are done; so is a set under a key where none is near enough to it
    room = F.col("pos") * (1 + similarity) - F.col("n") * (1 - similarity)
    open_keys = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(room).alias("room")).where("lo < hi").select("key", "room")
    open_ = own.join(open_keys, "key").where(room + F.col("room") <= 1e-6).drop("room")
    open_ = written(open_.join(sets.select("s", *[f"m{k}" for k in range(PARITIES)]), "s"))
    # of a pair of two components one side at least isn't in the key's largest
    largest = open_.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("most"))
    t, q = open_.join(largest, "key").where("c <> most").alias("t"), open_.alias("q")
    sizes = F.col("t.n") + F.col("q.n")
    parity = sum([F.bit_count(F.col(f"t.m{k}").bitwiseXOR(F.col(f"q.m{k}"))) for k in range(1, PARITIES)], F.bit_count(F.col("t.m0").bitwiseXOR(F.col("q.m0"))))
    least = F.greatest(F.col("t.pos") + F.col("q.pos"), F.abs(F.col("t.n") - F.col("q.n")))
    may = ~differ(least, sizes, similarity) & ~differ(parity, sizes, similarity)
    pairs = t.join(q, (F.col("t.key") == F.col("q.key")) & (F.col("t.c") != F.col("q.c")) & may)
    pairs = written(pairs.select(F.least("t.s", "q.s").alias("a"), F.greatest("t.s", "q.s").alias("b")).distinct())
    return also(group, verified(written(likely(pairs, sets, similarity)), texts, size, similarity))


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay if one of each group of near-duplicates stays, with all their columns.

    Near-duplicates have sets of shingles of at least the Jaccard similarity; all such pairs are found and verified. Groups are
    their connected components. The least id of a group stays, once; rows with a null id stay. Of rows that repeat an id only those
    go whose text has a near-duplicate: ids are told apart by their texts. Null and blank texts are one group.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    # documents with the same set of shingles share s
    prints = written(set_hashes(texts.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc"), "text"), shingle))
    sets = prints.groupBy("s").agg(*[F.first(c).alias(c) for c in prints.columns if c not in ("doc", "s")])
    group = similar(texts, sets, shingle, similarity)
    own = prints.join(group, F.col("s") == F.col("node"), "left").select("doc", F.coalesce("component", "s").alias("c"))
    first = own.groupBy("c").agg(F.min("doc").alias("first"))
    gone = written(own.join(first, "c").where("doc <> first").select(F.col("doc.doc_id").alias("id"), F.col("doc.t").alias("t")).distinct())
    # rows that nothing marks, and those without an id, stay where they are; only the others are shuffled
    many = prints.groupBy(F.col("doc.doc_id").alias("id"), F.col("doc.t").alias("t")).count().where("count > 1").select("id", "t")
    place = F.xxhash64("id", "t")
    marked = written(marks(gone.unionByName(many).select(place.alias("s"))))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")).withColumn("place", place.bitwiseAND(F.lit(MARKS - 1)))
    row = row.join(F.broadcast(marked), F.shiftright("place", 6) == F.col("word"), "left")
    seen = F.expr("id is not null and coalesce(shiftrightunsigned(v, cast(place & 63 as int)) & 1, 0) = 1")
    # of rows that repeat an id and its text one stays
    kept = row.where(seen).join(gone, ["id", "t"], "left_anti")
    kept = kept.withColumn("pick", F.row_number().over(Window.partitionBy("id", "t").orderBy(F.xxhash64("row")))).where("pick = 1")
    return row.where(~seen).select("row").unionByName(kept.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
