"""Benchmark decontamination: windows of test items are looked up in a broadcast hash set while texts are scanned.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``n`` consecutive words of an item; an
item of fewer words, but not none, is one window. Hits of the 64-bit hashes are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import WordRun, as_bytes, steps, table, written

N = 10
#: Bytes of the words of all items that are broadcast at once; a window takes about five times its share of them. A larger test
#: set is scanned in as many passes as it takes, each of which holds and broadcasts one part, also on the driver.
MOST_BROADCAST = 16 << 20
#: A longer item is cut into pieces of about so many bytes that overlap by a window but for a word.
PIECE = 1 << 20
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<a:long,b:long>>"
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return word, fold


def _words(text: bytes) -> list[bytes]:
    word, fold = _tables()
    return bytes(np.where(word[f := fold[np.frombuffer(text, np.uint8)]], f, 32)).split()


class Windows:
    """The windows of a bounded set of pieces (item, words joined by a space): for each length the sorted hashes, with the
    item of each and where its words are.
    """

    def __init__(self, pieces: list[tuple[str, bytes]], n: int):
        self.items = sorted({i for i, _ in pieces})
        self.text = b"\n".join([t for _, t in pieces]) + b"\n"
        number = {x: k for k, x in enumerate(self.items)}
        own = np.array([number[i] for i, _ in pieces], np.int32)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        word, fold = _tables()
        offset = 0
        for a, b in steps([t for _, t in pieces]):
            run = WordRun([t for _, t in pieces[a:b]], word, fold)
            count = np.diff(run.first)
            for size in sorted({min(n, c) for c in count.tolist() if c}):
                h, ok = run.grams(size)
                at = np.flatnonzero(ok & ((count == size) | (count > n) & (size == n))[run.text[: len(h)]])
                found.setdefault(size, []).append((h[at], run.start[at] + offset, run.end[at + size - 1] + offset, own[a:b][run.text[at]]))
            offset += len(run.buffer)
        self.lengths: dict[int, tuple[np.ndarray, ...]] = {}
        for size, parts in found.items():
            h, start, end, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)  # a first look that most windows fail
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.lengths[size] = h[order], start[order], end[order], item[order], seen

    def having(self, size: int, low: int, high: int, words: bytes) -> list[int]:
        """The items with a window of just these words, among those of equal hash."""
        _, start, end, item, _ = self.lengths[size]
        return sorted({int(item[k]) for k in range(low, high) if self.text[start[k] : end[k]] == words})

    def scan(self, texts: list[bytes]) -> tuple[list, list, list, list]:
        """(number of words, of hit words, items found, byte ranges of hit words) of each text."""
        word, fold = _tables()
        run = WordRun(texts, word, fold)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for size, (hashes, _, _, _, seen) in self.lengths.items():
            h, ok = run.grams(size)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)] & ok)
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            known: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(low < high).tolist():
                i = int(at[k])
                words = b" ".join([run.buffer[a:b].tobytes() for a, b in zip(run.start[i : i + size].tolist(), run.end[i : i + size].tolist(), strict=True)])
                if words not in known:
                    known[words] = self.having(size, int(low[k]), int(high[k]), words)
                if known[words]:
                    t = int(run.text[i])
                    hits.setdefault(t, []).append((i, i + size))
                    items.setdefault(t, set()).update(known[words])
        n_hit, spans, names = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        for t, some in hits.items():
            joined: list[list[int]] = []
            for a, b in sorted(some):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            n_hit[t] = sum(b - a for a, b in joined)
            start = int(run.text_start[t])
            spans[t] = [{"a": int(run.start[a]) - start, "b": int(run.end[b - 1]) - start} for a, b in joined]
            names[t] = [self.items[k] for k in sorted(items[t])]
        return np.diff(run.first).tolist(), n_hit, names, spans


def united(text: bytes, items: list[str], spans: list[dict[str, int]]) -> tuple[int, int, list[str], list[dict[str, int]]]:
    """One result from what several scans of the same text found."""
    joined: list[dict[str, int]] = []
    for s in sorted(spans, key=lambda x: (x["a"], x["b"])):
        # the words between two spans decide whether they meet
        if joined and (s["a"] <= joined[-1]["b"] or not _words(text[joined[-1]["b"] : s["a"]])):
            joined[-1]["b"] = max(joined[-1]["b"], s["b"])
        else:
            joined.append(dict(s))
    return len(_words(text)), sum(len(_words(text[s["a"] : s["b"]])) for s in joined), sorted(set(items)), joined


def _cut(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words, at = _words(text), 0
            pieces = [b" ".join(words)] if words else []
            if pieces and len(pieces[0]) > PIECE:
                each = max(n, PIECE * len(words) // len(pieces[0]))
                pieces = [b" ".join(words[at : at + each + n - 1]) for at in range(0, max(1, len(words) - n + 1), each)]
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])


def parts_of(pieces: DataFrame, most: int) -> list[DataFrame]:
    """The pieces (item, words) in parts of at most ``most`` bytes, or of one bucket, by ranges of buckets of their hash.

    Only a number per bucket comes to the driver; buckets are so many that pieces of one rarely exceed a part.
    """
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, min(1 << 16, 16 * size // most)) if size > most else 1
    if n == 1:
        return [pieces]
    bucket = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    ranges, held = [[0, 0]], 0
    for r in sorted(pieces.groupBy(bucket.alias("b")).agg(F.sum(F.octet_length("words")).alias("n")).collect()):
        if held and held + r.n > most:
            ranges.append([r.b, r.b])
            held = 0
        ranges[-1][1] = r.b
        held += r.n
    return [pieces.where(bucket.between(a, b)) for a, b in ranges]


def scanned(docs: DataFrame, items: DataFrame, n: int = N, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST_BROADCAST) -> DataFrame:
    """(row, text, n_words, n_hit, items, spans): ``row`` packs all columns of docs; spans are byte ranges of hit words.

    Null and empty texts have no words and no hits; items with a null id or text are left out; an empty test set hits nothing.
    Repeated rows are scanned each; a word that several windows cover counts once. A test set of several parts takes a pass over
    the texts for each, which notes the texts with hits, and a join of those with all texts by their hash.
    """
    sc = docs.sparkSession.sparkContext
    known = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    pieces = written(known.mapInArrow(partial(_cut, n=n), "item string, words binary"))
    parts = parts_of(pieces, most)
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()

    def windows(part: DataFrame):  # noqa: ANN202
        return sc.broadcast(Windows(sorted((r.item, bytes(r.words)) for r in part.toLocalIterator()), n))

    def arrays(out) -> list[pa.Array]:  # noqa: ANN001
        return [pa.array(x, k) for x, k in zip(out, _KINDS, strict=True)]

    if len(parts) == 1:
        held = windows(parts[0])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(1))
                for a, b in steps(texts):
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], *arrays(held.value.scan(texts[a:b]))], names=["row", "text", "n_words", "n_hit", "items", "spans"])

        return packed.mapInArrow(work, f"row {kind}, text string, {SCHEMA}")

    keyed = packed.withColumn("k", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = []
    for part in parts:
        held = windows(part)

        def hits(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                texts = as_bytes(batch.column(1))
                for a, b in steps(texts):
                    _, n_hit, names, spans = arrays(held.value.scan(texts[a:b]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), names, spans], names=["k", "items", "spans"]).filter(pc.greater(n_hit, 0))

        found.append(written(keyed.select("k", "text").mapInArrow(hits, "k string, items array<string>, spans array<struct<a:long,b:long>>").dropDuplicates(["k"])))
        held.destroy()
    whole = reduce(DataFrame.unionByName, found).groupBy("k").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out = list(zip(*[united(t, i or [], s or []) for t, i, s in rows], strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays(out)], names=["row", "text", "n_words", "n_hit", "items", "spans"])

    return keyed.join(whole, "k", "left").select("row", "text", "items", "spans").mapInArrow(finish, f"row {kind}, text string, {SCHEMA}")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; see ``scanned`` for odd rows."""
    found = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text"), items, n)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, most_hit: float = 0.5, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents without hit spans, with all their columns; one of whose words over ``most_hit`` are hit goes as a whole.

    chars_col follows the text. Texts without hits stay as they are, null ones included. Rows are judged one by one, so rows that repeat
    stay or go together; empty documents give no rows, without items nothing is hit; other columns pass as they are, whatever their names.
    """
    found = scanned(docs, items, n, text_col).where("n_hit = 0 or n_hit <= n_words * " + repr(float(most_hit)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    t, at, rest = texts[k], 0, []
                    for s in spans:
                        rest.append(t[at : s["a"]])
                        at = s["b"]
                    texts[k] = b"".join([*rest, t[at:]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])

    cut = found.select("row", "text", "spans").mapInArrow(work, f"row {found.schema['row'].dataType.simpleString()}, text string")
    new = {text_col: F.col("text")} | ({chars_col: F.when(F.col("text") == F.col("row")[text_col], F.col("row")[chars_col]).otherwise(F.length("text").cast(docs.schema[chars_col].dataType))} if chars_col in docs.columns else {})
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
