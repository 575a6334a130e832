"""Removal of repeated word windows by level-wise doubling.

Every window of the wanted length is first represented by a shorter window inside it, the one of least hash, which is the
same in all copies. Only windows whose representative repeats somewhere are extended to twice its length, and so on up to the
wanted length or until none survives. At that length, every occurrence but the first is removed. A batch sends each hash once,
whatever its number of occurrences there, so that no hash gathers many rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockwright.llm.common import WordRun, as_bytes, is_not_space, joined, leftmost_min, mixed, steps, table

WINDOW = 20
#: The shortest window of the first level.
FIRST = 8
#: A longer text is worked on in pieces of about so many bytes that overlap by a window.
PIECE = 4 << 20
#: What is shuffled of a window: p holds 32 more bits of its hash, then where it starts; a range known to repeat has its end in
#: ``to``, others have 0. Few columns, with the values side by side, as every repeated window goes through here.
_KEYS = "key long, p long, did long, th long, to int"


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths that about double up to the window, the first of at least ``first`` words."""
    out = [window]
    while out[0] // 2 >= first:
        out.insert(0, -(-out[0] // 2))
    return out


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[int, int, bytes]]:
    """(index of the text, words before the piece, piece)."""
    for k, t in enumerate(texts):
        if len(t) <= PIECE:
            yield k, 0, t
            continue
        at, words, tail = 0, 0, []
        while at < len(t):
            to = at + PIECE
            while to < len(t) and t[to] not in b" \t\n\x0b\x0c\r":
                to += 1
            new = t[at:to].split()
            yield k, words - len(tail), b" ".join(tail + new)
            words += len(new)
            tail = (tail + new)[-(window - 1) :] if window > 1 else []
            at = to


def _frame(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _sent(h1: np.ndarray, h2: np.ndarray, did: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray, first_stays: bool) -> pa.RecordBatch:
    """Rows of one batch for the shuffle: of each hash one row under its own key, the others under keys of their own, known.

    first_stays: the first occurrence isn't known to repeat here (rows at the same place are all first); else all are known.
    """
    order = np.lexsort((a, did, h2, h1))
    h1, h2, did, th, a, b = (x[order] for x in (h1, h2, did, th, a, b))
    lead = np.ones(len(h1), bool)
    lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    group = np.cumsum(lead) - 1
    heads = np.flatnonzero(lead)
    if first_stays:
        known = (did != did[heads][group]) | (a != a[heads][group])
        own = ~known
    else:
        known = (np.bincount(group, minlength=len(heads)) > 1)[group]
        own = lead
    if first_stays and known.any():  # known windows of a document need no key: they are sent as merged ranges
        k = np.flatnonzero(known)
        k = k[np.lexsort((a[k], th[k], did[k]))]
        new = np.ones(len(k), bool)
        new[1:] = (did[k][1:] != did[k][:-1]) | (th[k][1:] != th[k][:-1]) | (a[k][1:] > b[k][:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(k)) - 1
        keep = np.flatnonzero(own)
        did, th, a, b = (np.concatenate([x[keep], x[k[y]]]) for x, y in ((did, begin), (th, begin), (a, begin), (b, last)))
        known = np.arange(len(did)) >= len(keep)
        h1, h2, own = np.concatenate([h1[keep], np.zeros(len(begin), np.uint64)]), np.concatenate([h2[keep], np.zeros(len(begin), np.uint64)]), ~known
    elsewhere = joined(did.view(np.uint64) + th.view(np.uint64), a.astype(np.uint64))
    p = np.where(own, h2, np.uint64(1)) << np.uint64(32) | a.astype(np.uint64)
    return _frame([np.where(own, h1, elsewhere).view(np.int64), p.view(np.int64), did, th, np.where(known, b, 0).astype(np.int32)], [x.split()[0] for x in _KEYS.split(", ")])


def _windows(batches: Iterator[pa.RecordBatch], length: int, shorter: int | None, window: int) -> Iterator[pa.RecordBatch]:
    """Representatives of ``length`` words of the windows whose shorter representatives are listed (of all, at first)."""
    is_word = is_not_space()
    for batch in batches:
        did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lists = batch.column(3) if shorter else None
        pieces = list(_pieces(as_bytes(batch.column(2)), window))
        for x, y in steps([p[2] for p in pieces]):
            row = np.array([p[0] for p in pieces[x:y]])
            offset = np.array([p[1] for p in pieces[x:y]])
            run = WordRun([p[2] for p in pieces[x:y]], is_word)
            n = len(run.hash) - window + 1
            if n <= 0:
                continue
            wanted = run.text[:n] == run.text[window - 1 :]
            if shorter:
                marked = np.zeros(len(run.hash), bool)
                for t in range(y - x):
                    places = lists[int(row[t])].values.to_numpy() - offset[t]
                    size = run.first[t + 1] - run.first[t]
                    marked[run.first[t] + places[(places >= 0) & (places < size)]] = True
                wanted &= marked[leftmost_min(run.grams(shorter)[0], window - shorter + 1)]
            h1 = run.grams(length)[0]
            at = np.unique(leftmost_min(h1, window - length + 1)[wanted])
            if not len(at):
                continue
            h2 = run.grams(length, 1)[0][at] & np.uint64(0xFFFFFFFF) if length == window else np.zeros(len(at), np.uint64)
            text = run.text[at]
            place = at - run.first[text] + offset[text]
            yield _sent(h1[at], h2, did[row[text]], th[row[text]], place, place + length, length == window)


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = []
        for t, first, some in zip(as_bytes(batch.column(1)), starts, spans, strict=True):
            words = t.split()
            n, gone = len(words), 0
            if first or some:
                at, rest = 0, []
                for a, b in sorted([*[(x, x + window) for x in first], *[(x["a"], x["b"]) for x in some]]):
                    if b > at:
                        a = max(at, a)
                        rest += words[at:a]
                        gone += b - a
                        at = b
                words = rest + words[at:]
            out.append((n, gone, b" ".join(words)))
        yield _frame([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, did, th, text): did orders documents, null ids last; (did, th) tells rows apart, but for equal ones.

    ``row`` packs all columns but the text, which would else be shuffled twice. Where all ids differ, th is zero: a hash of the
    text would tell no more, and goes into every row of the shuffles.
    """
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    most = docs.groupBy(did.alias("did")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    th = F.xxhash64(text_col) if (most or 0) > 1 else F.lit(0).cast("long")
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"), did.alias("did"), th.alias("th"), F.col(text_col).alias("text"))


def repeated_spans(rows: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(did, th, starts, spans): per document the windows, and merged ranges of windows, that occur earlier too."""
    shorter, lists = None, None
    for length in levels(window, first):
        # with its row, so that this join and the one that cuts the texts share one shuffle of them
        source = rows.select("did", "th", "text") if lists is None else rows.join(lists, ["did", "th"]).select("did", "th", "text", "places", "row")

        def work(batches: Iterator[pa.RecordBatch], length: int = length, shorter: int | None = shorter) -> Iterator[pa.RecordBatch]:
            return _windows(batches, length, shorter, window)

        sent = source.mapInArrow(work, _KEYS).repartition("key")
        sent = sent.select("key", F.shiftrightunsigned("p", 32).alias("key2"), "did", "th", F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("a"), "to")
        same = Window.partitionBy("key", "key2")
        if length < window:
            repeated = sent.withColumn("n", F.count("*").over(same)).where("to > 0 or n > 1")
            lists = repeated.groupBy("did", "th").agg(F.collect_list("a").alias("places"))
        else:
            later = sent.withColumn("n", F.rank().over(same.orderBy("did", "a"))).where("to > 0 or n > 1")
            lists = later.groupBy("did", "th").agg(F.collect_list(F.when(F.col("to") == 0, F.col("a"))).alias("starts"), F.collect_list(F.when(F.col("to") > 0, F.struct("a", F.col("to").alias("b")))).alias("spans"))
        shorter = length
    return lists


def without_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed, kept): ``row`` packs the columns of docs but the text, kept are the words that stay, joined by a space.

    A window's occurrences are ordered by (id, place), null ids last; rows that share an id aren't earlier than each other, so
    repeated rows are judged alike. Null and blank texts have no words. A text of fewer words than the window stays. Ids are
    numbers, or texts of numbers; others are an error. An empty table gives no rows; further columns, whatever their names, are in row.
    Windows are told by 96 bits of hashes of all their words: of 10^12 different windows two are taken for one with a probability of about 10^-5.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, first)
    found = rows.join(spans, ["did", "th"], "left").select("row", "text", "starts", "spans")
    return found.mapInArrow(partial(_kept, window=window), f"row {found.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_repeats(docs)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
