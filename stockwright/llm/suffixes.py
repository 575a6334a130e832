"""Removal of byte strings that occur twice, with suffix arrays built by linear grouping.

A window of 200 bytes is found by its anchor, the 32-byte string of least hash inside it, which is the same in all copies. An
anchor that occurs once has no repeated window. Where an anchor's whole neighbourhood repeats, all its windows do. What is left
are neighbourhoods that share an anchor and differ somewhere: they are dealt by anchor and sorted by suffix arrays over their
blocks, from the anchor on and backwards from it; what neighbours in both orders have in common decides what repeats.
An anchor with very many different neighbourhoods is not gathered in one task: it is split by all the bytes about it, so that each
of its windows is a group of its own, which repeats if it has two places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockwright.llm.common import as_bytes, joined, leftmost_min, mixed, saved, steps, table
from stockwright.llm.substrings import keyed

WIDTH = 200
ANCHOR = 32
BLOCK = 50
PIECE = 4 << 20
#: Different neighbourhoods of one anchor in a batch, and rows of one anchor in all, above which its windows are counted.
MANY_LOCAL, MANY = 32, 4000
#: Neighbourhoods that one suffix array takes, up to the end of an anchor's.
CHUNK = 16_384
_ANCHORS = "key long, h long, ctx long, did long, th long, p int, lo int, hi int, kind int"


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of symbols that end with a unique least one.

    Groups of suffixes are taken in descending order. Each suffix of a group points to the nearest earlier suffix of a lower
    group; suffixes that get pointers leave their group for new ones just above it, ordered by the number of pointers. In the
    end a group holds the suffixes of one longest Lyndon prefix. Then suffixes are emitted in ascending order: each one settles
    the next place in the group of those whose Lyndon prefix ends where it starts.
    """
    n = len(text)
    members: list[list[int]] = []
    group, above, below = [0] * n, [], []
    of: dict[int, int] = {c: k for k, c in enumerate(sorted(set(text)))}
    for k in range(len(of)):
        members.append([])
        above.append(k + 1)
        below.append(k - 1)
    above[-1] = -1
    for i, c in enumerate(text):
        group[i] = of[c]
        members[of[c]].append(i)
    top = len(of) - 1
    done = [False] * len(of)
    before = [-1] * n
    g = top
    while g >= 0:
        done[g] = True
        live = sorted([s for s in members[g] if group[s] == g])
        members[g] = live
        pointed: dict[int, int] = {}
        for s in live:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in pointed.items():
            parts.setdefault((group[p], k), []).append(p)
        for (a, _), some in sorted(parts.items(), key=lambda x: -x[0][1]):  # each goes just above its group: most pointers first
            if len(some) == len(members[a]) and all(group[s] == a for s in members[a]):
                continue  # the whole group moves: nothing is told apart
            new = len(members)
            members.append(some)
            done.append(False)
            for p in some:
                group[p] = new
            above.append(above[a])
            below.append(a)
            if above[a] >= 0:
                below[above[a]] = new
            else:
                top = new
            above[a] = new
        g = below[g]
    start, at = [0] * len(members), 0
    g = 0
    while g >= 0:
        start[g] = at
        at += sum(1 for s in members[g] if group[s] == g)
        g = above[g]
    out, settled = [0] * n, [False] * n
    out[0], settled[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not settled[j]:
            k = group[j]
            out[start[k]] = j
            start[k] += 1
            settled[j] = True
            j = before[j]
    return out


def _hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 8 and 32 bytes from each place."""
    v = np.concatenate([buffer, np.zeros(ANCHOR, np.uint8)]).astype(np.uint64)
    v = v[:-1] | (v[1:] << np.uint64(8))
    v = v[:-2] | (v[2:] << np.uint64(16))
    eight = mixed(v[:-4] | (v[4:] << np.uint64(32)))
    two = joined(eight[:-8], eight[8:])
    return eight, joined(two[:-16], two[16:])


def _window_hash(eight: np.ndarray, four: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the 200 bytes from each place: six times 32 and 8."""
    h = four[at]
    for k in range(1, 6):
        h = joined(h, four[at + ANCHOR * k])
    return joined(h, eight[at + 192])


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WIDTH + 1), PIECE):
            yield k, at, t[at : at + PIECE + WIDTH - 1]


def _ranges(did: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping ranges of the same text as one."""
    order = np.lexsort((a, th, did))
    did, th, a, b = did[order], th[order], a[order], b[order]
    new = np.ones(len(a), bool)
    if len(a) > 1:
        same = (did[1:] == did[:-1]) & (th[1:] == th[:-1])
        # the furthest end so far, within a text: texts are kept apart by a large step
        step = np.cumsum(np.concatenate([[0], ~same])) * np.int64(1 << 40)
        reach = np.maximum.accumulate(b.astype(np.int64) + step)
        new[1:] = ~same | (a[1:] + step[1:] > reach[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(a)) - 1
        return did[begin], th[begin], a[begin], (reach[last] - step[last]).astype(b.dtype)
    return did, th, a, b


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[x[0] for x in fields])


def _anchors(batches: Iterator[pa.RecordBatch], many_local: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a neighbourhood; 1: one that repeats in this batch; 2, 3: as 0, 1, of an anchor with many here; 4: a repeated range."""
    for batch in batches:
        dids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        pieces = [p for p in _pieces(as_bytes(batch.column(2))) if len(p[2]) >= WIDTH]
        for x, y in steps([p[2] for p in pieces]):
            row = np.array([p[0] for p in pieces[x:y]])
            shift = np.array([p[1] for p in pieces[x:y]])
            buffer = np.frombuffer(b"".join([p[2] for p in pieces[x:y]]), np.uint8)
            ends = np.cumsum([len(p[2]) for p in pieces[x:y]])
            begins = np.concatenate([[0], ends[:-1]])
            eight, four = _hashes(buffer)
            least = leftmost_min(four[: len(buffer) - ANCHOR + 1], WIDTH - ANCHOR + 1)
            text = np.repeat(np.arange(y - x), ends - begins)[: len(least)]
            ok = np.arange(len(least)) + WIDTH <= ends[text]
            at = np.flatnonzero(ok)
            new = np.ones(len(at), bool)
            new[1:] = (least[at][1:] != least[at][:-1]) | (text[at][1:] != text[at][:-1])
            lead = np.flatnonzero(new)
            lo, hi = at[lead], at[np.append(lead[1:], len(at)) - 1]
            p, t = least[lo], text[lo]
            h = four[p]
            ctx = joined(joined(_window_hash(eight, four, lo), _window_hash(eight, four, hi)), ((hi - lo) * 1024 + p - lo).astype(np.uint64))
            base = shift[t] - begins[t]
            did, th, p, lo, hi = dids[row[t]], ths[row[t]], p + base, lo + base, hi + base
            order = np.lexsort((lo, th, did, ctx, h))
            h, ctx, did, th, p, lo, hi = (z[order] for z in (h, ctx, did, th, p, lo, hi))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
            twice = (np.bincount(np.cumsum(first) - 1) > 1)[np.cumsum(first) - 1]
            own = np.flatnonzero(first)
            anchor = np.cumsum(np.concatenate([[True], h[own][1:] != h[own][:-1]])) - 1
            rank = np.arange(len(own)) - np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[anchor]
            many = (np.bincount(anchor) > many_local)[anchor]
            kind = twice[own].astype(np.int32) + 2 * many
            key = np.where(rank < many_local, h[own], joined(did[own].view(np.uint64) + th[own].view(np.uint64), lo[own].astype(np.uint64)))
            k = np.flatnonzero(twice)
            rd, rt, ra, rb = _ranges(did[k], th[k], lo[k], hi[k] + WIDTH)
            z = np.zeros(len(rd), np.int64)
            cat = lambda u, v: np.concatenate([u, v])
            yield _batch([cat(key.view(np.int64), joined(rd.view(np.uint64) + rt.view(np.uint64), ra.astype(np.uint64)).view(np.int64)), cat(h[own].view(np.int64), z), cat(ctx[own].view(np.int64), z), cat(did[own], rd), cat(th[own], rt), cat(p[own], z).astype(np.int32), cat(lo[own], ra).astype(np.int32), cat(hi[own], rb).astype(np.int32), cat(kind, z + 4).astype(np.int32)], _ANCHORS)


_NEAR = "h long, did long, th long, p int, lo int, known boolean, left binary, right binary"


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        did, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for k, (text, some) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
            out += [(s["h"], did[k], th[k], s["p"], s["lo"], s["known"], text[s["lo"] : s["p"]], text[s["p"] : s["hi"] + WIDTH]) for s in some]
        for i in range(0, len(out), 20_000):
            yield _batch(list(zip(*out[i : i + 20_000], strict=True)), _NEAR)


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def ordered(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts of at most WIDTH bytes by a suffix array over their blocks, and how many bytes each shares with the
    next, ends padded with zeros.
    """
    m, per = len(parts), WIDTH // BLOCK
    rows = _padded(parts, WIDTH)
    symbols = np.ones((m, per + 1), np.int64)
    symbols[:, :per] = np.unique(rows.reshape(-1).view(f"S{BLOCK}"), return_inverse=True)[1].reshape(m, per) + 2
    order = np.array(suffix_array([*symbols.ravel().tolist(), 0]))
    order = order[(order < m * (per + 1)) & (order % (per + 1) == 0)] // (per + 1)
    differ = rows[order][1:] != rows[order][:-1]
    return order, np.where(differ.any(1), differ.argmax(1), WIDTH)


def _runs(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each text, the run of the order in which neighbours share ``least`` bytes or more."""
    run = np.empty(len(order), np.int64)
    run[order] = np.concatenate([[0], np.cumsum(common < least)])
    return run


def repeated_windows(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For neighbourhoods of anchors, left and right of where the anchor starts: the least and the greatest number of bytes
    to the left of the anchor at which a window of WIDTH bytes starts that another one also has; -1 if none.

    A window with x bytes to the left is the same in two of them if they are in one run of the order to the right, where
    neighbours share WIDTH - x bytes, and in one run of the order of what is to the left, read backwards, where they share x.
    """
    m = len(left)
    n_left = np.fromiter(map(len, left), np.int64, m)
    n_right = np.fromiter(map(len, right), np.int64, m)
    ahead, back = ordered(right), ordered([x[::-1] for x in left])
    low, high = np.full(m, -1), np.full(m, -1)
    for x in range(WIDTH - ANCHOR + 1):
        k = np.flatnonzero((n_left >= x) & (n_right >= WIDTH - x))
        if len(k) < 2:
            continue
        key = _runs(*ahead, WIDTH - x)[k] * m + _runs(*back, x)[k]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(k), bool)
        hit[by[1:][same]] = hit[by[:-1][same]] = True
        k = k[hit]
        low[k] = np.where(low[k] < 0, x, low[k])
        high[k] = x
    return low, high


_RANGES = "did long, th long, a int, b int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; each suffix array takes whole anchors."""

    def result(t: pa.Table) -> pa.RecordBatch:
        low, high = repeated_windows(t["left"].to_pylist(), t["right"].to_pylist())
        k = np.flatnonzero((low >= 0) & ~t["known"].to_numpy())
        p = t["p"].to_numpy()[k]
        return _batch([t["did"].to_numpy()[k], t["th"].to_numpy()[k], (p - high[k]).astype(np.int32), (p - low[k] + WIDTH).astype(np.int32)], _RANGES)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield result(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
    if held:
        yield result(pa.Table.from_batches(held))


_COUNTED = "w1 long, w2 long, did long, th long, a int, b int, known boolean"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of anchors with many neighbourhoods: each once a batch, the others as known ranges."""
    for batch in batches:
        dids, ths, texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()
        for i, j in steps(texts):
            w1, w2, at, row = [], [], [], []
            for k in range(i, j):
                for s in lists[k]:  # only the bytes that the neighbourhood covers
                    part = np.frombuffer(texts[k][s["lo"] : s["hi"] + WIDTH], np.uint8)
                    eight, four = _hashes(part)
                    n = np.arange(s["hi"] - s["lo"] + 1)
                    h = _window_hash(eight, four, n)
                    w1.append(h)
                    back = eight[n + 192]
                    for x in range(5, -1, -1):
                        back = joined(back, four[n + ANCHOR * x])
                    w2.append(back)
                    at.append(n + s["lo"])
                    row.append(np.full(len(n), k))
            if not w1:
                continue
            w1, w2, at, row = (np.concatenate(z) for z in (w1, w2, at, row))
            did, th = np.array(dids, np.int64)[row], np.array(ths, np.int64)[row]
            order = np.lexsort((at, th, did, w2, w1))
            w1, w2, at, did, th = (z[order] for z in (w1, w2, at, did, th))
            first = np.ones(len(w1), bool)
            first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            twice = (np.bincount(np.cumsum(first) - 1) > 1)[np.cumsum(first) - 1]
            k, own = np.flatnonzero(twice & ~first), np.flatnonzero(first)
            rd, rt, ra, rb = _ranges(did[k], th[k], at[k], at[k] + WIDTH)
            elsewhere = joined(rd.view(np.uint64) + rt.view(np.uint64), ra.astype(np.uint64)).view(np.int64)
            yield _batch([np.concatenate([w1[own].view(np.int64), elsewhere]), np.concatenate([w2[own].view(np.int64), np.zeros(len(rd), np.int64)]), np.concatenate([did[own], rd]), np.concatenate([th[own], rt]), np.concatenate([at[own], ra]).astype(np.int32), np.concatenate([at[own] + WIDTH, rb]).astype(np.int32), np.concatenate([twice[own], np.ones(len(rd), bool)])], _COUNTED)


_OUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, some in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            at, spans, gone, rest, end = 0, 0, 0, [], -1
            for s in sorted(some or [], key=lambda s: s["a"]):
                if s["a"] > end:
                    spans += 1
                if s["b"] > at:
                    a = max(at, s["a"])
                    rest.append(text[at:a])
                    gone += s["b"] - a
                    at = end = s["b"]
            out.append((len(text), gone, spans, b"".join([*rest, text[at:]])))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        done = _batch([*cols], _OUT)
        yield pa.RecordBatch.from_arrays([batch.column(0), *done.columns], names=["row", *done.schema.names])


def repeated_ranges(rows: DataFrame, many_local: int = MANY_LOCAL, most: int = MANY) -> DataFrame:
    """(did, th, known, few, many): per document the ranges known to repeat, and neighbourhoods to compare or to count."""
    texts = rows.select("did", "th", "text")
    by_anchor = Window.partitionBy("key").orderBy("ctx")
    whole = by_anchor.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peers = by_anchor.rangeBetween(Window.currentRow, Window.currentRow)
    found = texts.mapInArrow(partial(_anchors, many_local=many_local), _ANCHORS).select(
        "*", F.count("*").over(whole).alias("n"), F.count("*").over(peers).alias("same"), F.max(F.col("kind").isin(2, 3)).over(whole).alias("many"),
        (F.rank().over(by_anchor) == F.row_number().over(by_anchor)).alias("lead"),
    ).where("kind = 4 or n > 1 or many or kind in (1, 3)")
    known = "kind = 4 or kind in (1, 3) or same > 1"
    many = f"kind < 4 and (many or n > {most})"
    few = f"kind < 4 and not ({many}) and n > same and lead"
    found = found.select(
        "did", "th",
        F.struct("h", "p", "lo", "hi", F.expr(known).alias("known")).alias("s"), "kind",
        F.expr(f"case when {many} then 2 when {few} then 1 else 0 end").alias("way"), F.expr(known).alias("known"),
    )
    # of each document: ranges known to repeat, neighbourhoods to compare, neighbourhoods whose windows are counted
    lists = found.groupBy("did", "th").agg(
        F.collect_list(F.when(F.col("known"), F.struct(F.col("s.lo").alias("a"), F.when(F.col("kind") == 4, F.col("s.hi")).otherwise(F.col("s.hi") + WIDTH).alias("b")))).alias("known"),
        F.collect_list(F.when(F.col("way") == 1, F.col("s"))).alias("few"), F.collect_list(F.when(F.col("way") == 2, F.col("s"))).alias("many"),
    )
    return lists


def _by_kind(rows: DataFrame, lists: DataFrame) -> DataFrame:
    # each join keeps the row, so that these and the one that cuts the texts share one shuffle of them
    with_list = lambda kind: rows.join(lists.where(f"size({kind}) > 0").select("did", "th", kind), ["did", "th"]).select("did", "th", "text", kind, "row")
    few = with_list("few").mapInArrow(_neighbourhoods, _NEAR)
    few = few.repartition("h").sortWithinPartitions("h").mapInArrow(_compared, _RANGES)
    many = with_list("many").mapInArrow(_hashed, _COUNTED)
    many = many.withColumn("n", F.count("*").over(Window.partitionBy("w1", "w2"))).where("known or n > 1").select("did", "th", "a", "b")
    known = lists.select("did", "th", F.inline("known")).select("did", "th", "a", "b")
    return known.unionByName(few).unionByName(many).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many_local: int = MANY_LOCAL, most: int = MANY) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): ``row`` packs the columns of docs but the text, kept are the bytes that stay.

    Every byte goes that a WIDTH-byte string covers which also starts anywhere else, in this or another document. Null texts
    are empty; texts of fewer bytes stay. Rows with the same id are different rows, whose texts can repeat each other. Ids are
    numbers, or texts of numbers; others are an error. An empty table gives no rows; further columns, whatever their names, are in row.
    """
    rows = keyed(docs, id_col, text_col)
    lists = saved(repeated_ranges(rows, many_local, most))
    found = rows.join(_by_kind(rows, lists), ["did", "th"], "left").select("row", "text", "spans")
    return found.mapInArrow(_removed, f"row {found.schema['row'].dataType.simpleString()}, {_OUT}")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
