"""Substring search by an index of three-letter grams: posting lists are intersected, and what is left is verified.

A posting list is cut into blocks of 65,536 neighbouring ids, each a sorted list of two-byte places or, where that is longer, a bitmap; so a
block has 8 KB at most, however common its gram. Blocks are written in the order of their grams, so that a search reads the files and
row groups of its own grams only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.functions.predicates import contains
from stockwright.sources.tables import kept

GRAM, BLOCK = 3, 1 << 16
#: Places up to which a list is shorter than a bitmap.
MOST_LISTED = BLOCK // 16
_POSTINGS = "gram long, block long, places binary"


def grams_of(text: str) -> np.ndarray:
    """The distinct grams of a text, each three code points in one number."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) >= GRAM else np.zeros(0, np.int64)


def coded(places: np.ndarray) -> bytes:
    """Sorted distinct places of a block, as a list or a bitmap; the length tells which, as a list is shorter."""
    if len(places) < MOST_LISTED:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def decoded(places: bytes) -> np.ndarray:
    raw = np.frombuffer(places, np.uint8)
    return np.flatnonzero(np.unpackbits(raw)) if len(raw) == BLOCK // 8 else np.frombuffer(places, "<u2").astype(np.int64)


def _groups(gram: np.ndarray, block: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((place, block, gram))
    gram, block, place = gram[order], block[order], place[order]
    group = np.ones(len(gram), bool)
    group[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
    once = group.copy()
    once[1:] |= place[1:] != place[:-1]
    gram, block, place, starts = gram[once], block[once], place[once], np.flatnonzero(group[once])
    parts = [coded(p) for p in np.split(place, starts[1:])] if len(gram) else []
    return pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(block[starts]), pa.array(parts, pa.binary())], names=["gram", "block", "places"])


def build_index(rows: DataFrame, key: str, columns: Sequence[str], folder: str) -> DataFrame:
    """Writes the index of the lower-cased texts of some columns to a folder; key is a number from 0 on, null keys aren't found.

    Each task gathers the places of its rows by gram before they are shuffled; a gram's lists meet block by block.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids = some.column("key").to_pylist()
                found = [np.concatenate([grams_of(t) for t in texts if t is not None] or [np.zeros(0, np.int64)]) for texts in some.column("texts").to_pylist()]
                each = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
                yield _groups(np.concatenate(found) if found else np.zeros(0, np.int64), each // BLOCK, each % BLOCK)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("gram", "block", "places")], strict=True):
                if held and held[0][:2] != row[:2]:
                    out.append(met(held))
                    held = []
                held.append(row)
            yield made(out)
        yield made([met(held)] if held else [])

    def met(rows: list) -> tuple:
        return (*rows[0][:2], rows[0][2] if len(rows) == 1 else coded(np.unique(np.concatenate([decoded(r[2]) for r in rows]))))

    def made(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["gram", "block", "places"])

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.array(*[F.lower(F.col(c).cast("string")) for c in columns]).alias("texts"))
    gathered = kept(texts.mapInArrow(gather, _POSTINGS))  # read twice: for the bounds of the ranges, too
    gathered.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block").mapInArrow(merge, _POSTINGS).write.mode("overwrite").parquet(folder)
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_POSTINGS).parquet(folder)


def candidates(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term, key) of rows with all grams of a term; terms, lower-cased, have three letters at least."""
    wanted = [(t, int(g), len(grams)) for t in terms for grams in [grams_of(t)] for g in grams]
    spark = index.sparkSession
    asked = spark.createDataFrame(wanted, "term string, gram long, n int")

    def both(df: pd.DataFrame) -> pd.DataFrame:
        found: np.ndarray | None = None
        if len(df) == df["n"].iloc[0]:
            for places in sorted(df["places"], key=len):
                more = decoded(places)
                found = more if found is None else found[np.isin(found, more, assume_unique=True)]
        keys = np.zeros(0, np.int64) if found is None else found + int(df["block"].iloc[0]) * BLOCK
        return pd.DataFrame({"term": df["term"].iloc[0], "key": keys})

    some = index.where(F.col("gram").isin(*sorted({g for _, g, _ in wanted})))
    return some.join(F.broadcast(asked), "gram").groupBy("term", "block").applyInPandas(both, "term string, key long")


def search(rows: DataFrame, index: DataFrame, key: str, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """(term, key) for each of a few terms and each row of which one of the columns contains it, whatever the case; an empty term is in all.

    Terms under three letters have no gram and are looked for by a scan; so are all rows without a key.
    """
    asked = list(dict.fromkeys(t.strip().lower() for t in terms))
    long, short = [t for t in asked if len(t) >= GRAM], [t for t in asked if len(t) < GRAM]
    has = lambda t: contains(t, *columns)
    scans = [rows.where(has(t) if t else F.lit(True)).select(F.lit(t).alias("term"), F.col(key)) for t in short]
    scans += [rows.where(F.col(key).isNull() & has(t)).select(F.lit(t).alias("term"), F.col(key)) for t in long]
    found = []
    if long:
        some = candidates(index, long).withColumnRenamed("key", "_key")
        met = rows.select(key, *columns).join(some, F.col(key) == F.col("_key"))
        real = reduce(or_, [(F.col("term") == t) & has(t) for t in long])
        found = [met.where(real).select("term", key)]
    return reduce(lambda a, b: a.unionByName(b), [*found, *scans])
