"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Spark's setting that deletes what an action has shuffled when the action ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset and Spark runs locally, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What the actions inside shuffle is deleted when they end, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with shuffles_go(df.sparkSession):
        # the setting holds for what is planned under it
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as a table: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(F.length(bare) > 0, F.split(bare, WS_RUN)).otherwise(F.array().cast("array<string>"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x acts on all bits of the result. Works in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pairs (a, b)."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordRun:
    """The words of several texts as arrays: a 64-bit hash of each word, its text and its place in the buffer."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, fold: np.ndarray | None = None):
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold is not None:
            buffer = fold[buffer]
        inside = is_word[buffer]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.buffer, self.start, self.end = buffer, edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.text = np.searchsorted(self.text_end, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = self._hashed()

    def _hashed(self) -> np.ndarray:
        """Eight bytes at a time; words are grouped by their number of blocks."""
        size = self.end - self.start
        padded = np.concatenate([self.buffer, np.zeros(16, np.uint8)]).astype(np.uint64)
        eight = padded[:-1] | (padded[1:] << np.uint64(8))
        eight = eight[:-2] | (eight[2:] << np.uint64(16))
        eight = eight[:-4] | (eight[4:] << np.uint64(32))
        out = size.astype(np.uint64)
        todo = np.arange(len(size))
        done = 0
        while len(todo):
            left = size[todo] - done
            block = eight[self.start[todo] + done]
            short = left < 8
            keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            out[todo] = joined(out[todo], block & keep)
            todo = todo[left > 8]
            done += 8
        return out

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and whether the run lies in one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        parts, at, size, acc = self.hash ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64), 0, 1, None
        m, want, left = len(self.hash) - n + 1, n, n
        while left:  # powers of two of n, each made of two halves
            if left & 1:
                piece = parts[at : at + m]
                acc = piece.copy() if acc is None else joined(acc, piece)
                at += size
            left >>= 1
            if left:
                parts = joined(parts[:-size], parts[size:])
                size *= 2
        assert at == want
        return acc, self.text[:m] == self.text[n - 1 :]


def let_go() -> None:
    """Gives memory that a task has freed back to the system: its worker stays for other tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def is_not_space() -> np.ndarray:
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


def leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of its leftmost least value."""
    value, index, n = h, np.arange(len(h), dtype=np.int64), 1
    while n < width:
        s = min(n, width - n)
        take = value[s:] < value[:-s]
        index = np.where(take, index[s:], index[:-s])
        value = np.where(take, value[s:], value[:-s])
        n += s
    return index
