"""Consumers that let no bad record hold up a batch: it is halved until the bad ones are alone, and these become dead letters.

``bisecting`` is for work that Spark does on a whole piece, a job each; ``bisecting_records`` for work on a handful of records at a time, which
tasks halve themselves, so that a batch is one job however many of its records are bad.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from stockwright.operators.ordered import Ordered
from stockwright.sources.tables import drop_path, kept
from stockwright.streaming.changes import split_stale

#: Pieces of a level that are worked on at the same time.
AT_ONCE = 8


def bisecting(work: Callable[[DataFrame, str], None], out: str, dead: str, order: Sequence[str], as_of: Column | None = None, age: str = "1 hour", retries: int = 2) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives a batch (``ts`` and columns that name a record, ``order``) to ``work`` in pieces.

    work(rows, path) reads the rows and writes what it makes of them to a path of its own below ``out``. Where that fails, the piece is
    halved, and a record that fails alone for another ``retries`` times goes to ``dead``, with the batch, the ``reason`` and the error. Records
    that are older than an age at ``as_of`` (else now), or of an unknown age, go there as ``stale`` without being tried. A batch that comes again
    begins anew: what it had written is replaced, and no record is written twice. b bad records of n cost about b log2(n) pieces,
    those of a level side by side.
    """

    def consume(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for place in (out, dead):
            drop_path(spark, f"{place}/batch={number}")
        fresh, stale = split_stale(batch, as_of if as_of is not None else F.current_timestamp(), age)
        letter = lambda rows, reason, error, name: rows.withColumns({"reason": F.lit(reason), "error": F.lit(error).cast("string")}).write.mode("overwrite").parquet(f"{dead}/batch={number}/from={name}")
        letter(stale, "stale", None, "stale")
        rows = kept(Ordered(fresh, order).numbered("_at").frame())

        def tried(low: int, high: int) -> list[tuple[int, int]]:
            """The halves that a piece leaves to be tried."""
            piece = rows.where((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at")
            error = _error(work, piece, f"{out}/batch={number}/from={low}", retries if high - low == 1 else 0)
            if error is None:
                return []
            if high - low == 1:
                letter(piece, "failed", error, low)
                return []
            middle = (low + high) // 2
            return [(low, middle), (middle, high)]

        n = rows.count()
        todo = [(0, n)] if n else []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while todo:
                todo = [half for halves in pool.map(lambda ends: tried(*ends), todo) for half in halves]

    return consume


def _error(work: Callable[[DataFrame, str], None], piece: DataFrame, path: str, retries: int) -> str | None:
    for _ in range(retries + 1):
        try:
            work(piece, path)
            return None
        except Exception as e:  # noqa: BLE001 what a record may do wrong isn't known here
            error = f"{type(e).__name__}: {str(e)[:500]}"
    drop_path(piece.sparkSession, path)
    return error


def bisecting_records(work: Callable[[list[dict]], list[tuple]], made: str, out: str, dead: str, as_of: Column | None = None, age: str = "1 hour", retries: int = 2, size: int = 100) -> Callable[[DataFrame, int], None]:
    """As bisecting, for a work that makes a row of the columns ``made`` (a schema) of each of up to ``size`` records, in their order.

    Tasks hand their records to work and halve what fails, so that a batch is one pass over its records, however many are bad. Results go
    below ``out``, dead letters below ``dead``, with what bisecting adds to them.
    """

    def consume(batch: DataFrame, number: int) -> None:
        fresh, stale = split_stale(batch, as_of if as_of is not None else F.current_timestamp(), age)
        results = batch.sparkSession.createDataFrame([], made).schema
        kind = to_arrow_schema(StructType([StructField("made", results)])).field("made").type

        def handled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, errors = [None] * b.num_rows, [None] * b.num_rows
                todo = [(at, min(at + size, b.num_rows)) for at in range(0, b.num_rows, size)]
                while todo:
                    low, high = todo.pop()
                    some = b.slice(low, high - low).to_pylist()
                    got, error = _made(work, some, retries if high - low == 1 else 0)
                    if error is None:
                        rows[low:high] = [dict(zip(kind.names, r, strict=True)) for r in got]
                    elif high - low == 1:
                        errors[low] = error
                    else:
                        todo += [((low + high) // 2, high), (low, (low + high) // 2)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(errors, pa.string())], names=[*b.schema.names, "_made", "_error"])

        shape = StructType([*fresh.schema.fields, StructField("_made", results), StructField("_error", StringType())])
        done = kept(fresh.mapInArrow(handled, shape))
        done.where("_error is null").select("_made.*").write.mode("overwrite").parquet(f"{out}/batch={number}")
        failed = done.where("_error is not null").select(*batch.columns, F.lit("failed").alias("reason"), F.col("_error").alias("error"))
        old = stale.select("*", F.lit("stale").alias("reason"), F.lit(None).cast("string").alias("error"))
        failed.unionByName(old).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return consume


def _made(work: Callable[[list[dict]], list[tuple]], some: list[dict], retries: int) -> tuple[list[tuple], str | None]:
    for _ in range(retries + 1):
        try:
            done = list(work(some))
            if len(done) != len(some):
                raise ValueError(f"{len(done)} rows of {len(some)} records")
            return done, None
        except Exception as e:  # noqa: BLE001 what a record may do wrong isn't known here
            error = f"{type(e).__name__}: {str(e)[:500]}"
    return [], error
