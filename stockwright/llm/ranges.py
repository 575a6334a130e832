"""Places and running sums over rows in a total order, made range by range.

Rows are dealt into ranges of the order, and each task goes through its range once, counting from zero. What the ranges before it
add is one row a range, which the driver sums up and hands out again by broadcast. No key has to fit into a task: a key with many
rows lies in several ranges, and what it carries over a border is part of its range's row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwright.llm.common import written

#: A key with over 1 / SHARE of all rows is joined apart from the others; there are fewer than SHARE such keys.
SHARE = 1024


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def walked(df: DataFrame, deal: Sequence[str], order: Sequence[str], walk: Callable[[], Callable[[dict], dict]], out: str, kept: Sequence[str]) -> DataFrame:
    """The ``kept`` columns of df and those of ``out``, which ``walk`` makes of a range's rows in order; ``part`` numbers the ranges.

    walk() begins a range; what it returns takes the columns of a batch as lists and gives the new ones. Rows that are equal in ``deal``
    share a range.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step = TaskContext.get().partitionId(), walk()
        for batch in batches:
            made = step({n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            columns = [pa.array([part] * batch.num_rows, pa.int32()), *[batch.column(c) for c in kept], *[made[n] for n in names]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", *kept, *names])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(["part int", *[f"{c} {kinds[c]}" for c in kept], out])
    return written(df.repartitionByRange(ranges(df), *deal).sortWithinPartitions(*order).mapInArrow(work, schema))


def with_offsets(df: DataFrame, offsets: dict[int, tuple], schema: str, how: str = "inner") -> DataFrame:
    """df with what the driver found for each range; one row a range is broadcast."""
    table = df.sparkSession.createDataFrame([(p, *x) for p, x in offsets.items()], f"part int, {schema}")
    return df.join(F.broadcast(table), "part", how)


def places(df: DataFrame, key: str, order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The kept columns and ``place``, a row's number from 0 among those of its key."""

    def walk() -> Callable[[dict], dict]:
        last: list = [None, -1]

        def step(c: dict) -> dict:
            out = []
            for k in c[key].to_pylist():
                last[1] = last[1] + 1 if k == last[0] else 0
                last[0] = k
                out.append(last[1])
            return {"local": pa.array(out, pa.int64())}

        return step

    rows = walked(df, [key, *order], [key, *order], walk, "local long", [*dict.fromkeys([key, *kept])])
    ends = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, "local")).alias("last")).orderBy("part").collect()
    offsets, now = {}, (None, 0)
    for r in ends:  # only a range's first key can have begun in an earlier range
        carried = now[1] if now[0] == r["first"] else 0
        offsets[r["part"]] = (r["first"], carried)
        now = (r["last"][key], r["last"]["local"] + 1 + (carried if r["last"][key] == r["first"] else 0))
    kind = df.schema[key].dataType.simpleString()
    placed = with_offsets(rows, offsets, f"_first {kind}, _carried long")
    return placed.select(*[*dict.fromkeys([key, *kept])], (F.col("local") + F.when(F.col(key) == F.col("_first"), F.col("_carried")).otherwise(0)).alias("place"))


def dense_ranks(df: DataFrame, key: str, ties: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The kept columns and ``rank``, from 0, by binary ``key``; equal keys, which ties spread over ranges, have one rank."""

    def walk() -> Callable[[dict], dict]:
        last: list = [None, -1]

        def step(c: dict) -> dict:
            out = []
            for k in c[key].to_pylist():
                if last[1] < 0 or k != last[0]:
                    last[0], last[1] = k, last[1] + 1
                out.append(last[1])
            return {"local": pa.array(out, pa.int64())}

        return step

    rows = walked(df, [key, *ties], [key, *ties], walk, "local long", [key, *kept])
    ends = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("local").alias("most")).orderBy("part").collect()
    offsets, at, before = {}, 0, None
    for r in ends:
        at -= before is not None and r["first"] == before
        offsets[r["part"]] = (at,)
        at, before = at + r["most"] + 1, r["last"]
    return with_offsets(rows, offsets, "_before long").select(*kept, (F.col("local") + F.col("_before")).alias("rank"))


def running_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """df with ``upto_x`` for each numeric column x of sums: its sum over all rows up to this one, itself included."""

    def walk() -> Callable[[dict], dict]:
        total = dict.fromkeys(sums, 0)

        def step(c: dict) -> dict:
            made = {}
            for x in sums:
                out = []
                for v in c[x].to_pylist():
                    total[x] += v
                    out.append(total[x])
                made[f"upto_{x}"] = pa.array(out, pa.int64())
            return made

        return step

    rows = walked(df, order, order, walk, ", ".join(f"upto_{x} long" for x in sums), df.columns)
    ends = rows.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums]).orderBy("part").collect()
    offsets, at = {}, [0] * len(sums)
    for r in ends:
        offsets[r["part"]] = tuple(at)
        at = [a + r[x] for a, x in zip(at, sums, strict=True)]
    placed = with_offsets(rows, offsets, ", ".join(f"_{x} long" for x in sums))
    return placed.select(*df.columns, *[(F.col(f"upto_{x}") + F.col(f"_{x}")).alias(f"upto_{x}") for x in sums])


def matched(rows: DataFrame, info: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with the columns of info, which has one row for each key; rows without one go.

    Keys with over 1 / SHARE of the rows are looked up by broadcast, and so are not dealt to one task; rows are read three times,
    so they should be a written table.
    """
    n = rows.count()
    hot = F.broadcast(rows.groupBy(*key).count().where(F.col("count") * SHARE > n).drop("count"))
    apart = rows.join(F.broadcast(info.join(hot, [*key], "left_semi")), [*key])
    return apart.unionByName(rows.join(hot, [*key], "left_anti").join(info, [*key]))


def packed(rows: DataFrame, key: Sequence[str], value: str, most: int = 4096) -> DataFrame:
    """(key, first, items): the values of each key in order, comma-joined, in packs of at most ``most`` that never mix keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in key], strict=True))
            out = []
            for k, v in zip(keys, batch.column(value).to_pylist(), strict=True):
                if held and (k != now or len(held) == most):
                    out.append((now, held))
                    held = []
                now = k
                held.append(v)
            yield from made(out)
        yield from made([(now, held)] if held else [])

    def made(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            columns = [pa.array([k[i] for k, _ in out], kinds[i]) for i in range(len(key))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for _, v in out]), pa.array([",".join(map(str, v)) for _, v in out])], names=[*key, "first", "items"])

    types = [rows.schema[k].dataType.simpleString() for k in key]
    kinds = [{"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}[t] for t in types]
    schema = ", ".join([*[f"{k} {t}" for k, t in zip(key, types, strict=True)], "first long, items string"])
    dealt = rows.select(*key, value).repartitionByRange(ranges(rows), *key, value).sortWithinPartitions(*key, value)
    return dealt.mapInArrow(work, schema)


def flag(condition: Column) -> Column:
    return condition.cast("long")
