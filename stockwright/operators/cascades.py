"""Deletes that spread along a graph of references, level by level, and can be taken up again where they broke off."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.sources.tables import is_complete


@dataclass(frozen=True)
class Reference:
    """``column`` of ``child`` names a row of ``parent``. When that goes, the child's row goes too, or only the column is cleared."""

    child: str
    column: str
    parent: str
    clears: bool = False


@dataclass(frozen=True)
class Table:
    """Rows and the columns that name one; a table that others refer to has a single such column."""

    rows: DataFrame
    key: tuple[str, ...]

    def name(self) -> Column:
        return F.concat_ws("#", *[F.col(k).cast("string") for k in self.key])


class Cascade:
    """What goes with the rows of one table: found in levels, each a written table, after which every table is written anew.

    A level holds the names of rows that refer to a row of the level before, found by semi-joins with that level alone, each row in
    the first level that reaches it; so graphs with cycles end. Levels and tables that are complete in ``folder`` are
    read and not made again. Null references refer to nothing.
    """

    def __init__(self, tables: dict[str, Table], graph: Sequence[Reference], folder: str):
        self.tables, self.graph, self.folder = tables, list(graph), folder.rstrip("/")
        self.spark: SparkSession = next(iter(tables.values())).rows.sparkSession

    def _once(self, what: str, df: DataFrame) -> DataFrame:
        """df, written to the folder unless it is there completely."""
        path = f"{self.folder}/{what}"
        if not is_complete(self.spark, path):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def levels(self, root: str, gone: DataFrame) -> list[DataFrame]:
        """(table, name) of what goes, by level; gone has the names of the root's rows in its first column."""
        return self._walk(root, gone, self.graph, "level")

    def _walk(self, root: str, gone: DataFrame, graph: Sequence[Reference], what: str) -> list[DataFrame]:
        names = gone.select(F.lit(root).alias("table"), gone[gone.columns[0]].cast("string").alias("name")).where("name is not null").distinct()
        out = [self._once(f"{what}=0", names)]
        while True:
            found = []
            for r in graph:
                if not r.clears:
                    child, last = self.tables[r.child], out[-1].where(F.col("table") == r.parent).select(F.col("name").alias("_gone"))
                    hit = child.rows.join(last, F.col(r.column).cast("string") == F.col("_gone"), "left_semi")
                    found.append(hit.select(F.lit(r.child).alias("table"), child.name().alias("name")))
            reached = reduce(lambda a, b: a.unionByName(b), found).distinct() if found else out[0].limit(0)
            for earlier in out:
                reached = reached.join(earlier, ["table", "name"], "left_anti")
            level = self._once(f"{what}={len(out)}", reached)
            if level.isEmpty():
                return out
            out.append(level)

    def run(self, root: str, gone: DataFrame) -> dict[str, DataFrame]:
        """Every table without what goes and with its cleared columns, as written to the folder.

        Only of tables that others refer to is it listed what goes; rows of the others go with what they refer to, without a name.
        """
        listed = {root, *(r.parent for r in self.graph)}
        every = reduce(lambda a, b: a.unionByName(b), self._walk(root, gone, [r for r in self.graph if r.child in listed], "gone"))
        return {name: self._once(f"table={name}", self._left(name, t, every, name in listed)) for name, t in self.tables.items()}

    def _left(self, name: str, t: Table, every: DataFrame, listed: bool) -> DataFrame:
        of = lambda n: every.where(F.col("table") == n).select(F.col("name").alias("_gone"))
        rows = t.rows
        if listed:
            rows = rows.join(of(name), t.name() == F.col("_gone"), "left_anti")
        else:
            for r in self.graph:
                if r.child == name and not r.clears:
                    rows = rows.join(of(r.parent), F.col(r.column).cast("string") == F.col("_gone"), "left_anti")
        for r in self.graph:
            if r.clears and r.child == name:
                rows = rows.join(of(r.parent), F.col(r.column).cast("string") == F.col("_gone"), "left").withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).drop("_gone")
        return rows.select(*t.rows.columns)

    def report(self, after: dict[str, DataFrame], check: dict[str, Column] | None = None) -> DataFrame:
        """(name, before, left, cleared) of each table, cleared being references that became null; and ``sum``, of a column of ``check`` over what is left."""
        out = []
        for name, df in after.items():
            clears = [r.column for r in self.graph if r.clears and r.child == name]
            nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNotNull()) for c in clears], F.lit(0))
            own = (check or {}).get(name, F.lit(0))
            old = self.tables[name].rows
            # references that stood in rows that went don't count as cleared
            kept = old.withColumn("_name", self.tables[name].name()).join(df.select(self.tables[name].name().alias("_name")).distinct(), "_name", "left_semi") if clears else old.limit(0)
            a, b, c = old.agg(F.count("*").alias("before")), df.agg(F.count("*").alias("left"), nulls.alias("_still"), F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("sum")), kept.agg(nulls.alias("_were"))
            row = F.broadcast(a).join(F.broadcast(b)).join(F.broadcast(c))  # single rows
            out.append(row.select(F.lit(name).alias("name"), "before", "left", (F.col("_were") - F.col("_still")).cast("long").alias("cleared"), "sum"))
        return reduce(lambda x, y: x.unionByName(y), out)
