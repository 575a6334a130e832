"""The catalogue's tables as views over the star-schema Parquet files, and readers of the other formats."""

from __future__ import annotations

import re
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing
from functools import cached_property
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stockwright.functions.text import slug


def cents(amount) -> F.Column:  # noqa: ANN001
    return F.round(amount * 100).cast("long")


#: Rows of a large table that a task is dealt.
DEALT = 1 << 18
#: Folders that scratch() gave out, by application.
SCRATCH: dict[str, list[str]] = {}


class Catalogue:
    """Views by name; each is a lazy plan, so that filters and columns reach the files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tasks(self, name: str) -> int | None:
        """How many tasks take the rows of a raw table, DEALT each; None where Spark deals them to as many anyway."""
        n = ceil(self.raw(name).count() / DEALT)
        return n if n > self.spark.sparkContext.defaultParallelism else None

    def dealt(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df, of about as many rows as a raw table, dealt by columns, so that no task's share grows with the table."""
        n = self.tasks(name)
        return df.repartition(n, *by) if n else df.repartition(*by)

    @cached_property
    def parts(self) -> DataFrame:
        """A part whose brand and name occur under a smaller id is a duplicate of that canonical part."""
        first = F.min("p_partkey").over(Window.partitionBy("p_brand", "p_name"))
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"),
            cents(F.col("p_retailprice")).alias("price_cents"), F.col("p_size").alias("size"), F.when(first < F.col("p_partkey"), first).alias("canonical_part_id"),
        )

    @cached_property
    def retailers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("retailer_id"), F.col("s_name").alias("retailer_name"), F.col("s_nationkey").alias("model_id"))

    @cached_property
    def history(self) -> DataFrame:
        """One observation for each part, retailer and day: the lowest price of the day.

        Dealt by part, which serves this grouping and those by part and by listing that follow it: one shuffle for all. Its number of tasks
        follows the rows, as partitions that are merged to the number of cores would grow with them.
        """
        price = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        seen = self.raw("lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("retailer_id"), F.col("l_shipdate").alias("observed_at"), price.alias("price_cents"))
        return self.dealt(seen, "lineitem", "part_id").groupBy("part_id", "retailer_id", "observed_at").agg(F.min("price_cents").alias("price_cents"))

    @cached_property
    def listings(self) -> DataFrame:
        """The current price of each part at each retailer."""
        last = F.max(F.struct("observed_at", "price_cents"))
        return self.history.groupBy("part_id", "retailer_id").agg(last.alias("x")).select("part_id", "retailer_id", F.col("x.price_cents").alias("price_cents"), F.col("x.observed_at").alias("updated_at"))

    @cached_property
    def builds(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("build_id"), F.col("o_custkey").alias("user_id"), cents(F.col("o_totalprice")).alias("base_cents"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("build_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("phase"), F.col("l_quantity").cast("long").alias("quantity"),
            (F.col("l_linestatus") == "F").alias("purchased"),
        )

    @cached_property
    def labour(self) -> DataFrame:
        cost = F.round(F.col("l_tax") * F.col("l_extendedprice") * 100).cast("long")
        return self.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("build_id"), cost.alias("cost_cents"))

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("model_id"), F.col("c_mktsegment").alias("segment"), cents(F.col("c_acctbal")).alias("balance_cents"))

    @cached_property
    def ballots(self) -> DataFrame:
        """Every cast of a vote; a user's later one replaces the earlier."""
        kind = F.when(F.col("event_type").isin("purchase", "click"), "upvote").when(F.col("event_type") == "error", "downvote").otherwise("other")
        return self.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("entity_id"), "user_id", kind.alias("vote_type"), F.col("ts").alias("created_at"))

    @cached_property
    def alerts(self) -> DataFrame:
        """A user who bought a part watches it from its retail price down."""
        return self.alerts_for(None)

    def alerts_for(self, wanted: DataFrame | None) -> DataFrame:
        """Alerts for the parts (part_id) of a table, which narrow the lines before these meet their orders; for all without one."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey")
        if wanted is not None:
            lines = lines.join(wanted.select("part_id"), F.col("l_partkey") == F.col("part_id"), "left_semi")
        own = self.raw("orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        own = own.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("part_id")).distinct()
        return own.join(self.parts.select(F.col("id").alias("part_id"), F.col("price_cents").alias("threshold_cents")), "part_id")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in the checkpoint folder, or, where none is set and Spark runs locally, a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{shared}/{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="scratch-")
    SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as a table, so that a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    """A path and its file system, wherever that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def rename_single_files(spark: SparkSession, folders: dict[str, str]) -> None:
    """Moves the one data file of each folder to a path; what is there already is replaced."""
    for folder, path in folders.items():
        at, files = _path(spark, folder)
        found = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("part-")]
        if len(found) != 1:
            raise ValueError(f"{len(found)} files in {folder}")
        to, _ = _path(spark, path)
        files.delete(to, False)
        files.mkdirs(to.getParent())
        if not files.rename(found[0], to):
            raise OSError(f"can't move {found[0]} to {path}")


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this application wrote to scratch folders, once its results are used; how many folders they were."""
    paths = SCRATCH.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        drop_path(spark, p)
    return len(paths)


def json_seed(spark: SparkSession, path: str) -> DataFrame:
    """(make, model, generation, start_year, end_year, description, slug) of nested seed files, one object for each make.

    A make in two files fails. The description may be missing; a slug that is missing is made of the three names.
    """
    kind = "make string, models array<struct<name:string,generations:array<struct<name:string,start_year:int,end_year:int,description:string,slug:string>>>>"
    makes = spark.read.schema(kind).option("multiLine", True).json(path)
    twice = makes.groupBy("make").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"makes in more than one file: {sorted(r.make for r in twice)}")
    models = makes.select("make", F.explode("models").alias("m"))
    flat = models.select("make", F.col("m.name").alias("model"), F.explode("m.generations").alias("g"))
    own = F.coalesce("g.slug", slug(F.concat_ws(" ", "make", "model", "g.name")))
    return flat.select("make", "model", F.col("g.name").alias("generation"), "g.start_year", "g.end_year", "g.description", own.alias("slug"))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Load-test statistics from CSV with a header; N/A and empty cells are null."""
    return spark.read.csv(path, header=True, nullValue="N/A", emptyValue="", inferSchema=False)


def number_in(column: str) -> F.Column:
    """A numeric cell of load_stats; one without a number fails."""
    value = F.col(f"`{column}`").try_cast("double")
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"no number in {column}: "), F.coalesce(F.col(f"`{column}`"), F.lit("N/A")))).cast("double"))


def utc_micros(at: str) -> F.Column:
    """Microseconds since 1970 of a time without zone, which is UTC whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({at} as timestamp_ntz))")


def relational(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of a numeric key; filters and columns are the database's work."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def to_relational(df: DataFrame, url: str, name: str, types: str | None = None, **options: str) -> None:
    """Writes a new table of a relational database, each task its own rows; types are the database's, for columns that need others."""
    if types:
        options["createTableColumnTypes"] = types
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("errorifexists").save()


#: Rows of a table that one embedded database holds.
SHARD = 1 << 16


def to_databases(df: DataFrame, key: str, name: str, rows: int = SHARD) -> DataFrame:
    """(low, high, database): a table of numbers, texts, bytes and booleans in embedded relational databases, each of a range of a numeric key.

    An embedded database lives in one process, while executors are several: so every task makes its own, as bytes that Spark keeps where all
    can read them. low and high are null where no row of a database has a key.
    """
    parts = max(1, ceil(df.count() / rows))
    kinds = {"string": "TEXT", "binary": "BLOB", "double": "REAL", "float": "REAL"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint", "boolean"), "INTEGER")
    columns = ", ".join(f'"{n}" {kinds[t]}' for n, t in df.dtypes)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(sqlite3.connect(":memory:")) as db:
            db.execute(f'CREATE TABLE "{name}" ({columns})')
            for b in batches:
                db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * b.num_columns)})', zip(*[c.to_pylist() for c in b.columns], strict=True))
            db.execute(f'CREATE INDEX "{name}_key" ON "{name}" ("{key}")')
            db.commit()
            low, high, n = db.execute(f'SELECT min("{key}"), max("{key}"), count(*) FROM "{name}"').fetchone()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([db.serialize()], pa.binary())], names=["low", "high", "database"])

    return kept(df.repartitionByRange(parts, key).mapInArrow(store, "low long, high long, database binary"))


def from_databases(databases: DataFrame, name: str, columns: str, where: str = "1", low: int | None = None, high: int | None = None) -> DataFrame:
    """Columns (a schema) of the rows of a table in databases for which ``where``, in the databases' SQL, holds: filters and columns are their work.

    With bounds of the key only databases with keys from low to below high are opened.
    """
    some = databases
    if low is not None:
        some = some.where(F.col("high") >= low)
    if high is not None:
        some = some.where(F.col("low") < high)
    wanted = databases.sparkSession.createDataFrame([], columns).schema
    shape = to_arrow_schema(wanted)
    sql = f'SELECT {", ".join(chr(34) + n + chr(34) for n in wanted.names)} FROM "{name}" WHERE {where}'

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(raw.as_py())
                    found = list(zip(*db.execute(sql).fetchall(), strict=True)) or [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()).cast(f.type) if pa.types.is_boolean(f.type) else pa.array(v, f.type) for v, f in zip(found, shape, strict=True)], schema=shape)

    return some.select("database").mapInArrow(read, wanted)
