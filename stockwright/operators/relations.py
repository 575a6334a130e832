"""Lookups, hydration joins, set differences and rewrites that stand for mutations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwright.functions.predicates import is_file_key


def batch_get(df: DataFrame, keys: Sequence, key: str) -> DataFrame:
    """Rows with any of a bounded list of keys; missing keys are left out. The list becomes a filter that reaches the files."""
    return df.where(F.col(key).isin(*dict.fromkeys(keys)))


def get_or_raise(df: DataFrame, keys: Sequence, key: str) -> DataFrame:
    """Rows with any of a bounded list of keys; a key without a row is an error, once rows are read."""
    wanted = df.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"{key} {df.schema[key].dataType.simpleString()}")
    found = F.broadcast(wanted).join(batch_get(df, keys, key).withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no row with key "), F.col(key).cast("string"))).cast("boolean")
    return found.where(F.coalesce("_found", missing)).select(*df.columns)


def by_ids_in_order(df: DataFrame, ids: Sequence, key: str) -> DataFrame:
    """Rows in the order in which their ids are asked for, each once, with that place."""
    wanted = list(dict.fromkeys(ids))
    return df.where(F.col(key).isin(*wanted)).withColumn("place", (F.array_position(F.lit(wanted), F.col(key)) - 1).cast("long")).orderBy("place")


def with_children(parents: DataFrame, children: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """Parents with the sorted list of their children's items; an empty list where there are none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def hydrate(facts: DataFrame, models: DataFrame, makes: DataFrame) -> DataFrame:
    """Facts with model and make names, '' where they are missing, and a display name that is null then."""
    df = facts.join(models, "model_id", "left").join(makes, "make_id", "left")
    display = F.when(F.col("model_name").isNotNull() & F.col("make_name").isNotNull(), F.concat_ws(" ", "make_name", "model_name"))
    return df.select(*facts.columns, F.coalesce("model_name", F.lit("")).alias("model_name"), F.coalesce("make_name", F.lit("")).alias("make_name"), display.alias("display_name"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reconcile(source: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, action): insert what is missing, update what differs in a field, keep the rest; extra stored rows are left."""
    s, t = source.select(key, *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(1).alias("in_s")), stored.select(key, *[F.col(f).alias(f"t_{f}") for f in fields], F.lit(1).alias("in_t"))
    differs = reduce(or_, [~F.col(f"s_{f}").eqNullSafe(F.col(f"t_{f}")) for f in fields])
    action = F.when(F.col("in_t").isNull(), "insert").when(F.col("in_s").isNull(), "leave").when(differs, "update").otherwise("keep")
    return s.join(t, key, "full_outer").select(key, action.alias("action"))


def changed_links(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The links to add and to remove, to get from one set to another."""
    keys = list(keys)
    return after.join(before, keys, "left_anti").select(*keys, F.lit("link").alias("action")).unionByName(before.join(after, keys, "left_anti").select(*keys, F.lit("unlink").alias("action")))


def collisions(df: DataFrame, keys: Sequence[Column | str], owner: str) -> DataFrame:
    """Keys with more than one owner, with the number of owners and the least and greatest of them."""
    return df.groupBy(*keys).agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner")).where("owners > 1")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows, replaced by new ones of the same key. Write the result to another place than it is read from."""
    return stored.join(new, list(keys), "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.join(stored, list(keys), "left_anti"))


def patched(stored: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], clear: str = "clear") -> DataFrame:
    """Stored rows with the given fields of changes; a field named in the array ``clear`` becomes null, other nulls change nothing."""
    c = changes.select(F.col(key), *[F.col(f).alias(f"new_{f}") for f in fields], F.col(clear).alias("_clear"))
    df = stored.join(c, key, "left")
    value = lambda f: F.when(F.coalesce(F.array_contains("_clear", f), F.lit(False)), None).otherwise(F.coalesce(f"new_{f}", f)).alias(f)
    return df.select(*[value(f) if f in fields else F.col(f) for f in stored.columns])


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows that refer to a deleted key; tables: name -> (rows, referring column)."""
    return {name: df.join(gone.select(F.col(key).alias("_gone")), F.col(ref) == F.col("_gone"), "left_anti") for name, (df, ref) in tables.items()}


def set_null(df: DataFrame, ref: str, gone: DataFrame, key: str) -> DataFrame:
    marked = df.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(ref) == F.col("_gone"), "left")
    return marked.withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone").select(*df.columns)


def in_use(df: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """Rows that something refers to and that can't be deleted."""
    return df.join(references.select(F.col(ref).alias("_ref")), F.col(key) == F.col("_ref"), "left_semi")


def claims(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, value, owner, action): what becomes of the unique values of owners that are created, changed or deleted.

    stored (label, value, owner) are the values held, before and after those of the owners of a batch: none before for a new
    owner, none after for a deleted one. A new value that another owner holds, or that an owner of lesser id claims in the
    same batch, is ``taken``; then the owner's other changes are ``refused``. All else is ``claim`` or ``release``.
    """
    pair, own = ["label", "value"], ["label", "value", "owner"]
    wanted = after.select(*own).distinct().join(before, own, "left_anti")
    held = stored.select(*pair, F.col("owner").alias("holder"))
    first = wanted.groupBy(*pair).agg(F.min("owner").alias("first"))
    wanted = wanted.join(first, pair).join(held, pair, "left").select(*own, (F.coalesce(F.col("holder") != F.col("owner"), F.lit(False)) | (F.col("owner") != F.col("first"))).alias("taken"))
    dropped = before.select(*own).distinct().join(after, own, "left_anti")
    all_of = wanted.withColumn("action", F.lit("claim")).unionByName(dropped.withColumns({"taken": F.lit(False), "action": F.lit("release")}))
    failed = wanted.where("taken").select("owner").distinct().withColumn("failed", F.lit(True))
    action = F.when(F.col("taken"), "taken").when(F.col("failed"), "refused").otherwise(F.col("action"))
    return all_of.join(failed, "owner", "left").select(*own, action.alias("action"))


def purged(parts: DataFrame, owned: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """``parts`` with tombstones on the gone ones and without links to them, and each owned table without their rows."""
    marks = gone.select(F.col(key).alias("_gone")).distinct()
    df = parts.join(marks, F.col(key) == F.col("_gone"), "left").withColumn("deleted", F.col("_gone").isNotNull()).drop("_gone")
    df = df.join(marks, F.col("canonical_part_id") == F.col("_gone"), "left")
    df = df.withColumn("canonical_part_id", F.when(F.col("_gone").isNull(), F.col("canonical_part_id"))).drop("_gone")
    return {"parts": df} | cascade(owned, gone, key)


def emptied(df: DataFrame, ref: str) -> DataFrame:
    """df without what it refers to: the way in which a whole table that it refers to can go."""
    return df.withColumn(ref, F.lit(None).cast(df.schema[ref].dataType))


def first_owners(df: DataFrame, keys: Sequence[str], owner: str, most: int = 10) -> DataFrame:
    """Keys with more than one owner, their number and the ``most`` least of them in order."""
    own = df.select(*keys, owner).distinct()
    w = Window.partitionBy(*keys).orderBy(owner)
    ranked = own.withColumn("_n", F.row_number().over(w))
    listed = F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col(owner))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("owners"), listed.alias("first_owners")).where("owners > 1")


def referenced_keys(sources: Sequence[DataFrame], name: str) -> DataFrame:
    """The distinct file keys in the lists of several tables; addresses, blanks and nulls in them are none."""
    lists = reduce(lambda a, b: a.unionByName(b), [s.select(name) for s in sources])
    return lists.select(F.explode(name).alias(name)).where(is_file_key(F.col(name))).distinct()


def index_faults(rows: DataFrame, key: str, due: Column, stored: Column) -> DataFrame:
    """(key, fault) of rows whose derived attribute isn't what it should be, null if it shouldn't be: missing, wrongly present, differs."""
    fault = F.when(due.isNotNull() & stored.isNull(), "missing").when(due.isNull() & stored.isNotNull(), "wrongly present").when(due != stored, "differs")
    return rows.select(key, fault.alias("fault")).where("fault is not null")
