"""Cascades against a plain walk; broken off and taken up again; run a second time."""

import os

import pytest
from pyspark.sql import functions as F

from stockwright.operators import cascades as C

GRAPH = [
    C.Reference("lists", "user", "users"), C.Reference("lines", "list", "lists"), C.Reference("lines", "added_by", "users"), C.Reference("lines", "part", "parts"), C.Reference("parts", "owner", "users"),
    C.Reference("parts", "canonical", "parts", clears=True), C.Reference("posts", "parent", "posts"), C.Reference("posts", "user", "users"),
]
ROWS = {
    "users": ("id long, text string", [(1, "a"), (2, "b"), (3, "c")]), "lists": ("id long, user long", [(10, 1), (11, 2), (12, None)]),
    "parts": ("id long, owner long, canonical long", [(20, 1, None), (21, 2, 20), (22, 2, 20), (23, 3, None), (24, None, 23)]),
    "lines": ("list long, n int, part long, added_by long", [(10, 1, 23, 2), (11, 1, 20, 2), (11, 2, 21, 1), (11, 3, 21, 3), (12, 1, None, None), (12, 2, 24, 2)]),
    "posts": ("id long, parent long, user long", [(1, None, 1), (2, 1, 2), (3, 2, 3), (4, None, 2), (5, 6, 3), (6, 5, 1)]),
}
KEYS = {"lines": ("list", "n")}
LEFT = {
    "users": [(2, "b"), (3, "c")], "lists": [(11, 2), (12, None)], "parts": [(21, 2, None), (22, 2, None), (23, 3, None), (24, None, 23)],
    "lines": [(11, 3, 21, 3), (12, 1, None, None), (12, 2, 24, 2)], "posts": [(4, None, 2)],
}


def made(spark, rows=ROWS):
    return {n: C.Table(spark.createDataFrame(r, s), KEYS.get(n, ("id",))) for n, (s, r) in rows.items()}


def content(after):
    return {n: sorted(map(tuple, df.collect()), key=repr) for n, df in after.items()}


def gone(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_levels_lead_through_all_tables(spark, tmp_path):
    c = C.Cascade(made(spark), GRAPH, str(tmp_path / "run"))
    after = c.run("users", gone(spark, 1, 1, 99, None))
    assert content(after) == {n: sorted(r, key=repr) for n, r in LEFT.items()}
    got = {r.name: (r.before, r.left, r.cleared, r["sum"]) for r in c.report(after, {"users": F.col("id")}).collect()}
    assert got == {"users": (3, 2, 0, 5), "lists": (3, 2, 0, 0), "parts": (5, 4, 2, 0), "lines": (6, 3, 0, 0), "posts": (6, 1, 0, 0)}
    levels = [sorted(map(tuple, x.collect())) for x in c.levels("users", gone(spark, 1))]
    assert levels[1] == [("lines", "11#2"), ("lists", "10"), ("parts", "20"), ("posts", "1"), ("posts", "6")] and levels[2] == [("lines", "10#1"), ("lines", "11#1"), ("posts", "2"), ("posts", "5")] and levels[3] == [("posts", "3")]


def test_a_second_run_changes_nothing(spark, tmp_path):
    first = C.Cascade(made(spark), GRAPH, str(tmp_path / "a")).run("users", gone(spark, 1))
    again = C.Cascade({n: C.Table(df, KEYS.get(n, ("id",))) for n, df in first.items()}, GRAPH, str(tmp_path / "b"))
    after = again.run("users", gone(spark, 1))
    assert content(after) == content(first)
    assert {(r.before - r.left, r.cleared) for r in again.report(after).collect()} == {(0, 0)}


@pytest.mark.parametrize("broken", ("posts", "lines"))
def test_a_broken_run_is_taken_up_again(spark, tmp_path, broken):
    """One table can't be read once the walk is under way; what was finished before isn't made again."""
    tables, folder = made(spark), str(tmp_path / "run")
    stop = F.raise_error(F.lit("lost")).cast("boolean")
    key, at = ("user", 2) if broken == "posts" else ("list", 10)
    bad = tables[broken].rows.where(F.when(F.col(key) == at, stop).otherwise(True))
    # the first level is found with whole tables, the rest with the broken one
    C.Cascade(tables, [r for r in GRAPH if not r.clears], folder)._once("level=0", gone(spark, 1).select(F.lit("users").alias("table"), F.col("id").cast("string").alias("name")))
    with pytest.raises(Exception, match="lost"):
        C.Cascade(tables | {broken: C.Table(bad, tables[broken].key)}, GRAPH, folder).run("users", gone(spark, 1))
    begun = {d: os.stat(f"{folder}/{d}/_SUCCESS").st_mtime_ns for d in os.listdir(folder) if os.path.exists(f"{folder}/{d}/_SUCCESS")}
    assert "level=0" in begun
    after = C.Cascade(tables, GRAPH, folder).run("users", gone(spark, 1))
    assert content(after) == {n: sorted(r, key=repr) for n, r in LEFT.items()}
    assert all(os.stat(f"{folder}/{d}/_SUCCESS").st_mtime_ns == t for d, t in begun.items())


def test_nothing_gone_and_empty_tables(spark, tmp_path):
    c = C.Cascade(made(spark), GRAPH, str(tmp_path / "a"))
    assert content(c.run("users", gone(spark))) == {n: sorted(r, key=repr) for n, (_, r) in ROWS.items()}
    empty = {n: (s, []) for n, (s, _) in ROWS.items()}
    assert set(map(len, content(C.Cascade(made(spark, empty), GRAPH, str(tmp_path / "b")).run("users", gone(spark, 1))).values())) == {0}


def test_rows_that_nothing_refers_to_are_not_listed(spark, tmp_path):
    """Lines are most of the rows; they go with what they refer to, and no list of their names is written on the way."""
    c = C.Cascade(made(spark), GRAPH, str(tmp_path / "run"))
    after = c.run("users", gone(spark, 1))
    assert content(after)["lines"] == sorted(LEFT["lines"], key=repr)
    listed = {r.table for d in os.listdir(tmp_path / "run") if not d.startswith("table=") for r in spark.read.parquet(f"{tmp_path}/run/{d}").select("table").distinct().collect()}
    assert listed == {"users", "lists", "parts", "posts"}
