"""Listings through a sorted copy against the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from stockwright.operators.listings import Listing, build_listing


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else r.choice(("a", "b", None)), r.randrange(300), i) for i in range(2000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    df = spark.createDataFrame(rows, "k string, n long, id long")
    listing = build_listing(df, ["k", "n", "id"], str(tmp_path_factory.mktemp("listing")))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    return rows, df, listing


@pytest.mark.parametrize("forward", (True, False))
def test_pages_follow_one_another(made, forward):
    rows, _, listing = made
    for key in ("hot", "a", "none"):
        want = sorted(((n, i) for k, n, i in rows if k == key), reverse=not forward)
        got, after = [], None
        while page := [(x.n, x.id) for x in listing.page([key], 333, after, forward).collect()]:
            got += page
            after = page[-1]
        assert got == want


def test_bounds_and_files(made):
    rows, _, listing = made
    want = sorted((n, i) for k, n, i in rows if k == "hot" and 40 <= n <= 55)
    page = listing.page(["hot"], 10_000, low=40, high=55)
    assert [(x.n, x.id) for x in page.collect()] == want
    some = listing.page(["a"], 10)
    files = lambda df: {x.f for x in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files(listing.rows)) >= 8
    # ranges of the key alone are listed by the scan
    kept = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in kept and "part#" in kept.split("PartitionFilters")[1]
    chosen = listing.ranges.where((F.col("low.k") <= "a") & (F.col("high.k") >= "a")).count()
    assert chosen <= 3 < listing.ranges.count()
    assert listing.ranges.where((F.col("low.k") <= "hot") & (F.col("high.k") >= "hot")).count() >= 5  # a hot key isn't one range


def test_faults(spark, made):
    rows, df, listing = made
    assert listing.faults(df, "id").collect() == []
    now = df.where("id <> 5").withColumn("k", F.when(F.col("id") == 7, None).otherwise(F.col("k"))).withColumn("n", F.when(F.col("id") == 8, 999).otherwise(F.col("n")))
    now = now.unionByName(spark.createDataFrame([("z", 1, 5000), (None, 1, 5001)], "k string, n long, id long"))
    listed = {i for k, _, i in rows if k is not None}
    want = {(5, "wrongly present"), (7, "wrongly present"), (8, "different"), (5000, "missing")}
    assert set(map(tuple, listing.faults(now, "id").collect())) == {w for w in want if w[0] in listed or w[0] == 5000}


def test_empty(spark, tmp_path):
    listing = build_listing(spark.createDataFrame([], "k string, id long"), ["k", "id"], str(tmp_path))
    assert listing.ranges.count() == 0 == listing.rows.count() and listing.page(["a"], 5).collect() == [] == listing.faults(listing.rows.drop("part"), "id").collect()
    again = spark.createDataFrame([("a", 1)], "k string, id long")
    build_listing(again, ["k", "id"], str(tmp_path))
    assert [r.id for r in Listing(spark, str(tmp_path), ["k", "id"]).page(["a"], 5).collect()] == [1]
