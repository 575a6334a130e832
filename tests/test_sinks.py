"""Dead letters of a stream, sitemap files read back, relational tables out and in."""

import datetime as dt
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from stockwright.sources import sitemaps as M
from stockwright.sources import tables
from stockwright.streaming import changes as S
from stockwright.streaming import letters
from stockwright.streaming.letters import bisecting

NOW = dt.datetime(2024, 1, 2)
SCHEMA = "id long, ts timestamp, price string"


def put(spark, path, ids, bad, old=()):
    rows = [(i, None if i in old else NOW, "x" if i in bad else str(i)) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(path)


def parse(rows, path):
    rows.select("id", F.col("price").cast("long").alias("price")).write.mode("overwrite").parquet(path)


def start(spark, source, folder, work):
    consume = bisecting(work, f"{folder}/out", f"{folder}/dead", ["id"], F.lit(NOW).cast("timestamp"))
    return S.run_consumer(S.change_stream(spark, source, SCHEMA, 10), consume, f"{folder}/checkpoint")


def results(spark, folder):
    out = sorted(map(tuple, spark.read.schema("id long, price long").parquet(f"{folder}/out").select("id", "price").collect()))
    dead = sorted((r.id, r.batch, r.reason, (r.error or "")[:14]) for r in spark.read.schema(f"{SCHEMA}, reason string, error string, batch int").option("basePath", f"{folder}/dead").parquet(f"{folder}/dead").collect())
    return out, dead


def test_bad_records_are_alone_in_the_end(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, source, range(40), {7, 8, 31}, {20})
    start(spark, source, folder, parse).awaitTermination()
    put(spark, source, range(40, 60), {59})
    start(spark, source, folder, parse).awaitTermination()
    out, dead = results(spark, folder)
    assert out == [(i, i) for i in range(60) if i not in {7, 8, 31, 20, 59}]
    assert [(i, b, r) for i, b, r, _ in dead] == [(7, 0, "failed"), (8, 0, "failed"), (20, 0, "stale"), (31, 0, "failed"), (59, 1, "failed")]
    assert all(e for _, _, r, e in dead if r == "failed")


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path, monkeypatch):
    """The consumer itself stops in the middle of a batch; after a restart the batch begins anew."""
    source, folder, seen, real = str(tmp_path / "in"), str(tmp_path / "run"), [], letters._error
    put(spark, source, range(30), {3, 22})

    def lost(*args):
        seen.append(1)
        if len(seen) == 6:
            raise RuntimeError("driver lost")
        return real(*args)

    monkeypatch.setattr(letters, "_error", lost)
    query = start(spark, source, folder, parse)
    with pytest.raises(Exception):  # noqa: B017, PT011
        query.awaitTermination()
    monkeypatch.setattr(letters, "_error", real)
    begun = sum(len(f) for _, _, f in os.walk(f"{folder}/out"))
    start(spark, source, folder, parse).awaitTermination()
    out, dead = results(spark, folder)
    assert begun > 0 and out == [(i, i) for i in range(30) if i not in {3, 22}] and [d[0] for d in dead] == [3, 22]


def test_single_records_are_tried_again(spark, tmp_path):
    tries = []

    def flaky(rows, path):
        tries.append(path)
        if len(tries) < 3:
            raise ValueError("not yet")
        parse(rows, path)

    folder = str(tmp_path)
    df = spark.createDataFrame([(1, NOW, "5")], SCHEMA)
    bisecting(flaky, f"{folder}/out", f"{folder}/dead", ["id"], F.lit(NOW).cast("timestamp"))(df, 4)
    assert len(tries) == 3 and results(spark, folder) == ([(1, 5)], [])
    bisecting(parse, f"{folder}/o2", f"{folder}/d2", ["id"], F.lit(NOW).cast("timestamp"))(df.limit(0), 5)
    assert not os.path.exists(f"{folder}/o2/batch=5")


def test_records_are_halved_in_their_tasks(spark, tmp_path, monkeypatch):
    """A batch with very many bad records is a fixed number of jobs, and its results are those of bisecting."""
    folder, bad = str(tmp_path), set(range(3, 20000, 7))
    put(spark, f"{folder}/in", range(20000), bad, {20})
    df = spark.read.schema(SCHEMA).parquet(f"{folder}/in")
    consume = letters.bisecting_records(lambda rs: [(r["id"], int(r["price"])) for r in rs], "id long, price long", f"{folder}/out", f"{folder}/dead", F.lit(NOW).cast("timestamp"))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    for _ in range(2):  # a batch that comes again is written once
        consume(df, 0)
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 20
    out, dead = results(spark, folder)
    assert out == [(i, i) for i in range(20000) if i not in bad | {20}]
    assert [(i, r) for i, _, r, _ in dead] == [(i, "stale" if i == 20 else "failed") for i in sorted(bad | {20})]
    small = df.where("id < 40")
    bisecting(parse, f"{folder}/o2/out", f"{folder}/o2/dead", ["id"], F.lit(NOW).cast("timestamp"))(small, 1)
    letters.bisecting_records(lambda rs: [(r["id"], int(r["price"])) for r in rs], "id long, price long", f"{folder}/o3/out", f"{folder}/o3/dead", F.lit(NOW).cast("timestamp"))(small, 1)
    (a, x), (b, y) = results(spark, f"{folder}/o2"), results(spark, f"{folder}/o3")
    assert a == b and [d[:3] for d in x] == [d[:3] for d in y]


def test_sitemap_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, NOW if i % 2 else None) for i in range(25)] + [(None, NOW)], "id long, at timestamp")
    kinds = [M.Kind("parts", rows, "id", "at", "/parts&x", "weekly", "0.7"), M.Kind("cars", rows.where("id < 0"), "id", "at", "/cars", "monthly", "0.6")]
    folder = str(tmp_path / "site")
    names = M.write_sitemap(spark, kinds, folder, "https://s.example", "https://api.example", NOW, 10)
    assert names == ["sitemap-static.xml", "sitemap-parts.xml", "sitemap-parts-2.xml", "sitemap-parts-3.xml", "sitemap-cars.xml"]
    files = {r.file: r.content for r in M.read_sitemap(spark, folder).collect()}
    assert sorted(files) == sorted([*names, "sitemap.xml"])
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    pages = [[u.findtext(f"{space}loc") for u in ET.fromstring(files[n]).findall(f"{space}url")] for n in names]  # noqa: S314
    assert [len(p) for p in pages] == [9, 10, 10, 5, 0]
    assert sum(pages[1:4], []) == [f"https://s.example/parts&x/{i}" for i in sorted(map(str, range(25)))]
    assert [u.findtext(f"{space}lastmod") for u in ET.fromstring(files[names[1]]).findall(f"{space}url")][:2] == [None, "2024-01-02T00:00:00+00:00"]  # noqa: S314
    assert [s.findtext(f"{space}loc") for s in ET.fromstring(files["sitemap.xml"])] == [f"https://api.example/sitemap-{x}" for x in ("static.xml", "parts.xml", "parts.xml?page=2", "parts.xml?page=3", "cars.xml")]  # noqa: S314
    M.write_sitemap(spark, kinds[:1], folder, "https://t.example", "https://api.example", NOW, 10)  # replaces what it writes
    assert "https://t.example/parts" in {r.file: r.content for r in M.read_sitemap(spark, folder).collect()}["sitemap-parts.xml"]


def test_relational_tables_come_back(spark):
    url = "jdbc:derby:memory:sinks;create=true"
    df = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, bytearray([i % 256, 0, 255]) if i % 5 else None, NOW, i / 4, i % 2 == 0) for i in range(300)], "id long, name string, data binary, at timestamp, x double, yes boolean")
    tables.to_relational(df, url, "things")
    back = tables.relational(spark, url, "things", "id", 0, 300, 5)
    assert back.rdd.getNumPartitions() == 5
    key = lambda r: (r.id, r.name, bytes(r.data) if r.data is not None else None, r.at, r.x, r.yes)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    some = back.where("x > 70 and name is not null").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,70.0)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert sorted(r.id for r in some.collect()) == [i for i in range(281, 300) if i % 3]
    with pytest.raises(Exception, match="(?i)exists"):
        tables.to_relational(df, url, "things")


def test_databases_come_back(spark):
    """Executors are several processes: each database is made and read by tasks alone."""
    df = spark.createDataFrame([(i if i else None, f"n{i}" if i % 3 else None, bytearray([i % 256, 0, 255]) if i % 5 else None, i / 4, i % 2 == 0) for i in range(300)], "id long, name string, data binary, x double, yes boolean")
    dbs = tables.to_databases(df, "id", "things", 50)
    assert dbs.count() == 6 and df.schema == tables.from_databases(dbs, "things", "id long, name string, data binary, x double, yes boolean").schema
    key = lambda r: repr((r.id, r.name, bytes(r.data) if r.data is not None else None, r.x, r.yes))
    assert sorted(map(key, tables.from_databases(dbs, "things", "id long, name string, data binary, x double, yes boolean").collect())) == sorted(map(key, df.collect()))
    some = tables.from_databases(dbs, "things", "id long", "x > 70 AND name IS NOT NULL", 250, 290)
    assert sorted(r.id for r in some.collect()) == [i for i in range(281, 300) if i % 3]
    assert tables.from_databases(tables.to_databases(df.limit(0), "id", "none"), "none", "id long").count() == 0
