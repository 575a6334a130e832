"""Claims, identity, limits, charts, ingestion, urls and descriptions on small tables with nulls and ties."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stockwright.functions import html as H
from stockwright.functions import ordering as O
from stockwright.functions import text as T
from stockwright.operators import analysis as A
from stockwright.operators import prices as P
from stockwright.operators import relations as L
from stockwright.sources import tables
from stockwright.streaming import changes as S

DAY = lambda *a: dt.datetime(*a)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://A.Example/?UTM_Source=x&b=1&a=2&b=3#f", "http://a.example?b=1&b=3&a=2"),
        ("//a.example/p?gclsrc=1", "https://a.example/p"), ("http://a.example/p?q=a+b%26&e=", "http://a.example/p?q=a+b%26&e="),
        ("http://a.example/p?x=%zz&&y", "http://a.example/p?x=%25zz&y="), ("http://a.example/p?x=~*", "http://a.example/p?x=~%2A"), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("url", "plain", "large"),
    [
        ("http://WWW.x.org/a.jpg?width=5&v=1", "https://x.org/a.jpg?v=1", "https://www.x.org/a.jpg?v=1&width=5760"),
        ("https://x.org?Q=1&v=", "https://x.org/", "https://x.org/?v=&width=5760"), ("a/b.jpg?w=1", "a/b.jpg?w=1", "a/b.jpg?w=1"), ("", "", ""), (None, None, None),
    ],
)
def test_image_url(spark, url, plain, large):
    assert (one(spark, T.image_url(F.col("u")), u=url), one(spark, T.image_url(F.col("u"), T.LARGE_WIDTH), u=url)) == (plain, large)


def test_descriptions():
    assert [H.text_of(x) for x in (None, "  ", "a &amp;\n b", "<b>a</b><style>x</style> b", "x" * 3000, "<p></p>")] == [None, None, "a & b", "a b", "x" * 2000, None]


def test_keywords_and_what_they_are_said_of(spark):
    kw = [("wheels", 0, "wheel"), ("interior", 1, "steering wheel"), ("air", 2, "k&n filter"), ("air", 2, "v_8")]
    items = [(1, "wheel", ""), (2, "steering wheel", ""), (3, "wheel", "for a steering wheel"), (4, "K&N Filter!", None), (5, "k n filter", ""), (6, "x", "a v_8 v_8 engine"), (7, "wheels", ""), (8, None, None)]
    got = A.classify(spark.createDataFrame(items, "id long, t string, b string"), kw, "id", "t", "b")
    assert {r.id: r.category for r in got.collect()} == {1: "wheels", 2: "interior", 3: "interior", 4: "air", 5: "other", 6: "air", 7: "other", 8: None}
    # more keywords than are broadcast give the same
    table = spark.createDataFrame(kw, "category string, place int, keyword string")
    again = A.classify(spark.createDataFrame(items, "id long, t string, b string"), table, "id", "t", "b", most_keywords=1)
    assert rows(again) == rows(got)


def test_claims(spark):
    kind = "label string, value string, owner long"
    make = lambda r: spark.createDataFrame(r, kind)
    held = make([("n", "a", 1), ("n", "b", 2), ("s", "x", 2)])
    before = make([("n", "a", 1), ("n", "b", 2), ("s", "x", 2)])
    after = make([("n", "c", 1), ("n", "a", 2), ("s", "y", 2), ("n", "c", 3), ("n", "d", 4), ("n", "d", 4)])
    assert rows(L.claims(held, before, after)) == sorted(
        [("n", "c", 1, "claim"), ("n", "a", 1, "release"), ("n", "a", 2, "taken"), ("n", "b", 2, "refused"), ("s", "x", 2, "refused"), ("s", "y", 2, "refused"), ("n", "c", 3, "taken"), ("n", "d", 4, "claim")], key=repr
    )
    none = make([])
    assert rows(L.claims(none, none, none)) == []


def test_retailers(spark):
    stored = spark.createDataFrame([(1, "A", "a.com"), (2, "B", None), (3, "C", "www.c.com"), (4, "a", None)], "retailer_id long, name string, domain string")
    asked = [(1, "x", "WWW.a.com"), (2, "b", "b.com"), (3, "B", None), (4, "x", "c.com"), (5, "new", "n.com"), (6, "A", "other.com"), (7, None, None), (8, "c", " ")]
    got = A.retailer_of(spark.createDataFrame(asked, "candidate_id long, name string, domain string"), stored)
    assert rows(got) == [(1, 1, "found"), (2, 2, "backfilled"), (3, 2, "found"), (4, 3, "found"), (5, None, "created"), (6, 1, "found"), (7, None, "created"), (8, 3, "found")]


def test_gtin_and_conflicts(spark):
    parts = spark.createDataFrame([(5, "1-2", None), (7, "12", None), (8, "12", None), (1, "12", 7), (9, None, None), (3, "--", None)], "id long, gtin string, canonical_part_id long")
    asked = spark.createDataFrame([(1, "EAN 12"), (2, "99"), (3, None), (4, "")], "candidate_id long, gtin string")
    assert rows(A.by_gtin(asked, parts)) == [(1, 7), (2, None), (3, None), (4, None)]
    known = spark.createDataFrame([(1, "g", "m", "n"), (2, "g", "m", "n"), (3, None, "m", "n"), (4, None, None, None), (5, None, None, None)], "id long, gtin string, manufacturer string, number string")
    assert rows(A.identifier_conflicts(known, known)) == [(1, "gtin", 2), (2, "gtin", 1), (3, "manufacturer_part_number", 1)]


def test_limit_classes(spark):
    cases = [("GET", "/api/auth/login", "get"), ("POST", "/api/auth/login", "auth"), ("POST", "/api/auth/refresh", "default"), ("POST", "/api/auth/refresh/", "default"), ("PUT", "/api/admin/users", "admin"), ("POST", "/api/authors", "default"), ("options", "/api/parts", None), ("GET", "/", None), ("GET", "/health", None), ("GET", "/docs/x", None), ("GET", "/docsx", "get")]
    q = spark.createDataFrame([(str(i), m, p) for i, (m, p, _) in enumerate(cases)], "client string, method string, path string")
    got = {r.client: (r["class"], r.most) for r in S.limited_requests(q).collect()}
    most = {"get": 200, "auth": 10, "admin": 30, "default": 60}
    assert got == {str(i): (c, most[c]) for i, (_, _, c) in enumerate(cases) if c}


def test_places_of_a_busy_key(spark):
    r, t = random.Random(3), DAY(2026, 1, 1)
    times = sorted(r.uniform(0, 4000) for _ in range(300))
    got = S.rate_limited(spark.createDataFrame([("k", t + dt.timedelta(seconds=x), i, 5) for i, x in enumerate(times)], "key string, ts timestamp, request_id long, most long")).orderBy("request_id").collect()
    want, start, n = [], -math.inf, 0
    for x in times:
        if x - start >= 60:
            start, n = x, 0
        n += 1
        want.append(n)
    assert [x.place for x in got] == want


def test_failed_sequences(spark):
    got = S.failed_sequences(spark.createDataFrame([("1", "a", True), ("2", "a", False), ("3", "b", True), ("4", None, None), ("5", None, True)], "sequence_number string, k string, ok boolean"), "k", F.col("ok"))
    assert rows(got) == [("1",), ("2",), ("4",), ("5",)]


def test_chart_groups(spark):
    r = random.Random(5)
    points = [(c, r.randrange(120), r.randrange(60), k) for c in (1, 2) for k in range(150)]
    points += [(1, 5, 5, -1), (3, 0, 0, 0)]
    df = spark.createDataFrame(points, "chart long, x long, y long, place long")
    want = set()
    for c in (1, 2, 3):
        first = {}
        for _, x, y, k in (p for p in points if p[0] == c):
            first[x, y] = min(k, first.get((x, y), k))
        heads = []
        for x, y in sorted(first, key=lambda p: first[p]):
            head = next((h for h in heads if math.hypot(x - h[0], y - h[1]) <= 16), None)
            if head is None:
                heads.append(head := (x, y))
            want.add((c, x, y, *head))
    assert set(rows(P.chart_groups(df))) == want


def test_ingested(spark):
    kind = "part_id long, retailer_id long, price_cents long, observed_at timestamp"
    listings = spark.createDataFrame([(1, 1, 10, DAY(2026, 1, 1))], "part_id long, retailer_id long, price_cents long, updated_at timestamp")
    history = spark.createDataFrame([(1, 1, DAY(2026, 1, 1), 10)], "part_id long, retailer_id long, observed_at timestamp, price_cents long")
    seen = [(1, 1, 12, DAY(2026, 1, 1, 9)), (1, 1, 11, DAY(2026, 1, 1, 8)), (1, 1, 9, DAY(2026, 1, 2)), (2, 1, None, DAY(2026, 1, 3)), (3, 1, -5, DAY(2026, 1, 3)), (4, 1, 0, DAY(2026, 1, 3))]
    new, old = P.ingested(listings, history, spark.createDataFrame(seen, kind))
    assert {(r.part_id, r.price_cents) for r in new.collect()} == {(1, 9), (2, None), (3, None), (4, 0)}
    assert {(r.part_id, r.observed_at, r.price_cents) for r in old.collect()} == {(1, DAY(2026, 1, 1, 9), 12), (1, DAY(2026, 1, 2), 9), (4, DAY(2026, 1, 3), 0)}


def test_images_to_fetch(spark):
    urls = [f"https://x.org/{i}" for i in range(13)]
    items = spark.createDataFrame([(1, ["https://x.org/a?width=5", "http://www.x.org/a?width=7&v=1", "https://x.org/a?v=1&width=9", "https://x.org/c", None, " "]), (2, urls), (3, None)], "id long, urls array<string>")
    cached = spark.createDataFrame([("https://x.org/c",)], "canonical string")
    got = rows(A.images_to_fetch(items, cached, "id", "urls"))
    assert [g for g in got if g[0] == 1] == [(1, "https://x.org/a?v=1&width=5760"), (1, "https://x.org/a?width=5760")] and len([g for g in got if g[0] == 2]) == 12


def test_line_and_table_orders(spark):
    df = spark.createDataFrame([(1, "b", "z", 3), (2, "a", None, None), (3, "c", "", 1), (4, "a", "y", 2)], "id long, part string, part_number string, price long")
    ids = lambda order: [r.id for r in df.orderBy(*order).collect()]
    assert ids(O.line_order("part_number")) == [4, 1, 2, 3] and ids(O.line_order("part_number", True)) == [1, 4, 2, 3]
    assert ids(O.line_order("price")) == [3, 4, 1, 2] and ids(O.line_order("price", True)) == [1, 4, 3, 2]
    assert ids([*O.table_order("price"), F.col("id")]) == [2, 3, 4, 1] and ids([*O.table_order("part_number"), F.col("id")]) == [2, 3, 4, 1]


def test_numbers_of_statistics(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Type,Name,95%\nGET,/a,120\nPOST,/b,N/A\n")
    stats = tables.load_stats(spark, str(tmp_path / "s.csv"))
    assert stats.where("Type = 'GET'").select(tables.number_in("95%").alias("x")).first().x == 120.0
    with pytest.raises(Exception, match="no number"):
        stats.select(tables.number_in("95%").alias("x")).collect()


def test_scores_of_many(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "e long, k string")
    t = spark.createDataFrame([(1, "a"), (3, "b")], "e long, k string")
    r = A.micro_score(p, t, "e", ["k"]).first()
    assert (r.sample_size, r.true_positives, r.precision, r.recall) == (3, 1, 1 / 3, 0.5)
    none = p.limit(0)
    assert A.micro_score(none, none, "e", ["k"]).first().f1 == 0.0


def test_identifier_conflicts_of_an_identifier_that_very_many_share(spark):
    """100,000 parts of one GTIN and one number: all pairs would be ten billion rows."""
    known = spark.range(100_000).select(F.col("id"), F.lit("g").alias("gtin"), F.lit("m").alias("manufacturer"), F.lit("n").alias("number"))
    x = A.identifier_conflicts(known.where("id <> 5").unionByName(spark.createDataFrame([(5, None, "m", "n"), (None, "g", "m", "n")], "id long, gtin string, manufacturer string, number string")), known)
    got = x.groupBy("identifier", "existing_id").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first"))
    assert rows(got) == [("gtin", 0, 99_998, 1), ("gtin", 1, 1, 0), ("manufacturer_part_number", 0, 1, 5)]
