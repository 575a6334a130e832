"""Operators on rows made by hand."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockwright.functions import html as H
from stockwright.functions import ordering as O
from stockwright.functions import predicates as P
from stockwright.functions import text as T
from stockwright.operators import analysis as A
from stockwright.operators import builds as B
from stockwright.operators import prices as R
from stockwright.operators import relations as L
from stockwright.operators import votes as V
from stockwright.sources import tables
from stockwright.streaming import changes as S

UTC = dt.datetime


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("Brake  Kit (Front)", "brake-kit-front"), ("--A--", "a"), ("", ""), ("Ünï", "n")])
def test_slug(spark, raw, want):
    assert one(spark, raw, "string", T.slug) == want


@pytest.mark.parametrize(("raw", "want"), [("Acme Co., Inc.", "acme"), ("Group LLC", ""), ("Co Acme", "coacme"), ("A-B", "ab")])
def test_manufacturer_key(spark, raw, want):
    assert one(spark, raw, "string", lambda c: T.manufacturer_key(c, ("inc", "llc", "co", "group"))) == want


@pytest.mark.parametrize(("raw", "want"), [("$1,234.50", 123450), ("0.125", 12), ("0.375", 38), ("from 20 each", 2000), ("none", None), ("", None)])
def test_price_cents_rounds_halves_to_even(spark, raw, want):
    assert one(spark, raw, "string", T.price_cents) == want


@pytest.mark.parametrize(("raw", "want"), [("PN: AB-1", "AB-1"), ("sku:#", None), ("  ", None), ("x", "x")])
def test_part_number(spark, raw, want):
    assert one(spark, raw, "string", lambda c: T.part_number(c, ("pn:?", "sku:?", "#"))) == want


def test_part_number_key_is_long_enough(spark):
    assert one(spark, "ab-1", "string", T.part_number_key) is None
    assert one(spark, "ab-12", "string", T.part_number_key) == "AB12"
    assert one(spark, "ab-12", "string", lambda c: T.part_number_key(c, ("ab12",))) is None


@pytest.mark.parametrize("url", ["http://a.example/p/?q=1", "HTTPS://A.Example/p", "ftp://a.example/p", "not-a-url", "", None, "https:///p", " http://a.example ", "http://a.example//", "http://a.example/p#x", "mailto:a@b.org"])
def test_url_keys_are_alike_as_a_column_and_in_pages(spark, url):
    got = one(spark, url, "string", T.url_key)
    assert got == H._address(url)
    assert got == {"http://a.example/p/?q=1": "http://a.example/p", "ftp://a.example/p": "ftp://a.example/p", "not-a-url": None, " http://a.example ": "http://a.example/"}.get(url, got)


@pytest.mark.parametrize(("raw", "number", "key"), [
    ("Product Code: AB-12", "AB-12", "AB12"), ("Code: 77x", "77x", None), ("Model #: Z9-000", "Z9-000", "Z9000"), ("model: q 1 2 3", "q 1 2 3", "Q123"), ("#55", "#55", None), (" E46 ", None, None), ("SKU: e 9 x", None, None), ("SKU: Part #: 1-2-3-4", "1-2-3-4", "1234"),
    ("Code: SKU: 1234", "SKU: 1234", "SKU1234"), ("E-46", "E-46", None), ("z4m-kit", "z4m-kit", "Z4MKIT"), (None, None, None), (" \t", None, None), ("Item#:5555", "5555", "5555"), ("Part Number : p9-99", "p9-99", "P999"),
])
def test_part_numbers_by_the_fixed_labels_and_codes(spark, raw, number, key):
    assert one(spark, raw, "string", lambda c: T.part_number(c, reject=T.VEHICLE_CODES)) == number
    assert one(spark, raw, "string", lambda c: T.part_number_key(c, T.VEHICLE_CODES, labels=T.NUMBER_LABELS)) == key


@pytest.mark.parametrize(("raw", "want"), [("APR Motorsport", "apr"), ("Racing Dynamics USA, Inc.", "racingdynamics"), ("Performance Electronics Ltd", ""), ("Group 5", "group5"), ("Turner Motorsports America LLC", "turner"), ("Induction-Industries X", "inductionindustriesx"), ("CorpCo", "corpco")])
def test_endings_of_names(spark, raw, want):
    assert one(spark, raw, "string", T.manufacturer_key) == want


@pytest.mark.parametrize(("seconds", "want"), [(None, "-"), (-5, "0s ago"), (59, "59s ago"), (60, "1m ago"), (61, "1m 1s ago"), (3599, "59m 59s ago"), (3600, "1h ago"), (7260, "2h 1m ago"), (90000, "25h ago")])
def test_ages(spark, seconds, want):
    assert one(spark, seconds, "long", T.age) == want


def test_dollars_and_byte_keys(spark):
    assert [one(spark, c, "long", T.dollars) for c in (0, 5, 123456789, -1050)] == ["$0.00", "$0.05", "$1,234,567.89", "-$10.50"]
    for b in (b"", b"a", b"ab", b"abc", bytes(range(240, 256))):
        key = one(spark, bytearray(b), "binary", T.base64url)
        assert not set(key) & set("+/=") and bytes(one(spark, key, "string", T.from_base64url)) == b


def test_cursors_of_rows(spark):
    text = one(spark, "k \u00e9 ?>", "string", lambda c: O.cursor_text(c, F.lit(7)))
    assert one(spark, text, "string", O.cursor_position) == ("7", "k \u00e9 ?>")
    for bad in ("", "????", "bm90IGpzb24"):
        with pytest.raises(Exception, match="not a cursor"):
            one(spark, bad, "string", O.cursor_position)


def test_get_or_raise(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert sorted(r.id for r in L.get_or_raise(df, [2, 1, 2], "id").collect()) == [1, 2]
    with pytest.raises(Exception, match="no row with key 9"):
        L.get_or_raise(df, [1, 9], "id").collect()


def test_index_faults_and_baselines(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", None), (3, None, "a"), (4, "a", "b"), (5, None, None)], "id long, due string, stored string")
    assert sorted(map(tuple, L.index_faults(rows, "id", F.col("due"), F.col("stored")).collect())) == [(2, "missing"), (3, "wrongly present"), (4, "differs")]
    good = '{"harness_version":1,"signal":"car","sample_size":0,"generated_at":"t","precision":1,"recall":0.0,"f1":1e-3}'
    bad = {good: [], "[]": None, "{": None, None: None, good.replace(":0,", ":0.5,"): ["sample_size no integer"], good.replace("1e-3", "1.01"): ["f1 not in [0, 1]"], good.replace('"f1":1e-3', '"f1":null'): ["f1 missing"], good.replace('"car"', "5"): ["signal unknown"], good.replace("\"precision\":1", "\"precision\":true"): ["precision not in [0, 1]"]}
    got = {r.json: r.violations for r in A.baseline_violations(spark.createDataFrame([(k,) for k in bad], "json string")).collect()}
    assert all(got[k] == v if v is not None else got[k][0] == "not an object" for k, v in bad.items())


def test_who_may_change(spark):
    own = spark.createDataFrame([(1,), (2,), (None,)], "u long")
    seen = lambda *a, **k: sorted((r.u or 0) for r in own.where(P.may_change(F.col("u"), *a, **k)).collect())
    assert seen(1) == [0, 1] and seen(9) == [0] and seen(9, admin=True) == seen(9, superuser=True) == [0, 1, 2]


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.W3.Org/?utm_source=a&b=1&b=2#x", "string", T.canonical_url) == "https://www.w3.org?b=1&b=2"
    assert one(spark, "https://www.wwide.example/", "string", T.bare_host) == "ide.example"


def test_contains_is_no_pattern(spark):
    df = spark.createDataFrame([("100% a_b",), ("ab",), (None,)], "x string")
    assert df.where(P.contains("%", "x")).count() == 1
    assert df.where(P.contains("A_B", "x")).count() == 1
    assert df.where(P.contains(" ", "x")).count() == 3


def test_text_key_descending_mirrors_and_missing_are_last(spark):
    df = spark.createDataFrame([(v,) for v in ("ab", "abc", "b", "", None, "é")], "x string")
    down = [r.x for r in df.orderBy(*O.text_key(F.col("x"), True)).collect()]
    up = [r.x for r in df.orderBy(*O.text_key(F.col("x"))).collect()]
    assert down[:3] == ["b", "ab", "abc"] and set(down[-2:]) == {"", None}
    assert up[:3] == ["ab", "abc", "b"] and set(up[-2:]) == {"", None}


def test_numeric_key(spark):
    df = spark.createDataFrame([(v,) for v in (5, -3, None, 10**18)], "x long")
    assert [r.x for r in df.orderBy(*O.numeric_key(F.col("x"), True)).collect()] == [10**18, 5, -3, None]


def test_keyset_walk_is_complete(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(50)], "k long, id long")
    seen, after = [], None
    while page := O.keyset_page(df, ["k", "id"], 7, after).collect():
        seen += [r.id for r in page]
        after = O.from_cursor(O.cursor([page[-1].k, page[-1].id]))
    assert seen == list(range(50))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(), st.text()), max_size=4))
def test_cursor_round_trip(values):
    assert O.from_cursor(O.cursor(values)) == values


def test_bad_cursor():
    with pytest.raises(ValueError):
        O.from_cursor("%%%")


HISTORY = "part_id long, retailer_id long, observed_at timestamp, price_cents long"


def test_trend_and_empty_parts(spark):
    day = lambda n: UTC(2025, 12, 31) - dt.timedelta(days=n)
    h = spark.createDataFrame([(1, 1, day(60), 100), (1, 1, day(30), 150), (1, 1, day(1), 200), (2, 1, day(5), 100), (2, 1, day(4), 100), (3, 1, day(3), 50)], HISTORY)
    parts = spark.createDataFrame([(1, None), (2, None), (3, 1), (4, None)], "id long, canonical_part_id long")
    ask = spark.createDataFrame([(1,), (2,), (3,), (4,), (99,)], "part_id long")
    got = {r.part_id: r for r in R.batch_summary(ask, parts, R.within(h, "30d", "2026-01-01")).collect()}
    assert (got[1].min_cents, got[1].max_cents, got[1].last_cents, got[1].observations) == (50, 200, 200, 2)
    assert got[1].trend == "up" and got[3].trend == "up" and got[2].trend == "flat"
    assert got[4].observations == 0 and got[4].min_cents is None and got[99].trend == "flat"
    with pytest.raises(ValueError):
        R.within(h, "2d", "2026-01-01")


def test_build_costs_keep_null_apart_from_zero(spark):
    builds = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "build_id long, base_cents long")
    lines = spark.createDataFrame([(1, 7, 2), (2, 8, 1)], "build_id long, part_id long, quantity long")
    labour = spark.createDataFrame([(1, 5), (1, 6), (3, 4)], "build_id long, cost_cents long")
    prices = spark.createDataFrame([(7, 100)], "part_id long, price_cents long")
    got = {r.build_id: (r.parts_cents, r.labour_cents, r.total_cents) for r in B.costs(builds, lines, labour, prices).collect()}
    assert got == {1: (200, 11, 221), 2: (0, None, 10), 3: (None, 4, 14)}


def test_flagged_at_the_limits(spark):
    at = UTC(2026, 1, 1)
    rows = [(1, u, "downvote" if u < 3 else "upvote", at - dt.timedelta(days=30)) for u in range(10)]
    rows += [(2, u, "downvote", at - dt.timedelta(days=7)) for u in range(3)] + [(2, u + 10, "upvote", at) for u in range(20)]
    rows += [(3, u, "downvote", at) for u in range(4)]
    votes = spark.createDataFrame(rows, "entity_id int, user_id long, vote_type string, created_at timestamp")
    assert {r.entity_id for r in V.flagged(votes, "2026-01-01").collect()} == {1, 2}


def test_relations(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id long, name string, n long")
    changes = spark.createDataFrame([(1, "z", []), (2, None, ["n"])], "id long, name string, clear array<string>").withColumn("n", F.lit(None).cast("long"))
    got = {r.id: (r.name, r.n) for r in L.patched(stored, changes, "id", ["name", "n"]).collect()}
    assert got == {1: ("z", 1), 2: ("b", None), 3: (None, 3)}
    source = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "id long, name string")
    assert {r.id: r.action for r in L.reconcile(source, stored, "id", ["name"]).collect()} == {1: "keep", 2: "update", 3: "leave", 4: "insert"}
    assert [r.id for r in L.by_ids_in_order(stored, [3, 1, 3, 9], "id").collect()] == [3, 1]


def test_scores_without_denominators(spark):
    none = spark.createDataFrame([], "k string")
    got = A.multiset_score(none, none, ["k"]).first()
    assert (got.true_positives, got.precision, got.recall, got.f1) == (0, 0.0, 0.0, 0.0)
    some = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert A.multiset_score(some, some.limit(2), ["k"]).first().true_positives == 2


def test_classes(spark):
    kw = spark.createDataFrame([("one", 0, "brake pad"), ("two", 1, "rotor"), ("three", 2, "pad")], "category string, place int, keyword string")
    items = spark.createDataFrame([(1, "Brake pad", None), (2, "x", "a rotor"), (3, "nothing", ""), (4, "", None), (5, "pads", "")], "id long, t string, b string")
    assert {r.id: r.category for r in A.classify(items, kw, "id", "t", "b").collect()} == {1: "one", 2: "two", 3: "other", 4: None, 5: "other"}


PRODUCT = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"Pad\tset","brand":{"name":"Acme"},"offers":[{"price":"1,234.50"}],"image":["u1","u2"],"description":"a long description"}]}</script>'


def test_page_parser():
    assert H.read_page(PRODUCT, "https://a.example/p") == ("Pad\tset", "a long description", ["u1", "u2"], "Acme", None, 123450, "product")
    assert H.read_page("<title> T </title><p>now $12.50</p>", None) == ("T", None, None, None, None, 1250, "page")
    assert H.read_page("<p>no name</p>", None)[0] is None and H.read_page(None, None)[0] is None
    two = '<script type="application/ld+json">[{"@type":"Product","name":"A","url":"https://x/a"},{"@type":"Product","name":"B","url":"https://x/b"}]</script>'
    assert H.read_page(two, "http://x/b/")[0] == "B" and H.read_page(two, "https://x/c")[0] is None


def test_page_cleaner():
    page = '<style>x</style><script>y</script><meta name="csrf" content="t"><input value="v" name="n"><textarea>z</textarea><p>keep &amp; this</p>'
    got = H.clean_page(page)
    assert got == '<input name="n"><textarea></textarea><p>keep &amp; this</p>'
    assert H.clean_page("<object><iframe></object><p>kept?</p>") == "<p>kept?</p>"
    assert H.clean_page("<!DOCTYPE html><meta charset=utf-8><meta name=csrf content=1><meta property='og:price' content=2><p onclick='f()'>a<br>") == "<!DOCTYPE html><meta charset=utf-8><meta property='og:price' content=2><p onclick='f()'>a<br>"
    assert H.clean_page('<select name="s"><option selected value="a">A</select></b>') == '<select name="s"><option>A</select></b>'
    assert H.clean_page("<div><noscript>x<p>y</div>z<script>a</script><script type='application/ld+json'>{}</script>") == "<div></div>z<script type='application/ld+json'>{}</script>"


def test_json_seed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"make":"M","models":[{"name":"X","generations":[{"name":"I","start_year":1990,"end_year":null}]}]}')
    assert tables.json_seed(spark, str(tmp_path)).collect()[0].generation == "I"
    (tmp_path / "b.json").write_text('{"make":"M","models":[]}')
    with pytest.raises(ValueError):
        tables.json_seed(spark, str(tmp_path))


def test_load_stats(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Type,Name,95%\nGET,/a,120\nPOST,/b,N/A\n")
    assert [r["95%"] for r in tables.load_stats(spark, str(tmp_path / "s.csv")).collect()] == ["120", None]


def test_alert_cooldown(spark):
    t = UTC(2026, 1, 1)
    hours = [0, 23, 24, 25, 48]
    rows = [(1, 10, t + dt.timedelta(hours=h)) for h in hours] + [(2, 5, t)]
    got = S.fired(spark.createDataFrame(rows, "alert_id long, price_cents long, observed_at timestamp")).collect()
    assert sorted((r.alert_id, (r.observed_at - t).total_seconds() / 3600) for r in got) == [(1, 0), (1, 24), (1, 48), (2, 0)]


def test_rate_limit_window_starts_with_first_request(spark):
    t = UTC(2026, 1, 1, 0, 0, 50)
    rows = [("a", t + dt.timedelta(seconds=s), i, 2) for i, s in enumerate((0, 20, 59, 60, 61))]
    got = S.rate_limited(spark.createDataFrame(rows, "key string, ts timestamp, request_id long, most long")).orderBy("request_id").collect()
    assert [r.place for r in got] == [1, 2, 3, 1, 2] and [r.allowed for r in got] == [True, True, False, True, True]


def _change(seq, listing, new, old, deleted=False, was=False):
    ts = UTC(2026, 1, 1)
    s = lambda p, d: (listing, "p1", "r1", p, ts, d)
    return ("MODIFY", seq, ts, s(new, deleted), None if old == "none" else s(old, was))


def test_change_consumers_and_replay(spark, tmp_path):
    rows = [_change("1", "a", 90, 100), _change("2", "a", 80, 90), _change("3", "b", 100, 100), _change("4", "c", 5, "none"), _change("5", "d", -1, 3), _change("6", "e", 1, 1, True, False), _change("7", "f", 1, 1, True, True)]
    df = spark.createDataFrame(rows, S.CHANGE)
    assert {(r.listing_id, r.price_cents) for r in S.lowest_drops(df).collect()} == {("a", 80), ("c", 5)}
    assert [r.id for r in S.tombstoned(df).collect()] == ["e"]
    assert S.purge_messages(S.tombstoned(df)).first().message == '{"version":1,"kind":"part","part_id":"e"}'
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def consume(batch, _):
        S.lowest_drops(batch).write.mode("overwrite").parquet(out)

    for run in ("c1", "c2"):  # a replay from the start changes nothing
        q = S.run_consumer(S.change_stream(spark, str(tmp_path / "in")), consume, str(tmp_path / run))
        q.awaitTermination(60)
        assert spark.read.parquet(out).count() == 2


def test_recount_is_idempotent(spark):
    ballots = spark.createDataFrame([(1, 7, 1, "upvote", UTC(2026, 1, 1)), (2, 7, 1, "downvote", UTC(2026, 1, 2)), (3, 8, 1, "upvote", UTC(2026, 1, 1))], "event_id long, entity_id int, user_id long, vote_type string, created_at timestamp")
    stored = spark.createDataFrame([(7, 1), (8, 1)], "entity_id int, net_votes long")
    first = S.recount(ballots, ballots, stored)
    assert [(r.entity_id, r.net_votes) for r in first.collect()] == [(7, -1)]
    assert S.recount(ballots, ballots, L.upsert(stored, first, ["entity_id"])).count() == 0


def test_report_verdicts(spark):
    asked = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 8, 1), (4, 9, 1), (5, 9, 2), (6, 9, 99), (7, None, 1)], "report_id long, user_id long, entity_id long")
    entities = spark.createDataFrame([(1, 7), (2, None)], "entity_id long, owner_id long")
    got = {r.report_id: r.verdict for r in V.report_verdicts(asked, entities, spark.createDataFrame([(9, 1), (9, 1)], "user_id long, entity_id long")).collect()}
    assert got == {1: "own", 2: "created", 3: "already reported", 4: "already reported", 5: "created", 6: "not found", 7: "created"}


def test_migrated(spark):
    parts = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id long, canonical_part_id long")
    fits = spark.createDataFrame([(1, 5), (1, 2), (1, 5), (9, 1)], "part_id long, car_id long")
    listings = spark.createDataFrame([(2, 50), (1, 70), (1, -1)], "part_id long, price_cents long")
    got = {r.id: (r.car_ids, r.best_price_cents, r.net_votes) for r in R.migrated(parts, fits, listings, spark.createDataFrame([(2, -3)], "id long, net_votes long")).collect()}
    assert got == {1: ([2, 5], 50, 0), 2: ([], 50, -3), 3: ([], None, 0)}


def test_tasks_of_the_history_follow_its_rows(spark, monkeypatch):
    """A task's share of the history is bounded, whatever Spark merges partitions to; small tables are left to Spark."""
    c = tables.Catalogue(spark, "/root/testdata/sf0.001")
    assert c.tasks("lineitem") is None
    monkeypatch.setattr(tables, "DEALT", 500)
    assert c.tasks("lineitem") == c.history.rdd.getNumPartitions() == c.listings.rdd.getNumPartitions() == -(-c.raw("lineitem").count() // 500)


def test_references_without_a_semicolon_are_read():
    """As in HTML, and as the reference's html.unescape reads them; SQL of f20_parsed_page leaves them as text."""
    assert H.read_page("<title>the&amp;&amp;&amp</title>", None)[0] == "the&&&"
