"""Queries over the catalogue: access paths, filters, orders, pages, facets, vehicles, search."""

import datetime as dt

from pyspark.sql import functions as F

from stockwright.functions import ordering as O
from stockwright.functions import predicates as P
from stockwright.operators import analysis as A
from stockwright.operators import cascades as C
from stockwright.operators import listings as I
from stockwright.operators import relations as L
from stockwright.operators import search as G
from stockwright.operators.ordered import Ordered
from stockwright.plans.registry import Registry
from stockwright.sources import sitemaps as M
from stockwright.sources import tables

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_QUOTED = [x.replace("'", "''") for x in (O._PRINTABLE, O._PRINTABLE[::-1])]


def _mirror(column):
    return f"translate(lower({column}), '{_QUOTED[0]}', '{_QUOTED[1]}')"


def _catalogue(c):
    """Parts with an owner, cars and a universal mark, as a listing filters them."""
    return c.parts.withColumns({
        "owner": F.concat(F.lit("u"), (F.col("id") % 7).cast("string")), "universal": F.col("size") % 10 == 0,
        "car_ids": F.array((F.col("id") % 5).cast("int"), (F.col("size") % 11).cast("int")),
    })


@R.add("s01_point_lookup", "SELECT id, name, manufacturer, price_cents FROM parts WHERE id = 17")
def s01(c):
    return c.parts.where("id = 17").select("id", "name", "manufacturer", "price_cents")


@R.add("s03_indexed_page", "SELECT part_id, price_cents FROM listings WHERE retailer_id = 3 AND price_cents BETWEEN 100000 AND 200000 ORDER BY price_cents DESC, part_id LIMIT 20")
def s03(c):
    own = c.listings.where("retailer_id = 3 and price_cents between 100000 and 200000")
    return own.select("part_id", "price_cents").orderBy(F.desc("price_cents"), "part_id").limit(20)


@R.add("s08_batch_get", "SELECT id, name FROM parts WHERE id IN (3, 5, 8, 13, 99999999)")
def s08(c):
    return L.batch_get(c.parts, [3, 5, 5, 8, 13, 99999999], "id").select("id", "name")


@R.add("s10_first_of_index", "SELECT part_id, price_cents FROM listings WHERE retailer_id = 3 ORDER BY price_cents, part_id LIMIT 1")
def s10(c):
    return c.listings.where("retailer_id = 3").select("part_id", "price_cents").orderBy("price_cents", "part_id").limit(1)


@R.add("s13_scan_matching", "SELECT id, name FROM parts WHERE contains(lower(name), 'bolt') OR contains(lower(category), 'brass')")
def s13(c):
    return c.parts.where(P.contains(" Bolt ", "name") | P.contains("brass", "category")).select("id", "name")


@R.add("s14_parts_of_category", "SELECT id, category FROM parts WHERE category = (SELECT min(category) FROM parts) ORDER BY id DESC")
def s14(c):
    first = c.raw("part").agg(F.min("p_type").alias("category"))
    return c.parts.select("id", "category").join(F.broadcast(first), "category", "left_semi").orderBy(F.desc("id")).select("id", "category")


@R.add("s14_indexed_listing", "WITH k AS (SELECT min(category) AS a, max(category) AS b FROM parts) SELECT 1 AS page, id, name, category FROM (SELECT * FROM parts WHERE category = (SELECT a FROM k) ORDER BY name, id LIMIT 25) UNION ALL SELECT 2, id, name, category FROM (SELECT * FROM parts WHERE category = (SELECT a FROM k) ORDER BY name, id LIMIT 25 OFFSET 25) UNION ALL SELECT 3, id, name, category FROM (SELECT * FROM parts WHERE category = (SELECT b FROM k) AND name <= 'm' ORDER BY name DESC, id DESC LIMIT 25)")
def s14_indexed(c):
    """Two pages of a category forwards, the second behind the first's cursor, and one of another backwards from a name."""
    listing = I.build_listing(c.parts.select("category", "name", "id"), ["category", "name", "id"], tables.scratch(c.spark))
    a, b = c.raw("part").agg(F.min("p_type"), F.max("p_type")).first()
    one = listing.page([a], 25)
    last = one.orderBy(F.desc("name"), F.desc("id")).first()
    two = listing.page([a], 25, after=[last.name, last.id]) if last else one
    three = listing.page([b], 25, forward=False, high="m")
    pages = [p.select(F.lit(n).alias("page"), "id", "name", "category") for n, p in enumerate((one, two, three), 1)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@R.add("m13_listing_faults", "SELECT id, CASE WHEN id % 9 = 0 THEN 'missing' WHEN id % 10 = 1 THEN 'wrongly present' ELSE 'different' END AS fault FROM parts WHERE (id % 9 = 0) <> (id % 10 = 1) OR (id % 9 <> 0 AND id % 7 = 0 AND id % 10 <> 1)")
def m13_listing(c):
    """A listing of parts that was built before some were added, changed and taken out of their category."""
    now = c.parts.select(F.when(F.col("id") % 10 != 1, F.col("category")).alias("category"), "name", "id")
    before = c.parts.where("id % 9 <> 0").select("category", F.when(F.col("id") % 7 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), "id")
    return I.build_listing(before, ["category", "name", "id"], tables.scratch(c.spark)).faults(now, "id")


@R.add("s15_canonical_parts", "SELECT id, name FROM parts WHERE canonical_part_id IS NULL")
def s15(c):
    return c.parts.where("canonical_part_id is null").select("id", "name")


@R.add("s16_link_group", "SELECT id FROM parts WHERE coalesce(canonical_part_id, id) = (SELECT coalesce(canonical_part_id, id) FROM parts WHERE id = 1500)")
def s16(c):
    group = c.parts.select("id", F.coalesce("canonical_part_id", "id").alias("g"))
    return group.join(F.broadcast(group.where("id = 1500").select("g")), "g", "left_semi").select("id")


@R.add("s28_pages_within_limit", "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE strlen(html) <= 2000")
def s28(c):
    return c.raw("pages").where(F.octet_length("html") <= 2000).select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


@R.add("s29_objects_by_prefix", "SELECT split_part(name, '/', 1) AS prefix, count(*) AS n FROM (SELECT manufacturer || '/' || id AS name FROM parts) GROUP BY 1")
def s29(c):
    keys = c.parts.select(F.concat_ws("/", "manufacturer", "id").alias("name"))
    return keys.groupBy(F.split_part("name", F.lit("/"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


@R.add("p02_contains", "SELECT id, name FROM parts WHERE contains(lower(name), 'st')")
def p02(c):
    return c.parts.where(P.contains("ST", "name")).select("id", "name")


@R.add("p02_contains_no_pattern", "SELECT id FROM parts WHERE contains(lower(name), '_')")
def p02_plain(c):
    return c.parts.where(P.contains("_", "name")).select("id")


_TERMS = {"documents": ("ation", "privacy policy", "über", "e th", "zzzz", "é ", "the of"), "parts": ("bolt", "Nut ", "#3", "ee", "a", "")}
_FOUND = "SELECT DISTINCT '{0}' AS kind, '{1}' AS term, {2} AS id FROM {0} WHERE {3}"


@R.add("p02_indexed_search", " UNION ALL ".join([_FOUND.format("documents", t.strip().lower(), "doc_id", f"contains(lower(text), '{t.strip().lower()}')") for t in _TERMS["documents"]] + [_FOUND.format("parts", t.strip().lower(), "id", " OR ".join(f"contains(lower({k}), '{t.strip().lower()}')" for k in ("name", "manufacturer", "category"))) for t in _TERMS["parts"]]))
def p02_indexed(c):
    """Several terms in documents and in parts, found by indexes of their grams."""
    out = []
    for kind, rows, key, columns in (("documents", c.raw("documents"), "doc_id", ["text"]), ("parts", c.parts, "id", ["name", "manufacturer", "category"])):
        index = G.build_index(rows, key, columns, f"{tables.scratch(c.spark)}/index")
        out.append(G.search(rows, index, key, columns, _TERMS[kind]).select(F.lit(kind).alias("kind"), "term", F.col(key).alias("id")).distinct())
    return out[0].unionByName(out[1])


@R.add("p03_starts_with", "SELECT id, name FROM parts WHERE starts_with(lower(name), 'b')")
def p03(c):
    return c.parts.where(P.starts_with("B", "name")).select("id", "name")


@R.add("p04_catalogue_filter", "SELECT id FROM parts WHERE canonical_part_id IS NULL AND manufacturer IN ('Brand#11', 'Brand#23', 'Brand#34') AND (id % 5 IN (1, 2) OR size % 11 IN (1, 2)) AND price_cents BETWEEN 95000 AND 160000")
def p04(c):
    f = P.PartFilter(manufacturers=("Brand#11", "Brand#23", "Brand#34"), cars=(1, 2), least_cents=95000, most_cents=160000)
    return _catalogue(c).where(f.column()).select("id")


@R.add("p04_catalogue_owner", "SELECT id FROM parts WHERE id % 7 = 3 AND size % 10 = 0")
def p04_owner(c):
    return _catalogue(c).where(P.PartFilter(owner="u3", universal=True, cars=(1,)).column()).select("id")


@R.add("p05_retailer_source", "SELECT id FROM parts WHERE canonical_part_id IS NULL AND id IN (SELECT part_id FROM listings WHERE retailer_id = 5) AND price_cents >= 100000")
def p05(c):
    """An owner would come before the retailer, and the retailer would then be ignored."""
    stocked = c.listings.where("retailer_id = 5").select(F.col("part_id").alias("id"))
    return _catalogue(c).where(P.PartFilter(least_cents=100000).column()).join(stocked, "id", "left_semi").select("id")


@R.add("p06_filter_without_cars", "SELECT id FROM parts WHERE canonical_part_id IS NULL AND price_cents <= 120000")
def p06(c):
    return _catalogue(c).where(P.PartFilter(cars=(1, 2), universal=True, most_cents=120000).without_cars().column()).select("id")


@R.add("p09_user_search", "SELECT user_id, username FROM users WHERE contains(lower(username), '0012')")
def p09(c):
    return c.users.where(P.contains("0012", "username")).select("user_id", "username")


@R.add("p11_newest_reports", "SELECT doc_id, quality FROM labels WHERE toxic = 1 ORDER BY quality, doc_id DESC LIMIT 40")
def p11(c):
    return c.raw("labels").where("toxic = 1").select("doc_id", "quality").orderBy("quality", F.desc("doc_id")).limit(40)


@R.add("p12_active_categories", "SELECT DISTINCT category FROM parts WHERE canonical_part_id IS NULL ORDER BY lower(category), category")
def p12(c):
    return c.parts.where("canonical_part_id is null").select("category").distinct().orderBy(F.lower("category"), "category")


@R.add("p16_vehicle_search", "SELECT s_suppkey AS generation_id FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(s_name), 'an') OR contains(lower(n_name), 'an') OR contains(lower(r_name), 'an')")
def p16(c):
    return _vehicles(c).where(P.contains("AN", "retailer_name", "model_name", "make_name")).select(F.col("retailer_id").alias("generation_id"))


@R.add("p19_file_keys", "SELECT page_id, NOT regexp_matches(k, '^(?i:https?)://') AND contains(k, '/') AS is_key FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE substr(url, 9) END AS k FROM pages)")
def p19(c):
    k = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.expr("substring(url, 9)"))
    return c.raw("pages").select("page_id", P.is_file_key(k).alias("is_key"))


@R.add("p20_activity", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN a < 15 THEN 'active' WHEN a < 90 THEN 'idle' ELSE 'stalled' END AS activity FROM (SELECT event_id, event_type, CAST(floor(epoch(TIMESTAMP '2024-01-31' - ts)) AS BIGINT) % 200 AS a FROM events)")
def p20(c):
    micros = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return c.raw("events").select("event_id", P.activity(F.col("event_type") == "purchase", F.floor(micros) % 200).alias("activity"))


@R.add("p21_newest_canonical", "SELECT id, name FROM parts WHERE canonical_part_id IS NULL AND contains(lower(name), 'e') ORDER BY id DESC LIMIT 30")
def p21(c):
    return c.parts.where(F.col("canonical_part_id").isNull() & P.contains("e", "name")).select("id", "name").orderBy(F.desc("id")).limit(30)


@R.add("p22_search_parts", "SELECT id, name, manufacturer FROM parts WHERE canonical_part_id IS NULL AND (contains(lower(name), 'nut') OR manufacturer IN (SELECT DISTINCT manufacturer FROM parts WHERE contains(lower(manufacturer), '#3')))")
def p22(c):
    makers = c.parts.select("manufacturer").distinct().where(P.contains("#3", "manufacturer")).withColumn("hit", F.lit(True))
    both = c.parts.where("canonical_part_id is null").join(makers, "manufacturer", "left")
    return both.where(P.contains("nut", "name") | F.coalesce("hit", F.lit(False))).select("id", "name", "manufacturer")


@R.add("p24_url_exists", "SELECT min(page_id) AS page_id FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 5)")
def p24(c):
    one = c.raw("pages").where("page_id = 5").select(F.trim("url").alias("url"))
    return c.raw("pages").select("page_id", "url").join(F.broadcast(one), "url", "left_semi").agg(F.min("page_id").alias("page_id"))


@R.add("p25_users_by_name", "SELECT user_id, username FROM users ORDER BY lower(username), user_id LIMIT 100")
def p25(c):
    return c.users.select("user_id", "username").orderBy(F.lower("username"), "user_id").limit(100)


@R.add("p26_by_ids_in_order", "SELECT id, name, place FROM parts JOIN (VALUES (42, CAST(0 AS BIGINT)), (7, 1), (1999, 2), (12, 4)) v(k, place) ON id = k ORDER BY place")
def p26(c):
    return L.by_ids_in_order(c.parts.select("id", "name"), [42, 7, 1999, 7, -5, 12], "id")


@R.add("p27_owned_rows", "SELECT CAST(11 AS INTEGER) AS caller, build_id FROM builds WHERE user_id = 11 OR build_id % 100 = 0 UNION ALL SELECT 12, build_id FROM builds UNION ALL SELECT 13, build_id FROM builds")
def p27(c):
    """What a plain user, an admin and a superuser may change; some builds have no owner."""
    owner = F.when(F.col("build_id") % 100 != 0, F.col("user_id"))
    some = [c.builds.where(P.may_change(owner, i, admin, above)).select(F.lit(i).alias("caller"), "build_id") for i, admin, above in ((11, False, False), (12, True, False), (13, False, True))]
    return some[0].unionByName(some[1]).unionByName(some[2])


def _ordered(name, sql_order):
    @R.add(f"o03_parts_{name}", f"SELECT id FROM parts ORDER BY {sql_order}, id LIMIT 60")
    def o03(c):
        df = c.parts.withColumns({"part_number": F.concat("name", F.lit("-"), "size"), "net_votes": F.col("size") - 25})
        return df.orderBy(*O.part_order(name)).select("id").limit(60)


for _n, _s in (
    ("votes_desc", "size - 25 DESC"), ("votes_asc", "size - 25"), ("price_asc", "price_cents"), ("price_desc", "price_cents DESC"),
    ("name_asc", "lower(name)"), ("name_desc", _mirror("name")), ("part_number_asc", "lower(name || '-' || size)"), ("part_number_desc", _mirror("name || '-' || size")),
    ("manufacturer_asc", "lower(manufacturer)"), ("manufacturer_desc", _mirror("manufacturer")), ("category_asc", "lower(category)"), ("category_desc", _mirror("category")),
):
    _ordered(_n, _s)


@R.add("o02_numeric_key", "SELECT user_id, balance_cents FROM users ORDER BY greatest(balance_cents, 0) DESC, user_id LIMIT 50")
def o02(c):
    return c.users.select("user_id", "balance_cents").orderBy(*O.numeric_key(F.col("balance_cents"), True), "user_id").limit(50)


@R.add("l01_keyset_page", "SELECT price_cents, id FROM parts WHERE (price_cents, id) > (95000, 500) ORDER BY price_cents, id LIMIT 25")
def l01(c):
    return O.keyset_page(c.parts.select("price_cents", "id"), ["price_cents", "id"], 25, (95000, 500))


@R.add("a19_facets", "SELECT 'category' AS facet, category AS value, count(*) AS n FROM parts WHERE price_cents > 100000 GROUP BY 2 UNION ALL SELECT 'manufacturer', manufacturer, count(*) FROM parts WHERE price_cents > 100000 GROUP BY 2")
def a19(c):
    return A.facets(c.parts.where("price_cents > 100000"), ["category", "manufacturer"])


def _vehicles(c):
    models = c.raw("nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("model_name"), F.col("n_regionkey").alias("make_id"))
    makes = c.raw("region").select(F.col("r_regionkey").alias("make_id"), F.col("r_name").alias("make_name"))
    return L.hydrate(c.retailers, models, makes)


@R.add("j01_hydrated_vehicles", "SELECT s_suppkey AS retailer_id, s_name AS retailer_name, s_nationkey AS model_id, coalesce(n_name, '') AS model_name, coalesce(r_name, '') AS make_name, r_name || ' ' || n_name AS display_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j01(c):
    return _vehicles(c)


@R.add("j02_generations_per_make", "SELECT r_name AS make_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1 ORDER BY n DESC, 1")
def j02(c):
    return _vehicles(c).where("make_name <> ''").groupBy("make_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "make_name")


@R.add("j10_posts_with_author", "SELECT conv_id, turn, role, c_name AS author FROM conversations LEFT JOIN customer ON c_custkey = conv_id ORDER BY conv_id, turn")
def j10(c):
    names = c.users.select(F.col("user_id").alias("conv_id"), F.col("username").alias("author"))
    return c.raw("conversations").select("conv_id", "turn", "role").join(names, "conv_id", "left").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "author")


@R.add("s22_thread_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def s22(c):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return c.raw("conversations").select("conv_id", "turn", rn.alias("place"))


@R.add("j13_makes_of_parts", "SELECT DISTINCT r_name AS make_name FROM listings JOIN supplier ON s_suppkey = retailer_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE price_cents < 120000")
def j13(c):
    sellers = c.listings.where("price_cents < 120000").select("retailer_id").distinct()
    return _vehicles(c).join(sellers, "retailer_id", "left_semi").where("make_name <> ''").select("make_name").distinct()


@R.add("j16_parts_for_cars", "SELECT DISTINCT part_id FROM listings WHERE retailer_id IN (1, 2, 3)")
def j16(c):
    return c.listings.where(F.col("retailer_id").isin(1, 2, 3)).select("part_id").distinct()


@R.add("j17_search_builds_by_car", "SELECT user_id, username FROM users WHERE contains(lower(username), '77') OR model_id IN (SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '1'))")
def j17(c):
    cars = c.raw("nation").where(P.contains("1", "n_name")).select(F.col("n_nationkey").alias("model_id"), F.lit(True).alias("hit"))
    return c.users.join(cars, "model_id", "left").where(P.contains("77", "username") | F.coalesce("hit", F.lit(False))).select("user_id", "username")


@R.add("j18_search_parts_by_maker", "SELECT id FROM parts WHERE contains(lower(name), 'gear') OR contains(lower(manufacturer), '#12')")
def j18(c):
    return c.parts.where(P.contains("gear", "name") | P.contains("#12", "manufacturer")).select("id")


@R.add("u05_search_all", "SELECT 'part' AS kind, id FROM parts WHERE contains(lower(name), '12') UNION ALL SELECT 'user', user_id FROM users WHERE contains(lower(username), '12') UNION ALL SELECT 'retailer', retailer_id FROM retailers WHERE contains(lower(retailer_name), '12')")
def u05(c):
    found = [(k, df.where(P.contains("12", n)).select(F.col(i).alias("id"))) for k, df, n, i in (("part", c.parts, "name", "id"), ("user", c.users, "username", "user_id"), ("retailer", c.retailers, "retailer_name", "retailer_id"))]
    a, b, d = [df.select(F.lit(k).alias("kind"), "id") for k, df in found]
    return a.unionByName(b).unionByName(d)


_KEY = "'uploads/' || substr(md5({}), 1, 3) || '.jpg'"
_REFERENCED = " UNION ALL ".join(f"SELECT k FROM (SELECT unnest([{', '.join(ks)}]) AS k FROM {t}) WHERE k LIKE '%/%' AND k NOT LIKE 'http%' AND k NOT LIKE '/%'" for t, ks in (
    ("parts", [_KEY.format("'p' || id"), "'https://x.org/' || id", "''"]), ("users", [_KEY.format("'u' || user_id"), "NULL"]), ("retailers", [_KEY.format("'g' || retailer_id")]),
    ("builds", [_KEY.format("'b' || build_id"), "'plain'"]), ("pages", [_KEY.format("'m' || page_id")]),
))


def _sources(c):
    """The image lists of parts, users, generations and build lists and the keys of recorded images."""
    key = lambda p, i: F.concat(F.lit("uploads/"), F.substring(F.md5(F.concat(F.lit(p), F.col(i).cast("string"))), 1, 3), F.lit(".jpg"))
    none = F.lit(None).cast("string")
    return [
        c.parts.select(F.array(key("p", "id"), F.concat(F.lit("https://x.org/"), "id"), F.lit("")).alias("k")), c.users.select(F.array(key("u", "user_id"), none).alias("k")),
        c.retailers.select(F.array(key("g", "retailer_id")).alias("k")), c.builds.select(F.array(key("b", "build_id"), F.lit("plain")).alias("k")), c.raw("pages").select(F.array(key("m", "page_id")).alias("k")),
    ]


@R.add("j19_orphaned_objects", f"SELECT k FROM (SELECT 'uploads/' || substr(md5('o' || event_id), 1, 3) || '.jpg' AS k FROM events UNION SELECT 'uploads/new-' || event_id || '.jpg' FROM events WHERE event_type = 'error') WHERE k NOT IN ({_REFERENCED})")
def j19(c):
    """Keys of a bucket's listing that none of five tables refers to with a file key."""
    stored = c.raw("events").select(F.concat(F.lit("uploads/"), F.substring(F.md5(F.concat(F.lit("o"), F.col("event_id").cast("string"))), 1, 3), F.lit(".jpg")).alias("k"))
    new = c.raw("events").where("event_type = 'error'").select(F.concat(F.lit("uploads/new-"), F.col("event_id"), F.lit(".jpg")).alias("k"))
    return stored.unionByName(new).distinct().join(L.referenced_keys(_sources(c), "k"), "k", "left_anti")


@R.add("j23_fitment_changes", "SELECT part_id, retailer_id, 'link' AS action FROM (SELECT part_id, retailer_id FROM listings WHERE price_cents < 130000 EXCEPT SELECT part_id, retailer_id FROM listings WHERE price_cents BETWEEN 100000 AND 150000) UNION ALL SELECT part_id, retailer_id, 'unlink' FROM (SELECT part_id, retailer_id FROM listings WHERE price_cents BETWEEN 100000 AND 150000 EXCEPT SELECT part_id, retailer_id FROM listings WHERE price_cents < 130000)")
def j23(c):
    before, after = c.listings.where("price_cents between 100000 and 150000"), c.listings.where("price_cents < 130000")
    return L.changed_links(before.select("part_id", "retailer_id"), after.select("part_id", "retailer_id"), ["part_id", "retailer_id"])


@R.add("j24_reconcile", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'leave' WHEN a.n IS DISTINCT FROM b.n THEN 'update' ELSE 'keep' END AS action FROM (SELECT id, lower(name) AS n FROM parts WHERE id % 3 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE lower(name) END AS n FROM parts WHERE id % 4 <> 0) b USING (id)")
def j24(c):
    source = c.parts.where("id % 3 <> 0").select("id", F.lower("name").alias("n"))
    stored = c.parts.where("id % 4 <> 0").select("id", F.when(F.col("id") % 5 != 0, F.lower("name")).alias("n"))
    return L.reconcile(source, stored, "id", ["n"])


@R.add("u01_referenced_keys", f"SELECT DISTINCT k FROM ({_REFERENCED})")
def u01(c):
    return L.referenced_keys(_sources(c), "k")


@R.add("u02_set_difference", "SELECT id FROM parts EXCEPT SELECT part_id FROM listings WHERE retailer_id < 20")
def u02(c):
    return c.parts.select("id").subtract(c.listings.where("retailer_id < 20").select("part_id"))


@R.add("u04_multiset_intersection", "SELECT part_id FROM lines WHERE phase = 1 INTERSECT ALL SELECT part_id FROM lines WHERE phase = 2")
def u04(c):
    return c.lines.where("phase = 1").select("part_id").intersectAll(c.lines.where("phase = 2").select("part_id"))


@R.add("u06_ordered_dedup", "SELECT name, min(id) AS id FROM parts GROUP BY name")
def u06(c):
    return c.parts.groupBy("name").agg(F.min("id").alias("id"))


@R.add("m02_unique_keys", "SELECT manufacturer, name, count(DISTINCT id) AS owners, min(id) AS first_owner, max(id) AS last_owner FROM parts GROUP BY ALL HAVING count(DISTINCT id) > 1")
def m02(c):
    return L.collisions(c.parts, ["manufacturer", "name"], "id")


@R.add("m07_parts_in_use", "SELECT id FROM parts WHERE id IN (SELECT part_id FROM lines WHERE quantity = 50)")
def m07(c):
    return L.in_use(c.parts.select("id"), c.lines.where("quantity = 50"), "id", "part_id")


@R.add("m13_stale_derived", "SELECT id, CASE WHEN canonical_part_id IS NULL AND NOT gone AND stored IS NULL THEN 'missing' WHEN stored IS NOT NULL AND (canonical_part_id IS NOT NULL OR gone) THEN 'wrongly present' WHEN stored <> lower(name) || '#' || id THEN 'differs' END AS fault FROM (SELECT *, id % 6 = 0 AS gone, CASE WHEN id % 5 <> 0 THEN lower(CASE WHEN id % 7 = 0 THEN 'old ' ELSE '' END || name) || '#' || id END AS stored FROM parts) WHERE fault IS NOT NULL")
def m13(c):
    """The key of the index of live canonical parts is made anew and compared with what is stored."""
    stored = F.when(F.col("id") % 5 != 0, F.concat(F.lower(F.concat(F.when(F.col("id") % 7 == 0, "old ").otherwise(""), F.col("name"))), F.lit("#"), F.col("id")))
    rows = c.parts.withColumns({"gone": F.col("id") % 6 == 0, "stored": stored})
    due = F.when(F.col("canonical_part_id").isNull() & ~F.col("gone"), F.concat(F.lower("name"), F.lit("#"), F.col("id")))
    return L.index_faults(rows, "id", due, F.col("stored"))


@R.add("k01_create_absent", "SELECT id, CASE WHEN id % 2 = 0 THEN price_cents ELSE 0 END AS price_cents, CASE WHEN id % 2 = 0 THEN 'stored' ELSE 'new' END AS origin FROM parts")
def k01(c):
    """The parts of every second id are stored, all are offered; those stored stay as they are."""
    stored = c.parts.where("id % 2 = 0").select("id", "price_cents", F.lit("stored").alias("origin"))
    return L.insert_absent(stored, c.parts.select("id", F.lit(0).cast("long").alias("price_cents"), F.lit("new").alias("origin")), ["id"])


@R.add("k02_patch", "SELECT id, CASE WHEN id % 10 = 1 THEN NULL WHEN id % 10 = 2 THEN 'new' ELSE name END AS name, price_cents FROM parts")
def k02(c):
    changes = c.parts.where("id % 10 in (1, 2, 3)").select("id", F.when(F.col("id") % 10 == 2, "new").alias("name"), F.when(F.col("id") % 10 == 1, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("clear"))
    return L.patched(c.parts.select("id", "name", "price_cents"), changes, "id", ["name"])


@R.add("k03_batch_put", "SELECT id, CASE WHEN id < 50 THEN 1 ELSE price_cents END AS price_cents FROM parts")
def k03(c):
    return L.upsert(c.parts.select("id", "price_cents"), c.parts.where("id < 50").select("id", F.lit(1).cast("long").alias("price_cents")), ["id"])


def _sitemap_sql():
    """SQL of the same files, whose lines are joined by line feeds."""
    lines = lambda *xs: " || chr(10) || ".join(xs)
    url = lambda loc, last, often, much: lines("'  <url>'", f"'    <loc>https://site.example' || {loc} || '</loc>'", *last, f"'    <changefreq>{often}</changefreq>'", f"'    <priority>{much}</priority>'", "'  </url>'")
    head = lambda kind: lines(*[f"'{x}'" for x in M.HEAD.format(kind).split("\n")])
    file = lambda kind, body: f"{lines(head(kind), body, f"'</{kind}>'")} || chr(10)"
    of_days = lambda i: f"TIMESTAMP '2001-01-01' + to_days(CAST({i} % 300 AS INTEGER))"
    kinds = (
        ("parts", f"SELECT CAST(id AS VARCHAR), {of_days('id')} FROM parts WHERE canonical_part_id IS NULL", "/parts/", "weekly", "0.7"),
        ("cars", f"SELECT CAST(retailer_id AS VARCHAR), {of_days('retailer_id')} FROM retailers", "/car-generations/", "monthly", "0.6"), ("build-lists", "SELECT CAST(build_id AS VARCHAR), created_at FROM builds", "/build-lists/", "weekly", "0.6"),
    )
    last = ["strftime(ts, '    <lastmod>%Y-%m-%dT%H:%M:%S+00:00</lastmod>')"]
    pages = " UNION ALL ".join(f"SELECT {i + 1} AS i, '{n}' AS kind, (n - 1) // 2000 + 1 AS page, n, {url(f"'{p}' || k", last, f, w)} AS e FROM (SELECT k, ts, row_number() OVER (ORDER BY k) AS n FROM ({q}) t(k, ts))" for i, (n, q, p, f, w) in enumerate(kinds))
    static = lines(*[url(f"'{p}'", [], f, w) for p, f, w in M.STATIC_PAGES])
    item = lines("'  <sitemap>'", "'    <loc>https://api.example/sitemap-' || kind || '.xml' || CASE WHEN page = 1 THEN '' ELSE '?page=' || page END || '</loc>'", "'    <lastmod>2024-01-31T00:00:00+00:00</lastmod>'", "'  </sitemap>'")
    return f"""WITH e AS ({pages}), g AS (SELECT i, kind, page, string_agg(e, chr(10) ORDER BY n) AS body FROM e GROUP BY ALL),
      x AS (SELECT 0 AS i, 'static' AS kind, 1 AS page UNION ALL SELECT i, kind, page FROM g),
      c AS (SELECT 'sitemap-' || kind || CASE WHEN page = 1 THEN '' ELSE '-' || page END || '.xml' AS file, {file("urlset", "body")} AS content FROM g
      UNION ALL SELECT 'sitemap-static.xml', {file("urlset", static)} UNION ALL SELECT 'sitemap.xml', {file("sitemapindex", f"string_agg({item}, chr(10) ORDER BY i, page)")} FROM x)
      SELECT file, length(content) AS n_chars, sha256(content) AS sha256 FROM c"""


@R.add("k05_sitemap", _sitemap_sql())
def k05(c):
    """All files of a sitemap with pages of 2,000 addresses, as they are read back."""
    day = lambda i: F.expr(f"timestamp'2001-01-01' + make_dt_interval(cast({i} % 300 as int))")
    kinds = [
        M.Kind("parts", c.parts.where("canonical_part_id is null").select("id", day("id").alias("at")), "id", "at", "/parts", "weekly", "0.7"),
        M.Kind("cars", c.retailers.select("retailer_id", day("retailer_id").alias("at")), "retailer_id", "at", "/car-generations", "monthly", "0.6"),
        M.Kind("build-lists", c.builds, "build_id", "created_at", "/build-lists", "weekly", "0.6"),
    ]
    folder = tables.scratch(c.spark)
    M.write_sitemap(c.spark, kinds, folder, "https://site.example", "https://api.example", dt.datetime(2024, 1, 31), 2000)
    return M.read_sitemap(c.spark, folder).select("file", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


_WITH_RESERVATIONS = "(SELECT CAST(id AS VARCHAR) AS id, name, price_cents FROM parts UNION ALL SELECT '#unique#name#' || lower(name), NULL, NULL FROM parts)"


def _with_reservations(c):
    """Parts as a table holds them that also holds the reservations of their unique names."""
    none = c.parts.select(F.concat(F.lit("#unique#name#"), F.lower("name")).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("price_cents"))
    return c.parts.select(F.col("id").cast("string").alias("id"), "name", "price_cents").unionByName(none)


@R.add("s04_query_all", "SELECT part_id, price_cents FROM listings WHERE retailer_id = 3 AND price_cents BETWEEN 100000 AND 200000")
def s04(c):
    return c.listings.where("retailer_id = 3 and price_cents between 100000 and 200000").select("part_id", "price_cents").orderBy("price_cents", "part_id")


@R.add("s06_scan_page", f"SELECT id, name FROM {_WITH_RESERVATIONS} WHERE NOT starts_with(id, '#unique#') AND price_cents > 90500 AND id > '12' ORDER BY id LIMIT 40")
def s06(c):
    return O.scan_page(_with_reservations(c).where("price_cents > 90500").select("id", "name"), "id", 40, "12")


@R.add("s07_scan_all", f"SELECT id, name, price_cents FROM {_WITH_RESERVATIONS} WHERE NOT starts_with(id, '#unique#')")
def s07(c):
    return _with_reservations(c).where(P.not_reserved("id"))


@R.add("s09_get_many", "SELECT id, name FROM parts WHERE id IN (SELECT part_id FROM lines WHERE quantity = 49)")
def s09(c):
    return L.in_use(c.parts.select("id", "name"), c.lines.where("quantity = 49"), "id", "part_id")


@R.add("s23_alerts_of", "SELECT 'user' AS by, user_id, part_id, threshold_cents FROM alerts WHERE user_id = 7 UNION ALL SELECT 'part', user_id, part_id, threshold_cents FROM alerts WHERE part_id = 11 UNION ALL SELECT 'pair', user_id, part_id, threshold_cents FROM alerts WHERE user_id = 7 AND part_id = (SELECT min(part_id) FROM alerts WHERE user_id = 7)")
def s23(c):
    one = c.alerts.where("user_id = 7")
    pair = one.join(one.agg(F.min("part_id").alias("part_id")), "part_id", "left_semi")
    some = [("user", one), ("part", c.alerts.where("part_id = 11")), ("pair", pair)]
    a, b, d = [df.select(F.lit(k).alias("by"), "user_id", "part_id", "threshold_cents") for k, df in some]
    return a.unionByName(b).unionByName(d)


@R.add("s24_recorded_images", "SELECT url, user_id, arg_min(file_id, (new, file_id)) AS file_id FROM (SELECT url, page_id % 5 AS user_id, page_id AS file_id, 1 AS new FROM pages UNION ALL SELECT url, page_id % 5, page_id + 1000000, 0 FROM pages WHERE page_id % 3 = 0) GROUP BY ALL")
def s24(c):
    """What is stored for a url and user stays; of several new records the first counts."""
    new = c.raw("pages").groupBy("url", (F.col("page_id") % 5).alias("user_id")).agg(F.min("page_id").alias("file_id"))
    stored = c.raw("pages").where("page_id % 3 = 0").groupBy("url", (F.col("page_id") % 5).alias("user_id")).agg((F.min("page_id") + 1000000).alias("file_id"))
    return L.insert_absent(stored, new, ["url", "user_id"])


_TERM = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '  ' || upper(name) || chr(9) ELSE name || chr(10) END"


@R.add("p01_normal_term", f"SELECT id, lower(trim(coalesce({_TERM}, ''), ' ' || chr(9) || chr(10))) AS term FROM parts")
def p01(c):
    return c.parts.select("id", P.normal_term(F.expr(_TERM)).alias("term"))


@R.add("p10_live_rows", "SELECT id FROM parts WHERE id % 10 <> 0")
def p10(c):
    """The mark is set, missing or false; rows without a mark are live."""
    return c.parts.withColumn("deleted", F.when(F.col("id") % 10 == 0, True).when(F.col("id") % 10 == 1, None).otherwise(False)).where(P.live()).select("id")


@R.add("p13_flagged_users", "SELECT 'superuser' AS kind, user_id FROM users WHERE segment = 'BUILDING' AND balance_cents >= 0 UNION ALL SELECT 'service', user_id FROM users WHERE segment = 'MACHINERY'")
def p13(c):
    u = c.users.select("user_id", (F.col("segment") == "BUILDING").alias("is_superuser"), (F.col("balance_cents") < 0).alias("disabled"), (F.col("segment") == "MACHINERY").alias("is_service_account"))
    return u.where("is_superuser and not disabled").select(F.lit("superuser").alias("kind"), "user_id").unionByName(u.where("is_service_account").select(F.lit("service").alias("kind"), "user_id"))


@R.add("p14_active_alerts_newest", "SELECT part_id, max(created_at) AS created_at FROM builds JOIN lines USING (build_id) JOIN parts ON id = part_id WHERE user_id = 7 AND price_cents % 20 = 0 GROUP BY part_id")
def p14(c):
    own = c.builds.where("user_id = 7").select("build_id", "created_at").join(c.lines.select("build_id", "part_id"), "build_id")
    active = c.parts.where("price_cents % 20 = 0").select(F.col("id").alias("part_id"))
    return own.join(active, "part_id", "left_semi").groupBy("part_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "part_id")


@R.add("p15_alerts_met", "SELECT user_id, part_id, threshold_cents, price_cents FROM alerts JOIN (SELECT part_id, min(price_cents) AS price_cents FROM listings GROUP BY part_id) USING (part_id) WHERE user_id % 3 <> 0 AND threshold_cents >= price_cents")
def p15(c):
    active = c.alerts.where("user_id % 3 <> 0")
    now = c.listings.groupBy("part_id").agg(F.min("price_cents").alias("price_cents"))
    return active.join(now, "part_id").where("threshold_cents >= price_cents").select("user_id", "part_id", "threshold_cents", "price_cents")


@R.add("p17_exact_case", "SELECT s_suppkey AS generation_id, r_name AS make_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def p17(c):
    """A make is looked up in any case, but another spelling than its own finds nothing."""
    v = _vehicles(c)
    found = [v.where(P.exact_after_lookup(F.col("make_name"), n)) for n in ("ASIA", "europe")]
    return found[0].unionByName(found[1]).select(F.col("retailer_id").alias("generation_id"), "make_name")


@R.add("p18_public_users", "SELECT user_id, username, segment FROM users")
def p18(c):
    return P.public(c.users)


@R.add("p23_manufacturer_page", "SELECT name FROM (SELECT DISTINCT manufacturer AS name, lower(manufacturer) AS k FROM parts WHERE contains(lower(manufacturer), '#1')) WHERE k > 'brand#11' ORDER BY k, name LIMIT 3")
def p23(c):
    names = c.parts.select(F.col("manufacturer").alias("name")).distinct().where(P.contains("#1", "name")).select(F.lower("name").alias("k"), "name")
    return O.keyset_page(names, ["k", "name"], 3, ("brand#11", "Brand#11")).select("name")


_LABEL = "CASE WHEN category LIKE 'S%' THEN 'A ' || category WHEN category LIKE 'P%' THEN '' END"


@R.add("j12_parts_by_label", f"SELECT id FROM (SELECT id, lower(coalesce(nullif({_LABEL}, ''), category)) AS k FROM parts) ORDER BY k, id LIMIT 60")
def j12(c):
    """A category's label is its display name, or its name where it has none."""
    labels = c.parts.select("category").distinct().select("category", F.expr(_LABEL).alias("display_name"))
    df = c.parts.select("id", "category").join(labels, "category", "left")
    return df.orderBy(*O.text_key(F.coalesce(F.nullif("display_name", F.lit("")), "category")), "id").limit(60).select("id")


@R.add("l02_page_cursors", "SELECT page, k AS last_name, id AS last_id, rtrim(translate(base64(encode('{\"id\":\"' || id || '\",\"k\":\"' || k || '\"}')), '+/', '-_'), '=') AS cursor FROM (SELECT (n - 1) // 30 AS page, arg_max(name, n) AS k, arg_max(CAST(id AS VARCHAR), n) AS id FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS n FROM parts) GROUP BY 1)")
def l02(c):
    """The cursor behind each page of 30 of the parts by name, and what it is read as."""
    rows = Ordered(c.parts.select("name", "id"), ["name", "id"]).numbered("n").frame()
    last = rows.groupBy(F.floor(F.col("n") / 30).alias("page")).agg(F.max(F.struct("n", "name", "id")).alias("x"))
    coded = last.select("page", O.cursor_text(F.col("x.name"), F.col("x.id")).alias("cursor"))
    position = O.cursor_position(F.col("cursor"))
    return coded.select("page", position["k"].alias("last_name"), position["id"].alias("last_id"), "cursor")


@R.add("s02_get_or_raise", "SELECT id, name FROM parts WHERE id IN (3, 5, 8)")
def s02(c):
    return L.get_or_raise(c.parts.select("id", "name"), [3, 5, 8, 5], "id")


@R.add("l05_single_lookup", "SELECT user_id, username FROM users WHERE lower(username) = 'customer#000000012' ORDER BY user_id LIMIT 1")
def l05(c):
    return c.users.where(F.lower("username") == "customer#000000012").select("user_id", "username").orderBy("user_id").limit(1)


@R.add("u03_changed_sets", "SELECT id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM (SELECT id, [id % 5, 5 + size % 11] AS a, [id % 5, 5 + id % 11] AS b FROM parts)")
def u03(c):
    before = F.array((F.col("id") % 5).cast("int"), (5 + F.col("size") % 11).cast("int"))
    after = F.array((F.col("id") % 5).cast("int"), (5 + F.col("id") % 11).cast("int"))
    text = lambda x: F.array_join(F.sort_array(x).cast("array<string>"), ",")
    return c.parts.select("id", text(F.array_except(after, before)).alias("added"), text(F.array_except(before, after)).alias("removed"))


_SOME = "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '' WHEN user_id % 7 = 2 THEN upper(segment) ELSE segment || user_id END"
for _down, _sql in ((False, "lower(v)"), (True, _mirror("v"))):

    @R.add(f"o01_text_key_{'desc' if _down else 'asc'}", f"SELECT user_id FROM (SELECT user_id, {_SOME} AS v FROM users) ORDER BY coalesce(v, '') = '', {_sql}, user_id LIMIT 90")
    def o01(c, down=_down):
        return c.users.select("user_id", F.expr(_SOME).alias("v")).orderBy(*O.text_key(F.col("v"), down), "user_id").limit(90).select("user_id")


@R.add("o04_compound_key", "SELECT build_id FROM (SELECT build_id, CASE WHEN status <> 'P' THEN created_at END AS t, status FROM builds) ORDER BY t NULLS LAST, status, build_id LIMIT 70")
def o04(c):
    when = F.when(F.col("status") != "P", F.col("created_at"))
    return c.builds.orderBy(*O.datetime_key(when), *O.compound_key(F.col("status")), "build_id").limit(70).select("build_id")


_LINES = """(SELECT l.build_id, l.phase, l.part_id, p.name AS part, CASE WHEN p.id % 7 <> 0 THEN manufacturer END AS part_manufacturer, CASE WHEN p.id % 5 = 0 THEN '' ELSE p.name || '-' || p.id END AS part_number,
    CASE WHEN size % 3 <> 0 THEN category END AS fit, quantity AS qty, CASE WHEN p.id % 11 <> 0 THEN price_cents * quantity END AS price FROM lines l JOIN parts p ON p.id = l.part_id)"""


def _lines(c):
    p = c.parts.select(F.col("id").alias("part_id"), F.col("name").alias("part"), "manufacturer", "category", "size", "price_cents")
    df = c.lines.drop("purchased").join(p, "part_id").withColumnRenamed("quantity", "qty")
    return df.select("build_id", "phase", "part_id", "part", F.when(F.col("part_id") % 7 != 0, F.col("manufacturer")).alias("part_manufacturer"), F.when(F.col("part_id") % 5 == 0, "").otherwise(F.concat_ws("-", "part", "part_id")).alias("part_number"), F.when(F.col("size") % 3 != 0, F.col("category")).alias("fit"), "qty", F.when(F.col("part_id") % 11 != 0, F.col("price_cents") * F.col("qty")).alias("price"))


def _line_sorted(key, down):
    value = key if O.LINE_KEYS[key] else f"nullif({key}, '')"

    @R.add(f"o06_lines_{key}_{'desc' if down else 'asc'}", f"SELECT build_id, phase, part_id FROM {_LINES} ORDER BY {value} IS NULL, {value} {'DESC' if down else ''}, part, build_id, phase, part_id LIMIT 60")
    def o06(c):
        return _lines(c).orderBy(*O.line_order(key, down), "build_id", "phase", "part_id").limit(60).select("build_id", "phase", "part_id")


for _k in O.LINE_KEYS:
    for _d in (False, True):
        _line_sorted(_k, _d)

_TABLE = """(SELECT id, name AS part, CASE WHEN id % 7 <> 0 THEN manufacturer END AS part_manufacturer, CASE WHEN id % 5 <> 0 THEN name || '-' || id END AS part_number, category, CASE WHEN size % 3 <> 0 THEN category END AS fit,
    CASE WHEN id % 13 <> 0 THEN size - 25 END AS rating, CASE WHEN id % 11 <> 0 THEN price_cents END AS price FROM parts)"""


def _table_sorted(key, down):
    none = "''" if O.TABLE_KEYS[key] == "" else "0"

    @R.add(f"o07_table_{key}_{'desc' if down else 'asc'}", f"SELECT id FROM {_TABLE} ORDER BY coalesce({key}, {none}) {'DESC' if down else ''}, id LIMIT 60")
    def o07(c):
        df = c.parts.select("id", F.col("name").alias("part"), F.when(F.col("id") % 7 != 0, F.col("manufacturer")).alias("part_manufacturer"), F.when(F.col("id") % 5 != 0, F.concat_ws("-", "name", "id")).alias("part_number"), "category", F.when(F.col("size") % 3 != 0, F.col("category")).alias("fit"), F.when(F.col("id") % 13 != 0, F.col("size") - 25).alias("rating"), F.when(F.col("id") % 11 != 0, F.col("price_cents")).alias("price"))
        return df.orderBy(*O.table_order(key, down), "id").limit(60).select("id")


for _k in O.TABLE_KEYS:
    for _d in (False, True):
        _table_sorted(_k, _d)


@R.add("o08_failure_rate", "SELECT name, rate FROM (SELECT event_type AS name, count(*) FILTER (value < 50) / count(*) AS rate FROM events GROUP BY 1) ORDER BY rate DESC, name")
def o08(c):
    rate = (F.count_if(F.col("value") < 50) / F.count("*")).alias("rate")
    return c.raw("events").groupBy(F.col("event_type").alias("name")).agg(rate).orderBy(F.desc("rate"), "name")


@R.add("o08_featured", "SELECT entity_id, count(*) FILTER (vote_type IN ('upvote', 'downvote')) AS total_votes FROM ballots_latest GROUP BY 1 ORDER BY total_votes DESC, entity_id LIMIT 20")
def o08_featured(c):
    from stockwright.operators import votes as V

    t = V.tally(V.latest(c.ballots)).select("entity_id", (F.col("upvotes") + F.col("downvotes")).alias("total_votes"))
    return t.orderBy(F.desc("total_votes"), "entity_id").limit(20)


_ACTIVITY = "CASE user_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'stalled' WHEN 2 THEN 'active' WHEN 3 THEN 'queued' ELSE 'idle' END"


@R.add("o08_activity", f"SELECT user_id, activity FROM (SELECT user_id, username, {_ACTIVITY} AS activity FROM users) ORDER BY list_position(['active', 'idle', 'stalled', 'queued', 'done'], activity), username LIMIT 80")
def o08_activity(c):
    df = c.users.select("user_id", "username", F.expr(_ACTIVITY).alias("activity"))
    return df.orderBy(*O.activity_order(F.col("activity"), F.col("username"))).limit(80).select("user_id", "activity")


@R.add("o08_generations", "SELECT retailer_id, 1980 + retailer_id % 17 AS start_year FROM retailers ORDER BY start_year, retailer_name")
def o08_generations(c):
    return c.retailers.select("retailer_id", (1980 + F.col("retailer_id") % 17).alias("start_year"), "retailer_name").orderBy("start_year", "retailer_name").drop("retailer_name")


@R.add("a15_generations_by_count", "SELECT n_name AS model_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 ORDER BY n DESC, 1")
def a15(c):
    return _vehicles(c).where("model_name <> ''").groupBy("model_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_name")


@R.add("a25_collision_owners", "SELECT name, count(*) AS owners, array_to_string(list(id ORDER BY id)[1:10], ',') AS first_owners FROM parts GROUP BY name HAVING count(*) > 1")
def a25(c):
    return L.first_owners(c.parts, ["name"], "id").select("name", "owners", F.array_join(F.col("first_owners").cast("array<string>"), ",").alias("first_owners"))


@R.add("a26_verified_counts", "SELECT coalesce(e.name, f.name) AS name, coalesce(e.n, 0) AS expected, coalesce(f.n, 0) AS found, coalesce(e.n, 0) = coalesce(f.n, 0) AS ok FROM (SELECT manufacturer AS name, count(*) AS n FROM parts WHERE size > 5 GROUP BY 1) e FULL JOIN (SELECT manufacturer AS name, count(*) AS n FROM parts WHERE canonical_part_id IS NULL AND size > 5 GROUP BY 1) f ON f.name = e.name")
def a26(c):
    n = lambda df: df.where("size > 5").groupBy(F.col("manufacturer").alias("name")).agg(F.count("*").alias("n"))
    return A.verified_counts(n(c.parts), n(c.parts.where("canonical_part_id is null")))


@R.add("a30_crawl_rates", "SELECT user_id, CAST(CASE WHEN t > 0 THEN least(100, floor(p / t * 100 + 0.5)) ELSE 0 END AS BIGINT) AS percent, r AS per_minute, CAST(CASE WHEN r > 0 AND t > p THEN floor((t - p) / r * 60 + 0.5) ELSE 0 END AS BIGINT) AS eta_seconds FROM (SELECT *, CAST(CASE WHEN s > 0 THEN floor(p / s * 60 + 0.5) ELSE 0 END AS BIGINT) AS r FROM (SELECT user_id, 1000 * count(*) FILTER (event_type <> 'error') AS p, 1000 * count(*) AS t, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) // 60 AS s FROM events GROUP BY 1))")
def a30(c):
    took = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6)
    per = c.raw("events").groupBy("user_id").agg((1000 * F.count_if(F.col("event_type") != "error")).alias("p"), (1000 * F.count("*")).alias("t"), took.alias("s"))
    return per.select("user_id", A.crawl_rates(F.col("p"), F.col("t"), F.expr("s div 60")).alias("r")).select("user_id", "r.*")


_BEFORE = "SELECT 'name' AS label, lower(name) || '-' || id AS value, id AS owner FROM parts UNION ALL SELECT 'slug', 's' || id, id FROM parts"
_AFTER = "SELECT 'name' AS label, CASE WHEN id % 5 = 0 THEN lower(name) || '-' || (id + 1) WHEN id % 5 = 1 THEN 'new-' || id ELSE lower(name) || '-' || id END AS value, id AS owner FROM parts WHERE id % 7 <> 0 UNION ALL SELECT 'slug', CASE WHEN id % 10 < 2 THEN 't' || id ELSE 's' || id END, id FROM parts WHERE id % 7 <> 0"
_CLAIMS = """WITH b AS ({before}), a AS ({after}), w AS (SELECT * FROM a EXCEPT SELECT * FROM b), r AS (SELECT * FROM b EXCEPT SELECT * FROM a),
  c AS (SELECT w.*, coalesce(b.owner <> w.owner, false) OR w.owner <> min(w.owner) OVER (PARTITION BY w.label, w.value) AS taken FROM w LEFT JOIN b USING (label, value)), f AS (SELECT DISTINCT owner FROM c WHERE taken)
  SELECT label, value, owner, CASE WHEN taken THEN 'taken' WHEN owner IN (SELECT owner FROM f) THEN 'refused' ELSE 'claim' END AS action FROM c UNION ALL SELECT label, value, owner, CASE WHEN owner IN (SELECT owner FROM f) THEN 'refused' ELSE 'release' END FROM r"""


@R.add("m01_unique_claims", _CLAIMS.format(before=_BEFORE, after=_AFTER))
def m01(c):
    label, name, slug = F.lit("name").alias("label"), F.lower("name"), F.lit("slug").alias("label")
    owner = F.col("id").alias("owner")
    at = lambda k: F.concat(name, F.lit("-"), (F.col("id") + k).cast("string"))
    before = c.parts.select(label, at(0).alias("value"), owner).unionByName(c.parts.select(slug, F.concat(F.lit("s"), "id").alias("value"), owner))
    left, turn = c.parts.where("id % 7 <> 0"), F.col("id") % 5
    renamed = F.when(turn == 0, at(1)).when(turn == 1, F.concat(F.lit("new-"), "id")).otherwise(at(0))
    moved = F.concat(F.when(F.col("id") % 10 < 2, "t").otherwise("s"), "id")
    return L.claims(before, before, left.select(label, renamed.alias("value"), owner).unionByName(left.select(slug, moved.alias("value"), owner)))


_USERS_BEFORE = "SELECT 'username' AS label, lower(username) AS value, user_id AS owner FROM users UNION ALL SELECT 'email', lower(username) || '@x.org', user_id FROM users"
_USERS_AFTER = "SELECT 'username' AS label, CASE WHEN user_id % 10 = 1 THEN 'renamed' || user_id ELSE lower(username) END AS value, user_id AS owner FROM users WHERE user_id % 10 <> 0 UNION ALL SELECT 'email', lower(username) || '@x.org', user_id FROM users WHERE user_id % 10 <> 0 UNION ALL SELECT 'username', CASE k WHEN 0 THEN 'customer#000000005' ELSE 'created' || k END, 9000000000 + k FROM range(4) t(k) UNION ALL SELECT 'email', 'c' || k || '@x.org', 9000000000 + k FROM range(4) t(k)"


@R.add("m03_user_reservations", _CLAIMS.format(before=_USERS_BEFORE, after=_USERS_AFTER))
def m03(c):
    """Users are created, one of them under a name that is held, renamed and deleted."""
    def held(u, name, mail):
        return u.select(F.lit("username").alias("label"), name.alias("value"), F.col("user_id").alias("owner")).unionByName(u.select(F.lit("email").alias("label"), mail.alias("value"), F.col("user_id").alias("owner")))

    name, mail = F.lower("username"), F.concat(F.lower("username"), F.lit("@x.org"))
    left = c.users.where("user_id % 10 <> 0")
    new = c.spark.range(4).select("id", (F.col("id") + 9000000000).alias("user_id"))
    created = held(new, F.when(F.col("id") == 0, "customer#000000005").otherwise(F.concat(F.lit("created"), "id")), F.concat(F.lit("c"), "id", F.lit("@x.org")))
    return L.claims(held(c.users, name, mail), held(c.users, name, mail), held(left, F.when(F.col("user_id") % 10 == 1, F.concat(F.lit("renamed"), "user_id")).otherwise(name), mail).unionByName(created))


@R.add("m06_part_purge", "SELECT 'parts deleted' AS name, count(*) AS n FROM parts WHERE id % 10 = 0 UNION ALL SELECT 'duplicates', count(*) FROM parts WHERE canonical_part_id IS NOT NULL AND canonical_part_id % 10 <> 0 UNION ALL SELECT 'listings', count(*) FROM listings WHERE part_id NOT IN (SELECT id FROM parts WHERE id % 10 = 0) UNION ALL SELECT 'history', count(*) FROM history WHERE part_id NOT IN (SELECT id FROM parts WHERE id % 10 = 0) UNION ALL SELECT 'cars', count(*) FROM parts WHERE id % 10 <> 0")
def m06(c):
    cars = c.parts.select(F.col("id").alias("part_id"), (F.col("size") % 11).alias("car_id"))
    left = L.purged(c.parts, {"listings": (c.listings, "part_id"), "history": (c.history, "part_id"), "cars": (cars, "part_id")}, c.parts.where("id % 10 = 0"))
    parts = left.pop("parts")
    some = [("parts deleted", parts.where("deleted")), ("duplicates", parts.where("canonical_part_id is not null")), *left.items()]
    return _counted(some)


@R.add("m08_bulk_reset", """SELECT 'makes' AS name, count(*) AS before, 0 AS "left", 0 AS cleared, 0 AS sum FROM region UNION ALL SELECT 'models', count(*), 0, 0, 0 FROM nation UNION ALL SELECT 'generations', count(*), 0, 0, 0 FROM supplier
    UNION ALL SELECT 'votes', count(*), count(*) FILTER (entity_id NOT IN (SELECT s_suppkey FROM supplier)), 0, CAST(coalesce(sum(event_id) FILTER (entity_id NOT IN (SELECT s_suppkey FROM supplier)), 0) AS BIGINT) FROM ballots
    UNION ALL SELECT 'builds', count(*), count(*), count(*) FILTER (build_id % 40 + 1 IN (SELECT s_suppkey FROM supplier)), CAST(sum(build_id) AS BIGINT) FROM builds
    UNION ALL SELECT 'makers', count(DISTINCT manufacturer), 0, 0, 0 FROM parts UNION ALL SELECT 'parts', count(*), count(*), count(manufacturer), CAST(sum(id) AS BIGINT) FROM parts""")
def m08(c):
    """All makes go, and with them models, generations and votes on these, while build lists lose their car; then all makers of parts go."""
    vehicles = {
        "makes": C.Table(c.raw("region").select("r_regionkey"), ("r_regionkey",)), "models": C.Table(c.raw("nation").select("n_nationkey", "n_regionkey"), ("n_nationkey",)), "generations": C.Table(c.retailers.select("retailer_id", "model_id"), ("retailer_id",)),
        "votes": C.Table(c.ballots.select("event_id", "entity_id"), ("event_id",)), "builds": C.Table(c.builds.select("build_id", (F.col("build_id") % 40 + 1).alias("car_id")), ("build_id",)),
    }
    graph = [C.Reference("models", "n_regionkey", "makes"), C.Reference("generations", "model_id", "models"), C.Reference("votes", "entity_id", "generations"), C.Reference("builds", "car_id", "generations", clears=True)]
    one = C.Cascade(vehicles, graph, tables.scratch(c.spark))
    makers = {"makers": C.Table(c.parts.select("manufacturer").where("manufacturer is not null").distinct(), ("manufacturer",)), "parts": C.Table(c.parts.select("id", "manufacturer"), ("id",))}
    two = C.Cascade(makers, [C.Reference("parts", "manufacturer", "makers", clears=True)], tables.scratch(c.spark))
    a = one.report(one.run("makes", vehicles["makes"].rows), {"votes": F.col("event_id"), "builds": F.col("build_id")})
    return a.unionByName(two.report(two.run("makers", makers["makers"].rows), {"parts": F.col("id")}))


def _counted(some):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in some])


@R.add("s25_relational", "SELECT id, name, upper(md5(CAST(id AS VARCHAR))) AS code FROM parts WHERE price_cents >= 90500 AND size < 40")
def s25(c):
    """Parts with a binary column go into embedded databases, one for each range of ids, and come back from there, filtered by them."""
    parts = c.parts.select("id", "name", "price_cents", "size", F.unhex(F.md5(F.col("id").cast("string"))).alias("code"))
    back = tables.from_databases(tables.to_databases(parts, "id", "parts"), "parts", "id long, name string, code binary", "price_cents >= 90500 AND size < 40")
    return back.select("id", "name", F.hex("code").alias("code"))


@R.add("s26_json_seed", "SELECT r_name AS make, n_name AS model, s_name AS generation, CAST(1980 + s_suppkey % 17 AS INTEGER) AS start_year FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def s26(c):
    """Vehicles are written as seed files, one for each make, and read from there."""
    return tables.json_seed(c.spark, _seed_files(c)).select("make", "model", "generation", "start_year")


@R.add("f27_flattened_seed", "SELECT r_name AS make, n_name AS model, s_name AS generation, CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name END AS description, CASE WHEN s_suppkey % 3 = 0 THEN 'own-' || s_suppkey ELSE trim(regexp_replace(lower(r_name || ' ' || n_name || ' ' || s_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def f27(c):
    return tables.json_seed(c.spark, _seed_files(c)).select("make", "model", "generation", "description", "slug")


def _seed_files(c):
    v = c.retailers.join(c.raw("nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("model"), F.col("n_regionkey").alias("k")), "model_id")
    v = v.join(c.raw("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("make")), "k")
    even, third = F.col("retailer_id") % 2 == 0, F.col("retailer_id") % 3 == 0
    item = F.struct(F.col("retailer_name").alias("name"), (1980 + F.col("retailer_id") % 17).cast("int").alias("start_year"), F.when(even, F.concat(F.lit("about "), "retailer_name")).alias("description"), F.when(third, F.concat(F.lit("own-"), "retailer_id")).alias("slug"))
    models = v.groupBy("make", "model").agg(F.collect_list(item).alias("generations"))
    makes = models.groupBy("make").agg(F.collect_list(F.struct(F.col("model").alias("name"), "generations")).alias("models"))
    path = f"{tables.scratch(c.spark)}/makes"
    makes.write.option("maxRecordsPerFile", 1).json(path)
    return path


@R.add("s27_csv_stats", "SELECT type, name, CAST(count(*) AS DOUBLE) AS requests, CAST(count(*) FILTER (value > 200) AS DOUBLE) AS failures FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS type, '/' || event_type AS name, value FROM events) WHERE type = 'GET' GROUP BY ALL")
def s27(c):
    """Statistics are written as CSV with a header, a row of totals without numbers among them, and read from there."""
    e = c.raw("events").select(F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST").alias("Type"), F.concat(F.lit("/"), "event_type").alias("Name"), "value")
    rows = e.groupBy("Type", "Name").agg(F.count("*").cast("string").alias("Request Count"), F.count_if(F.col("value") > 200).cast("string").alias("Failure Count"))
    total = c.spark.range(1).select(F.lit("").alias("Type"), F.lit("Aggregated").alias("Name"), F.lit("N/A").alias("Request Count"), F.lit("N/A").alias("Failure Count"))
    path = f"{tables.scratch(c.spark)}/stats"
    rows.unionByName(total).write.csv(path, header=True)
    found = tables.load_stats(c.spark, path).where("Type = 'GET'")
    return found.select(F.col("Type").alias("type"), F.col("Name").alias("name"), tables.number_in("Request Count").alias("requests"), tables.number_in("Failure Count").alias("failures"))


@R.add("f25_utc_micros", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def f25(c):
    return c.raw("events").select("event_id", tables.utc_micros("ts").alias("micros"))
