"""Queries for text functions, identity resolution, pages, classes and scores."""

from pyspark.sql import functions as F

from stockwright.functions import html as H
from stockwright.functions import text as T
from stockwright.operators import analysis as A
from stockwright.plans.registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@R.add("f01_slug", "SELECT id, trim(regexp_replace(lower(name || ' / ' || manufacturer), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM parts")
def f01(c):
    return c.parts.select("id", T.slug(F.concat_ws(" / ", "name", "manufacturer")).alias("slug"))


_ENDINGS = ", ".join(f"'{w}'" for w in T.NAME_ENDINGS)
_NAMES = "CASE WHEN id % 5 = 0 THEN manufacturer || ' ' || {0} || ', Inc.' WHEN id % 5 = 1 THEN 'Group ' || upper({0}) WHEN id % 5 = 2 THEN {0} || ' ' || manufacturer WHEN id % 5 = 3 THEN {0} ELSE manufacturer END"
_NAMES_SQL = _NAMES.format(f"list_value({_ENDINGS})[id % {len(T.NAME_ENDINGS)} + 1]")
_NAMES_SPARK = _NAMES.format(f"array({_ENDINGS})[id % {len(T.NAME_ENDINGS)}]")


@R.add("f02_manufacturer_key", f"SELECT id, regexp_replace(regexp_replace(' ' || lower({_NAMES_SQL}), '(?:[^a-z0-9]+(?:{'|'.join(T.NAME_ENDINGS)}))+[^a-z0-9]*$', ''), '[^a-z0-9]', '', 'g') AS key FROM parts")
def f02(c):
    return c.parts.select("id", T.manufacturer_key(F.expr(_NAMES_SPARK)).alias("key"))


_SHOWN = ("SKU : ", "part # :", "Part Number: ", "ITEM#:", "Product Code: ", "Model #: ", "model:", "Code: ", "#", "SKU: Code:", "")
_CODES = ", ".join(f"'{w}'" for w in T.VEHICLE_CODES)
_RAW = "CASE WHEN id % 4 = 3 THEN {0} || upper({1}) || CASE WHEN id % 8 = 3 THEN ' ' ELSE '' END WHEN id % 20 = 0 THEN ' ' || {0} ELSE ' ' || {0} || name || ' - ' || id END"
_RAW_SQL = _RAW.format(f"list_value({', '.join(repr(x) for x in _SHOWN)})[id % {len(_SHOWN)} + 1]", f"list_value({_CODES})[id % {len(T.VEHICLE_CODES)} + 1]")
_RAW_SPARK = _RAW.format(f"array({', '.join(repr(x) for x in _SHOWN)})[id % {len(_SHOWN)}]", f"array({_CODES})[id % {len(T.VEHICLE_CODES)}]")
_STRIP = f"trim({_RAW_SQL})"
for _l in T.NUMBER_LABELS:
    _STRIP = f"regexp_replace({_STRIP}, '(?i)^{_l}', '')"
_STRIP = f"nullif(trim({_STRIP}), '')"
_NUMBER = f"CASE WHEN lower(regexp_replace(s, '\\s+', '', 'g')) NOT IN ({_CODES}) THEN s END"


@R.add("f03_part_number", f"SELECT id, {_STRIP} AS number FROM parts")
def f03(c):
    return c.parts.select("id", T.part_number(F.expr(_RAW_SPARK)).alias("number"))


@R.add("f04_part_number_rejected", f"SELECT id, {_NUMBER} AS number FROM (SELECT id, {_STRIP} AS s FROM parts)")
def f04(c):
    return c.parts.select("id", T.part_number(F.expr(_RAW_SPARK), reject=T.VEHICLE_CODES).alias("number"))


@R.add("f05_part_number_key", f"SELECT id, CASE WHEN length(k) >= 4 AND lower(k) NOT IN ({_CODES}) THEN k END AS key FROM (SELECT id, upper(regexp_replace({_NUMBER}, '[^A-Za-z0-9]', '', 'g')) AS k FROM (SELECT id, {_STRIP} AS s FROM parts))")
def f05(c):
    return c.parts.select("id", T.part_number_key(F.expr(_RAW_SPARK), T.VEHICLE_CODES, labels=T.NUMBER_LABELS).alias("key"))


@R.add("f06_gtin", "SELECT id, nullif(regexp_replace('GTIN ' || id || '-' || size, '[^0-9]', '', 'g'), '') AS gtin FROM parts")
def f06(c):
    return c.parts.select("id", T.gtin(F.concat(F.lit("GTIN "), F.col("id"), F.lit("-"), F.col("size"))).alias("gtin"))


@R.add("f07_price_cents", "SELECT id, CAST(round_even(CAST(regexp_extract(regexp_replace('$ ' || (price_cents // 100) || '.' || (id % 10) || '25 each', '[$,\\s]', '', 'g'), '\\d+\\.?\\d*', 0) AS DOUBLE) * 100, 0) AS BIGINT) AS cents FROM parts")
def f07(c):
    shown = F.concat(F.lit("$ "), F.expr("price_cents div 100"), F.lit("."), F.col("id") % 10, F.lit("25 each"))
    return c.parts.select("id", T.price_cents(shown).alias("cents"))


_ODD_URL = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN split_part(url, '?', 1) || '?b=1&a=2%20x&b=3&Ref=x&source=y&GCLSRC=1&c=#top' WHEN 2 THEN substr(url, instr(url, '//')) WHEN 3 THEN 'HTTPS://Shop.Example.COM/?utm_term=1&&q=a+b%26' ELSE 'shop/' || page_id || '?dclid=1&x=%C3%A9&twclid=2' END"
_DROP = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'gclsrc', 'dclid', 'msclkid', 'twclid', 'ref', 'source'"
_ENCODED = "replace(url_encode({0}), '%20', '+')"


@R.add(
    "f09_canonical_url",
    f"""WITH u AS (SELECT page_id, {_ODD_URL} AS url FROM pages), x AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS x, generate_subscripts(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), 1) AS i FROM u),
    kv AS (SELECT page_id, i, url_decode(replace(regexp_extract(x, '^[^=]*'), '+', ' ')) AS k, url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')) AS v FROM x WHERE x <> ''),
    f AS (SELECT *, min(i) OVER (PARTITION BY page_id, k) AS place FROM kv WHERE lower(k) NOT IN ({_DROP})),
    q AS (SELECT page_id, '?' || string_agg({_ENCODED.format("k")} || '=' || {_ENCODED.format("v")}, '&' ORDER BY place, i) AS q FROM f GROUP BY page_id),
    p AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), ''), 'https') AS s, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS h, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM u)
    SELECT page_id, s || '://' || h || CASE WHEN p = '/' THEN '' WHEN h = '' AND NOT starts_with(p, '/') THEN '/' || p ELSE p END || coalesce(q, '') AS canonical FROM p LEFT JOIN q USING (page_id)""",
)
def f09(c):
    return c.raw("pages").select("page_id", T.canonical_url(F.expr(_ODD_URL)).alias("canonical"))


_IMAGE = "CASE id % 4 WHEN 0 THEN 'http://WWW.img.example.com/a' || id || '.jpg?width=416&v=' || size || '&W=3' WHEN 1 THEN 'https://cdn.example.com?h=2&format=webp' WHEN 2 THEN '/relative/' || id || '?w=1' ELSE ' https://cdn.example.com/b' || id || '?v=&Quality=8&x=1 ' END"


@R.add("f11_image_url", "SELECT id, CASE id % 4 WHEN 0 THEN 'https://img.example.com/a' || id || '.jpg?v=' || size WHEN 1 THEN 'https://cdn.example.com/' WHEN 2 THEN '/relative/' || id || '?w=1' ELSE 'https://cdn.example.com/b' || id || '?x=1' END AS image FROM parts")
def f11_image(c):
    return c.parts.select("id", T.image_url(F.expr(_IMAGE)).alias("image"))


@R.add("f12_large_image_url", "SELECT id, CASE id % 4 WHEN 0 THEN 'https://www.img.example.com/a' || id || '.jpg?v=' || size || '&width=5760' WHEN 1 THEN 'https://cdn.example.com/?width=5760' WHEN 2 THEN '/relative/' || id || '?w=1' ELSE 'https://cdn.example.com/b' || id || '?v=&x=1&width=5760' END AS image FROM parts")
def f12(c):
    return c.parts.select("id", T.image_url(F.expr(_IMAGE), T.LARGE_WIDTH).alias("image"))


@R.add("f13_images_to_fetch", "SELECT id, 'https://cdn.example.com/a' || (id % 9) || '?width=5760' AS image FROM parts WHERE id % 9 <> 0 UNION ALL SELECT id, 'https://cdn.example.com/b?v=' || size || '&width=5760' FROM parts")
def f13(c):
    """Of the images of a part the widest of each canonical address, if that isn't cached."""
    base = F.concat(F.lit("https://cdn.example.com/a"), F.col("id") % 9)
    urls = F.array(F.concat(base, F.lit("?width=100")), F.concat(base, F.lit("?width=900")), F.concat(F.lit("https://cdn.example.com/b?width=5&v="), "size"))
    cached = c.spark.range(1).select(F.lit("https://cdn.example.com/a0").alias("canonical"))
    return A.images_to_fetch(c.parts.select("id", urls.alias("urls")), cached, "id", "urls")


_LINK = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' ' || replace(url, 'https://', 'HTTP://') || '/' WHEN 2 THEN replace(url, 'https://', 'ftp://') WHEN 3 THEN 'not-a-url' WHEN 4 THEN 'https://Shop.Example.COM' ELSE 'https:///nohost/' || page_id END"
_KEYED = "regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)', {})"


@R.add("f10_url_key", f"SELECT page_id, CASE WHEN h <> '' THEN CASE WHEN s IN ('http', 'https') THEN 'http' ELSE s END || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END END AS key FROM (SELECT page_id, lower({_KEYED.format(1)}) AS s, lower({_KEYED.format(2)}) AS h, {_KEYED.format(3)} AS p FROM (SELECT page_id, trim({_LINK}) AS u FROM pages))")
def f10(c):
    return c.raw("pages").select("page_id", T.url_key(F.expr(_LINK)).alias("key"))


@R.add("f31_ages_and_prices", "SELECT id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END || ' ago' WHEN s IS NULL THEN '-' ELSE (s // 3600) || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || (s // 60 % 60) || 'm' ELSE '' END || ' ago' END AS age, CASE WHEN c < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS price FROM (SELECT id, CASE WHEN id % 7 <> 0 THEN greatest(id * id % 20011 - 100, 0) END AS s, price_cents * (size - 5) AS c FROM parts)")
def f31(c):
    seconds = F.when(F.col("id") % 7 != 0, F.col("id") * F.col("id") % 20011 - 100)
    return c.parts.select("id", T.age(seconds).alias("age"), T.dollars(F.col("price_cents") * (F.col("size") - 5)).alias("price"))


@R.add("f29_byte_keys", "SELECT id, k AS key, name AS back FROM (SELECT id, name, rtrim(translate(base64(encode(name)), '+/', '-_'), '=') AS k FROM parts)")
def f29(c):
    key = T.base64url(F.col("name").cast("binary"))
    return c.parts.select("id", key.alias("key")).select("id", "key", T.from_base64url(F.col("key")).cast("string").alias("back"))


@R.add("f11_bare_host", f"SELECT page_id, ltrim({_HOST}, 'w.') AS host FROM pages")
def f11(c):
    return c.raw("pages").select("page_id", T.bare_host(F.col("url")).alias("host"))


@R.add("f14_sites", f"SELECT {_HOST} AS domain, count(*) AS n FROM pages GROUP BY 1")
def f14(c):
    return c.raw("pages").groupBy(T.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@R.add("f15_html_fingerprint", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def f15(c):
    return c.raw("pages").select("page_id", T.fingerprint(F.col("html")).alias("f")).select("page_id", "f.bytes", "f.sha256")


@R.add("f19_page_title", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def f19(c):
    return c.raw("pages").select("page_id", H.title_of(F.col("html")).alias("title"))


@R.add("f16_cleaned_page", "SELECT page_id, regexp_replace(html, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', '', 'g') AS html FROM pages")
def f16(c):
    return c.raw("pages").select("page_id", H.cleaned_page("html").alias("html"))


def _parsed(df, html, url):
    """(id, name, description, images, brand, part_number, price_cents, source) of pages (id, ...)."""
    p = df.select("id", H.parsed_page(html, url).alias("p")).select("id", "p.*")
    return p.select("id", "name", "description", F.array_join("images", " ").alias("images"), "brand", T.part_number(F.col("sku"), reject=T.VEHICLE_CODES).alias("part_number"), "price_cents", "source")


_UNESCAPED = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_TITLE = _UNESCAPED.format("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")
_VISIBLE = _UNESCAPED.format("regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")
_SHOWN = f"regexp_extract({_VISIBLE}, '(?:From\\s*)?\\$[\\s,]?(\\d+\\.?\\d*)', 1)"


@R.add("f20_parsed_page", f"SELECT page_id AS id, nullif({_TITLE}, '') AS name, NULL AS description, NULL AS images, NULL AS brand, NULL AS part_number, CASE WHEN {_TITLE} <> '' THEN CAST(round(CAST(nullif({_SHOWN}, '') AS DOUBLE) * 100) AS BIGINT) END AS price_cents, CASE WHEN {_TITLE} <> '' THEN 'page' END AS source FROM pages")
def f20(c):
    return _parsed(c.raw("pages").withColumnRenamed("page_id", "id"), F.col("html"), F.col("url"))


_BLOCK = """'<title>page ' || id || '</title><meta property="og:description" content="not this description"><script type="application/ld+json">' || CASE id % 6
  WHEN 0 THEN '{"@graph":[{"@type":"Thing","name":"no"},{"@type":["Thing","Product"],"name":"' || name || '","brand":{"name":"' || manufacturer || '"},"sku":"SKU: N-' || id || '","offers":[{"price":"1,200.50"}],"image":["u1",{"url":"u2"}],"description":"a  long <b>description</b> of ' || name || '"}]}'
  WHEN 1 THEN '[{"@type":"Product","name":"other","url":"https://x.example/other"},{"@type":"product","name":"' || name || '","url":"http://X.example/p/' || id || '/","brand":"' || manufacturer || '","offers":{"price":0,"lowPrice":' || size || '}}]'
  WHEN 2 THEN '{"@type":"Product","name":"' || name || '","offers":{"url":"https://x.example/elsewhere"}}'
  WHEN 3 THEN '{broken'
  WHEN 4 THEN '{"@type":"Product","name":"tab' || chr(9) || 'inside","mpn":"M' || id || '","description":"short"}'
  ELSE '{"@type":"Product","name":"  ","price":1}' END || '</script><p>now $12.50 only'"""


@R.add("f17_json_ld_product", "SELECT id, CASE WHEN id % 6 IN (0, 1) THEN name WHEN id % 6 = 4 THEN 'tab' || chr(9) || 'inside' ELSE 'page ' || id END AS name, CASE WHEN id % 6 IN (0, 1, 4) THEN 'product' ELSE 'page' END AS source FROM parts")
def f17(c):
    return _blocks(c).select("id", "name", "source")


@R.add("f18_json_ld_fields", "SELECT id, CASE id % 6 WHEN 0 THEN 'a long description of ' || name WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE 'not this description' END AS description, CASE WHEN id % 6 = 0 THEN 'u1 u2' END AS images, CASE WHEN id % 6 IN (0, 1) THEN manufacturer END AS brand, CASE id % 6 WHEN 0 THEN 'N-' || id WHEN 4 THEN 'M' || id END AS part_number, CAST(CASE id % 6 WHEN 0 THEN 120050 WHEN 1 THEN nullif(size, 0) * 100 WHEN 4 THEN NULL ELSE 1250 END AS BIGINT) AS price_cents FROM parts")
def f18(c):
    return _blocks(c).drop("name", "source")


def _blocks(c):
    return _parsed(c.parts, F.expr(_BLOCK), F.concat(F.lit("https://x.example/p/"), "id"))


@R.add("f08_description", "SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN name || ' & ' || category WHEN 2 THEN name || ' ' || category ELSE repeat('ab ', 666) || 'ab' END AS description FROM parts")
def f08(c):
    raw = "CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || name || '  &amp; ' || category WHEN 2 THEN '<p>' || name || '</p><script>x</script><b> ' || category || '</b>' ELSE repeat('ab ', 900) END"
    return c.parts.select("id", H.description_text(F.expr(raw)).alias("description"))


@R.add("f22_plain_text", "SELECT id, lower(trim(regexp_replace('  ' || name || '   X', '\\s+', ' ', 'g'))) AS plain FROM parts")
def f22(c):
    return c.parts.select("id", T.plain(F.concat(F.lit("  "), F.col("name"), F.lit("   X"))).alias("plain"))


@R.add("f26_image_lists", "SELECT id, array_to_string([l[2]] || list_filter(l, lambda x, i: i <> 2), ',') AS first, array_to_string(l[1:2], ',') AS two FROM (SELECT id, ['a' || id, 'b' || id, 'c' || size] AS l FROM parts)")
def f26(c):
    items = F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"), F.concat(F.lit("c"), "size"))
    df = c.parts.select("id", items.alias("l"))
    return df.select("id", F.array_join(T.to_front(F.col("l"), 1), ",").alias("first"), F.array_join(T.capped(F.col("l"), 2), ",").alias("two"))


@R.add("f28_composite_keys", "SELECT id, CASE WHEN canonical_part_id IS NOT NULL THEN manufacturer || '#' || canonical_part_id END AS key FROM parts")
def f28(c):
    return c.parts.select("id", T.composite(F.col("manufacturer"), F.col("canonical_part_id").cast("string")).alias("key"))


@R.add("f32_escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def f32(c):
    return c.raw("pages").select("page_id", T.xml_escaped(F.col("html")).alias("escaped"))


@R.add("e01_resolve_by_url", "SELECT a.page_id AS candidate_id, min(b.page_id) AS part_id FROM pages a JOIN pages b ON trim(a.url) = trim(b.url) GROUP BY 1")
def e01(c):
    by_url = c.raw("pages").groupBy(F.trim("url").alias("u")).agg(F.min("page_id").alias("part_id"))
    return c.raw("pages").select(F.col("page_id").alias("candidate_id"), F.trim("url").alias("u")).join(by_url, "u").select("candidate_id", "part_id")


@R.add("e02_resolve_by_number", "SELECT p.id, q.g AS part_id FROM parts p LEFT JOIN (SELECT manufacturer, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k, min(id) AS g FROM parts WHERE canonical_part_id IS NULL GROUP BY 1, 2) q ON q.manufacturer = p.manufacturer AND q.k = upper(regexp_replace(p.name, '[^A-Za-z0-9]', '', 'g'))")
def e02(c):
    key = T.part_number_key(F.col("name"), least=1)
    canon = c.parts.where("canonical_part_id is null").groupBy("manufacturer", key.alias("k")).agg(F.min("id").alias("part_id"))
    return c.parts.select("id", "manufacturer", key.alias("k")).join(canon, ["manufacturer", "k"], "left").select("id", "part_id")


@R.add("e04_resolve_identity", "SELECT c.id AS candidate_id, coalesce(g.x, u.x, m.x) AS part_id, len(list_distinct([g.x, u.x, m.x])) > 1 AS conflict FROM parts c LEFT JOIN (SELECT size AS k, min(id) AS x FROM parts WHERE size < 10 GROUP BY 1) g ON g.k = c.size LEFT JOIN (SELECT name AS k, min(id) AS x FROM parts GROUP BY 1) u ON u.k = c.name LEFT JOIN (SELECT manufacturer AS a, category AS b, min(id) AS x FROM parts WHERE canonical_part_id IS NULL GROUP BY 1, 2) m ON m.a = c.manufacturer AND m.b = c.category")
def e04(c):
    cand = c.parts.select(F.col("id").alias("candidate_id"), F.col("size").alias("gtin"), F.col("name").alias("url"), "manufacturer", F.col("category").alias("number"))
    return A.resolve(cand, c.parts.where("size < 10").select(F.col("size").alias("gtin"), "id"), c.parts.select(F.col("name").alias("url"), "id"), c.parts.where("canonical_part_id is null").select("manufacturer", F.col("category").alias("number"), "id"))


@R.add("e06_manufacturer_match", "SELECT p.id, coalesce(a.b, k.b) AS brand FROM (SELECT id, CASE WHEN id % 2 = 0 THEN lower(manufacturer) ELSE manufacturer || ' Inc' END AS n FROM parts) p LEFT JOIN (SELECT lower(manufacturer) AS l, min(manufacturer) AS b FROM parts GROUP BY 1) a ON a.l = lower(p.n) LEFT JOIN (SELECT regexp_replace(lower(manufacturer), '[^a-z0-9]', '', 'g') AS k, min(manufacturer) AS b FROM parts GROUP BY 1) k ON k.k = regexp_replace(regexp_replace(' ' || lower(p.n), '(?:[^a-z0-9]+(?:inc|llc|co|company|group))+[^a-z0-9]*$', ''), '[^a-z0-9]', '', 'g')")
def e06(c):
    n = F.when(F.col("id") % 2 == 0, F.lower("manufacturer")).otherwise(F.concat("manufacturer", F.lit(" Inc")))
    p = c.parts.select("id", F.lower(n).alias("l"), T.manufacturer_key(n).alias("k"))
    exact = c.parts.groupBy(F.lower("manufacturer").alias("l")).agg(F.min("manufacturer").alias("a"))
    by_key = c.parts.groupBy(T.manufacturer_key(F.col("manufacturer")).alias("k")).agg(F.min("manufacturer").alias("b"))
    return p.join(exact, "l", "left").join(by_key, "k", "left").select("id", F.coalesce("a", "b").alias("brand"))


_KEYWORDS = (("colour", 0, "red"), ("colour", 0, "blue"), ("fixing", 1, "bolt"), ("fixing", 1, "hot gear"), ("plain", 2, "small"), ("plain", 2, "economy"), ("gizmo", 3, "gizmo"), ("wheels", 4, "gear"))
_EXCEPT = (("fixing", ("bolt",), ("small bolt", "standard")), ("wheels", ("gear",), ("cold gear",)))
_SCORED = " + ".join(f"CASE WHEN regexp_matches(lower(p.{c}), '\\b' || kw || '\\b') THEN {w} ELSE 0 END" for c, w in (("category", 2), ("name", 1)))
_SPARED = " ".join(f"WHEN kw.category = '{k}' AND kw IN ({', '.join(map(repr, words))}) AND ({' OR '.join(f"contains(lower(p.category || ' ' || p.name), '{x}')" for x in phrases)}) THEN 0" for k, words, phrases in _EXCEPT)


@R.add("f21_category", "WITH kw AS (SELECT * FROM (VALUES " + ", ".join(map(str, _KEYWORDS)) + f") v(category, place, kw)), s AS (SELECT id, kw.category, place, sum(CASE {_SPARED} ELSE {_SCORED} END) AS score FROM parts p, kw GROUP BY ALL HAVING score > 0) SELECT p.id, coalesce(b.c, 'other') AS category FROM parts p LEFT JOIN (SELECT id, arg_max(category, (score, -place)) AS c FROM s GROUP BY id) b USING (id)")
def f21(c):
    items = c.parts.select("id", F.col("category").alias("title"), F.col("name").alias("body"))
    return A.classify(items, _KEYWORDS, "id", "title", "body", exceptions=_EXCEPT)


@R.add("a24_micro_scores", "WITH p AS (SELECT build_id, part_id, count(*) AS n FROM lines WHERE purchased GROUP BY ALL), t AS (SELECT build_id, part_id, count(*) AS n FROM lines WHERE quantity > 10 GROUP BY ALL), s AS (SELECT (SELECT CAST(sum(least(p.n, t.n)) AS BIGINT) FROM p JOIN t USING (build_id, part_id)) AS tp, (SELECT sum(n) FROM p) AS np, (SELECT sum(n) FROM t) AS nt, (SELECT count(DISTINCT build_id) FROM (SELECT build_id FROM p UNION ALL SELECT build_id FROM t)) AS k) SELECT k AS sample_size, tp AS true_positives, tp / np AS precision, tp / nt AS recall, 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS f1 FROM s")
def a24(c):
    return A.micro_score(c.lines.where("purchased").select("build_id", "part_id"), c.lines.where("quantity > 10").select("build_id", "part_id"), "build_id", ["part_id"])


_GTIN = "CASE WHEN id % 3 = 0 THEN 'GTIN-' || (id // 4) WHEN id % 3 = 1 THEN CAST(id // 4 AS VARCHAR) END"


@R.add("e03_resolve_by_gtin", f"WITH s AS (SELECT id, {_GTIN} AS g, nullif(regexp_replace({_GTIN}, '[^0-9]', '', 'g'), '') AS k FROM parts WHERE canonical_part_id IS NULL) SELECT p.id AS candidate_id, (SELECT arg_min(s.id, (s.g <> s.k, s.id)) FROM s WHERE s.k = CAST(p.id // 3 AS VARCHAR)) AS part_id FROM parts p")
def e03(c):
    stored = c.parts.select("id", F.expr(_GTIN.replace("//", "div").replace("VARCHAR", "STRING")).alias("gtin"), "canonical_part_id")
    asked = c.parts.select(F.col("id").alias("candidate_id"), F.concat(F.lit(" EAN "), F.expr("id div 3")).alias("gtin"))
    return A.by_gtin(asked, stored)


@R.add("e05_own_part_at_url", "SELECT a.page_id AS candidate_id, min(b.page_id) AS part_id FROM pages a LEFT JOIN pages b ON a.url = b.url AND b.page_id % 4 = a.page_id % 3 AND b.page_id % 2 = 0 GROUP BY 1")
def e05(c):
    asked = c.raw("pages").select(F.col("page_id").alias("candidate_id"), (F.col("page_id") % 3).alias("user_id"), F.concat(F.lit(" "), "url").alias("url"))
    listed = c.raw("pages").where("page_id % 2 = 0").select("url", (F.col("page_id") % 4).alias("user_id"), F.col("page_id").alias("id"))
    return A.owned_by_url(asked, listed)


_DOMAIN = "CASE WHEN retailer_id % 3 = 0 THEN 'shop' || retailer_id || '.com' WHEN retailer_id % 3 = 1 THEN 'www.shop' || retailer_id || '.com' END"


@R.add("e07_retailer_match", f"WITH r AS (SELECT retailer_id, lower(retailer_name) AS n, {_DOMAIN} AS d FROM retailers), c AS (SELECT id, lower('SUPPLIER#' || lpad(CAST(id % 15 AS VARCHAR), 9, '0')) AS n, CASE WHEN id % 4 <> 3 THEN 'www.shop' || (id % 12) || '.com' END AS d FROM parts), m AS (SELECT c.id, coalesce((SELECT min(retailer_id) FROM r WHERE r.d = c.d), (SELECT min(retailer_id) FROM r WHERE r.d = substr(c.d, 5))) AS a, (SELECT min(retailer_id) FROM r WHERE r.n = c.n) AS b, c.d FROM c) SELECT m.id AS candidate_id, coalesce(a, b) AS retailer_id, CASE WHEN coalesce(a, b) IS NULL THEN 'created' WHEN a IS NULL AND m.d IS NOT NULL AND r.d IS NULL THEN 'backfilled' ELSE 'found' END AS action FROM m LEFT JOIN r ON r.retailer_id = m.b")
def e07(c):
    asked = c.parts.select(F.col("id").alias("candidate_id"), F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("id") % 15).cast("string"), 9, "0")).alias("name"), F.when(F.col("id") % 4 != 3, F.concat(F.lit("WWW.shop"), F.col("id") % 12, F.lit(".com"))).alias("domain"))
    return A.retailer_of(asked, c.retailers.select("retailer_id", F.col("retailer_name").alias("name"), F.expr(_DOMAIN).alias("domain")))


@R.add("e08_identifier_conflicts", "WITH s AS (SELECT id, CASE WHEN id % 3 = 0 THEN size END AS gtin, manufacturer AS m, name AS n FROM parts), x AS (SELECT c.id, 0 AS place, s.id AS o FROM s c JOIN s ON s.gtin = c.gtin AND s.id <> c.id UNION ALL SELECT c.id, 1, s.id FROM s c JOIN s ON s.m = c.m AND s.n = c.n AND s.id <> c.id) SELECT id AS candidate_id, CASE min(place) WHEN 0 THEN 'gtin' ELSE 'manufacturer_part_number' END AS identifier, arg_min(o, (place, o)) AS existing_id FROM x GROUP BY id")
def e08(c):
    known = c.parts.select("id", F.when(F.col("id") % 3 == 0, F.col("size")).alias("gtin"), "manufacturer", F.col("name").alias("number"))
    return A.identifier_conflicts(known, known)


@R.add("w05_edited_images", "SELECT id, array_to_string([l[3], l[1], l[2]], ',') AS front, array_to_string([l[1], l[3]], ',') AS less, CASE WHEN id % 2 = 0 THEN array_to_string(l, ',') ELSE array_to_string(l || ['n'], ',') END AS more, array_to_string(l, ',') AS full_list FROM (SELECT id, ['a' || id, 'b' || id, 'c' || size] AS l FROM parts)")
def w05(c):
    items = F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"), F.concat(F.lit("c"), "size"))
    df, text = c.parts.select("id", items.alias("l")), lambda x: F.array_join(x, ",")
    new = F.when(F.col("id") % 2 == 0, F.concat(F.lit("b"), "id")).otherwise("n")
    return df.select("id", text(T.to_front(F.col("l"), 2)).alias("front"), text(T.without_place(F.col("l"), 1)).alias("less"), text(T.with_new(F.col("l"), new, 12)).alias("more"), text(T.with_new(F.col("l"), F.lit("x"), 3)).alias("full_list"))


@R.add("a22_multiset_score", "WITH p AS (SELECT part_id, count(*) AS n FROM lines WHERE phase = 1 GROUP BY 1), t AS (SELECT part_id, count(*) AS n FROM lines WHERE phase = 2 GROUP BY 1), s AS (SELECT (SELECT CAST(sum(least(p.n, t.n)) AS BIGINT) FROM p JOIN t USING (part_id)) AS tp, (SELECT sum(n) FROM p) AS np, (SELECT sum(n) FROM t) AS nt) SELECT tp AS true_positives, tp / np AS precision, tp / nt AS recall, 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS f1 FROM s")
def a22(c):
    return A.multiset_score(c.lines.where("phase = 1").select("part_id"), c.lines.where("phase = 2").select("part_id"), ["part_id"])


_RULE = "CASE WHEN n_chars > 300 THEN 1 WHEN n_chars > 100 THEN 0 END"


@R.add("a23_value_score", f"WITH s AS (SELECT count(*) FILTER (p = q) AS tp, count(p) AS np, count(*) AS nt FROM (SELECT {_RULE} AS p, quality AS q FROM documents LEFT JOIN labels USING (doc_id)) WHERE q IS NOT NULL) SELECT tp AS true_positives, tp / np AS precision, tp / nt AS recall, 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS f1 FROM s")
def a23(c):
    both = c.raw("documents").select("doc_id", F.expr(_RULE).alias("p")).join(c.raw("labels").select("doc_id", "quality"), "doc_id", "left")
    return A.value_score(both, "p", "quality")


@R.add("a31_latency_gate", "SELECT name, n, p95, failures, n > 0 AND p95 < 90 AND failures = 0 AS passed FROM (SELECT event_type AS name, count(*) AS n, quantile_disc(value, 0.95) AS p95, count(*) FILTER (event_type = 'error' OR value > 1000) AS failures FROM events GROUP BY 1)")
def a31(c):
    """The gate is passed below a p95 and without any failure."""
    p95 = F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")
    failed = (F.col("event_type") == "error") | (F.col("value") > 1000)
    stats = c.raw("events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), p95, F.count_if(failed).alias("failures"))
    return stats.withColumn("passed", (F.col("n") > 0) & (F.col("p95") < 90) & (F.col("failures") == 0))


_BASELINE = """'{' || CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '"harness_version":true,' WHEN 2 THEN '"harness_version":2,' ELSE '"harness_version":1,' END
  || CASE event_id % 7 WHEN 0 THEN '"signal":"' || event_type || '",' WHEN 1 THEN '"signal":"car",' ELSE '"signal":"category",' END
  || CASE event_id % 5 WHEN 0 THEN '"sample_size":"9",' WHEN 1 THEN '"sample_size":' || (event_id - 500) || ',' ELSE '"sample_size":' || event_id || ',' END
  || CASE event_id % 3 WHEN 0 THEN '"generated_at":"",' ELSE '"generated_at":"2024-01-01T00:00:00Z",' END
  || CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN '"precision":1.5,' WHEN 2 THEN '"precision":"x",' ELSE '"precision":0.25,' END || '"recall":1,"f1":0.5}'"""
_WHEN = "CASE WHEN {} THEN '{}' END"
_VIOLATIONS = ", ".join(_WHEN.format(*x) for x in [
    ("event_id % 11 = 0", "harness_version missing"), ("event_id % 13 = 0", "precision missing"), ("event_id % 11 = 1", "harness_version no integer"), ("event_id % 5 = 0", "sample_size no integer"),
    ("event_id % 11 = 2", "harness_version differs"), ("event_id % 7 = 0", "signal unknown"), ("event_id % 5 = 1 AND event_id < 500", "sample_size negative"), ("event_id % 3 = 0", "generated_at no time"), ("event_id % 13 IN (1, 2)", "precision not in [0, 1]"),
])


@R.add("f34_quality_gate", f"SELECT event_id, coalesce(array_to_string([{_VIOLATIONS}], '; '), '') AS violations FROM events")
def f34(c):
    made = c.raw("events").select("event_id", F.expr(_BASELINE).alias("json"))
    return A.baseline_violations(made).select("event_id", F.array_join("violations", "; ").alias("violations"))
