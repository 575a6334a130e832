"""Normal forms of names, numbers, prices and addresses as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only follow visitors around, and those that only size an image.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "ref", "source")
SIZES = ("width", "height", "w", "h", "size", "resize", "dpr", "q", "quality", "format", "fit", "crop")
LARGE_WIDTH = 5760
# Words that end a manufacturer's name without being part of it, labels before a part number, and codes of
# vehicles, which aren't part numbers.
NAME_ENDINGS = (
    "inc", "llc", "ltd", "co", "corp", "company", "llp", "limited", "performance", "racing", "motorsport", "motorsports", "tuning",
    "engineering", "electronics", "induction", "industries", "usa", "america", "automotive",
)
NUMBER_LABELS = (r"SKU\s*:\s*", r"Part\s*#\s*:\s*", r"Part\s*Number\s*:\s*", r"Item\s*#\s*:\s*", r"Product\s*Code\s*:\s*", r"Model\s*#?\s*:\s*", r"Code\s*:\s*")
VEHICLE_CODES = ("z4m", "1m", "e8x", "e9x", "e46", "e90", "e92", "e82", "e85", "e86", "f80", "f82", "f10", "f12", "e60", "e63", "e64")
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_PARTS = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"


#: The white space that str.strip() takes off, as far as ASCII goes.
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def manufacturer_key(name: Column, endings: Sequence[str] = NAME_ENDINGS) -> Column:
    """Letters and digits without the words that only end a name; a name of such words alone becomes empty."""
    words = "|".join(endings)
    ended = F.regexp_replace(F.concat(F.lit(" "), F.lower(name)), f"(?:[^a-z0-9]+(?:{words}))+[^a-z0-9]*$", "")
    return F.regexp_replace(ended, "[^a-z0-9]", "")


def part_number(value: Column, labels: Sequence[str] = NUMBER_LABELS, reject: Sequence[str] = ()) -> Column:
    """A part number without the labels before it, each taken off once in order; null if nothing is left, or if it is a code to
    reject, whatever its case and white space.
    """
    value = F.btrim(value, F.lit(_BLANKS))
    for label in labels:
        value = F.regexp_replace(value, f"(?i)^{label}", "")
    value = F.nullif(F.btrim(value, F.lit(_BLANKS)), F.lit(""))
    return F.when(~F.lower(F.regexp_replace(value, r"\s+", "")).isin(*[r.lower() for r in reject]), value) if reject else value


def part_number_key(value: Column, reject: Sequence[str] = (), least: int = 4, labels: Sequence[str] = ()) -> Column:
    """What part numbers are compared by: letters and digits in upper case, of ``least`` at least, of a number that isn't rejected."""
    key = F.upper(F.regexp_replace(part_number(value, labels, reject), "[^A-Za-z0-9]", ""))
    ok = F.length(key) >= least
    return F.when(ok & ~F.lower(key).isin(*[r.lower() for r in reject]) if reject else ok, key)


def gtin(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit(""))


def price_cents(text: Column) -> Column:
    """Cents of the first number in a text without $, commas and spaces; halves go to the even cent."""
    number = F.nullif(F.regexp_extract(F.regexp_replace(text, r"[$,\s]", ""), r"\d+\.?\d*", 0), F.lit(""))
    return F.bround(number.cast("double") * 100).cast("long")


def plain(text: Column) -> Column:
    """White space runs as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column, drop: Sequence[str], blanks: bool = True) -> Column:
    """The decoded parameters of a url as array<struct<k,v>> without those to drop, whatever their case; a name that occurs
    again is moved to its first place. Without ``blanks`` parameters of no value go.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    some = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(some, lambda p: F.struct(_decoded(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: (~F.lower(p["k"]).isin(*drop) if drop else F.lit(True)) & (F.lit(blanks) | (p["v"] != "")))
    return F.flatten(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.filter(pairs, lambda p: p["k"] == k)))


def query_text(pairs: Column) -> Column:
    """Parameters encoded again, with the ? before them; empty if there are none."""
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), joined)).otherwise("")


def canonical_url(url: Column, drop: Sequence[str] = TRACKING) -> Column:
    """Lower-case scheme (https, if there is none) and host, no tracking parameters, no fragment, no bare slash."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("")), F.lit("https"))
    netloc, path = F.lower(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)
    path = F.when(path == "/", "").when((netloc == "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(scheme, F.lit("://"), netloc, path, query_text(query_pairs(url, drop)))


def image_url(url: Column, width: int | None = None) -> Column:
    """An image's address without what only sizes it, the same for all its sizes; with a width, the address to fetch it at.

    Texts without scheme or host stay as they are.
    """
    u = F.btrim(url, F.lit(_BLANKS))
    scheme, netloc, path = F.lower(F.regexp_extract(u, _SCHEME, 1)), F.lower(F.regexp_extract(u, _PARTS, 1)), F.regexp_extract(u, _PARTS, 2)
    pairs = query_pairs(u, SIZES, blanks=width is not None)
    if width is None:
        netloc = F.ltrim(netloc, F.lit("w."))
    else:
        pairs = F.concat(pairs, F.array(F.struct(F.lit("width").alias("k"), F.lit(str(width)).alias("v"))))
    made = F.concat(F.when(scheme.isin("http", "https"), "https").otherwise(scheme), F.lit("://"), netloc, F.when(path == "", "/").otherwise(path), query_text(pairs))
    return F.when((scheme != "") & (F.regexp_extract(u, _PARTS, 1) != ""), made).otherwise(url)


def url_key(url: Column) -> Column:
    """What http and https, the case of the host, a last slash, a query and a fragment don't change; null for what has no scheme or host."""
    parts = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)"
    u = F.btrim(url, F.lit(_BLANKS))
    scheme, netloc, path = (F.regexp_extract(u, parts, i) for i in (1, 2, 3))
    scheme = F.when(F.lower(scheme).isin("http", "https"), "http").otherwise(F.lower(scheme))
    made = F.concat(scheme, F.lit("://"), F.lower(netloc), F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", "")))
    return F.when(netloc != "", made)


def bare_host(url: Column) -> Column:
    """The host without any leading w's and dots."""
    return F.ltrim(host(url), F.lit("w."))


def site_name(domain: Column) -> Column:
    return F.initcap(F.split(F.regexp_replace(domain, r"^www\.", ""), r"\.")[0])


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fingerprint(html: Column) -> Column:
    return F.struct(F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("sha256"))


def composite(*columns: Column) -> Column:
    """Keys joined by #, null if any is null."""
    from functools import reduce
    from operator import and_

    return F.when(reduce(and_, [c.isNotNull() for c in columns]), F.concat_ws("#", *columns))


def capped(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(items), 1, most)


def with_new(items: Column, item: Column, most: int) -> Column:
    """An item behind the others, unless it is among them or there are ``most`` already."""
    return F.when(F.array_contains(items, item) | (F.size(items) >= most), items).otherwise(F.array_append(items, item))


def to_front(items: Column, place: int) -> Column:
    """The element at a place moved to the front."""
    return F.concat(F.array(F.get(items, place)), F.filter(items, lambda _, i: i != place))


def without_place(items: Column, place: int) -> Column:
    return F.filter(items, lambda _, i: i != place)


def age(seconds: Column) -> Column:
    """How long ago something was: seconds, minutes with seconds, or hours with minutes; - where that is unknown, 0 for what is to come."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    two = lambda a, b, u, v: F.concat(a.cast("string"), F.lit(u), F.when(b > 0, F.concat(F.lit(" "), b.cast("string"), F.lit(v))).otherwise(""), F.lit(" ago"))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return F.when(seconds.isNull(), "-").when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(m < 60, two(m, s % 60, "m", "s")).otherwise(two(h, m % 60, "h", "m"))


def dollars(cents: Column) -> Column:
    """An amount with a sign, separated thousands and two decimals."""
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(cents).cast("decimal(20,0)") / 100, 2))


def base64url(data: Column) -> Column:
    """Bytes as text that a url or a key can hold, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "="))
