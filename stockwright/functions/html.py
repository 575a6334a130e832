"""Product facts from HTML pages. Parsing needs a parser with state, so it runs in Arrow batches; all else stays in the engine."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType(
    [T.StructField(c, {"price_cents": T.LongType(), "images": T.ArrayType(T.StringType())}.get(c, T.StringType())) for c in ("name", "description", "images", "brand", "sku", "price_cents", "source")]
)
#: Images kept of a product, and characters of a description.
MOST_IMAGES, MOST_TEXT = 12, 2000
_PRICE = re.compile(r"(?:From\s*)?\$[\s,]?\d+\.?\d*")
#: From here on cents don't fit into a long.
_MOST_PRICE = 9e16
_LD = "application/ld+json"
_UNREAD = ("script", "style", "template")


class _Reader(HTMLParser):
    """Collects the title, meta values, JSON-LD blocks and visible text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.blocks: list[str] = []
        self.title: list[str] = []
        self.text: list[str] = []
        self.inside, self.titled = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            if (key := a.get("property", "").lower()) and "content" in a:
                self.meta.setdefault(key, a["content"])
        elif tag in _UNREAD:
            self.inside.append("json" if tag == "script" and a.get("type", "").strip().lower() == _LD else tag)
            if self.inside[-1] == "json":
                self.blocks.append("")
        elif tag == "title":
            self.titled = not self.title

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNREAD and self.inside:
            self.inside.pop()
        elif tag == "title":
            self.titled = False

    def handle_data(self, data: str) -> None:
        where = self.inside[-1] if self.inside else ""
        if where == "json":
            self.blocks[-1] += data
        elif not where:
            self.text.append(data)
            if self.titled:
                self.title.append(data)


def _read(html: str) -> _Reader | None:
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        return None
    return reader


def text_of(raw: str | None, most: int = MOST_TEXT) -> str | None:
    """A description without tags and entities, white space runs as one space, up to ``most`` characters; null if nothing is left."""
    if raw is None or not raw.strip():
        return None
    s = raw.strip()
    if "<" in s and ">" in s:
        reader = _read(s)
        s = " ".join(x.strip() for x in reader.text if x.strip()) if reader else s
    else:
        s = _html.unescape(s)
    return re.sub(r"\s+", " ", s).strip()[:most] or None


@F.pandas_udf(T.StringType())
def description_text(raw: pd.Series) -> pd.Series:
    return raw.map(text_of, na_action="ignore")


def _products(block: str) -> Iterator[dict]:
    """The products of a JSON-LD block; control characters may stand raw in its strings."""
    try:
        data = json.loads(block, strict=False)
    except ValueError:
        return
    if isinstance(data, dict):
        data = data["@graph"] if isinstance(data.get("@graph"), list) else [data]
    for item in data if isinstance(data, list) else []:
        kinds = item.get("@type") if isinstance(item, dict) else None
        if any(isinstance(k, str) and k.strip().lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield item


def _address(url: object) -> str | None:
    """What http and https, the case of the host, a last slash and a query don't change; null for what isn't an absolute url."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)", url.strip()) if isinstance(url, str) else None
    if not m:
        return None
    scheme = "http" if m[1].lower() in ("http", "https") else m[1].lower()
    return f"{scheme}://{m[2].lower()}{m[3].removesuffix('/') or '/'}"


def _declared(item: dict) -> set[str]:
    """The addresses that a product says it has."""
    offers = item.get("offers")
    todo, out = [item.get("url"), item.get("@id"), item.get("sameAs"), *[o.get("url") for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]], set()
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += v
        elif isinstance(v, dict):
            todo.append(v.get("url") or v.get("@id"))
        elif key := _address(v):
            out.add(key)
    return out


def _named(value: object) -> str | None:
    return _html.unescape(value.strip()) if isinstance(value, str) and value.strip() else None


def _offered_cents(item: dict) -> int | None:
    """The first price above zero of the first offer, in cents."""
    offer = item.get("offers")
    offer = (offer[0] if offer else None) if isinstance(offer, list) else offer
    for key in ("price", "lowPrice", "highPrice"):
        try:
            price = float(str(offer.get(key)).replace(",", "")) if isinstance(offer, dict) else 0.0
        except ValueError:
            continue
        if 0 < price < _MOST_PRICE:
            return round(price * 100)
    return None


def _images(value: object) -> list[str]:
    out = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            x = next((x[k] for k in ("url", "contentUrl", "image") if isinstance(x.get(k), str) and x[k].strip()), None)
        if isinstance(x, str) and x.strip():
            out.append(x.strip())
    return out


def _shown_cents(text: str | None) -> int | None:
    m = re.search(r"\d+\.?\d*", re.sub(r"[$,\s]", "", text or ""))
    return round(float(m[0]) * 100) if m and float(m[0]) < _MOST_PRICE else None


def read_page(html: str | None, url: str | None) -> tuple:
    """(name, description, images, brand, sku, price_cents, source): from the product block for the page's address, else the
    first block that declares none, else from the page's own marks. Without an address the first block counts. Nulls if no
    name is found.
    """
    none = (None,) * 7
    reader = _read(html) if html else None
    if reader is None:
        return none
    found, want = [p for b in reader.blocks for p in _products(b)], _address(url)
    if want:
        found = [p for p in found if want in _declared(p)] or [p for p in found if not _declared(p)]
    item = found[0] if found else {}
    if name := _named(item.get("name")):
        text, brand, sku = item.get("description"), item.get("brand"), item.get("sku") or item.get("mpn")
        text = text_of(text) if isinstance(text, str) and len(text.strip()) > 10 else None
        brand = _named(brand.get("name") if isinstance(brand, dict) else brand)
        return name, text, _images(item.get("image"))[:MOST_IMAGES] or None, brand, sku if isinstance(sku, str) else None, _offered_cents(item), "product"
    name = _html.unescape(reader.meta.get("og:title") or "".join(reader.title)).strip()
    if not name:
        return none
    price = next((c for k in ("product:price:amount", "og:price:amount") if (c := _shown_cents(reader.meta.get(k))) is not None), None)
    if price is None and (m := _PRICE.search("".join(reader.text))):
        price = _shown_cents(m[0])
    image = reader.meta.get("og:image")
    return name, text_of(reader.meta.get("og:description")), [image] if image else None, None, None, price, "page"


@F.pandas_udf(PAGE)
def parsed_page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [read_page(h, u) for h, u in zip(html, url, strict=True)]
    df = pd.DataFrame(rows, columns=PAGE.names)
    return df.assign(price_cents=df["price_cents"].astype("Int64"))


# What a stored page may not keep, and what it may.
DROPPED = ("style", "noscript", "iframe", "object", "embed")
META_PREFIXES = ("og:", "twitter:", "product:")
META_NAMES = ("description", "keywords", "viewport", "robots", "twitter:card", "twitter:title", "twitter:description", "twitter:image")
META_HEADERS = ("content-type", "content-language")
FORM_TAGS = ("input", "textarea", "select", "option", "button")
FORM_VALUES = ("value", "checked", "selected", "placeholder")
#: Elements without an end tag.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def _meta_stays(a: dict[str, str]) -> bool:
    value = lambda k: a.get(k, "").strip().lower()
    return "charset" in a or "itemprop" in a or value("property").startswith(META_PREFIXES) or value("name") in META_NAMES or value("http-equiv") in META_HEADERS


class _Cleaner(HTMLParser):
    """Notes where each construct begins and what stands in its place: the source, nothing, or a tag without form values.

    An element ends with its end tag or with that of an element about it, so one that isn't closed takes no more than its
    parent; an end tag without a start is passed over.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = [0, *accumulate(len(x) + 1 for x in html.split("\n"))]
        self.at: list[tuple[int, str | None]] = []  # place, replacement; None is the source
        self.open: list[tuple[str, bool]] = []  # tag, whether its content goes
        self.gone = 0

    def note(self, stays: bool, instead: str | None = None) -> None:
        line, column = self.getpos()
        self.at.append((self.lines[line - 1] + column, (instead if stays else "")))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        goes = tag in DROPPED or (tag == "script" and a.get("type", "").strip().lower() != _LD) or (tag == "meta" and not _meta_stays(a))
        instead = None
        if tag in FORM_TAGS and any(k in FORM_VALUES for k in a):
            instead = f"<{tag}" + "".join(f' {k}="{_html.escape(v or "")}"' for k, v in attrs if k not in FORM_VALUES) + ">"
        self.note(not self.gone and not goes, instead)
        if tag not in _VOID:
            hides = goes or tag == "textarea"
            self.open.append((tag, hides))
            self.gone += hides

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.gone -= self.open.pop()[1]

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _ in self.open):
            self.note(not self.gone)
            return
        own = False
        while True:
            t, hides = self.open.pop()
            self.gone -= hides
            own = t == tag and hides and tag != "textarea"
            if t == tag:
                break
        self.note(not self.gone and not own)

    def handle_data(self, data: str) -> None:
        self.note(not self.gone)

    def handle_entityref(self, name: str) -> None:
        self.note(not self.gone)

    def handle_charref(self, name: str) -> None:
        self.note(not self.gone)

    def handle_comment(self, data: str) -> None:
        self.note(not self.gone)

    def handle_decl(self, decl: str) -> None:
        self.note(not self.gone)

    def handle_pi(self, data: str) -> None:
        self.note(not self.gone)

    def unknown_decl(self, data: str) -> None:
        self.note(not self.gone)


def clean_page(html: str | None) -> str | None:
    """The page without styles, scripts (but JSON-LD), frames, unlisted meta elements and what was filled into forms.

    What stays is the source as it was. Text areas lose their content, form elements their values.
    """
    if html is None:
        return None
    c = _Cleaner(html)
    c.feed(html)
    c.close()
    places = [p for p, _ in c.at]
    out = [html[: places[0]] if places else html]
    for k, (p, instead) in enumerate(c.at):
        end = places[k + 1] if k + 1 < len(places) else len(html)
        out.append(html[p:end] if instead is None else instead)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _cleaned(html: pd.Series) -> pd.Series:
    return html.map(clean_page, na_action="ignore")


def cleaned_page(html: Column | str) -> Column:
    """clean_page as a column; pages without any of its tags don't go through the parser."""
    html = F.col(html) if isinstance(html, str) else html
    may = "|".join(sorted({*DROPPED, *FORM_TAGS, "script", "meta"}))
    return F.when(html.rlike(f"(?i)<(?:{may})"), _cleaned(F.when(html.rlike(f"(?i)<(?:{may})"), html))).otherwise(html)


def title_of(html: Column) -> Column:
    """The text of the title element, without a parser."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
