"""Sort keys with fixed places for missing values, and pages."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwright.functions.text import base64url, from_base64url

_PRINTABLE = "".join(map(chr, range(0x20, 0x7F)))
_GREATEST = 10**15 - 1
_PAGE_MOST = 1000


def text_key(value: Column, descending: bool = False) -> list[Column]:
    """Missing and empty texts are last both ways. Descending mirrors each printable ASCII character, so that a text still
    comes before one that continues it and other characters keep their order.
    """
    low = F.lower(value)
    missing = F.coalesce(value == "", F.lit(True))
    return [missing.asc(), (F.translate(low, _PRINTABLE, _PRINTABLE[::-1]) if descending else low).asc_nulls_last()]


def numeric_key(value: Column, descending: bool = False) -> list[Column]:
    """Values are cut to whole numbers from 0 to 10^15 - 1; missing ones are last both ways."""
    v = F.least(F.greatest(value.cast("long"), F.lit(0)), F.lit(_GREATEST))
    return [v.desc_nulls_last() if descending else v.asc_nulls_last()]


def signed_key(value: Column, descending: bool = False) -> list[Column]:
    v = F.coalesce(value, F.lit(0))
    return [v.desc() if descending else v.asc()]


#: Orders of a catalogue listing; ties go by ascending id in all of them.
PART_ORDERS = {
    f"{name}_{'desc' if down else 'asc'}": (key, column, down)
    for name, key, column in (("votes", signed_key, "net_votes"), ("price", numeric_key, "price_cents"), ("name", text_key, "name"), ("part_number", text_key, "part_number"), ("manufacturer", text_key, "manufacturer"), ("category", text_key, "category"))
    for down in (False, True)
}


def part_order(order: str = "votes_desc", id_col: str = "id") -> list[Column]:
    key, column, down = PART_ORDERS.get(order, PART_ORDERS["votes_desc"])
    return [*key(F.col(column), down), F.col(id_col).asc()]


def datetime_key(value: Column) -> list[Column]:
    """Earlier times first, missing ones last."""
    return [value.asc_nulls_last()]


def compound_key(*values: Column) -> list[Column]:
    """Several texts, one after the other, as one key; a missing one is an empty text."""
    return [F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]).asc()]


#: Orders of a build list's lines: the column, and whether it is a number.
LINE_KEYS = {"part": False, "part_manufacturer": False, "part_number": False, "fit": False, "qty": True, "price": True}


def line_order(key: str, descending: bool = False, part: str = "part") -> list[Column]:
    """Lines by a key of LINE_KEYS: missing values, empty texts among them, are last both ways; ties go by the part's name."""
    value = F.col(key) if LINE_KEYS[key] else F.nullif(F.col(key), F.lit(""))
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(part).asc()]


#: Orders of the table of parts and what stands for a missing value.
TABLE_KEYS = {"part": "", "part_manufacturer": "", "part_number": "", "category": "", "fit": "", "rating": 0, "price": 0}


def table_order(key: str, descending: bool = False) -> list[Column]:
    value = F.coalesce(key, F.lit(TABLE_KEYS[key]))
    return [value.desc() if descending else value.asc()]


#: Activities in the order of a crawl's table.
ACTIVITIES = ("active", "idle", "stalled", "queued", "done")


def activity_order(activity: Column, name: Column) -> list[Column]:
    return [F.array_position(F.lit(list(ACTIVITIES)), activity).asc(), name.asc()]


def cursor(values: Sequence) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values), separators=(",", ":")).encode()).decode().rstrip("=")


def from_cursor(text: str) -> list:
    try:
        values = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor of this listing") from e
    if not isinstance(values, list):
        raise ValueError("not a cursor of this listing")
    return values


def keyset_page(df: DataFrame, keys: Sequence[str], limit: int, after: Sequence | None = None) -> DataFrame:
    """Up to ``limit`` rows in ascending order of non-null keys, the last of them unique, after a row's keys.

    The predicate is a plain range over the first key with the rest as tie-break, which the files' statistics can prune.
    """
    if after is not None:
        values = [F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]
        df = df.where((F.col(keys[0]) >= values[0]) & (F.struct(*keys) > F.struct(*values)))
    return df.orderBy(*keys).limit(limit)


def scan_page(df: DataFrame, key: str, limit: int, after: str | None = None) -> DataFrame:
    """One page of a whole table in the order of a text key, without the reservations that share it."""
    from stockwright.functions.predicates import not_reserved

    return keyset_page(df.where(not_reserved(key)), [key], limit, None if after is None else [after])


def offset_page(df: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, skip)).limit(min(max(1, limit), _PAGE_MOST))


def page_facts(df: DataFrame, skip: int, limit: int) -> DataFrame:
    """One row about an offset page: total, current page, pages, whether there is a next or an earlier one."""
    skip, limit = max(0, skip), min(max(1, limit), _PAGE_MOST)
    total = F.col("total")
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(skip // limit + 1).cast("long").alias("current_page"), F.ceil(total / limit).cast("long").alias("total_pages"),
        (total > skip + limit).alias("has_next"), F.lit(skip > 0).alias("has_previous"),
    )


def cursor_text(key: Column, id_: Column) -> Column:
    """The opaque cursor behind a row of a listing, from its sort key and id; what cursor_position reads."""
    return base64url(F.to_json(F.struct(id_.cast("string").alias("id"), key.alias("k")), {"ignoreNullFields": "false"}).cast("binary"))


def cursor_position(text: Column, kind: str = "string") -> Column:
    """struct<id,k> of an opaque cursor; an error for what is none."""
    found = F.from_json(from_base64url(text).cast("string"), f"id string, k {kind}", {"mode": "PERMISSIVE"})
    return F.when(found["id"].isNull(), F.raise_error(F.lit("not a cursor of this listing"))).otherwise(found)
