"""Filters as Column builders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_term(term: Column | str | None) -> Column:
    """A search term in lower case without the white space about it; nothing is an empty term."""
    return F.lower(F.btrim(F.coalesce(term if isinstance(term, Column) else F.lit(term), F.lit("")), F.lit(" \t\n\x0b\x0c\r")))


def _any(term: str | None, columns: Sequence[Column | str], how) -> Column:  # noqa: ANN001
    wanted = (term or "").strip().lower()
    if not wanted:
        return F.lit(True)
    tests = [F.coalesce(how(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(wanted)), F.lit(False)) for c in columns]
    return reduce(or_, tests)


def contains(term: str | None, *columns: Column | str) -> Column:
    """Whether any column holds the term, upper and lower case alike; an empty term fits all, the term is no pattern."""
    return _any(term, columns, F.contains)


def starts_with(term: str | None, *columns: Column | str) -> Column:
    return _any(term, columns, F.startswith)


def live(deleted: Column | str = "deleted") -> Column:
    """Rows without a tombstone; a missing mark counts as live."""
    return ~F.coalesce(F.col(deleted) if isinstance(deleted, str) else deleted, F.lit(False))


def is_file_key(value: Column) -> Column:
    return F.coalesce(~value.rlike("^(?i:https?)://") & F.contains(value, F.lit("/")), F.lit(False))


def activity(done: Column, age_seconds: Column) -> Column:
    return F.when(done, "done").when(age_seconds < 15, "active").when(age_seconds < 90, "idle").otherwise("stalled")


def exact_after_lookup(name: Column, wanted: str) -> Column:
    """Found by its name in any case, but kept only if the case is that of the name too."""
    return (F.lower(name) == wanted.lower()) & (name == wanted)


#: What anyone may see of a user.
PUBLIC = ("user_id", "username", "segment")


def public(users: DataFrame) -> DataFrame:
    """Users as others see them: no address, no balance."""
    return users.select(*[c for c in users.columns if c in PUBLIC])


def not_reserved(key: Column | str) -> Column:
    """Rows of a table that aren't reservations of unique values, which share it."""
    return ~F.startswith(F.col(key) if isinstance(key, str) else key, F.lit("#unique#"))


@dataclass(frozen=True)
class PartFilter:
    """What a catalogue listing may be narrowed to. An owner sees duplicates too, anyone else canonical parts only."""

    categories: tuple[str, ...] = ()
    manufacturers: tuple[str, ...] = ()
    owner: str | None = None
    universal: bool | None = None
    cars: tuple = ()
    text: str | None = None
    least_cents: int | None = None
    most_cents: int | None = None

    def without_cars(self) -> PartFilter:
        from dataclasses import replace

        return replace(self, cars=(), universal=None)

    def column(self, text_columns: Sequence[str] = ("name",), owner: str = "owner", price: str = "price_cents", universal: str = "universal", cars: str = "car_ids") -> Column:
        all_of = [F.col(owner) == self.owner if self.owner is not None else F.col("canonical_part_id").isNull()]
        if self.categories:
            all_of.append(F.col("category").isin(*self.categories))
        if self.manufacturers:
            all_of.append(F.col("manufacturer").isin(*self.manufacturers))
        if self.universal:
            all_of.append(F.col(universal))  # and the cars don't matter
        elif self.cars:
            all_of.append(F.arrays_overlap(cars, F.lit(list(self.cars))))
        if self.text:
            all_of.append(contains(self.text, *text_columns))
        if self.least_cents is not None:
            all_of.append(F.col(price) >= self.least_cents)
        if self.most_cents is not None:
            all_of.append(F.col(price) <= self.most_cents)
        return reduce(and_, all_of)


def may_change(owner: Column, user, admin: bool = False, superuser: bool = False) -> Column:  # noqa: ANN001
    """Whether a user may change a row: its owner, an admin or a superuser, and anyone a row without owner."""
    return F.lit(True) if admin or superuser else owner.isNull() | (owner == user)
