"""Attribute conditions: `field:value && field:[a..b] && field:!=x`, joined by AND.

Conditions, the first marker of this list that stands in a part decides:
`f:!=[a,b]` and `f:![a,b]` none of, `f:!=a` not equal, `f:[a..b]` from a to b inclusive (either end may
be missing), `f:[a,b]` one of, `f:>=a` `f:<=a` `f:>a` `f:<a` bounds, all inclusive, `f:a` equal. A bracket
that isn't closed is part of the value. Parts without a colon are dropped. Exact conditions need a
bitmap index: without one, equal and one-of find nothing, not-equal and none-of everything. Nulls are
unequal to every value, so not-equal and none-of keep them. Bounds need a range, date or datetime
index, or nothing is found; a bound that can't be read is no bound, but the value must be there."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.sources.profile import Profile

NONE, NOT, ONE, FROM, TO, IS = "none of", "not", "one of", "from", "to", "is"
#: Marker, if the part must end with a bracket, what it means; in order of precedence.
MARKERS = [(":!=[", True, NONE), (":![", True, NONE), (":!=", False, NOT), (":[", True, ONE), (":>=", False, FROM), (":<=", False, TO), (":>", False, FROM), (":<", False, TO), (":", False, IS)]


@dataclass(frozen=True)
class Values:
    """One of the values, or none of them."""

    field: str
    values: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Bounds:
    field: str
    low: str | None = None
    high: str | None = None


def parse(text: str | None) -> list[Values | Bounds]:
    return [c for part in (text or "").split("&&") if (c := _condition(part.strip()))]


def _condition(part: str) -> Values | Bounds | None:
    for marker, closed, meaning in MARKERS:
        field, found, rest = part.partition(marker)
        if not found or closed and not rest.endswith("]"):
            continue
        field, rest = field.strip(), rest[:-1] if closed else rest.strip()
        if meaning in (FROM, TO):
            return Bounds(field, rest if meaning == FROM else None, rest if meaning == TO else None)
        if meaning == ONE and ".." in rest:
            low, _, high = rest.partition("..")
            return Bounds(field, low.strip() or None, high.strip() or None)
        values = tuple(v.strip() for v in rest.split(",")) if closed else (rest,)
        return Values(field, values, meaning in (NONE, NOT))
    return None


def bound(text: str | None, kind: str) -> float | None:
    """A bound as the number that its index compares; None if it can't be read."""
    if text is None:
        return None
    try:
        if kind == "range":
            return float(text) if not re.search(r"[_\s]", text) else None
        if kind == "date":
            return float((datetime.strptime(text, "%Y-%m-%d").date() - date(1970, 1, 1)).days)
        time = datetime.fromisoformat(text)
        return float(int(time.replace(tzinfo=time.tzinfo or timezone.utc).timestamp())) if len(text) > 10 else None
    except ValueError:
        return None


def column(condition: Values | Bounds, profile: Profile) -> Column:
    """The condition over a staged table."""
    if isinstance(condition, Values):
        if not profile.index(condition.field, "bitmap"):
            return F.lit(condition.negated)
        hit = F.coalesce(F.col(f"`_key_{condition.field}`").isin(*condition.values), F.lit(False))
        return ~hit if condition.negated else hit
    index = profile.index(condition.field, "range", "date", "datetime")
    if not index:
        return F.lit(False)
    value = F.col(f"`_num_{condition.field}`")
    low, high = bound(condition.low, index.type), bound(condition.high, index.type)
    tests = [value.isNotNull()] + [value >= low] * (low is not None) + [value <= high] * (high is not None)
    return reduce(Column.__and__, tests)


def conjunction(conditions: list[Values | Bounds], profile: Profile) -> Column | None:
    return reduce(Column.__and__, (column(c, profile) for c in conditions)) if conditions else None
