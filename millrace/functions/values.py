"""Column functions on numbers, times, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days that have passed; not the number of midnights."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("bigint")


def decay(hours: Column, half: float = 24.0) -> Column:
    """Hyperbolic decay: a half after `half` hours."""
    return F.lit(1.0) / (F.lit(1.0) + hours / F.lit(half))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Per cent to some digits; 0 if the whole is 0."""
    return F.round(F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)), digits)


def token_cost(total: Column, cached: Column, out: Column, price: Column, cached_price: Column, out_price: Column) -> Column:
    """Cost of a call by prices for a million tokens; cached tokens lie within 0 and the total."""
    held = F.greatest(F.lit(0), F.least(cached, total))
    return F.round(((total - held) * price + held * cached_price + out * out_price) / F.lit(1_000_000.0), 6)


def filled(current: Column, proposed: Column) -> Column:
    """The current value unless it is blank."""
    return F.when(F.trim(F.coalesce(current, F.lit(""))) == "", proposed).otherwise(current)


def merged_map(existing: Column, new: Column) -> Column:
    """Both maps; the existing value wins. Null maps are empty."""
    kept = F.map_filter(new, lambda k, v: ~F.coalesce(F.map_contains_key(existing, k), F.lit(False)))
    return F.when(existing.isNull(), new).when(new.isNull(), existing).otherwise(F.map_concat(existing, kept))


def padded_map(known: Column, keys: Column, default: str = "unknown") -> Column:
    """A value for each key; what the map lacks gets the default."""
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(known, k), F.lit(default))))


def json_text(c: Column, path: str, default: str | None = None) -> Column:
    found = F.get_json_object(c, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_true(values: Column) -> Column:
    """The first element that is neither null nor blank."""
    return F.try_element_at(F.filter(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(1))


def named_failures(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in order; a rule of null does not hold."""
    return F.array_compact(F.array_distinct(F.array(*(F.when(when, F.lit(code)) for code, when in rules))))


def points(rules: list[tuple[Column, int]], low: int = 0, high: int = 100) -> Column:
    """The sum of the deltas of the rules that hold, clamped."""
    out = F.lit(0)
    for when, delta in rules:
        out = out + F.when(when, F.lit(delta)).otherwise(F.lit(0))
    return clamp(out, low, high)
