"""Joins, filters, ranks, pages and set operations that the catalog's queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions; false without any."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def having_any(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left with a match: filters through a bridge without multiplying rows."""
    return left.join(right, on, "left_semi")


def having_none(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def having_all(left: DataFrame, pairs: DataFrame, key: str, item: str, items: list) -> DataFrame:
    """Rows of left whose key stands with every item in pairs (relational division). One shuffle of the filtered pairs."""
    if not items:
        return left
    found = pairs.where(F.col(item).isin(*items)).groupBy(key).agg(F.count_distinct(item).alias("_n"))
    return left.join(found.where(F.col("_n") == len(set(items))), key, "left_semi")


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Equality with each parameter that is given; None and '' leave the rows as they are."""
    for name, value in equals.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; the order must be total."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank. Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column, largest: int = 100) -> DataFrame:
    """A page by offset; number and size are clamped to 1 and more, and to 1 to largest."""
    size, number = max(1, min(largest, size)), max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counted_ranges(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): df by ranges of an order, written with the number of the range, and how many rows each has and how many
    lie before it. Done once for many pages; order columns are names, with - before those that fall, and should have no ties."""
    places = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    dealt = df.repartitionByRange(*places).withColumn("_range", F.spark_partition_id())
    rows = materialise(dealt, by=["_range"])
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, materialise(counts.select("_range", "n", before.alias("before")))  # a row for each range


def deep_page(rows: DataFrame, ranges: DataFrame, number: int, size: int, *order: str, largest: int = 100) -> DataFrame:
    """page() of counted_ranges: only the ranges that hold the page are read, which are one or two, and only they are sorted."""
    size, number = max(1, min(largest, size)), max(1, number)
    start = (number - 1) * size
    held = ranges.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).orderBy("_range").collect()  # as many as the page spans
    if not held:
        return rows.drop("_range").limit(0)
    places = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    own = rows.where(F.col("_range").isin(*(r._range for r in held))).drop("_range")
    return own.orderBy(*places).offset(start - held[0].before).limit(size)


def shown_page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page by number, or the last one where the number is beyond it."""
    return page(df, last_valid_page(df.count(), number, size), size, *order)


def last_valid_page(count: int, number: int, size: int) -> int:
    """The page to show: within 1 and the last page."""
    return max(1, min(number, -(-count // size)))


def page_after(df: DataFrame, key: str, cursor, size: int, *order: Column) -> DataFrame:
    """A keyset page: rows below the cursor's key."""
    return (df if cursor is None else df.where(F.col(key) < cursor)).orderBy(*order).limit(size)


def facet_counts(apps: DataFrame, bridge: DataFrame, dim: DataFrame, app: str, key: str) -> DataFrame:
    """Distinct apps for each row of a small dimension, those with any."""
    counts = having_any(bridge.select(app, key).distinct(), apps, app).groupBy(key).agg(F.count("*").alias("n_apps"))
    return counts.join(dim, key)


def facet_counts_fanned(apps: DataFrame, bridge: DataFrame, app: str, key: str, value: Column) -> DataFrame:
    """Facets as a second join through the bridge counts them: every pair of a key and any of the app's rows with the value."""
    held = having_any(bridge, apps, app)
    hits = held.where(value).groupBy(app).agg(F.count("*").alias("_hits"))
    return held.join(hits, app).groupBy(key).agg(F.sum("_hits").cast("bigint").alias("n_apps"))


def related(items: DataFrame, bridge: DataFrame, item: str, through: str) -> DataFrame:
    """(item, other) that share a value of the bridge, without themselves, once each."""
    other = bridge.select(through, F.col(item).alias("other"))
    pairs = having_any(bridge, items, item).join(other, through).where(F.col(item) != F.col("other"))
    return pairs.select(item, "other").distinct()


def related_top(bridge: DataFrame, item: str, through: str, n: int, *order: str) -> DataFrame:
    """(item, other, rank): the first n others that share a value of the bridge, by the columns `order` of it (names,
    with - before those that fall), then by item.

    The first n + 1 items of a value hold the first n others of each of its items, so that no pair of further items is made."""
    places = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    columns = [c.lstrip("-") for c in order]
    best = top_by(bridge.select(through, item, *columns).distinct(), [through], n + 1, *places, F.col(item).asc())
    others = best.select(through, F.col(item).alias("other"), *columns)
    pairs = bridge.select(through, item).distinct().join(others, through).where(F.col(item) != F.col("other"))
    # dealt by item once: the distinct pairs and their ranks are then both made where they lie
    pairs = pairs.select(item, "other", *columns).repartition(item).distinct()
    return top_by(pairs, [item], n, *places, F.asc("other")).select(item, "other", "rank")


def ordered_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with a and b so that a is the lesser one."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def ordered_union(*lists: Column) -> Column:
    """Elements in the order of their first place, once each."""
    return F.array_distinct(F.concat(*lists))


def added_removed(before: Column, after: Column) -> tuple[Column, Column]:
    """Sorted elements that came and that went."""
    return F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))


def only_within(values: Column, allowed: Column) -> Column:
    """Whether there are values and all are among the allowed."""
    return (F.size(values) > 0) & (F.size(F.array_except(values, allowed)) == 0)


def merged_suggestions(lists: list[DataFrame], text: str, place: str, n: int) -> DataFrame:
    """Ranked lists one after the other, first of equal texts (whatever their case), at most n: a top-n report."""
    tagged = [df.select(text, F.lit(k).alias("source"), F.col(place).alias("place")) for k, df in enumerate(lists)]
    whole = reduce(DataFrame.unionAll, tagged).withColumn("_low", F.lower(text))
    order = [F.col("source"), F.col("place"), F.col(text)]
    return top(first_by(whole, ["_low"], *order).drop("_low"), n, *order)


def guarded_transition(df: DataFrame, column: str, guard: Column, new: str) -> DataFrame:
    """df with the column set to `new` where the guard holds, and `changed`."""
    holds = F.coalesce(guard, F.lit(False))
    return df.withColumns({column: F.when(holds, F.lit(new)).otherwise(F.col(column)), "changed": holds})
