"""Array and map functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, trim_ws

EMPTY = "array<string>"


def empty() -> Column:
    return F.array().cast(EMPTY)


def or_empty(value) -> Column:
    return F.coalesce(col(value), empty())


def unique_lower(*values) -> Column:
    """Trim, lower, drop blanks, keep first occurrence."""
    joined = F.flatten(F.array(*[or_empty(v) for v in values])) if len(values) > 1 else or_empty(values[0])
    return F.array_distinct(F.filter(F.transform(joined, lambda x: F.lower(trim_ws(x))), lambda x: x != ""))


def single(value) -> Column:
    """Scalar to array, null to empty."""
    return F.when(col(value).isNull(), empty()).otherwise(F.array(col(value)))


def keep_first(items: Column, key) -> Column:
    """Keep the first item of every key. A fold, so ``items`` is evaluated once, not once per element."""
    return F.aggregate(items, F.slice(items, 1, 0), lambda acc, x: F.when(
        F.exists(acc, lambda a: key(a) == key(x)), acc).otherwise(F.concat(acc, F.array(x))))


def dedupe_keep_first(value) -> Column:
    """Drop blanks and case-insensitive repeats, keeping the first spelling."""
    return F.filter(keep_first(or_empty(value), lambda x: F.lower(trim_ws(x))), lambda x: trim_ws(x) != "")


def expand_family(value, families: dict) -> Column:
    """Every value plus all members of each family that contains it (value order, family order)."""
    groups = [[m.strip().lower() for m in dict.fromkeys([name, *members])] for name, members in families.items()]
    members = sorted({m for g in groups for m in g})
    table = {m: list(dict.fromkeys(x for g in groups if m in g for x in g)) for m in members}
    if not table:
        return unique_lower(value)
    lookup = F.create_map(*[part for key, items in table.items()
                            for part in (F.lit(key), F.array(*[F.lit(i) for i in items]))])
    return F.array_distinct(F.flatten(F.transform(
        unique_lower(value), lambda v: F.concat(F.array(v), F.coalesce(F.try_element_at(lookup, v), empty())))))


def overlaps(left, right) -> Column:
    return F.coalesce(F.arrays_overlap(or_empty(left), or_empty(right)), F.lit(False))


def count_by(value) -> Column:
    """array<string> -> map<string,int> of counts (one pass over the sorted array)."""
    start = F.array().cast("array<struct<k:string,n:int>>")
    folded = F.aggregate(F.array_sort(or_empty(value)), start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["k"] == x),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            x.alias("k"), (F.element_at(acc, -1)["n"] + 1).alias("n")))))
        .otherwise(F.concat(acc, F.array(F.struct(x.alias("k"), F.lit(1).alias("n"))))))
    return F.map_from_entries(folded)
