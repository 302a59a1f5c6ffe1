"""Joins, set operations and paging that recur in the analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def only_match(right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and `value` for the keys that have exactly one distinct value."""
    return right.groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).where("_n = 1").drop("_n")


def join_only_match(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join that answers null where the match is missing or ambiguous."""
    return left.join(only_match(right, keys, value), keys, "left")


def either_end(edges: DataFrame, ends: tuple[str, str], nodes: DataFrame, node: str) -> DataFrame:
    """Edges that touch a node on either end: a union of two equi-joins instead of OR."""
    parts = [edges.join(nodes.select(F.col(node).alias(e)), e, "left_semi") for e in ends]
    return parts[0].union(parts[1].select(*parts[0].columns)).distinct()


def absent_pairs(things: DataFrame, expected: list[str], present: DataFrame, key: str, what: str) -> DataFrame:
    """Every (key, expected) that `present` lacks; `expected` is a literal list."""
    wanted = things.select(key).distinct().withColumn(what, F.explode(F.array(*[F.lit(e) for e in expected])))
    return wanted.join(present.select(key, what).distinct(), [key, what], "left_anti")


def page_of(df: DataFrame, sort: list[Column], offset: int, limit: int, most: int = 500) -> DataFrame:
    """One page of a list in a total order; the caller ends `sort` with a unique key."""
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset not negative")
    return df.orderBy(*sort).offset(offset).limit(limit)


def contains_anywhere(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which any column contains the text, case and accents aside; no text keeps all."""
    from folioscope.functions.text import fold, py_fold

    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(fold(c).contains(py_fold(text)), F.lit(False)) for c in columns]))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def symmetric_difference(a: Column, b: Column) -> Column:
    """Sorted members of exactly one of two arrays."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def closure(root: DataFrame, key: str, links: list[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Everything that hangs from the root rows along a static list of foreign keys.

    `links`: (name, child table, its foreign key, the column it carries on), parents first.
    """
    found = {"root": root.select(key).distinct()}
    carried = {key: found["root"]}
    for name, child, foreign, on in links:
        if foreign not in carried:
            raise ValueError(f"{name} hangs from {foreign}, which nothing before it carries")
        rows = child.join(carried[foreign], foreign, "left_semi")
        found[name] = rows
        carried[on] = rows.select(on).distinct()
    return found
