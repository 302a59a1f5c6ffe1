"""Joins on intervals, points and neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(left_start: Column, left_end: Column, right_start: Column, right_end: Column) -> Column:
    """Closed intervals that share a day; null ends never overlap."""
    return (left_start <= right_end) & (right_start <= left_end)


def shared_days(left_start: Column, left_end: Column, right_start: Column, right_end: Column) -> Column:
    """Days in common, both ends included."""
    return F.datediff(F.least(left_end, right_end), F.greatest(left_start, right_start)) + 1


def interval_self_join(rows: DataFrame, keys: list[str], id_col: str, start: str, end: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id_a < id_b) of rows with equal keys whose closed intervals overlap.

    An equi-join on the keys and on the calendar year buckets that an interval touches,
    so that one long-lived key spreads over tasks; a pair is kept in the first bucket
    that both touch only, hence once.
    """
    years = F.sequence(F.year(start), F.year(end))
    spread = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).withColumn("bucket", F.explode(years))
    side = lambda s: spread.select(*keys, "bucket", *[F.col(c).alias(f"{c}_{s}") for c in (id_col, start, end, *carry)])
    joined = side("a").join(side("b"), [*keys, "bucket"])
    first = F.year(F.greatest(f"{start}_a", f"{start}_b"))
    return (
        joined.where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
        .where(overlaps(F.col(f"{start}_a"), F.col(f"{end}_a"), F.col(f"{start}_b"), F.col(f"{end}_b")))
        .where(F.col("bucket") == first)
        .withColumn("days", shared_days(F.col(f"{start}_a"), F.col(f"{end}_a"), F.col(f"{start}_b"), F.col(f"{end}_b")))
        .drop("bucket")
    )


def follow_ups(rows: DataFrame, keys: list[str], id_col: str, start: str, end: str, most_days: int = 31) -> DataFrame:
    """Ordered pairs where one interval starts 0 to `most_days` days after the other ends."""
    a = rows.select(*keys, F.col(id_col).alias("id_a"), F.col(end).alias("ended"))
    b = rows.select(*keys, F.col(id_col).alias("id_b"), F.col(start).alias("begun"))
    gap = F.datediff("begun", "ended")
    return a.join(b, keys).where((F.col("id_a") != F.col("id_b")) & gap.between(0, most_days)).select(*keys, "id_a", "id_b", gap.alias("gap_days"))


def point_in_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str, first: str, last: str, prefer: str) -> DataFrame:
    """Each point with the span that holds it; of several the one with the smallest `prefer`."""
    inside = F.col(point).between(F.col(first), F.col(last))
    found = points.join(spans, keys).where(inside)
    best = W.partitionBy(*[found[c] for c in points.columns]).orderBy(prefer)
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """As-of join: for each left row the values of the latest right row not after it.

    One union and one window per key instead of a range join; ties on time take the
    largest values. Left rows with a null key or time keep null values.
    """
    marked = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(_struct_type(right, values)))
    facts = right.select(
        *keys, F.lit(0).alias("_side"), F.col(since).alias("_t"), F.struct(*values).alias("_v"),
    )
    both = marked.unionByName(facts.where(F.col(since).isNotNull()), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    seen = both.withColumn("_v", F.when(usable, F.last("_v", ignorenulls=True).over(order))).where("_side = 1")
    return seen.select(*left.columns, *[F.col("_v")[v].alias(v) for v in values])


def _struct_type(df: DataFrame, values: list[str]) -> str:
    return df.select(F.struct(*values).alias("s")).schema["s"].dataType.simpleString()


def within_days(left: DataFrame, right: DataFrame, keys: list[str], at: str, on: str, days: int) -> DataFrame:
    """All pairs with equal keys at most `days` apart: an equi-join on the day, spread over the window."""
    spread = left.withColumn("_day", F.explode(F.sequence(F.date_sub(at, days), F.date_add(at, days))))
    return spread.join(right, [*[spread[k] == right[k] for k in keys], spread["_day"] == right[on]]).drop("_day", *[right[k] for k in keys])
