"""Exact statistics of decimals, totals with explicit completeness, and accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, lowest, highest, mean, median, sd (n - 1) and iqr of a decimal column, per key.

    Quantiles interpolate linearly at (n - 1) p. Rows are counted per key and value first,
    map-side, and ranks come from the running counts of the distinct values: the rows of a hot
    key are never sorted in one task. Shown at two decimals, half up.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("decimal(18,4)").alias("v"))
    plain = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        (F.sum("v").cast("decimal(28,4)") / F.count("*").cast("decimal(10,0)")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("sd"),
    )
    w = W.partitionBy(*keys)
    counted = known.groupBy(*keys, "v").agg(F.count("*").alias("c")).withColumn("above", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))

    def quantile(quarters: int) -> Column:
        # Position (n - 1) * q / 4 as whole part and remainder in quarters.
        place = (F.col("n") - 1) * quarters
        low, rest = F.floor(place / 4), F.pmod(place, F.lit(4))
        holds = lambda rank: (rank < F.col("above")) & (rank >= F.col("above") - F.col("c"))
        weight = F.when(holds(low), 4 - rest).otherwise(0) + F.when(holds(low + 1), rest).otherwise(0)
        return F.sum(F.col("v") * weight.cast("decimal(3,0)")) / F.lit(4).cast("decimal(1,0)")

    quantiles = counted.groupBy(*keys).agg(quantile(2).alias("median"), quantile(1).alias("q1"), quantile(3).alias("q3"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = plain.alias("a").join(quantiles.alias("b"), same).select("a.*", "b.median", "b.q1", "b.q3")
    money = lambda c: F.round(c.cast("decimal(28,6)"), 2).cast("double")
    return both.select(
        *keys, "n", F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"),
        money(F.col("mean")).alias("mean"), money(F.col("median")).alias("median"), F.round("sd", 2).alias("sd"), money(F.col("q3") - F.col("q1")).alias("iqr"),
    )


def complete_total(value: Column, currency: Column) -> Column:
    """Sum of a group, null if any value is missing or the currencies differ."""
    return F.when((F.count(F.lit(1)) == F.count(value)) & (F.countDistinct(currency) == 1), F.sum(value))


def sums_against_totals(lines: DataFrame, keys: list[str], value: str, total: str) -> DataFrame:
    """keys, summed, printed where the lines don't add up to the printed total, both at two decimals, half up.

    Nothing is said of a group with a missing value or without a total.
    """
    g = lines.groupBy(*keys).agg(F.round(F.sum(value), 2).alias("summed"), F.max(total).alias("printed"), F.count("*").alias("n"), F.count(value).alias("known"))
    return g.where((F.col("known") == F.col("n")) & (F.col("summed") != F.round("printed", 2))).select(*keys, F.col("summed").cast("double").alias("summed"), F.col("printed").cast("double").alias("printed"))


def outliers_by_median(df: DataFrame, group: str, value: str, least: int = 5, factor: float = 1.6) -> DataFrame:
    """Rows above `factor` times the median of their group, for groups of at least `least` values."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    medians = known.groupBy(group).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median")).where(F.col("n") >= least)
    return known.join(medians, group).where(F.col(value) > F.col("median") * factor)


def confusion(predicted: DataFrame, truth: DataFrame, keys: list[str], value: str, flagged: Column, conflict: Column | None = None, others: Column | None = None) -> DataFrame:
    """Counts per field of hit, flagged_error, silent_error, omission, correct_null, not_found, in_conflict and rescuable.

    Both sides have the keys and `value`; `flagged` says whether a prediction was marked as
    doubtful, `conflict` whether its readings differ. A conflict is rescuable if one of
    `others`, the values it wavers between, is the truth.
    """
    no = F.lit(False)
    p = predicted.select(
        *keys, F.col(value).alias("p"), flagged.alias("doubtful"), F.lit(True).alias("known"), (no if conflict is None else F.coalesce(conflict, no)).alias("torn"),
        (F.array().cast("array<string>") if others is None else others).alias("others"),
    )
    t = truth.select(*keys, F.col(value).alias("t"))
    kind = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("torn") & F.coalesce(F.array_contains("others", F.col("t").cast("string")), no), "rescuable")
        .when(F.col("torn"), "in_conflict")
        .when(F.col("p").isNull() & F.col("t").isNull(), "correct_null")
        .when(F.col("p").isNull(), "omission")
        .when(F.col("p").eqNullSafe(F.col("t")), "hit")
        .when(F.col("doubtful"), "flagged_error")
        .otherwise("silent_error")
    )
    return t.join(p, keys, "left").groupBy(keys[-1], kind.alias("outcome")).agg(F.count("*").alias("n"))
