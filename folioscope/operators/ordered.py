"""Ordered logic as windows: gaps, runs, segments, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def sequence_breaks(df: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Rows whose number repeats, falls behind or jumps ahead of the row before.

    Keys with repeated `order` values are first made distinct; nulls are skipped.
    """
    w = W.partitionBy(*keys).orderBy(order, number)
    seen = df.where(F.col(order).isNotNull() & F.col(number).isNotNull()).select(*keys, order, number).distinct()
    before = seen.withColumn("previous", F.lag(number).over(w))
    step = F.col(number) - F.col("previous")
    kind = F.when(step == 0, "repeated").when(step < 0, "goes_back").when(step > 1, "jump")
    return before.withColumn("kind", kind).where("kind is not null")


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive rows with the same value (nulls are a value)."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    marked = df.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(
        F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")
    ).withColumnRenamed("_run", "run")


def page_segments(pages: DataFrame, file_col: str, page_col: str, class_col: str, blank: Column, continues: Column, single: list[str]) -> DataFrame:
    """Pieces of a file from the classes of its pages.

    A classed page opens a piece, except that pages of the same class after it extend it
    unless the class is one of `single`; pages for which `continues` holds extend it too.
    Blank pages belong to a piece only if a continuing page follows before the next opening.
    """
    w = W.partitionBy(file_col).orderBy(page_col)
    typed = pages.withColumn("_blank", F.coalesce(blank, F.lit(False))).withColumn("_cont", F.coalesce(continues, F.lit(False)))
    typed = typed.withColumn("_class", F.when(~F.col("_blank") & ~F.col("_cont"), F.col(class_col)))
    last = F.last("_class", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("_class").isNotNull() & (~F.col("_class").eqNullSafe(last) | F.col("_class").isin(*single))
    numbered = typed.withColumn("_open", opens.cast("int")).withColumn("piece_no", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))
    in_piece = W.partitionBy(file_col, "piece_no").orderBy(page_col)
    ahead = F.last(F.when(~F.col("_blank"), F.col(page_col)), ignorenulls=True).over(in_piece.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    kept = numbered.withColumn("_end", ahead).where((F.col("piece_no") > 0) & (F.col(page_col) <= F.col("_end")))
    return kept.groupBy(file_col, "piece_no").agg(
        F.max("_class").alias("type"), F.min(page_col).alias("page_from"), F.max(page_col).alias("page_to"), F.count("*").alias("pages")
    )


def chain(df: DataFrame, key: str, node: str) -> DataFrame:
    """Links between neighbours that share a key: i to i + 1 in order of the node, not all pairs."""
    w = W.partitionBy(key).orderBy(node)
    linked = df.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(key, node).distinct()
    return linked.withColumn("next", F.lead(node).over(w)).where("next is not null")


def follow_chain(links: DataFrame, node: str, next_col: str) -> DataFrame:
    """node and the head of its chain, by pointer doubling: log2(length) joins.

    `links` gives at most one `next_col` (towards the head) per node; nodes without one are
    heads. Doubling as often as the number of nodes asks for ends every chain; what still
    moves then runs into a cycle, and its head is a node of that cycle.
    """
    state = links.select(F.col(node).alias("n"), F.coalesce(F.col(next_col), F.col(node)).alias("to"))
    missing = state.select(F.col("to").alias("n")).distinct().join(state.select("n"), "n", "left_anti").select("n", F.col("n").alias("to"))
    state = cut_lineage(state.unionByName(missing).distinct())
    for _ in range(state.count().bit_length() + 1):
        jumped = cut_lineage(
            state.alias("s").join(state.select(F.col("n").alias("to"), F.col("to").alias("far")), "to").select("n", "to", "far")
        )
        moved = jumped.where(F.col("to") != F.col("far")).limit(1).count()
        state = jumped.select("n", F.col("far").alias("to"))
        if not moved:
            break
    return state.select(F.col("n").alias(node), F.col("to").alias("head"))
