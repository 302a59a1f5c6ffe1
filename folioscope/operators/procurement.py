"""Which papers of a case may belong to one procurement, from shared keys, nearness and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import graph

#: Fixed value: pages between the end of one paper and the start of the next for a shared tax id to count.
NEAR_PAGES = 3


def near_pairs(papers: DataFrame, pages: int = NEAR_PAGES) -> DataFrame:
    """case_id, a, b (a < b): papers of a file with a common tax id where b starts within `pages` of a's end.

    `papers`: case_id, node, file, page_from, page_to, tax. An equi-join on blocks of pages,
    so that a supplier with many papers in a file meets its neighbours only.
    """
    known = papers.where("file is not null and tax is not null and page_from is not null and page_to is not null").distinct()
    block = lambda c: F.floor(c / (pages + 1)).cast("int")
    left = known.select("case_id", "file", "tax", F.col("node").alias("a"), "page_to", F.explode(F.array(*[block(F.col("page_to")) + d for d in (-1, 0, 1)])).alias("block"))
    right = known.select("case_id", "file", "tax", F.col("node").alias("b"), "page_from", block(F.col("page_from")).alias("block"))
    close = F.abs(F.col("page_to") - F.col("page_from")) <= pages
    return left.join(right, ["case_id", "file", "tax", "block"]).where((F.col("a") < F.col("b")) & close).select("case_id", "a", "b").distinct()


def procurement_groups(papers: DataFrame, anchors: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """case_id, node, group of the papers that belong together, at least two in a group.

    `papers`: as for `near_pairs`, with `label` (file number; two different ones never
    merge); `anchors`: case_id, node, key of what is printed on the papers (file, order or
    invoice numbers), which link wherever two papers share one; `sets`: case_id, file, set of
    files that came in together. A tax id links only papers that are near each other or whose
    files share a set. Links are walked in the order of the papers.
    """
    labels = papers.groupBy("case_id", "node").agg(F.min("label").alias("label"))
    near = near_pairs(papers).withColumn("key", F.concat_ws("|", F.lit("near"), "a", "b"))
    members = anchors.select("case_id", "node", F.concat_ws("|", F.lit("anchor"), "key").alias("key"))
    members = members.unionByName(near.select("case_id", F.explode(F.array("a", "b")).alias("node"), "key"))
    if sets is not None:
        in_set = papers.where("tax is not null").join(sets, ["case_id", "file"])
        members = members.unionByName(in_set.select("case_id", "node", F.concat_ws("|", F.lit("set"), "set", "tax").alias("key")))
    held = members.distinct().join(labels, ["case_id", "node"])
    grouped = graph.constrained_cliques(held, "case_id", "key", "node", "label")
    size = grouped.groupBy("case_id", "group").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "group")
    return grouped.join(size, ["case_id", "group"], "left_semi").select("case_id", "node", "group")
