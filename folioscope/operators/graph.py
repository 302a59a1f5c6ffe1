"""Groups of linked things."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of an undirected graph, alternating big and small stars.

    Each round is two joins' worth of grouping; a hub is never collected, since the
    smallest neighbour comes from an aggregation and is joined back. The rounds grow with the
    logarithm of the nodes; more than `most_rounds` raise, so that no result is incomplete.
    """
    now = cut_lineage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    # Number and checksum of the edges: one pass tells whether a round changed them.
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        # Big star: neighbours above a node link to the smallest of its neighbourhood.
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        big = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: neighbours below a node, and the node, link to the smallest of them.
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        small = big.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        now = cut_lineage(small)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle within {most_rounds} rounds")
    nodes = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    heads = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return nodes.unionByName(heads).distinct()


def constrained_groups(edges: DataFrame, part: str, a: str, b: str, order: str, label_a: str, label_b: str) -> DataFrame:
    """part, node, group: union in a fixed order that never joins two different labels.

    Edges of one part (a case) are walked by `order`; an edge is skipped if its groups hold
    different known labels already. As the walk depends on the order, it can't be split;
    the memory of a part is its nodes, and its edges stream through a sort.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}
        labels: dict = {}
        current = None

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(current, n, find(n)) for n in root], columns=[part, "node", "group"])

        for batch in batches:
            for p, x, y, lx, ly in batch[[part, a, b, label_a, label_b]].itertuples(index=False):
                if p != current:
                    if root:
                        yield rows()
                    root, labels, current = {}, {}, p
                for n, label in ((x, lx), (y, ly)):
                    if n not in root:
                        root[n] = n
                        labels[n] = label if isinstance(label, str) else None
                rx, ry = find(x), find(y)
                if rx == ry or (labels[rx] and labels[ry] and labels[rx] != labels[ry]):
                    continue
                low, high = min(rx, ry), max(rx, ry)
                root[high] = low
                labels[low] = labels[low] or labels[high]
        if root:
            yield rows()

    kinds = dict(edges.dtypes)
    sorted_edges = edges.repartition(part).sortWithinPartitions(part, order, a, b)
    return sorted_edges.mapInPandas(walk, f"{part} {kinds[part]}, node {kinds[a]}, group {kinds[a]}")


def constrained_cliques(members: DataFrame, part: str, key: str, node: str, label: str) -> DataFrame:
    """part, node, group: as `constrained_groups` over all pairs of nodes that share a key, in order of the nodes.

    Only the links from the first node of each key to its others are walked. After them, the
    nodes of a key are one group or all labelled, so that the pairs left out can only join
    groups of the same label, which happens at the end. Time and memory of a part are its rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}
        labels: dict = {}
        held: list = []
        current = None

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def unite(x, y) -> None:
            rx, ry = find(x), find(y)
            if rx == ry or (labels[rx] and labels[ry] and labels[rx] != labels[ry]):
                return
            low, high = min(rx, ry), max(rx, ry)
            root[high] = low
            labels[low] = labels[low] or labels[high]

        def rows() -> pd.DataFrame:
            first: dict = {}
            for k, n in held:
                if (seen := labels[find(n)]) is not None:
                    unite(first.setdefault((k, seen), n), n)
            return pd.DataFrame([(current, n, find(n)) for n in root], columns=[part, "node", "group"])

        for batch in batches:
            for p, k, x, y, lx, ly in batch.itertuples(index=False):
                if p != current:
                    if root:
                        yield rows()
                    root, labels, held, current = {}, {}, [], p
                for n, told in ((x, lx), (y, ly)):
                    if n not in root:
                        root[n] = n
                        labels[n] = told if isinstance(told, str) else None
                held.append((k, y))
                unite(x, y)
        if root:
            yield rows()

    kinds = dict(members.dtypes)
    once = members.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(part, key, node, label).distinct()
    w = W.partitionBy(part, key)
    star = once.withColumn("first", F.min(F.struct(node, label)).over(w)).withColumn("size", F.count("*").over(w)).where("size > 1")
    rows_in = star.select(part, key, F.col(f"first.{node}").alias("x"), F.col(node).alias("y"), F.col(f"first.{label}").alias("lx"), F.col(label).alias("ly"))
    # The first node stands in its own key too (a link to itself joins nothing).
    return rows_in.repartition(part).sortWithinPartitions(part, "x", "y", key).mapInPandas(walk, f"{part} {kinds[part]}, node {kinds[node]}, group {kinds[node]}")
