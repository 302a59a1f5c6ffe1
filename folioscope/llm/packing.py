"""Packs of fixed capacity, filled by bounded-space online best fit.

The documents are dealt to shards by hash; each shard packs its own stream with a fixed
number of open packs. Open packs stand in buckets by free space, and a bitset over the
free spaces finds the least one that still holds the next piece in one step; if none does
and all places are taken, the fullest pack is closed. Only texts longer than the capacity
are split: full packs of their own, and one rest that is packed like any other piece.

Defined results: texts without tokens get no pack; a repeated doc_id counts once; an empty
table gives an empty result; the same rows give the same packs in any order and on any
cluster. What stays unused is at most what the last open packs of each shard leave.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCHEMA = "pack_id int, capacity_tokens int, doc_id bigint, piece int, first_token bigint, n_tokens bigint, pack_no string, pack_offset int"


class OpenPacks:
    """A bounded set of open packs, searched by free space."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.buckets: dict[int, list[int]] = {}
        self.bits = 0
        self.count = 0
        self.next_id = 0

    def _put(self, pack: int, free: int) -> None:
        if free:
            heapq.heappush(self.buckets.setdefault(free, []), pack)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        pack = heapq.heappop(self.buckets[free])
        if not self.buckets[free]:
            del self.buckets[free]
            self.bits ^= 1 << free
        self.count -= 1
        return pack

    def add(self, size: int) -> tuple[int, int]:
        """(pack, place of the first token) for a piece of at most the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + ((fitting & -fitting).bit_length() - 1)
            pack = self._take(free)
        else:
            if self.count >= self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
            pack, free = self.next_id, self.capacity
            self.next_id += 1
        self._put(pack, free - size)
        return pack, self.capacity - free


def pack_documents(sized: DataFrame, sizes: DataFrame, shard_tokens: int = 40_000_000, places: int = 256, most_sizes: int = 100) -> DataFrame:
    """pack_id, capacity_tokens, doc_id, piece, first_token, n_tokens, pack_no, pack_offset.

    `sized`: doc_id, n_tokens; `sizes`: pack_id, capacity_tokens. The number of shards
    follows from the total, so that a shard holds about `shard_tokens` tokens.
    """
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    shards = max(1, round(total / shard_tokens))
    kinds = sizes.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().orderBy("pack_id", "capacity_tokens").limit(most_sizes + 1).collect()
    if len(kinds) > most_sizes:
        raise ValueError(f"more than {most_sizes} capacities")
    listed = [F.struct(F.lit(k.pack_id).alias("pack_id"), F.lit(k.capacity_tokens).alias("capacity_tokens")) for k in kinds]
    if not listed:
        return sized.sparkSession.createDataFrame([], SCHEMA)
    pieces = (
        sized.where("n_tokens > 0")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        .withColumn("kind", F.explode(F.array(*listed)))
        .select("doc_id", "n_tokens", "shard", "kind.pack_id", "kind.capacity_tokens")
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, shard = int(group["pack_id"].iat[0]), int(group["capacity_tokens"].iat[0]), int(group["shard"].iat[0])
        packs, rows = OpenPacks(capacity, places), []
        # Arrival in the order of a hash: no pattern of the ids reaches the packs.
        for doc, n in group.sort_values(["turn", "doc_id"])[["doc_id", "n_tokens"]].itertuples(index=False):
            whole = n // capacity if n > capacity else 0
            for piece in range(whole):
                rows.append((doc, piece, piece * capacity, capacity, packs.next_id, 0))
                packs.next_id += 1
            rest = n - whole * capacity
            if rest:
                pack, offset = packs.add(rest)
                rows.append((doc, whole, whole * capacity, rest, pack, offset))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "n_tokens", "pack_no", "pack_offset"])
        out["pack_no"] = [f"{shard}-{p}" for p in out["pack_no"]]
        out.insert(0, "capacity_tokens", capacity)
        out.insert(0, "pack_id", kind)
        return out

    return (
        pieces.withColumn("turn", F.xxhash64("doc_id", F.lit(1)))
        .groupBy("pack_id", "capacity_tokens", "shard")
        .applyInPandas(fill, SCHEMA)
    )


def pack_report(packed: DataFrame) -> DataFrame:
    """Per capacity: documents, split documents, packs, tokens and the share of space used."""
    packs = packed.groupBy("pack_id", "capacity_tokens", "pack_no").agg(F.sum("n_tokens").alias("held"))
    space = packs.groupBy("pack_id", "capacity_tokens").agg(
        F.count("*").alias("packs"), F.sum("held").alias("tokens"), F.max("held").alias("fullest")
    )
    docs = packed.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces")).groupBy("pack_id").agg(
        F.count("*").alias("documents"), F.count(F.when(F.col("pieces") > 1, 1)).alias("split_documents")
    )
    return space.join(docs, "pack_id").select(
        "pack_id", "capacity_tokens", "documents", "split_documents", "packs", "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6).alias("used_share"),
    )
