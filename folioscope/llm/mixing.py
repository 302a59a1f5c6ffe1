"""A mix of sources by target shares, interleaved by Pfair scheduling.

The size of the mix is the largest at which no source needs more than its tokens times its
allowed repeats. Each source then contributes its share, in whole documents, going round
its documents in the order of a hash. The documents of a source are laid end to end and cut
into steps of equal length; a document belongs to the step that holds its middle, so what it
overruns is missing from the source's next step. Step k of a source with share w is released
at floor(k / w) and due at ceil((k + 1) / w); of the released steps the one with the earliest
deadline comes next. A block is two steps, and a step is long enough for the longest
document, so that at any point of the mix each source is within less than one block of its
share. As the weights are whole numbers, the schedule repeats after their sum; only one
period of it is ever computed on the driver.

Running sums are built from sums of hash buckets, whose number grows with the documents, so
that a source with most of the rows is never sorted in one task.

Defined results: a source without documents or without a target share contributes nothing,
and the shares of the others are scaled to one; repeated doc_ids count once; texts without
tokens are not chosen; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def pfair_order(shares: dict[str, Fraction], blocks: int) -> list[tuple[int, str, int]]:
    """(slot, source, block of the source) for `blocks` slots, earliest deadline first."""
    waiting = [(0, math.ceil(1 / w), s, 0) for s, w in sorted(shares.items()) if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(blocks):
        while waiting and waiting[0][0] <= slot:
            _, due, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, k))
        if not ready:
            continue
        _, source, k = heapq.heappop(ready)
        out.append((slot, source, k))
        w = shares[source]
        heapq.heappush(waiting, (math.floor((k + 1) / w), math.ceil((k + 2) / w), source, k + 1))
    return out


def whole_weights(shares: dict[str, float], most: int = 100_000) -> dict[str, int]:
    """The shares as whole numbers of like proportions, whose sum is the period of the schedule.

    Shares are kept to one part in `most`; no source with a share gets nothing.
    """
    scaled = {s: max(1, round(Fraction(w) / Fraction(sum(shares.values())) * most)) for s, w in shares.items()}
    common = reduce(math.gcd, scaled.values())
    return {s: w // common for s, w in scaled.items()}


def step_length(longest: int, weights: dict[str, int]) -> int:
    """The least step for which overruns of whole documents and the schedule stay within a block (two steps).

    Each source may be off its steps by half a document; a source feels its own overrun and
    its share of all others'.
    """
    most = max(weights.values()) / sum(weights.values())
    return max(1, math.ceil(longest * (1 + most * max(0, len(weights) - 2)) / 2))


def mix_sources(sized: DataFrame, targets: DataFrame, step: int | None = None, bucket_docs: int = 100_000) -> DataFrame:
    """doc_id, source, repeat_no, n_tokens, slot, place of every chosen copy of a document.

    `sized`: doc_id, source, n_tokens; `targets`: source, target_share, max_repeats (at most
    10,000 sources, checked). The mix is read by slot and, within one, by place. `step` is the
    length of a slot in tokens; a longer one than the documents need is taken as it is.
    """
    spark = sized.sparkSession
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("most")
    )
    docs = sized.where("n_tokens > 0 and source is not null").join(wanted, "source", "left_semi").select("doc_id", "source", "n_tokens")
    docs = cut_lineage(docs)
    per_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.max("n_tokens").alias("longest"))
    totals = {r.source: r for r in per_source.join(wanted, "source").limit(10_001).collect()}
    if len(totals) > 10_000:
        raise ValueError("more than 10,000 sources")
    if not totals:
        return spark.createDataFrame([], "doc_id bigint, source string, repeat_no int, n_tokens bigint, slot bigint, place bigint")
    weights = whole_weights({s: r.share for s, r in totals.items()})
    period = sum(weights.values())
    shares = {s: Fraction(w, period) for s, w in weights.items()}
    size = min(Fraction(r.tokens * r.most) / shares[s] for s, r in totals.items())
    length = max(step or 0, step_length(max(r.longest for r in totals.values()), weights))
    plan = spark.createDataFrame(
        [(s, totals[s].tokens, float(shares[s] * size), weights[s]) for s in sorted(totals)], "source string, tokens bigint, quota double, weight int"
    )
    buckets = math.ceil(sum(r.docs for r in totals.values()) / bucket_docs)
    docs = docs.withColumn("turn", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(buckets)).cast("int"))
    per_bucket = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_bucket.select("source", "bucket", before.alias("offset"))
    inside = W.partitionBy("source", "bucket").orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "bucket"])
    start = placed.join(F.broadcast(plan), "source").withColumn("start", F.col("offset") + F.col("inside"))
    # Copy r starts at r times the source's tokens; it is chosen if its middle lies within the quota.
    rounds = F.ceil(F.col("quota") / F.col("tokens")).cast("int")
    copies = start.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), rounds))).withColumn(
        "place", F.col("start") + (F.col("repeat_no") - 1) * F.col("tokens")
    )
    middle = F.col("place") + F.col("n_tokens") / 2
    k = F.floor(middle / length)
    chosen = copies.where(middle <= F.col("quota")).withColumn("turn_no", F.floor(k / F.col("weight"))).withColumn("k", F.pmod(k, F.col("weight")).cast("int"))
    slots = spark.createDataFrame([(s, k, slot) for slot, s, k in pfair_order(shares, period)], "source string, k int, at int")
    return chosen.join(slots, ["source", "k"]).select(
        "doc_id", "source", "repeat_no", "n_tokens", (F.col("turn_no") * period + F.col("at")).alias("slot"), "place"
    )


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and reached share, tokens, documents, copies and the most repeats."""
    per = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("copies"), F.max("repeat_no").alias("repeats")
    )
    whole = per.agg(F.sum("tokens").alias("whole")).first().whole
    return (
        targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
        .select(
            "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
            F.round(F.coalesce("tokens", F.lit(0)) / F.lit(whole), 6).alias("reached_share"),
        )
    )
