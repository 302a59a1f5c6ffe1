"""Near-duplicate texts by SetSketch registers.

Each text becomes the set of its runs of words. A SetSketch register holds the smallest of
exponentially distributed hash values of the set, on a logarithmic scale of base b and cut
to a range; sketches of parts merge by maximum. Texts that agree in all registers of some
band are candidates; their similarity is estimated jointly from the registers by maximum
likelihood (as the likelihood is concave, its slope at the bound decides), and the pairs
that may reach the threshold are verified on the sets themselves.

Texts with equal sets form one class; pairs are sought between classes and handed out to
the members only where they are asked for.

Defined results: null and empty texts and texts of fewer than `min_words` words belong to
no pair; texts of any length are read whole; repeated rows of an id count once; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Base, rate and range of the registers (two bytes each).
BASE, RATE, TOP = 1.001, 20.0, 65_534
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, run: int) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes of the runs of `run` lower-cased words, and the number of words."""
    words = text.lower().split()
    if len(words) < run:
        return np.empty(0, dtype=np.uint64), len(words)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    acc = np.full(len(words) - run + 1, _GOLDEN)
    for k in range(run):
        acc = _mix(acc + each[k : len(words) - run + 1 + k])
    return np.unique(acc), len(words)


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """The m SetSketch registers of a set of 64-bit hashes, which are well mixed already."""
    seeds = np.arange(1, m + 1, dtype=np.uint64) * _GOLDEN
    least = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 128):
        x = (hashes[i : i + 128, None] ^ seeds) * _MIX_A
        x ^= x >> np.uint64(32)
        x *= _MIX_B
        np.minimum(least, x.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(value) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_values(k: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of `rows` registers; four registers fill one word before it is scrambled."""
    words = -(-rows // 4)
    packed = np.zeros((bands, words * 4), dtype=np.uint16)
    packed[:, :rows] = k[: bands * rows].reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for part in packed.view(np.uint64).T:
        acc = _mix(acc + part)
    return acc


def bands_for(threshold: float, rows: int, miss: float = 5e-4) -> int:
    """Bands needed so that a pair at the threshold is missed with probability `miss`."""
    return math.ceil(math.log(miss) / math.log(1.0 - threshold**rows))


def _slope(greater: Column, less: Column, n_a: Column, n_b: Column, m: int, at: float) -> Column:
    """Slope of the log likelihood of similarity `at`, given how many registers differ which way."""
    u = n_a / (n_a + n_b)
    v = F.lit(1.0) - u
    k = (BASE - 1.0) / BASE

    def p(x: Column) -> Column:
        return -F.log(F.lit(1.0) - x * k) / math.log(BASE)

    def dp(x: Column) -> Column:
        return F.lit(k / math.log(BASE)) / (F.lit(1.0) - x * k)

    up, down = u - v * at, v - u * at
    d_up, d_down = -v * dp(up), -u * dp(down)
    return greater * d_up / p(up) + less * d_down / p(down) - (F.lit(m) - greater - less) * (d_up + d_down) / (F.lit(1.0) - p(up) - p(down))


def near_duplicate_classes(
    texts: DataFrame, id_col: str, text_col: str, run: int = 5, threshold: float = 0.8, min_words: int = 1, rows: int = 4, probe: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(members, links): id, rep of every text of enough words, and rep_a, rep_b of all pairs of classes that reach the similarity.

    A class has the texts of equal sets; `rep` is its smallest id. `rows` registers make a
    band; the number of bands follows from the threshold. `probe` registers serve the joint
    estimate, which lets a pair through up to four standard errors below the threshold.
    Hot bands are split by the adaptive skew join.
    """
    bands = bands_for(threshold, rows)
    m = max(bands * rows, probe)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {"id": [], "set_key": [], "size": [], "probe": [], "bands": []}
            for i, text in zip(b["id"], b["text"], strict=True):
                hashes, words = shingle_hashes(text, run)
                if words < min_words or not len(hashes):
                    continue
                k = registers(hashes, m)
                acc = band_values(k, bands, rows)
                out["id"].append(i)
                out["set_key"].append(xxhash.xxh128_digest(hashes.tobytes()))
                out["size"].append(len(hashes))
                out["probe"].append((k[:probe].astype(np.int32) - 32_768).astype(np.int16))
                out["bands"].append(acc.view(np.int64))
            yield pd.DataFrame(out)

    filled = texts.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    once = lambda df: df.groupBy("id").agg(F.min("text").alias("text"))
    sketched = cut_lineage(
        once(filled).mapInPandas(sketch, "id bigint, set_key binary, size int, probe array<smallint>, bands array<bigint>")
    )
    reps = sketched.groupBy("set_key").agg(F.min("id").alias("rep"))
    members = sketched.select("id", "set_key").join(reps, "set_key").select("id", "rep")
    classes = sketched.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), "size", "probe", "bands")
    # Most band values stand alone; the others are kept and met with themselves.
    banded = classes.select("rep", "size", F.explode("bands").alias("band")).withColumn("n", F.count("*").over(W.partitionBy("band")))
    banded = cut_lineage(banded.where("n > 1").select("rep", "size", "band"))
    fits = F.least("size", "size_b") >= F.greatest("size", "size_b") * threshold
    candidates = (
        banded.toDF("rep_a", "size", "band")
        .join(banded.toDF("rep_b", "size_b", "band"), "band")
        .where((F.col("rep_a") < F.col("rep_b")) & fits)
        .select("rep_a", "rep_b")
        .distinct()
    )
    part = classes.select("rep", "size", "probe")
    pairs = candidates.join(part.toDF("rep_a", "size_a", "probe_a"), "rep_a").join(part.toDF("rep_b", "size_b", "probe_b"), "rep_b")
    # One pass for both counts: thousands count where a is greater, units where it is less.
    signs = F.zip_with("probe_a", "probe_b", lambda x, y: F.when(x > y, 1000).when(x < y, 1).otherwise(0))
    margin = 4.0 * math.sqrt(threshold * (1.0 - threshold) / probe)
    counted = pairs.select("rep_a", "rep_b", "size_a", "size_b", F.aggregate(signs, F.lit(0), lambda s, x: s + x).alias("signs"))
    greater, less = F.floor(F.col("signs") / 1000).cast("double"), (F.col("signs") % 1000).cast("double")
    likely = cut_lineage(
        counted.where(_slope(greater, less, F.col("size_a").cast("double"), F.col("size_b").cast("double"), probe, max(threshold - margin, 0.05)) >= 0).select("rep_a", "rep_b")
    )

    @F.pandas_udf("array<bigint>")
    def sets(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, run)[0].view(np.int64) for t in batch])

    touched = likely.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    whole = cut_lineage(once(filled.join(touched, "id", "left_semi")).select("id", sets("text").alias("set")))
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = (
        likely.join(whole.toDF("rep_a", "set_a"), "rep_a")
        .join(whole.toDF("rep_b", "set_b"), "rep_b")
        .where(common >= threshold * (F.size("set_a") + F.size("set_b") - common))
        .select("rep_a", "rep_b")
    )
    return members, links


def pairs_of_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b) of all pairs of texts, classes of equal texts written out.

    The result is as large as the pairs asked for, k * k / 2 for k equal texts; use the classes where that isn't wanted.
    """
    across = links.join(members.toDF("x", "rep_a"), "rep_a").join(members.toDF("y", "rep_b"), "rep_b").select("x", "y")
    within = members.toDF("x", "rep").join(members.toDF("y", "rep"), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """id_a, id_b (id_a < id_b): all pairs whose sets of word runs reach the similarity (see `near_duplicate_classes`)."""
    return pairs_of_classes(*near_duplicate_classes(texts, id_col, text_col, **settings))
