"""Persons from facts: keys, proposals, decided merges."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.identifiers import compare_key
from folioscope.functions.text import py_fold
from folioscope.operators.fuzzy import name_likeness_of
from folioscope.operators.graph import components
from folioscope.session import cut_lineage


def resolve_persons(contracts: DataFrame) -> DataFrame:
    """One person per strong key and case; every contract without key is a person of its own.

    The stable id comes from the key or from the paper, so that a rebuild finds it again.
    """
    stable = F.coalesce(
        F.concat(F.lit("clave:"), F.col("strong_key")), F.concat(F.lit("doc:"), F.col("file_sha"), F.lit("#"), F.col("piece_id").cast("string"))
    )
    return contracts.withColumn("stable_id", stable).groupBy("case_id", "stable_id").agg(
        F.max("strong_key").alias("strong_key"), F.min("nombre").alias("name"), F.count("*").alias("contracts")
    )


def same_name_other_key(aliases: DataFrame) -> DataFrame:
    """Homonyms: a compared name with several strong keys in one case."""
    named = aliases.where("strong_key is not null").select("case_id", compare_key(F.col("name_literal")).alias("name_key"), "strong_key").distinct()
    return named.groupBy("case_id", "name_key").agg(F.count("*").alias("keys"), F.array_join(F.array_sort(F.collect_list("strong_key")), "|").alias("strong_keys")).where(
        "keys > 1"
    )


def _normal(name: str) -> Column:
    """The words that `name_likeness` compares."""

    @F.pandas_udf("string")
    def normal(names: pd.Series) -> pd.Series:
        return names.map(lambda s: " ".join(py_fold(s).replace(",", " ").split()))

    return normal(name)


def _pairs_of_letters(name: str) -> Column:
    """Neighbouring characters, repeated ones told apart by a number."""

    def numbered(s: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for gram in (s[i : i + 2] for i in range(len(s) - 1)):
            seen[gram] += 1
            out.append(f"{gram}{seen[gram]}")
        return out

    @F.pandas_udf("array<string>")
    def pairs(names: pd.Series) -> pd.Series:
        return names.map(numbered)

    return pairs(name)


def _name_candidates(names: DataFrame) -> DataFrame:
    """case_id, x, y: every two names (x < y) of a case that `name_likeness` can find alike.

    With the lengths summing to S, a ratio of 0.86 matches M >= 0.43 S characters in at most
    S - 2 M + 1 blocks, so at least 3 M - S - 1 >= 0.29 S - 1 pairs of letters are common, and
    the shorter name has at least 0.754 of the longer one's length. Names that share so many
    share one of their rarest (prefix filter). Equal words and abbreviated first names have
    their own keys.
    """
    told = cut_lineage(names.withColumn("n", F.length("norm")).withColumn("grams", _pairs_of_letters("norm")))
    grams = told.select("case_id", "norm", "n", F.explode("grams").alias("gram"))
    count = grams.groupBy("gram").agg(F.count("*").alias("seen"))
    least = F.greatest(F.lit(1), F.ceil(F.lit(0.2899 * 1.754) * F.col("n") - 1))
    rare = (
        grams.join(count, "gram").withColumn("rank", F.row_number().over(W.partitionBy("case_id", "norm").orderBy("seen", "gram")))
        .where(F.col("rank") <= F.col("n") - least).select("case_id", "norm", F.concat(F.lit("g"), "gram").alias("key"))
    )
    words = F.split("norm", " ")
    exact = told.select("case_id", "norm", F.explode(F.array(
        F.concat(F.lit("s"), F.array_join(F.array_sort(words), " ")), F.concat(F.lit("l"), F.size(words).cast("string"), F.lit(" "), F.element_at(words, -1))
    )).alias("key"))
    keyed = rare.unionByName(exact).join(told, ["case_id", "norm"])
    side = lambda s: keyed.select("case_id", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("norm", "n", "grams", "open")])
    total = F.col("n_x") + F.col("n_y")
    alike = (F.least("n_x", "n_y") >= 0.4299 * total) & (F.size(F.array_intersect("grams_x", "grams_y")) >= 0.2899 * total - 1)
    return (
        side("x").join(side("y"), ["case_id", "key"]).where("norm_x < norm_y and (open_x or open_y)").where(~F.col("key").startswith("g") | alike)
        .select("case_id", F.col("norm_x").alias("x"), F.col("norm_y").alias("y")).distinct()
    )


def merge_proposals(persons: DataFrame, decided: DataFrame | None = None, least: float = 0.86) -> DataFrame:
    """Pairs of persons of a case with like names, unless both have a strong key or it was decided.

    Every pair of a case at or above `least` is found (no likeness lies between 0 and 0.86);
    names are compared once, however many persons bear them.
    """
    named = cut_lineage(persons.where("name is not null").select("case_id", "stable_id", "name", "strong_key").withColumn("norm", _normal("name")).where("norm <> ''"))
    names = named.groupBy("case_id", "norm").agg(F.max(F.col("strong_key").isNull()).alias("open"))
    alike = (
        _name_candidates(names).withColumn("xy", name_likeness_of(F.col("x"), F.col("y"))).withColumn("yx", name_likeness_of(F.col("y"), F.col("x")))
        .where(F.greatest("xy", "yx") >= least)
        .unionByName(names.where("open").select("case_id", F.col("norm").alias("x"), F.col("norm").alias("y"), F.lit(1.0).alias("xy"), F.lit(1.0).alias("yx")))
    )
    # The ratio depends on the order: the person with the smaller id is the first.
    both = alike.select("case_id", F.col("x").alias("norm_a"), F.col("y").alias("norm_b"), F.col("xy").alias("likeness")).unionByName(
        alike.where("x <> y").select("case_id", F.col("y").alias("norm_a"), F.col("x").alias("norm_b"), F.col("yx").alias("likeness"))
    )
    side = lambda s: named.select("case_id", F.col("norm").alias(f"norm_{s}"), F.col("stable_id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("strong_key").alias(f"key_{s}"))
    pairs = (
        both.where(F.col("likeness") >= least).join(side("a"), ["case_id", "norm_a"]).join(side("b"), ["case_id", "norm_b"])
        .where("id_a < id_b and (key_a is null or key_b is null)").select("case_id", "id_a", "name_a", "id_b", "name_b", "likeness")
    )
    if decided is not None:
        pairs = pairs.join(decided.select("case_id", "id_a", "id_b"), ["case_id", "id_a", "id_b"], "left_anti")
    return pairs


def apply_merges(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """stable_id and the person that stands for its merged group; a person with key stands first."""
    groups = components(merges, "id_a", "id_b").toDF("stable_id", "group")
    grouped = persons.join(groups, "stable_id", "left").withColumn("group", F.coalesce("group", "stable_id"))
    first = F.first("stable_id").over(W.partitionBy("case_id", "group").orderBy(F.col("strong_key").isNull(), "stable_id"))
    return grouped.select("case_id", "stable_id", first.alias("merged_id"))


def mention_groups(mentions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Unresolved mentions that share a normal form, more than one spelling each, minus rejected forms."""
    found = (
        mentions.where("strong_key is null").groupBy("case_id", "name_norm")
        .agg(F.countDistinct("name_literal").alias("spellings"), F.countDistinct("alias_id").alias("mentions")).where("mentions > 1")
    )
    return found.join(rejected, ["case_id", "name_norm"], "left_anti") if rejected is not None else found
