"""Decisions as an append-only log over machine facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_decisions(log: DataFrame, keys: list[str], sequence: str = "decision_id") -> DataFrame:
    """The last decision per key."""
    w = W.partitionBy(*keys).orderBy(F.desc(sequence))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overlay(facts: DataFrame, log: DataFrame, keys: list[str], sequence: str = "decision_id", lock: str | None = None) -> DataFrame:
    """Facts with the last decision applied.

    `log` has the keys, the sequence, `action` (verify, correct, illegible, absent, ambiguous,
    revert) and `value`. A reverted decision leaves the machine's fact; facts are never dropped.
    With `lock`, a column of both, a decision counts only if it was made on what the fact is now.
    """
    seen = [] if lock is None else [F.col(lock).alias("seen")]
    last = last_decisions(log, keys, sequence).where("action <> 'revert'").select(*keys, "action", F.col("value").alias("decided"), *seen)
    joined = facts.join(last, keys, "left")
    if lock is not None:
        joined = joined.withColumn("action", F.when(F.col("seen").eqNullSafe(F.col(lock)), F.col("action"))).drop("seen")
    value = F.when(F.col("action") == "correct", F.col("decided")).when(F.col("action").isin("illegible", "absent", "ambiguous"), F.lit(None)).otherwise(F.col("literal"))
    state = (
        F.when(F.col("action") == "verify", "verificado").when(F.col("action") == "correct", "corregido").when(F.col("action") == "illegible", "ilegible")
        .when(F.col("action") == "absent", "ausente").when(F.col("action") == "ambiguous", "ambiguo").otherwise(F.col("state"))
    )
    return joined.withColumn("literal", value).withColumn("state", state).drop("action", "decided")


def upsert(old: DataFrame, new: DataFrame, key: str, review: str = "review") -> DataFrame:
    """Found rows by key: kept reviews, `gone` where no longer found, new ones unreviewed.

    A full outer join: what people wrote stays even if a rule no longer finds the row.
    """
    fresh = [c for c in new.columns if c != key]
    o, n = old.alias("o"), new.withColumn("_found", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    found = F.col("n._found").isNotNull()
    return joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *[F.when(found, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fresh],
        F.coalesce(F.col(f"o.{review}"), F.lit("new")).alias(review),
        (~found).alias("gone"),
    )


def stable_key(*parts: Column) -> Column:
    """sha-256 over parts in a fixed form; nulls are told apart from empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def reanchor(decisions: DataFrame, fields: DataFrame, overlap: Column, least: float = 0.5) -> DataFrame:
    """decision_id, field_id, outcome for decisions whose page and box must find their field again.

    `decisions`: decision_id, file_sha, page_no, field_name, box_d; `fields`: field_id and the
    same with box_f. One clear best overlap gives `applied`; several equal ones, or two
    decisions on one field, or none, need a person.
    """
    pairs = decisions.join(fields, ["file_sha", "page_no", "field_name"], "left").withColumn("score", overlap)
    ranked = pairs.withColumn("score", F.when(F.col("score") >= least, F.col("score")))
    by = W.partitionBy("decision_id")
    best = ranked.withColumn("top", F.max("score").over(by)).where("score = top or top is null")
    counted = best.groupBy("decision_id").agg(F.max("top").alias("top"), F.count("*").alias("n"), F.min("field_id").alias("field_id"))
    claims = counted.withColumn("claims", F.count("*").over(W.partitionBy("field_id")))
    outcome = F.when(F.col("top").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("claims") > 1, "collides").otherwise("applied")
    return claims.select("decision_id", F.when(F.col("top").isNotNull(), F.col("field_id")).alias("field_id"), outcome.alias("outcome"))


def settle(outcomes: DataFrame, choices: DataFrame) -> DataFrame:
    """decision_id, field_id, outcome once people chose what happens to decisions that found no field.

    `outcomes` comes from `reanchor`; `choices`: decision_id, choice (`reassign`, `discard`,
    `pending`), field_id, choice_id; the last choice counts. What was applied is not touched,
    and what nobody chose for stays pending.
    """
    last = last_decisions(choices, ["decision_id"], "choice_id").select("decision_id", "choice", F.col("field_id").alias("chosen"))
    open_ = F.col("outcome") != "applied"
    moved = open_ & (F.col("choice") == "reassign") & F.col("chosen").isNotNull()
    outcome = F.when(moved, "reassigned").when(open_ & (F.col("choice") == "discard"), "discarded").when(open_, "pending").otherwise(F.col("outcome"))
    return outcomes.join(last, "decision_id", "left").select("decision_id", F.when(moved, F.col("chosen")).when(~open_, F.col("field_id")).alias("field_id"), outcome.alias("outcome"))
