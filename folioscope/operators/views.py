"""Working views over extracted facts: long rows to one row per piece.

Repeated rows count once; a piece without any firm field still appears, with nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import amount_cents, day_month_year, digits, person_key
from folioscope.schema import FAMILIES, FIELDS, FIRM_STATES, HUMAN_STATES


def is_firm(state: Column) -> Column:
    """Whether a state may feed totals and identities; null states may not."""
    return F.coalesce(state.isin(*FIRM_STATES), F.lit(False))


def classify_state(human: Column, conflict: Column, value: Column, confidence: Column, threshold: float) -> Column:
    """State of a fact: a human decision, then conflict, then absence, then confidence."""
    return (
        F.when(human.isin(*HUMAN_STATES), human)
        .when(F.coalesce(conflict, F.lit(False)), "conflicto")
        .when(value.isNull(), "no_revisado")
        .when(confidence.isNull() | (confidence < threshold), "pendiente_baja")
        .otherwise("automatico_alta")
    )


def family(page_class: Column) -> Column:
    """Family of a class of paper; null if it belongs to none."""
    expr = F.lit(None).cast("string")
    for name, members in FAMILIES.items():
        expr = F.when(page_class.isin(*members), name).otherwise(expr)
    return expr


def distinct_facts(fields: DataFrame) -> DataFrame:
    """One row per field_id."""
    kept = ("case_id", "piece_id", "file_sha", "field_name", "literal", "null_reason", "page_no", "confidence", "state")
    return fields.groupBy("field_id").agg(F.min(F.struct(*kept)).alias("f")).select("field_id", "f.*")


def wide_facts(fields: DataFrame, gated: bool = True) -> DataFrame:
    """One row per piece: literal of each field, lowest confidence, number of human fields.

    With `gated`, only firm facts are shown; without, each value stands beside its state.
    """
    facts = distinct_facts(fields)
    shown = is_firm(F.col("state")) if gated else F.lit(True)
    picks = []
    for name in FIELDS:
        here = (F.col("field_name") == name) & shown
        picks.append(F.max(F.when(here, F.col("literal"))).alias(name))
        if not gated:
            picks.append(F.max(F.when(here, F.col("state"))).alias(f"{name}_state"))
    return facts.groupBy("case_id", "piece_id", "file_sha").agg(
        *picks,
        F.min(F.when(shown, F.col("confidence"))).alias("lowest_confidence"),
        F.count(F.when(F.col("state").isin(*HUMAN_STATES), 1)).alias("human_fields"),
    )


def contracts(fields: DataFrame) -> DataFrame:
    """Typed contracts: person key, name, cents and the two dates, from firm facts."""
    wide = wide_facts(fields)
    return wide.select(
        "case_id", "piece_id", "file_sha", "nombre",
        F.coalesce(person_key(F.col("documento")), F.concat_ws("#", F.lit("doc:").cast("string"), F.col("file_sha"), F.col("piece_id").cast("string"))).alias("person"),
        person_key(F.col("documento")).alias("strong_key"),
        digits(F.col("documento")).alias("document_digits"),
        amount_cents(F.col("monto")).alias("cents"),
        day_month_year(F.col("fecha_inicio")).alias("starts"),
        day_month_year(F.col("fecha_fin")).alias("ends"),
        "lowest_confidence", "human_fields",
    )


def latest_lines(lines: DataFrame) -> DataFrame:
    """Each price line once, as it was loaded last."""
    others = [c for c in lines.columns if c not in ("line_id", "loaded_at")]
    return lines.groupBy("line_id").agg(F.max("loaded_at").alias("loaded_at"), F.max_by(F.struct(*others), "loaded_at").alias("r")).select(
        "line_id", "loaded_at", "r.*"
    )
