"""Invariants: each check returns its violations, so that a sound data set gives no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.schema import FIELD_STATES, NULL_REASONS


def violations(files: DataFrame, pages: DataFrame, readings: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """check, id of everything that breaks a rule of the model."""
    named = lambda name, df, col: df.select(F.lit(name).alias("check"), F.col(col).cast("string").alias("id"))
    once = fields.select("field_id", "piece_id", "field_name", "literal", "null_reason", "page_no", "state").distinct()
    both = F.col("literal").isNotNull() & F.col("null_reason").isNotNull()
    neither = F.col("literal").isNull() & F.col("null_reason").isNull()
    parts = [
        named("value_and_reason", once.where(both), "field_id"),
        named("neither_value_nor_reason", once.where(neither), "field_id"),
        named("value_without_page", once.where("literal is not null and page_no is null"), "field_id"),
        named("unknown_state", once.where(~F.coalesce(F.col("state").isin(*FIELD_STATES), F.lit(False))), "field_id"),
        named("unknown_reason", once.where(~F.col("null_reason").isin(*NULL_REASONS)), "field_id"),
        named("field_twice", once.groupBy("piece_id", "field_name").agg(F.min("field_id").alias("field_id"), F.countDistinct("field_id").alias("n")).where("n > 1"), "field_id"),
        named("page_without_file", pages.join(files, pages.file_sha == files.sha256, "left_anti"), "page_id"),
        named("reading_without_page", readings.join(pages, "page_id", "left_anti"), "reading_id"),
        named("word_without_reading", words.join(readings, "reading_id", "left_anti"), "word_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
