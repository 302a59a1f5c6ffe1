"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.units import alias_dictionary, common_quantities, parse_lines, spell_frame
from folioscope.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every quantity of `price_lines` in the common unit of its measure."""
    return common_quantities(table(spark, folder, "price_lines", "line_id", "unit_literal", "quantity_literal", "description"))


def p4_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary of unit spellings: what each spelling of the data means."""
    parsed = parse_lines(table(spark, folder, "price_lines", "line_id", "unit_literal", "quantity_literal", "description"))
    return alias_dictionary(parsed.select("spelling"), spell_frame(spark)).select("spelling", "unit", F.col("num").cast("double").alias("num"), "den")


QUERIES = {"p4_found": p4_found, "p4_aliases": p4_aliases}
