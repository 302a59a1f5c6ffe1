"""Several readings of one thing: agreement of routes, phrases beside labels, numbers written twice."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import amount_cents, words_to_number, written_amount_cents
from folioscope.functions.text import fold, py_fold
from folioscope.schema import NULL_REASONS

#: Which reason counts if no route has a value: the first of these that any route gave.
REASON_ORDER = ("manuscrito", "conflicto", "ambiguo", "ilegible", "ausente")
assert set(REASON_ORDER) == set(NULL_REASONS)


def route_consensus(readings: DataFrame, keys: list[str], critical: Column, single_factor: float = 0.6) -> DataFrame:
    """keys, value, state, confidence, reason, variants from one row per key and route.

    `readings`: keys, route, value, reason, confidence. All routes that read something
    agree: that value. They differ: a conflict with all variants. One route only: less
    confidence, and pending if the field is critical. None: the gravest reason.
    Handwriting is never filled in by a reader.
    """
    handwritten = F.max(F.when(F.col("reason") == "manuscrito", True)).alias("hand")
    grouped = readings.withColumn("critical", critical).groupBy(*keys).agg(
        F.array_sort(F.collect_set("value")).alias("values"), F.count("value").alias("routes"), F.max("confidence").alias("best"), handwritten, F.max("critical").alias("critical"),
        *[F.max(F.when(F.col("reason") == r, True)).alias(f"r_{r}") for r in REASON_ORDER],
    )
    n = F.size("values")
    hand = F.coalesce("hand", F.lit(False))
    reason = F.coalesce(*[F.when(F.col(f"r_{r}"), r) for r in REASON_ORDER], F.lit("ausente"))
    state = (
        F.when(hand | (n == 0), "no_revisado").when(n > 1, "conflicto")
        .when((F.col("routes") == 1) & F.col("critical"), "pendiente_baja").otherwise("automatico_alta")
    )
    return grouped.select(
        *keys, F.when((n == 1) & ~hand, F.col("values")[0]).alias("value"), state.alias("state"),
        F.round(F.when((n == 1) & ~hand, F.col("best") * F.when(F.col("routes") == 1, single_factor).otherwise(1.0)), 6).alias("confidence"),
        F.when(hand, "manuscrito").when(n == 0, reason).when(n > 1, "conflicto").alias("reason"), F.when(n > 1, F.col("values")).alias("variants"),
    )


def route_text_agreement(readings: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, routes, words_a, words_b, common: how far two routes of a page read the same words."""
    t = readings.select("reading_id", "page_id", "route").join(texts.select("reading_id", "text"), "reading_id")
    words = F.filter(F.split(fold("text"), "[^a-z0-9]+"), lambda w: w != "")
    each = t.select("page_id", "route", F.array_distinct(words).alias("words"))
    a, b = each.toDF("page_id", "route_a", "a"), each.toDF("page_id", "route_b", "b")
    return a.join(b, "page_id").where("route_a < route_b").select(
        "page_id", "route_a", "route_b", F.size("a").alias("words_a"), F.size("b").alias("words_b"), F.size(F.array_intersect("a", "b")).alias("common")
    )


_WRITTEN = r"pesos\s+([a-z][a-z ]+?(?:\s+con\s+[0-9]{2}/100)?)\s*\(\s*\$?\s*([0-9][0-9.,]*)\s*\)"
_COUNTED = r"\b([0-9]{1,4})\s*\(\s*([a-z ]+?)\s*\)"


def numbers_written_twice(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, kind, written, digits, match (null if either can't be read) of numbers in words and in digits."""
    t = fold(text)
    money = F.transform(
        F.arrays_zip(F.regexp_extract_all(t, F.lit(_WRITTEN), F.lit(1)).alias("w"), F.regexp_extract_all(t, F.lit(_WRITTEN), F.lit(2)).alias("d")),
        lambda z: F.struct(F.lit("money").alias("kind"), z["w"].alias("w"), z["d"].alias("d")),
    )
    count = F.transform(
        F.arrays_zip(F.regexp_extract_all(t, F.lit(_COUNTED), F.lit(2)).alias("w"), F.regexp_extract_all(t, F.lit(_COUNTED), F.lit(1)).alias("d")),
        lambda z: F.struct(F.lit("count").alias("kind"), z["w"].alias("w"), z["d"].alias("d")),
    )
    found = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.concat(money, count)).alias("f")).select("id", "f.*")
    by_words = F.when(F.col("kind") == "money", written_amount_cents(F.col("w"))).otherwise(words_to_number(F.col("w")))
    by_digits = F.when(F.col("kind") == "money", amount_cents(F.regexp_replace("d", "[.,]$", ""))).otherwise(F.col("d").try_cast("bigint"))
    read = found.select("id", "kind", F.col("w").alias("written"), F.col("d").alias("digits"), by_words.alias("x"), by_digits.alias("y"))
    return read.where(~((F.col("kind") == "count") & F.col("x").isNull())).select("id", "kind", "written", "digits", (F.col("x") == F.col("y")).alias("match"))


def free_amounts(text: Column) -> Column:
    """Array of cents of the amounts in a text: a currency mark or two decimals are needed."""
    marked = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"(?:\$\s?|ARS )([0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{2})?|[0-9]+(?:,[0-9]{2})?)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9.,/$-])([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})(?:[^0-9]|$)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(marked, bare), amount_cents), lambda x: x.isNotNull())))


def beside_label(words: DataFrame, label: str, least: float = 0.82) -> DataFrame:
    """reading_id, value: the words right of a label on its line, else the line below it.

    The label is looked for in windows of as many words, alike by at least `least`. The
    words of one reading are a group, so that no group grows with the data.
    """
    from difflib import SequenceMatcher

    wanted = py_fold(label)
    size = len(wanted.split())

    def per_reading(group: pd.DataFrame) -> pd.DataFrame:
        lines = [list(g.sort_values("x0")["text"]) for _, g in group.groupby("line_no")]
        best: tuple[float, str] | None = None
        for i, line in enumerate(lines):
            for k in range(len(line) - size + 1):
                window = re.sub(r"[:.]+$", "", py_fold(" ".join(line[k : k + size])))
                ratio = SequenceMatcher(None, window, wanted, autojunk=False).ratio()
                if ratio >= least and (best is None or ratio > best[0]):
                    rest = " ".join(line[k + size :]).lstrip(":. ")
                    best = (ratio, rest or (" ".join(lines[i + 1]) if i + 1 < len(lines) else ""))
        rows = [(group["reading_id"].iat[0], best[1])] if best and best[1] else []
        return pd.DataFrame(rows, columns=["reading_id", "value"])

    return words.select("reading_id", "line_no", "x0", "text").groupBy("reading_id").applyInPandas(per_reading, "reading_id bigint, value string")


def document_context(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, file_no, day, currency, vat, delivery: what a paper says once; conflicting values are dropped."""
    t = fold(text)
    only = lambda found: F.when(F.size(F.array_distinct(found)) == 1, found[0])
    days = F.regexp_extract_all(t, F.lit(r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b"), F.lit(1))
    files = F.regexp_extract_all(t, F.lit(r"(?:expediente|expte\.?)\s*(?:n[°ºo]\.?\s*)?((?:exp-)?[0-9]+/[0-9]{4})"), F.lit(1))
    has = lambda p: t.rlike(p)
    vat = F.when(has("iva incluido|impuestos incluidos|incluyen impuestos") & ~has(r"mas iva|iva discriminado"), "incluido").when(
        has(r"mas iva|iva discriminado") & ~has("iva incluido|impuestos incluidos|incluyen impuestos"), "discriminado"
    )
    currency = F.when(has(r"u\$s|usd|dolares") & ~has(r"\$ ?[0-9]|pesos"), "USD").when(has(r"\$ ?[0-9]|pesos") & ~has(r"u\$s|usd|dolares"), "ARS")
    return df.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), only(files).alias("file_no"), only(days).alias("day"), currency.alias("currency"), vat.alias("vat"),
        F.when(has(r"flete"), F.lit("flete")).alias("delivery"),
    )


def vote_notation(values: DataFrame, group: str, text: str) -> DataFrame:
    """group, notation: whether a table writes its decimals with comma or dot, by its unambiguous numbers."""
    comma = F.col(text).rlike(r"^[0-9.]*[0-9],[0-9]{1,2}$")
    dot = F.col(text).rlike(r"^[0-9,]*[0-9]\.[0-9]{1,2}$")
    votes = values.groupBy(group).agg(F.count(F.when(comma, 1)).alias("c"), F.count(F.when(dot, 1)).alias("d"))
    return votes.select(group, F.when(F.col("c") > F.col("d"), "comma").when(F.col("d") > F.col("c"), "dot").alias("notation"))
