"""Identifiers and marks in text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.numbers import PERSON_PREFIXES, check_digit_holds, digits
from folioscope.functions.text import fold, unaccent

# What introduces an identifier of each class (patterns without look-around).
IDENTIFIERS = {
    "expediente": r"(?:expediente|expte\.?)\s*(?:n[°ºo]\.?\s*)?(?:exp-)?([0-9]{1,7}(?:/[0-9]{2,4})?)",
    "orden_compra": r"(?:orden de compra|o\.c\.)\s*(?:n[°ºo]\.?\s*)?([0-9]{1,8}(?:/[0-9]{2,4})?)",
    "orden_pago": r"(?:orden de pago|o\.p\.)\s*(?:n[°ºo]\.?\s*)?([0-9]{1,8}(?:/[0-9]{2,4})?)",
    "remito": r"remito\s*(?:n[°ºo]\.?\s*)?([0-9]{1,5}-[0-9]{1,8}|[0-9]{1,8})",
    "factura": r"factura\s*[abc]?\s*(?:n[°ºo]\.?\s*)?([0-9]{1,5}-[0-9]{1,8}|[0-9]{1,8})",
    "licitacion": r"licitacion(?: publica| privada)?\s*(?:n[°ºo]\.?\s*)?([0-9]{1,6}(?:/[0-9]{2,4})?)",
    "resolucion": r"resolucion\s*(?:n[°ºo]\.?\s*)?([0-9]{1,6}(?:/[0-9]{2,4})?)",
    "nota": r"nota\s*(?:n[°ºo]\.?\s*)?([0-9]{1,6}(?:/[0-9]{2,4})?)",
}


# Words that don't tell one product from another.
STOP_WORDS = "de del la las el los y e o u con sin para por a al en x".split()
# The form of a folio note: label, number, repetition, side.
FOLIO = r"^(?:f{1,2}s?\.?|folios?|fojas?)?\s*([0-9]{1,4})\s*(bis|ter|quater)?\s*\.?\s*(vta\.?|vto\.?|v\.?|r\.?)?$"
# Forms of entities in text with the confidence of each class, and legal forms of firms.
TAX_ID = r"\b([0-9]{2}[-\s.]?[0-9]{8}[-\s.]?[0-9])\b"
CASE_NUMBER = r"(?i)\b(?:expte\.?|expediente)\s*(?:n[°ºo]?\.?\s*)?([0-9.\-/]{3,20})"
VOUCHER = r"(?i)\b(?:factura|remito|recibo|orden\s+de\s+(?:compra|pago))\s*(?:n[°ºo]\.?\s*)?([0-9A-Z]{1,4}[-\s]?[0-9]{4,12})"
FIRM = r"\b([A-ZÁÉÍÓÚÑ][0-9A-Za-z_ÁÉÍÓÚÑáéíóúñ&.\s]{2,60}?\s+(?:S\.?\s?A\.?|S\.?R\.?L\.?|S\.?A\.?S\.?|S\.?\s?H\.?|U\.?T\.?E\.?))\b"
CONFIDENCES = {"tax_id": 0.9, "case_number": 0.75, "voucher": 0.7, "firm": 0.6}


def compare_key(text: Column) -> Column:
    """Without accents, upper case, everything else than letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.upper(unaccent(text)), "[^A-Z0-9]+", " "))


def entity_key(text: Column) -> Column:
    """Without accents, lower case, dots deleted, other punctuation as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unaccent(text)), r"\.", ""), "[^a-z0-9]+", " "))


def description_tokens(text: Column) -> Column:
    """Words of a description: decimal comma as dot, stop words and lone dots removed."""
    t = F.regexp_replace(fold(text), "([0-9]),([0-9])", "$1.$2")
    words = F.regexp_extract_all(t, F.lit("[a-z0-9./]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS, "."))


def number_tokens(text: Column) -> Column:
    """Sorted distinct tokens that hold a digit."""
    return F.array_sort(F.array_distinct(F.filter(description_tokens(text), lambda w: w.rlike("[0-9]"))))


def labelled(text: Column, label: str) -> Column:
    """What follows an explicit label such as `marca:`; null without the label."""
    found = F.trim(F.regexp_extract(fold(text), rf"{label}:\s*([a-z0-9 ./-]*[a-z0-9])", 1))
    return F.nullif(found, F.lit(""))


def identifiers(text: Column, kind: str, folded: bool = False) -> Column:
    """Distinct numbers of a class in a text, without blanks and leading zeros, sorted.

    `folded` says that the text went through `fold` before, which saves doing it for each class.
    """
    found = F.regexp_extract_all(text if folded else fold(text), F.lit(IDENTIFIERS[kind]), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^0+([0-9])", "$1"))))


def folio(text: Column) -> Column:
    """struct<number, suffix, back> of a folio note such as `12 bis vta.`, with or without label; null if it is none."""
    t = F.translate(F.trim(F.lower(text)), "°º", "")
    side = F.regexp_extract(t, FOLIO, 3)
    return F.when(
        t.rlike(FOLIO),
        F.struct(
            F.regexp_extract(t, FOLIO, 1).cast("int").alias("number"),
            F.nullif(F.regexp_extract(t, FOLIO, 2), F.lit("")).alias("suffix"),
            ((side != "") & ~side.startswith("r")).alias("back"),
        ),
    )


def entities(text: Column) -> Column:
    """array<struct<class, norm, confidence>> of what its form makes sure in a text, each once.

    A tax id counts with its own check digit only; its prefix tells persons from firms.
    """
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    rows = lambda kind, confidence, norms: F.transform(norms, lambda n: F.struct(kind(n).alias("class"), n.alias("norm"), F.lit(confidence).alias("confidence")))
    ids = F.filter(F.transform(found(TAX_ID), digits), check_digit_holds)
    person = lambda n: F.when(F.substring(n, 1, 2).isin(*PERSON_PREFIXES), "person").otherwise("firm")
    named = F.filter(F.transform(found(FIRM), entity_key), lambda n: F.length(n) >= 5)
    numbered = lambda p: F.filter(F.transform(found(p), entity_key), lambda n: n != "")
    every = F.concat(
        rows(person, CONFIDENCES["tax_id"], ids), rows(lambda n: F.lit("case_number"), CONFIDENCES["case_number"], numbered(CASE_NUMBER)),
        rows(lambda n: F.lit("voucher"), CONFIDENCES["voucher"], numbered(VOUCHER)), rows(lambda n: F.lit("firm"), CONFIDENCES["firm"], named),
    )
    return F.array_distinct(every)


def legibility(text: Column) -> Column:
    """`blank`, `unreadable` or `readable` by the share of useful words.

    Useful: at least four letters, or a number of at least three digits. Blank: fewer than
    twelve words and none useful; unreadable: less than eight per cent useful.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    useful = F.filter(words, lambda w: w.rlike(r"^[^0-9]*[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ]{4,}") | w.rlike(r"[0-9]{3,}"))
    n, u = F.size(words), F.size(useful)
    return F.when((n < 12) & (u == 0), "blank").when(u < n * 0.08, "unreadable").otherwise("readable")


def snippet(text: Column, word: str, before: int = 6, length: int = 14) -> Column:
    """A window of words around the first word that starts with `word`."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    hit = F.array_position(F.transform(words, lambda w: fold(w).startswith(word)), True)
    start = F.greatest(hit.cast("int") - before, F.lit(1))
    return F.when(hit > 0, F.array_join(F.slice(words, start, F.lit(length)), " "))
