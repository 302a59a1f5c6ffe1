"""Numbers, dates and identifiers in text, as expressions. Unreadable or ambiguous text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An amount: dots group thousands in threes, a comma sets off exactly two decimals.
AMOUNT = r"^\$?\s*([0-9]{1,3}(\.[0-9]{3})+|[0-9]+)(,[0-9]{2})?$"
#: A decimal number of a price table: like an amount, with any number of decimals but three.
DECIMAL = r"^([0-9]{1,3}(\.[0-9]{3})+|[0-9]+)(,([0-9]{1,2}|[0-9]{4,8}))?$"
#: Weights of the check digit of an eleven-digit tax id.
TAX_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: Prefixes of tax ids that belong to persons.
PERSON_PREFIXES = ("20", "23", "24", "27")


def amount_cents(text: Column) -> Column:
    """Cents of an amount; `74.20`, `74,2` and `1.234.5` are ambiguous."""
    t = F.trim(text)
    whole = F.regexp_replace(F.regexp_extract(t, AMOUNT, 1), r"\.", "")
    cents = F.regexp_replace(F.regexp_extract(t, AMOUNT, 3), ",", "")
    return F.when(t.rlike(AMOUNT), (F.concat(whole, F.when(cents == "", "00").otherwise(cents))).try_cast("bigint"))


def amount_reason(text: Column) -> Column:
    """`ausente` for no text, `ambiguo` for text that is no clear amount, else null."""
    return F.when(text.isNull() | (F.trim(text) == ""), "ausente").when(~F.trim(text).rlike(AMOUNT), "ambiguo")


def local_decimal(text: Column) -> Column:
    """decimal(24,8) of a local number; three digits after a lone separator are never a fraction."""
    t = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    return F.when(t.rlike(DECIMAL), plain.try_cast("decimal(24,8)"))


def canonical_money(value: Column) -> Column:
    """Text with at least two decimals and no needless zeros, never rounded."""
    t = value.cast("decimal(38,8)").cast("string")
    return F.regexp_replace(t, r"(\.[0-9]{2}[0-9]*?)0+$", "$1")


def day_month_year(text: Column) -> Column:
    """Date of `dd/mm/yyyy`; two-digit years and impossible days give null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_timestamp(t, F.lit("dd/MM/yyyy")).cast("date"))


def digits(text: Column) -> Column:
    """Only the digits."""
    return F.regexp_replace(text, "[^0-9]", "")


def identity_kind(text: Column) -> Column:
    """`CUIL` for 11 digits, `DNI` for 7 or 8, else null (ambiguous)."""
    n = F.length(digits(text))
    return F.when(n == 11, "CUIL").when(n.isin(7, 8), "DNI")


def check_digit(text: Column) -> Column:
    """The check digit that the first ten digits of a tax id ask for."""
    d = digits(text)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(TAX_WEIGHTS)), F.lit(0))
    rest = F.lit(11) - F.pmod(total, F.lit(11))
    return F.when(F.length(d) == 11, F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest))


def check_digit_holds(text: Column) -> Column:
    """Whether an eleven-digit id carries its own check digit; null for other lengths."""
    return check_digit(text) == F.substring(digits(text), 11, 1).try_cast("int")


def person_key(text: Column) -> Column:
    """One key per person: the number inside a person's tax id, the whole tax id of a firm."""
    d = digits(text)
    inner = F.regexp_replace(F.substring(d, 3, 8), "^0+", "")
    return (
        F.when((F.length(d) == 11) & F.substring(d, 1, 2).isin(*PERSON_PREFIXES), F.concat(F.lit("DNI:"), inner))
        .when(F.length(d) == 11, F.concat(F.lit("CUIT:"), d))
        .when(F.length(d).isin(7, 8), F.concat(F.lit("DNI:"), F.regexp_replace(d, "^0+", "")))
    )


# Number words.
_UNITS = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho"
    " diecinueve veinte veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho veintinueve"
).split()
_TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
_HUNDREDS = {
    "cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500,
    "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}
NUMBER_WORDS = {w: i for i, w in enumerate(_UNITS)} | {"un": 1, "una": 1, "veintiun": 21} | _TENS | _HUNDREDS
_SCALES = {"mil": 1000, "millon": 1_000_000, "millones": 1_000_000}


def words_to_number(words: Column) -> Column:
    """Whole number of Spanish words (folded text); null if any word is unknown.

    A fold over the words: small words add up, `mil` multiplies what stands before it
    since the last million, `millon(es)` closes a part.
    """
    values = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    tokens = F.filter(F.split(F.trim(words), r"\s+"), lambda w: ~w.isin("y", "de", ""))
    start = F.struct(F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        small = F.try_element_at(values, w)
        thousands = (F.when(s["part"] == 0, 1).otherwise(s["part"]) * 1000).cast("bigint")
        millions = s["done"] + F.when(s["part"] == 0, 1).otherwise(s["part"]) * 1_000_000
        return (
            F.when(w == "mil", F.struct(s["done"].alias("done"), thousands.alias("part"), s["ok"].alias("ok")))
            .when(w.isin("millon", "millones"), F.struct(millions.cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("part"), s["ok"].alias("ok")))
            .when(small.isNull(), F.struct(s["done"].alias("done"), s["part"].alias("part"), F.lit(False).alias("ok")))
            .otherwise(F.struct(s["done"].alias("done"), (s["part"] + small).cast("bigint").alias("part"), s["ok"].alias("ok")))
        )

    end = F.aggregate(tokens, start, step)
    return F.when(end["ok"] & (F.size(tokens) > 0), end["done"] + end["part"])


def written_amount_cents(text: Column) -> Column:
    """Cents of an amount in words: `... con NN/100` or `... con <words> centavos`."""
    t = F.trim(F.regexp_replace(text, r"^\s*(?:son\s+)?pesos\s+", ""))
    fraction = F.regexp_extract(t, r"\scon\s+([0-9]{2})/100\s*$", 1)
    in_words = F.regexp_extract(t, r"\scon\s+([a-z ]+?)\s+centavos\s*$", 1)
    whole = words_to_number(F.regexp_replace(t, r"\scon\s+(?:[0-9]{2}/100|[a-z ]+\s+centavos)\s*$", ""))
    part = F.when(fraction != "", fraction.try_cast("bigint")).when(in_words != "", words_to_number(in_words)).otherwise(F.lit(0))
    return whole * 100 + part


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area of two boxes; null if either has no area."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), F.least(area(a), area(b))))


def spanish_number(value: Column, decimals: int = 2) -> Column:
    """Thousands dot and decimal comma."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def spanish_date(value: Column) -> Column:
    """dd/mm/yyyy."""
    return F.date_format(value, "dd/MM/yyyy")
