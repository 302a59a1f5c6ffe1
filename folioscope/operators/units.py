"""Quantities in many units, brought to the common unit of their measure.

Steps
1. A small grammar splits the literals into number, content and unit spelling, in Arrow
   batches (as Catalyst expressions it exceeds the size of one generated method).
2. The distinct unit spellings of all rows are mapped to known spellings: a character
   n-gram inverted index proposes, a weighted edit distance verifies (`alias_dictionary`).
3. The dictionary is joined back to every row by spelling.
4. A spelling with two meanings is read by the goods: for every word of the descriptions
   the corpus tells how often its lines use volume and how often length (`goods_measure`).

Defined results: a null or unreadable quantity, a lump, a container without stated
content, a row without any unit, an ambiguous spelling of unknown goods give no row.
Empty tables give an empty result; a line loaded twice gives one row; extra columns of
the input are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.edit import weighted_damerau
from folioscope.functions.text import fold
from folioscope.session import cut_lineage

# Spellings of units by (common unit, numerator, denominator).
UNIT_SPELLINGS: dict[tuple[str, str, int], str] = {
    ("kilogramo", "1", 1): "kg kgs kgr kilo kilos kilogramo kilogramos",
    ("kilogramo", "0.001", 1): "g gr grs gramo gramos",
    ("kilogramo", "0.000001", 1): "mg miligramo miligramos",
    ("kilogramo", "1000", 1): "t tn tns ton tonelada toneladas",
    ("kilogramo", "0.45359237", 1): "lb lbs libra libras",
    ("kilogramo", "100", 1): "qq quintal quintales",
    ("litro", "1", 1): "l lt lts litro litros dm3",
    ("litro", "0.001", 1): "cc cm3 cms3 mililitro mililitros mls",
    ("litro", "0.01", 1): "cl centilitro centilitros",
    ("litro", "100", 1): "hl hectolitro hectolitros",
    ("litro", "1000", 1): "m3 mt3 mts3 metro_cubico metros_cubicos",
    ("litro", "3.785411784", 1): "gal gals galon galones",
    ("metro", "1", 1): "m mt mts metro metros metro_lineal metros_lineales mtl mtsl",
    ("metro", "0.01", 1): "cm cms centimetro centimetros",
    ("metro", "0.001", 1): "mm mms milimetro milimetros",
    ("metro", "1000", 1): "km kms kilometro kilometros",
    ("metro", "0.3048", 1): "ft pie pies",
    ("metro", "0.0254", 1): "in pulg pulgada pulgadas",
    ("metro cuadrado", "1", 1): "m2 mt2 mts2 metro_cuadrado metros_cuadrados",
    ("metro cuadrado", "0.0001", 1): "cm2 cms2 centimetro_cuadrado centimetros_cuadrados",
    ("metro cuadrado", "10000", 1): "ha has hectarea hectareas",
    ("hora", "1", 1): "h hs hr hrs hora horas",
    ("hora", "1", 60): "min mins minuto minutos",
    ("unidad", "1", 1): "u un uni unid unids unidad unidades c/u cu pza pzas pieza piezas",
    ("unidad", "2", 1): "par pares",
    ("unidad", "12", 1): "dz doc docena docenas",
    ("unidad", "100", 1): "cto ctos ciento cientos",
    ("unidad", "1000", 1): "mill millar millares",
    ("unidad", "144", 1): "gruesa gruesas",
    # Containers and lumps carry no measure of their own.
    ("container", "1", 1): "caja cajas paquete paquetes pack packs rollo rollos bobina bobinas bolsa bolsas saco sacos"
    " balde baldes lata latas bidon bidones tambor tambores botella botellas pallet pallets envase envases frasco frascos",
    ("lump", "1", 1): "global lote lotes viaje viajes juego juegos servicio",
    # Two meanings: the goods decide.
    ("ml?", "1", 1): "ml",
    ("gl?", "1", 1): "gl",
}
# The readings of an ambiguous spelling by the measure of the goods.
AMBIGUOUS: tuple[tuple[str, str, str, str], ...] = (
    ("ml?", "litro", "litro", "0.001"),
    ("ml?", "metro", "metro", "1"),
    ("gl?", "litro", "litro", "3.785411784"),
)
# Numbers in words.
NUMBER_WORDS = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8,
    "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16,
    "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "veintiuno": 21, "veintidos": 22,
    "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "treinta": 30, "cuarenta": 40, "cincuenta": 50,
    "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100, "doscientos": 200,
    "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700,
    "ochocientos": 800, "novecientos": 900, "mil": 1000, "medio": "0.5", "media": "0.5",
}

_DIGITS = r"(?:\d{1,3}(?:[. ]\d{3})+(?!\d)|\d+)(?:,\d+)?(?:\s*(?:\d+/\d+|[½¼¾]))?"


def _words(low: int, high: int) -> str:
    return "|".join(sorted((w for w, n in NUMBER_WORDS.items() if low <= float(n) < high), key=len, reverse=True))


# Numbers in words: hundreds, tens and units in this order, `mil` between them, and a half.
_SMALL = rf"(?:(?:{_words(30, 100)})(?: y (?:{_words(1, 10)}))?|(?:{_words(0, 30)}))"
_PART = rf"(?:(?:{_words(100, 1000)})(?: {_SMALL})?|{_SMALL})"
_NUMBER = rf"(?:{_DIGITS}|\d+/\d+|[½¼¾]|(?:(?:{_PART} )?mil(?: {_PART})?|{_PART})(?: y medi[oa])?(?![a-z]))"
_CONTAINERS = UNIT_SPELLINGS[("container", "1", 1)].replace(" ", "|")
_UNIT = r"[a-z][a-z0-9/_ ]*"

# A packed quantity: number, x or container, content, unit.
_Q_PACKED = re.compile(rf"({_NUMBER})\s*(?:x|(?:{_CONTAINERS})(?: de | x | c/ ?| )) ?({_NUMBER})\s*\(?({_UNIT})\)?")
_Q_PLAIN = re.compile(rf"(?:({_UNIT}): ?)?({_NUMBER})(?: ?\(?({_UNIT})\)?)?")
_U_PACKED = re.compile(rf"({_CONTAINERS})(?: de | x | c/ ?| )({_NUMBER}) ?({_UNIT})")
_D_UNIT = re.compile(rf"(?:precio por|expresada en|medido en|\(por) ({_UNIT})[)\]]?$")
_D_CONTENT = re.compile(rf"(?:^|[ (,])(presentacion|contenido|x|{_CONTAINERS})(?: de | x | c/ ?| )({_NUMBER}) ?({_UNIT})\)?$")
_CONTAINER = re.compile(_CONTAINERS)
_TWO_WORDS = re.compile(r"\b(metros?|centimetros?) (cuadrados?|cubicos?|lineal(?:es)?)")
_VULGAR = {"½": Decimal("0.5"), "¼": Decimal("0.25"), "¾": Decimal("0.75")}
_MARKS = str.maketrans("áéíóúüñàèìòù²³", "aeiouunaeiou23")
_DOT = re.compile(r"(?<=[a-z])\.")


def plain(text: str | None) -> str:
    """Lower case, no accents, ² and ³ as digits, no abbreviation dots, single blanks."""
    if not text:
        return ""
    t = _DOT.sub("", " ".join(text.lower().translate(_MARKS).split()))
    return _TWO_WORDS.sub(r"\1_\2", t) if "etro" in t else t


def to_number(text: str) -> Decimal | None:
    """A number with decimal comma, grouping dots or blanks, a fraction or words; else None."""
    whole, share = text.strip(), Decimal(0)
    if whole and whole[-1] in _VULGAR:
        share, whole = _VULGAR[whole[-1]], whole[:-1].strip()
    elif "/" in whole:
        whole, _, tail = whole.rpartition(" ")
        top, bottom = tail.split("/")
        if not int(bottom):
            return None
        share = Decimal(top) / Decimal(bottom)
    if not whole:
        return share
    if whole[0].isdigit():
        return Decimal(whole.replace(".", "").replace(" ", "").replace(",", ".")) + share
    total, part = Decimal(0), Decimal(0)
    for w in whole.split():
        if w == "mil":
            total, part = total + (part or 1) * 1000, Decimal(0)
        elif w in NUMBER_WORDS:
            part += Decimal(str(NUMBER_WORDS[w]))
        elif w != "y":
            return None
    return total + part + share


def _stem(word: str) -> str:
    return re.sub(r"(?:es|s)$", "", word)


def read_line(unit: str | None, quantity: str | None, description: str | None) -> tuple[Decimal, str] | None:
    """(amount times content, unit spelling) of one line, or None.

    The spelling that counts is that of a packed quantity, else the quantity's own, else
    the unit column's, else the one the description tells. A container takes its content
    from the unit column or the description.
    """
    q = plain(quantity)
    if not q or (q[0].isalpha() and q.split(" ")[0].rstrip(":") not in NUMBER_WORDS and ":" not in q):
        return None
    u = plain(unit)
    if m := _Q_PACKED.fullmatch(q):
        number, content, said = m.groups()
    elif m := _Q_PLAIN.fullmatch(q):
        number, content, said = m[2], None, m[1] or m[3]
        if not said and u and u[0].isalpha():
            if p := _U_PACKED.fullmatch(u):
                content, said = p[2], p[3]
            else:
                said = u
    else:
        return None
    amount = to_number(number)
    if amount is None:
        return None
    if not said:
        d = plain(description)
        if not (m := _D_UNIT.search(d)):
            return None
        said = m[1]
    elif content is None and _CONTAINER.fullmatch(said):
        m = _D_CONTENT.search(plain(description))
        if not m or (_CONTAINER.fullmatch(m[1]) and _stem(m[1]) != _stem(said)):
            return None
        content, said = m[2], m[3]
    inner = to_number(content) if content else Decimal(1)
    return None if inner is None else (amount * inner, said.strip())


#: Amounts from here on have no place in decimal(26,8).
_BEYOND = 10**18


def parse_lines(lines: DataFrame) -> DataFrame:
    """line_id, amount decimal(26,8), spelling and goods of every loaded row that can be parsed; amounts from 10^18 can't be held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [
                (i, *r, d)
                for i, u, q, d in zip(b["line_id"], b["unit_literal"], b["quantity_literal"], b["description"], strict=True)
                if (r := read_line(u, q, d)) and r[0] < _BEYOND
            ]
            ids, amounts, spellings, goods = zip(*got, strict=True) if got else ((), (), (), ())
            yield pd.DataFrame(
                {
                    "line_id": pd.Series(ids, dtype="int64"),
                    "amount": pd.Series([format(round(a, 8), "f") for a in amounts], dtype="object"),
                    "spelling": pd.Series(spellings, dtype="object"),
                    "goods": pd.Series(goods, dtype="object"),
                }
            )

    need = lines.select("line_id", "unit_literal", "quantity_literal", "description").where(
        "line_id is not null and quantity_literal is not null"
    )
    return need.mapInPandas(run, "line_id bigint, amount string, spelling string, goods string").withColumn(
        "amount", F.col("amount").cast("decimal(26,8)")
    )


def spell_frame(spark: SparkSession) -> DataFrame:
    """The known spellings: surface, common unit, numerator, denominator."""
    rows = [
        (surface, unit, num, den) for (unit, num, den), names in UNIT_SPELLINGS.items() for surface in names.split()
    ]
    return spark.createDataFrame(rows, "surface string, unit string, num string, den int").withColumn(
        "num", F.col("num").cast("decimal(16,9)")
    )


def _grams(col: str) -> Column:
    """Character bigrams of a padded word."""
    padded = F.concat(F.lit("^"), F.col(col), F.lit("$"))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))
    )


def alias_dictionary(spellings: DataFrame, known: DataFrame, max_cost: float = 0.34) -> DataFrame:
    """Map each distinct `spelling` to the known spelling it means.

    Bigram inverted index, then weighted edit distance of at most `max_cost` times the
    length; words of up to three letters must be equal. The cheapest wins, then the
    alphabetically first. One row per spelling that has a meaning.
    """
    distinct = spellings.where("spelling is not null and spelling <> ''").select("spelling").distinct()
    left = distinct.select("spelling", F.explode(_grams("spelling")).alias("gram"))
    right = known.select("surface", "unit", "num", "den", F.explode(_grams("surface")).alias("gram"))
    shared = (
        left.join(right, "gram")
        .groupBy("spelling", "surface", "unit", "num", "den")
        .count()
        .where(
            (F.col("spelling") == F.col("surface"))
            | (
                (F.least(F.length("spelling"), F.length("surface")) > 3)
                & (F.abs(F.length("spelling") - F.length("surface")) <= 2)
                & (F.col("count") * 2 >= F.length("spelling") - 1)
            )
        )
    )

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_damerau(x, y) / max(len(x), 1) for x, y in zip(a, b, strict=True)], dtype="float64")

    scored = shared.withColumn("cost", cost("spelling", "surface")).where(F.col("cost") <= max_cost)
    best = scored.groupBy("spelling").agg(
        F.min(F.struct("cost", "surface", "unit", "num", "den")).alias("b")
    )
    return best.select("spelling", "b.unit", "b.num", "b.den")


def _goods_words(col: str) -> Column:
    """Distinct words of at least three letters."""
    return F.array_distinct(F.filter(F.split(fold(col), "[^a-z]+"), lambda w: F.length(w) >= 3))


def goods_measure(resolved: DataFrame, unclear: DataFrame) -> DataFrame:
    """`litro` or `metro` for the goods of each unclear line (line_id, measure).

    Every line whose unit is plain votes for the words of its description; the log odds
    of the words of an unclear line are summed. Lines without evidence have no row.
    """
    votes = (
        resolved.where("unit in ('litro', 'metro')")
        .select("unit", F.explode(_goods_words("goods")).alias("word"))
        .groupBy("word")
        .agg(
            F.count(F.when(F.col("unit") == "litro", 1)).alias("volume"),
            F.count(F.when(F.col("unit") == "metro", 1)).alias("length"),
        )
        .select("word", F.log((F.col("volume") + 0.5) / (F.col("length") + 0.5)).alias("odds"))
    )
    return (
        unclear.select("line_id", F.explode(_goods_words("goods")).alias("word"))
        .join(votes, "word")
        .groupBy("line_id")
        .agg(F.sum("odds").alias("odds"))
        .where(F.abs("odds") > 1.0)
        .select("line_id", F.when(F.col("odds") > 0, "litro").otherwise("metro").alias("measure"))
    )


def common_quantities(lines: DataFrame) -> DataFrame:
    """line_id, common_unit, quantity_milli for every line whose quantity and unit can be told.

    `lines` needs line_id, unit_literal, quantity_literal and description. A quantity whose
    thousandths are beyond a bigint has no row, as the result couldn't hold it.
    """
    spark = lines.sparkSession
    parsed = cut_lineage(parse_lines(lines))
    aliases = cut_lineage(alias_dictionary(parsed.select("spelling"), spell_frame(spark)))
    joined = parsed.join(aliases, "spelling")
    clear = joined.where(~F.col("unit").isin("container", "lump") & ~F.col("unit").endswith("?"))
    unclear = joined.where(F.col("unit").endswith("?"))
    readings = spark.createDataFrame(list(AMBIGUOUS), "unit string, measure string, common_unit string, factor string")
    settled = (
        unclear.join(goods_measure(clear, unclear), "line_id")
        .join(readings, ["unit", "measure"])
        .select("line_id", "amount", F.col("common_unit").alias("unit"), F.col("factor").cast("decimal(16,9)").alias("num"), "den")
    )
    told = clear.select("line_id", "amount", "unit", "num", "den").unionByName(settled)
    thousandths = F.col("amount") * (F.col("num") * 1000).cast("decimal(14,6)")
    milli = F.try_divide(thousandths.try_cast("decimal(34,9)"), F.col("den").cast("decimal(3,0)"))
    return (
        told.select("line_id", F.col("unit").alias("common_unit"), F.round(milli, 0).try_cast("decimal(20,0)").try_cast("bigint").alias("quantity_milli"))
        .where("quantity_milli is not null")
        .distinct()
    )


__all__ = ["alias_dictionary", "common_quantities", "goods_measure", "parse_lines", "read_line", "spell_frame", "to_number"]
