"""Expressions on text, numbers, dates and identifiers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.functions import identifiers as ids
from folioscope.functions import numbers as nums
from folioscope.functions.edit import weighted_damerau
from folioscope.functions.text import fold


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "cents"), [("$ 74.200,00", 7420000), ("$ 96.750", 9675000), ("74.20", None), ("74,2", None), ("1.234.5", None), ("", None), (None, None), ("12", 1200)]
)
def test_amounts(spark, text, cents):
    assert one(spark, nums.amount_cents, text) == cents


@pytest.mark.parametrize(("text", "value"), [("1.234,5", 1234.5), ("1,234", None), ("1234", 1234), ("12,5000", 12.5), ("1.23", None), (None, None)])
def test_decimals(spark, text, value):
    got = one(spark, nums.local_decimal, text)
    assert (None if got is None else float(got)) == value


@pytest.mark.parametrize(("text", "day"), [("24/12/20", None), ("31/02/2020", None), ("2O/12/2021", None), ("29/02/2020", "2020-02-29"), (None, None)])
def test_dates(spark, text, day):
    got = one(spark, nums.day_month_year, text)
    assert (None if got is None else str(got)) == day


@pytest.mark.parametrize(
    ("text", "key"), [("12.345.678", "DNI:12345678"), ("20-12345678-6", "DNI:12345678"), ("30-12345678-1", "CUIT:30123456781"), ("1234567890", None), (None, None)]
)
def test_person_keys(spark, text, key):
    assert one(spark, nums.person_key, text) == key


def test_check_digit(spark):
    assert one(spark, nums.check_digit, "20-12345678-6") == 6
    assert one(spark, nums.check_digit_holds, "20-12345678-5") is False
    assert one(spark, nums.check_digit_holds, "123") is None


@pytest.mark.parametrize(
    ("text", "cents"),
    [("pesos mil doscientos con 50/100", 120050), ("tres mil con veinte centavos", 300020), ("un millon", 100000000), ("cien gatos", None), ("", None)],
)
def test_written_amounts(spark, text, cents):
    assert one(spark, nums.written_amount_cents, text) == cents


def test_canonical_money(spark):
    df = spark.sql("select cast('180000' as decimal(18,4)) a, cast('1.2345' as decimal(18,4)) b, cast('1.5' as decimal(18,4)) c")
    assert tuple(df.select(*[nums.canonical_money(F.col(c)) for c in "abc"]).first()) == ("180000.00", "1.2345", "1.50")


def test_boxes(spark):
    df = spark.sql("select named_struct('x0',0D,'y0',0D,'x1',10D,'y1',10D) a, named_struct('x0',5D,'y0',0D,'x1',15D,'y1',10D) b, named_struct('x0',1D,'y0',1D,'x1',1D,'y1',1D) c")
    got = df.select(nums.box_overlap(F.col("a"), F.col("b")), nums.box_overlap(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (0.5, None)


def test_text_keys(spark):
    assert one(spark, ids.compare_key, " Pérez, José  Á.") == "PEREZ JOSE A"
    assert one(spark, ids.entity_key, "S.R.L. Ñandú & Cía.") == "srl nandu cia"
    assert one(spark, fold, "  ÁRBOL \n Ñ ") == "arbol n"
    assert one(spark, lambda c: ids.labelled(c, "marca"), "Papel marca: ACME-2") == "acme-2"
    assert one(spark, ids.number_tokens, "Cable 2,5 mm2 x 3") == ["2.5", "3", "mm2"]
    assert one(spark, lambda c: ids.identifiers(c, "expediente"), "Expte. N° 0012/2020 y expediente 12/2020") == ["12/2020"]
    assert one(spark, ids.folio, "Foja 12 bis vta.").asDict() == {"number": 12, "suffix": "bis", "back": True}
    assert one(spark, ids.folio, "una foja") is None


def test_legibility(spark):
    assert one(spark, ids.legibility, None) == "blank"
    assert one(spark, ids.legibility, ". - x 1 " * 20) == "unreadable"
    assert one(spark, ids.legibility, "Contrato de obra número 123") == "readable"


def test_spanish(spark):
    assert one(spark, nums.spanish_number, 1234567.5, "double") == "1.234.567,50"


def test_edit_distance():
    assert weighted_damerau("casa", "casa") == 0
    assert weighted_damerau("caso", "casa") == 0.5  # o and a are confusable
    assert weighted_damerau("csaa", "casa") == 0.8
    assert weighted_damerau("", "abc") == 3 and weighted_damerau("abc", "", 1.0) > 1.0
