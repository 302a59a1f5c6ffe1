"""Quantities in common units."""

from __future__ import annotations

from decimal import Decimal

import pytest

from folioscope.operators import units

SCHEMA = "line_id bigint, unit_literal string, quantity_literal string, description string"


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.290,50", "1290.50"), ("1 290", "1290"), ("125 1/4", "125.25"), ("26 ½", "26.5"), ("¾", "0.75"), ("doce", "12"), ("treinta y cinco", "35"), ("0,75", "0.75")],
)
def test_numbers(text, value):
    assert units.to_number(text) == Decimal(value)


@pytest.mark.parametrize(
    ("unit", "quantity", "description", "want"),
    [
        ("kg", "12,5", "harina", ("12.5", "kg")),
        ("bolsas", "9x10kg", "cemento", ("90", "kg")),
        (None, "20 saco x 500 grs.", "cal", ("10000", "grs")),
        ("-", "Kg: 59,96", "cal", ("59.96", "kg")),
        ("-", "34 (m3)", "arena", ("34", "m3")),
        ("pack de 2 dz", "3", "marcador", ("6", "dz")),
        ("bolsas", "135", "Cemento, presentación 30 kilo", ("4050", "kilo")),
        ("CAJA", "10", "Cubierta radial 215/80 R16 caja x 50UN.", ("500", "un")),
        ("u", "194", "Piedra, presentación 50 kg", ("194", "u")),
        (None, "27", "Disco corte 230 mm - precio por dz", ("27", "dz")),
        ("bobina", "150,00", "Cinta aisladora", None),
        ("caja", "5", "Papel higiénico rollo 60 m", None),
        (None, "34", "Cemento portland", None),
        ("kg", "a convenir", "Cal", None),
        ("kg", None, "Cal", None),
        ("kg", "", "", None),
    ],
)
def test_lines(unit, quantity, description, want):
    got = units.read_line(unit, quantity, description)
    assert got == want if want is None else (got[0], got[1]) == (Decimal(want[0]), want[1])


def test_common_units(spark, rows):
    data = [
        (1, "t", "1,5", "Cal hidratada"), (2, "min", "90", "Servicio limpieza"), (3, "ft", "10", "Caño polietileno"), (4, "global", "1", "Pintura látex"),
        (5, "ML", "300", "Caño polietileno 32 mm"), (6, "ml", "500", "Aceite hidráulico"), (7, "gl.", "2", "Aceite hidráulico"), (8, "gl.", "2", "Silla"),
        (9, "metros", "4", "Caño polietileno 19 mm"), (10, "litros", "4", "Aceite hidráulico ISO 32"), (11, "lts", "1", "Aceite motor"), (12, "mts", "1", "Caño PVC"),
        (13, "kilogrmos", "2", "Cal"), (1, "t", "1,5", "Cal hidratada"), (None, "kg", "1", "Cal"), (14, "quintales", "1 200", "Trigo"), (15, None, None, None), (16, "kg", "2", "x" * 200_000),
    ]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as unit", "2 as amount", "3 as spelling")
    assert rows(units.common_quantities(df)) == sorted(
        [
            (1, "kilogramo", 1_500_000), (2, "hora", 1500), (3, "metro", 3048), (5, "metro", 300_000), (6, "litro", 500), (7, "litro", 7571), (9, "metro", 4000),
            (10, "litro", 4000), (11, "litro", 1000), (12, "metro", 1000), (13, "kilogramo", 2000), (14, "kilogramo", 120_000_000), (16, "kilogramo", 2000),
        ],
        key=repr,
    )


def test_empty(spark):
    assert units.common_quantities(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alias_dictionary_rejects_the_unlike(spark, rows):
    said = spark.createDataFrame([("kilogrmos",), ("litors",), ("zapallo",), ("kx",), (None,), ("",)], "spelling string")
    got = {r[0]: r[1] for r in rows(units.alias_dictionary(said, units.spell_frame(spark)))}
    assert got == {"kilogrmos": "kilogramo", "litors": "litro"}


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("doscientos cincuenta", 250), ("ciento veinte", 120), ("dos mil", 2000), ("mil", 1000), ("tres mil cuatrocientos treinta y dos", 3432),
        ("novecientos noventa y nueve mil novecientos noventa y nueve", 999_999), ("dos y medio", "2.5"), ("treinta y cinco", 35), ("media", "0.5"), ("dos perros", None),
    ],
)
def test_numbers_in_words(text, number):
    assert units.to_number(text) == (None if number is None else Decimal(str(number)))


def test_quantities_in_words():
    assert units.read_line("kg", "doscientos cincuenta", "harina") == (Decimal(250), "kg")
    assert units.read_line(None, "ciento veinte kg", "harina") == (Decimal(120), "kg")
    assert units.read_line("m", "dos mil", "cable") == (Decimal(2000), "m")


def test_very_large_quantities(spark):
    rows = [(1, "g", "400000000000000000", "sal"), (2, "kg", "999999999999999", "sal"), (3, "kg", "99999999999999999999", "sal"), (4, "tn", "900000000000000000", "sal")]
    df = spark.createDataFrame(rows, "line_id bigint, unit_literal string, quantity_literal string, description string")
    got = {r.line_id: r.quantity_milli for r in units.common_quantities(df).collect()}
    # 4 x 10^17 grams and 10^15 kilograms fit; the others have no thousandths in a bigint.
    assert got == {1: 400_000_000_000_000_000, 2: 999_999_999_999_999_000}
