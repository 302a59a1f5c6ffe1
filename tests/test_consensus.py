"""Several readings of one thing."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import consensus


def test_routes(spark, rows):
    data = [
        (1, "a", "x", None, 0.9), (1, "b", "x", None, 0.7), (2, "a", "x", None, 0.9), (2, "b", "y", None, 0.9), (3, "a", "x", None, 0.9), (3, "b", None, "ilegible", None),
        (4, "a", None, "ausente", None), (4, "b", None, "ambiguo", None), (5, "a", "x", None, 0.9), (5, "b", None, "manuscrito", None), (6, "a", None, None, None),
    ]
    df = spark.createDataFrame(data, "k int, route string, value string, reason string, confidence double")
    assert rows(consensus.route_consensus(df, ["k"], F.lit(True)), "k", "value", "state", "confidence", "reason") == [
        (1, "x", "automatico_alta", 0.9, None), (2, None, "conflicto", None, "conflicto"), (3, "x", "pendiente_baja", 0.54, None),
        (4, None, "no_revisado", None, "ambiguo"), (5, None, "no_revisado", None, "manuscrito"), (6, None, "no_revisado", None, "ausente"),
    ]


def test_written_twice(spark, rows):
    df = spark.createDataFrame(
        [(1, "la suma de PESOS MIL DOSCIENTOS CON 50/100 ($ 1.200,50) por 12 (doce) meses"), (2, "pesos cien ($ 200) y 3 (cuatro) cuotas"), (3, None), (4, "pesos cosa rara ($ 5)"), (5, "art. 5 (inciso)")],
        "i int, t string",
    )
    assert rows(consensus.numbers_written_twice(df, "i", "t"), "id", "kind", "match") == [(1, "count", True), (1, "money", True), (2, "count", False), (2, "money", False), (4, "money", None)]


def test_free_amounts(spark):
    df = spark.createDataFrame([("son $ 1.200,50 y 3.000,00 en 2 cuotas de $ 77, expediente 12345", ), (None,)], "t string")
    assert [r[0] for r in df.select(consensus.free_amounts(F.col("t"))).collect()] == [[7700, 120050, 300000], None]


def test_beside_label(spark, rows):
    words = [("Apellido", 1, 10.0), ("y", 1, 60.0), ("nornbre:", 1, 70.0), ("Ana", 1, 120.0), ("Paz", 1, 150.0), ("Fecha", 2, 10.0)]
    df = spark.createDataFrame([(1, ln, x, t) for t, ln, x in words] + [(2, 1, 1.0, "nada")], "reading_id bigint, line_no int, x0 double, text string")
    assert rows(consensus.beside_label(df, "Apellido y nombre")) == [(1, "Ana Paz")]


def test_context(spark, rows):
    df = spark.createDataFrame([(1, "Expte. N° 12/2020 del 01/02/2020, $ 5 IVA incluido"), (2, "expediente 1/2020 y expediente 2/2020, USD 5 más IVA, flete"), (3, None)], "i int, t string")
    assert rows(consensus.document_context(df, "i", "t")) == [(1, "12/2020", "01/02/2020", "ARS", "incluido", None), (2, None, None, "USD", "discriminado", "flete")]
