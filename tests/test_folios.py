"""Folio numbers by place, blocks by greedy choice, tables with empty cells, entities, units' index."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.functions.edit import weighted_damerau
from folioscope.functions.identifiers import folio
from folioscope.operators import folios, pages, units


def test_folio_forms(spark):
    forms = {"12": (12, None, False), "f. 12": (12, None, False), "Fs. 7 bis": (7, "bis", False), "FOJA 3 vta.": (3, None, True), "12 vto": (12, None, True), "4 r.": (4, None, False), "fojas 5 ter v": (5, "ter", True), "12345": None, "A 12": None, "": None, None: None}
    got = spark.createDataFrame([(t,) for t in forms], "t string").select("t", folio(F.col("t")).alias("f")).collect()
    assert {r.t: None if r.f is None else tuple(r.f) for r in got} == forms


def test_folio_detection(spark, rows):
    words = [
        (1, 1, "47", 500.0, 20.0, 520.0, 30.0), (2, 1, "9", 60.0, 400.0, 70.0, 410.0),  # upper right; within the text
        (3, 2, "8", 290.0, 800.0, 300.0, 810.0),  # lower middle
        *[(10 + i, 3, w, 60.0 + 50 * i, 20.0, 90.0 + 50 * i, 30.0) for i, w in enumerate("Expediente 1234 del año".split())],  # a sentence
        (20, 4, "fs.", 500.0, 20.0, 510.0, 30.0), (21, 4, "3", 515.0, 20.0, 520.0, 30.0), (22, 5, "6", 500.0, None, 520.0, None), (3, 2, "8", 290.0, 800.0, 300.0, 810.0),
    ]
    w = spark.createDataFrame(words, "word_id bigint, reading_id bigint, text string, x0 double, y0 double, x1 double, y1 double")
    readings = spark.createDataFrame([(i, 10 + i) for i in range(1, 6)], "reading_id bigint, page_id bigint")
    sheets = spark.createDataFrame([(10 + i, 595.0, 842.0) for i in range(1, 6)] + [(16, None, None)], "page_id bigint, width_pt double, height_pt double")
    assert rows(folios.detect_folios(w, readings, sheets), "page_id", "number", "confidence") == [(11, 47, 0.92), (12, 8, 0.72), (14, 3, 0.84)]
    assert folios.detect_folios(w.where("false"), readings, sheets).count() == 0


def test_best_blocks(spark, rows):
    blocks = [("p", 1, 5, 0.5), ("p", 4, 8, 0.9), ("p", 9, 9, 0.4), ("p", 8, 10, 0.4), ("q", 1, 5, 0.1), ("q", 3, 1, 0.9), ("q", None, 1, 0.9), ("q", 6, 7, None)]
    df = spark.createDataFrame(blocks, "page string, a int, b int, score double")
    assert rows(folios.best_blocks(df, "page", "a", "b", "score"), "page", "a") == [("p", 4), ("p", 9), ("q", 1), ("q", 6)]


def test_tables_grow_over_rows_with_empty_cells():
    line = lambda *cells: (list(cells), [f"c{x:g}" for x in cells])
    full = line(60.0, 200.0, 400.0)
    lines = [line(60.0), full, full, full, line(60.0, 401.0), line(60.0), line(70.0, 300.0), full]
    assert pages.table_blocks(lines, 18.0, 3) == [(1, 4, full[0])]
    assert pages.places_in([60.0, 401.0], full[0], 9.0) == [0, 2] and pages.places_in([60.0, 62.0], full[0], 9.0) is None
    assert pages.columns_of([(60.0, 90.0, "a"), (95.0, 120.0, "b"), (200.0, None, "c"), (230.0, 240.0, "d")], 18.0) == ([60.0, 200.0, 230.0], ["a b", "c", "d"])


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_the_index_of_spellings_finds_what_brute_force_finds(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/price_lines.parquet")
    met = units.parse_lines(lines).select("spelling").distinct()
    got = {r.spelling for r in units.alias_dictionary(met, units.spell_frame(spark)).collect()}
    known = [r.surface for r in units.spell_frame(spark).collect()]

    def near(s: str) -> bool:
        return any(s == k or (min(len(s), len(k)) > 3 and weighted_damerau(s, k) <= 0.34 * len(s)) for k in known)

    wanted = {r.spelling for r in met.collect() if r.spelling and near(r.spelling)}
    assert len(wanted) > 50 and len(got & wanted) >= 0.97 * len(wanted) and got <= wanted
