"""Running lines of a file with many wordings."""

from __future__ import annotations

import random

from folioscope.llm import scans


def test_all_wordings_of_a_file_run(spark):
    names = ["norte de obras", "hacienda general", "sumarios", "concursos viales", "patrimonio", "escuelas tecnicas", "hospitales", "catastro urbano", "tesoreria", "personal docente", "automotores", "biblioteca", "imprenta"]
    placed, n = [], 0
    for page in range(1, 2 * len(names) + 2):
        head = names[(page - 1) // 2] if page <= 2 * len(names) else "irnprenta"
        lines = [head, *[f"texto comun del expediente numero {k} sobre la pagina {page} y otras cosas" for k in range(8)]]
        for k, line in enumerate(lines):
            for place, w in enumerate(line.split(" "), 1):
                n += 1
                placed.append((n, "f", page, page, k, place, 8, w, 400.0 if k == 0 and head != "irnprenta" else 60.0 + 30 * place))
    df = spark.createDataFrame(placed, "word_id bigint, file_sha string, page_id bigint, reading_id bigint, line int, place int, last_line int, text string, x0 double")
    got = {r.reading_id: r.kinds for r in scans.running_lines(df).where("line = 0").collect()}
    assert set(got) == set(range(1, 2 * len(names) + 2)) and all(set(k) == {"header"} for k in got.values())


def test_filter_loses_no_equal_line():
    rng = random.Random(3)
    running = ["secretaria de hacienda actuaciones 9576", "anexo 2 licitacion", "copia para archivo", "fs uno"]
    lines = []
    for _ in range(600):
        s = list(rng.choice(running))
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([["c"], ["o"], [s[at]] * 2, [], ["e", "i"], s[at : at + 1]])
            if not s:
                s = ["x"]
        lines.append("".join(s))
    assert scans.lines_among(lines, running) == [t for t in lines if any(scans._same_line(t, r) for r in running)]


def edge_frame(spark, heads: list[tuple[str, int, str]]):
    """Pages with a line at the top, away from the margin, over text at the margin."""
    placed = []
    for page, (file, reading, head) in enumerate(heads, 1):
        for k, line in enumerate([head, *[f"texto {k} de la pagina {page} con cosas propias {page * k}" for k in range(8)]]):
            for place, w in enumerate(line.split(" "), 1):
                placed.append((len(placed), file, page, reading, k, place, 8, w, 190.0 + 30 * place if k == 0 else 30.0 + 30 * place))
    return spark.createDataFrame(placed, "word_id bigint, file_sha string, page_id bigint, reading_id bigint, line int, place int, last_line int, text string, x0 double")


def test_a_line_runs_only_if_it_is_met_again(spark):
    long = " ".join(f"palabra{'abcdefghijklmnopqrst'[i]}" for i in range(20))
    heads = [("f", 1, "Resolucion"), ("f", 2, "otra cosa"), ("f", 3, "Copia flel"), ("f", 4, "Copia fiel"), ("g", 5, "Anexo 7"), ("h", 6, "Anexo 9"), ("f", 7, long), ("f", 8, long), ("f", 9, "Sur"), ("f", 10, "Sur"), ("f", 11, "12 / 40")]
    df = edge_frame(spark, heads)
    for chunk in (2000, 2):
        got = {r.reading_id: set(r.kinds) for r in scans.running_lines(df, chunk=chunk).where("line = 0").collect()}
        # One sighting is a title; misread characters and the number in another file don't hide a second one.
        assert got == {3: {"header"}, 4: {"header"}, 5: {"header"}, 6: {"header"}, 7: {"header"}, 8: {"header"}, 9: {"header"}, 10: {"header"}, 11: {"pageno"}}


def test_repeated_lines():
    assert scans.repeated([("copia fiel", 1, 1, False), ("copia flel", 2, 2, False), ("titulo", 3, 3, False), ("anexo", 4, 4, True), ("indice", 5, 6, False)]) == ["copia fiel", "copia flel", "anexo", "indice"]


def test_page_number_with_its_label_after_a_running_line():
    words = "Ministerio de Obras Folio N° 12 / 340 vta.".split(" ")
    assert scans.edge_kinds(words, {"ministerio de obras"}) == ["header"] * 3 + ["pageno"] * 6
