"""Pages as words with boxes: lines, tables, page classes, folio notes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.identifiers import folio, legibility
from folioscope.functions.text import fold

# Titles and marks that tell the class of a page (folded), in order of precedence.
PAGE_RULES = (
    ("factura", "factura", "cae|punto de venta|iva"),
    ("remito", "remito", "no valido como factura|entregado por"),
    ("recibo", "recibo", "recibi|recibimos"),
    ("orden_compra", "orden de compra", "proveedor|plazo de entrega"),
    ("contrato", "contrato", "locador|locacion|las partes"),
    ("resolucion", "resolucion", "visto|considerando|resuelve"),
    ("pliego", "pliego", "condiciones particulares|oferentes"),
    ("nota", "nota", "tengo el agrado|saludo a usted"),
)


def distinct_words(words: DataFrame) -> DataFrame:
    """One row per word_id, words without text left out."""
    kept = ("reading_id", "ord", "text", "x0", "y0", "x1", "y1", "conf")
    return words.where("text <> '' and word_id is not null").groupBy("word_id").agg(F.min(F.struct(*kept)).alias("w")).select("word_id", "w.*")


def lined_words(words: DataFrame) -> DataFrame:
    """Words with the number of their line, top to bottom; words without a box stay out.

    Words are walked by height; one whose vertical middle lies below the lowest edge of
    what stands above it opens a new line.
    """
    boxed = words.where("y0 is not null and y1 is not null and x0 is not null")
    down = W.partitionBy("reading_id").orderBy("y0", "x0", "word_id")
    lowest = F.max("y1").over(down.rowsBetween(W.unboundedPreceding, -1))
    opens = lowest.isNull() | ((F.col("y0") + F.col("y1")) / 2 > lowest)
    return boxed.withColumn("line_no", F.sum(opens.cast("int")).over(down.rowsBetween(W.unboundedPreceding, 0)))


def reading_lines(words: DataFrame) -> DataFrame:
    """reading_id, line_no, text, words and box of each line (see `lined_words`)."""
    numbered = lined_words(distinct_words(words))
    parts = F.array_sort(F.collect_list(F.struct("x0", "word_id", "text")))
    return numbered.groupBy("reading_id", "line_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("words"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def reading_text(words: DataFrame) -> DataFrame:
    """reading_id and its words in order as one text."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "word_id", "text")))
    return distinct_words(words).groupBy("reading_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("words")
    )


def best_reading(readings: DataFrame) -> DataFrame:
    """One reading per page: native text first, then the surer one, then the earlier id."""
    rank = W.partitionBy("page_id").orderBy(
        F.when(F.col("route") == "nativo", 0).otherwise(1), F.col("confidence").desc_nulls_last(), "reading_id"
    )
    return readings.withColumn("rn", F.row_number().over(rank)).where("rn = 1").drop("rn")


def longest_reading(readings: DataFrame, words: DataFrame) -> DataFrame:
    """The reading of each page with the most words; ties take the earlier id."""
    counts = distinct_words(words).groupBy("reading_id").agg(F.count("*").alias("words"))
    sized = readings.join(counts, "reading_id", "left").na.fill(0, ["words"])
    rank = W.partitionBy("page_id").orderBy(F.desc("words"), "reading_id")
    return sized.withColumn("rn", F.row_number().over(rank)).where("rn = 1").select("page_id", "reading_id", "words")


def classify_page(text: Column) -> Column:
    """Class of a page: its legibility first, then a title near the top, then the most marks.

    `no valido como factura` rules out an invoice; ties go to the rule named first.
    """
    t = fold(text)
    head = F.substring(t, 1, 120)
    state = legibility(text)
    no_invoice = t.contains("no valido como factura")
    title = F.coalesce(*[F.when(head.contains(title) & ~((F.lit(name) == "factura") & no_invoice), name) for name, title, _ in PAGE_RULES])
    marks = [F.size(F.regexp_extract_all(t, F.lit(f"({m})"), F.lit(1))) for _, _, m in PAGE_RULES]
    most = F.greatest(*marks)
    by_marks = F.coalesce(*[F.when((m == most) & (most > 0), name) for (name, _, _), m in zip(PAGE_RULES, marks, strict=True)])
    return F.when(state != "readable", state).otherwise(F.coalesce(title, by_marks, F.lit("desconocido")))


def folio_notes(lines: DataFrame, page_height: float = 842.0, margin: float = 0.13) -> DataFrame:
    """reading_id and folio (number, suffix, back) of lines in the margins that are folio notes."""
    edge = (F.col("y0") < page_height * margin) | (F.col("y1") > page_height * (1 - margin))
    note = folio(F.col("text"))
    return lines.where(edge).select("reading_id", "line_no", note.alias("f")).where("f is not null").select("reading_id", "line_no", "f.*")


def columns_of(words: list[tuple[float, float, str]], gap: float) -> tuple[list[float], list[str]]:
    """Starts and texts of the cells of a line, left to right: a cell starts after a gap."""
    starts: list[float] = []
    cells: list[list[str]] = []
    end = None
    for x0, x1, text in words:
        if end is None or x0 - end >= gap:
            starts.append(x0)
            cells.append([text])
        else:
            cells[-1].append(text)
        end = x0 if x1 is None or x1 != x1 else x1
    return starts, [" ".join(c) for c in cells]


def places_in(starts: list[float], columns: list[float], near: float) -> list[int] | None:
    """The column of each start, in order; None if one has none or two share one."""
    found = []
    for x in starts:
        best = min(range(len(columns)), key=lambda c: abs(columns[c] - x))
        if abs(columns[best] - x) > near or (found and best <= found[-1]):
            return None
        found.append(best)
    return found


def table_blocks(lines: list[tuple[list[float], list[str]]], gap: float, least_rows: int) -> list[tuple[int, int, list[float]]]:
    """(first line, last line, columns) of the tables among a reading's lines, top to bottom.

    Seeds are runs of at least `least_rows` lines with the same two or more columns. Each
    grows up and down over lines with at least two cells that fit its columns, some of which
    may stay empty. The seed of most rows comes first, and no line belongs to two tables.
    """
    same = lambda p, q: len(p) == len(q) >= 2 and all(abs(x - y) <= gap / 2 for x, y in zip(p, q, strict=True))
    seeds, at = [], 0
    while at < len(lines):
        end = at
        while end + 1 < len(lines) and same(lines[end][0], lines[end + 1][0]):
            end += 1
        if end - at + 1 >= least_rows:
            seeds.append((at, end))
        at = end + 1
    taken: set[int] = set()
    blocks = []
    for first, last in sorted(seeds, key=lambda b: (b[0] - b[1], b[0])):
        if taken & set(range(first, last + 1)):
            continue
        columns = lines[first][0]
        fits = lambda i: 0 <= i < len(lines) and i not in taken and len(lines[i][0]) >= 2 and places_in(lines[i][0], columns, gap / 2) is not None  # noqa: B023, E731
        while fits(first - 1):
            first -= 1
        while fits(last + 1):
            last += 1
        taken |= set(range(first, last + 1))
        blocks.append((first, last, columns))
    return sorted(blocks)


def find_tables(lines_of_words: DataFrame, gap: float = 18.0, least_rows: int = 3) -> DataFrame:
    """reading_id, table_no, line_no, column_no, text: the cells of the tables of each reading (see `table_blocks`).

    Cells start after a gap of at least `gap` points; starts within half of it are one column.
    A page's words are the group, so no group grows with the data.
    """

    def per_reading(group: pd.DataFrame) -> pd.DataFrame:
        numbers, lines = [], []
        for line, words in group.sort_values(["line_no", "x0"]).groupby("line_no"):
            numbers.append(line)
            lines.append(columns_of(list(words[["x0", "x1", "text"]].itertuples(index=False, name=None)), gap))
        out = []
        for table_no, (first, last, columns) in enumerate(table_blocks(lines, gap, least_rows), 1):
            for i in range(first, last + 1):
                starts, cells = lines[i]
                out += [(group["reading_id"].iat[0], table_no, numbers[i], c + 1, t) for c, t in zip(places_in(starts, columns, gap / 2), cells, strict=True)]
        return pd.DataFrame(out, columns=["reading_id", "table_no", "line_no", "column_no", "text"])

    need = lines_of_words.select("reading_id", "line_no", "x0", "x1", "text")
    return need.groupBy("reading_id").applyInPandas(per_reading, "reading_id bigint, table_no int, line_no int, column_no int, text string")


def continue_tables(tables: DataFrame, file_col: str, page_col: str, columns_col: str, id_col: str) -> DataFrame:
    """Proposals that a file's next table, on the next page with as many columns, continues the one before."""
    w = W.partitionBy(file_col).orderBy(page_col, id_col)
    ahead = tables.select(
        file_col, id_col, page_col, columns_col, F.lead(id_col).over(w).alias("next_id"), F.lead(page_col).over(w).alias("next_page"), F.lead(columns_col).over(w).alias("next_columns")
    )
    return ahead.where((F.col("next_page") == F.col(page_col) + 1) & (F.col("next_columns") == F.col(columns_col))).select(file_col, id_col, "next_id")
