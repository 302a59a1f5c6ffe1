"""Finding the folio number that a page carries, and picking blocks that don't overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.identifiers import folio

# The margin of the page, the most companions in a line, the height of a line, the nearness of a neighbour.
MARGIN, COMPANIONS, LINE_HEIGHT, NEAR = 0.13, 2, 6.0, 45.0
# How sure a place of the page makes a folio number, what a near neighbour takes away, and the least.
TOP_RIGHT, BOTTOM_RIGHT, BOTTOM_MIDDLE, TOP_MIDDLE, ELSEWHERE, PER_NEIGHBOUR, LEAST = 0.92, 0.80, 0.72, 0.60, 0.5, 0.08, 0.3


def detect_folios(words: DataFrame, readings: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, literal, number, suffix, back, confidence: the likeliest folio number of each page.

    `words`: word_id, reading_id, text and box; `readings`: reading_id, page_id; `pages`:
    page_id, width_pt, height_pt. A candidate stands in the upper or lower margin with at most
    two others in its line; its place tells how sure it is. Of equal ones the first by reading
    and word is taken. Candidates are few, so that their lines come from one join by reading.
    """
    boxed = words.where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null").select("word_id", "reading_id", "text", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("middle")).distinct()
    where = readings.select("reading_id", "page_id").join(pages.where("width_pt > 0 and height_pt > 0").select("page_id", "width_pt", "height_pt"), "page_id")
    placed = boxed.join(where, "reading_id").withColumn("f", folio(F.col("text"))).where("f is not null")
    inside = (F.col("middle") > F.col("height_pt") * MARGIN) & (F.col("middle") < F.col("height_pt") * (1 - MARGIN))
    candidates = placed.where(~inside)
    others = boxed.select("reading_id", F.col("word_id").alias("other"), F.col("x0").alias("ox0"), F.col("x1").alias("ox1"), F.col("middle").alias("omiddle"))
    together = (F.col("other") != F.col("word_id")) & (F.abs(F.col("omiddle") - F.col("middle")) < LINE_HEIGHT)
    near = together & (F.col("ox0") - F.col("x1") < NEAR) & (F.col("x0") - F.col("ox1") < NEAR)
    keys = ["page_id", "reading_id", "word_id", "text", "f", "x0", "x1", "middle", "width_pt", "height_pt"]
    counted = candidates.join(others, "reading_id").groupBy(*keys).agg(F.count_if(together).alias("others"), F.count_if(near).alias("near")).where(F.col("others") <= COMPANIONS)
    center, top = (F.col("x0") + F.col("x1")) / 2, F.col("middle") <= F.col("height_pt") * MARGIN
    right, middle = center > F.col("width_pt") * 0.66, center.between(F.col("width_pt") * 0.33, F.col("width_pt") * 0.66)
    place = F.when(top & right, TOP_RIGHT).when(~top & right, BOTTOM_RIGHT).when(~top & middle, BOTTOM_MIDDLE).when(top & middle, TOP_MIDDLE).otherwise(ELSEWHERE)
    scored = counted.withColumn("confidence", F.round(F.greatest(F.lit(LEAST), place - PER_NEIGHBOUR * F.col("near")), 2))
    first = W.partitionBy("page_id").orderBy(F.desc("confidence"), "reading_id", "word_id")
    return scored.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("page_id", F.trim("text").alias("literal"), "f.number", "f.suffix", "f.back", "confidence")


def best_blocks(blocks: DataFrame, part: str, first: str, last: str, score: str) -> DataFrame:
    """The blocks of each part that a greedy choice keeps: best score first, none that overlaps a kept one.

    Ties go to the earlier and then the shorter block; closed spans that share a place
    overlap. Blocks with a null or reversed span are not chosen. A part is one page: its
    blocks are few.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        rows = []
        for i, r in group.sort_values([score, first, last], ascending=[False, True, True], na_position="last").iterrows():
            if r[first] <= r[last] and all(r[last] < a or b < r[first] for a, b in kept):
                kept.append((r[first], r[last]))
                rows.append(i)
        return group.loc[rows]

    return blocks.where(F.col(first).isNotNull() & F.col(last).isNotNull()).groupBy(part).applyInPandas(choose, blocks.schema)
