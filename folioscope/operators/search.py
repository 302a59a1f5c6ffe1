"""Search over page texts: an inverted index, ranked and plain queries, coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold, py_fold

# Characters that readings mix up, both ways, and the most variants offered.
READING_SWAPS = (("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("b", "6"), ("g", "9"), ("z", "2"), ("q", "9"), ("rn", "m"), ("ll", "n"))
MOST_VARIANTS = 6


def terms(text: Column) -> Column:
    """Folded words of letters and digits."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != "")


def inverted_index(pages: DataFrame, page: str, text: str) -> DataFrame:
    """term, page, hits, length: one row per term and page."""
    words = pages.where(F.col(text).isNotNull()).select(F.col(page).alias("page"), terms(F.col(text)).alias("t"))
    sized = words.select("page", F.size("t").alias("length"), F.explode("t").alias("term"))
    return sized.groupBy("term", "page").agg(F.count("*").alias("hits"), F.max("length").alias("length"))


def compile_query(query: str) -> tuple[list[str], list[str]]:
    """(phrases, terms) of a query: quoted phrases stay whole, words of three letters match as prefix."""
    phrases = [py_fold(p) for p in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"[^"]*"', " ", query)
    return phrases, [w for w in re.split(r"[^a-z0-9]+", py_fold(rest)) if w]


def _word_test(word: str):
    """Test of one token: a prefix from three letters on, else the whole word."""
    return (lambda t: t.startswith(word)) if len(word) >= 3 else (lambda t: t == word)


def matches(text: Column, query: str) -> Column:
    """Whether a text has all words (as prefixes from three letters on) and phrases of a query."""
    phrases, words = compile_query(query)
    folded, tokens = fold(text), terms(text)
    cond = F.lit(True)
    for p in phrases:
        cond = cond & folded.contains(p)
    for w in words:
        cond = cond & F.exists(tokens, _word_test(w))
    return F.coalesce(cond, F.lit(False))


def rank_bm25(index: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """page, score of the pages that hold every word of the query."""
    _, words = compile_query(query)
    words = sorted(set(words))
    pages = index.select("page", "length").distinct().agg(F.count("*").alias("pages"), F.avg("length").alias("mean"))
    wanted = F.array(*[F.lit(w) for w in words])
    hit = index.withColumn(
        "word", F.explode(F.filter(wanted, lambda w: F.when(F.length(w) >= 3, F.col("term").startswith(w)).otherwise(F.col("term") == w)))
    )
    per_page = hit.groupBy("word", "page").agg(F.sum("hits").alias("tf"), F.max("length").alias("length"))
    df = per_page.groupBy("word").agg(F.count("*").alias("df"))
    scored = per_page.join(F.broadcast(df.limit(len(words) + 1)), "word").crossJoin(F.broadcast(pages))  # one row
    idf = F.log(1 + (F.col("pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("page").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(words)).drop("n")


def variants_of(text: Column) -> Column:
    """array of the spellings that a bad reading may have left of a text of three letters or more, in the order of the swaps."""
    base = fold(text)
    swapped = F.array(*[F.replace(base, F.lit(x), F.lit(y)) for a, b in READING_SWAPS for x, y in ((a, b), (b, a))])
    return F.slice(F.array_distinct(F.filter(swapped, lambda v: (F.length(base) >= 3) & (v != base))), 1, MOST_VARIANTS)


def rank_pages(pages: DataFrame, page: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """page, score (BM25) of the pages that hold every word of the query, without an index.

    One pass counts the query's words in each text where it stands; nothing else is exploded
    or shuffled. For many queries over the same texts, keep `inverted_index` as a table.
    """
    words = sorted(set(compile_query(query)[1]))
    tokens = pages.where(F.col(text).isNotNull()).select(F.col(page).alias("page"), terms(F.col(text)).alias("t"))
    counted = tokens.select("page", F.size("t").alias("length"), *[F.size(F.filter("t", _word_test(w))).alias(f"tf{i}") for i, w in enumerate(words)]).where("length > 0")
    whole = counted.agg(F.count("*").alias("pages"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    score, every = F.lit(0.0), F.lit(len(words) > 0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("pages") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        every = every & (tf > 0)
    return counted.where(every).crossJoin(F.broadcast(whole)).select("page", score.alias("score"))  # one row


def search_coverage(pages: DataFrame, readings: DataFrame, page: str = "page_id", text: str = "page_text") -> DataFrame:
    """Pages in all, indexed, read but not indexed, never read, and indexed without text."""
    read = readings.select(page).distinct().withColumn("was_read", F.lit(True))
    state = pages.join(read, page, "left")
    indexed = F.col(text).isNotNull()
    return state.agg(
        F.count("*").alias("pages"),
        F.count(F.when(indexed, 1)).alias("indexed"),
        F.count(F.when(indexed & (F.trim(text) == ""), 1)).alias("indexed_without_text"),
        F.count(F.when(~indexed & F.col("was_read"), 1)).alias("read_not_indexed"),
        F.count(F.when(~indexed & F.col("was_read").isNull(), 1)).alias("never_read"),
    )
