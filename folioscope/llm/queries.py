"""Queries of the training-data operators, by name, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.catalogue import match_catalogue
from folioscope.llm.mixing import mix_report, mix_sources, step_length, whole_weights
from folioscope.llm.neardup import near_duplicates
from folioscope.llm.packing import pack_documents, pack_report
from folioscope.llm.parties import link_parties, names_of_cases
from folioscope.llm.scans import scan_paragraphs, scan_repairs
from folioscope.llm.subjects import classify_subjects
from folioscope.llm.tokens import with_tokens
from folioscope.session import cut_lineage
from folioscope.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pages of like text: runs of three words, similarity 0.5, twenty words."""
    pages = table(spark, folder, "case_pages", "page_id", "page_text")
    pairs = near_duplicates(pages, "page_id", "page_text", run=3, threshold=0.5, min_words=20)
    return pairs.toDF("page_id_a", "page_id_b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The words of scanned pages that a repair has to treat."""
    return scan_repairs(
        table(spark, folder, "words", "word_id", "reading_id", "ord", "text", "x0", "y0"),
        table(spark, folder, "readings", "reading_id", "page_id", "route"),
        table(spark, folder, "case_pages", "page_id", "file_sha", "page_no", "page_text"),
    ).select("word_id", "kind")


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired paragraphs of each reading, in order."""
    return scan_paragraphs(
        table(spark, folder, "words", "word_id", "reading_id", "ord", "text", "x0", "y0", "x1"),
        table(spark, folder, "readings", "reading_id", "page_id", "route"),
        table(spark, folder, "case_pages", "page_id", "file_sha", "page_no", "page_text"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of a case that mean the same party."""
    return link_parties(
        names_of_cases(
            table(spark, folder, "price_lines", "case_id", "supplier_name", "supplier_tax_id"),
            table(spark, folder, "piece_fields", "case_id", "field_name", "literal"),
            table(spark, folder, "person_aliases", "case_id", "name_literal", "strong_key"),
        )
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue entry of every price line without item, 0 if there is none."""
    lines = table(spark, folder, "price_lines", "line_id", "description", "item_id")
    return match_catalogue(lines, table(spark, folder, "catalog_items", "item_id", "item_name"))


def p5_misses(spark: SparkSession, folder: str) -> DataFrame:
    """The descriptions for which the catalogue has no entry, with the number of lines of each."""
    missed = p5_found(spark, folder).where("item_id = 0").select("line_id")
    lines = table(spark, folder, "price_lines", "line_id", "description").where("description is not null")
    return lines.join(missed, "line_id").groupBy("description").agg(F.countDistinct("line_id").alias("lines"))


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The pack of each piece of each document, for every capacity."""
    sized = cut_lineage(with_tokens(table(spark, folder, "documents", "doc_id", "text")))
    return pack_documents(sized, table(spark, folder, "pack_sizes", "pack_id", "capacity_tokens"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Use of space per capacity."""
    return pack_report(cut_lineage(p6_packs(spark, folder)))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeats and their place in the mix."""
    sized = with_tokens(table(spark, folder, "documents", "doc_id", "text", "source"), "source")
    return mix_sources(sized, table(spark, folder, "mix_targets", "source", "target_share", "max_repeats"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the mix that each source reaches."""
    return mix_report(p7_mix(spark, folder), table(spark, folder, "mix_targets", "source", "target_share", "max_repeats"))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: packs that hold too much, documents cut that needn't be, documents whose pieces don't add up; all must be 0."""
    sized = cut_lineage(with_tokens(table(spark, folder, "documents", "doc_id", "text")))
    sizes = table(spark, folder, "pack_sizes", "pack_id", "capacity_tokens")
    packed = cut_lineage(pack_documents(sized, sizes))
    over = packed.groupBy("pack_id", "capacity_tokens", "pack_no").agg(F.sum("n_tokens").alias("held")).groupBy("pack_id").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("laid"), F.max("capacity_tokens").alias("capacity"))
    # The list of capacities is short; `pack_documents` raises beyond a hundred.
    kinds = [F.lit(r.pack_id) for r in sizes.select("pack_id").distinct().limit(101).collect()]
    wanted = sized.where("n_tokens > 0").withColumn("pack_id", F.explode(F.array(*kinds)))
    both = wanted.join(docs, ["pack_id", "doc_id"], "left")
    wrong = both.groupBy("pack_id").agg(
        F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut_in_vain"), F.count_if(~F.col("laid").eqNullSafe(F.col("n_tokens"))).alias("not_whole")
    )
    return over.join(wrong, "pack_id")


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: uses beyond the allowed ones (0), and whether its tokens are within one block of its share of the mix."""
    targets = table(spark, folder, "mix_targets", "source", "target_share", "max_repeats")
    mixed = cut_lineage(p7_mix(spark, folder))
    whole, longest = mixed.agg(F.sum("n_tokens"), F.max("n_tokens")).first()
    shares = {r.source: r.target_share for r in targets.join(mixed, "source", "left_semi").limit(10_000).collect()}
    block = 2 * step_length(longest or 1, whole_weights(shares)) if shares else 1
    report = mix_report(mixed, targets)
    near = F.abs(F.col("tokens") - F.col("target_share") * F.lit(whole or 0)) < block
    return report.select("source", F.greatest(F.col("repeats") - F.col("max_repeats"), F.lit(0)).alias("too_often"), near.alias("near"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of each document."""
    return classify_subjects(
        table(spark, folder, "documents", "doc_id", "text"),
        table(spark, folder, "subject_labels", "doc_id", "subject_id"),
        table(spark, folder, "subjects", "subject_id"),
    )


QUERIES = {
    q.__name__: q
    for q in (p1_found, p2_found, p2_paragraphs, p3_found, p5_found, p5_misses, p6_packs, p6_report, p6_invariants, p7_mix, p7_shares, p7_invariants, p8_found)
}
ORACLES: dict[str, str] = {
    # The exact similarity of all pairs that share a run, on the sets themselves.
    "p1_found": (
        "with w as (select distinct page_id, list_filter(regexp_split_to_array(lower(page_text), '\\s+'), lambda x: x <> '') as l from case_pages where page_text is not null),"
        " r as (select distinct page_id, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] as run from (select page_id, l, unnest(range(1, len(l) - 1)) as i from w where len(l) >= 20)),"
        " n as (select page_id, count(*) as n from r group by page_id),"
        " c as (select a.page_id as a, b.page_id as b, count(*) as common from r a join r b on a.run = b.run and a.page_id < b.page_id group by all)"
        " select a as page_id_a, b as page_id_b from c join n x on x.page_id = a join n y on y.page_id = b where common >= 0.5 * (x.n + y.n - common)"
    ),
    "p6_invariants": "select distinct pack_id, 0 as overfull, 0 as cut_in_vain, 0 as not_whole from pack_sizes",
    "p7_invariants": "select source, 0 as too_often, true as near from mix_targets",
}
