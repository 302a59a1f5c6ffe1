"""Analyses that hold several readings, or words and digits, against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import consensus, pages
from folioscope.operators.views import latest_lines
from folioscope.plans.registry import Catalogue
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

_FOLD = "trim(regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy'), '\\s+', ' ', 'g'))"
_TEXTS = "w as (select distinct word_id, reading_id, ord, text from words where text <> ''), t as (select reading_id, string_agg(text, ' ' order by ord, word_id) as text from w group by reading_id)"


@CATALOGUE.add(
    f"with {_TEXTS}, e as (select r.page_id, r.route, list_distinct(list_filter(regexp_extract_all({_FOLD.format('t.text')}, '[a-z0-9]+'), lambda x: x <> '')) as words from readings r join t using (reading_id))"
    " select a.page_id, a.route as route_a, b.route as route_b, len(a.words) as words_a, len(b.words) as words_b, len(list_intersect(a.words, b.words)) as common from e a join e b on a.page_id = b.page_id and a.route < b.route"
)
def route_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How far the routes of a page read the same words."""
    return consensus.route_text_agreement(table(spark, folder, "readings", "reading_id", "page_id", "route"), pages.reading_text(table(spark, folder, "words")))


@CATALOGUE.add(
    "with f as (select distinct field_id, piece_id, field_name, literal, null_reason, confidence, state from piece_fields), g as (select piece_id, field_name, list_sort(list(distinct literal) filter (where literal is not null)) as v, count(literal) as routes, max(confidence) as best,"
    " bool_or(coalesce(null_reason = 'manuscrito', false)) as hand, min(case null_reason when 'manuscrito' then 1 when 'conflicto' then 2 when 'ambiguo' then 3 when 'ilegible' then 4 when 'ausente' then 5 end) as r from f group by piece_id, field_name)"
    " select piece_id, field_name, case when len(v) = 1 and not hand then v[1] end as value, case when hand or coalesce(len(v), 0) = 0 then 'no_revisado' when len(v) > 1 then 'conflicto'"
    " when routes = 1 and field_name in ('nombre', 'documento') then 'pendiente_baja' else 'automatico_alta' end as state, round(case when len(v) = 1 and not hand then best * case when routes = 1 then 0.6 else 1.0 end end, 6) as confidence,"
    " case when hand then 'manuscrito' when coalesce(len(v), 0) = 0 then ['manuscrito','conflicto','ambiguo','ilegible','ausente'][coalesce(r, 5)] when len(v) > 1 then 'conflicto' end as reason, case when len(v) > 1 then v end as variants from g"
)
def field_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """One value per field from what its readers say, or why there is none."""
    f = table(spark, folder, "piece_fields", "field_id", "piece_id", "field_name", "literal", "null_reason", "confidence", "state").distinct()
    r = f.select("piece_id", "field_name", F.col("literal").alias("value"), F.col("null_reason").alias("reason"), "confidence")
    return consensus.route_consensus(r, ["piece_id", "field_name"], F.col("field_name").isin("nombre", "documento"))


@CATALOGUE.add(
    f"with x as (select doc_id, {_FOLD.format('text')} as t from documents where text is not null) select doc_id as id,"
    " (select case when len(list_distinct(f)) = 1 then f[1] end from (select regexp_extract_all(t, '(?:expediente|expte\\.?)\\s*(?:n[°ºo]\\.?\\s*)?((?:exp-)?[0-9]+/[0-9]{4})', 1) as f)) as file_no,"
    " (select case when len(list_distinct(f)) = 1 then f[1] end from (select regexp_extract_all(t, '\\b([0-9]{2}/[0-9]{2}/[0-9]{4})\\b', 1) as f)) as day,"
    " case when regexp_matches(t, 'u\\$s|usd|dolares') and not regexp_matches(t, '\\$ ?[0-9]|pesos') then 'USD' when regexp_matches(t, '\\$ ?[0-9]|pesos') and not regexp_matches(t, 'u\\$s|usd|dolares') then 'ARS' end as currency,"
    " case when regexp_matches(t, 'iva incluido|impuestos incluidos|incluyen impuestos') and not regexp_matches(t, 'mas iva|iva discriminado') then 'incluido'"
    " when regexp_matches(t, 'mas iva|iva discriminado') and not regexp_matches(t, 'iva incluido|impuestos incluidos|incluyen impuestos') then 'discriminado' end as vat,"
    " case when regexp_matches(t, 'flete') then 'flete' end as delivery from x".replace("{4}", "{{4}}").replace("{{4}}", "{4}")
)
def document_context(spark: SparkSession, folder: str) -> DataFrame:
    """File number, date, currency, tax treatment and freight that each paper states once."""
    return consensus.document_context(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


@CATALOGUE.add(
    "with x as (select doc_id, regexp_replace(text, '\\s+', ' ', 'g') as s, text from documents where text is not null), a as (select doc_id, list_sort(list_distinct(list_transform("
    "regexp_extract_all(s, '(?:\\$\\s?|ARS )([0-9]{1,3}(?:\\.[0-9]{3})+(?:,[0-9]{2})?|[0-9]+(?:,[0-9]{2})?)', 1) || regexp_extract_all(text, '(?:^|[^0-9.,/$-])([0-9]{1,3}(?:\\.[0-9]{3})*,[0-9]{2})(?:[^0-9]|$)', 1),"
    " lambda v: case when regexp_matches(v, '^\\$?\\s*([0-9]{1,3}(\\.[0-9]{3})+|[0-9]+)(,[0-9]{2})?$') then try_cast(replace(replace(v, '.', ''), ',', '') || case when v like '%,%' then '' else '00' end as bigint) end))) as cents from x)"
    " select doc_id, list_filter(cents, lambda v: v is not null) as cents from a"
)
def amounts_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """All amounts of each document, in cents."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", consensus.free_amounts(F.col("text")).alias("cents"))


@CATALOGUE.add()
def numbers_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that a page or document writes in words and in digits, and whether they agree."""
    papers = table(spark, folder, "documents", "doc_id", "text").unionByName(table(spark, folder, "case_pages", "page_id", "page_text").toDF("doc_id", "text"))
    return consensus.numbers_written_twice(papers, "doc_id", "text")


@CATALOGUE.add(
    "select case_id, case when count(*) filter (where regexp_matches(quantity_literal, '^[0-9.]*[0-9],[0-9]{1,2}$')) > count(*) filter (where regexp_matches(quantity_literal, '^[0-9,]*[0-9]\\.[0-9]{1,2}$')) then 'comma'"
    " when count(*) filter (where regexp_matches(quantity_literal, '^[0-9,]*[0-9]\\.[0-9]{1,2}$')) > count(*) filter (where regexp_matches(quantity_literal, '^[0-9.]*[0-9],[0-9]{1,2}$')) then 'dot' end as notation from price_lines group by case_id"
)
def decimal_notation(spark: SparkSession, folder: str) -> DataFrame:
    """Which decimal mark each case's tables use."""
    return consensus.vote_notation(table(spark, folder, "price_lines", "case_id", "quantity_literal"), "case_id", "quantity_literal")


@CATALOGUE.add()
def word_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables among the words of the readings, as cells."""
    return pages.find_tables(pages.lined_words(pages.distinct_words(table(spark, folder, "words"))))


_STATES = ("automatico_alta", "pendiente_baja", "conflicto", "no_revisado", "verificado", "corregido")
#: Counters by table; the expressions mean the same in both engines.
COUNTERS = {
    "case_files": {"sightings": "count(*)", "files": "count(distinct sha256)", "cases": "count(distinct case_id)", "bytes": "cast(sum(bytes) as bigint)", "files_of_unknown_length": "count(distinct case when pages is null then sha256 end)"},
    "case_pages": {"pages": "count(*)", "indexed": "count(page_text)", "classified": "count(page_class)", "blank": "count(case when fingerprint = '' then 1 end)", "files_with_pages": "count(distinct file_sha)"},
    "readings": {"readings": "count(*)", "pages_read": "count(distinct page_id)", "native": "count(case when route = 'nativo' then 1 end)", "readings_without_words": "count(case when confidence is null then 1 end)"},
    "piece_fields": {"pieces": "count(distinct piece_id)", "fields": "count(distinct field_id)", **{f"fields_{s}": f"count(distinct case when state = '{s}' then field_id end)" for s in _STATES}},
    "person_aliases": {"aliases": "count(distinct alias_id)", "persons": "count(distinct person_id)", "typed_aliases": "count(distinct case when field_id is null then alias_id end)"},
    "price_lines": {
        "lines": "count(distinct line_id)", "assigned_lines": "count(distinct case when item_id is not null then line_id end)", "procedures": "count(distinct procurement_id)",
        "suppliers": "count(distinct supplier_tax_id)", "invoice_lines": "count(distinct case when stage = 'factura' then line_id end)", "lines_without_price": "count(distinct case when unit_price is null then line_id end)",
    },
    "documents": {"documents": "count(distinct doc_id)", "undated_documents": "count(distinct case when doc_date is null then doc_id end)"},
    "subject_labels": {"labelled_documents": "count(distinct doc_id)", "labellers": "count(distinct labeller)"},
}


@CATALOGUE.add("select * from " + " cross join ".join(f"(select {', '.join(f'{e} as {n}' for n, e in c.items())} from {t})" for t, c in COUNTERS.items()))
def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of a dashboard: one scan and one aggregation per table, single rows side by side."""
    parts = [table(spark, folder, t).agg(*[F.expr(e).alias(n) for n, e in c.items()]) for t, c in COUNTERS.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.crossJoin(p)  # one row each
    return whole


@CATALOGUE.add(
    "with h as (select file_sha, count(distinct field_id) as n from piece_fields where state in ('verificado','corregido') group by file_sha union all select file_sha, count(distinct line_id) from price_lines where state in ('verificado','corregido') group by file_sha)"
    " select file_sha, sum(n)::bigint as decisions from h group by file_sha"
)
def human_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Human decisions per file over all kinds of facts."""
    human = F.col("state").isin("verificado", "corregido")
    a = table(spark, folder, "piece_fields", "file_sha", "field_id", "state").where(human).groupBy("file_sha").agg(F.countDistinct("field_id").alias("n"))
    b = table(spark, folder, "price_lines", "file_sha", "line_id", "state").where(human).groupBy("file_sha").agg(F.countDistinct("line_id").alias("n"))
    return a.unionByName(b).groupBy("file_sha").agg(F.sum("n").alias("decisions"))


@CATALOGUE.add(
    "select case_id, count(distinct document_id) as documents, count(distinct item_id) as items, count(distinct stage) as stages, count(distinct procurement_id) as procedures, count(distinct supplier_tax_id) as suppliers from price_lines group by case_id"
)
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact distinct counts per case."""
    p = table(spark, folder, "price_lines", "case_id", "document_id", "item_id", "stage", "procurement_id", "supplier_tax_id")
    names = {"documents": "document_id", "items": "item_id", "stages": "stage", "procedures": "procurement_id", "suppliers": "supplier_tax_id"}
    return p.groupBy("case_id").agg(*[F.countDistinct(c).alias(n) for n, c in names.items()])


@CATALOGUE.add("select sha256, ingested_at from (select sha256, max(ingested_at) as ingested_at from case_files group by sha256) order by ingested_at nulls first, sha256 limit 25")
def oldest_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first batch to be verified again: never seen first, then the oldest."""
    f = table(spark, folder, "case_files", "sha256", "ingested_at").groupBy("sha256").agg(F.max("ingested_at").alias("ingested_at"))
    return f.orderBy(F.col("ingested_at").asc_nulls_first(), "sha256").limit(25)


@CATALOGUE.add("select file_sha from case_pages except select file_sha from piece_fields")
def files_without_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose pages gave no fact at all: a set difference."""
    a = table(spark, folder, "case_pages", "file_sha").distinct()
    return a.join(table(spark, folder, "piece_fields", "file_sha"), "file_sha", "left_anti")


_TOTALS = (
    "t as (select case_id, document_id, sum(cast(subtotal * 100 as bigint))::bigint as cents from (select distinct on (line_id) * from price_lines order by line_id, loaded_at desc) group by case_id, document_id)"
)


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    p = latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "document_id", "subtotal"))
    return p.groupBy("case_id", "document_id").agg(F.sum((F.col("subtotal") * 100).cast("bigint")).alias("cents"))


@CATALOGUE.add(
    f"with {_TOTALS} select case_id, document_id, cents, row_number() over (order by cents = 0, cents desc, document_id) as place, (select count(*) from t where cents is not null) as of from t where cents is not null order by place limit 40"
)
def largest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The forty documents with the largest totals, zeros last, with the number of all beside the cut."""
    t = _totals(spark, folder).where("cents is not null")
    top = t.orderBy(F.col("cents") == 0, F.desc("cents"), "document_id").limit(40)
    placed = top.withColumn("place", F.row_number().over(W.orderBy(F.col("cents") == 0, F.desc("cents"), "document_id")))
    return placed.crossJoin(t.agg(F.count("*").alias("of")))  # one row


@CATALOGUE.add(f"with {_TOTALS} select case_id, document_id from t where cents is null")
def documents_without_total(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose total is unknown, which stand in a list of their own."""
    return _totals(spark, folder).where("cents is null").select("case_id", "document_id")
