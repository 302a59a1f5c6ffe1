"""Decisions over facts, staleness, grouping, agreement of reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import decisions, graph, ordered, pipeline, procurement, relational, statistics, views
from folioscope.plans.registry import Catalogue
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

# The stages of the pipeline, their scope and what they need.
PIPELINE = pipeline.Registry(
    [
        pipeline.Stage("ingest", "file"),
        pipeline.Stage("read", "page", ("ingest",), version=2),
        pipeline.Stage("classify", "file", ("read",)),
        pipeline.Stage("segment", "file", ("classify",)),
        pipeline.Stage("folios", "file", ("read",)),
        pipeline.Stage("tables", "file", ("read", "segment")),
        pipeline.Stage("numbers_twice", "file", ("read", "classify")),
        pipeline.Stage("extract", "file", ("segment",)),
        pipeline.Stage("normalise", "file", ("extract",)),
        pipeline.Stage("lines", "file", ("tables", "extract", "classify"), version=2),
        pipeline.Stage("identity", "case", ("normalise",)),
        pipeline.Stage("index", "case", ("read",)),
        pipeline.Stage("entities", "case", ("index", "segment")),
        pipeline.Stage("chronology", "case", ("normalise",)),
        pipeline.Stage("interpret", "case", ("identity", "extract")),
        pipeline.Stage("procurements", "case", ("lines", "entities", "chronology")),
        pipeline.Stage("findings", "case", ("procurements",)),
    ]
)

_ONCE = "once as (select distinct field_id, case_id, piece_id, field_name, literal, null_reason, page_no, confidence, state from piece_fields)"


@CATALOGUE.add(
    f"with {_ONCE} select field_id, case when state = 'corregido' then upper(literal) when state = 'no_revisado' and null_reason = 'ilegible' then null else literal end as literal,"
    " case when state = 'no_revisado' and null_reason = 'ilegible' then 'ilegible' else state end as state from once"
)
def decision_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Facts under a log of decisions; a later revert undoes what stands before it."""
    f = table(spark, folder, "piece_fields", "field_id", "literal", "null_reason", "state").distinct()
    action = (
        F.when(F.col("state") == "verificado", "verify").when(F.col("state") == "corregido", "correct")
        .when((F.col("state") == "no_revisado") & (F.col("null_reason") == "ilegible"), "illegible").when(F.col("state") == "conflicto", "absent")
    )
    log = f.select("field_id", action.alias("action"), F.upper("literal").alias("value")).where("action is not null").withColumn("decision_id", F.lit(1))
    undone = log.where("action = 'absent'").select("field_id", F.lit("revert").alias("action"), "value", F.lit(2).alias("decision_id"))
    return decisions.overlay(f, log.unionByName(undone), ["field_id"]).select("field_id", "literal", "state")


@CATALOGUE.add(
    "with f as (select sha256, count(*) as seen, bool_or(original_path like '%/scan%') as scanned from case_files group by sha256)"
    " select sha256, seen, scanned, case when seen > 1 then 'accepted' else 'new' end as review, false as gone from f union all select 'removed', 3, true, 'rejected', true"
)
def file_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per file merged into a store in which people accepted the repeated ones and rejected one that is gone."""
    f = table(spark, folder, "case_files", "sha256", "original_path").groupBy("sha256").agg(
        F.count("*").alias("seen"), F.max(F.col("original_path").contains("/scan")).alias("scanned")
    )
    removed = spark.createDataFrame([("removed", 3, True, "rejected")], "sha256 string, seen bigint, scanned boolean, review string")
    old = f.where("seen > 1").select("sha256", F.lit(1).cast("bigint").alias("seen"), F.lit(False).alias("scanned"), F.lit("accepted").alias("review")).unionByName(removed)
    return decisions.upsert(old, f, "sha256")


_FILE_STAGES, _CASE_STAGES = ([n for n, s in PIPELINE.stages.items() if s.scope == k] for k in ("file", "case"))


@CATALOGUE.add(
    "with s as (select page_id, arg_max(engine_version, created_at) as version from readings group by page_id),"
    " u as (select p.page_id, p.file_sha, case when s.version is null then 'never' when s.version = '2.0' then 'current' else 'stale' end as state from case_pages p left join s using (page_id)),"
    " f as (select file_sha, bool_or(state <> 'current') as hit from u where file_sha is not null group by file_sha), c as (select distinct case_id from case_pages where case_id is not null)"
    " select 'read' as stage, cast(page_id as varchar) as unit, state from u union all select 'ingest', file_sha, 'current' from f"
    f" union all select x.stage, file_sha, case when hit then 'stale' else 'current' end from f cross join (select unnest([{', '.join(repr(n) for n in _FILE_STAGES if n != 'ingest')}]) as stage) x"
    f" union all select x.stage, case_id, case when (select bool_or(hit) from f) then 'stale' else 'current' end from c cross join (select unnest([{', '.join(repr(n) for n in _CASE_STAGES)}]) as stage) x"
)
def stale_units(spark: SparkSession, folder: str) -> DataFrame:
    """State of every page, file and case in all stages, from the versions that read the pages.

    Pages never read or read by an old engine make the stages of their file stale, and those
    of all cases.
    """
    pages = table(spark, folder, "case_pages", "page_id", "file_sha", "case_id").select(F.col("page_id").cast("string").alias("page"), F.col("file_sha").alias("file"), F.col("case_id").alias("case"))
    stages = {k: F.explode(F.array(*[F.lit(n) for n, s in PIPELINE.stages.items() if s.scope == k])).alias("stage") for k in ("page", "file", "case")}
    parts = [pages.select(F.col(k).alias("unit")).where("unit is not null").distinct().select(stage, "unit") for k, stage in stages.items()]
    units = parts[0].unionByName(parts[1]).unionByName(parts[2])
    r = table(spark, folder, "readings", "page_id", "engine_version", "created_at")
    fresh = F.when(F.col("engine_version") == "2.0", PIPELINE.stages["read"].signature).otherwise("1:old")
    read = r.select(F.lit("read").alias("stage"), F.col("page_id").cast("string").alias("unit"), fresh.alias("signature"), F.lit("done").alias("state"), F.col("created_at").alias("sealed_at"))
    signatures = spark.createDataFrame([(s.name, s.signature) for s in PIPELINE.stages.values()], "stage string, signature string")
    rest = units.where("stage <> 'read'").join(F.broadcast(signatures), "stage").select("stage", "unit", "signature", F.lit("done").alias("state"), F.lit(None).cast("timestamp").alias("sealed_at"))
    holders = pages.where("file is not null").select(F.col("page").alias("unit"), F.col("file").alias("holder")).distinct()
    return pipeline.unit_states(units, read.unionByName(rest), PIPELINE, holders, {"page": "file"})


@CATALOGUE.add(
    "with l as (select doc_id, labeller, string_agg(distinct cast(subject_id as varchar), ',' order by cast(subject_id as varchar)) as s from subject_labels group by all), t as (select doc_id, s as t from l where labeller = 'rev-a'), p as (select doc_id, s as p from l where labeller = 'rev-b')"
    " select 'subjects' as field, case when p.p is null then 'not_found' when t.t is null then 'correct_null' when p.p = t.t then 'hit' else 'silent_error' end as outcome, count(*) as n from t left join p using (doc_id) group by all"
)
def reviewer_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How one reviewer's set of subjects compares with another's: equal sets hit."""
    subjects = F.array_join(F.array_sort(F.collect_set(F.col("subject_id").cast("string"))), ",")
    sets = table(spark, folder, "subject_labels", "doc_id", "subject_id", "labeller").groupBy("doc_id", "labeller").agg(F.nullif(subjects, F.lit("")).alias("s")).withColumn("field", F.lit("subjects"))
    side = lambda who: sets.where(F.col("labeller") == who).drop("labeller")
    return statistics.confusion(side("rev-b"), side("rev-a"), ["doc_id", "field"], "s", F.lit(False))


@CATALOGUE.add(
    "select labeller, count(*) as labels, count(distinct doc_id) as documents, count(distinct subject_id) as subjects from subject_labels group by labeller"
)
def reviewer_activity(spark: SparkSession, folder: str) -> DataFrame:
    """What each reviewer did."""
    s = table(spark, folder, "subject_labels", "doc_id", "subject_id", "labeller")
    return s.groupBy("labeller").agg(F.count("*").alias("labels"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("subject_id").alias("subjects"))


_LATEST = "lines as (select * exclude (rn) from (select *, row_number() over (partition by line_id order by loaded_at desc) as rn from price_lines) where rn = 1)"


@CATALOGUE.add(
    f"with {_LATEST}, e as (select distinct case_id, supplier_tax_id, document_id from lines where supplier_tax_id is not null), n as (select case_id, supplier_tax_id, document_id, lead(document_id) over (partition by case_id, supplier_tax_id order by document_id) as next from e),"
    " f as (select distinct document_id from lines where stage = 'factura') select distinct document_id, next from n where next is not null and (document_id in (select document_id from f) or next in (select document_id from f))"
)
def links_with_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """Links between a supplier's documents that touch an invoice on either end."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "document_id", "supplier_tax_id", "stage"))
    keyed = p.where("supplier_tax_id is not null").withColumn("key", F.struct("case_id", "supplier_tax_id"))
    links = ordered.chain(keyed, "key", "document_id").select("document_id", "next")
    return relational.either_end(links, ("document_id", "next"), p.where("stage = 'factura'").select(F.col("document_id").alias("d")).distinct(), "d")


@CATALOGUE.add(
    "with recursive n as (select page_id, next_id from (select page_id, file_sha, page_no, page_class, lead(page_id) over w as next_id, lead(page_no) over w as np, lead(page_class) over w as nc from case_pages where page_class is not null window w as (partition by file_sha order by page_no, page_id))"
    " where np = page_no + 1 and nc = page_class), h as (select page_id as node, page_id as component from n where page_id not in (select next_id from n) union all select n.next_id, h.component from h join n on n.page_id = h.node) select node, component from h"
)
def page_components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of pages linked by continuation, as connected components."""
    from folioscope.plans.papers import page_continuation

    return graph.components(page_continuation(spark, folder), "page_id", "next_id")


@CATALOGUE.add()
def procurement_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of a case that share a procedure, or a supplier on near pages of a file, never across two procedures."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "document_id", "file_sha", "page_no", "supplier_tax_id", "procurement_id")).where("document_id is not null")
    where = p.groupBy("case_id", "document_id").agg(
        F.min("file_sha").alias("file"), F.min("page_no").alias("page_from"), F.max("page_no").alias("page_to"), F.min(F.col("procurement_id").cast("string")).alias("label")
    )
    tax = p.select("case_id", "document_id", F.col("supplier_tax_id").alias("tax")).distinct()
    papers = where.join(tax, ["case_id", "document_id"]).withColumnRenamed("document_id", "node")
    anchors = p.where("procurement_id is not null").select("case_id", F.col("document_id").alias("node"), F.col("procurement_id").cast("string").alias("key"))
    return procurement.procurement_groups(papers, anchors.distinct()).select("case_id", F.col("node").alias("document_id"), "group")
