"""Analyses over extracted facts: views, intervals, coverage, totals, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numbers import amount_cents, day_month_year
from folioscope.operators import intervals, statistics, views
from folioscope.operators.relational import page_of
from folioscope.plans.registry import Catalogue
from folioscope.schema import FIELDS, FIRM_STATES, HUMAN_STATES, sql_list
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

_FIRM, _HUMAN = sql_list(FIRM_STATES), sql_list(HUMAN_STATES)
_ONCE = "once as (select distinct field_id, case_id, piece_id, file_sha, field_name, literal, null_reason, page_no, confidence, state from piece_fields)"
_CENTS = r"case when regexp_matches({0}, '^\$?\s*([0-9]{{1,3}}(\.[0-9]{{3}})+|[0-9]+)(,[0-9]{{2}})?$') then cast(regexp_replace(regexp_replace({0}, '[^0-9,]', '', 'g'), ',', '') || case when {0} like '%,%' then '' else '00' end as bigint) end"
_DATE = "try_strptime(case when regexp_matches({0}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then {0} end, '%d/%m/%Y')::date"
_CONTRACTS = f"""{_ONCE},
wide as (
  select case_id, piece_id, file_sha, {', '.join(f"max(literal) filter (where field_name = '{f}' and state in {_FIRM}) as {f}" for f in FIELDS)},
    min(confidence) filter (where state in {_FIRM}) as lowest_confidence,
    count(*) filter (where state in {_HUMAN}) as human_fields
  from once group by all),
contracts as (
  select case_id, piece_id, file_sha, nombre, regexp_replace(documento, '[^0-9]', '', 'g') as d,
    case when length(regexp_replace(documento, '[^0-9]', '', 'g')) in (7, 8) then 'DNI:' || ltrim(regexp_replace(documento, '[^0-9]', '', 'g'), '0') end as strong_key,
    coalesce(case when length(regexp_replace(documento, '[^0-9]', '', 'g')) in (7, 8) then 'DNI:' || ltrim(regexp_replace(documento, '[^0-9]', '', 'g'), '0') end, 'doc:#' || file_sha || '#' || piece_id) as person,
    {_CENTS.format('trim(monto)')} as cents, {_DATE.format('fecha_inicio')} as starts, {_DATE.format('fecha_fin')} as ends, lowest_confidence, human_fields
  from wide)"""


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(
        spark, folder, "piece_fields", "field_id", "case_id", "piece_id", "file_sha", "field_name", "literal", "null_reason", "page_no", "confidence", "state"
    )


def _contracts(spark: SparkSession, folder: str) -> DataFrame:
    return views.contracts(_fields(spark, folder))


@CATALOGUE.add(f"with {_CONTRACTS} select case_id, piece_id, {', '.join(FIELDS)}, lowest_confidence, human_fields from wide")
def working_view_contract(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece with its firm fields."""
    return views.wide_facts(_fields(spark, folder)).drop("file_sha")


@CATALOGUE.add(
    f"with {_ONCE} select case_id, piece_id, {', '.join(f'''max(literal) filter (where field_name = '{f}') as {f}, max(state) filter (where field_name = '{f}') as {f}_state''' for f in FIELDS)},"
    f" min(confidence) as lowest_confidence, count(*) filter (where state in {_HUMAN}) as human_fields from once group by case_id, piece_id, file_sha"
)
def working_view_all(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece with every value beside its state."""
    return views.wide_facts(_fields(spark, folder), gated=False).drop("file_sha")


@CATALOGUE.add(
    f"with {_ONCE} select field_id, case when state in {_HUMAN} then state when state = 'conflicto' then 'conflicto' when literal is null then 'no_revisado'"
    " when confidence is null or confidence < 0.8 then 'pendiente_baja' else 'automatico_alta' end as state from once"
)
def field_states(spark: SparkSession, folder: str) -> DataFrame:
    """State of each fact from decision, conflict, absence and confidence."""
    f = views.distinct_facts(_fields(spark, folder))
    return f.select(
        "field_id", views.classify_state(F.col("state"), F.col("state") == "conflicto", F.col("literal"), F.col("confidence"), 0.8).alias("state")
    )


@CATALOGUE.add(
    "select page_id, case when page_class in ('contrato_obra','contrato_personal','contrato_locacion') then 'contract' when page_class in ('factura','recibo','remito') then 'voucher'"
    " when page_class in ('decreto','resolucion','rendicion') then 'act' end as family from case_pages"
)
def page_families(spark: SparkSession, folder: str) -> DataFrame:
    """Family of each page's class."""
    return table(spark, folder, "case_pages", "page_id", "page_class").select("page_id", views.family(F.col("page_class")).alias("family"))


IMPOSSIBLE = (
    "select piece_id, case when ends < starts then 'ends before it starts' when year(starts) < 1983 then 'starts before 1983'"
    " when year(ends) > 2027 then 'ends after 2027' when date_diff('day', starts, ends) > 3650 then 'longer than ten years' end as reason from contracts where reason is not null"
)


def impossible(c: DataFrame, year: int = 2025) -> DataFrame:
    """piece_id and the first reason why its dates can't be; `year` is the year of reading."""
    reason = (
        F.when(F.col("ends") < F.col("starts"), "ends before it starts")
        .when(F.year("starts") < 1983, "starts before 1983")
        .when(F.year("ends") > year + 2, f"ends after {year + 2}")
        .when(F.datediff("ends", "starts") > 3650, "longer than ten years")
    )
    return c.select("piece_id", reason.alias("reason")).where("reason is not null")


@CATALOGUE.add(f"with {_CONTRACTS} {IMPOSSIBLE}")
def impossible_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts whose dates can't be, with the first reason; the year of reading is a parameter."""
    return impossible(_contracts(spark, folder))


@CATALOGUE.add(
    f"with {_CONTRACTS} select piece_id, trim((case when starts is null then 'sin inicio; ' else '' end) || (case when ends is null then 'sin fin; ' else '' end)"
    " || (case when strong_key is null then 'sin persona; ' else '' end) || (case when cents is null then 'sin monto; ' else '' end)) as reasons"
    " from contracts where starts is null or ends is null or strong_key is null or cents is null"
)
def excluded_from_cross(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts that lack what the overlap analysis needs, with all reasons."""
    c = _contracts(spark, folder)
    lacks = [("starts", "sin inicio; "), ("ends", "sin fin; "), ("strong_key", "sin persona; "), ("cents", "sin monto; ")]
    text = F.trim(F.concat(*[F.when(F.col(k).isNull(), t).otherwise("") for k, t in lacks]))
    return c.select("piece_id", text.alias("reasons")).where("reasons <> ''")


OVERLAPS = (
    "select a.case_id, a.person, a.piece_id as piece_a, b.piece_id as piece_b, date_diff('day', greatest(a.starts, b.starts), least(a.ends, b.ends)) + 1 as days,"
    " coalesce(a.cents, 0) + coalesce(b.cents, 0) as cents{} from contracts a join contracts b on a.case_id = b.case_id and a.person = b.person and a.piece_id < b.piece_id"
    " and a.starts <= b.ends and b.starts <= a.ends where a.starts <= a.ends and b.starts <= b.ends"
)


def overlapping(c: DataFrame, *carry: str) -> DataFrame:
    """Pairs of contracts of one person whose periods share days, with the columns to carry along as `_a` and `_b`."""
    pairs = intervals.interval_self_join(c, ["case_id", "person"], "piece_id", "starts", "ends", ("cents", *carry))
    total = F.coalesce("cents_a", F.lit(0)) + F.coalesce("cents_b", F.lit(0))
    return pairs.select(
        "case_id", "person", F.col("piece_id_a").alias("piece_a"), F.col("piece_id_b").alias("piece_b"), "days", total.alias("cents"), *[f"{k}_{s}" for k in carry for s in "ab"]
    )


@CATALOGUE.add(f"with {_CONTRACTS} {OVERLAPS.format('')}")
def contract_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of one person whose periods share days."""
    return overlapping(_contracts(spark, folder))


@CATALOGUE.add(CATALOGUE.oracles["contract_overlap"] + " order by days desc, piece_a, piece_b limit 3")
def overlap_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest overlaps."""
    return contract_overlap(spark, folder).orderBy(F.desc("days"), "piece_a", "piece_b").limit(3)


@CATALOGUE.add(
    f"with {_CONTRACTS} select a.case_id, a.person, a.piece_id as id_a, b.piece_id as id_b, date_diff('day', a.ends, b.starts) as gap_days from contracts a join contracts b"
    " on a.case_id = b.case_id and a.person = b.person and a.piece_id <> b.piece_id and date_diff('day', a.ends, b.starts) between 0 and 31"
)
def chained_renewals(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of one person that follow each other within 31 days."""
    return intervals.follow_ups(_contracts(spark, folder), ["case_id", "person"], "piece_id", "starts", "ends")


@CATALOGUE.add(
    f"with {_CONTRACTS} select case_id, strong_key, count(*) as contracts, count(*) filter (where cents is null) as without_amount, coalesce(sum(cents), 0)::bigint as cents,"
    " min(starts) as first_start, max(ends) as last_end, string_agg(distinct nombre, '|' order by nombre) as names, min(lowest_confidence) as lowest_confidence"
    " from contracts where strong_key is not null group by all"
)
def spend_per_person(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts, amounts and names per person; no amounts count as nothing."""
    c = _contracts(spark, folder).where("strong_key is not null")
    return c.groupBy("case_id", "strong_key").agg(
        F.count("*").alias("contracts"), F.count(F.when(F.col("cents").isNull(), 1)).alias("without_amount"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.min("starts").alias("first_start"), F.max("ends").alias("last_end"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("nombre")), "|"), F.lit("")).alias("names"), F.min("lowest_confidence").alias("lowest_confidence"),
    )


@CATALOGUE.add(
    f"with {_CONTRACTS} select case_id, strong_key, sum(cents)::bigint as cents, count(distinct file_sha) as files from contracts where strong_key is not null group by all having count(distinct file_sha) > 1"
)
def persons_in_several_files(spark: SparkSession, folder: str) -> DataFrame:
    """Persons with contracts in more than one file; unknown amounts stay unknown."""
    c = _contracts(spark, folder).where("strong_key is not null")
    return c.groupBy("case_id", "strong_key").agg(F.sum("cents").alias("cents"), F.countDistinct("file_sha").alias("files")).where("files > 1")


@CATALOGUE.add(
    f"with {_ONCE} select field_name, count(*) as total, count(*) filter (where state = 'automatico_alta') as automatic, count(*) filter (where state in {_HUMAN}) as human,"
    f" count(*) filter (where state in {_FIRM}) as firm, count(*) filter (where state = 'pendiente_baja') as pending, count(*) filter (where state = 'conflicto') as conflict,"
    " count(*) filter (where literal is null) as without_value,"
    f" round(100.0 * count(*) filter (where state in {_FIRM}) / nullif(count(*), 0), 1)::double as firm_percent from once group by field_name"
)
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each field is read, firm, pending or missing."""
    f = views.distinct_facts(_fields(spark, folder))
    n = lambda c: F.count(F.when(c, 1))
    firm = n(F.col("state").isin(*FIRM_STATES))
    return f.groupBy("field_name").agg(
        F.count("*").alias("total"), n(F.col("state") == "automatico_alta").alias("automatic"), n(F.col("state").isin(*HUMAN_STATES)).alias("human"), firm.alias("firm"),
        n(F.col("state") == "pendiente_baja").alias("pending"), n(F.col("state") == "conflicto").alias("conflict"), n(F.col("literal").isNull()).alias("without_value"),
        F.round(F.try_divide(firm * 100.0, F.count("*").cast("double")), 1).alias("firm_percent"),
    )


_QUEUE = (
    f"with {_ONCE} select o.field_id, o.case_id, o.field_name, o.state, o.confidence, f.file_name,"
    " case o.state when 'conflicto' then 1 when 'pendiente_baja' then 2 when 'no_revisado' then 3 end as priority"
    " from once o left join (select sha256, min(file_name) as file_name from case_files group by sha256) f on f.sha256 = o.file_sha where o.state in ('conflicto','pendiente_baja','no_revisado')"
)


@CATALOGUE.add(_QUEUE)
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that wait for a person, with file and priority."""
    f = views.distinct_facts(_fields(spark, folder)).where(F.col("state").isin("conflicto", "pendiente_baja", "no_revisado"))
    names = table(spark, folder, "case_files", "sha256", "file_name").groupBy(F.col("sha256").alias("file_sha")).agg(F.min("file_name").alias("file_name"))
    priority = F.when(F.col("state") == "conflicto", 1).when(F.col("state") == "pendiente_baja", 2).otherwise(3)
    return f.join(names, "file_sha", "left").select("field_id", "case_id", "field_name", "state", "confidence", "file_name", priority.alias("priority"))


@CATALOGUE.add(_QUEUE + " order by priority, confidence nulls first, field_id limit 50 offset 50")
def review_queue_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of fifty of the queue, in a total order."""
    return page_of(review_queue(spark, folder), [F.col("priority"), F.col("confidence").asc_nulls_first(), F.col("field_id")], 50, 50)


@CATALOGUE.add(
    f"with {_ONCE}, q as (select * from once where state in ('conflicto','pendiente_baja','no_revisado')) select 'state' as facet, state as value, count(*) as n from q group by state"
    " union all select 'field_name', field_name, count(*) from q group by field_name union all select 'case_id', case_id, count(*) from q group by case_id"
)
def review_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Values and counts of each filter of the queue, in one pass over grouping sets."""
    f = views.distinct_facts(_fields(spark, folder)).where(F.col("state").isin("conflicto", "pendiente_baja", "no_revisado"))
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("state", "field_name", "case_id")]))
    return f.select(facets.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


REPEATED = (
    "select case_id, strong_key, starts, ends, cents, count(*) as n, count(distinct file_sha) as files, string_agg(piece_id, ',' order by piece_id) as pieces"
    " from contracts where strong_key is not null group by case_id, strong_key, starts, ends, cents having count(*) > 1"
)


def repeated(c: DataFrame) -> DataFrame:
    """Contracts of equal person, dates and amount (unknown amounts are equal)."""
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list("piece_id")), lambda x: x.cast("string")), ",")
    return c.where("strong_key is not null").groupBy("case_id", "strong_key", "starts", "ends", "cents").agg(
        F.count("*").alias("n"), F.countDistinct("file_sha").alias("files"), pieces.alias("pieces")
    ).where("n > 1")


@CATALOGUE.add(f"with {_CONTRACTS} {REPEATED}")
def repeated_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of equal person, dates and amount (unknown amounts are equal)."""
    return repeated(_contracts(spark, folder))


_LINES = (
    "lines as (select line_id, arg_max(case_id, loaded_at) as case_id, arg_max(struct_pack(a := supplier_tax_id), loaded_at).a as tax, arg_max(struct_pack(a := subtotal), loaded_at).a as subtotal,"
    " arg_max(struct_pack(a := stage), loaded_at).a as stage, arg_max(struct_pack(a := currency), loaded_at).a as currency, arg_max(struct_pack(a := state), loaded_at).a as state from price_lines group by line_id)"
)


@CATALOGUE.add(
    f"with {_CONTRACTS}, {_LINES}, c as (select case_id, strong_key, count(*) as contracts, sum(cents)::bigint as contracted from contracts where strong_key is not null group by all),"
    " v as (select case_id, 'DNI:' || regexp_extract(tax, '-([0-9]{8})-', 1) as strong_key, count(*) as vouchers, sum(cast(subtotal * 100 as bigint))::bigint as invoiced from lines"
    " where stage = 'factura' and tax like '29-%' group by 1, 2)"
    " select c.case_id, c.strong_key, c.contracts, c.contracted, coalesce(v.vouchers, 0) as vouchers, v.invoiced from c left join v on c.case_id = v.case_id and c.strong_key = v.strong_key"
)
def invoiced_vs_contracted(spark: SparkSession, folder: str) -> DataFrame:
    """Per person what was contracted and what was invoiced: both aggregated, then joined."""
    c = _contracts(spark, folder).where("strong_key is not null").groupBy("case_id", "strong_key").agg(F.count("*").alias("contracts"), F.sum("cents").alias("contracted"))
    lines = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "supplier_tax_id", "subtotal", "stage"))
    paid = lines.where((F.col("stage") == "factura") & F.col("supplier_tax_id").startswith("29-"))
    key = F.concat(F.lit("DNI:"), F.regexp_extract("supplier_tax_id", "-([0-9]{8})-", 1))
    v = paid.groupBy("case_id", key.alias("strong_key")).agg(F.count("*").alias("vouchers"), F.sum((F.col("subtotal") * 100).cast("bigint")).alias("invoiced"))
    return c.join(v, ["case_id", "strong_key"], "left").na.fill(0, ["vouchers"])


_LINE_CENTS = "cast(subtotal * 100 as bigint)"


@CATALOGUE.add(
    f"with {_CONTRACTS}, {_LINES}, c as (select coalesce(sum(cents), 0)::bigint as contracted_firm, count(cents) as contracts_with_firm_amount, count(*) - count(cents) as contracts_without_firm_amount from contracts),"
    f" m as (select coalesce(sum({_CENTS.format('trim(literal)')}) filter (where field_name = 'monto' and state = 'pendiente_baja'), 0)::bigint as contracted_provisional,"
    " count(*) filter (where field_name = 'monto' and state = 'pendiente_baja') as contracts_with_provisional_amount, count(*) filter (where field_name = 'monto' and state in ('conflicto', 'no_revisado')) as amounts_pending,"
    f" count(*) filter (where state in {_HUMAN}) as human_fields, count(*) filter (where state in ('pendiente_baja', 'conflicto', 'no_revisado')) as pending_fields from once),"
    f" v as (select coalesce(sum({_LINE_CENTS}) filter (where state in {_FIRM}), 0)::bigint as invoiced_firm, count(subtotal) filter (where state in {_FIRM}) as invoice_lines_with_firm_amount,"
    f" coalesce(sum({_LINE_CENTS}) filter (where coalesce(state not in {_FIRM}, true)), 0)::bigint as invoiced_provisional, count(*) filter (where subtotal is null) as invoice_lines_without_amount, count(*) as invoice_lines"
    " from lines where stage = 'factura'),"
    " p as (select count(*) as pages_without_family from case_pages where coalesce(page_class not in ('contrato_obra','contrato_personal','contrato_locacion','factura','recibo','remito','decreto','resolucion','rendicion'), true)),"
    " f as (select max(ingested_at) as last_load from case_files)"
    " select * from c cross join m cross join v cross join p cross join f"
)
def separated_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What was contracted and what was invoiced, firm and provisional, never added together, with all that has no amount.

    Each table is read once; the rows that are put side by side are single ones.
    """
    n = lambda c: F.count_if(c)
    c = _contracts(spark, folder).agg(
        F.coalesce(F.sum("cents"), F.lit(0)).alias("contracted_firm"), F.count("cents").alias("contracts_with_firm_amount"), (F.count("*") - F.count("cents")).alias("contracts_without_firm_amount")
    )
    amount, state = F.col("field_name") == "monto", F.col("state")
    low = amount & (state == "pendiente_baja")
    m = views.distinct_facts(_fields(spark, folder)).agg(
        F.coalesce(F.sum(F.when(low, amount_cents(F.col("literal")))), F.lit(0)).alias("contracted_provisional"), n(low).alias("contracts_with_provisional_amount"),
        n(amount & state.isin("conflicto", "no_revisado")).alias("amounts_pending"), n(state.isin(*HUMAN_STATES)).alias("human_fields"),
        n(state.isin("pendiente_baja", "conflicto", "no_revisado")).alias("pending_fields"),
    )
    lines = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "subtotal", "stage", "state")).where("stage = 'factura'")
    cents, firm = (F.col("subtotal") * 100).cast("bigint"), views.is_firm(state)
    v = lines.agg(
        F.coalesce(F.sum(F.when(firm, cents)), F.lit(0)).alias("invoiced_firm"), n(firm & F.col("subtotal").isNotNull()).alias("invoice_lines_with_firm_amount"),
        F.coalesce(F.sum(F.when(~firm, cents)), F.lit(0)).alias("invoiced_provisional"), n(F.col("subtotal").isNull()).alias("invoice_lines_without_amount"), F.count("*").alias("invoice_lines"),
    )
    p = table(spark, folder, "case_pages", "page_class").agg(n(views.family(F.col("page_class")).isNull()).alias("pages_without_family"))
    f = table(spark, folder, "case_files", "ingested_at").agg(F.max("ingested_at").alias("last_load"))
    return c.crossJoin(m).crossJoin(v).crossJoin(p).crossJoin(f)  # one row each


@CATALOGUE.add(
    f"with {_ONCE}, m as (select case_id, {_CENTS.format('trim(literal)')} as cents, piece_id from once where field_name = 'monto'), k as (select * from m where cents is not null),"
    " g as (select case_id, count(*) as n, quantile_cont(cents::double, 0.5) as median from k group by case_id having count(*) >= 5)"
    " select k.case_id, k.piece_id, k.cents, g.n, g.median from k join g on g.case_id = k.case_id where k.cents > g.median * 1.6"
)
def median_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts above 1.6 times the median of their case."""
    f = views.distinct_facts(_fields(spark, folder)).where("field_name = 'monto'").select("case_id", amount_cents(F.col("literal")).alias("cents"), "piece_id")
    return statistics.outliers_by_median(f, "case_id", "cents").select("case_id", "piece_id", "cents", "n", "median")


@CATALOGUE.add(f"with {_CONTRACTS} select case_id, starts, count(*) as n from contracts where starts is not null group by all having count(*) >= 2")
def grouped_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which at least two contracts of a case start."""
    c = _contracts(spark, folder).where("starts is not null")
    return c.groupBy("case_id", "starts").agg(F.count("*").alias("n")).where("n >= 2")


SAME_PAPER = (
    "select case_id, strong_key, starts, ends, count(*) as n, case when count(cents) < count(*) then 'unsure' when count(distinct cents) = 1 then 'same paper' else 'different' end as verdict"
    " from contracts where strong_key is not null and starts is not null and ends is not null group by all having count(*) > 1"
)


def same_paper(c: DataFrame) -> DataFrame:
    """Contracts of equal person and period: the same paper only if the amounts agree."""
    verdict = F.when(F.count("cents") < F.count(F.lit(1)), "unsure").when(F.countDistinct("cents") == 1, "same paper").otherwise("different")
    return c.where("strong_key is not null and starts is not null and ends is not null").groupBy("case_id", "strong_key", "starts", "ends").agg(
        F.count(F.lit(1)).alias("n"), verdict.alias("verdict")
    ).where("n > 1")


@CATALOGUE.add(f"with {_CONTRACTS} {SAME_PAPER}")
def same_paper_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of equal person and period: the same paper only if the amounts agree."""
    return same_paper(_contracts(spark, folder))


@CATALOGUE.add(
    f"with {_ONCE}, d as (select case_id, piece_id as paper, field_name as kind, {_DATE.format('literal')} as on_date, case when state in {_HUMAN} then 0 else 1 end as rank, field_id from once where field_name in ('fecha_inicio','fecha_fin') and state in {_FIRM}),"
    " e as (select * from d where on_date is not null qualify row_number() over (partition by case_id, paper, kind order by rank, field_id) = 1),"
    " l as (select line_id, arg_max(case_id, loaded_at) as case_id, arg_max(struct_pack(a := document_id), loaded_at).a as paper, arg_max(struct_pack(a := price_date), loaded_at).a as d, arg_max(struct_pack(a := stage), loaded_at).a as stage from price_lines group by line_id)"
    " select case_id, paper::varchar as paper, kind, on_date from e union all select case_id, doc_id::varchar, 'documento', doc_date::date from documents where doc_date is not null"
    " union all select distinct case_id, paper::varchar, 'precio ' || stage, d from l where d is not null and stage is not null and paper is not null"
    " union all select distinct p.case_id, p.page_id::varchar, 'lectura', r.created_at::date from readings r join case_pages p using (page_id) where r.created_at is not null"
    " union all select distinct case_id, sha256, 'ingreso', ingested_at::date from case_files where ingested_at is not null"
)
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Dated facts of every kind: contract dates (a person's before the machine's), papers, prices by stage, readings and loads."""
    d = views.distinct_facts(_fields(spark, folder)).where(F.col("field_name").isin("fecha_inicio", "fecha_fin") & views.is_firm(F.col("state")))
    dated = d.select("case_id", "piece_id", F.col("field_name").alias("kind"), day_month_year(F.col("literal")).alias("on_date"), "field_id", F.when(F.col("state").isin(*HUMAN_STATES), 0).otherwise(1).alias("rank")).where("on_date is not null")
    first = dated.groupBy("case_id", "piece_id", "kind").agg(F.min_by("on_date", F.struct("rank", "field_id")).alias("on_date"))
    row = lambda df, paper, kind, at: df.select("case_id", F.col(paper).cast("string").alias("paper"), kind.alias("kind"), F.col(at).cast("date").alias("on_date")).where("on_date is not null")
    lines = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "document_id", "price_date", "stage")).where("stage is not null and document_id is not null")
    read = table(spark, folder, "readings", "page_id", "created_at").join(table(spark, folder, "case_pages", "page_id", "case_id"), "page_id")
    parts = (
        row(table(spark, folder, "documents", "case_id", "doc_id", "doc_date"), "doc_id", F.lit("documento"), "doc_date"),
        row(lines, "document_id", F.concat(F.lit("precio "), "stage"), "price_date").distinct(), row(read, "page_id", F.lit("lectura"), "created_at").distinct(),
        row(table(spark, folder, "case_files", "case_id", "sha256", "ingested_at"), "sha256", F.lit("ingreso"), "ingested_at").distinct(),
    )
    out = row(first, "piece_id", F.col("kind"), "on_date")
    for p in parts:
        out = out.unionByName(p)
    return out


@CATALOGUE.add(
    f"with {_ONCE}, a as (select field_id, literal, {_CENTS.format('trim(literal)')} as cents from once where field_name = 'monto')"
    " select field_id, cents, case when literal is null or trim(literal) = '' then 'ausente' when cents is null then 'ambiguo' end as reason from a"
)
def amount_parser(spark: SparkSession, folder: str) -> DataFrame:
    """Cents of every amount, or why there are none."""
    from folioscope.functions.numbers import amount_reason

    f = views.distinct_facts(_fields(spark, folder)).where("field_name = 'monto'")
    return f.select("field_id", amount_cents(F.col("literal")).alias("cents"), amount_reason(F.col("literal")).alias("reason"))


@CATALOGUE.add(f"with {_ONCE} select field_id, {_DATE.format('literal')} as on_date from once where field_name like 'fecha%'")
def date_parser(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of every date field; impossible and short ones are null."""
    f = views.distinct_facts(_fields(spark, folder)).where("field_name like 'fecha%'")
    return f.select("field_id", day_month_year(F.col("literal")).alias("on_date"))
