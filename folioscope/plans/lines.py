"""Analyses over price lines: latest load, exact statistics, totals, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.identifiers import description_tokens, entity_key, labelled, number_tokens
from folioscope.functions.numbers import canonical_money, local_decimal
from folioscope.operators import relational, statistics, views
from folioscope.operators.decisions import stable_key
from folioscope.operators.intervals import within_days
from folioscope.operators.ordered import chain
from folioscope.plans.registry import Catalogue
from folioscope.schema import STAGES
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

_LATEST = "lines as (select * exclude (rn) from (select *, row_number() over (partition by line_id order by loaded_at desc) as rn from price_lines) where rn = 1)"


def _lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", *columns))


@CATALOGUE.add("select line_id, max(loaded_at) as loaded_at, count(*) as loads from price_lines group by line_id having count(*) > 1")
def reloaded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that were loaded more than once, with the last time."""
    p = table(spark, folder, "price_lines", "line_id", "loaded_at")
    return p.groupBy("line_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("loads")).where("loads > 1")


@CATALOGUE.add(f"with {_LATEST} select line_id, case_id, stage, state, loaded_at from lines")
def latest_load(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as it was loaded last."""
    return _lines(spark, folder, "case_id", "stage", "state").select("line_id", "case_id", "stage", "state", "loaded_at")


@CATALOGUE.add(
    f"with {_LATEST}, v as (select item_id, cast(unit_price * 10000 as bigint) as v, unit_price::double as d from lines where item_id is not null and unit_price is not null),"
    " r as (select item_id, v, d, row_number() over (partition by item_id order by v) - 1 as r, count(*) over (partition by item_id) as n from v),"
    " q as (select item_id, n, min(d) as lo, max(d) as hi, sum(v)::bigint as s, stddev_samp(d) as sd,"
    + ",".join(
        f" sum(v * case when r = (n - 1) * {k} // 4 then 4 - (n - 1) * {k} % 4 when r = (n - 1) * {k} // 4 + 1 then (n - 1) * {k} % 4 else 0 end)::bigint as q{k}" for k in (1, 2, 3)
    )
    + " from r group by item_id, n)"
    " select item_id, n, lo as lowest, hi as highest, ((2 * s + 100 * n) // (200 * n)) / 100.0 as mean, ((2 * q2 + 400) // 800) / 100.0 as median,"
    " round(sd, 2) as sd, ((2 * (q3 - q1) + 400) // 800) / 100.0 as iqr from q"
)
def price_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Exact statistics of unit prices per assigned item."""
    p = _lines(spark, folder, "item_id", "unit_price").where("item_id is not null")
    return statistics.exact_statistics(p, ["item_id"], "unit_price")


@CATALOGUE.add(
    f"with {_LATEST} select coalesce(stage, '') as stage, currency, state in ('automatico_alta','verificado','corregido') as firm, count(*) as n, count(subtotal) as with_value,"
    " sum(cast(subtotal * 100 as bigint))::bigint as cents, min(price_date) as first_date, max(price_date) as last_date from lines group by all"
)
def money_by_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Exact sums by stage, currency and firmness, with completeness; currencies never mix."""
    p = _lines(spark, folder, "stage", "currency", "state", "subtotal", "price_date")
    return p.groupBy(F.coalesce("stage", F.lit("")).alias("stage"), "currency", views.is_firm(F.col("state")).alias("firm")).agg(
        F.count("*").alias("n"), F.count("subtotal").alias("with_value"), F.sum((F.col("subtotal") * 100).cast("bigint")).alias("cents"),
        F.min("price_date").alias("first_date"), F.max("price_date").alias("last_date"),
    )


@CATALOGUE.add(
    f"with {_LATEST} select case_id, document_id, case when count(*) = count(subtotal) and count(distinct currency) = 1 then sum(cast(subtotal * 100 as bigint)) end::bigint as cents from lines group by case_id, document_id"
)
def document_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Total of each document; unknown if a part is missing or currencies differ."""
    p = _lines(spark, folder, "case_id", "document_id", "subtotal", "currency")
    return p.groupBy("case_id", "document_id").agg(statistics.complete_total((F.col("subtotal") * 100).cast("bigint"), F.col("currency")).alias("cents"))


@CATALOGUE.add(
    f"with {_LATEST} select line_id from lines where quantity is not null and unit_price is not null and subtotal is not null and round(cast(quantity as decimal(18,4)) * unit_price, 2) <> round(subtotal, 2)"
)
def subtotal_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose quantity times price isn't their subtotal, at two decimals."""
    p = _lines(spark, folder, "quantity", "unit_price", "subtotal")
    return p.where(F.round(F.col("quantity") * F.col("unit_price"), 2) != F.round("subtotal", 2)).select("line_id")


@CATALOGUE.add(
    f"with {_LATEST}, o as (select case_id, procurement_id, unit_price, line_id, row_number() over (partition by case_id, procurement_id order by unit_price, line_id) as r from lines"
    " where stage = 'oferta' and unit_price is not null and procurement_id is not null) select case_id, procurement_id, line_id, unit_price::double as unit_price from o where r = 2"
)
def second_best_offer(spark: SparkSession, folder: str) -> DataFrame:
    """The second cheapest offered line of each procedure."""
    p = _lines(spark, folder, "case_id", "procurement_id", "stage", "unit_price").where("stage = 'oferta' and unit_price is not null and procurement_id is not null")
    w = W.partitionBy("case_id", "procurement_id").orderBy("unit_price", "line_id")
    return p.withColumn("r", F.row_number().over(w)).where("r = 2").select("case_id", "procurement_id", "line_id", F.col("unit_price").cast("double").alias("unit_price"))


@CATALOGUE.add(
    f"with {_LATEST}, t as (select distinct case_id, procurement_id from lines where procurement_id is not null), s as (select unnest([{', '.join(repr(s) for s in STAGES)}]) as stage)"
    " select case_id, s.stage, count(*) as procedures from t cross join s where not exists (select 1 from lines l where l.case_id = t.case_id and l.procurement_id = t.procurement_id and l.stage = s.stage) group by all"
)
def missing_stages(spark: SparkSession, folder: str) -> DataFrame:
    """How many procedures of a case lack each stage."""
    p = _lines(spark, folder, "case_id", "procurement_id", "stage").where("procurement_id is not null").withColumn("key", F.struct("case_id", "procurement_id"))
    gaps = relational.absent_pairs(p, list(STAGES), p.where("stage is not null"), "key", "stage")
    return gaps.groupBy(F.col("key.case_id").alias("case_id"), "stage").agg(F.count("*").alias("procedures"))


_ONLY_PRICE = (
    "(select case_id, procurement_id, item_id, case when count(distinct unit_price) = 1 then min(unit_price) end as reference, count(distinct unit_price) as n from lines"
    " where stage = '{}' and item_id is not null and procurement_id is not null group by all)"
)


@CATALOGUE.add(
    f"with {_LATEST}, o as {_ONLY_PRICE.format('orden_compra')}, a as {_ONLY_PRICE.format('adjudicacion')}"
    " select l.line_id, l.case_id, (case when o.n > 0 then o.reference else a.reference end)::double as ordered_price, l.unit_price::double as invoiced_price from lines l"
    " left join o using (case_id, procurement_id, item_id) left join a using (case_id, procurement_id, item_id) where l.stage = 'factura' and l.item_id is not null"
)
def invoice_against_order(spark: SparkSession, folder: str) -> DataFrame:
    """Invoiced lines with the only order price of their item and procedure, without any order the only award price; ambiguous stays null."""
    keys = ["case_id", "procurement_id", "item_id"]
    p = _lines(spark, folder, *keys, "stage", "unit_price").where("item_id is not null")
    prices = lambda stage: F.collect_set(F.when(F.col("stage") == stage, F.col("unit_price")))
    told = p.where(F.col("stage").isin("orden_compra", "adjudicacion") & F.col("procurement_id").isNotNull()).groupBy(*keys).agg(prices("orden_compra").alias("o"), prices("adjudicacion").alias("a"))
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    reference = told.select(*keys, F.when(F.size("o") > 0, only("o")).otherwise(only("a")).alias("reference"))
    joined = p.where("stage = 'factura'").join(reference, keys, "left")
    return joined.select("line_id", "case_id", F.col("reference").cast("double").alias("ordered_price"), F.col("unit_price").cast("double").alias("invoiced_price"))


@CATALOGUE.add(
    f"with {_LATEST}, s as (select case_id, procurement_id, stage, min(price_date) as d from lines where procurement_id is not null and price_date is not null and stage in ('factura','orden_compra') group by all)"
    " select i.case_id, i.procurement_id, i.d as invoiced, o.d as ordered from s i join s o on i.case_id = o.case_id and i.procurement_id = o.procurement_id where i.stage = 'factura' and o.stage = 'orden_compra' and i.d < o.d"
)
def invoice_before_order(spark: SparkSession, folder: str) -> DataFrame:
    """Procedures whose first invoice is older than their first order."""
    p = _lines(spark, folder, "case_id", "procurement_id", "stage", "price_date").where("procurement_id is not null and price_date is not null")
    firsts = p.where(F.col("stage").isin("factura", "orden_compra")).groupBy("case_id", "procurement_id").agg(
        F.min(F.when(F.col("stage") == "factura", F.col("price_date"))).alias("invoiced"), F.min(F.when(F.col("stage") == "orden_compra", F.col("price_date"))).alias("ordered")
    )
    return firsts.where("invoiced < ordered")


def same_prices(lines: DataFrame) -> DataFrame:
    """case_id, doc_a, doc_b of the papers of a case (document_id) with the same sorted prices (unit_price)."""
    s = lines.where("unit_price is not null").groupBy("case_id", "document_id").agg(F.sort_array(F.collect_list("unit_price")).alias("signature"))
    b = s.withColumnRenamed("document_id", "doc_b")
    return s.join(b, ["case_id", "signature"]).where(F.col("document_id") < F.col("doc_b")).select("case_id", F.col("document_id").alias("doc_a"), "doc_b")


@CATALOGUE.add(
    f"with {_LATEST} select a.case_id, a.document_id as doc_a, b.document_id as doc_b from (select distinct case_id, document_id, signature from (select case_id, document_id, string_agg(unit_price::varchar, ';' order by unit_price) as signature"
    " from lines where stage = 'oferta' and unit_price is not null group by case_id, document_id)) a join (select case_id, document_id, string_agg(unit_price::varchar, ';' order by unit_price) as signature from lines where stage = 'oferta' and unit_price is not null group by case_id, document_id) b"
    " on a.case_id = b.case_id and a.signature = b.signature and a.document_id < b.document_id"
)
def identical_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of a case with the same sorted prices."""
    return same_prices(_lines(spark, folder, "case_id", "document_id", "stage", "unit_price").where("stage = 'oferta'"))


@CATALOGUE.add(
    f"with {_LATEST}, e as (select distinct case_id, item_id, document_id from lines where item_id is not null)"
    " select case_id, item_id, document_id, next from (select case_id, item_id, document_id, lead(document_id) over (partition by case_id, item_id order by document_id) as next from e) where next is not null"
)
def document_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a case with the same item, each linked to the next."""
    p = _lines(spark, folder, "case_id", "item_id", "document_id").where("item_id is not null").withColumn("key", F.struct("case_id", "item_id"))
    return chain(p, "key", "document_id").select("key.case_id", "key.item_id", "document_id", "next")


@CATALOGUE.add(
    f"with {_LATEST} select line_id, list_sort(list_filter(list_distinct(conditions || ['flete']), lambda c: (list_contains(conditions, c)::int + (c = 'flete')::int) = 1)) as differs,"
    " list_contains(conditions, 'garantia') as has_warranty, len(conditions) as n from lines where conditions is not null"
)
def condition_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Symmetric difference of each line's conditions to freight only."""
    p = _lines(spark, folder, "conditions").where("conditions is not null")
    return p.select(
        "line_id", relational.symmetric_difference(F.col("conditions"), F.array(F.lit("flete"))).alias("differs"),
        F.array_contains("conditions", "garantia").alias("has_warranty"), F.size("conditions").alias("n"),
    )


@CATALOGUE.add(f"with {_LATEST} select c as condition, vat, count(*) as n from (select unnest(conditions) as c, vat from lines) group by all")
def condition_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by condition and tax treatment: arrays to rows."""
    p = _lines(spark, folder, "conditions", "vat")
    return p.select(F.explode("conditions").alias("condition"), "vat").groupBy("condition", "vat").agg(F.count("*").alias("n"))


@CATALOGUE.add(
    f"with {_LATEST} select case_id, document_id, list(page_no || '/' || row_no || '/' || line_id order by page_no, row_no, line_id) as sources from lines where state = 'verificado' group by case_id, document_id"
)
def document_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the places (page/row/line) of its verified lines, in order."""
    p = _lines(spark, folder, "case_id", "document_id", "page_no", "row_no", "state").where("state = 'verificado'")
    src = F.struct(F.col("page_no").alias("page"), F.col("row_no").alias("row"), F.col("line_id").alias("line"))
    return p.groupBy("case_id", "document_id").agg(
        F.transform(F.array_sort(F.collect_list(src)), lambda x: F.concat_ws("/", *[x[c].cast("string") for c in ("page", "row", "line")])).alias("sources")
    )


@CATALOGUE.add(
    f"with {_LATEST}, d as (select distinct case_id, file_sha from lines union select distinct case_id, file_sha from piece_fields) select case_id, count(*) as files from d where file_sha is not null group by case_id"
)
def files_with_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a case named by a line or a fact: union of two sets."""
    a = table(spark, folder, "price_lines", "case_id", "file_sha")
    b = table(spark, folder, "piece_fields", "case_id", "file_sha")
    return a.union(b).distinct().where("file_sha is not null").groupBy("case_id").agg(F.count("*").alias("files"))


@CATALOGUE.add(
    f"with {_LATEST}, s as (select case_id, coalesce('CUIT:' || max(supplier_tax_id), 'N:' || supplier_name) as key, supplier_name as name, 'supplier' as kind from lines where supplier_name is not null group by case_id, supplier_name),"
    " p as (select case_id, coalesce(strong_key, 'P:' || person_id) as key, min(name_literal) as name, 'person' as kind from person_aliases group by case_id, coalesce(strong_key, 'P:' || person_id))"
    " select * from s union all select * from p where not exists (select 1 from s where s.case_id = p.case_id and s.name = p.name)"
)
def party_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and persons of a case in one list, persons of the same name left out."""
    lines = _lines(spark, folder, "case_id", "supplier_name", "supplier_tax_id").where("supplier_name is not null")
    s = lines.groupBy("case_id", F.col("supplier_name").alias("name")).agg(F.max("supplier_tax_id").alias("tax"))
    s = s.select("case_id", F.coalesce(F.concat(F.lit("CUIT:"), "tax"), F.concat(F.lit("N:"), "name")).alias("key"), "name", F.lit("supplier").alias("kind"))
    a = table(spark, folder, "person_aliases", "case_id", "strong_key", "person_id", "name_literal")
    key = F.coalesce("strong_key", F.concat(F.lit("P:"), F.col("person_id").cast("string")))
    p = a.groupBy("case_id", key.alias("key")).agg(F.min("name_literal").alias("name")).withColumn("kind", F.lit("person"))
    return s.unionByName(p.join(s, ["case_id", "name"], "left_anti"))


@CATALOGUE.add(
    f"with {_LATEST}, p as (select case_id, supplier_tax_id as tax, price_date, line_id from lines where supplier_tax_id is not null and price_date is not null and case_id is not null)"
    " select p.line_id, max(o.price_date) as previous_date from p asof left join (select case_id, tax, price_date from p) o on p.case_id = o.case_id and p.tax = o.tax and p.price_date > o.price_date group by p.line_id"
)
def previous_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """The last earlier date on which the line's supplier sold anything in the case.

    Only the distinct dates of a supplier are put in order; lines look theirs up by an equi-join.
    """
    keys = ["case_id", "supplier_tax_id", "price_date"]
    p = _lines(spark, folder, *keys).where("case_id is not null and supplier_tax_id is not null and price_date is not null")
    days = p.select(*keys).distinct().withColumn("previous_date", F.lag("price_date").over(W.partitionBy(*keys[:2]).orderBy("price_date")))
    return p.join(days, keys).select("line_id", "previous_date")


@CATALOGUE.add(
    f"with {_LATEST}, a as (select distinct case_id, price_date from lines where stage = 'adjudicacion' and price_date is not null), m as (select case_id, doc_id, doc_date::date as d from documents where source = 'acta' and doc_date is not null)"
    " select m.case_id, m.doc_id, a.price_date, abs(date_diff('day', a.price_date, m.d)) as apart from m join a on a.case_id = m.case_id and abs(date_diff('day', a.price_date, m.d)) <= 20"
)
def minutes_near_awards(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes within twenty days of an award of their case."""
    a = _lines(spark, folder, "case_id", "stage", "price_date").where("stage = 'adjudicacion' and price_date is not null").select("case_id", "price_date").distinct()
    m = table(spark, folder, "documents", "case_id", "doc_id", "source", "doc_date").where("source = 'acta' and doc_date is not null")
    m = m.select("case_id", "doc_id", F.col("doc_date").cast("date").alias("d"))
    near = within_days(m, a, ["case_id"], "d", "price_date", 20)
    return near.select("case_id", "doc_id", "price_date", F.abs(F.datediff("price_date", "d")).alias("apart"))


@CATALOGUE.add(
    f"with {_LATEST} select line_id, case when subtotal is not null and quantity > 0 then round(subtotal::double / quantity::double, 4) end as derived_price from lines where unit_price is null"
)
def derived_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Unit prices that only follow from subtotal and quantity."""
    p = _lines(spark, folder, "unit_price", "subtotal", "quantity").where("unit_price is null")
    price = F.when(F.col("subtotal").isNotNull() & (F.col("quantity") > 0), F.round(F.try_divide(F.col("subtotal").cast("double"), F.col("quantity").cast("double")), 4))
    return p.select("line_id", price.alias("derived_price"))


@CATALOGUE.add(
    f"with {_LATEST} select line_id, case when regexp_matches(trim(quantity_literal), '^([0-9]{{1,3}}(\\.[0-9]{{3}})+|[0-9]+)(,([0-9]{{1,2}}|[0-9]{{4,8}}))?$')"
    " then replace(replace(trim(quantity_literal), '.', ''), ',', '.')::double end as quantity from lines where quantity_literal is not null"
)
def decimal_parser(spark: SparkSession, folder: str) -> DataFrame:
    """Local numbers among the quantities; unclear ones are null."""
    p = _lines(spark, folder, "quantity_literal").where("quantity_literal is not null")
    return p.select("line_id", local_decimal(F.col("quantity_literal")).cast("double").alias("quantity"))


@CATALOGUE.add(
    f"with {_LATEST} select line_id, regexp_replace(unit_price::decimal(30,8)::varchar, '(\\.[0-9]{{2}}[0-9]*?)0+$', '\\1') as money from lines where unit_price is not null"
)
def canonical_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Unit prices as canonical text."""
    return _lines(spark, folder, "unit_price").where("unit_price is not null").select("line_id", canonical_money(F.col("unit_price")).alias("money"))


@CATALOGUE.add(
    f"with {_LATEST} select line_id, sha256(coalesce(case_id, chr(0)) || chr(31) || coalesce(document_id::varchar, chr(0)) || chr(31) || coalesce(description, chr(0))) as key from lines"
)
def line_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A stable key for each line over its case, document and description."""
    p = _lines(spark, folder, "case_id", "document_id", "description")
    return p.select("line_id", stable_key(F.col("case_id"), F.col("document_id"), F.col("description")).alias("key"))


_FOLD = "trim(regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy'), '\\s+', ' ', 'g'))"


@CATALOGUE.add(
    f"with {_LATEST} select line_id, nullif(trim(regexp_extract({_FOLD.format('description')}, 'marca:\\s*([a-z0-9 ./-]*[a-z0-9])', 1)), '') as brand,"
    f" list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace({_FOLD.format('description')}, '([0-9]),([0-9])', '\\1.\\2', 'g'), '[a-z0-9./]+'), lambda w: regexp_matches(w, '[0-9]')))) as numbers"
    " from lines where description is not null"
)
def description_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Brand and number tokens of each description."""
    p = _lines(spark, folder, "description").where("description is not null")
    return p.select("line_id", labelled(F.col("description"), "marca").alias("brand"), number_tokens(F.col("description")).alias("numbers"))


@CATALOGUE.add(
    f"with {_LATEST}, w as (select line_id, unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace({_FOLD.format('description')}, '([0-9]),([0-9])', '\\1.\\2', 'g'), '[a-z0-9./]+'),"
    " lambda x: x not in ('de','del','la','las','el','los','y','e','o','u','con','sin','para','por','a','al','en','x','.')))) as word from lines where description is not null)"
    " select word, count(*) as n from w group by word having count(*) >= 2"
)
def anchor_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stand in at least two descriptions."""
    p = _lines(spark, folder, "description").where("description is not null")
    words = p.select(F.explode(F.array_distinct(description_tokens(F.col("description")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@CATALOGUE.add(
    f"with {_LATEST} select case_id, trim(regexp_replace(replace(translate(lower(translate(supplier_name, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY')), '', ''), '.', ''), '[^a-z0-9]+', ' ', 'g')) as name_key,"
    " count(distinct supplier_name) as spellings, count(*) as n from lines where supplier_name is not null group by 1, 2"
)
def supplier_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of a case by normal form, with the number of spellings."""
    p = _lines(spark, folder, "case_id", "supplier_name").where("supplier_name is not null")
    return p.groupBy("case_id", entity_key(F.col("supplier_name")).alias("name_key")).agg(F.countDistinct("supplier_name").alias("spellings"), F.count("*").alias("n"))


@CATALOGUE.add(
    f"with {_LATEST}, p as (select case_id, document_id, min(price_date) as d from lines where price_date is not null group by all), w as (select case_id, document_id, d, lag(d) over (partition by case_id order by document_id) as previous from p)"
    " select * from w where d < previous"
)
def out_of_order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dated before the document that stands before them in the case."""
    p = _lines(spark, folder, "case_id", "document_id", "price_date").where("price_date is not null")
    d = p.groupBy("case_id", "document_id").agg(F.min("price_date").alias("d"))
    return d.withColumn("previous", F.lag("d").over(W.partitionBy("case_id").orderBy("document_id"))).where("d < previous")


@CATALOGUE.add(
    f"with {_LATEST} select stage, vat, count(*) as n, sum(cast(subtotal * 100 as bigint))::bigint as cents, grouping(stage)::int * 2 + grouping(vat)::int as level from lines group by cube (stage, vat)"
)
def stage_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sums over every combination of stage and tax treatment."""
    p = _lines(spark, folder, "stage", "vat", "subtotal")
    return p.cube("stage", "vat").agg(F.count("*").alias("n"), F.sum((F.col("subtotal") * 100).cast("bigint")).alias("cents"), F.grouping_id("stage", "vat").cast("int").alias("level"))
