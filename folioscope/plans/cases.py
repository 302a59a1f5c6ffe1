"""Queries over literal papers, for what the tables lack (chambers, roles, overlaps), and filters, findings and folios."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.identifiers import CASE_NUMBER, FIRM, FOLIO, TAX_ID, VOUCHER, compare_key, description_tokens, entities
from folioscope.functions.numbers import TAX_WEIGHTS, digits
from folioscope.functions.text import fold, py_fold
from folioscope.operators import consensus, folios, identity, intervals, relational, search, statistics, views
from folioscope.plans import facts
from folioscope.plans.lines import _FOLD, _LATEST
from folioscope.plans.registry import Catalogue
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

_D = datetime.date
#: Contracts of a made-up case: overlapping, following each other, repeated, with impossible dates, in two chambers.
CONTRACTS = [
    ("c1", 1, "f1", "DNI:1", "senado", "asesor", _D(2020, 1, 1), _D(2020, 6, 30), 1000_00, 0.95),
    ("c1", 2, "f2", "DNI:1", "diputados", "asesor", _D(2020, 6, 1), _D(2020, 12, 31), 2000_00, 0.9),
    ("c1", 3, "f2", "DNI:1", "senado", "chofer", _D(2020, 6, 30), _D(2021, 1, 31), None, 0.85),
    ("c1", 4, "f3", "DNI:1", "senado", "asesor", _D(2021, 1, 15), _D(2021, 3, 31), 500_00, 0.99),
    ("c1", 5, "f4", "DNI:2", "senado", "asesor", _D(2020, 1, 1), _D(2020, 3, 31), 700_00, 0.99),
    ("c1", 6, "f5", "DNI:2", "senado", "asesor", _D(2020, 1, 1), _D(2020, 3, 31), 700_00, 0.99),
    ("c1", 7, "f5", "DNI:2", "senado", "asesor", _D(2020, 4, 1), _D(2020, 4, 30), 300_00, 0.99),
    ("c1", 8, "f6", "DNI:2", "senado", None, _D(2020, 4, 20), _D(2020, 5, 30), 300_00, 0.99),
    ("c1", 9, "f6", "DNI:3", "diputados", "asesor", _D(2022, 5, 1), _D(2022, 4, 1), 100_00, 0.9),
    ("c1", 10, "f6", "DNI:3", "diputados", "asesor", _D(1970, 5, 1), _D(1971, 4, 1), 100_00, 0.9),
    ("c1", 11, "f6", "DNI:3", "diputados", "asesor", _D(2020, 5, 1), _D(2030, 4, 1), 100_00, 0.9),
    ("c1", 12, "f6", "DNI:3", "diputados", "asesor", _D(2005, 1, 1), _D(2016, 1, 1), None, 0.9),
    ("c1", 13, "f7", "DNI:4", "senado", "asesor", _D(2020, 1, 1), _D(2020, 2, 1), None, 0.9),
    ("c1", 14, "f8", "DNI:4", "senado", "asesor", _D(2020, 1, 1), _D(2020, 2, 1), None, 0.9),
    ("c1", 15, "f8", None, "senado", "asesor", _D(2020, 1, 1), _D(2020, 2, 1), 50_00, 0.9),
    ("c2", 16, "f9", "DNI:1", "senado", "asesor", _D(2020, 1, 1), _D(2020, 12, 31), 900_00, 0.9),
    ("c2", 17, "f9", "DNI:1", "senado", "asesor", None, _D(2020, 12, 31), 900_00, 0.9),
]
_NAMES = ("case_id", "piece_id", "file_sha", "strong_key", "chamber", "role", "starts", "ends", "cents", "lowest_confidence")
_SCHEMA = "case_id string, piece_id bigint, file_sha string, strong_key string, chamber string, role string, starts date, ends date, cents bigint, lowest_confidence double"


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, (str, datetime.date)):
        return f"'{value}'"
    return str(value)


def _values(name: str, columns: tuple[str, ...], rows: list[tuple], kinds: dict[str, str]) -> str:
    """The rows as a common table expression."""
    typed = ", ".join(f"{c}::{kinds[c]} as {c}" if c in kinds else c for c in columns)
    return f"{name} as (select {typed} from (values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) as v({', '.join(columns)}))"


_TABLE = _values("papers", _NAMES, CONTRACTS, {"starts": "date", "ends": "date", "cents": "bigint", "piece_id": "bigint", "lowest_confidence": "double"})
_PERSON = "coalesce(strong_key, 'doc:#' || file_sha || '#' || piece_id)"
_WITH = f"with {_TABLE}, contracts as (select *, {_PERSON} as person from papers)"


def _papers(spark: SparkSession) -> DataFrame:
    c = spark.createDataFrame(CONTRACTS, _SCHEMA)
    alone = F.concat(F.lit("doc:#"), "file_sha", F.lit("#"), F.col("piece_id").cast("string"))
    return c.withColumn("person", F.coalesce("strong_key", alone))


@CATALOGUE.add(
    f"{_WITH} {facts.OVERLAPS.format(''', case when a.chamber = b.chamber then 'same chamber' else 'different chambers' end as crossing, least(a.lowest_confidence, b.lowest_confidence) as lowest_confidence''')}"
)
def case_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping contracts of one person, within a chamber or between two; unknown amounts add nothing."""
    pairs = facts.overlapping(_papers(spark), "chamber", "lowest_confidence")
    crossing = F.when(F.col("chamber_a") == F.col("chamber_b"), "same chamber").otherwise("different chambers")
    return pairs.select("case_id", "person", "piece_a", "piece_b", "days", "cents", crossing.alias("crossing"), F.least("lowest_confidence_a", "lowest_confidence_b").alias("lowest_confidence"))


@CATALOGUE.add(f"{_WITH} {facts.OVERLAPS.format('')} order by days desc, piece_a, piece_b limit 3")
def case_overlap_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest overlaps of the literal papers."""
    return facts.overlapping(_papers(spark)).orderBy(F.desc("days"), "piece_a", "piece_b").limit(3)


@CATALOGUE.add(
    f"{_WITH} select a.case_id, a.person, a.role, a.piece_id as id_a, b.piece_id as id_b, date_diff('day', a.ends, b.starts) as gap_days from contracts a join contracts b"
    " on a.case_id = b.case_id and a.person = b.person and a.role = b.role and a.piece_id <> b.piece_id and date_diff('day', a.ends, b.starts) between 0 and 31"
)
def case_renewals(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of one person in one role that follow each other within 31 days."""
    return intervals.follow_ups(_papers(spark), ["case_id", "person", "role"], "piece_id", "starts", "ends")


@CATALOGUE.add(f"{_WITH} {facts.IMPOSSIBLE}")
def case_impossible_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The first reason for which the dates of a literal contract can't be."""
    return facts.impossible(_papers(spark))


@CATALOGUE.add(f"{_WITH} {facts.REPEATED}")
def case_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Literal contracts of equal person, dates and amount."""
    return facts.repeated(_papers(spark))


@CATALOGUE.add(f"{_WITH} {facts.SAME_PAPER}")
def case_same_paper(spark: SparkSession, folder: str) -> DataFrame:
    """Literal contracts of equal person and period, by whether their amounts agree."""
    return facts.same_paper(_papers(spark))


@CATALOGUE.add(
    f"{_WITH} select case_id, strong_key, coalesce(sum(cents) filter (where chamber = 'senado'), 0)::bigint as senado, coalesce(sum(cents) filter (where chamber = 'diputados'), 0)::bigint as diputados, count(*) as contracts"
    " from contracts where strong_key is not null group by all having count(*) filter (where chamber = 'senado') > 0 and count(*) filter (where chamber = 'diputados') > 0"
)
def case_both_chambers(spark: SparkSession, folder: str) -> DataFrame:
    """Persons with contracts in both chambers, with the amounts of each."""
    in_chamber = lambda c: F.col("chamber") == c
    amount = lambda c: F.coalesce(F.sum(F.when(in_chamber(c), F.col("cents"))), F.lit(0)).alias(c)
    g = _papers(spark).where("strong_key is not null").groupBy("case_id", "strong_key").agg(
        amount("senado"), amount("diputados"), F.count("*").alias("contracts"), F.count_if(in_chamber("senado")).alias("s"), F.count_if(in_chamber("diputados")).alias("d")
    )
    return g.where("s > 0 and d > 0").drop("s", "d")


#: Offers of a made-up procedure, line by line, with the total that the paper prints.
OFFERS = [
    ("c1", 1, 1, "10.00", "100.00", "350.00"), ("c1", 1, 2, "25.00", "250.00", "350.00"), ("c1", 2, 1, "25.00", "250.00", "360.00"), ("c1", 2, 2, "10.00", "100.00", "360.00"),
    ("c1", 3, 1, "10.00", "100.00", None), ("c1", 4, 1, "3.00", "33.335", "33.34"), ("c2", 5, 1, "10.00", "100.00", "100.00"), ("c1", 6, 1, "10.00", None, "5.00"),
]
_OFFERS = _values("offers", ("case_id", "document_id", "row_no", "unit_price", "subtotal", "printed"), OFFERS, {"document_id": "bigint", "unit_price": "decimal(18,4)", "subtotal": "decimal(18,4)", "printed": "decimal(18,2)"})


def _offers(spark: SparkSession) -> DataFrame:
    money = lambda v: None if v is None else Decimal(v)
    rows = [(c, d, r, money(p), money(s), money(t)) for c, d, r, p, s, t in OFFERS]
    return spark.createDataFrame(rows, "case_id string, document_id bigint, row_no int, unit_price decimal(18,4), subtotal decimal(18,4), printed decimal(18,2)")


@CATALOGUE.add(
    f"with {_OFFERS}, s as (select case_id, document_id, string_agg(unit_price::varchar, ';' order by unit_price) as signature from offers where unit_price is not null group by all)"
    " select a.case_id, a.document_id as doc_a, b.document_id as doc_b from s a join s b on a.case_id = b.case_id and a.signature = b.signature and a.document_id < b.document_id"
)
def case_identical_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Literal offers of a case with the same sorted prices."""
    from folioscope.plans.lines import same_prices

    return same_prices(_offers(spark))


@CATALOGUE.add(
    f"with {_OFFERS} select case_id, document_id, round(sum(subtotal), 2)::double as summed, max(printed)::double as printed from offers group by all"
    " having max(printed) is not null and count(subtotal) = count(*) and round(sum(subtotal), 2) <> round(max(printed), 2)"
)
def case_printed_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Papers whose lines don't add up to the printed total, at two decimals; with a missing line nothing is said."""
    return statistics.sums_against_totals(_offers(spark), ["case_id", "document_id"], "subtotal", "printed")


#: Mentions of made-up persons.
MENTIONS = [("c1", "Ana Paz", "DNI:1"), ("c1", "PAZ  ANA", "DNI:9"), ("c1", "ana páz", "DNI:2"), ("c2", "Ana Paz", "DNI:3"), ("c1", "Luis Sol", "DNI:4"), ("c1", "Luis Sol", None)]
_KEY = "trim(regexp_replace(upper(translate(name_literal, 'áéíóúüñ', 'aeiouun')), '[^A-Z0-9]+', ' ', 'g'))"


@CATALOGUE.add(
    f"with {_values('m', ('case_id', 'name_literal', 'strong_key'), MENTIONS, {})} select case_id, {_KEY} as name_key, count(distinct strong_key) as keys, string_agg(distinct strong_key, '|' order by strong_key) as strong_keys"
    " from m where strong_key is not null group by 1, 2 having count(distinct strong_key) > 1"
)
def case_homonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Literal mentions of equal names with different strong keys."""
    return identity.same_name_other_key(spark.createDataFrame(MENTIONS, "case_id string, name_literal string, strong_key string"))


#: Sentences with a number in words and in digits.
SENTENCES = [(1, "la suma de pesos mil doscientos ($ 1.200,00) por mes"), (2, "pesos dos mil con 50/100 ($ 2.000,05)"), (3, "por el término de 3 (tres) meses"), (4, "sin números")]


@CATALOGUE.add("select * from (values (1, 'money', true), (2, 'money', false), (3, 'count', true)) as v(id, kind, match)")
def case_numbers_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the numbers that literal sentences write twice agree."""
    return consensus.numbers_written_twice(spark.createDataFrame(SENTENCES, "i int, t string"), "i", "t").select("id", "kind", "match")


#: Words of a page with a small table: three rows of three columns, then running text.
CELLS = [[(60, "Cantidad"), (200, "Detalle"), (400, "Precio")], [(60, "2"), (200, "Sillas"), (400, "10,00")], [(60, "3"), (200, "Mesas"), (400, "25,00")], [(60, "4"), (200, "Lámparas"), (400, "7,50")]]


@CATALOGUE.add(f"select * from (values {', '.join(f'({r}, {c}, {w!r})' for r, line in enumerate(CELLS, 1) for c, (_, w) in enumerate(line, 1))}) as v(row_no, column_no, text)")
def case_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of a literal table."""
    from folioscope.operators.pages import find_tables, lined_words

    rows = [(1, n, x + 0.0, 100.0 + 14 * r, x + 40.0, 110.0 + 14 * r, w) for r, line in enumerate(CELLS) for n, (x, w) in enumerate(line, 10 * r)]
    words = spark.createDataFrame(rows, "reading_id bigint, word_id bigint, x0 double, y0 double, x1 double, y1 double, text string")
    found = find_tables(lined_words(words))
    return found.select(F.col("line_no").alias("row_no"), "column_no", "text")


# Filters.


def line_filter(stage: str | None = None, supplier: str | None = None, procurement: int | None = None, item: int | None = None, since: str | None = None, until: str | None = None, pending: bool | None = None) -> Column:
    """A condition on price lines from what was asked for; nothing asked is always true, and an unknown value fails what asks for it."""
    asked = [
        None if stage is None else F.col("stage") == stage,
        None if supplier is None else compare_key(F.col("supplier_name")).contains(compare_key(F.lit(supplier))),
        None if procurement is None else F.col("procurement_id") == procurement,
        None if item is None else F.col("item_id") == item,
        None if since is None else F.col("price_date") >= F.lit(since).cast("date"),
        None if until is None else F.col("price_date") <= F.lit(until).cast("date"),
        None if pending is None else F.coalesce(F.col("state").isin("pendiente_baja", "conflicto", "no_revisado"), F.lit(True)) == pending,
    ]
    out = F.lit(True)
    for c in asked:
        out = out if c is None else out & F.coalesce(c, F.lit(False))
    return out


@CATALOGUE.add(
    f"with {_LATEST} select line_id from lines where stage = 'factura' and contains(trim(regexp_replace(upper(translate(supplier_name, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY')), '[^A-Z0-9]+', ' ', 'g')), 'SA')"
    " and price_date >= date '2015-01-01' and price_date <= date '2023-12-31' and coalesce(state in ('pendiente_baja', 'conflicto', 'no_revisado'), true)"
)
def filtered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Invoiced lines of suppliers whose name holds a text, in a span of dates, that wait for a person."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "stage", "supplier_name", "procurement_id", "item_id", "price_date", "state"))
    return p.where(line_filter(stage="factura", supplier="sa", since="2015-01-01", until="2023-12-31", pending=True)).select("line_id")


# Confidences in words, lowest first.
CONFIDENCE_ORDER = ("baja", "media", "alta")


def finding_filter(kind: str | None = None, review: str | None = None, least: str | None = None, text: str | None = None) -> Column:
    """A condition on findings (kind, review, confidence in words, text); `least` is the lowest confidence that passes."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE_ORDER]), F.col("confidence"))
    asked = [
        None if kind is None else F.col("kind") == kind,
        None if review is None else F.col("review") == review,
        None if least is None else rank > CONFIDENCE_ORDER.index(least),
        None if text is None else fold(F.col("text")).contains(py_fold(text)),
    ]
    out = F.lit(True)
    for c in asked:
        out = out if c is None else out & F.coalesce(c, F.lit(False))
    return out


@CATALOGUE.add(
    "with f as (select distinct field_id, field_name as kind, state as review, case when confidence >= 0.9 then 'alta' when confidence >= 0.7 then 'media' when confidence is not null then 'baja' end as confidence, literal as text from piece_fields)"
    " select field_id from f where kind = 'nombre' and review = 'pendiente_baja' and confidence in ('media', 'alta')"
    " union all select field_id from f where kind = 'nombre' and confidence in ('alta') and contains(lower(translate(text, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')), 'mar')"
)
def filtered_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Names that wait for a person with at least middle confidence, and sure names that hold a text."""
    c = F.col("confidence")
    words = F.when(c >= 0.9, "alta").when(c >= 0.7, "media").when(c.isNotNull(), "baja")
    f = table(spark, folder, "piece_fields", "field_id", "field_name", "state", "confidence", "literal").distinct().select(
        "field_id", F.col("field_name").alias("kind"), F.col("state").alias("review"), words.alias("confidence"), F.col("literal").alias("text")
    )
    waiting = f.where(finding_filter(kind="nombre", review="pendiente_baja", least="media"))
    return waiting.select("field_id").unionByName(f.where(finding_filter(kind="nombre", least="alta", text="mar")).select("field_id"))


@CATALOGUE.add("select page_id from case_pages where contains(regexp_replace(page_text, '[^0-9]', '', 'g'), '2020')")
def digits_search(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose digits, whatever stands between them, hold a number."""
    return table(spark, folder, "case_pages", "page_id", "page_text").where(digits(F.col("page_text")).contains("2020")).select("page_id")


# Text.


@CATALOGUE.add(
    f"with {_LATEST} select line_id, list_filter(regexp_extract_all(regexp_replace({_FOLD.format('description')}, '([0-9]),([0-9])', '\\1.\\2', 'g'), '[a-z0-9./]+'),"
    " lambda w: w not in ('de','del','la','las','el','los','y','e','o','u','con','sin','para','por','a','al','en','x','.')) as words from lines where description is not null"
)
def description_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each description that tell products apart."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "description")).where("description is not null")
    return p.select("line_id", description_tokens(F.col("description")).alias("words"))


_SWAPPED = ", ".join(f"replace(t, '{x}', '{y}')" for a, b in search.READING_SWAPS for x, y in ((a, b), (b, a)))


@CATALOGUE.add(
    f"with x as (select item_id, {_FOLD.format('item_name')} as t from catalog_items), v as (select item_id, list_filter([{_SWAPPED}], lambda s: length(t) >= 3 and s <> t) as l from x)"
    f" select item_id, list_filter(l, lambda s, i: list_position(l, s) = i)[1:{search.MOST_VARIANTS}] as variants from v"
)
def search_variants(spark: SparkSession, folder: str) -> DataFrame:
    """How a bad reading may have left the name of each item."""
    return table(spark, folder, "catalog_items", "item_id", "item_name").select("item_id", search.variants_of(F.col("item_name")).alias("variants"))


_ENTITY_KEY = "trim(regexp_replace(replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy'), '.', ''), '[^a-z0-9]+', ' ', 'g'))"
_CHECK = " + ".join(f"{w} * substr(n, {i}, 1)::int" for i, w in enumerate(TAX_WEIGHTS, 1))


@CATALOGUE.add(
    f"with d as (select doc_id, text from documents where text is not null union all select page_id, page_text from case_pages where page_text is not null), t as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{TAX_ID}', 1)), '[^0-9]', '', 'g') as n from d),"
    f" k as (select doc_id, n, 11 - ({_CHECK}) % 11 as rest from t where length(n) = 11),"
    " e as (select doc_id, case when substr(n, 1, 2) in ('20','23','24','27') then 'person' else 'firm' end as class, n as norm, 0.9 as confidence from k where (case rest when 11 then 0 when 10 then 9 else rest end) = substr(n, 11, 1)::int"
    f" union select doc_id, 'case_number', {_ENTITY_KEY.format('m')}, 0.75 from (select doc_id, unnest(regexp_extract_all(text, '{CASE_NUMBER}', 1)) as m from d)"
    f" union select doc_id, 'voucher', {_ENTITY_KEY.format('m')}, 0.7 from (select doc_id, unnest(regexp_extract_all(text, '{VOUCHER}', 1)) as m from d)"
    f" union select doc_id, 'firm', {_ENTITY_KEY.format('m')}, 0.6 from (select doc_id, unnest(regexp_extract_all(text, '{FIRM}', 1)) as m from d))"
    " select doc_id, class, norm, confidence::double as confidence from e where norm <> '' and (class <> 'firm' or length(norm) >= 5)"
)
def entities_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Persons, firms, files and vouchers that each document or page names by their form, with the confidence of the form."""
    d = table(spark, folder, "documents", "doc_id", "text").unionByName(table(spark, folder, "case_pages", "page_id", "page_text").toDF("doc_id", "text")).where("text is not null")
    return d.select("doc_id", F.explode(entities(F.col("text"))).alias("e")).select("doc_id", "e.class", "e.norm", "e.confidence")


#: Texts with tax ids (right and wrong check digits), files, vouchers and firms.
NAMED = [
    (1, "El señor de CUIL 20-12345678-6 y la firma de CUIT 30-12345678-1; otra vez 20123456786"), (2, "CUIT 20-12345678-9 no es válido"),
    (3, "Expte. N° 1234/2020 y expediente 00.55-7"), (4, "Factura N° A 00012345, orden de pago 12-345678"), (5, "Vista la oferta de Aceros Sol S.R.L. y de Obras Paz SA"), (6, ""),
]


@CATALOGUE.add(
    "select doc_id, class, norm, confidence::double as confidence from (values (1, 'person', '20123456786', 0.9), (1, 'firm', '30123456781', 0.9), (3, 'case_number', '1234 2020', 0.75), (3, 'case_number', '0055 7', 0.75),"
    " (4, 'voucher', '12 345678', 0.7), (4, 'voucher', 'a 00012345', 0.7), (5, 'firm', 'vista la oferta de aceros sol srl', 0.6), (5, 'firm', 'obras paz sa', 0.6)) as v(doc_id, class, norm, confidence)"
)
def case_entities(spark: SparkSession, folder: str) -> DataFrame:
    """What literal texts name by its form."""
    d = spark.createDataFrame(NAMED, "doc_id int, text string")
    return d.select("doc_id", F.explode(entities(F.col("text"))).alias("e")).select("doc_id", "e.class", "e.norm", "e.confidence")


# Folios.

_MARGIN, _NEAR = folios.MARGIN, folios.NEAR


@CATALOGUE.add(
    "with b as (select distinct word_id, reading_id, text, x0, x1, (y0 + y1) / 2 as m from words where text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null),"
    " p as (select b.*, r.page_id, c.width_pt, c.height_pt, trim(translate(lower(trim(b.text)), '°º', '')) as t from b join readings r using (reading_id) join case_pages c using (page_id) where c.width_pt > 0 and c.height_pt > 0),"
    f" k as (select *, regexp_extract(t, '{FOLIO}', ['number', 'suffix', 'side']) as f from p where regexp_matches(t, '{FOLIO}') and not (m > height_pt * {_MARGIN} and m < height_pt * (1 - {_MARGIN}))),"
    f" n as (select k.page_id, k.reading_id, k.word_id, any_value(k.text) as text, any_value(k.f) as f, any_value((k.x0 + k.x1) / 2) as c, any_value(k.m) as m, any_value(k.width_pt) as w, any_value(k.height_pt) as h,"
    f" count(*) filter (where o.word_id <> k.word_id and abs(o.m - k.m) < 6) as others, count(*) filter (where o.word_id <> k.word_id and abs(o.m - k.m) < 6 and o.x0 - k.x1 < {_NEAR} and k.x0 - o.x1 < {_NEAR}) as near"
    " from k join b o on o.reading_id = k.reading_id group by all),"
    f" s as (select *, round(greatest(0.3, case when m <= h * {_MARGIN} and c > w * 0.66 then 0.92 when m > h * {_MARGIN} and c > w * 0.66 then 0.80 when m > h * {_MARGIN} and c between w * 0.33 and w * 0.66 then 0.72"
    f" when m <= h * {_MARGIN} and c between w * 0.33 and w * 0.66 then 0.60 else 0.5 end::double - 0.08::double * near), 2) as confidence from n where others <= 2)"
    " select page_id, trim(text) as literal, f.number::int as number, nullif(f.suffix, '') as suffix, f.side <> '' and f.side not like 'r%' as back, confidence from s"
    " qualify row_number() over (partition by page_id order by confidence desc, reading_id, word_id) = 1"
)
def folio_detection(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest folio number of each page, from the place of its words in the margins."""
    return folios.detect_folios(
        table(spark, folder, "words", "word_id", "reading_id", "text", "x0", "y0", "x1", "y1"), table(spark, folder, "readings", "reading_id", "page_id"),
        table(spark, folder, "case_pages", "page_id", "width_pt", "height_pt"),
    )


@CATALOGUE.add(f"select page_id, literal from ({CATALOGUE.oracles['folio_detection']}) where number = 2")
def folio_search(spark: SparkSession, folder: str) -> DataFrame:
    """All pages that carry a folio number."""
    return folio_detection(spark, folder).where("number = 2").select("page_id", "literal")


# Papers that belong together, calculations and reasons.


@CATALOGUE.add(
    f"with {_LATEST}, o as (select case_id, procurement_id, min(document_id) as order_id from lines where stage = 'orden_compra' and procurement_id is not null and document_id is not null group by all having count(distinct document_id) = 1)"
    " select distinct l.document_id, o.order_id from lines l left join o using (case_id, procurement_id) where l.stage = 'factura' and l.document_id is not null"
)
def order_of_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Each invoice paper with the only order of its procedure; none or several give null."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "case_id", "procurement_id", "document_id", "stage")).where("document_id is not null")
    orders = p.where("stage = 'orden_compra' and procurement_id is not null").withColumnRenamed("document_id", "order_id")
    return relational.join_only_match(p.where("stage = 'factura'"), orders, ["case_id", "procurement_id"], "order_id").select("document_id", "order_id").distinct()


@CATALOGUE.add(
    f"with {_LATEST} select line_id, 'quantity * unit_price' as formula, [quantity::varchar, unit_price::varchar] as operands, round(quantity::decimal(18,4) * unit_price, 2)::double as result, round(subtotal, 2)::double as found"
    " from lines where quantity is not null and unit_price is not null and subtotal is not null and round(quantity::decimal(18,4) * unit_price, 2) <> round(subtotal, 2)"
)
def subtotal_calculations(spark: SparkSession, folder: str) -> DataFrame:
    """The calculation behind each wrong subtotal: formula, operands as written, result, and what the paper has."""
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", "quantity", "unit_price", "subtotal"))
    result = F.round(F.col("quantity") * F.col("unit_price"), 2)
    return p.where(result != F.round("subtotal", 2)).select(
        "line_id", F.lit("quantity * unit_price").alias("formula"), F.array(F.col("quantity").cast("string"), F.col("unit_price").cast("string")).alias("operands"),
        result.cast("double").alias("result"), F.round("subtotal", 2).cast("double").alias("found"),
    )


def reasons_of(pairs: list[tuple[str, Column, Column]], effect: str) -> Column:
    """array<struct<attribute, a, b, effect>> of the attributes in which two sides differ; an unknown side is no reason."""
    each = [F.when(a != b, F.struct(F.lit(n).alias("attribute"), a.cast("string").alias("a"), b.cast("string").alias("b"), F.lit(effect).alias("effect"))) for n, a, b in pairs]
    return F.filter(F.array(*each), lambda r: r.isNotNull())


_INVOICE_ORDER = (
    "(select case_id, procurement_id, item_id, max(currency) as currency, max(vat) as vat, max(unit_norm) as unit_norm from lines where stage = '{}' and item_id is not null and procurement_id is not null group by all having count(*) = 1)"
)


@CATALOGUE.add(
    f"with {_LATEST}, i as {_INVOICE_ORDER.format('factura')}, o as {_INVOICE_ORDER.format('orden_compra')}, r as (select case_id, procurement_id, item_id,"
    " unnest([case when i.currency <> o.currency then 'currency' || '|' || i.currency || '|' || o.currency end, case when i.vat <> o.vat then 'vat' || '|' || i.vat || '|' || o.vat end,"
    " case when i.unit_norm <> o.unit_norm then 'unit_norm' || '|' || i.unit_norm || '|' || o.unit_norm end]) as reason from i join o using (case_id, procurement_id, item_id))"
    " select case_id, procurement_id, item_id, reason, 'blocks' as effect from r where reason is not null"
)
def comparison_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why the only invoiced and the only ordered line of an item can't be compared, one row per attribute."""
    cols = ("currency", "vat", "unit_norm")
    keys = ["case_id", "procurement_id", "item_id"]
    p = views.latest_lines(table(spark, folder, "price_lines", "line_id", "loaded_at", *keys, "stage", *cols)).where("item_id is not null and procurement_id is not null")
    at = lambda stage, end: F.max(F.when(F.col("stage") == stage, F.struct(*cols))).alias(end)
    n = lambda stage: F.count_if(F.col("stage") == stage)
    g = p.groupBy(*keys).agg(at("factura", "i"), at("orden_compra", "o"), n("factura").alias("ni"), n("orden_compra").alias("no")).where("ni = 1 and no = 1 and case_id is not null")
    why = reasons_of([(c, F.col(f"i.{c}"), F.col(f"o.{c}")) for c in cols], "blocks")
    return g.select(*keys, F.explode(why).alias("r")).select(*keys, F.concat_ws("|", "r.attribute", "r.a", "r.b").alias("reason"), "r.effect")


@CATALOGUE.add("select engine, count(*) as readings, min(created_at) as first, max(created_at) as last from readings group by engine")
def engine_activity(spark: SparkSession, folder: str) -> DataFrame:
    """What each engine read, and when first and last."""
    r = table(spark, folder, "readings", "engine", "created_at")
    return r.groupBy("engine").agg(F.count("*").alias("readings"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
