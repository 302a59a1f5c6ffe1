"""Analyses over files, pages, readings, words and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.identifiers import FOLIO, IDENTIFIERS, compare_key, identifiers, legibility, snippet
from folioscope.functions.numbers import NUMBER_WORDS, check_digit, check_digit_holds, identity_kind, person_key, spanish_date, spanish_number, words_to_number
from folioscope.functions.text import fold
from folioscope.operators import checks, identity, ordered, pages, relational, search, views
from folioscope.operators.intervals import point_in_span
from folioscope.plans.registry import Catalogue
from folioscope.sources.tables import table

CATALOGUE = Catalogue()

_FOLD = "trim(regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy'), '\\s+', ' ', 'g'))"
_WORDS = "w as (select distinct word_id, reading_id, ord, text, x0, y0, x1, y1, conf from words where text <> '')"


@CATALOGUE.add(
    "select sha256, original_path, ingested_at from (select *, row_number() over (partition by sha256 order by ingested_at, original_path) as rn from case_files) where rn > 1"
)
def duplicate_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files seen again under another path: every sighting but the first."""
    f = table(spark, folder, "case_files", "sha256", "original_path", "ingested_at")
    w = W.partitionBy("sha256").orderBy("ingested_at", "original_path")
    return f.withColumn("rn", F.row_number().over(w)).where("rn > 1").drop("rn")


@CATALOGUE.add(
    "select page_id, case when page_text is null or trim(page_text) = '' then '' else sha256("
    + _FOLD.format("page_text")
    + ") end as text_fingerprint from case_pages"
)
def text_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """sha-256 of each page's folded text; blank pages have an empty one."""
    p = table(spark, folder, "case_pages", "page_id", "page_text")
    blank = F.col("page_text").isNull() | (F.trim("page_text") == "")
    return p.select("page_id", F.when(blank, "").otherwise(F.sha2(fold("page_text"), 256)).alias("text_fingerprint"))


@CATALOGUE.add(
    "with f as (select sha256, min(ingested_at) as seen from case_files group by sha256), p as (select c.file_sha, c.page_id, c.fingerprint, f.seen from case_pages c join f on f.sha256 = c.file_sha where c.fingerprint <> ''),"
    " o as (select *, first_value(file_sha) over (partition by fingerprint order by seen, page_id) as origin, first_value(page_id) over (partition by fingerprint order by seen, page_id) as origin_page from p)"
    " select file_sha, count(*) as pages, count(*) filter (where origin_page <> page_id) as repeated, count(distinct origin) filter (where origin_page <> page_id) as origins,"
    " case when count(*) filter (where origin_page <> page_id) = 0 then 'new' when count(*) filter (where origin_page <> page_id) = count(*) and count(distinct origin) = 1"
    " and min(origin) <> file_sha then 'whole copy' else 'partly repeated' end as verdict from o group by file_sha"
)
def page_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Per file how many pages were seen before and whether it is a whole copy of one file."""
    f = table(spark, folder, "case_files", "sha256", "ingested_at").groupBy(F.col("sha256").alias("file_sha")).agg(F.min("ingested_at").alias("seen"))
    p = table(spark, folder, "case_pages", "page_id", "file_sha", "fingerprint").where("fingerprint <> ''").join(f, "file_sha")
    # The origin per fingerprint comes from an aggregation, so that a stamp seen everywhere is no hot window.
    origin = p.groupBy("fingerprint").agg(F.min(F.struct("seen", "page_id", "file_sha")).alias("o")).select("fingerprint", F.col("o.page_id").alias("origin_page"), F.col("o.file_sha").alias("origin"))
    rep = F.col("origin_page") != F.col("page_id")
    n_rep = F.count(F.when(rep, 1))
    return p.join(origin, "fingerprint").groupBy("file_sha").agg(
        F.count("*").alias("pages"), n_rep.alias("repeated"), F.countDistinct(F.when(rep, F.col("origin"))).alias("origins"),
        F.when(n_rep == 0, "new").when((n_rep == F.count("*")) & (F.countDistinct("origin") == 1) & (F.min("origin") != F.col("file_sha")), "whole copy").otherwise("partly repeated").alias("verdict"),
    )


@CATALOGUE.add(
    "select r.page_id, r.reading_id, r.route from (select *, row_number() over (partition by page_id order by case when route = 'nativo' then 0 else 1 end, confidence desc nulls last, reading_id) as rn from readings) r where rn = 1"
)
def best_reading(spark: SparkSession, folder: str) -> DataFrame:
    """The reading of each page to be trusted: native first, then the surest."""
    return pages.best_reading(table(spark, folder, "readings", "reading_id", "page_id", "route", "confidence")).select("page_id", "reading_id", "route")


@CATALOGUE.add(
    f"with {_WORDS}, n as (select r.page_id, r.reading_id, count(w.word_id) as words from readings r left join w using (reading_id) group by all)"
    " select page_id, reading_id, words from (select *, row_number() over (partition by page_id order by words desc, reading_id) as rn from n) where rn = 1"
)
def longest_reading(spark: SparkSession, folder: str) -> DataFrame:
    """The reading of each page with the most words."""
    return pages.longest_reading(table(spark, folder, "readings", "reading_id", "page_id"), table(spark, folder, "words"))


@CATALOGUE.add(f"with {_WORDS} select reading_id, string_agg(text, ' ' order by ord, word_id) as text, count(*) as words from w group by reading_id")
def reading_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each reading in order as one text."""
    return pages.reading_text(table(spark, folder, "words"))


@CATALOGUE.add(
    f"with {_WORDS}, b as (select * from w where x0 is not null and y0 is not null and y1 is not null), l as (select *, max(y1) over (partition by reading_id order by y0, x0, word_id rows between unbounded preceding and 1 preceding) as lowest from b),"
    " n as (select *, sum(case when lowest is null or (y0 + y1) / 2 > lowest then 1 else 0 end) over (partition by reading_id order by y0, x0, word_id rows between unbounded preceding and current row) as line_no from l)"
    " select reading_id, line_no, string_agg(text, ' ' order by x0, word_id) as text, count(*) as words, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from n group by reading_id, line_no"
)
def reading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each reading from the boxes of its words."""
    return pages.reading_lines(table(spark, folder, "words"))


@CATALOGUE.add(
    f"with {_WORDS}, b as (select * from w where x0 is not null and y0 is not null and y1 is not null), l as (select *, max(y1) over (partition by reading_id order by y0, x0, word_id rows between unbounded preceding and 1 preceding) as lowest from b),"
    " n as (select *, sum(case when lowest is null or (y0 + y1) / 2 > lowest then 1 else 0 end) over (partition by reading_id order by y0, x0, word_id rows between unbounded preceding and current row) as line_no from l),"
    " t as (select reading_id, line_no, trim(lower(string_agg(text, ' ' order by x0, word_id))) as t, min(y0) as y0, max(y1) as y1 from n group by reading_id, line_no),"
    " u as (select reading_id, line_no, trim(translate(t, '°º', '')) as t from t where y0 < 842 * 0.13 or y1 > 842 * 0.87),"
    f" f as (select reading_id, line_no, regexp_extract(t, '{FOLIO}', ['number','suffix','side']) as f from u where regexp_matches(t, '{FOLIO}'))"
    " select reading_id, line_no, f.number::int as number, nullif(f.suffix, '') as suffix, f.side <> '' and f.side not like 'r%' as back from f"
)
def folio_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Folio notes in the margins of the readings."""
    return pages.folio_notes(pages.reading_lines(table(spark, folder, "words")))


@CATALOGUE.add(
    "select file_sha, page_no, n as number, previous, case when n = previous then 'repeated' when n < previous then 'goes_back' else 'jump' end as kind from"
    " (select file_sha, page_no, page_no as n, lag(page_no) over (partition by file_sha order by page_no) as previous from (select distinct file_sha, page_no from case_pages where page_text is not null)) where n - previous <> 1"
)
def folio_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Where the numbers of the indexed pages of a file jump."""
    p = table(spark, folder, "case_pages", "file_sha", "page_no", "page_text").where("page_text is not null").withColumn("number", F.col("page_no"))
    return ordered.sequence_breaks(p, ["file_sha"], "page_no", "number")


@CATALOGUE.add(
    "with c as (select file_sha, page_no, page_class, case when row_number() over w = 1 or page_class is distinct from lag(page_class) over w then 1 else 0 end as opens from case_pages window w as (partition by file_sha order by page_no)),"
    " r as (select *, sum(opens) over (partition by file_sha order by page_no rows unbounded preceding) as run from c)"
    " select file_sha, run, min(page_class) as page_class, min(page_no) as first, max(page_no) as last, count(*) as rows from r group by file_sha, run"
)
def class_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive pages of one class."""
    return ordered.runs(table(spark, folder, "case_pages", "file_sha", "page_no", "page_class"), ["file_sha"], "page_no", "page_class")


_PIECES = (
    "t as (select file_sha, page_no, (page_text is null or trim(page_text) = '') and page_class is null as blank, page_class is null as cont, page_class from case_pages),"
    " u as (select *, case when not blank and not cont then page_class end as cls from t),"
    " o as (select *, last_value(cls ignore nulls) over (partition by file_sha order by page_no rows between unbounded preceding and 1 preceding) as prev from u),"
    " n as (select *, sum(case when cls is not null and (prev is null or cls <> prev or cls in ('pase')) then 1 else 0 end) over (partition by file_sha order by page_no rows unbounded preceding) as piece_no from o),"
    " e as (select *, max(case when not blank then page_no end) over (partition by file_sha, piece_no) as finish from n),"
    " pieces as (select file_sha, piece_no, max(cls) as type, min(page_no) as page_from, max(page_no) as page_to, count(*) as pages from e where piece_no > 0 and page_no <= finish group by file_sha, piece_no)"
)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "case_pages", "file_sha", "page_no", "page_class", "page_text")
    blank = (F.col("page_text").isNull() | (F.trim("page_text") == "")) & F.col("page_class").isNull()
    return ordered.page_segments(p, "file_sha", "page_no", "page_class", blank, F.col("page_class").isNull(), ["pase"])


@CATALOGUE.add(f"with {_PIECES} select * from pieces")
def segment_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of each file from the classes of its pages."""
    return _pieces(spark, folder)


@CATALOGUE.add(
    f"with {_PIECES} select l.line_id, p.piece_no, p.type from (select distinct line_id, file_sha, page_no from price_lines) l join pieces p on p.file_sha = l.file_sha and l.page_no between p.page_from and p.page_to"
)
def lines_in_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The piece in which each price line stands."""
    points = table(spark, folder, "price_lines", "line_id", "file_sha", "page_no").distinct()
    return point_in_span(points, _pieces(spark, folder), ["file_sha"], "page_no", "page_from", "page_to", "piece_no").select("line_id", "piece_no", "type")


@CATALOGUE.add(
    "select file_sha, page_id, next_id from (select file_sha, page_id, page_no, page_class, lead(page_id) over w as next_id, lead(page_no) over w as np, lead(page_class) over w as nc from case_pages where page_class is not null"
    " window w as (partition by file_sha order by page_no, page_id)) where np = page_no + 1 and nc = page_class"
)
def page_continuation(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that the next page of the same class continues."""
    p = table(spark, folder, "case_pages", "file_sha", "page_id", "page_no", "page_class").where("page_class is not null")
    return pages.continue_tables(p, "file_sha", "page_no", "page_class", "page_id")


@CATALOGUE.add(
    "with recursive l as (select page_id, next_id from (" + CATALOGUE.oracles["page_continuation"] + ")), h as (select page_id, page_id as head from l where page_id not in (select next_id from l)"
    " union all select l.next_id, h.head from h join l on l.page_id = h.page_id) select * from h"
)
def continuation_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Every continued page with the head of its chain, followed by pointer doubling."""
    links = page_continuation(spark, folder).select(F.col("next_id").alias("page_id"), F.col("page_id").alias("towards"))
    return ordered.follow_chain(links, "page_id", "towards")


@CATALOGUE.add(
    "select p.file_sha, count(*) as pages, count(r.page_id) as read, count(p.page_class) as classified, count(p.page_text) as indexed, case when count(r.page_id) = 0 and count(p.page_text) = 0 then 'unread'"
    " when count(p.page_text) + count(case when p.page_text is null then r.page_id end) < count(*) then 'partly read' when count(p.page_class) = 0 then 'unclassified' else 'ready' end as state"
    " from case_pages p left join (select distinct page_id from readings) r using (page_id) group by p.file_sha"
)
def file_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Pages read, classified and indexed of each file, and its state."""
    read = table(spark, folder, "readings", "page_id").distinct().withColumn("r", F.lit(1))
    p = table(spark, folder, "case_pages", "file_sha", "page_id", "page_class", "page_text").join(read, "page_id", "left")
    reached = F.count("page_text") + F.count(F.when(F.col("page_text").isNull(), F.col("r")))
    state = (
        F.when((F.count("r") == 0) & (F.count("page_text") == 0), "unread").when(reached < F.count(F.lit(1)), "partly read")
        .when(F.count("page_class") == 0, "unclassified").otherwise("ready")
    )
    return p.groupBy("file_sha").agg(
        F.count(F.lit(1)).alias("pages"), F.count("r").alias("read"), F.count("page_class").alias("classified"), F.count("page_text").alias("indexed"), state.alias("state")
    )


@CATALOGUE.add(
    "select page_id from case_pages p where page_text is null and not exists (select 1 from readings r where r.page_id = p.page_id)"
)
def unread_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are neither indexed nor read."""
    p = table(spark, folder, "case_pages", "page_id", "page_text").where("page_text is null")
    return p.join(table(spark, folder, "readings", "page_id"), "page_id", "left_anti").select("page_id")


@CATALOGUE.add(
    "select count(*) as pages, count(page_text) as indexed, count(*) filter (where trim(page_text) = '') as indexed_without_text, count(*) filter (where page_text is null and r.page_id is not null) as read_not_indexed,"
    " count(*) filter (where page_text is null and r.page_id is null) as never_read from case_pages p left join (select distinct page_id from readings) r on r.page_id = p.page_id"
)
def search_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What a search over the pages can and can't see."""
    return search.search_coverage(table(spark, folder, "case_pages", "page_id", "page_text"), table(spark, folder, "readings", "page_id"))


@CATALOGUE.add(
    f"select page_id from case_pages where contains({_FOLD.format('page_text')}, 'recepcion') and len(list_filter(regexp_extract_all({_FOLD.format('page_text')}, '[a-z0-9]+'), lambda w: starts_with(w, 'form'))) > 0"
    f" and len(list_filter(regexp_extract_all({_FOLD.format('page_text')}, '[a-z0-9]+'), lambda w: starts_with(w, 'recepcion'))) > 0"
)
def page_search(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a word that starts with `form` and one with `recepción`."""
    p = table(spark, folder, "case_pages", "page_id", "page_text")
    return p.where(search.matches(F.col("page_text"), "form recepción")).select("page_id")


@CATALOGUE.add(
    f"with t as (select page_id as page, unnest(regexp_extract_all({_FOLD.format('page_text')}, '[a-z0-9]+')) as term from case_pages where page_text is not null),"
    " n as (select page, count(*) as length from t group by page), s as (select count(*) as pages, avg(length) as mean from n),"
    " h as (select q.word, t.page, count(*) as tf from t join (select unnest(['multa','diaria']) as word) q on starts_with(t.term, q.word) group by all), d as (select word, count(*) as df from h group by word)"
    " select h.page, round(sum(ln(1 + (s.pages - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * n.length / s.mean))), 4) as score from h join d using (word) join n using (page) cross join s group by h.page having count(*) = 2"
)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that hold both words, ranked by BM25."""
    return search.rank_pages(table(spark, folder, "case_pages", "page_id", "page_text"), "page_id", "page_text", "multa diaria").select("page", F.round("score", 4).alias("score"))


@CATALOGUE.add(
    f"with x as (select doc_id, {_FOLD.format('text')} as t from documents where text is not null)"
    " select doc_id, kind, ids from (" + " union all ".join(
        f"select doc_id, '{k}' as kind, list_sort(list_distinct(list_transform(regexp_extract_all(t, '{p}', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))) as ids from x" for k, p in IDENTIFIERS.items()
    ) + ") where len(ids) > 0"
)
def identifiers_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of files, orders, vouchers and the like in each document."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", fold("text").alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), identifiers(F.col("t"), k, folded=True).alias("ids")) for k in IDENTIFIERS]))
    return d.select("doc_id", each.alias("x")).select("doc_id", "x.kind", "x.ids").where(F.size("ids") > 0)


@CATALOGUE.add(
    "with w as (select page_id, list_filter(regexp_split_to_array(coalesce(page_text, ''), '\\s+'), lambda x: x <> '') as w from case_pages),"
    " u as (select page_id, len(w) as n, len(list_filter(w, lambda x: regexp_matches(x, '^[^0-9]*[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ]{4,}') or regexp_matches(x, '[0-9]{3,}'))) as u from w)"
    " select page_id, case when n < 12 and u = 0 then 'blank' when u < n * 0.08 then 'unreadable' else 'readable' end as legibility from u"
)
def page_legibility(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each page is blank, unreadable or readable."""
    p = table(spark, folder, "case_pages", "page_id", "page_text")
    return p.select("page_id", legibility(F.col("page_text")).alias("legibility"))


_RULES = pages.PAGE_RULES
_MARKS = {name: f"len(regexp_extract_all(t, '({marks})', 1))" for name, _, marks in _RULES}
_TITLED = " ".join(f"when contains(substr(t, 1, 120), '{title}')" + (" and not contains(t, 'no valido como factura')" if name == "factura" else "") + f" then '{name}'" for name, title, _ in _RULES)
_MARKED = " ".join(f"when {m} > 0 and {m} = greatest({', '.join(_MARKS.values())}) then '{name}'" for name, m in _MARKS.items())


@CATALOGUE.add(
    f"with s as ({CATALOGUE.oracles['page_legibility']}), x as (select page_id, coalesce({_FOLD.format('page_text')}, '') as t from case_pages)"
    f" select page_id, case when s.legibility <> 'readable' then s.legibility {_TITLED} {_MARKED} else 'desconocido' end as class from x join s using (page_id)"
)
def page_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class of each page by its text."""
    p = table(spark, folder, "case_pages", "page_id", "page_text")
    return p.select("page_id", pages.classify_page(F.col("page_text")).alias("class"))


@CATALOGUE.add(
    "with d as (select distinct field_id, regexp_replace(literal, '[^0-9]', '', 'g') as d from piece_fields where field_name = 'documento' and literal is not null)"
    " select field_id, case when length(d) = 11 then 'CUIL' when length(d) in (7, 8) then 'DNI' end as kind, case when length(d) in (7, 8) then 'DNI:' || regexp_replace(d, '^0+', '')"
    " when length(d) = 11 and substr(d, 1, 2) in ('20','23','24','27') then 'DNI:' || regexp_replace(substr(d, 3, 8), '^0+', '') when length(d) = 11 then 'CUIT:' || d end as person_key from d"
)
def id_parser(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and person key of each document number."""
    f = table(spark, folder, "piece_fields", "field_id", "field_name", "literal").where("field_name = 'documento' and literal is not null").distinct()
    return f.select("field_id", identity_kind(F.col("literal")).alias("kind"), person_key(F.col("literal")).alias("person_key"))


@CATALOGUE.add(
    "with d as (select distinct supplier_tax_id as tax, regexp_replace(supplier_tax_id, '[^0-9]', '', 'g') as d from price_lines where supplier_tax_id is not null),"
    " c as (select tax, d, 11 - (" + " + ".join(f"try_cast(substr(d, {i + 1}, 1) as int) * {w}" for i, w in enumerate((5, 4, 3, 2, 7, 6, 5, 4, 3, 2))) + ") % 11 as r from d where length(d) = 11)"
    " select tax, (case when r = 11 then 0 when r = 10 then 9 else r end)::int as digit, (case when r = 11 then 0 when r = 10 then 9 else r end) = substr(d, 11, 1)::int as holds from c"
)
def tax_id_check(spark: SparkSession, folder: str) -> DataFrame:
    """The check digit that each supplier's tax id asks for, and whether it has it."""
    p = table(spark, folder, "price_lines", "supplier_tax_id").where("supplier_tax_id is not null").distinct()
    out = p.select(F.col("supplier_tax_id").alias("tax"), check_digit(F.col("supplier_tax_id")).alias("digit"), check_digit_holds(F.col("supplier_tax_id")).alias("holds"))
    return out.where("digit is not null")


_WORD_VALUES = "map {" + ", ".join(f"'{w}': {v}" for w, v in NUMBER_WORDS.items()) + "}"


@CATALOGUE.add(
    f"with q as (select distinct {_FOLD.format('quantity_literal')} as words from price_lines where quantity_literal is not null), k as (select words, list_filter(string_split(words, ' '), lambda w: w not in ('y', 'de', '')) as l from q"
    " where not regexp_matches(words, '[0-9]') and words <> ''), m as (select words, l, coalesce(list_position(l, 'mil'), 0) as pos from k),"
    f" v as (select words, l, pos, list_transform(l, lambda w: case when w = 'mil' then 0 else ({_WORD_VALUES})[w] end) as n from m)"
    " select words, case when len(l) = 0 or len(list_filter(n, lambda x: x is null)) > 0 then null when pos > 0 then (case when pos = 1 then 1 else list_sum(n[1:pos - 1]) end) * 1000 + coalesce(list_sum(n[pos + 1:]), 0)"
    " else list_sum(n) end::bigint as number from v"
)
def words_to_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The number of each quantity that is written without digits; an unknown word makes the whole unknown."""
    q = table(spark, folder, "price_lines", "quantity_literal").where("quantity_literal is not null").select(fold(F.col("quantity_literal")).alias("words")).distinct()
    return q.where(~F.col("words").rlike("[0-9]") & (F.col("words") != "")).select("words", words_to_number(F.col("words")).alias("number"))


@CATALOGUE.add(
    "select distinct a.case_id, a.name_key, a.keys, a.strong_keys from (select case_id, trim(regexp_replace(upper(translate(name_literal, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY')), '[^A-Z0-9]+', ' ', 'g')) as name_key,"
    " count(distinct strong_key) as keys, string_agg(distinct strong_key, '|' order by strong_key) as strong_keys from person_aliases where strong_key is not null group by 1, 2) a where keys > 1"
)
def homonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Equal names with different strong keys in a case."""
    return identity.same_name_other_key(table(spark, folder, "person_aliases", "case_id", "name_literal", "strong_key"))


@CATALOGUE.add(
    "select case_id, name_norm, count(distinct name_literal) as spellings, count(distinct alias_id) as mentions from person_aliases where strong_key is null group by all having count(distinct alias_id) > 1"
)
def mention_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions without key that share a normal form."""
    return identity.mention_groups(table(spark, folder, "person_aliases", "case_id", "name_norm", "name_literal", "alias_id", "strong_key"))


@CATALOGUE.add()
def merge_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Persons of a case with like names that may be one."""
    f = table(spark, folder, "piece_fields", "field_id", "case_id", "piece_id", "file_sha", "field_name", "literal", "null_reason", "page_no", "confidence", "state")
    return identity.merge_proposals(identity.resolve_persons(views.contracts(f)))


@CATALOGUE.add(
    "select alias_id, case_id, name_literal from (select *, row_number() over (partition by case_id, coalesce(strong_key, 'P:' || person_id) order by alias_id) as rn from (select distinct * from person_aliases)) where rn = 1"
)
def first_alias(spark: SparkSession, folder: str) -> DataFrame:
    """The first name under which each person of a case was seen."""
    a = table(spark, folder, "person_aliases", "alias_id", "case_id", "person_id", "strong_key", "name_literal").distinct()
    who = F.coalesce("strong_key", F.concat(F.lit("P:"), F.col("person_id").cast("string")))
    first = a.groupBy("case_id", who.alias("who")).agg(F.min(F.struct("alias_id", "name_literal")).alias("f"))
    return first.select("f.alias_id", "case_id", "f.name_literal")


@CATALOGUE.add(
    "select doc_id, doc_date from documents where doc_date is not null and (case when text is null then false else contains(" + _FOLD.format("text") + ", 'mora') end or coalesce(contains(" + _FOLD.format("office_code") + ", 'mora'), false))"
)
def accent_insensitive_search(spark: SparkSession, folder: str) -> DataFrame:
    """Dated documents that hold a word, case and accents aside."""
    d = table(spark, folder, "documents", "doc_id", "doc_date", "text", "office_code").where("doc_date is not null")
    return relational.contains_anywhere(d, "Mora", ["text", "office_code"]).select("doc_id", "doc_date")


@CATALOGUE.add(
    "with w as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents where text is not null), h as (select doc_id, w, list_position(list_transform(w, lambda x: starts_with("
    + _FOLD.format("x")
    + ", 'notificacion')), true) as i from w) select doc_id, array_to_string(list_slice(w, greatest(i - 6, 1)::bigint, (greatest(i - 6, 1) + 13)::bigint), ' ') as snippet from h where i > 0"
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """A window of fourteen words around the first hit of each document."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", snippet(F.col("text"), "notificacion").alias("snippet")).where("snippet is not null")


@CATALOGUE.add(
    "select doc_id, strftime(doc_date, '%d/%m/%Y') as day, replace(replace(replace(format('{:,}', n_chars), ',', '#'), '.', ','), '#', '.') as size from documents where doc_date is not null"
)
def spanish_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Dates and sizes as they are written in Spanish."""
    d = table(spark, folder, "documents", "doc_id", "doc_date", "n_chars").where("doc_date is not null")
    return d.select("doc_id", spanish_date(F.col("doc_date")).alias("day"), spanish_number(F.col("n_chars"), 0).alias("size"))


@CATALOGUE.add(
    "with f as (select distinct field_id, piece_id, field_name, literal, null_reason, page_no, state from piece_fields) select 'value_and_reason' as check, field_id::varchar as id from f where literal is not null and null_reason is not null"
    " union select 'neither_value_nor_reason', field_id::varchar from f where literal is null and null_reason is null union select 'value_without_page', field_id::varchar from f where literal is not null and page_no is null"
    " union select 'page_without_file', page_id::varchar from case_pages p where not exists (select 1 from case_files c where c.sha256 = p.file_sha)"
    " union select 'reading_without_page', reading_id::varchar from readings r where not exists (select 1 from case_pages p where p.page_id = r.page_id)"
    " union select 'word_without_reading', word_id::varchar from words w where not exists (select 1 from readings r where r.reading_id = w.reading_id)"
)
def invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that breaks a rule of the model; a sound data set gives no row."""
    return checks.violations(*[table(spark, folder, t) for t in ("case_files", "case_pages", "readings", "words", "piece_fields")])


@CATALOGUE.add(
    "with p as (select page_id, file_sha from case_pages where case_id = (select min(case_id) from case_files)), r as (select reading_id from readings where page_id in (select page_id from p))"
    " select 'pages' as part, count(*) as n from p union all select 'readings', count(*) from r union all select 'words', count(*) from words where reading_id in (select reading_id from r)"
)
def case_closure(spark: SparkSession, folder: str) -> DataFrame:
    """How much hangs from the first case along the foreign keys."""
    files = table(spark, folder, "case_files", "case_id")
    root = files.agg(F.min("case_id").alias("case_id"))
    found = relational.closure(
        root, "case_id",
        [("pages", table(spark, folder, "case_pages", "case_id", "page_id"), "case_id", "page_id"), ("readings", table(spark, folder, "readings", "page_id", "reading_id"), "page_id", "reading_id"),
         ("words", table(spark, folder, "words", "reading_id", "word_id"), "reading_id", "word_id")],
    )
    parts = [found[n].agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n in ("pages", "readings", "words")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@CATALOGUE.add(
    "select event_type, date_trunc('day', ts) as day, count(*) as n, count(distinct user_id) as users, round(sum(round(value * 100)) / 100, 2) as total from events group by all"
)
def events_per_day(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and day."""
    e = table(spark, folder, "events", "event_type", "ts", "user_id", "value")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum(F.round(F.col("value") * 100)) / 100, 2).alias("total")
    )


@CATALOGUE.add(
    "with o as (select user_id, ts, event_id, case when lag(ts) over w is null or ts > lag(ts) over w + interval 30 minute then 1 else 0 end as opens from events window w as (partition by user_id order by ts, event_id)),"
    " s as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from o) select user_id, session, count(*) as events, min(ts) as first, max(ts) as last from s group by all"
)
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user, closed by half an hour of silence."""
    e = table(spark, folder, "events", "user_id", "ts", "event_id")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 30 minutes"))
    s = e.withColumn("session", F.sum(opens.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@CATALOGUE.add(
    "select distinct case_id, trim(regexp_replace(upper(translate(name_literal, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY')), '[^A-Z0-9]+', ' ', 'g')) as name_key from person_aliases"
)
def compare_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a case in the form in which they are compared."""
    a = table(spark, folder, "person_aliases", "case_id", "name_literal")
    return a.select("case_id", compare_key(F.col("name_literal")).alias("name_key")).distinct()
