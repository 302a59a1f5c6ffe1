"""Repair of text read from scanned pages.

The words of a reading are put into lines by their boxes. Then, each word gets the first
kind that applies:

* `header`: words of a line at the edge of the page that runs through the file. The file's
  running lines are those that stand away from the left margin at the edge of some page, or
  whose wording does so in the corpus, and that are met on two pages of the file, up to
  misread characters, or in two files, up to digits; a line belongs to one if it equals it up
  to misread characters.
* `pageno`: words of an edge line (or the rest of a header line) that is a page or folio
  number with its label and total.
* `hyphen`: the last word of a line (or page) whose join with the next line's first word is
  a known word, while the parts are not, whatever mark stands at the break.
* `misread`: a rare word from which up to two confusions of characters lead to a much more
  frequent one. The anagram value of a word is the sum of the fifth powers of its character
  codes; a confusion of characters changes it by a fixed difference, so that an equi-join of
  values plus differences, one from either side, proposes the variants, which are then
  checked letter by letter and ranked by frequency.

`scan_paragraphs` then carries the repairs out: without headers and page numbers, with the
parts of broken words joined and the corrections put in, the lines become paragraphs.

Defined results: rows repeated exactly count once; words without box join the line before;
null or empty text is no case; a reading without words gives nothing; an empty table gives
an empty result; extra columns are ignored; lines and pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.edit import weighted_damerau
from folioscope.session import cut_lineage

# What a reading shows, and what the paper may hold instead.
CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("rri", "m"), ("cl", "d"), ("ii", "u"), ("li", "u"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"),
    ("c", "e"), ("e", "c"), ("(", "c"), ("b", "h"), ("h", "b"), ("y", "v"), ("f", "t"), ("t", "f"), ("g", "q"), ("9", "g"), ("5", "s"),
    ("8", "b"), ("2", "z"), ("6", "o"), ("6", "b"), ("m", "rn"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("vv", "w"), ("p", "r"), ("9", "q"), ("4", "a"), ("q", "g"), ("v", "y"),
    ("r1", "n"), ("f", "e"), ("6", "e"), ("(l", "d"), ("u", "ll"), ("fi", "ñ"), ("1i", "u"), ("i1", "u"),
    ("a~", "a"), ("e~", "e"), ("i~", "i"), ("o~", "o"), ("u~", "u"), ("n~", "ñ"),
)
# Marks that a break of a word may leave.
BREAK_MARKS = "-­¬‐‑–~_"
_SURE_MARKS = "­¬‐‑~_"
_EDGE = r"^[.,;:\[\]\"'¡!¿?«»$—–)…·]+|[.,;:\[\]\"'¡!¿?«»$—)…·]+$"
_EDGE_BRACKET = r"^[(.,;:\[\]\"'¡!¿?«»$—–)…·]+|[.,;:\[\]\"'¡!¿?«»$—)…·]+$"
_NUMBER_PREFIX = r"(?i)^[^0-9a-z]*(?:exp-)?"

_PAGE_LABEL = r"(?:f[s5]|fojas?|folio|hoja|p[aá][g9]|pagina|f[o0][jli]a|f[o0][il1][il1][o0]|h[o0]ja|fol)\b\.?"
_DIGIT = r"[0-9oilzsbg]"
_PAGE_NUMBER = re.compile(
    rf"(?:{_PAGE_LABEL}\s*(?:n\s*[°º]?\s*\.?\s*)?(?:-\s*)?{_DIGIT}{{1,4}}(?:\s*(?:/|de)\s*{_DIGIT}{{1,4}})?(?:\s*(?:[vy][tf]a|vuelta|bis))?\.?"
    rf"|-?\s*(?=[0-9oilzsbg/ -]*[0-9]){_DIGIT}{{1,4}}(?:\s*(?:/|de)\s*{_DIGIT}{{1,4}})?\s*-?(?:\s*[vy][tf]a\.?)?)"
)
_LABELLED_END = re.compile(rf"\s+(?:{_PAGE_LABEL}.*|-\s*[0-9]+\s*-|[0-9]{{1,3}}\s*(?:/|de)\s*[0-9]{{1,3}})$")


# What any page number holds, and how it can start: most lines are told to have none by these.
_HAS_NUMBER = re.compile(rf"[0-9]|{_PAGE_LABEL}")
_MAY_START = re.compile(rf"{_PAGE_LABEL}|[-0-9]|{_DIGIT}{{1,4}}(?![a-z])")


def _plain(text: str) -> str:
    return text.lower().translate(str.maketrans("áéíóúüñàè", "aeiouunae", "~"))


def is_page_number(text: str) -> bool:
    """Whether a line is a page or folio number."""
    return bool(_PAGE_NUMBER.fullmatch(_plain(text).strip()))


def _same_line(a: str, b: str) -> bool:
    """Equal up to misread characters."""
    if a == b:
        return True
    limit = 0.75 + 0.12 * max(len(a), len(b))
    return abs(len(a) - len(b)) <= limit and weighted_damerau(a, b, limit) <= limit


def _may_be_same(a: str, b: str, grams_a: Counter, grams_b: Counter) -> bool:
    """False only if `_same_line` is: a cost of 0.25 is the least that takes a pair of letters away."""
    longer = max(len(a), len(b))
    return (longer - 1 - (grams_a & grams_b).total()) * 0.25 <= 0.75 + 0.12 * longer


def lines_among(lines: list[str], running: list[str]) -> list[str]:
    """The lines that equal one of the running ones up to misread characters; what was met last is tried first."""
    grams = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    exact, order, found = set(running), [(r, grams(r)) for r in running], []
    for line in lines:
        if line in exact:
            found.append(line)
            continue
        own = grams(line)
        for i, (r, g) in enumerate(order):
            if _may_be_same(line, r, own, g) and _same_line(line, r):
                found.append(line)
                order.insert(0, order.pop(i))
                break
    return found


def repeated(running: list[tuple[str, int, int, bool]]) -> list[str]:
    """Of the candidates (line, first page, last page, seen in other files): those met on two pages or in other files.

    Lines that are equal up to misread characters count as one.
    """
    grams = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    kept, open_groups = [], []
    for line, first, last, elsewhere in sorted(running, key=lambda r: not (r[3] or r[1] != r[2])):
        own = grams(line)
        equal = lambda g: any(_may_be_same(line, r, own, h) and _same_line(line, r) for r, h in g)  # noqa: B023, E731
        if elsewhere or first != last or equal(kept):
            kept.append((line, own))
            continue
        group = next((g for g in open_groups if equal(g[1])), None)
        if group is None:
            open_groups.append([first, [(line, own)]])
        elif group[0] == first:
            group[1].append((line, own))
        else:
            kept += [*group[1], (line, own)]
            open_groups.remove(group)
    found = {r for r, _ in kept}
    return [r[0] for r in running if r[0] in found]


def edge_readings(words: list[str]) -> list[tuple[str | None, list[str]]]:
    """How an edge line can be read, best first: the running line it would hold (None: none needed) and the kinds."""
    line, n = _plain(" ".join(words)), len(words)
    if is_page_number(line):
        return [(None, ["pageno"] * n)]
    ways: list[tuple[str | None, list[str]]] = [(line, ["header"] * n)]
    if not _HAS_NUMBER.search(line):
        return ways
    plain = [_plain(w) for w in words]
    for cut in range(n - 1, 0, -1):
        head, tail = plain[: n - cut], plain[n - cut :]
        if _MAY_START.match(tail[0]) and is_page_number(" ".join(tail)):
            ways.append((" ".join(head), ["header"] * len(head) + ["pageno"] * cut))
        head, tail = plain[:cut], plain[cut:]
        if _MAY_START.match(head[0]) and is_page_number(" ".join(head)):
            ways.append((" ".join(tail), ["pageno"] * cut + ["header"] * len(tail)))
    return ways


def edge_kinds(words: list[str], held: set[str]) -> list[str | None]:
    """`header`, `pageno` or None for each word of an edge line; `held` has the running lines it may hold."""
    return next((list(k) for line, k in edge_readings(words) if line is None or line in held), [None] * len(words))


def bare(col: Column) -> Column:
    """Lower case without the punctuation around; an opening bracket stays, as it may be a misread c."""
    return F.regexp_replace(F.lower(col), _EDGE, "")


def lines_of(words: DataFrame, readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Each word once, with its line, place in the line, and the line's place on the page."""
    kept = ["word_id", "reading_id", "ord", "text", "x0", "y0", *[c for c in words.columns if c == "x1"]]
    order = W.partitionBy("reading_id").orderBy("ord", "word_id")
    # Repeats of a word stand side by side in the order of its reading.
    once = (
        words.where("word_id is not null and reading_id is not null and text <> ''").select(*kept)
        .withColumn("again", F.lag("word_id").over(order).eqNullSafe(F.col("word_id")))
        .where("not again")
    )
    jump = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(order)) > 5, F.lit(False))
    lined = once.drop("again").withColumn("line", F.sum(jump.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    in_line = W.partitionBy("reading_id", "line")
    placed = (
        lined.withColumn("place", F.row_number().over(in_line.orderBy("ord", "word_id")))
        .withColumn("width", F.count("*").over(in_line))
        .withColumn("last_line", F.max("line").over(W.partitionBy("reading_id")))
    )
    where = readings.select("reading_id", "page_id", "route").join(pages.select("page_id", "file_sha", "page_no"), "page_id")
    return placed.join(where, "reading_id")


def running_lines(placed: DataFrame, margin: float = 150.0, top: int = 4, bottom: int = 3, chunk: int = 2000) -> DataFrame:
    """reading_id, line, kinds: the kind of each word of the edge lines that have any.

    The edge of a page are its first `top` and last `bottom` lines; a line stands away from
    the left margin if it starts beyond `margin` points. Lines of a file are compared with its
    running lines in chunks of `chunk`, which bounds a row but leaves nothing out.
    """
    edge = placed.where((F.col("line") < top) | (F.col("line") > F.col("last_line") - bottom))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), " ")
    lines = cut_lineage(
        edge.groupBy("file_sha", "page_id", "reading_id", "line").agg(text.alias("text"), F.min_by("x0", "place").alias("x0"))
    )

    @F.pandas_udf("string")
    def header_part(t: pd.Series) -> pd.Series:
        plain = t.map(lambda s: _plain(s))
        return plain.map(lambda s: None if is_page_number(s) else _LABELLED_END.sub("", s))

    # Nothing but digits and marks is no running line.
    parts = lines.select("file_sha", "page_id", "x0", header_part("text").alias("part")).where("part rlike '[a-z].*[a-z].*[a-z]'")
    # Each line of a file once, before anything is compared.
    met = cut_lineage(
        parts.groupBy("file_sha", "part").agg(
            F.count("*").alias("n"), F.count_if(F.col("x0") > margin).alias("off"), F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.countDistinct("page_id").alias("pages")
        )
    )
    wording = F.regexp_replace("part", r"[0-9]", "#")
    corpus = (
        met.groupBy(wording.alias("wording")).agg(F.sum("n").alias("n"), F.sum("off").alias("off"), F.min("file_sha").alias("low"), F.max("file_sha").alias("high"))
        .where("off >= 2 and off * 5 >= n").select("wording", (F.col("low") < F.col("high")).alias("elsewhere"))
    )
    chosen = (
        met.where("file_sha is not null").withColumn("wording", wording).join(corpus, "wording", "left").where("off > 0 or elsewhere is not null")
        .select("file_sha", "part", "pages", "first", "last", F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"))
    )

    @F.pandas_udf("array<string>")
    def held(t: pd.Series) -> pd.Series:
        return t.map(lambda s: list({line for line, _ in edge_readings(s.split(" ")) if line is not None}))

    @F.pandas_udf("array<string>")
    def running_of(candidates: pd.Series) -> pd.Series:
        return candidates.map(lambda c: repeated([(r["part"], r["first"], r["last"], r["elsewhere"]) for r in c]))

    @F.pandas_udf("array<string>")
    def among(asked: pd.Series, running: pd.Series) -> pd.Series:
        return pd.Series([lines_among(list(a), list(r)) for a, r in zip(asked, running, strict=True)])

    @F.pandas_udf("array<string>")
    def kinds(t: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([edge_kinds(s.split(" "), set() if f is None else set(f)) for s, f in zip(t, found, strict=True)])

    # Lines meet the running lines of their file whose length allows it, by eights of the length.
    texts = lines.where("file_sha is not null").select("file_sha", "text").distinct()
    asked = cut_lineage(texts.select("file_sha", "text", F.explode(held("text")).alias("part")))
    n = F.length("part")
    slots = F.sequence(F.floor(F.greatest(F.lit(0), 0.88 * n - 0.75) / 8), F.floor((n + 0.75) / 0.88 / 8))
    known_parts = (
        chosen.select("file_sha", "part", "pages", "first", "last", "elsewhere", F.explode(slots).alias("slot")).groupBy("file_sha", "slot")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("order"), "part", "first", "last", "elsewhere"))).alias("candidates"))
        .select("file_sha", "slot", running_of("candidates").alias("running")).where("size(running) > 0")
    )
    turn = F.row_number().over(W.partitionBy("file_sha", "slot").orderBy("part"))
    by_slot = (
        asked.select("file_sha", "part", F.floor(n / 8).alias("slot")).distinct().withColumn("turn", F.floor((turn - 1) / chunk))
        .groupBy("file_sha", "slot", "turn").agg(F.collect_list("part").alias("asked"))
    )
    # Heavy for its few bytes: Spark would put it into too few tasks.
    met_lists = by_slot.join(known_parts, ["file_sha", "slot"]).repartition(placed.sparkSession.sparkContext.defaultParallelism)
    hits = met_lists.select("file_sha", F.explode(among("asked", "running")).alias("part"))
    found = asked.join(hits, ["file_sha", "part"]).groupBy("file_sha", "text").agg(F.collect_set("part").alias("found"))
    # Texts keep their own blanks out, so that the words can be told apart again.
    return (
        lines.join(found, ["file_sha", "text"], "left")
        .select("reading_id", "line", kinds("text", "found").alias("kinds"))
        .where(F.exists("kinds", lambda k: k.isNotNull()))
    )


def vocabulary(placed: DataFrame, pages: DataFrame) -> DataFrame:
    """word, n, native: how often a word stands within lines, and in native text."""
    inside = placed.where("place > 1 and place < width").select("text", (F.col("route") == "nativo").cast("int").alias("native"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for t in b["page_text"]:
                found.update(t.split())
            yield pd.DataFrame({"text": list(found), "n": list(found.values())})

    # Counted as written first, so that only distinct forms are stripped of their marks; whole texts are split batch by batch.
    indexed = pages.where("page_text is not null").select("page_text").mapInPandas(counted, "text string, n bigint").select("text", "n", F.lit(0).alias("native"))
    written = inside.select("text", F.lit(1).cast("bigint").alias("n"), "native").unionByName(indexed).groupBy("text").agg(F.sum("n").alias("n"), F.sum("native").alias("native"))
    return (
        written.where("text not like '(%'").select(bare(F.col("text")).alias("word"), "n", "native")
        .where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.sum("native").alias("native"))
    )


def broken_words(flow: DataFrame, vocab: DataFrame) -> DataFrame:
    """word_id of the first part of each word that a line or page end broke, next_id of the other part, joined form.

    `stem` is the first part as the whole word shows it. `compound` marks the compounds at a
    line end, which keep their hyphen and are no broken words.
    `flow`: the words of the running text (no headers, no page numbers).
    """
    order = W.partitionBy("reading_id").orderBy("line")
    end = F.struct("text", "word_id")
    lines = (
        flow.groupBy("reading_id", "line")
        .agg(F.min_by(end, "place").alias("first"), F.max_by(end, "place").alias("last"), F.first("file_sha").alias("file_sha"), F.first("page_no").alias("page_no"), F.first("route").alias("route"))
        .withColumn("next", F.lead("first").over(order))
        .withColumn("rank", F.row_number().over(order))
    )
    inner = lines.select("reading_id", "file_sha", "page_no", "route", "last.word_id", "last.text", "next")
    # The first line of the next page: of the same route if there is one.
    starts = (
        lines.where("rank = 1")
        .groupBy("file_sha", F.col("page_no").alias("of_page"), F.col("route").alias("of_route"))
        .agg(F.min("first").alias("over"))
    )
    over = starts.groupBy("file_sha", (F.col("of_page") - 1).alias("page_no")).agg(
        F.map_from_entries(F.collect_list(F.struct("of_route", "over"))).alias("over")
    )
    last = inner.join(over, ["file_sha", "page_no"], "left")
    next_word = F.coalesce(
        F.col("next"), F.try_element_at("over", F.col("route")), F.try_element_at("over", F.lit("ocr_a")), F.element_at(F.map_values("over"), 1)
    )
    parts = last.select("word_id", "text", next_word.alias("after")).select("word_id", "text", F.col("after.text").alias("next"), F.col("after.word_id").alias("next_id"))
    left = F.regexp_replace(bare(F.col("text")), f"[{BREAK_MARKS}]+$", "")
    parts = parts.select(
        "word_id",
        "next_id",
        "next",
        F.regexp_replace("text", f"[{BREAK_MARKS}]+$", "").alias("stem"),
        F.regexp_extract("text", f"([{BREAK_MARKS}])$", 1).alias("mark"),
        F.regexp_replace("text", r"[^.,;:)]", "").alias("stop"),
        left.alias("a"),
        bare(F.col("next")).alias("b"),
        (F.col("next").rlike(r"^[a-záéíóúñü(0-9]")).alias("lower"),
    ).where("length(a) > 0")
    parts = parts.withColumn("joined", F.concat("a", "b")).withColumn("compound", F.concat_ws("-", "a", "b"))
    # The four forms of a break are looked up together.
    forms = ("a", "b", "joined", "compound")
    asked = parts.select("word_id", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("word")) for f in forms])).alias("f")).select("word_id", "f.form", "f.word")
    counts = asked.distinct().join(vocab.select("word", "n"), "word").groupBy("word_id").agg(*[F.max(F.when(F.col("form") == f, F.col("n"))).alias(f"n_{f}") for f in forms])
    looked = parts.join(counts, "word_id", "left").na.fill(0, [f"n_{f}" for f in forms])
    marked = F.col("mark") != ""
    known = F.col("n_joined") > 0
    unknown_part = F.least("n_a", "n_b") * 50 <= F.col("n_joined")
    sure = F.col("mark").isin(*_SURE_MARKS)
    broken = (
        F.when(marked & (F.col("n_compound") > F.col("n_joined")), F.lit(False))
        .when(sure, F.length("a") > 1)
        .when(marked & known, F.lit(True))
        .when(marked, F.col("lower") & (F.least("n_a", "n_b") <= 2) & (F.length("a") > 1))
        .otherwise(known & unknown_part & F.col("lower") & (F.col("stop") == "") & (F.col("n_joined") >= 3))
    )
    compound = marked & (F.col("n_compound") > F.col("n_joined"))
    stem = F.when(compound, F.concat("stem", F.lit("-"))).otherwise(F.col("stem"))
    return looked.where(broken | compound).select("word_id", "next_id", stem.alias("stem"), F.concat(stem, "next").alias("joined"), compound.alias("compound")).distinct()


def _anagram(col: Column) -> Column:
    """Sum of the fifth powers of the character codes."""
    return F.aggregate(
        F.split(col, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c == "", 0).otherwise(F.pow(F.pmod(F.ascii(c), F.lit(1024)) + 1, F.lit(5))).cast("bigint")
    )


def _value(text: str) -> int:
    return sum((ord(c) % 1024 + 1) ** 5 for c in text)


def confusion_steps(shown: str, meant: str, most: int = 2) -> int | None:
    """How many confusions lead from the shown to the meant word; None if others are needed."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(shown) + 1):
        for j in range(len(meant) + 1):
            d = best.get((i, j))
            if d is None:
                continue
            if i < len(shown) and j < len(meant) and shown[i] == meant[j]:
                best[i + 1, j + 1] = min(best.get((i + 1, j + 1), 99), d)
            if d < most:
                for a, b in CONFUSIONS:
                    if shown.startswith(a, i) and meant.startswith(b, j):
                        k = (i + len(a), j + len(b))
                        best[k] = min(best.get(k, 99), d + 1)
    return best.get((len(shown), len(meant)))


def corrections(vocab: DataFrame, forms: DataFrame, ratio: float = 8.0, joined: DataFrame | None = None, frequent: int = 4) -> DataFrame:
    """word, correction: the most likely frequent variant of each rare or unknown form.

    `forms` has the distinct bare words of the readings with their counts (word, seen).
    `joined` has further forms to correct, which do not count as seen. A variant must be seen
    `frequent` times, and `ratio` times as often as the form; it is up to two confusions away.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("shown"), F.lit(b).alias("meant"), F.lit(_value(b) - _value(a)).alias("by")) for a, b in CONFUSIONS])
    no_accent = lambda c: F.translate(c, "áéíóúü", "aeiouu")
    often = vocab.select("word", "n").unionByName(forms.select("word", F.col("seen").alias("n"))).groupBy("word").agg(F.max("n").alias("n")).where(
        (F.col("n") >= frequent) & (F.length("word") >= 2)
    ).select(
        F.col("word").alias("meant"), no_accent(F.col("word")).alias("meant_plain"), F.col("n").alias("n_meant")
    )
    asked = forms if joined is None else forms.unionByName(joined.join(forms, "word", "left_anti"))
    rare = (
        asked.join(vocab, "word", "left")
        .select("word", F.coalesce("n", "seen").alias("n"), F.coalesce("native", F.lit(0)).alias("native"), no_accent(F.col("word")).alias("plain"))
        .where("native = 0 and length(word) >= 2 and word rlike '[a-z]'")
    )
    # The form plus one difference meets the variant minus another, each by the confusions whose characters it holds.
    differences = lambda text, side: F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.filter(steps, lambda c: text.contains(c[side])), lambda c: c["by"].cast("bigint")))))
    up = rare.withColumn("own", _anagram(F.col("plain"))).withColumn("delta", differences(F.col("plain"), "shown")).select("word", "plain", "n", (F.col("own") + F.col("delta")).alias("value"))
    down = often.withColumn("own", _anagram(F.col("meant_plain"))).withColumn("delta", differences(F.col("meant_plain"), "meant")).select("meant", "meant_plain", "n_meant", (F.col("own") - F.col("delta")).alias("value"))
    longer = F.length("plain") - F.length("meant_plain")
    proposed = up.join(down, "value").where((F.col("n_meant") >= F.col("n") * ratio) & (F.abs(longer) <= 4) & (F.col("word") != F.col("meant"))).select(
        "word", "plain", "meant", "meant_plain", "n_meant").distinct()

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([confusion_steps(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    checked = proposed.withColumn("steps", distance("plain", "meant_plain")).where("steps is not null and steps > 0")
    rank = F.struct(F.col("steps"), -F.col("n_meant"), F.col("meant"))
    return checked.groupBy("word").agg(F.min(rank)["meant"].alias("correction"))


def _put(text: Column, core: str, correction: Column) -> Column:
    """The text with the correction in place of its core: the case and the marks around stay."""
    upper, lower = (F.length(F.regexp_replace(text, rf"\P{{{k}}}", "")) for k in ("Lu", "Ll"))
    inside = F.regexp_replace(text, core, "")
    cased = (
        F.when((upper > lower) & (upper > 1), F.upper(correction))
        .when(inside.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(correction, 1, 1)), correction.substr(F.lit(2), F.length(correction))))
        .otherwise(correction)
    )
    head, tail = core.split("|")
    return F.concat(F.regexp_extract(text, head, 0), cased, F.regexp_extract(text, tail, 0))


def _in_digits(text: Column) -> Column:
    """A number with the letters in it as the digits they look like; the prefix of a file number stays."""
    prefix = F.regexp_extract(text, _NUMBER_PREFIX, 0)
    return F.concat(prefix, F.translate(text.substr(F.length(prefix) + 1, F.length(text)), "oOiIlLzZsSbBgG", "00111122556896"))


def _tagged(words: DataFrame, readings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed words with their kind at the edge, the vocabulary, and the parts of words to join."""
    placed = cut_lineage(lines_of(words, readings, pages))
    edges = cut_lineage(running_lines(placed))
    tagged = placed.join(edges, ["reading_id", "line"], "left").withColumn("kind", F.try_element_at("kinds", F.col("place"))).drop("kinds")
    tagged = cut_lineage(tagged)
    vocab = cut_lineage(vocabulary(tagged.where("kind is null"), pages))
    return tagged, vocab, cut_lineage(broken_words(tagged.where("kind is null"), vocab))


def _misread(tagged: DataFrame, vocab: DataFrame, links: DataFrame, joined: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """word_id, correction of the misread words, and the corrections of forms they come from."""
    broken = links.where("not compound").select("word_id")
    open_words = cut_lineage(tagged.where("kind is null").join(broken, "word_id", "left_anti").withColumn("word", bare(F.col("text"))))
    # An opening bracket may be a misread c or just a bracket: both forms are looked up.
    inner = F.regexp_replace("word", r"^\(+", "")
    open_words = open_words.withColumn("inner", inner)
    forms = open_words.select(F.explode(F.array_distinct(F.array("word", "inner"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("seen"))
    fixes = cut_lineage(corrections(vocab, forms, joined=joined))
    compact = F.regexp_replace(F.col("inner"), r"^exp-|[./,°º\-]", "")
    # A number with letters that look like digits, unless it reads as a code.
    number = compact.rlike(r"^[0-9oilzsbg]+$") & compact.rlike(r"[0-9]") & compact.rlike(r"[a-z]") & (
        F.length(F.regexp_replace(compact, r"[0-9]", "")) <= F.length(F.regexp_replace(compact, r"[a-z]", ""))
    ) & (F.length(compact) >= 2)
    direct = open_words.join(fixes, "word", "left").join(fixes.toDF("inner", "within"), "inner", "left")
    text = F.col("text")
    put = (
        F.when(F.col("correction").isNotNull(), _put(text, _EDGE, F.col("correction")))
        .when(F.col("within").isNotNull(), _put(text, _EDGE_BRACKET, F.col("within")))
        .when(number, _in_digits(text))
    )
    return direct.select("word_id", put.alias("correction")).where("correction is not null"), fixes


def scan_repairs(words: DataFrame, readings: DataFrame, pages: DataFrame) -> DataFrame:
    """word_id, kind of every word that a repair has to treat, and the text to put in its place.

    That is the whole word for the first part of a broken one; headers and page numbers have none.
    """
    tagged, vocab, links = _tagged(words, readings, pages)
    fixed, _ = _misread(tagged, vocab, links)
    return (
        tagged.where("kind is not null").select("word_id", "kind", F.lit(None).cast("string").alias("correction"))
        .unionByName(links.where("not compound").select("word_id", F.lit("hyphen").alias("kind"), F.col("joined").alias("correction")))
        .unionByName(fixed.select("word_id", F.lit("misread").alias("kind"), "correction"))
    )


def paragraph_starts(flow: DataFrame, links: DataFrame, gap: float = 1.4, short: float = 0.2) -> DataFrame:
    """reading_id, line, paragraph of the lines of the running text.

    A paragraph starts where the step between lines is more than `gap` times the usual one of
    the file, or after a line that had room for the next word and `short` of the width besides;
    never inside a broken word.
    """
    lines = flow.groupBy("file_sha", "reading_id", "line").agg(
        F.min_by("y0", "place").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min_by(F.col("x1") - F.col("x0"), "place").alias("first_width"), F.min_by("word_id", "place").alias("first_id"),
    )
    order, page = W.partitionBy("reading_id").orderBy("line"), W.partitionBy("reading_id")
    stepped = lines.withColumn("step", F.col("y") - F.lag("y").over(order))
    usual = stepped.where("step > 0").groupBy("file_sha").agg(F.percentile_approx("step", 0.5, 10000).alias("usual"))
    joined = links.select(F.col("next_id").alias("first_id"), F.lit(True).alias("joined")).distinct()
    right, width = F.max("x1").over(page), F.max("x1").over(page) - F.min("x0").over(page)
    room = F.lag("x1").over(order) + F.col("first_width") + F.lit(short) * width < right
    opens = (F.coalesce(F.col("step") > F.lit(gap) * F.col("usual"), F.lit(False)) | F.coalesce(room, F.lit(False))) & F.col("joined").isNull()
    told = stepped.join(usual, "file_sha", "left").join(joined, "first_id", "left").withColumn("opens", opens.cast("int"))
    return told.select("reading_id", "line", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("paragraph"))


def scan_paragraphs(words: DataFrame, readings: DataFrame, pages: DataFrame) -> DataFrame:
    """reading_id, paragraph (from 1), text: the paragraphs of each reading, repaired.

    A word that the page end broke stands whole where it begins, and its rest is taken from the
    reading of the next page that completes it. What has no correction stays as it was read.
    """
    tagged, vocab, links = _tagged(words, readings, pages)
    flow = tagged.where("kind is null")
    form = bare(F.col("joined"))
    fixed, fixes = _misread(tagged, vocab, links, links.where("not compound").groupBy(form.alias("word")).agg(F.count("*").alias("seen")).where("word <> ''"))
    order = W.partitionBy("reading_id").orderBy("line", "place")
    linked = flow.join(links.select("word_id", "next_id", "stem", "compound"), "word_id", "left").join(fixed, "word_id", "left")
    follows = F.coalesce(F.lag("next_id").over(order) == F.col("word_id"), F.lit(False))
    in_broken = F.coalesce(~F.col("compound"), F.lit(False)) | F.coalesce(follows & ~F.lag("compound").over(order), F.lit(False))
    # A word that ends a compound or stands alone is corrected by itself, a broken one as a whole.
    own = F.when(in_broken, F.coalesce("stem", "text")).otherwise(
        F.when(F.col("compound"), F.concat(F.regexp_replace(F.coalesce("correction", "text"), f"[{BREAK_MARKS}]+$", ""), F.lit("-"))).otherwise(
            F.coalesce("correction", "text")
        )
    )
    parts = linked.withColumn("own", own).withColumn("in_broken", in_broken).withColumn("unit", F.sum((~follows).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    units = cut_lineage(
        parts.groupBy("reading_id", "unit").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "place", "own"))), lambda p: p["own"]), "").alias("shown"),
            F.min_by("word_id", F.struct("line", "place")).alias("first_id"), F.min("line").alias("line"),
            F.max_by("next_id", F.struct("line", "place")).alias("over_id"),
            F.max_by("text", F.struct("line", "place")).alias("last_text"), F.count("*").alias("n"), F.max("in_broken").alias("whole"),
        )
    )
    # Over the page end: a unit that is itself the rest of a word takes nothing more.
    rests = units.join(units.where("over_id is not null").select(F.col("over_id").alias("first_id")).distinct(), "first_id", "left_semi")
    crossing = units.where("over_id is not null").join(rests.select("first_id"), "first_id", "left_anti")
    taken = cut_lineage(crossing.select("first_id", "over_id").join(rests.select(F.col("first_id").alias("over_id"), F.col("shown").alias("rest")), "over_id"))
    kept = units.join(taken.select("first_id", "rest"), "first_id", "left").join(taken.select(F.col("over_id").alias("first_id")).distinct(), "first_id", "left_anti")
    alone = F.col("over_id").isNotNull() & F.col("rest").isNull() & (F.col("n") == 1)
    kept = kept.withColumn("shown", F.when(alone, F.col("last_text")).otherwise(F.concat("shown", F.coalesce("rest", F.lit("")))))
    mended = kept.withColumn("word", F.when(F.col("whole"), bare(F.col("shown")))).join(fixes, "word", "left")
    mended = mended.withColumn("shown", F.when(F.col("correction").isNotNull(), _put(F.col("shown"), _EDGE, F.col("correction"))).otherwise(F.col("shown")))
    texts = mended.join(paragraph_starts(flow, links), ["reading_id", "line"]).groupBy("reading_id", "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "shown"))), lambda u: u["shown"]), " ").alias("text")
    )
    number = F.row_number().over(W.partitionBy("reading_id").orderBy("paragraph"))
    return texts.select("reading_id", number.alias("paragraph"), "text")
