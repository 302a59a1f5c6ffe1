"""Linking the spellings of one person or firm within a case.

The words that carry identity (surnames, a firm's own name) of each case are sharded into
tries and joined with Levenshtein automata; names that share a neighbouring word are
candidates. Each candidate pair is then checked in every order of its words: given names
with nicknames, initials and typing errors, surnames, and for firms trade, branch and legal
form with their abbreviations. Identification numbers confirm or refute. A pair that only
fits because parts are missing is kept if it doesn't fit two different parties.

Defined results: names are compared exactly as stored, so strings that differ in case or
blanks are two spellings; null or blank names and null cases give no row; repeated rows
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.edit import weighted_damerau
from folioscope.functions.text import py_fold
from folioscope.llm.trie import Trie, bound_for
from folioscope.operators.graph import components
from folioscope.session import cut_lineage

# Given names and their familiar or short forms.
GIVEN = {
    "alejandro": "alejo ale", "antonio": "tono toni ant.", "beatriz": "betty bea", "cecilia": "ceci", "concepcion": "concha conce",
    "daniel": "dani", "dolores": "lola loli", "eduardo": "edu", "enrique": "quique", "ezequiel": "eze", "federico": "fede",
    "francisco": "paco pancho fco.", "gabriel": "gabi", "graciela": "grace chela", "guillermo": "willy guille gmo.", "hilda": "",
    "ignacio": "nacho", "irene": "", "jorge": "coco", "jose": "pepe", "julio": "", "katia": "", "luis": "lucho", "manuel": "manolo manu",
    "maria": "mary ma.", "mercedes": "mecha merce", "nicolas": "nico", "noemi": "mimi", "olga": "", "patricia": "patri pato",
    "roberto": "beto rob. tito", "rosario": "charo", "susana": "susi susy", "teresa": "tere", "ubaldo": "", "veronica": "vero",
    "victoria": "vicky", "walter": "", "yolanda": "yoli", "zulema": "zule", "juan": "juancho", "carlos": "carlitos", "pedro": "", "ana": "anita",
    "laura": "", "miguel": "migue", "rosa": "", "marta": "", "silvia": "", "pablo": "", "diego": "", "sergio": "", "ricardo": "richard",
    "elena": "", "raul": "", "oscar": "", "hector": "", "alberto": "", "monica": "moni", "claudia": "", "andrea": "", "fernando": "fer",
    "martin": "", "ramon": "moncho", "norma": "", "lucia": "", "sofia": "sofi", "alicia": "", "adriana": "adri",
}
# Trades in firm names with their abbreviations.
TRADES = {
    "agropecuaria": "agrop", "construcciones": "constr", "corralon": "corr", "distribuidora": "distrib", "electricidad": "electr",
    "ferreteria industrial": "ferret ind", "imprenta": "impr", "insumos hospitalarios": "ins hosp", "laboratorios": "labs",
    "libreria y papeleria": "libr y pap", "metalurgica": "metal", "repuestos": "rep", "servicios informaticos": "serv informat",
    "textil": "text", "transportes": "transp",
}
# Legal forms as they are written, longest first.
LEGAL = (
    ("soc por acc simplificada", "sas"), ("sociedad por acciones simplificada", "sas"), ("s a s", "sas"), ("sas", "sas"),
    ("soc de resp ltda", "srl"), ("sociedad de responsabilidad limitada", "srl"), ("s r l", "srl"), ("srl", "srl"),
    ("sociedad anonima", "sa"), ("s a", "sa"), ("sa", "sa"),
    ("y compania", "cia"), ("y cia", "cia"), ("e hijos", "hijos"), ("y hijos", "hijos"), ("e hs", "hijos"), ("y hs", "hijos"),
)
# Branches and their abbreviations.
BRANCHES = (("del valle", "valle"), ("del", "valle"), ("hermanos", "hermanos"), ("herm", "hermanos"), ("hnos", "hermanos"), ("norte", "norte"), ("sur", "sur"))
# Titles before names.
TITLES = frozenset("sr sra srta dr dra lic ing arq cpn prof".split())

_NICK = {n: full for full, nicks in GIVEN.items() for n in nicks.replace(".", "").split()}
_GIVEN_TRIE = Trie(GIVEN)
_TRADE_WORDS = {w: t for t in TRADES for w in t.split() if w != "y"}
_TRADE_SHORT = {s: w for t, short in TRADES.items() for s, w in zip(short.split(), t.split(), strict=True) if s != "y"}
_TRADE_TRIE = Trie(_TRADE_WORDS)
_FORM_TRIE = Trie(["norte", "hermanos", "hijos", "compania", "valle"])


class Party(NamedTuple):
    """A parsed name."""

    firm: bool
    given: tuple[str, ...]
    core: tuple[str, ...]
    trade: str
    branch: str
    legal: str


@lru_cache(maxsize=200_000)
def _given(word: str) -> str | None:
    """The listed given name a word stands for."""
    if word in GIVEN:
        return word
    if word in _NICK:
        return _NICK[word]
    # Mario isn't Maria mistyped, nor Daniela Daniel.
    other = lambda w: {word[-1], w[-1]} == {"a", "o"} or word == w + "a" or w == word + "a"
    near = sorted((weighted_damerau(word, w, 2.0), w) for w, _ in _GIVEN_TRIE.neighbours(word, 2 if len(word) > 3 else 0) if not other(w))
    most = 1.0 if len(word) < 5 else 2.0 if near and max(len(word), len(near[0][1])) > 6 and word[0] == near[0][1][0] else 1.3
    return near[0][1] if near and near[0][0] <= most else None


@lru_cache(maxsize=200_000)
def _near(word: str, trie: Trie, bound: int = 1) -> str | None:
    """The nearest word of a trie, neighbour swaps included."""
    found = sorted((weighted_damerau(word, w, 1.3), w) for w, _ in trie.neighbours(word, bound + 1))
    return found[0][1] if found and found[0][0] <= 1.0 else None


def words_of(name: str) -> list[str]:
    """The folded words of a name, without a title before it."""
    words = [w for w in re.split(r"[\s.,;:()\-/]+", py_fold(name).replace("&", " y ")) if w]
    return words[1:] if len(words) > 1 and words[0] in TITLES else words


def _without_legal(words: list[str]) -> tuple[list[str], str]:
    """The words without the legal form, and the form."""
    fixed = [(_near(w, _FORM_TRIE) or w) if len(w) > 4 else w for w in words]
    joined = " " + " ".join(fixed) + " "
    for written, form in LEGAL:
        if f" {written} " in joined and (joined.endswith(f" {written} ") or len(written) > 3):
            return joined.replace(f" {written} ", " ", 1).split(), form
    return fixed, ""


def _firm(words: list[str], legal: str, trades: set[str]) -> Party:
    joined, branch = " " + " ".join(words) + " ", ""
    for written, form in BRANCHES:
        if f" {written} " in joined:
            joined, branch = joined.replace(f" {written} ", " ", 1), form
            break
    return Party(True, (), tuple(w for w in joined.split() if w != "y"), min(trades) if trades else "", branch, legal)


def _person_ways(words: list[str], before: int, told: dict[str, str]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """The ways to share the words of a person out into given names and surnames, likeliest first.

    `before` is the number of words before a comma (0: no comma). What the comma doesn't say
    is told by initials, by the corpus (`told`), by the list of given names, and else by position:
    given names stand together, before the surnames or after them.
    """
    full = {w: _NICK.get(w, w) for w in words}
    if before:
        return [(tuple(_given(w) or w if len(w) > 1 else w for w in words[before:]), tuple(words[:before]))]
    sure = {w: "g" if len(w) == 1 or w in GIVEN or w in _NICK else told.get(w, "") for w in words}
    near = {w: g for w in words if not sure[w] and (g := _given(w))}
    n = len(words)

    def fits(k: int, given_first: bool, guess: bool) -> bool:
        wanted = ["g"] * k + ["c"] * (n - k) if given_first else ["c"] * (n - k) + ["g"] * k
        if all(len(w) == 1 for w, r in zip(words, wanted, strict=True) if r == "c"):
            return False
        return all((sure[w] or ("g" if guess and w in near else r)) == r or (len(w) == 1 and r == "c" and 0 < i < n - 1) for i, (w, r) in enumerate(zip(words, wanted, strict=True)))

    ways, seen = [], set()
    for guess in (True, False):
        for given_first in (True, False):
            # Of several shares the one with two given names at most and two surnames at most is likelier.
            for k in sorted(range(1, n), key=lambda k: (max(k, n - k) > 2, k)):
                if (k, given_first) not in seen and fits(k, given_first, guess):
                    seen.add((k, given_first))
                    given, core = (words[:k], words[k:]) if given_first else (words[n - k :], words[: n - k])
                    ways.append((tuple(near.get(w, full[w]) for w in given), tuple(core)))
    if not ways:
        # Given names on both sides, or nothing but given names.
        given = [near.get(w, full[w]) for w in words if len(w) == 1 or sure[w] == "g" or (w in near and not sure[w])]
        core = [w for w in words if not (len(w) == 1 or sure[w] == "g" or (w in near and not sure[w]))]
        if not core and n > 1:
            core = [words[-1]]
            given = [g for g in given if g != near.get(core[0], full[core[0]])]
        ways.append((tuple(given), tuple(core or words)))
    return ways


@lru_cache(maxsize=100_000)
def parse_party(name: str, hint: str = "") -> tuple[Party, ...]:
    """The ways to take a name apart, likeliest first.

    `hint` has what the corpus tells of its words, as `word:role` with roles g (given name),
    c (surname or a firm's own name) and t (trade).
    """
    told = dict(h.rsplit(":", 1) for h in hint.split())
    words = words_of(name)
    kept, legal = _without_legal(words)
    trades, rest = set(), []
    has_dots = "." in name
    for w in kept:
        known = w if w in _TRADE_WORDS else _TRADE_SHORT.get(w) if (legal or has_dots) else None
        if not known and len(w) > 5 and told.get(w) != "g":
            known = _near(w, _TRADE_TRIE)
        if known:
            trades.add(_TRADE_WORDS.get(known, known))
        else:
            rest.append(w)
    if legal or trades:
        return (_firm(rest, legal, trades),)
    if "t" in told.values() and "g" not in told.values() and not any(w in GIVEN for w in words):
        return (_firm(rest, legal, trades),)
    if len(words) < 2:
        return (Party(False, (), tuple(words), "", "", ""),)
    folded = py_fold(name)
    before = len(words_of(folded.split(",")[0])) if "," in folded and folded.split(",")[0].strip(" .") else 0
    return tuple(Party(False, g, c, "", "", "") for g, c in _person_ways(words, before if before < len(words) else 0, {w: r for w, r in told.items() if r != "t"}))


def _words_agree(a: str, b: str) -> bool:
    """Equal but for typing errors, or one an initial of the other."""
    if a == b:
        return True
    if min(len(a), len(b)) == 1:
        return a[0] == b[0]
    n = max(len(a), len(b))
    return weighted_damerau(a, b, 2.5) <= (1.0 if n < 7 else 2.0)


def _given_agree(a: str, b: str) -> bool:
    """Whether two given names may be one: equal, an initial, or, off the list, a typing error or a short form.

    Listed names are whole here, so two of them agree only if equal. Another last letter is
    another name (Mario, Maria), not a typing error.
    """
    if a == b or (min(len(a), len(b)) == 1 and a[0] == b[0]):
        return True
    if min(len(a), len(b)) < 3 or (a in GIVEN and b in GIVEN):
        return False
    short, long = sorted((a, b), key=len)
    if long.startswith(short) and len(long) >= len(short) + 2 and short not in GIVEN:
        return True
    return a[-1] == b[-1] and len(long) > 4 and weighted_damerau(a, b, 1.0) <= 1.0


def _stands_for(a: str, b: str) -> bool:
    """Whether two words of firm names are one, but for typing errors or an abbreviation by its first letters."""
    short, long = sorted((a, b), key=len)
    return _words_agree(a, b) or (len(short) > 2 and long.startswith(short))


def _firms(a: Party, b: Party) -> int:
    """The words of two firms, one by one in any order; what is left over on both sides tells them apart."""
    left, open_b = [], list(b.core)
    for x in a.core:
        y = next((y for y in open_b if x == y), None) or next((y for y in open_b if _stands_for(x, y)), None)
        if y:
            open_b.remove(y)
        else:
            left.append(x)
    if len(left) == len(a.core):
        return 0
    parts = ((a.trade, b.trade), (a.branch, b.branch), (a.legal, b.legal))
    if (left and open_b) or any(x and y and x != y for x, y in parts):
        return -1
    return 2 if not left and not open_b and all(x == y for x, y in parts) else 1


def _compare(a: Party, b: Party) -> int:
    if not a.core or not b.core:
        return 0
    if a.firm and b.firm:
        return _firms(a, b)
    if a.firm or b.firm:
        # A firm written without any mark of one: only if no word is left over.
        f, p = (a, b) if a.firm else (b, a)
        words = p.given + p.core
        return 1 if len(words) > 1 and len(words) == len(f.core) and not f.branch and _firms(f, Party(True, (), words, f.trade, "", f.legal)) == 2 else 0
    # Persons: the first surnames agree, and so do second surnames where both have one.
    if not _words_agree(a.core[0], b.core[0]) or len(a.core[0]) == 1:
        crossed = any(_words_agree(x, y) for x in a.core for y in b.core if min(len(x), len(y)) > 1)
        return -1 if crossed else 0
    if len(a.core) > 1 and len(b.core) > 1 and not _words_agree(a.core[1], b.core[1]):
        return -1
    if not a.given or not b.given:
        return 1
    # Initials may stand out of order after a surname; whole names keep theirs.
    if not _given_agree(a.given[0], b.given[0]):
        return -1
    if len(a.given) > 1 and len(b.given) > 1 and not _given_agree(a.given[1], b.given[1]):
        return -1
    whole = a.given[0] == b.given[0] and len(a.given[0]) > 1
    complete = len(a.given) == len(b.given) and len(a.core) == len(b.core)
    return 2 if whole and complete and all(min(len(x), len(y)) > 1 for x, y in zip(a.given, b.given, strict=True)) else 1


def compare(a: tuple[Party, ...], b: tuple[Party, ...]) -> int:
    """2: the same party; 1: fits, but parts are missing; 0: unlike; -1: alike but different.

    A pair fits if some way to take the two names apart makes it fit; if none does, the
    likeliest way decides between unlike and different.
    """
    best = max(_compare(x, y) for x in a for y in b)
    return best if best > 0 else _compare(a[0], b[0])


def same_number(a: str | None, b: str | None) -> bool | None:
    """Whether two identification numbers agree up to one mistyped digit; None if one is missing."""
    if not a or not b:
        return None
    return a == b or (len(a) == len(b) and weighted_damerau(a, b, 1.0, cheap=1.0) <= 1.0)


def decide(name_a: str, name_b: str, id_a: str | None, id_b: str | None, hint_a: str = "", hint_b: str = "") -> int:
    """`compare`, with the identification numbers and what the corpus tells of the words (see `parse_party`)."""
    level = compare(parse_party(name_a, hint_a), parse_party(name_b, hint_b))
    agree = same_number(id_a, id_b)
    bag_a, bag_b = (sorted(w for w in re.split(r"[\s.,]+", py_fold(n)) if w) for n in (name_a, name_b))
    if bag_a and bag_a == bag_b:
        return 3
    if agree:
        return 3 if id_a == id_b or level > 0 else level
    if agree is False:
        return -1
    return level


def id_core(col: Column) -> Column:
    """The eight digits of a person's or firm's number, whatever stands around them."""
    return F.nullif(F.regexp_extract(col, r"(\d{8})", 1), F.lit(""))


def names_of_cases(lines: DataFrame, fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """case_id, name and its most frequent number, once per spelling of a case."""
    none = F.lit(None).cast("string")
    each = (
        lines.select("case_id", F.col("supplier_name").alias("name"), id_core(F.col("supplier_tax_id")).alias("number"))
        .unionByName(fields.where("field_name = 'nombre'").select("case_id", F.col("literal").alias("name"), none.alias("number")))
        .unionByName(aliases.select("case_id", F.col("name_literal").alias("name"), id_core(F.col("strong_key")).alias("number")))
        .where("case_id is not null and trim(name) <> ''")
    )
    counted = each.groupBy("case_id", "name", "number").count()
    best = F.max(F.when(F.col("number").isNotNull(), F.struct("count", "number")))
    return counted.groupBy("case_id", "name").agg(best["number"].alias("number"))


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is heavy for its few bytes, which Spark would else put into too few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def trie_join(words: DataFrame, shard_words: int = 4000) -> DataFrame:
    """case_id, word_a, word_b (a <= b) for all words of a case within bounded edit distance.

    A case with more than `shard_words` words is split into several tries; each pair of
    shards is one group, so no group holds more than about twice that many words.
    """
    sizes = words.groupBy("case_id").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("shards"))
    placed = words.join(sizes, "case_id").withColumn("shard", F.pmod(F.xxhash64("word"), F.col("shards")).cast("int"))
    paired = placed.select(
        "case_id", "word", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    ).select("case_id", "word", "shard", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        case, lo, hi = group["case_id"].iat[0], group["lo"].iat[0], group["hi"].iat[0]
        trie = Trie(group.loc[group["shard"] == lo, "word"])
        found = [
            (case, min(w, n), max(w, n))
            for w in group.loc[group["shard"] == hi, "word"]
            for n, _ in trie.neighbours(w, bound_for(w))
            if lo != hi or w >= n or bound_for(n) < bound_for(w)
        ]
        return pd.DataFrame(found, columns=["case_id", "word_a", "word_b"])

    spread = paired.repartition(_tasks(words), "case_id", "lo", "hi")
    return spread.groupBy("case_id", "lo", "hi").applyInPandas(join, "case_id string, word_a string, word_b string").distinct()


def word_evidence(name: str) -> list[tuple[str, int, int, bool]]:
    """word, signs of a given name, signs of a surname, whether in a firm: for each word of a name that needs them.

    What follows a comma is a given name and what precedes it a surname; a word before an
    inner initial is a given name, one after leading initials a surname.
    """
    kept, legal = _without_legal(words_of(name))
    folded, out = py_fold(name), []
    before = len(words_of(folded.split(",")[0])) if "," in folded and not legal else 0
    for i, w in enumerate(kept):
        if len(w) < 2 or w in GIVEN or w in _NICK or w in _TRADE_WORDS or (len(kept) < 2 and not legal):
            continue
        given, core = 0, 0
        if before:
            given, core = (0, 2) if i < before else (2, 0)
        elif not legal and 0 < i and len(kept[i - 1]) == 1 and all(len(x) == 1 for x in kept[:i]):
            core = 2
        elif not legal and i == 0 and len(kept) > 2 and len(kept[1]) == 1 and len(kept[-1]) > 1:
            given = 1
        out.append((w, given, core, bool(legal)))
    return out


def word_roles(names: DataFrame, numbers: int = 10) -> DataFrame:
    """word, role over the whole corpus: g (given name), c (surname or own name), t (trade); unclear words have no row.

    A trade is a word of firms that stands in those of at least `numbers` identification numbers.
    """

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*e, i) for n, i in zip(b["name"], b["number"], strict=True) for e in word_evidence(n)]
            yield pd.DataFrame(rows, columns=["word", "g", "c", "firm", "number"])

    told = names.select("name", "number").mapInPandas(tell, "word string, g int, c int, firm boolean, number string")
    sums = told.groupBy("word").agg(
        F.sum("g").alias("g"), F.sum("c").alias("c"), F.count_if("firm").alias("f"), F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("firm"), F.col("number"))).alias("numbers")
    )
    role = (
        F.when((F.col("numbers") >= numbers) & (F.col("f") * 2 > F.col("n")), "t")
        .when((F.col("g") >= 2) & (F.col("g") >= 3 * F.col("c")), "g")
        .when((F.col("c") >= 2) & (F.col("c") >= 3 * F.col("g")), "c")
    )
    return sums.select("word", role.alias("role")).where("role is not null")


def with_hints(names: DataFrame) -> DataFrame:
    """The names with the roles that the corpus gives to their words (see `parse_party`)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, w) for n in b["name"] for w, *_ in word_evidence(n)], columns=["name", "word"])

    words = names.select("name").distinct().mapInPandas(split, "name string, word string")
    told = words.join(word_roles(names), "word").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "word", "role"))), " ").alias("hint"))
    return names.join(told, "name", "left").select("case_id", "name", "number", F.coalesce("hint", F.lit("")).alias("hint"))


def keys_of(name: str, hint: str) -> set[tuple[str, str]]:
    """(word, first letter of the given name) under which a name meets those it may equal.

    The letter is `*` where there is no given name and `#` for firms. A trade is no key if
    there is another word; a name of single letters only is its own key.
    """
    ways, found = parse_party(name, hint), set()
    trades = {h[:-2] for h in hint.split() if h.endswith(":t")}
    for way in ways:
        words = [w for w in way.core if len(w) > 1]
        words = [w for w in words if w not in trades] or words
        found |= {(w, "#" if way.firm else way.given[0][0] if way.given else "*") for w in words}
    if not ways[0].firm and 1 < len(ways[0].given + ways[0].core) and len(ways) > 1:
        found |= {(w, "#") for w in ways[0].given + ways[0].core if len(w) > 1}
    return found or {(" ".join(sorted(words_of(name))) or py_fold(name), "*")}


def link_parties(names: DataFrame) -> DataFrame:
    """case_id, name_a, name_b: every pair of spellings of a case that mean the same party.

    What was found equal is closed under transitivity, except for pairs that were found different.
    """

    def core_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, n, i, h, w, k) for c, n, i, h in b[["case_id", "name", "number", "hint"]].itertuples(index=False, name=None) for w, k in keys_of(n, h)]
            yield pd.DataFrame(rows, columns=["case_id", "name", "number", "hint", "word", "letter"])

    words = cut_lineage(with_hints(names).mapInPandas(core_words, "case_id string, name string, number string, hint string, word string, letter string"))
    near = trie_join(words.select("case_id", "word").distinct())

    def side(word: str, starred: str, lettered: str, name: str) -> DataFrame:
        # Names meet by equal letters; one without given name meets all.
        star = F.when(F.col("letter") == "*", starred).otherwise(lettered)
        return words.select("case_id", F.col("word").alias(word), F.explode(F.array(F.concat(F.lit("="), "letter"), star)).alias("by"), F.struct("name", "number", "hint").alias(name))

    candidates = (
        near.join(side("word_a", "right", "left", "x"), ["case_id", "word_a"])
        .join(side("word_b", "left", "right", "y"), ["case_id", "word_b", "by"])
        .where("x.name <> y.name")
        .select("case_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .repartition(_tasks(names), "case_id", "a", "b")
        .distinct()
    )

    @F.pandas_udf("int")
    def level(a: pd.Series, b: pd.Series, i: pd.Series, j: pd.Series, g: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([decide(*row) for row in zip(a, b, i, j, g, h, strict=True)], dtype="int32")

    judged = cut_lineage(
        candidates.select("case_id", F.col("a.name").alias("a"), F.col("b.name").alias("b"), level("a.name", "b.name", "a.number", "b.number", "a.hint", "b.hint").alias("level"))
        .where("level <> 0")
    )
    both = judged.unionByName(judged.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"), "level"))
    sure = judged.where("level >= 2")
    # A pair with missing parts is dropped if one of its names also fits a party that the other refutes.
    weak = both.where("level = 1")
    fits = both.where("level >= 1").select("case_id", "a", F.col("b").alias("c"))
    refuted = both.where("level = -1").select("case_id", "b", F.col("a").alias("c"))
    unclear = (
        weak.join(fits, ["case_id", "a"])
        .where("c <> b")
        .join(refuted, ["case_id", "b", "c"], "left_semi")
        .select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    kept = sure.select("case_id", "a", "b").unionByName(
        judged.where("level = 1").select("case_id", "a", "b").join(unclear, ["case_id", "a", "b"], "left_anti")
    )
    node = lambda c: F.concat_ws("\x01", "case_id", c)
    parties = components(kept.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    placed = parties.select("component", F.split("node", "\x01").alias("n")).select("component", F.col("n")[0].alias("case_id"), F.col("n")[1].alias("name"))
    placed = cut_lineage(placed)
    pairs = placed.toDF("component", "case_id", "a").join(placed.toDF("component", "case_id", "b"), ["component", "case_id"]).where("a < b")
    apart = judged.where("level = -1").select("case_id", "a", "b")
    return pairs.select("case_id", "a", "b").join(apart, ["case_id", "a", "b"], "left_anti").toDF("case_id", "name_a", "name_b")
