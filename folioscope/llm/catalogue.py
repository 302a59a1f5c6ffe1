"""Mapping typed descriptions to the entries of a canonical list.

A symmetric-delete dictionary of the list's words is built once (its size is that of the
list, not of the data) and broadcast. Every word of a description is looked up in it within
a bounded edit distance, as an abbreviation, or as a known synonym; hits are ranked by
weighted Damerau-Levenshtein distance and the number of entries that use the word. An
entry is named if each of its words is met by another word of the description and no
number or variant of the description is left over. Among several, the cheapest wins, then
the entry people assigned most often, then the smaller id.

Defined results: a null, empty or unrecognised description gives item 0; repeated lines
give one row; an empty list gives 0 everywhere; extra columns are ignored; descriptions of
any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.edit import weighted_damerau
from folioscope.functions.text import py_fold

# Words that say nothing about the good.
STOP = frozenset("de del la el en para tipo p y o con_ adq compra provision reng item".split())
# Other names of goods; the right side is written with words of the list.
SYNONYMS = {
    "tubo": "cano", "caneria": "cano", "ssd": "disco solido", "cuerda": "soga", "tapaboca": "barbijo",
    "foco": "lampara", "lapicera": "bolígrafo", "birome": "bolígrafo", "guantes": "guante", "resmas": "resma",
    "acumulador": "bateria", "neumatico": "cubierta", "diesel": "gasoil", "hipoclorito": "lavandina", "gte": "guante",
    "rma": "resma", "son": "sin",
}
# A name that means another good only beside a certain word.
PAIRED_SYNONYMS = {("llave", "termomagnetico"): "interruptor"}
# Shapes that a bad reading gives to a letter, and the letter.
_SHAPES = (("rn", "m"), ("r1", "n"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("0", "o"), ("1", "l"), ("5", "s"), ("(", "c"), ("9", "g"), ("8", "b"), ("6", "b"), ("2", "z"), ("fi", "n"))
_DIGITS = str.maketrans("oil", "011")
# Letters that sound alike.
_SOUNDS = (("ll", "y"), ("z", "s"), ("ce", "se"), ("ci", "si"), ("v", "b"), ("x", "b"), ("k", "c"), ("qu", "c"), ("h", ""), ("fi", "n"))

_CONTAINER = "caja|paquete|pack|rollo|bobina|bolsa|saco|balde|lata|bidon|tambor|botella|pallet"
_TAIL = re.compile(
    r"\s*(?:marca:.*|[-,(\[]*\s*(?<![a-z])(?:presentacion|contenido|medido en|precio por|cant\. expresada en|por)\s[^()\[\]]*[)\]]?"
    rf"|\(?(?:(?:{_CONTAINER})(?:\s+(?:de|x))?|x)\s+[0-9][0-9.,]*\s*(?!mm\b|cm\b|m\b(?!2)|x[0-9])[a-z][a-z0-9./]*(?:\s+c[a-z]+)?\)?)\s*$"
)
_ROLL_TAIL = re.compile(rf"(?<=\S)\s+\(?(?:(?:{_CONTAINER})(?:\s+(?:de|x))?|x)\s+[0-9][0-9.,]*\s*[a-z][a-z0-9./]*(?:\s+cuadrados|\s+cubicos)?\)?\s*$")
_REMARK = re.compile(r"\b(?:o similar|s/muestra|segun pliego|1ra calidad|p/ deposito)\b|^(?:reng\.?\s*\d+\s*:?|item\s*\d*\s*:?)")
_HINT = re.compile(rf"presentac|contenid|medido|precio|expresada|\(por| por | x [0-9]|(?:{_CONTAINER}) |similar|muestra|pliego|calidad|dep|^reng|^item")
_MARKS = str.maketrans("áéíóúüñàèìòùâêîôûãõç²³", "aeiouunaeiouaeiouaoc23")
_NUMBER = re.compile(r"[0-9][0-9.,/x\-]*")
_NUMBER_UNIT = re.compile(r"([0-9]+(?:[.,/x-][0-9]+)*)([a-z%].*)")
_INNER_DOT = re.compile(r"([a-z]{2,})\.([a-z])")
_EDGE = "()[]{},;:.-/\"'"


def _skeleton(word: str) -> str:
    for shape, letter in _SHAPES:
        word = word.replace(shape, letter)
    return word


def _sound(word: str) -> str:
    for letters, sound in _SOUNDS:
        word = word.replace(letters, sound)
    return word


def _deletes(word: str, depth: int) -> set[str]:
    """The word and what remains after deleting up to `depth` letters."""
    out, edge = {word}, {word}
    for _ in range(depth):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def _depth(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2


class Catalogue:
    """The symmetric-delete dictionary and the matcher; pickled once to each worker."""

    def __init__(self, entries: list[tuple[int, str, int]]):
        """`entries`: id, name, how often people assigned it."""
        self.words: dict[int, tuple[str, ...]] = {}
        self.usage = {i: n for i, _, n in entries}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for item, name, _ in entries:
            words = tuple(w for w in self.split(py_fold(name), None) if w not in STOP)
            if not words:
                continue
            self.words[item] = words
            for w in set(words):
                self.by_word[w].append(item)
        self.codes = {w for w in self.by_word if any(c.isdigit() for c in w)}
        self.containers = [w for w in _CONTAINER.split("|") if w in self.by_word]
        self.plain = [w for w in self.by_word if w not in self.codes]
        self.synonyms = {k: py_fold(v).split() for k, v in SYNONYMS.items()}
        self.deletes: dict[str, set[str]] = defaultdict(set)
        for w in [*self.plain, *self.synonyms, *STOP]:
            for form in {w, _skeleton(w), _sound(w)}:
                for d in _deletes(form, _depth(w)):
                    self.deletes[d].add(w)
        self.prefixes: dict[str, set[str]] = defaultdict(set)
        for w in self.plain:
            for n in range(3, len(w)):
                self.prefixes[w[:n]].add(w)
        self.prefix_deletes: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for prefix, words in self.prefixes.items():
            for d in _deletes(prefix, 1):
                self.prefix_deletes[d] |= {(w, prefix) for w in words}
        self.shapes = {w: (_skeleton(w), _sound(w)) for w in [*self.plain, *self.synonyms, *STOP]}
        self.memo: dict[str, dict[str, float]] = {}
        self.known: dict[tuple[str, ...], int] = {}

    def split(self, text: str, codes: set[str] | None) -> list[str]:
        """Words of a folded text; numbers stand apart from the unit behind them."""
        out: list[str] = []
        for raw in text.split():
            t = raw.strip(_EDGE)
            if raw.endswith("."):
                t += "."
            if not t or t == ".":
                continue
            bare = t.rstrip(".")
            if codes is not None and (m := _INNER_DOT.fullmatch(bare)):
                out.append(m[1] + m[2] + ".")
            elif codes is not None and bare in codes:
                out.append(bare)
            elif codes is not None and bare[0].isdigit() and (number := bare.translate(_DIGITS)) in codes:
                out.append(number)
            elif codes is not None and len(bare) >= 3 and bare[0].isdigit() and bare[1:2].isalpha() and bare[1:] not in self.by_word and self.lookup(bare):
                out.append(bare)
            elif (m := _NUMBER_UNIT.fullmatch(bare)) and not (codes is None and len(m[2]) > 3):
                if codes is None and re.fullmatch(r"[0-9]+[a-z][0-9]*", bare) and m[2] not in ("mm", "cm", "m", "w", "gb", "g"):
                    out.append(bare)
                else:
                    out.append(m[1].rstrip("x-"))
                    rest = m[2]
                    out.extend([rest] if codes is None or rest != "%" else ["%"])
            else:
                out.append(t)
        return out

    def trim(self, most: int = 300_000) -> None:
        """Forget remembered results beyond a bound, so that a worker's memory stays flat."""
        for kept in (self.memo, self.known):
            if len(kept) > most:
                kept.clear()

    def lookup(self, token: str) -> dict[str, float]:
        """The list's words that a typed word may mean, with the cost of each."""
        got = self.memo.get(token)
        if got is None:
            got = self.memo[token] = self._lookup(token)
        return got

    def _lookup(self, token: str) -> dict[str, float]:
        short = token.endswith(".")
        word = token.rstrip(".")
        if word in self.by_word:
            found = {word: 0.0}
        elif word in STOP or word in self.synonyms:
            found = {}
        elif word.isdigit() or _NUMBER.fullmatch(word):
            return {}
        else:
            found = {}
        if word in STOP:
            return {"": 0.0}
        if word in self.synonyms:
            return {w: 0.05 for w in self.synonyms[word]}
        if found:
            return found
        best: dict[str, float] = {}
        letters = sum(c.isalpha() for c in word)
        if letters >= 2:
            skeleton, sound = _skeleton(word), _sound(word)
            near: set[str] = set()
            for form in {word, skeleton, sound}:
                for d in _deletes(form, _depth(word)):
                    near |= self.deletes.get(d, set())
            for w in near:
                limit = 1.0 if len(w) < 4 else 1.3 if len(w) < 5 else 2.0 if len(w) < 6 else 2.3
                c = weighted_damerau(word, w, limit)
                if c > 0.6:
                    shape, heard = self.shapes[w]
                    if skeleton != word:
                        c = min(c, 0.3 + weighted_damerau(skeleton, w, limit))
                    if skeleton != word or shape != w:
                        c = min(c, 0.3 + weighted_damerau(skeleton, shape, limit))
                    if sound != word or heard != w:
                        c = min(c, 0.4 + weighted_damerau(sound, heard, limit))
                if c <= limit:
                    for target in self.synonyms.get(w, ["" if w in STOP else w]):
                        best[target] = min(best.get(target, 9.0), c + 0.02 * (w in self.synonyms))
        if 3 <= len(word):
            for form in {word, _skeleton(word)}:
                for w in self.prefixes.get(form, ()):
                    best[w] = min(best.get(w, 9.0), 0.3 if short else 0.9)
            if short:
                for form in _deletes(word, 1):
                    for w, prefix in self.prefix_deletes.get(form, ()):
                        if (c := 0.4 + weighted_damerau(word, prefix, 1.0)) <= 1.4:
                            best[w] = min(best.get(w, 9.0), c)
        return best

    def tokens(self, description: str) -> list[str]:
        """The words of a description that speak of the good."""
        text = " ".join(description.lower().translate(_MARKS).split())
        brand = text.find("marca:")
        if brand > 0:
            text = text[:brand].rstrip()
        while _HINT.search(text):
            cut = _TAIL.sub("", _REMARK.sub(" ", text).strip()).strip()
            if cut == text or not cut:
                break
            text = cut
        return self.split(text.replace(" p/ ", " ").removeprefix("p/ "), self.codes)

    def match(self, description: str | None) -> int:
        """The id of the entry that the description names, or 0."""
        if not description:
            return 0
        tokens = tuple(self.tokens(description))
        got = self.known.get(tokens)
        if got is None:
            got = self.known[tokens] = self._search(list(tokens))
        if not got and (named := [w for w in self.containers if w in description.lower() and w not in tokens]):
            # What looked like a container may be part of the name.
            got = self._search([*tokens, *named])
        return got

    def _search(self, tokens: list[str]) -> int:
        # A thermomagnetic "llave" is a switch, not a tap.
        if "termomagnetico" in {w for t in tokens for w in self.lookup(t)}:
            tokens = ["interruptor" if "llave" in self.lookup(t) else t for t in tokens]
        moved = self.respace(tokens)
        keys = [k for k in (self._match(tokens), self._match(moved) if moved != tokens else None) if k]
        got = min(keys)[2] if keys else 0
        if not got and (m := _ROLL_TAIL.search(text := " ".join(tokens))):
            key = self._match(text[: m.start()].split())
            got = key[2] if key else 0
        return got

    def respace(self, tokens: list[str]) -> list[str]:
        """The words after moving misplaced blanks: two words of the list in one or in two wrong parts."""
        out, i = [], 0
        while i < len(tokens):
            t, pair = tokens[i], None
            if t not in self.by_word:
                for joined, n in ((t, 1), (t + tokens[i + 1], 2)) if i + 1 < len(tokens) else ((t, 1),):
                    cuts = [(joined[:p], joined[q:], n) for p in range(1, len(joined)) for q in (p, p + 1)]
                    pair = next((c for c in cuts if c[0] in self.by_word and c[1] in self.by_word), None)
                    if pair:
                        break
            if pair:
                out += pair[:2]
                i += pair[2]
            else:
                out.append(t)
                i += 1
        return out

    def _match(self, tokens: list[str]) -> tuple[float, int, int] | None:
        """(cost, -use, id) of the best entry."""
        wanted: dict[str, list[tuple[float, int]]] = defaultdict(list)
        heavy = []
        for i, t in enumerate(tokens):
            hits = self.lookup(t)
            for w, c in hits.items():
                if w:
                    wanted[w].append((c, i))
            heavy.append(0.0 if "" in hits else 9.0 if t[0].isdigit() else 0.9)
        seen: dict[int, int] = defaultdict(int)
        for w in wanted:
            for item in self.by_word.get(w, ()):
                seen[item] += 1
        best: tuple[float, int, int] | None = None
        for item, n in seen.items():
            words = self.words[item]
            if n < len(set(words)):
                continue
            used: dict[int, float] = {}
            cost = 0.0
            for w in sorted(words, key=lambda w: len(wanted[w])):
                free = [(c, i) for c, i in wanted[w] if i not in used] or (
                    [(c + 0.05, i) for c, i in wanted[w] if self.is_compound(tokens[i])]
                )
                if not free:
                    cost = 99.0
                    break
                c, i = min(free)
                used[i] = c
                cost += c
            left = sum(h for i, h in enumerate(heavy) if i not in used)
            if left > 1.8:
                continue
            total = cost + left
            if total <= 1.2 + 0.9 * len(words):
                key = (round(total, 6), -self.usage.get(item, 0), item)
                best = min(best, key) if best else key
        return best

    def is_compound(self, token: str) -> bool:
        """Whether one typed word stands for several words of the list."""
        return len(self.synonyms.get(token.rstrip("."), ())) > 1 or len(self.lookup(token)) > 1 and any(
            set(v) <= set(self.lookup(token)) for v in self.synonyms.values() if len(v) > 1
        )


def match_catalogue(lines: DataFrame, items: DataFrame, max_entries: int = 50_000) -> DataFrame:
    """line_id, item_id (0: none) of every line without item.

    `lines`: line_id, description, item_id; `items`: item_id, item_name. The list is
    collected and broadcast; more than `max_entries` entries raise, as the dictionary
    would no longer be small.
    """
    spark = lines.sparkSession
    usage = lines.where("item_id is not null").groupBy("item_id").agg(F.countDistinct("line_id").alias("n"))
    rows = (
        items.where("item_id is not null and item_name is not null")
        .groupBy("item_id").agg(F.min("item_name").alias("item_name"))
        .join(usage, "item_id", "left")
        .select("item_id", "item_name", F.coalesce("n", F.lit(0)).alias("n"))
        .limit(max_entries + 1)
        .collect()
    )
    if len(rows) > max_entries:
        raise ValueError(f"the list has more than {max_entries} entries")
    shared = spark.sparkContext.broadcast(Catalogue([(r.item_id, r.item_name, r.n) for r in sorted(rows)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        catalogue = shared.value
        for b in batches:
            catalogue.trim()
            found = [catalogue.match(d) for d in b["description"]]
            yield pd.DataFrame({"line_id": b["line_id"], "item_id": pd.Series(found, dtype="int64")})

    return (
        lines.where("item_id is null and line_id is not null")
        .select("line_id", "description")
        .mapInPandas(run, "line_id bigint, item_id bigint")
        .distinct()
    )
