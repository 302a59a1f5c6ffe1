"""Subjects of documents: averaged word and subword embeddings with independent logistic outputs.

A paragraph is the average of the embeddings of its words, word pairs and character
4-grams (hashed into a fixed table); each subject has its own logistic output. Labels are
known for documents only, so a document has a subject if at least one paragraph has it:
its probability joins those of the paragraphs by noisy-or, and training sends the gradient
to the paragraphs that carry the subject.

Training is synchronous: in each step all partitions work out the gradient of their part of
a batch at the same parameters, the gradients are summed, and one Adagrad step follows.
Batches follow from doc_id, so that the result doesn't depend on the cluster but for the
rounding of sums. The labelled documents are a bounded sample (`max_labelled`) and are turned
into features once; scoring covers every paragraph of every document.

Defined results: null, empty and blank texts have no subject; labels of unknown documents
are ignored; a repeated doc_id counts once; without labels nothing is found; extra columns
are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

_MARKED, _PLAIN = "áéíóúüñàèìòùâêîôûãõç", "aeiouunaeiouaeiouaoc"
_WORD = re.compile(rf"[a-z0-9({_MARKED}]+")
_BREAK = re.compile(r"\n\s*\n")
_MARKS = str.maketrans(_MARKED, _PLAIN)
#: Rows of a table that are looked up at once.
_SLICE = 1 << 18


@dataclass
class Settings:
    """Size of the model and of its training."""

    buckets: int = 1 << 15
    dim: int = 16
    steps: int = 64
    #: Batches of a walk through the labelled documents; fewer where they would have less than `least` documents.
    batches: int = 8
    least: int = 64
    #: Partitions over which the gradient of a batch is worked out.
    shards: int = 4
    rate: float = 0.3
    #: Below one half, since missing labels pull the probabilities down.
    threshold: float = 0.15
    max_labelled: int = 20_000
    seed: int = 7


def summed(table: np.ndarray, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The sum of the table's rows per group; `group` ascends. Looks up a bounded number of rows at once."""
    out = np.zeros((groups, table.shape[1]), dtype=np.float32)
    for a in range(0, len(rows), _SLICE):
        g = group[a : a + _SLICE]
        starts = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
        out[g[starts]] += np.add.reduceat(table[rows[a : a + _SLICE]], starts, axis=0)
    return out


class Words(dict):
    """The number of each word met (-1 for those without meaning), its hash and its features; emptied by `trim`."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets
        self.hashes = array("Q")
        self.features: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        plain = word.translate(_MARKS)
        if plain.isdigit() or len(plain) < 2:
            got = -1
        else:
            framed = f"<{plain}>"
            keys = [plain] + [framed[i : i + 4] for i in range(len(framed) - 3) if len(plain) > 3]
            got = len(self.hashes)
            self.hashes.append(crc32(plain.encode()))
            self.features.append(np.array([crc32(k.encode()) % self.buckets for k in keys], dtype=np.int32))
        self[word] = got
        return got

    def trim(self, most: int = 200_000) -> bool:
        """Forget all words if there are too many."""
        if len(self) <= most:
            return False
        self.clear()
        self.hashes = array("Q")
        self.features.clear()
        return True


@dataclass
class Paragraphs:
    """The paragraphs of some documents that have words: word numbers and pair features with the paragraph of each."""

    words: np.ndarray
    of_word: np.ndarray
    pairs: np.ndarray
    of_pair: np.ndarray
    document: np.ndarray

    @classmethod
    def read(cls, texts: list[str], known: Words) -> Paragraphs:
        numbers, lengths, document = [], [], []
        for d, text in enumerate(texts):
            for part in _BREAK.split(text.lower()):
                if found := [n for w in _WORD.findall(part) if (n := known[w]) >= 0]:
                    numbers.append(np.array(found, dtype=np.int32))
                    lengths.append(len(found))
                    document.append(d)
        words = np.concatenate(numbers) if numbers else np.empty(0, dtype=np.int32)
        of_word = np.repeat(np.arange(len(lengths)), lengths)
        h = np.frombuffer(known.hashes, dtype=np.uint64)[words] if len(words) else np.empty(0, dtype=np.uint64)
        same = of_word[1:] == of_word[:-1]
        # Multiplicative hashing of two word hashes; the upper bits are the mixed ones.
        mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
        pairs = (mixed[same] % np.uint64(known.buckets)).astype(np.int32)
        return cls(words, of_word, pairs, of_word[1:][same], np.array(document, dtype=np.int64))

    def __len__(self) -> int:
        return len(self.document)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Embeddings, output weights and biases."""

    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, s: Settings, outputs: int) -> Model:
        rng = np.random.default_rng(s.seed)
        embed = rng.normal(0, 1.0 / s.dim, (s.buckets, s.dim)).astype(np.float32)
        weight = rng.normal(0, 0.5, (s.dim, outputs)).astype(np.float32)
        return cls(embed, weight, np.full(outputs, -3.0, dtype=np.float32))

    def outputs(self, mean: np.ndarray) -> np.ndarray:
        return _sigmoid(mean @ self.weight + self.bias)


class Scorer:
    """Probabilities of paragraphs; a word's features are summed once and remembered."""

    def __init__(self, model: Model, s: Settings):
        self.model, self.known = model, Words(s.buckets)
        self.sums, self.counts = np.empty((0, s.dim), dtype=np.float32), np.empty(0, dtype=np.int64)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The document and the probabilities of each paragraph."""
        if self.known.trim():
            self.sums, self.counts = self.sums[:0], self.counts[:0]
        p = Paragraphs.read(texts, self.known)
        if fresh := self.known.features[len(self.sums) :]:
            counts = np.array([len(f) for f in fresh])
            added = summed(self.model.embed, np.concatenate(fresh), np.repeat(np.arange(len(fresh)), counts), len(fresh))
            self.sums, self.counts = np.concatenate([self.sums, added]), np.concatenate([self.counts, counts])
        n = np.bincount(p.of_word, weights=self.counts[p.words], minlength=len(p)) + np.bincount(p.of_pair, minlength=len(p))
        total = summed(self.sums, p.words, p.of_word, len(p)) + summed(self.model.embed, p.pairs, p.of_pair, len(p))
        return p.document, self.model.outputs(total / np.maximum(n, 1)[:, None].astype(np.float32))


class Examples(NamedTuple):
    """Labelled documents as features, ready for gradients.

    `flat` has the features by paragraph (`of_flat`), `rows` the distinct ones, which stand
    `times` times each in the paragraphs that `of_row` lists.
    """

    flat: np.ndarray
    of_flat: np.ndarray
    rows: np.ndarray
    times: np.ndarray
    of_row: np.ndarray
    document: np.ndarray
    truth: np.ndarray

    @classmethod
    def read(cls, texts: list[str], truths: list[list[int]], places: dict[int, int], s: Settings) -> Examples:
        known = Words(s.buckets)
        p = Paragraphs.read(texts, known)
        sizes = np.array([len(f) for f in known.features], dtype=np.int64)[p.words]
        flat = np.concatenate([known.features[w] for w in p.words] + [p.pairs]) if len(p) else np.empty(0, dtype=np.int32)
        of_flat = np.concatenate([np.repeat(p.of_word, sizes), p.of_pair]).astype(np.int32)
        order = np.argsort(of_flat, kind="stable")
        by_row = np.argsort(flat, kind="stable")
        rows, times = np.unique(flat, return_counts=True)
        truth = np.zeros((len(texts), len(places)), dtype=np.float32)
        for d, listed in enumerate(truths):
            truth[d, [places[t] for t in listed]] = 1
        return cls(flat[order], of_flat[order], rows, times.astype(np.int32), of_flat[by_row], p.document.astype(np.int32), truth)

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in self]

    @classmethod
    def unpack(cls, parts: list[bytes], outputs: int) -> Examples:
        *whole, truth = parts
        return cls(*(np.frombuffer(a, dtype=np.int32) for a in whole), np.frombuffer(truth, dtype=np.float32).reshape(-1, outputs))

    def gradient(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct features, and the gradients of their embeddings, of the weights and of the biases."""
        n = np.bincount(self.of_flat, minlength=len(self.document))[:, None].astype(np.float32)
        mean = summed(m.embed, self.flat, self.of_flat, len(self.document)) / n
        p = np.clip(m.outputs(mean), 1e-6, 1 - 1e-6)
        starts = np.flatnonzero(np.diff(self.document, prepend=-1))
        none = np.repeat(np.exp(np.add.reduceat(np.log1p(-p), starts, axis=0)), np.diff(starts, append=len(p)), axis=0)
        whole = np.clip(1 - none, 1e-6, 1.0)
        slope = np.where(self.truth[self.document] > 0, -p * (none / whole), p).astype(np.float32)
        change = (slope @ m.weight.T / n).astype(np.float32)
        place = np.repeat(np.arange(len(self.rows)), self.times)
        return self.rows, summed(change, self.of_row, place, len(self.rows)), mean.T @ slope, slope.sum(axis=0)


class Adagrad:
    """The model with the sums of its squared gradients."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.sums = [np.full_like(a, 1e-4, dtype=np.float64) for a in (model.embed, model.weight, model.bias)]

    def step(self, embed: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> None:
        """One step down the summed gradients; outputs move more slowly than embeddings."""
        m = self.model
        for held, sums, change, rate in zip((m.embed, m.weight, m.bias), self.sums, (embed, weight, bias), (1.0, 0.3, 0.1), strict=True):
            sums += change**2
            held -= (rate * self.rate * change / np.sqrt(sums)).astype(np.float32)


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: list[int], s: Settings) -> Model:
    """Train on the labelled documents (doc_id, text) x (doc_id, subject_id)."""
    spark = documents.sparkSession
    places = {x: i for i, x in enumerate(subjects)}
    marks = labels.where(F.col("subject_id").isin(*subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_id")).alias("truth"))
    # The bound is on training data only: the documents with the smallest hashes.
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    # A few bytes a document: below this bound the texts needn't be shuffled to find theirs.
    sample = F.broadcast(sample) if s.max_labelled <= 100_000 else sample
    labelled = cut_lineage(
        documents.select("doc_id", "text").where("trim(text) <> ''").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("truth").alias("truth"))
    )
    batches = max(1, min(s.batches, labelled.count() // s.least))

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            read = Examples.read(list(b["text"]), list(b["truth"]), places, s)
            if len(read.document):
                yield pd.DataFrame({"parts": [read.pack()]})

    turn = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(batches))
    held = [cut_lineage(labelled.where(turn == i).repartition(s.shards).mapInPandas(prepare, "parts array<binary>")) for i in range(batches)]
    state = Adagrad(Model.fresh(s, len(subjects)), s.rate)

    def gradients(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Model(*shared.value)
            for b in frames:
                for parts in b["parts"]:
                    got = Examples.unpack(parts, len(places)).gradient(model)
                    yield pd.DataFrame({"parts": [[a.astype(k).tobytes() for a, k in zip(got, ("i4", "f4", "f4", "f4"), strict=True)]]})

        return run

    for step in range(s.steps):
        m = state.model
        shared = spark.sparkContext.broadcast((m.embed, m.weight, m.bias))
        # One row per partition of the batch: at most the size of the model each.
        moved = held[step % batches].mapInPandas(gradients(shared), "parts array<binary>").collect()
        shared.destroy()
        total = [np.zeros(a.shape, dtype=np.float64) for a in (m.embed, m.weight, m.bias)]
        for r in moved:
            rows = np.frombuffer(r.parts[0], dtype=np.int32)
            total[0][rows] += np.frombuffer(r.parts[1], dtype=np.float32).reshape(len(rows), s.dim)
            total[1] += np.frombuffer(r.parts[2], dtype=np.float32).reshape(m.weight.shape)
            total[2] += np.frombuffer(r.parts[3], dtype=np.float32)
        state.step(*total)
    return state.model


def classify_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, subject_id for every subject to which a paragraph of the document is devoted.

    `subjects` is the short list of subjects (at most 1,000, checked).
    """
    s = settings or Settings()
    listed = [r.subject_id for r in subjects.where("subject_id is not null").select("subject_id").distinct().orderBy("subject_id").limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1,000 subjects")
    spark = documents.sparkSession
    none = spark.createDataFrame([], "doc_id bigint, subject_id int")
    if not listed or labels.limit(1).count() == 0:
        return none
    model = fit_subjects(documents, labels, listed, s)
    shared = spark.sparkContext.broadcast((model.embed, model.weight, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*shared.value), s)
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                document, p = scorer.scores(list(part["text"]))
                paragraph, subject = np.nonzero(p >= s.threshold)
                pairs = np.unique(document[paragraph] * len(listed) + subject)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[pairs // len(listed)], "subject_id": np.array(listed, dtype=np.int32)[pairs % len(listed)]})

    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id bigint, subject_id int").distinct()
