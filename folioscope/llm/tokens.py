"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the file that is used unless told otherwise.
TOKENIZERS, VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of byte-level vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file, read once per worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str, blanks: int = 10_000) -> int:
    """Tokens of a whole text.

    The splitting pattern walks back over white space, which overflows its stack on very long
    runs. A run of at least `blanks` is therefore taken as the one piece that the pattern makes
    of it: all of it but the last character, which goes with what follows.
    """
    if not text:
        return 0
    enc, total, at = encoder(path), 0, 0
    for run in regex.finditer(rf"\p{{White_Space}}{{{blanks},}}", text):
        end = run.end() - (run.end() < len(text))
        total += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(enc.encode_ordinary(text[at:]))


def with_tokens(documents: DataFrame, *keep: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, the columns to keep, and n_tokens; one row per doc_id, null texts have 0 tokens."""
    schema = documents.select("doc_id", *keep).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["n_tokens"] = [count_tokens(t, path) for t in b["text"]]
            yield b[["doc_id", *keep, "n_tokens"]]

    need = documents.where(F.col("doc_id").isNotNull()).select("doc_id", *keep, "text")
    sized = need.mapInPandas(run, f"{schema}, n_tokens bigint")
    others = [F.min_by(F.struct(*keep, "n_tokens"), "n_tokens").alias("v")] if keep else [F.min(F.struct("n_tokens")).alias("v")]
    return sized.groupBy("doc_id").agg(*others).select("doc_id", "v.*")
