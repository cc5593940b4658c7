"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bpe
from tracelake.llm.arrow import map_slices, strings

#: Characters whose class no version of Unicode changes; a text with others is
#: split by the library.
STABLE = re.compile(r"[^\u0000-\u024f\u2010-\u2027\u20ac]")
# Letters, numbers and white space among those, and the split
# pattern of byte-level vocabularies.
LETTER, NUMBER, SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
SPLIT = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[{LETTER}]+|[{NUMBER}]+|[^{SPACE}{LETTER}{NUMBER}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Pre-tokens whose counts a worker keeps; beyond that it starts anew.
CACHE = 400_000


class Counter:
    """Counts a text's tokens. Equal pre-tokens are merged once."""

    def __init__(self, tokenizer: str) -> None:
        self.path = bpe.resolve(tokenizer)
        self.merger = bpe.merger(self.path)
        special = self.merger.special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if not STABLE.search(text):
            return SPLIT.findall(text)
        found = bpe.library(self.path).pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, a token each."""
        if self.special is None or "<|" not in text:
            return self.split(text), 0
        pieces = self.special.split(text)
        return [t for p in pieces[::2] if p for t in self.split(p)], len(pieces) // 2

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.parts(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = list(set().union(*(p for p, _ in parts)) - self.known.keys())
        if new:
            _, counts = self.merger.merge([t.encode() for t in new])
            self.known.update(zip(new, counts.tolist(), strict=True))
        get = self.known.__getitem__
        return [n + sum(map(get, p)) for p, n in parts]


_counters: dict[str, Counter] = {}


def _step(tokenizer: str, limit: int):
    """Workers are used again, so their counter outlives a task."""
    if tokenizer not in _counters:
        _counters[tokenizer] = Counter(tokenizer)
    counter = _counters[tokenizer]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch.column(1))
        counts = np.array(counter.count(texts), np.int64)
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
            names=["id", "n_bytes", "n_tokens", "over_limit"],
        )

    return step


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    Counts are those of the tokenizers library without added tokens; special
    strings inside a text count one. A null text is empty and has no tokens;
    repeated rows and null ids are kept as they are; other columns aren't
    read. There is no shuffle, and memory is bounded by a slice of text (or
    one text, if that is longer) and by the cache.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    out = map_slices(df, "text", f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", partial(_step, tokenizer, limit))
    return out.withColumnRenamed("id", id_col)
