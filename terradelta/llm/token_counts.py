"""Operator 8: token counts by a map-side lookup in two tiers, without a shuffle of words.

The first tier is a compact table of the token counts of all texts' commonest words, broadcast; the second is a cache in each worker, filled by the tokenizer for words that the table lacks. Both only save work: every
text is counted whole, and every count is the library's.

A word here is a run without white space. The file's normaliser and pre-tokenizer never look across white space, so a
text has the tokens of its words. Texts with the control characters 1C to 1F, on whose nature Python and the library
differ, go to the library whole.

Defined results: null and empty texts have no bytes and no tokens; an empty table gives no rows; rows repeat as they
are; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, texts
from .tokens import _single_thread, in_groups

#: Words in the table, and the length of the longest of them: longer ones are left to the cache and the tokenizer.
TABLE_WORDS, TABLE_LENGTH = 50_000, 256
#: Words in a worker's cache before it starts anew.
CACHED = 600_000
#: Different words that a task counts before it hands its counts on.
COUNTED = 200_000
ODD = re.compile("[\x1c-\x1f]")


class Counts:
    """Token counts of words: a fixed table, then a cache, then the tokenizer."""

    def __init__(self, path: str, words: list[str], lengths: bytes):
        self.tk = _single_thread(Tokenizer.from_file(path))
        self.table = dict(zip(words, lengths, strict=True))
        self.cache: dict[str, int] = {}

    def _tokens(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tk.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, group: list[str]) -> list[int]:
        cut = [None if ODD.search(t) else t.split() for t in group]
        met = set().union(*(w for w in cut if w)).difference(self.table).difference(self.cache)
        if len(self.cache) + len(met) > CACHED:
            self.cache = {}
            met = set().union(*(w for w in cut if w)).difference(self.table)
        if met:
            new = list(met)
            self.cache.update(zip(new, self._tokens(new), strict=True))
        both = {**self.cache, **self.table} if len(group) > 500 else None
        out = []
        for t, w in zip(group, cut, strict=True):
            if w is None:
                out.append(self._tokens([t])[0])
            elif both is not None:
                out.append(sum(map(both.__getitem__, w)))
            else:
                table, cache = self.table, self.cache
                out.append(sum([table[x] if x in table else cache[x] for x in w]))
        return out


def frequent_words(docs: DataFrame, path: str, text: str = "text", size: int = TABLE_WORDS) -> tuple[list[str], bytes]:
    """The commonest words of all rows, at most ``size`` (of equals the lesser ones), with their token counts (up to 255).

    Every text is counted whole; a task sums its words first, so that only different words are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("word counts", None, lambda: None)
        seen: Counter = Counter()

        def counts() -> pa.RecordBatch:
            short = {w: n for w, n in seen.items() if len(w) <= TABLE_LENGTH}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(short.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in texts(batch, "text"):
                seen.update(t.split())
                if len(seen) > COUNTED:
                    yield counts()
        yield counts()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = _single_thread(Tokenizer.from_file(path))
        top = [w for batch in batches for w in batch.column(0).to_pylist()]
        pairs = [(w, len(e)) for w, e in zip(top, tk.encode_batch_fast(top, add_special_tokens=False), strict=True) if len(e) < 256]
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in pairs]], pa.list_(pa.string())), pa.array([bytes(n for _, n in pairs)], pa.binary())], ["words", "lengths"])

    every = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    top = every.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    got = top.select("word").mapInArrow(measure, "words array<string>, lengths binary").collect()
    return (list(got[0]["words"]), bytes(got[0]["lengths"])) if got else ([], b"")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held("counts", (path, hash(table.value[1])), lambda: Counts(path, *table.value))
        for batch in batches:
            n = []
            for group in in_groups((t or "" for t in texts(batch, "text"))):
                n += counts(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return one.mapInArrow(run, f"doc_id {one.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")


def op8_token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    return count_tokens(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
