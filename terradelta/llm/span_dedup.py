"""Operator 4: repeated passages by sliding spans of sentences.

A text is cut into sentences (behind ``.``, ``!`` or ``?`` before white space, and at newlines). Sentences of more than
LONG words are cut further, behind the word with the least hash of each LONG words in a row (winnowing), so that a
passage is found whose ends run into other sentences: where it is cut depends on its own words alone, but for ties. A
tie keeps the cut that stands, so that a word said over and over is cut each LONG words and not behind each word.

From each sentence on, and up to each sentence, the shortest run of at least RUN consecutive sentences that has
LEAST_WORDS words is hashed to 96 bits; the runs of all documents are joined, and a run that stands in several places is
kept in the first (by id, then text, then number). A longer run that repeats is covered by the shortest ones in it.
Sentences that any other occurrence covers are removed; all else, white space included, stays as it is. Fewer words make
chance repeats: of sf0.1's documents that share no 40 words with others, 32 % have two sentences in a row that stand
elsewhere too, 7 % three, and 2 % a run of 20 words.

Defined results: case and white space do not tell sentences apart; null texts stay null and empty texts empty; a text
that is shorter than a run has none; ids are whole numbers (others raise in the cast); null ids come first; rows that
agree in id and text are one document (the first place is in each of them); an empty table gives no rows; other columns
are not read. Among n different runs, about n * n / 2**97 pairs are mistaken for equal: 0.0003 for 100 TB.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lone, saved, texts

RUN, LEAST_WORDS = 2, 20
#: Longer sentences are cut, at least once in so many words.
LONG = 12
BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
WORD = re.compile(r"\S+")


def cuts(words: list[str]) -> list[int]:
    """Numbers of the words of a long sentence that it is cut behind: the least hash of each LONG words; of equal ones
    that which is cut already, else the last."""
    h = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
    out, at = [], -1
    for end in range(LONG, len(h) + 1):
        begin = end - LONG
        if at < begin:
            least = min(h[begin:end])
            at = end - 1
            while h[at] != least:
                at -= 1
            out.append(at)
        elif h[end - 1] < h[at]:
            at = end - 1
            out.append(at)
    return out


def sentences(text: str) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, end with the white space behind it, lower-case words) of a text's sentences that have words."""
    out: list[tuple[int, int, int, list[str]]] = []

    def add(start: int, end: int, after: int) -> None:
        words = text[start:end].lower().split()
        if len(words) <= LONG:
            if words:
                out.append((start, end, after, words))
            return
        begin, first, places = start, 0, [m.span() for m in WORD.finditer(text, start, end)]
        words = [text[x:y].lower() for x, y in places]
        for i in cuts(words):
            if i < len(words) - 1:
                out.append((begin, places[i][1], places[i + 1][0], words[first : i + 1]))
                begin, first = places[i + 1][0], i + 1
        out.append((begin, end, after, words[first:]))

    at = 0
    for m in BREAK.finditer(text):
        add(at, m.start(), m.end())
        at = m.end()
    add(at, len(text), len(text))
    return out


def run_ends(units: list[tuple[int, int, int, list[str]]], run: int, least_words: int) -> list[int]:
    """For each sentence that begins a run, the end of the run (number of the sentence behind it)."""
    out, end, words = [], 0, 0
    for i, u in enumerate(units):
        while end < len(units) and (words < least_words or end - i < run):
            words += len(units[end][3])
            end += 1
        if words < least_words or end - i < run:
            break
        out.append(end)
        words -= len(u[3])
    return out


def run_places(units: list[tuple[int, int, int, list[str]]], run: int, least_words: int) -> dict[int, tuple[int, int]]:
    """A text's runs, begin and end, by number: twice the first sentence's for the shortest run from a sentence on, and
    for the shortest run up to a sentence, if it is not also the former, one more than twice the last's."""
    ends = run_ends(units, run, least_words)
    out = {2 * i: (i, end) for i, end in enumerate(ends)}
    begin = 0
    for end in range(ends[0] if ends else len(units) + 1, len(units) + 1):
        while begin + 1 < len(ends) and ends[begin + 1] <= end:
            begin += 1
        if ends[begin] != end:
            out[2 * end - 1] = begin, end
    return out


def runs(text: str, run: int, least_words: int) -> list[tuple[int, bytes]]:
    """(number, digest) of a text's runs."""
    units = sentences(text)
    joined = [" ".join(u[3]) for u in units]
    return [(n, xxhash.xxh3_128_digest("\n".join(joined[i:end]).encode("utf-8", "surrogatepass"))) for n, (i, end) in run_places(units, run, least_words).items()]


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))


def span_table(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``h1``, ``h2`` (digest), ``doc_id``, ``version``, ``number`` for every run of every text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lone(batches, "spans"):
            sizes, numbers, digests = [], [], []
            for t in texts(part, "text"):
                found = runs(t or "", run, least_words)
                sizes.append(len(found))
                numbers += [i for i, _ in found]
                digests += [d for _, d in found]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            whose = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            made = [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(halves[:, 1].astype(np.int32)), part.column(0).take(whose), part.column(1).take(whose), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["h1", "h2", "doc_id", "version", "number"])

    return _source(docs, id_col, text).mapInArrow(make, "h1 long, h2 int, doc_id long, version long, number int")


def repeated(spans: DataFrame) -> DataFrame:
    """Per document with occurrences that are not the first: ``doc_id``, ``version``, ``runs`` (numbers).

    Counting goes by a part of the digest alone; only runs whose part occurs again are carried on, whole.
    """
    again = saved(spans.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "repeated-parts")
    spans = saved(spans.join(again, "h1"), "repeated-spans")
    place = F.struct("doc_id", "version", "number")
    # written, so that the join may split a run with many places
    first = saved(spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first"), "first-spans")
    later = spans.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "version").agg(F.collect_set("number").alias("runs"))


def remove_repeated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_removed``, ``removed`` (start and end of each removed sentence) and the ``text`` that
    stays."""
    spans = saved(span_table(docs, run, least_words, id_col, text), "spans")
    gone = repeated(spans).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "runs")
    rows = _source(docs, id_col, text)
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left").select("doc_id", "text", "runs")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lone(batches, "spans"):
            removed, out = [], []
            for t, first in zip(texts(batch, "text"), batch.column(2), strict=True):
                first = first.as_py()
                where = sentences(t) if first else []
                places = run_places(where, run, least_words)
                covered = sorted({i for n in first or () for i in range(*places[n])})
                removed.append([{"start": where[i][0], "end": where[i][1]} for i in covered])
                at, kept = 0, []
                for i in covered:
                    a, _, end, _ = where[i]
                    kept.append(t[at:a])
                    at = end
                out.append("".join([*kept, t[at:]]) if covered else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in removed], pa.int32()), pa.array(removed, kind), pa.array(out, pa.string())], ["doc_id", "n_removed", "removed", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_removed int, removed array<struct<start:int,end:int>>, text string")


def op4_spans(docs: DataFrame) -> DataFrame:
    """Every document, with the sentences of repeated passages removed."""
    out = remove_repeated(docs)
    return out.select("doc_id", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text")
