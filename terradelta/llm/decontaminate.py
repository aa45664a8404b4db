"""Operator 3: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by one space; the automaton holds every window of ``width`` consecutive
words of every benchmark item (a shorter item is one window) between spaces, and reads each normalised text once. Hits
map back through word numbers to offsets in the original text.

Defined results: null and empty texts have no words and no hits; items without words are never found; equal windows of
several items count for each of them; repeated item rows count once; items without id hit words, but are not among the
items found; an empty benchmark leaves every document clean. The benchmark's size is counted first. Up to PART_BYTES it
is one automaton, which goes to the workers by broadcast. A larger one is cut into parts of that size, which are read
one after another: each part's hits are written as ranges of words, and all parts' ranges are united by document in the
end, so that neither the driver nor a worker ever holds more than one part.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, parts, saved, utf8

#: Word bytes: digits, letters, and all bytes of other characters; A-Z become a-z, the rest a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text in one automaton at most.
PART_BYTES = 32 << 20

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows(raw: bytes, width: int) -> set[str]:
    w = words(raw)
    return {b" ".join(w[i : i + width]).decode() for i in range(max(1, len(w) - width + 1))} if w else set()


def automaton(items: list[tuple[str | None, str]], width: int) -> ahocorasick.Automaton:
    owners: dict[str, set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows((text or "").encode(), width):
            owners[window].update(() if item is None else (item,))
    out = ahocorasick.Automaton()
    for window, who in owners.items():
        out.add_word(f" {window} ", (window.count(" ") + 1, tuple(sorted(who))))
    if owners:
        out.make_automaton()
    return out


def scan(machine: ahocorasick.Automaton, raw: bytes) -> tuple[int, np.ndarray, set[str]]:
    """Words of a text, a flag for each that is in an occurrence (empty: none), and the items found."""
    w = words(raw)
    hit, found = np.zeros(0, bool), set()
    if not w or not len(machine):
        return len(w), hit, found
    normal = (b" " + b" ".join(w) + b" ").decode()
    starts = None
    for end, (n, items) in machine.iter(normal):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
            edge = np.zeros(len(w) + 1, np.int32)
        last = int(np.searchsorted(starts, end))  # the window's words end before this one
        edge[last - n] += 1
        edge[last] -= 1
        found.update(items)
    if starts is not None:
        hit = np.cumsum(edge[:-1]) > 0
    return len(w), hit, found


def spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of the runs of words that are hit."""
    out: list[list[int]] = []
    before = False
    for m, is_hit in zip(WORD.finditer(raw.decode().translate(_LOWER)), hit, strict=True):
        if is_hit and before:
            out[-1][1] = m.end()
        elif is_hit:
            out.append([m.start(), m.end()])
        before = bool(is_hit)
    return [(a, b) for a, b in out]


_LOWER = {c: c + 32 for c in range(65, 91)}


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """The different items (``item_id``, ``text``) in tables of about ``part_bytes``; one table if they are as few as usual."""
    items = saved(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct(), "benchmark")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _scanner(spark: SparkSession, part: DataFrame, width: int) -> Callable[[], ahocorasick.Automaton]:
    """Gives a worker its automaton of one part."""
    items = sorted((tuple(r) for r in part.collect()), key=repr)
    shared = spark.sparkContext.broadcast(items)
    name = hashlib.sha256(repr((items, width)).encode()).hexdigest()
    return lambda: held("benchmark", name, lambda: automaton(shared.value, width))


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _part_hits(rows: DataFrame, machine: Callable[[], ahocorasick.Automaton]) -> DataFrame:
    """``doc_id``, ``version``, ``items`` and ``hit`` (ranges of words) of the rows that one part hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [scan(machine(), raw) for raw in utf8(batch, "text")]
            some = [i for i, (_, hit, _) in enumerate(found) if len(hit)]
            made = [pa.array([sorted(found[i][2]) for i in some], pa.list_(pa.string())), pa.array([_ranges(found[i][1]) for i in some], _RANGES)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(some, pa.int64())) for k in (0, 1)] + made, ["doc_id", "version", "items", "hit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, version long, items array<string>, hit array<struct<start:int,end:int>>")


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, with_text: bool = False) -> DataFrame:
    """Per document row: ``doc_id``, its words, words hit, items found and the spans (character offsets) of the hits, and
    ``text`` if wanted."""
    tables = benchmark_parts(benchmark, part_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["doc_id", "n_words", "n_hit", "items", "spans", *["text"][:with_text]]

    def judged(batch: pa.RecordBatch, found: Iterator[tuple[int, np.ndarray, set[str]]]) -> pa.RecordBatch:
        out = [(n, int(hit.sum()), sorted(items), [{"start": a, "end": b} for a, b in (spans(raw, hit) if hit.any() else [])]) for raw, (n, hit, items) in zip(utf8(batch, "text"), found, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.string()), _RANGES), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[1:][:with_text]], names)

    if len(tables) == 1:
        machine = _scanner(docs.sparkSession, tables[0], width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                yield judged(batch, (scan(machine(), raw) for raw in utf8(batch, "text")))

        return rows.mapInArrow(run, f"doc_id {kind}, {HITS}{', text string' * with_text}")

    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text")
    hits = [saved(_part_hits(rows, _scanner(docs.sparkSession, t, width)), "part-hits") for t in tables]
    together = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_set("hit"))).alias("hit"))
    together = together.select(F.col("doc_id").alias("of"), F.col("version").alias("at"), "items", "hit")
    joined = rows.join(together, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("at")), "left").select("doc_id", "text", "items", "hit")

    def united(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        for raw, items, ranges in zip(utf8(batch, "text"), batch.column(2), batch.column(3), strict=True):
            n = len(words(raw))
            hit = np.zeros(n, bool)
            for r in ranges.as_py() or ():
                hit[r["start"] : r["end"]] = True
            yield n, hit, set(items.as_py() or ())

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield judged(batch, united(batch))

    return joined.mapInArrow(unite, f"doc_id {kind}, {HITS}{', text string' * with_text}")


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document against every benchmark item, windows of ten words."""
    hits = find_hits(docs, benchmark)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
