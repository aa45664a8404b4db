"""Operator 2: near-equal lines by a segment-partition edit join.

Lines within EDITS edits of each other are linked. Each distinct line is cut into EDITS + 1 segments, which are its
index entries (by its length, the segment's number and text); if two lines are within EDITS edits, at least one segment
of the shorter stands unchanged in the longer, near its own place. Each line therefore probes the index of its own
length and of the EDITS lengths below with the few substrings that the places of the edits allow (after Li and others,
Pass-Join, 2011). A 64-bit sketch of letter pairs, which EDITS edits change in at most 4 * EDITS bits, is tested inside
the join, and what leaves it is verified with banded bit-parallel edit distance.

A class is a connected component of links (equal lines are one node); its first line by id and number stays, the others
are removed.

Defined results: lines are cut at newlines and stripped; all that are not blank are classed. Lines of fewer than NEAR
characters, of which EDITS edits would be more than a sixth, are in a class only with equal ones and have no links; null and empty texts have no lines; null ids come first; rows that agree in id and text are one document; an
empty table gives no rows. Distinct lines are told apart by 64-bit hashes: among n distinct lines, about n * n / 2**65
pairs are mistaken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lone, saved, small, texts
from .components import components

EDITS, LEAST = 2, 1
#: Lines from this length on are linked by edits, shorter ones only classed with equal ones.
NEAR = 12


def eligible(text: str | None, least: int = LEAST) -> list[tuple[int, str]]:
    """(number, line) of the lines that are classed."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if len(s := x.strip()) >= least]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line)


@lru_cache(maxsize=20_000)
def segments(length: int, edits: int) -> tuple[tuple[int, int], ...]:
    """(start, size) of a line's segments: sizes differ by one at most, the longer ones last."""
    n = edits + 1
    size, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        s = size + (i >= n - longer)
        out.append((at, s))
        at += s
    return tuple(out)


@lru_cache(maxsize=20_000)
def index_plan(length: int, edits: int) -> tuple[tuple[int, int, int], ...]:
    """(seed, start, end) of a line's index entries."""
    return tuple((length * 64 + i, at, at + size) for i, (at, size) in enumerate(segments(length, edits)))


@lru_cache(maxsize=20_000)
def probe_plan(length: int, edits: int) -> tuple[tuple[int, int, int], ...]:
    """(seed, start, end) of the substrings that a line looks up: in segment i of a line shorter by d, with at most i edits
    before it and at most ``edits`` - i behind it."""
    out = []
    for d in range(min(edits, length - edits - 1) + 1):
        for i, (at, size) in enumerate(segments(length - d, edits)):
            low, high = max(at - i, at + d - (edits - i), 0), min(at + i, at + d + (edits - i), length - size)
            out += [((length - d) * 64 + i, p, p + size) for p in range(low, high + 1)]
    return tuple(out)


def sketches(lines: list[str]) -> np.ndarray:
    """For each line, one bit for each of 64 classes of letter pairs: whether it has an odd number of that class."""
    flat = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = ((flat[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[1:] + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(1) << (pair >> np.uint64(58))
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    out = np.bitwise_xor.reduceat(bits, starts)
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel over a band of diagonals (after Myers and Hyyrö)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    end = 0
    while end < len(a) and a[-1 - end] == b[-1 - end]:
        end += 1
    if end:
        a, b = a[:-end], b[:-end]
    if len(a) <= edits:
        return _plain(a, b) <= edits
    # in column j the window's bits are the rows j - edits - 1 to j + edits of the longer text, the lowest bit first
    width = 2 * edits + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    up, down = ((1 << (edits + 1)) - 1) << (edits + 1), 0
    score, last = edits, top
    for j, c in enumerate(a):
        shift, known = j - edits - 1, places.get(c, 0)
        match = (known >> shift if shift >= 0 else known << -shift) & mask
        same = ((((match & up) + up) ^ up) | match | down) & mask
        plus, minus = (down | ~(same | up)) & mask, same & up
        if j < len(b) - edits:  # down the window's last diagonal
            score += not same & top
        else:  # along the text's last row, which moves up in the window
            last >>= 1
            score += bool(plus & last) - bool(minus & last)
        up, down = (minus | ~((same >> 1) | plus)) & mask, (same >> 1) & plus
    return score <= edits


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``version`` tells rows of one id apart by their texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))


def occurrences(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``version``, ``line_no``, ``line`` (its hash) for every line that is classed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lone(batches, "lines"):
            whose, number, ids = [], [], []
            for at, t in enumerate(texts(batch, "text")):
                for i, s in eligible(t, least):
                    whose.append(at)
                    number.append(i)
                    ids.append(line_id(s))
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), _signed(ids)], ["doc_id", "version", "line_no", "line"])

    return _source(docs, id_col, text).mapInArrow(run, "doc_id long, version long, line_no int, line long")


def distinct_lines(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``line`` (hash), ``words`` (its text): distinct within each task, so that no line has more rows than tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in lone(batches, "lines"):
            ids, lines = [], []
            for t in texts(batch, "text"):
                for _, s in eligible(t, least):
                    if (k := line_id(s)) not in seen:
                        seen.add(k)
                        ids.append(k)
                        lines.append(s)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([_signed(ids), pa.array(lines, pa.string())], ["line", "words"])

    return _source(docs, id_col, text).select("text").mapInArrow(run, "line long, words string")


#: Hashes that a task remembers to leave out repeated lines early.
SEEN = 200_000


def _entries(lines: DataFrame, plan, edits: int) -> DataFrame:
    """``key``, ``line``, ``sketch``: index entries or probes of lines that are dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for part in lone(batches, "lines", 2000):
            kept, ids = [], []
            for k, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if k not in seen:
                    seen.add(k)
                    kept.append(s)
                    ids.append(k)
            if len(seen) > SEEN:  # a line that comes again has its entries twice, and its pairs are made distinct later
                seen.clear()
            if not kept:
                continue
            keys, sizes = [], []
            for s in kept:
                places = plan(len(s), edits)
                sizes.append(len(places))
                keys += [digest(s[a:b], seed) for seed, a, b in places]
            repeat = np.repeat(np.arange(len(kept)), sizes)
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(np.array(ids, np.int64)[repeat]), pa.array(sketches(kept).view(np.int64)[repeat])], ["key", "line", "sketch"])

    return lines.mapInArrow(run, "key long, line long, sketch long")


def linked_lines(docs: DataFrame, edits: int = EDITS, least: int = NEAR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``a`` < ``b`` (hashes) of different lines within ``edits`` edits."""
    if least <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    lines = distinct_lines(docs, least, id_col, text)
    dealt = lines.repartition("line")
    index, probes = _entries(dealt, index_plan, edits), _entries(dealt, probe_plan, edits)
    index = index.select("key", F.col("line").alias("x"), F.col("sketch").alias("sx"))
    probes = probes.select("key", F.col("line").alias("y"), F.col("sketch").alias("sy"))
    near = F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= 4 * edits
    pairs = index.join(probes, (index["key"] == probes["key"]) & (F.col("x") != F.col("y")) & near)
    pairs = saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    wanted = saved(wanted, "wanted-lines")
    words = lines.join(small(wanted, wanted.count()), "line", "left_semi").groupBy("line").agg(F.min("words").alias("words"))
    words = saved(words, "line-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lone(batches, "lines"):
            fits = [within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    both = pairs.join(words.select(F.col("line").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("line").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def near_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line that is classed: ``doc_id``, ``version``, ``line_no``, ``class_id`` (a hash), ``n_links`` (other lines
    within the edits), ``kept`` (whether it is the first of its class)."""
    links = saved(linked_lines(docs, edits, max(least, NEAR), id_col, text), "line-links")
    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    # this table and that of first lines are written, so that the joins with them may split a very common line
    facts = saved(found.join(degree, "node").select(F.col("node").alias("line"), F.col("component").alias("class_id"), "n_links"), "line-facts")
    lines = saved(occurrences(docs, least, id_col, text), "lines").join(facts, "line", "left")
    lines = lines.select("doc_id", "version", "line_no", F.coalesce("class_id", "line").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    place = F.struct("doc_id", "version", "line_no")
    first = lines.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("members")).filter("members > 1").select("class_id", "first")
    return lines.join(saved(first, "first-lines"), "class_id", "left").select("doc_id", "version", "line_no", "class_id", "n_links", F.when(F.col("first").isNull(), True).otherwise(place.eqNullSafe(F.col("first"))).alias("kept"))


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``documents`` without the lines that are not kept. A document that loses all its text goes, as its text stands
    elsewhere; one that was blank before stays. ``n_chars``, if there is such a column, follows the new text; all other
    columns, whatever their names, pass through."""
    gone = lines.filter(~F.col("kept")).groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("numbers"))
    # a row's other columns travel as one value, so that no name can clash
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in others)).alias("row"), F.col("text").alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("of"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("version")), "left").select("row", "text", "numbers")
    schema = rows.select("row", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lone(batches, "lines"):
            out, keep = [], []
            for t, numbers in zip(texts(batch, "text"), batch.column(2), strict=True):
                numbers = set(numbers.as_py() or ())
                new = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in numbers) if numbers else t
                keep.append(not numbers or bool(new.strip()))
                out.append(new)
            done = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], ["row", "text"])
            yield done.filter(pa.array(keep, pa.bool_()))

    def value(c: str) -> Column:
        return F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c)

    return joined.mapInArrow(run, schema).select(*map(value, docs.columns))


def op2_lines(docs: DataFrame) -> DataFrame:
    """Every classed line of all documents, two edits."""
    return near_lines(docs).select("doc_id", "line_no", "class_id", "n_links", "kept")
