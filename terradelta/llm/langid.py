"""Operator 9: language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ORDER bytes long with the counts of the bytes that followed. The code
length of a byte goes down from the longest context: a context that knows the byte gives it ``n / (total + distinct)``,
one that doesn't charges the escape ``distinct / (total + distinct)``, an unknown context charges nothing, and below
order 0 all 256 bytes are alike. Statistics are frozen after training, so the length of a text is a sum over its bytes,
each judged by the bytes before it: whole texts are scored in any number of blocks with exact results. The language
with the shortest code wins; ``score`` is its share of the probability that all languages' codes give the text.

Trees are kept as sorted arrays by order. A worker remembers the code lengths of the byte sequences it has met in a
table with direct addresses, which changes no result.

Defined results: null texts and texts without letters are ``und`` with score 0; so is all if there is nothing to learn
from; ties go to the language first in alphabetical order; null ids are never learned from and count as held out; more
than MOST_LANGUAGES languages to learn from raise, as all models are broadcast.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, parts, small, texts, utf8

ORDER = 4
#: Training text for a language, in bytes (expected; rows are drawn by a hash), and the longest text that is drawn.
TRAIN_BYTES, TRAIN_LONGEST = 1_500_000, 50_000
BLOCK = 1 << 19
SLOTS = 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Before a text's first byte.
PAD = b"\n" * ORDER


def _grams(raw: np.ndarray) -> np.ndarray:
    """At each place from ORDER on: its byte and the ORDER bytes before it, the byte lowest."""
    out = np.zeros(len(raw) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | raw[k : len(raw) - ORDER + k]
    return out


class Tree:
    """One language's counts: for each order, known sequences with counts, and contexts with totals and kinds."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.levels = levels

    @staticmethod
    def trained(samples: list[bytes]) -> Tree:
        grams, n = np.unique(np.concatenate([_grams(np.frombuffer(PAD + x, np.uint8)) for x in samples if x] or [np.zeros(0, np.uint64)]), return_counts=True)
        levels = []
        for k in range(ORDER, -1, -1):
            keys, at = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(at, n, len(keys)).astype(np.int64)
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            levels.append((keys, counts, contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)))
        return Tree(levels)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each sequence's last byte."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for level, (keys, counts, contexts, totals, kinds) in enumerate(self.levels):
            k = ORDER - level
            if not len(keys) or not len(open_):
                break
            g = grams[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(contexts, g >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == g >> np.uint64(8)
            s = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            seen = keys[s] == g
            whole = totals[c] + kinds[c]
            out[open_] += np.where(seen, np.log2(whole / counts[s]), np.where(known, np.log2(whole / kinds[c]), 0.0))
            open_ = open_[~seen]
        out[open_] += 8.0
        return out


class Model:
    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self.met = np.full(1 << SLOTS, np.uint64(2**64 - 1))
        self.known = np.zeros((1 << SLOTS, len(langs)), np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, langs=np.array(self.langs, dtype=str), **{f"{i}_{j}_{k}": a for i, t in enumerate(self.trees) for j, level in enumerate(t.levels) for k, a in enumerate(level)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            langs = [str(x) for x in z["langs"]]
            return Model(langs, [Tree([tuple(z[f"{i}_{j}_{k}"] for k in range(5)) for j in range(ORDER + 1)]) for i in range(len(langs))])

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths by language. float32: a byte's length is kept to some 1e-6 bits."""
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        new = self.met[slot] != grams
        out = self.known[slot]
        if new.any():
            at = np.flatnonzero(new)
            fresh, back = np.unique(grams[at], return_inverse=True)
            made = np.stack([t.bits(fresh) for t in self.trees], axis=1).astype(np.float32)
            out[at] = made[back]
            where = ((fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
            # of sequences that share a slot the last one stays; key and lengths go in by the same order
            where, last = np.unique(where[::-1], return_index=True)
            last = len(fresh) - 1 - last
            self.met[where], self.known[where] = fresh[last], made[last]
        return out

    def code_lengths(self, batch: Iterator[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        totals: list[np.ndarray] = []
        parts: list[bytes] = []
        whose: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal parts, whose, size
            if parts:
                joined = np.frombuffer(b"".join(parts), np.uint8)
                bits = self._bits(_grams(joined))
                sizes = np.array([len(p) for p in parts])
                # a part's first ORDER bytes are only context
                begin = np.cumsum(sizes) - sizes
                edges = np.stack([begin, begin + sizes - ORDER], axis=1).ravel()
                sums = np.add.reduceat(np.vstack([bits, np.zeros((1, bits.shape[1]), np.float32)]).astype(np.float64), np.minimum(edges, len(bits)), axis=0)[::2]
                for i, s in zip(whose, sums, strict=True):
                    totals[i] += s
            parts, whose, size = [], [], 0

        for i, raw in enumerate(batch):
            totals.append(np.zeros(len(self.langs)))
            raw = PAD + raw
            for at in range(ORDER, len(raw), BLOCK):
                parts.append(raw[at - ORDER : at + BLOCK])
                whose.append(i)
                size += len(parts[-1])
                if size >= BLOCK:
                    flush()
        flush()
        return np.array(totals).reshape(len(totals), len(self.langs))


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: a fifth of all ids, and null ids."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 5 == 0, F.lit(True))


#: Draws are whole numbers below this.
DRAWS = 1 << 62
#: Models are broadcast, so that their number is bounded; more languages raise.
MOST_LANGUAGES = 500


def share(size: int) -> int:
    """Draws below this are learned from: about TRAIN_BYTES of a language that has ``size`` bytes, however many."""
    return min(DRAWS, -(-DRAWS * TRAIN_BYTES // max(size, 1)))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from about TRAIN_BYTES of whole texts of each language that are not held out, from one text at least."""
    spark = docs.sparkSession
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text)), 2)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), held_out(F.col(id_col)).alias("held_out"), draw.alias("draw"))
    rows = rows.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.octet_length("text").between(1, TRAIN_LONGEST))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return Model([], [])
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = spark.createDataFrame([(r["lang"], max(share(r["size"]), r["least"] + 1)) for r in sizes], "lang string, below long")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[bytes]] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                by.setdefault(name, []).append(raw)
        for name, samples in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([Model([name], [Tree.trained(samples)]).dump()], pa.binary())], ["lang", "model"])

    drawn = rows.join(small(wanted, len(sizes)), "lang").filter("draw < below").select("lang", "text")
    got = drawn.repartition(min(len(sizes), 64), "lang").mapInArrow(fit, "lang string, model binary").collect()
    return Model(sorted(r["lang"] for r in got), [Model.load(bytes(r["model"])).trees[0] for r in sorted(got, key=lambda r: r["lang"])])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` in that language (null for ``und``),
    and ``text`` if wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held("languages", hash(shared.value), lambda: Model.load(shared.value))
        for batch in parts(batches):
            letters = [t is not None and LETTER.search(t) is not None for t in texts(batch, "text")]
            sizes: list[int] = []

            def measured(batch=batch, sizes=sizes):
                for raw in utf8(batch, "text"):
                    sizes.append(len(raw))
                    yield raw

            if m.langs:
                bits = m.code_lengths(measured())
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(bits)), best]
                share = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(axis=1)
            ok = [x and bool(m.langs) for x in letters]
            made = [
                pa.array([m.langs[best[i]] if x else UNKNOWN for i, x in enumerate(ok)], pa.string()),
                pa.array([float(share[i]) if x else 0.0 for i, x in enumerate(ok)], pa.float64()),
                pa.array([float(low[i]) / sizes[i] if x else None for i, x in enumerate(ok)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[1:][:with_text]], ["doc_id", "lang_pred", "score", "bits_per_byte", *["text"][:with_text]])

    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return one.mapInArrow(run, f"doc_id {one.schema[0].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double{', text string' * with_text}")


def op9_language(docs: DataFrame) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
