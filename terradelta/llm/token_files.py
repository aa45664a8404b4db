"""Operator 6: token ids in binary shard files under Re-Pair grammars.

A shard (one row of a Parquet file in the shared folder) holds consecutive documents in ascending order of their ids.
Its grammar is made by rounds: all pairs of neighbouring symbols are counted, those at least an eighth as frequent as the most frequent
one get nonterminals, and their occurrences are replaced, the more frequent pair first where two overlap. Rounds go on
until no pair is left whose rule would be shorter than what it saves (LEAST). No pair crosses a document's
end, so that each document is a range of symbols. Stored are the rules, each nonterminal's expansion length, the symbols,
and each document's range, so that one document, or one token of it, is decoded without the others.

Defined results: a null or empty text has the end id alone; null ids come first; rows with equal ids lie next to each
other in any order; an empty table gives no shard and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, small, texts
from .tokens import encoder, in_groups

END = 0
#: Ids in a shard, about. A longer document is a shard alone.
SHARD_IDS = 1_000_000
#: Uses from which a rule pays: it takes 12 bytes (two symbols and a length), and a use saves a symbol of 4.
LEAST = 4
#: A level of rounds takes the pairs at least one STEP-th as frequent as the most frequent one, and ends when a round
#: shortens the shard by less than one SLOW-th; what it leaves is taken in the next level.
STEP, SLOW = 8, 100
#: Stands for the number of a pair that is not counted yet.
OPEN = np.uint32(2**32 - 1)

SHARD = "shard long, first_id {0}, n_tokens long, doc_ids array<{0}>, doc_tokens binary, doc_ends binary, base int, rules binary, lengths binary, width int, symbols binary"


def _grouped(seq: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs at some places in ascending order: different pairs (left symbol in the upper 32 bits), how often each
    stands there, and the places pair by pair."""
    s, p = max(top - 1, 1).bit_length(), len(seq).bit_length()
    left, right = seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64)
    if 2 * s + p <= 64:  # places are sorted along in the lowest bits
        key = left
        key <<= np.uint64(s)
        key |= right
        key <<= np.uint64(p)
        key |= at.view(np.uint64)
        key.sort()
        places = (key & np.uint64((1 << p) - 1)).view(np.int64)
        key >>= np.uint64(p)
    else:
        key = (left << np.uint64(s)) | right
        order = np.argsort(key, kind="stable")
        places, key = at[order], key[order]
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
    pairs = key[starts]
    return ((pairs >> np.uint64(s)) << np.uint64(32)) | (pairs & np.uint64((1 << s) - 1)), np.diff(starts, append=len(key)).astype(np.uint32), places


#: Ways to look for pairs that do not overlap each other, once those left do so everywhere.
TRIES = 18


def _some(pairs: np.ndarray, attempt: int, often: np.ndarray) -> np.ndarray:
    """Which pairs are tried after all at once: those of one symbol; those that lead from one random half of the symbols
    to the other, so that none can overlap; one frequent one alone."""
    left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    if attempt == 1:
        return left == right
    if attempt < TRIES:
        side = lambda x: ((x + np.uint64(attempt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        return side(left) < side(right)
    alone = np.zeros(len(pairs), bool)
    alone[np.flatnonzero(often & (left != right))[:1]] = True
    return alone


def re_pair(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, ends of documents in them, rules (pairs) and expansion lengths. ``ends``: one past each last id."""
    seq = ids.astype(np.uint32)
    # for each place, how often its pair stood there when it was counted; that only falls. 0: the end of a document
    bound = np.full(len(seq), OPEN)
    bound[ends - 1] = 0
    rules, lengths, top = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32), base
    limit, attempt = 0, 0
    while True:
        active = np.flatnonzero(bound >= max(limit, 1))
        pairs, n, places = _grouped(seq, active, top)
        group = np.empty(len(seq), np.int32)
        group[places] = np.repeat(np.arange(len(n), dtype=np.int32), n)
        which = group[active]
        bound[active] = n[which]
        if not limit:
            limit = max(LEAST, -(-int(n.max(initial=0)) // STEP))
        often = n >= limit
        tried = often & _some(pairs, attempt, often) if attempt else often
        here = np.flatnonzero(tried[which])
        at, which = active[here], which[here]
        # of places that touch, a more frequent pair's goes first, and of equally frequent ones every other from the left
        touch, count = np.diff(at) == 1, n[which]
        begin = np.ones(len(at), bool)
        begin[1:] = ~touch | (count[1:] > count[:-1])
        b = np.flatnonzero(begin)
        chosen = (np.arange(len(at)) - np.repeat(b, np.diff(b, append=len(at)))) % 2 == 0
        chosen[:-1] &= ~(begin[1:] & touch)
        pays = np.bincount(which[chosen], minlength=len(n)) >= LEAST
        chosen &= pays[which]
        at, which = at[chosen], which[chosen]
        if len(at):
            attempt = 0
            number = np.cumsum(pays) - 1
            left, right = (pairs[pays] >> np.uint64(32)).astype(np.uint32), pairs[pays].astype(np.uint32)
            size = lambda s: np.where(s < base, 1, np.append(lengths, 0)[np.maximum(s.astype(np.int64) - base, 0)])  # noqa: E731, B023
            lengths = np.concatenate([lengths, (size(left) + size(right)).astype(np.uint32)])
            rules.append(np.stack([left, right], axis=1))
            slow = len(at) * SLOW < len(seq)
            seq[at] = (top + number[which]).astype(np.uint32)
            top += len(left)
            before = at[at > 0] - 1
            bound[before[bound[before] > 0]] = OPEN
            bound[at] = np.where(bound[at + 1] > 0, OPEN, 0)
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            seq, bound = np.compress(keep, seq), np.compress(keep, bound)
        elif limit == LEAST:
            # what overlaps itself is settled by the first attempt, so that other pairs must be left
            if not (often if not attempt else often & (pairs >> np.uint64(32) != pairs & np.uint64(0xFFFFFFFF))).any() or attempt == TRIES:
                break
            attempt += 1
        if limit > LEAST and (not len(at) or slow):
            limit = max(LEAST, -(-int(bound[bound < limit].max(initial=0)) // STEP))
    return seq, np.flatnonzero(bound == 0) + 1, np.concatenate(rules), lengths


def expansions(base: int, rules: np.ndarray) -> list[bytes]:
    """What each symbol stands for, as little-endian 32-bit ids."""
    plain = np.arange(base, dtype="<u4").tobytes()
    out = [plain[i : i + 4] for i in range(0, 4 * base, 4)]
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return out


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> str:
    """Writes all documents' ids, each with the end id, in ascending order of ``id_col``; returns the folder."""
    path = path or new_path(docs.sparkSession, "token-shards")
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = one.schema[0].dataType.simpleString()
    id_type = one.limit(0).toArrow().schema.field(0).type
    end = np.array([END], "<u4").tobytes()

    def shard(number: int, ids: list, raw: list[bytes], base: int) -> pa.RecordBatch:
        tokens = np.array([len(x) // 4 for x in raw], "<u4")
        symbols, ends, rules, lengths = re_pair(np.frombuffer(b"".join(raw), "<u4"), np.cumsum(tokens, dtype=np.int64), base)
        width = 2 if base + len(rules) <= 1 << 16 else 4
        row = {
            "shard": pa.array([number], pa.int64()), "first_id": pa.array([ids[0]], id_type), "n_tokens": pa.array([int(tokens.sum())], pa.int64()), "doc_ids": pa.array([ids], pa.list_(id_type)),
            "doc_tokens": pa.array([tokens.tobytes()]), "doc_ends": pa.array([ends.astype("<u8").tobytes()]), "base": pa.array([base], pa.int32()), "rules": pa.array([rules.astype("<u4").tobytes()]),
            "lengths": pa.array([lengths.astype("<u4").tobytes()]), "width": pa.array([width], pa.int32()), "symbols": pa.array([symbols.astype(f"<u{width}").tobytes()]),
        }
        return pa.RecordBatch.from_arrays(list(row.values()), list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base, number = encode.tk.get_vocab_size(with_added_tokens=True), TaskContext.get().partitionId() << 32
        ids: list = []
        raw: list[bytes] = []
        size = 0
        for batch in batches:
            at = 0
            for group in in_groups(t or "" for t in texts(batch, "text")):
                got = batch.column(0).slice(at, len(group)).to_pylist()
                at += len(group)
                for i, x in zip(got, encode(group), strict=True):
                    ids.append(i)
                    raw.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= SHARD_IDS:
                        yield shard(number, ids, raw, base)
                        ids, raw, size, number = [], [], 0, number + 1
        if ids:
            yield shard(number, ids, raw, base)

    one.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SHARD.format(kind)).write.parquet(path)
    return path


def decoded(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, as little-endian 32-bit numbers in a row."""
    pool = np.concatenate([np.arange(base, dtype="<u4"), np.frombuffer(b"".join(expansions(base, rules)[base:]), "<u4")])
    sizes = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    starts, n = (np.cumsum(sizes) - sizes)[symbols], sizes[symbols]
    ends = np.cumsum(n)
    return pool[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (32-bit, little-endian)."""
    kind = shards.schema["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols, ends = np.frombuffer(row["symbols"], f"<u{row['width']}"), np.frombuffer(row["doc_ends"], "<u8").astype(np.int64)
                flat = decoded(row["base"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), symbols)
                sizes = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                before = np.cumsum(sizes) - sizes
                if len(flat) != sizes.sum() or (len(ends) and ends[-1] != len(symbols)):
                    raise ValueError(f"shard {row['shard']} is damaged")
                raw = flat.tobytes()
                ids = [raw[4 * a : 4 * b] for a, b in zip(before.tolist(), (before + sizes).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(ids), pa.int64()), pa.array(row["doc_ids"], batch.schema.field("first_id").type), pa.array(before), pa.array(ids, pa.binary())], ["shard", "doc_id", "within", "ids"])

    inner = shards.select("shard", "first_id", "doc_ids", "doc_tokens", "doc_ends", "base", "rules", "lengths", "width", "symbols").mapInArrow(run, f"shard long, doc_id {kind}, within long, ids binary")
    return _started(shards, inner)


def _started(shards: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``start``. A shard's number has its writer's partition above, and partitions are ranges of ids in order: so
    their totals, which are few, are summed up in one task, and shards only within their partition."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.select("shard", "n_tokens", F.shiftright("shard", 32).alias("_part"))
    parts = rows.groupBy("_part").agg(F.sum("n_tokens").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("_part").orderBy("shard"))), F.lit(0))
    first = rows.withColumn("_within", within).join(parts, "_part").select("shard", (F.col("_base") + F.col("_within")).alias("_first"))
    # the documents' ids stay where they are: the shards' starts go to them if they are counted to be few
    return docs.join(small(first, shards.count()), "shard").withColumn("start", F.col("_first") + F.col("within")).drop("_first", "within", "shard")


def token_at(row: dict, doc: int, n: int) -> int:
    """Id ``n`` of a shard's document ``doc`` (both from 0): the expansion lengths lead down the rules to it."""
    base, rules = row["base"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    lengths = np.frombuffer(row["lengths"], "<u4")
    ends = np.frombuffer(row["doc_ends"], "<u8")
    size = lambda s: 1 if s < base else int(lengths[s - base])
    for s in np.frombuffer(row["symbols"], f"<u{row['width']}")[int(ends[doc - 1]) if doc else 0 : int(ends[doc])].tolist():
        if n < size(s):
            while s >= base:
                a, b = rules[s - base].tolist()
                s, n = (a, n) if n < size(a) else (b, n - size(a))
            return s
        n -= size(s)
    raise IndexError("the document has fewer ids")


def op6_token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All documents written to shard files and read back."""
    spark = docs.sparkSession
    read = read_shards(spark.read.parquet(write_shards(docs, tokenizer)))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
