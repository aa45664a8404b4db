"""Operator 10: near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct word shingles. Its signature has SYMBOLS minima, b = 16 bits of each. Signatures
are compared by the number of symbols that differ. They are split into chunks of four symbols, and if two signatures
differ in fewer than twice as many symbols as there are chunks, some chunk has one error or none: each chunk gives one
key for each place where the one allowed error may be, made of the other three symbols. So a join on keys finds all
pairs under that distance; the number of chunks is chosen such that a pair of the linking similarity is above it with
a probability of at most one in a million. Links are confirmed on the full sets.

Equal sets are one node. In each key's group every node is tested against the group's centre, the node that shares most
keys with others; components of these links are found. What is left are pairs of other nodes of a centre's star that
lie in different components. A star's nodes are described by their differences from the centre, which are small among
near copies; nodes outside the centre's component are dealt to blocks of bounded size, each of which meets all blocks of
the star in a task of its own, where a product of sparse 0/1 matrices gives all exact intersections and only links that
unite components leave. So no pair that could join two components is left out, no pairs are written out, and neither a
star nor a key's group is ever gathered in one task.

Defined results: null and empty texts and texts without words have an empty set and no links; a text of fewer words
than a shingle is one shingle; rows with null ids are not linked, stay, and have a null component; rows of equal ids
and other texts are nodes by their texts; ids are whole numbers (others raise in the cast); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, let_go, parts, saved, small, utf8
from .components import components

CHUNK, BITS = 4, 16
#: A pair of the linking similarity exceeds the signature distance with at most this probability.
MISSED = 1e-6
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words remembered in a worker before its memory starts anew.
REMEMBERED = 150_000
#: Shingles whose minima are taken at once.
BLOCK = 1 << 17


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; words are runs of bytes other than ASCII white space."""
    split = raw.translate(LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    words = held("shingle words", None, _Words)
    if len(words) > REMEMBERED:
        words.clear()
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def chunks_for(similarity: float) -> int:
    """The least number of chunks such that a pair of this similarity is within the signature distance, but for MISSED."""
    p = 1 - similarity
    for chunks in range(1, 200):
        n = CHUNK * chunks
        if sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * chunks, n + 1)) <= MISSED:
            return chunks
    raise ValueError("this similarity is too low for chunks with one error")


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """One row of 16-bit symbols for each set; sets are not empty."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), symbols), np.uint16)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= BLOCK):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(symbols):
            out[at:to, k] = (np.minimum.reduceat(flat * factors[k], starts) >> np.uint64(24)).astype(np.uint16)
        at = to
    return out


def sketch(docs: DataFrame, width: int, symbols: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``version`` (a hash of its text), ``n_shingles``, a 128-bit digest of the set (``d1``, ``d2``;
    null: empty) and its signature."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 500):
            sets = [shingles(raw, width) for raw in utf8(part, "text")]
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full, symbols).view(np.int16))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            halves = [tuple(np.frombuffer(d, np.int64).tolist()) if d else (None, None) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array([next(signed) if len(s) else None for s in sets], pa.list_(pa.int16()))],
                ["doc_id", "version", "n_shingles", "d1", "d2", "signature"],
            )

    return one.mapInArrow(run, "doc_id long, version long, n_shingles long, d1 long, d2 long, signature array<short>")


def full_sets(docs: DataFrame, nodes: DataFrame, rows: int, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``node``, ``set`` (array of shingle hashes) for the ``rows`` documents (``doc_id``, ``version``) named in ``nodes``."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    one = one.join(small(nodes.select("node", "doc_id", "version"), rows), ["doc_id", "version"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 500):
            sets = [shingles(raw, width).view(np.int64) for raw in utf8(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    sets = saved(one.mapInArrow(run, "node long, set array<long>"), "sets")
    # rows that agree in id and text have given a set each
    return sets if sets.count() == rows else saved(sets.groupBy("node").agg(F.first("set").alias("set")), "one-set-each")


def keys_of(signature: Column, chunks: int) -> Column:
    """For each chunk and each place of its one allowed error: a hash of the other three symbols."""
    out = []
    for c in range(chunks):
        at = [signature[CHUNK * c + i] for i in range(CHUNK)]
        for gap in range(CHUNK):
            out.append(F.xxhash64(F.lit(CHUNK * c + gap), *(x for i, x in enumerate(at) if i != gap)))
    return F.array(*out)


def packed(signature: Column, symbols: int) -> list[Column]:
    """Two bits of each symbol, 32 symbols to a long: symbols that differ there do differ."""
    out = []
    for begin in range(0, symbols, 32):
        word = F.lit(0).cast("long")
        for i in range(begin, min(begin + 32, symbols)):
            word = word.bitwiseOR(F.shiftleft(signature[i].bitwiseAND(F.lit(3).cast("short")).cast("long"), 2 * (i - begin)))
        out.append(word)
    return out


EVEN = 0x5555555555555555


def least_distance(a: list[Column], b: list[Column]) -> Column:
    """A lower bound of the number of symbols that differ, from packed signatures."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(EVEN).cast("long")))
    return total


#: A block of a star's nodes has about so many differing shingles and nodes at most; shingles are multiplied so many at once.
BLOCK_SHINGLES, BLOCK_NODES, AT_ONCE = 200_000, 400, 2048


def links_in_stars(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between nodes of one star that are in different components, enough to unite these.

    ``members``: star (its centre) ``b``, node ``a``, the node's component ``part``, the centre's component ``home``.
    """
    both = members.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    delta = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    rows = saved(both.select("b", "a", "part", (F.col("part") != F.col("home")).alias("out"), F.size("sa").alias("n"), delta.alias("delta")), "deltas")
    size = lambda kind: F.greatest(F.ceil(F.sum(F.when(kind, F.size("delta") + 1)) / BLOCK_SHINGLES), F.ceil(F.count(F.when(kind, 1)) / BLOCK_NODES))
    blocks = rows.groupBy("b").agg(F.coalesce(size(F.col("out")), F.lit(0)).cast("int").alias("outs"), F.coalesce(size(~F.col("out")), F.lit(0)).cast("int").alias("homes"))
    dealt = rows.join(saved(blocks.filter("outs > 0"), "blocks"), "b").withColumn("k", F.pmod(F.xxhash64("a"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("homes"))).cast("int"))
    # tasks: an out block i beside an out block j >= i, or beside a home block j (numbered from -1 down)
    outs, homes = F.sequence(F.lit(0), F.col("outs") - 1), F.when(F.col("homes") > 0, F.sequence(F.lit(-1), -F.col("homes"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    task = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"))
    of_out = F.concat(
        F.transform(F.filter(outs, lambda j: j >= F.col("k")), lambda j: task(F.col("k"), j, F.lit(True))),
        F.transform(F.filter(outs, lambda i: i <= F.col("k")), lambda i: task(i, F.col("k"), F.lit(False))),
        F.transform(homes, lambda j: task(F.col("k"), j, F.lit(True))),
    )
    of_home = F.transform(outs, lambda i: task(i, -F.col("k") - 1, F.lit(False)))
    tasks = dealt.withColumn("t", F.explode(F.when(F.col("out"), of_out).otherwise(of_home))).select("b", "t.i", "t.j", "t.left", "a", "part", "n", "delta")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        held("stars", None, lambda: None)
        return pd.DataFrame(block_links(t[t["left"]], t[~t["left"]], percent), columns=["a", "b"], dtype=np.int64)

    return tasks.groupBy("b", "i", "j").applyInPandas(run, "a long, b long")


def block_links(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """One link from each node of ``x`` to each other component of ``y`` that it is linked with."""
    if x.empty or y.empty:
        return []
    sizes = [np.array([len(d) for d in t["delta"]], np.int64) for t in (x, y)]
    flat = [np.concatenate([np.asarray(d, np.int64) for d in t["delta"]]) if s.sum() else np.zeros(0, np.int64) for t, s in zip((x, y), sizes, strict=True)]
    shared, at = np.intersect1d(flat[0], flat[1]), []
    for f, s in zip(flat, sizes, strict=True):
        row = np.repeat(np.arange(len(s)), s)
        column = np.searchsorted(shared, f)
        hit = column < len(shared)
        hit[hit] = shared[column[hit]] == f[hit]
        at.append((row[hit], column[hit]))
    common = np.zeros((len(x), len(y)), np.float32)
    for begin in range(0, len(shared), AT_ONCE):
        a, b = (np.zeros((len(s), min(AT_ONCE, len(shared) - begin)), np.float32) for s in sizes)
        for m, (row, column) in zip((a, b), at, strict=True):
            here = (column >= begin) & (column < begin + AT_ONCE)
            m[row[here], column[here] - begin] = 1
        common += a @ b.T
    n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
    # |x ^ y| = |dx| + |dy| - 2 |dx & dy|, from which the intersection of the full sets
    meet = (n + m - (sizes[0][:, None] + sizes[1][None, :] - 2 * common.astype(np.int64))) // 2
    linked = (100 * meet >= percent * (n + m - meet)) & (x["part"].to_numpy()[:, None] != y["part"].to_numpy()[None, :])
    out = []
    ids, others, parts = x["a"].to_numpy(), y["a"].to_numpy(), y["part"].to_numpy()
    for i in np.flatnonzero(linked.any(axis=1)):
        js = np.flatnonzero(linked[i])
        _, first = np.unique(parts[js], return_index=True)
        out += [(int(ids[i]), int(others[j])) for j in js[first]]
    return out


def near_duplicates(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``version``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Links: 100 * shared shingles >= ``percent`` * shingles of both.
    """
    chunks = chunks_for(percent / 100)
    symbols = CHUNK * chunks
    sketched = saved(sketch(docs, width, symbols, id_col, text), "sketches")
    # a node is a set; its number is its own, as several texts may have one id
    nodes = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "version", "n_shingles", "signature"), "doc_id").alias("x"))
    words = -(-symbols // 32)
    nodes = saved(nodes.select("d1", "d2", F.monotonically_increasing_id().alias("node"), "x.doc_id", "x.version", F.col("x.n_shingles").alias("n"), "x.signature"), "nodes")

    keys = nodes.select("node", F.explode(keys_of(F.col("signature"), chunks)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    keys = saved(keys.join(shared, "key"), "keys")  # only those that several nodes have
    # a node's standing: with how many it shares keys
    standing = keys.groupBy("node").agg(F.sum("members").alias("standing"))
    placed = keys.join(standing, "node")
    centres = placed.groupBy("key").agg(F.max(F.struct("standing", "node")).alias("c")).select("key", F.col("c.node").alias("b"))
    stars = saved(keys.join(centres, "key").select(F.col("node").alias("a"), "b").filter("a != b").distinct(), "stars")

    involved = saved(nodes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "version"), "involved")
    let_go(docs.sparkSession)
    sets = full_sets(docs, involved, involved.count(), width, id_col, text)
    facts = nodes.select("node", "n", *(w.alias(f"w{i}") for i, w in enumerate(packed(F.col("signature"), symbols))))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in df.columns))

    def close(a: str, b: str) -> Column:
        """What two nodes' facts allow: the signature distance and the sizes."""
        near = least_distance([F.col(f"{a}_w{i}") for i in range(words)], [F.col(f"{b}_w{i}") for i in range(words)]) < 2 * chunks
        return near & (100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
        both = both.select("a", "b", F.size("a_set").alias("x"), F.size("b_set").alias("y"), F.size(F.array_intersect("a_set", "b_set")).alias("both"))
        return both.filter(100 * F.col("both") >= percent * (F.col("x") + F.col("y") - F.col("both"))).select("a", "b")

    first = saved(confirmed(stars.join(side(facts, "a"), "a").join(side(facts, "b"), "b").filter(close("a", "b")).select("a", "b")), "confirmed")
    found = components(first)
    let_go(docs.sparkSession)

    part = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    members = stars.unionByName(stars.select(F.col("b").alias("a"), "b").distinct())
    members = members.join(part("a", "_p"), "a", "left").select("a", "b", F.coalesce("_p", "a").alias("part"))
    torn = members.groupBy("b").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).filter("n > 2 AND x <> y").select("b")
    # this table and those of blocks are written, so that the joins with them may split a large star's rows
    torn = saved(torn.join(part("b", "_p"), "b", "left").select("b", F.coalesce("_p", "b").alias("home")), "torn")
    in_stars = saved(links_in_stars(members.join(torn, "b"), sets, percent), "star-links")
    let_go(docs.sparkSession)
    final = components(first.unionByName(in_stars))

    linked = saved(nodes.select("d1", "d2", "doc_id", "node").join(final, "node"), "linked")
    # written, so that the join may split a large component
    least = saved(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-ids")
    linked = linked.join(least, "component").select("d1", "d2", "component_id")
    alone = nodes.join(final, "node", "left_anti").select("d1", "d2", F.col("doc_id").alias("component_id"))
    classes = saved(linked.unionByName(alone), "classes")
    rows = sketched.select("doc_id", "version", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return rows.select("doc_id", "version", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies of others, with all their columns, whatever the names: of each group the
    smallest id stays, and one row where it has several with the same text. Rows of one id with other texts are judged
    by their own; rows without id stay."""
    judged = saved(near_duplicates(docs, width, percent, id_col, text), "judged")
    gone = saved(judged.filter(~F.col("kept")).select("doc_id", "version").distinct(), "gone")
    again = judged.filter("kept and doc_id is not null").groupBy("doc_id", "version").agg(F.count("*").alias("rows")).filter("rows > 1")
    again = saved(again.select("doc_id", "version"), "again")
    # a row travels as one value, so that no name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("of"))
    same = (F.col("id") == F.col("doc_id")) & (F.col("of") == F.col("version"))
    kept = rows.join(small(gone, gone.count()), same, "left_anti")
    if many := again.count():
        repeated = kept.join(small(again, many), same, "left_semi").groupBy("id", F.col("row").getField(text)).agg(F.first("row").alias("row"))
        kept = kept.join(small(again, many), same, "left_anti").select("row").unionByName(repeated.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_near_duplicates(docs: DataFrame) -> DataFrame:
    """All documents; three-word shingles, similarity 0.85 and more."""
    return near_duplicates(docs, 3, 85).drop("version")
