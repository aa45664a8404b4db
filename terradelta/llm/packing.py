"""Operator 7: packing documents into few sequences by bin completion.

Lengths are whole numbers up to the capacity, so all that packing needs to know of any corpus is a histogram of at most
``capacity`` entries. The first packing is best fit, longest first. Where it needs more sequences than the lower bound
(of Martello and Toth), branch and bound by bin completion follows (Korf, 2002): it takes the longest length left,
enumerates undominated fillings of the room beside it, least waste first and longest pieces first, and leaves a branch
whose waste is more than a better packing may have. Paths are walked by their number of departures from the first choice
(limited discrepancy), as departures near the start matter most. A filling is used as often as the histogram allows at
once, or, as a departure, once, so that a path is about as long for 100 TB as for 1 MB.

The search ends with a proof (the bound is met, or all is tried) or after WORK units of work, which take some 10 seconds
of the driver whatever the corpus; ``lower_bound`` tells how far from proven the packing then is. Pieces are dealt to the packing's places by
their rank among pieces of their length.

Defined results: a null or empty text is its end id alone; each row is a document, also if its id repeats; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, texts
from .tokens import encoder, in_groups

CAPACITY, END = 2048, 0
#: Work of a whole search at most: a filling looked at is a unit, the preparations at a sequence one for each few lengths.
WORK, UNIT = 400_000, 15
#: Sequences of a path whose further choices are held; for those before, they are made anew when a path comes back.
HELD = 40
#: States that searches of at most so many lengths remember, so that none is searched twice.
STATES, SMALL = 50_000, 64

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the best of Martello and Toth's bounds over all splits into long, middle and
    short lengths."""
    sizes = sorted(s for s, n in counts.items() if n)
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in [0, *(s for s in sizes if 2 * s <= capacity)]:
        long = sum(counts[s] for s in sizes if s > capacity - k)
        middle = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        room = sum((capacity - s) * counts[s] for s in middle)
        short = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        least = max(least, long + sum(counts[s] for s in middle) + max(0, -(-(short - room) // capacity)))
    return least


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Best fit, longest first: each piece goes where least room is left of what it fits in. Equal sequences go together."""
    by_room: dict[int, dict[Filling, int]] = {capacity: {}}
    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, some in by_room.items() if r >= s and some), default=None)
            some = by_room[capacity if room is None else room]
            filling, times = next(iter(some.items())) if some else ((), left)  # a new sequence
            room = capacity if room is None else room
            # a sequence that the next copy fits in too is the tightest again
            k = min(room // s, left)
            take = min(times, left // k)
            if some:
                some[filling] -= take
                if not some[filling]:
                    del some[filling]
            into = by_room.setdefault(room - k * s, {})
            made = (*filling, (s, k))
            into[made] = into.get(made, 0) + take
            left -= k * take
    return [x for some in by_room.values() for x in some.items()]


def _sums(count: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each place in ``sizes``, which totals up to ``room`` the lengths from there on can have, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        s, bits = sizes[i], out[i + 1]
        n, step = min(count[sizes[i]], room // sizes[i]), 1
        while n > 0:
            k = min(step, n)
            bits |= (bits << (k * s)) & mask
            n, step = n - k, 2 * step
        out[i] = bits
    return out


def fillings(sizes: list[int], count: dict[int, int], room: int, most_waste: int, work: list[int] | None = None) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of a room: least waste first, then longest pieces first, without dominated ones. ``work`` (units
    left) is counted down, and none comes once it is used up.

    A filling is dominated if a free piece could take the place of some of its pieces that are not longer together: these
    could then lie where that piece would.
    """
    work = [WORK] if work is None else work
    sizes = [s for s in sizes if s <= room and count[s]]
    work[0] -= 1 + len(sizes) // UNIT
    sums, free = _sums(count, sizes, room), sum(1 << s for s in sizes)

    def exact(i: int, target: int, chosen: Filling) -> Iterator[Filling]:
        if not target:
            yield chosen
            return
        while sizes[i] > target or not sums[i] >> target & 1:
            i += 1
        s = sizes[i]
        for k in range(min(count[s], target // s), -1, -1):
            if sums[i + 1] >> (target - k * s) & 1:
                yield from exact(i + 1, target - k * s, (*chosen, (s, k)) if k else chosen)

    for waste in range(min(room, most_waste) + 1):
        if sums[0] >> (room - waste) & 1:
            for chosen in exact(0, room - waste, ()):
                work[0] -= 1
                if work[0] < 0:
                    return
                if not _dominated(count, free, chosen, waste):
                    yield waste, chosen


def _dominated(count: dict[int, int], free: int, chosen: Filling, waste: int) -> bool:
    def totals(pieces: Filling) -> int:
        """Totals of some of the pieces, each raised by up to ``waste``, as bits."""
        bits = 1
        for s, k in pieces:
            for _ in range(k):
                bits |= bits << s
        bits ^= 1
        raised = 0
        while raised < waste:
            by = min(raised + 1, waste - raised)
            bits |= bits << by
            raised += by
        return bits

    if totals(chosen) & free & ~sum(1 << s for s, _ in chosen):
        return True
    # another piece of a length that the filling has
    return any(count[z] > have and totals(tuple(x for x in chosen if x[0] != z)) >> z & 1 for z, have in chosen)


def pack(counts: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> list[tuple[Filling, int]]:
    """Fillings, each with the number of sequences that have it; they hold all pieces."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    best = best_fit(counts, capacity)
    least, left, departures = lower_bound(counts, capacity), [work], 0
    while (used := sum(n for _, n in best)) > least and left[0] > 0:
        found, whole = _walk(counts, capacity, used, departures, left)
        if found:
            best = found
        elif whole:  # all was tried
            break
        else:
            departures += 1
    return best


def _walk(counts: dict[int, int], capacity: int, better_than: int, departures: int, work: list[int]) -> tuple[list[tuple[Filling, int]] | None, bool]:
    """The first packing of fewer sequences on a path of at most so many departures, and whether no path was left out."""
    allowed = (better_than - 1) * capacity - sum(s * n for s, n in counts.items())  # waste
    sizes = sorted(counts, reverse=True)
    left, seen, left_out = dict(counts), {}, False

    def choices(at: int, wasted: int, departures: int) -> Iterator[tuple[int, dict[int, int], int, int]]:
        """(waste, filling, how often, departures left) of a sequence that begins with the longest length left."""
        nonlocal left_out
        s = sizes[at]
        for rank, (waste, chosen) in enumerate(fillings(sizes[at:], left | {s: left[s] - 1}, capacity - s, allowed - wasted, work)):
            if rank > departures:
                left_out = True
                return
            whole = dict(chosen)
            whole[s] = whole.get(s, 0) + 1
            times = min(left[x] // k for x, k in whole.items())
            if waste:
                times = min(times, (allowed - wasted) // waste)
            yield waste, whole, times, departures - rank
            if times > 1 and rank < departures:
                yield waste, whole, 1, departures - rank - 1
            left_out |= times > 1 and rank == departures
            if len(chosen) == 1 and chosen[0][1] == 1 and not waste:
                return  # one piece that fills the room dominates all else

    # where a path stands: the place of its longest length, its waste, its departures left, and the choices tried there
    path: list[tuple[tuple[int, int, int, int], dict[int, int], int]] = []
    held: dict[int, Iterator] = {}
    at, wasted, tried = 0, 0, 0
    while True:
        while at < len(sizes) and not left[sizes[at]]:
            at += 1
        if at == len(sizes):
            return [(tuple(sorted(whole.items(), reverse=True)), times) for _, whole, times in path], False
        if (here := held.get(len(path))) is None:
            here = held[len(path)] = islice(choices(at, wasted, departures), tried, None)
            held.pop(len(path) - HELD, None)
        move = next(here, None)
        if work[0] < 0:
            return None, False
        if move is not None:
            waste, whole, times, still = move
            for x, k in whole.items():
                left[x] -= k * times
            path.append(((at, wasted, departures, tried), whole, times))
            wasted, departures, tried = wasted + waste * times, still, 0
            if len(sizes) > SMALL:
                continue
            # the same pieces left with no less waste and no more departures: nothing new
            state = (*left.values(), departures)
            if seen.get(state, allowed + 1) > wasted:
                if len(seen) < STATES:
                    seen[state] = wasted
                continue
        elif not path:
            return None, not left_out
        else:
            del held[len(path)]
        (at, wasted, departures, tried), whole, times = path.pop()
        tried += 1
        for x, k in whole.items():
            left[x] += k * times


def places(packing: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end of ranks, times, first sequence, first offset) that deal ranks to places.

    Rank r of a length is, in its row, copy (r - first) // times of sequence (r - first) % times.
    """
    out, rank, sequence = [], {}, 0
    for whole, times in packing:
        offset = 0
        for s, k in whole:
            at = rank.get(s, 0)
            out.append((s, at, at + k * times, times, sequence, offset))
            rank[s] = at + k * times
            offset += k * s
        sequence += times
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``; only the first piece of several may be short."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            whose, rows, at = [], [], 0
            for group in in_groups(t or "" for t in texts(batch, "text")):
                for raw in encode(group):
                    raw += end
                    n, k = len(raw) // 4, 0
                    stop = n - (-(-n // capacity) - 1) * capacity
                    begin = 0
                    while begin < n:
                        whose.append(at)
                        rows.append((k, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])))
                        begin, stop, k = stop, stop + capacity, k + 1
                    at += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return one.mapInArrow(run, f"doc_id {one.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


#: Pieces of one length that are ranked in one block, about.
BLOCK_ROWS = 20_000


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` should be a written table, as it is read twice."""
    spark = pieces.sparkSession
    rows = pieces.count()
    # a common length is dealt to blocks, so that no task ranks all of it
    blocks = max(64, -(-rows // BLOCK_ROWS))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    by_block = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = places(pack(histogram, capacity))
    seats = spark.createDataFrame(plan or [(0,) * 6], "_size long, _from long, _to long, _times long, _sequence long, _offset long")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = by_block.select("length", "_block", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # the places that a block's ranks meet: few, as both are ranges in a row
    meets = (F.col("length") == F.col("_size")) & (F.col("_from") < F.col("_first") + F.col("_n")) & (F.col("_to") > F.col("_first"))
    first = first.join(small(seats, len(plan)), meets).drop("_n", "_size")
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("_row", within).join(first, ["length", "_block"]).withColumn("_rank", F.col("_first") + F.col("_row") - 1)
    r = F.col("_rank") - F.col("_from")
    return (
        ranked.filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", F.col("_sequence") + F.pmod(r, F.col("_times")))
        .withColumn("offset", F.col("_offset") + F.floor(r / F.col("_times")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def op7_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack_pieces(saved(cut_pieces(docs, tokenizer), "pieces"))
