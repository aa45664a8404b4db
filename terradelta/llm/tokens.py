"""Token ids of whole texts by the ``tokenizers`` library, with a memory of words in each worker.

A byte-level BPE file without normaliser cuts a text before each single space and around each single newline whatever
stands beside them, so the ids of a text are its words' ids in a row. A worker remembers the ids of the words it has met
and gives the library only the new ones, many in one call. A batch's words are looked up all at once in flat arrays: up
to SHORT bytes, a word is its length, its first eight and its last eight bytes, which are compared as two numbers;
longer words lie in a dictionary. Texts with other white space, with runs of it or with a special token's string go to
the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import Split  # noqa: E402

from .common import held  # noqa: E402

#: Words remembered in a worker (half of its table's slots); beyond it, the memory starts anew.
SLOT_BITS = 21
REMEMBERED = 1 << (SLOT_BITS - 1)
#: Bytes of remembered long words, at which it starts anew too.
REMEMBERED_BYTES = 32 << 20
#: Bytes that two numbers of eight hold.
SHORT = 16
#: Texts longer than this many characters are worked on in blocks that end before a space.
LONG = 1 << 19
#: Marks a word without a space before it.
BARE = "\x01"
#: New words in one text for the library.
JOINED = 100
#: Words of letters and marks behind them: two pre-tokens at most. Only letters that all versions of Unicode have alike.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?)]*)")
#: Byte-level files write bytes as characters: those that print stand for themselves, the others are numbered from 256 on.
PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b if b in PRINTS else 256 + sum(x not in PRINTS for x in range(b))) for b in range(256)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _single_thread(tk: Tokenizer) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return tk


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.data, self.used = np.empty(1 << 20, kind), 0

    def add(self, more: np.ndarray) -> int:
        """Where ``more`` begins."""
        while self.used + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        at, self.used = self.used, self.used + len(more)
        self.data[at : self.used] = more
        return at


class _Batch:
    """The words between a buffer's spaces: where they are, and the two numbers that short ones are."""

    def __init__(self, raw: bytes):
        self.raw = raw
        padded = np.zeros(len(raw) + 16, np.uint8)
        padded[8 : 8 + len(raw)] = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(padded[8 : 8 + len(raw)] == 32)
        self.starts, self.ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(raw))
        self.sizes = self.ends - self.starts
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        self.first = eight[self.starts + 8] & _MASKS[np.minimum(self.sizes, 8)]
        self.last = eight[self.ends] & _MASKS[np.where(self.sizes < 8, 0, 8)]

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Words:
    """From words to their ids, which lie in a pool: open addressing in arrays for short words, a dictionary for others."""

    def __init__(self):
        size = 1 << SLOT_BITS
        self.first, self.last, self.size = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.entry = np.zeros(size, np.uint32)
        self.long: dict[bytes, int] = {}
        self.long_bytes, self.words = 0, 0
        self.pool, self.at, self.n = _Pool("<u4"), _Pool("u4"), _Pool("u4")

    def full(self) -> bool:
        return self.words > REMEMBERED or self.long_bytes > REMEMBERED_BYTES

    def find(self, batch: _Batch, which: np.ndarray) -> np.ndarray:
        """The entry of each of the batch's words of these numbers, -1 for unknown ones."""
        out, sizes = np.full(len(which), -1, np.int64), batch.sizes[which]
        left = np.flatnonzero(sizes <= SHORT)
        first, last, size = batch.first[which[left]], batch.last[which[left]], sizes[left].astype(np.uint8) + np.uint8(1)
        slot = _slot(_mixed(first, last, size))
        while len(left):
            there = self.size[slot]
            hit = (self.first[slot] == first) & (self.last[slot] == last) & (there == size)
            out[left[hit]] = self.entry[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            left, slot, first, last, size = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1), first[on], last[on], size[on]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.long.get(batch[which[i]], -1)
        return out

    def different(self, batch: _Batch, which: np.ndarray) -> np.ndarray:
        """Some of these words, none twice: all long ones, and one short one for each hash."""
        short = which[batch.sizes[which] <= SHORT]
        _, one = np.unique(_mixed(batch.first[short], batch.last[short], batch.sizes[short].astype(np.uint8) + np.uint8(1)), return_index=True)
        long = {batch[i]: i for i in which[batch.sizes[which] > SHORT].tolist()}
        return np.sort(np.concatenate([short[one], np.array(list(long.values()), np.int64)]))

    def add(self, batch: _Batch, which: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Different, unknown words; ``ids`` has theirs in a row, ``sizes`` their numbers."""
        at = self.pool.add(ids) + np.cumsum(sizes) - sizes
        entry = self.at.add(at) + np.arange(len(which))
        self.n.add(sizes)
        self.words += len(which)
        for i in np.flatnonzero(batch.sizes[which] > SHORT).tolist():
            word = batch[which[i]]
            self.long[word] = int(entry[i])
            self.long_bytes += len(word)
        left = np.flatnonzero(batch.sizes[which] <= SHORT)
        first, last, size = batch.first[which], batch.last[which], batch.sizes[which].astype(np.uint8) + np.uint8(1)
        slot = _slot(_mixed(first[left], last[left], size[left]))
        while len(left):
            free = np.flatnonzero(self.size[slot] == 0)
            where, one = np.unique(slot[free], return_index=True)
            won = free[one]
            i = left[won]
            self.first[where], self.last[where], self.size[where], self.entry[where] = first[i], last[i], size[i], entry[i]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)


def _mixed(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of short words."""
    h = (first ^ size) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h ^ last) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    """Where their search begins in the table."""
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class ByteLevelEncoder:
    """Call it with texts; it gives their ids as bytes, four to an id, little-endian."""

    def __init__(self, path: str):
        self.tk = _single_thread(Tokenizer.from_file(path))
        specials = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.newline = self._whole("\n")
        # what stands outside the rule above
        self.odd = ["  ", " \n", "\n ", "\n\n", BARE, *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), *specials]
        self.plain = self.tk.normalizer is None and len(self.newline) == 4
        # Letters alone are one pre-token, so words of letters need no pattern: written as the model's characters they go
        # to it cut at newlines. That is exact if no token has a newline behind something else.
        self.letters, self.pattern = None, self.tk.pre_tokenizer
        kind = json.loads(self.tk.to_str())["pre_tokenizer"] or {}
        if kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not any("Ċ" in t.lstrip("Ċ") for t in self.tk.get_vocab()):
            self.letters = Split("Ċ", "merged_with_previous")
        self.known = self._fresh()

    def _fresh(self) -> _Words:
        out = _Words()
        special = {"": self._whole(" "), "\n": self.newline, BARE: b""}
        ids = [np.frombuffer(x, "<u4") for x in special.values()]
        out.add(_Batch(" ".join(special).encode()), np.arange(3), np.array([len(x) for x in ids]), np.concatenate(ids))
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers: each word with its space, if it has one, and a newline behind it, many in one text."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lines = [f"{x[1:]}\n" if x[0] == BARE else f" {x}\n" for x in words]
        parts = ["".join(lines[i : i + JOINED]) for i in range(0, len(lines), JOINED)]
        if letters:
            parts = [x.encode().decode("latin-1").translate(BYTE_CHARS) for x in parts]
            self.tk.pre_tokenizer = self.letters
        try:
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tk.encode_batch_fast(parts, add_special_tokens=False)])
        finally:
            self.tk.pre_tokenizer = self.pattern
        is_end = ids == np.frombuffer(self.newline, "<u4")[0]
        ends = np.flatnonzero(is_end)
        if len(ends) != len(words):
            raise RuntimeError("the tokenizer joins words over a newline")
        return ids[~is_end], np.diff(ends, prepend=-1) - 1

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and their numbers."""
        simple, marked, cores, marks, other = [], [], [], [], []
        for i, x in enumerate(new):
            m = PLAIN.fullmatch(x, x[0] == BARE) if self.letters is not None else None
            if m is None:
                other.append(i)
            elif not m[2]:
                simple.append(i)
            else:
                marked.append(i)
                cores.append(x[: m.end(1)])
                marks.append(BARE + m[2])
        kinds = {m: k for k, m in enumerate(sorted(set(marks)))}
        ids, sizes = self._encode([new[i] for i in simple] + cores, self.letters is not None)
        more, more_sizes = self._encode([*kinds, *(new[i] for i in other)])
        # each word is up to two ranges of all these ids
        flat, n = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
        at = np.cumsum(n) - n
        part = np.zeros((len(new), 2), np.int64)
        some = np.zeros((len(new), 2), bool)
        for which, where, begin in ((simple, 0, 0), (marked, 0, len(simple)), (other, 0, len(sizes) + len(kinds))):
            part[which, where] = begin + np.arange(len(which))
            some[which, where] = True
        part[marked, 1] = len(sizes) + np.array([kinds[m] for m in marks], np.int64)
        some[marked, 1] = True
        lengths = np.where(some, n[part], 0) if len(n) else np.zeros_like(part)
        return flat[_ranges(at[part].ravel(), lengths.ravel())] if len(n) else flat, lengths.sum(axis=1)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            if not self.plain or any(x in t for x in self.odd):
                out[i] = self._whole(t)
            elif len(t) > LONG:
                out[i] = b"".join([self._joined([x])[0] for x in blocks(t)])
            else:
                cut.append((i, t))
        for (i, _), ids in zip(cut, self._joined([t for _, t in cut]), strict=True):
            out[i] = ids
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.known.full():
            self.known = None  # gone before the next one is made
            self.known = self._fresh()
        cut = [f"{BARE}{t}".replace("\n", f" \n {BARE}").encode() for t in texts]
        batch, known = _Batch(b" ".join(cut)), self.known
        entries = known.find(batch, np.arange(len(batch.starts)))
        while len(new := np.flatnonzero(entries < 0)):  # again for words whose hash is another's
            some = known.different(batch, new)
            ids, sizes = self._ids([batch[i].decode() for i in some.tolist()])
            known.add(batch, some, sizes, ids)
            entries[new] = known.find(batch, new)
        n = known.n.data[entries].astype(np.int64)
        ids = known.pool.data[_ranges(known.at.data[entries].astype(np.int64), n)]
        text_ends = np.cumsum([len(x) + 1 for x in cut]) - 1
        last = np.searchsorted(batch.starts, text_ends, side="right")  # words up to each text's end
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], last])].tolist()
        return [ids[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]


def blocks(text: str) -> list[str]:
    """A long text in parts of about LONG characters, each but the first beginning with a space."""
    out, at = [], 0
    while len(text) - at > LONG and (to := text.find(" ", at + LONG - 1)) > 0:
        out.append(text[at:to])
        at = to
    out.append(text[at:])
    return out


def encoder(path: str) -> ByteLevelEncoder:
    """The worker's encoder."""
    return held("encoder", path, lambda: ByteLevelEncoder(path))


def in_groups(texts, chars: int = 1_000_000, rows: int = 2000):
    """Lists of consecutive texts that are bounded by characters and by number."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars or len(group) >= rows:
            yield group
            group, size = [], 0
    if group:
        yield group
