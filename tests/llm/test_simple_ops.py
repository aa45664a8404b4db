"""Operators 1, 3, 5, 6, 7, 8, 9 against plain versions on small tables with odd rows."""

import hashlib
import io
import wave
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terradelta.llm import decontaminate, langid, media, packing, sharding, token_counts, token_files, tokens

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n", "a", "Hello world.\nSecond line", "  two  spaces\t\ttabs \n\n x", "x" * 5000, "don't  we'll 'tis", "été naïve   wide", "a\x01b c",
    "end space ", " start", "<|endoftext|> inside <|startoftext|>x", "1234 5²6 ½", "日本語 テキスト", "a\x1cb\x85c", "é é İI ǅ", "the quick brown fox " * 700, "the quick brown fox " * 700, "line\n" * 50, "🙂🙂 ok",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _block int, start string"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None, None, None)] if texts else [], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media_round_trip(spark):
    got = by_id(media.op1_media(documents(spark)))
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, len(payload), "NONE", ""))
            w.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
    assert got[18].feature == got[19].feature and got[18].n_pairs > 0
    assert media.op1_media(documents(spark, [])).count() == 0


def test_media_fingerprint_by_blocks(monkeypatch):
    x = np.random.default_rng(1).integers(0, 255, 192 * 300, dtype=np.uint8)
    t, h = media.fingerprint(x)
    monkeypatch.setattr(media, "BLOCK", 7)
    t2, h2 = media.fingerprint(x)
    assert np.array_equal(t, t2) and np.array_equal(h, h2) and len(t) and (np.diff(t) >= 0).all()


def test_media_fingerprint_of_ends_and_short_texts(spark):
    """Other last 16 bytes and other words in a text of 200 bytes give another feature; one unit has pairs."""
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))[:n]
    texts = []
    for n in (192, 200, 384, 960, 3840):
        for _ in range(8):
            t = prose(n)
            texts += [t, t[:-16] + prose(16)]
            texts += [t, t[: n // 2] + prose(16) + t[n // 2 + 16 :]]
    got = by_id(media.op1_media(documents(spark, texts)))
    other = [got[i].feature != got[i + 1].feature for i in range(0, len(texts), 2)]
    assert sum(other) >= 0.9 * len(other)  # peaks are coarse: a few changes move none
    assert all(got[i].n_pairs > 0 for i in range(len(texts)))


def test_media_peaks_by_definition():
    """Against Fourier sums written out, frame by frame over the mirrored samples."""
    rng = np.random.default_rng(9)
    for n in (192, 960):
        x = rng.integers(32, 127, n, dtype=np.uint8)
        bins, strong = media.peaks(x)
        half = media.FRAME // 2
        mirrored = lambda i, n=n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
        for f in range(n // media.HOP + 1):
            frame = np.array([float(x[mirrored(f * media.HOP - half + j)]) for j in range(media.FRAME)])
            frame = (frame - frame.mean()) * np.array([0.5 - 0.5 * np.cos(2 * np.pi * j / (media.FRAME - 1)) for j in range(media.FRAME)])
            power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME))) ** 2 for k in range(half + 1)]
            for b, (low, high) in enumerate(media.BANDS):
                top = max(range(low, high), key=lambda k: power[k])
                assert np.isclose(power[bins[f, b]], power[top], rtol=1e-4)
                if abs(power[top] / np.mean(power) / media.STANDS_OUT - 1) > 1e-3:
                    assert strong[f, b] == (power[top] > media.STANDS_OUT * np.mean(power))
        assert len(bins) == n // media.HOP + 1


def test_media_feature_sees_each_stretch():
    """Other noise in any 64 bytes gives another fingerprint."""
    rng = np.random.default_rng(10)
    x = rng.integers(32, 127, 192 * 6, dtype=np.uint8)
    t, h = media.fingerprint(x)
    for at in range(0, len(x), 64):
        y = x.copy()
        y[at : at + 64] = rng.integers(32, 127, 64, dtype=np.uint8)
        t2, h2 = media.fingerprint(y)
        assert not (np.array_equal(t, t2) and np.array_equal(h, h2)), at


def test_media_null_file_and_clash(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, wav binary")
    assert media.read_wav(df).first().payload_bytes is None
    with pytest.raises(ValueError):
        media.store_wav(df.withColumnRenamed("wav", "text").withColumn("WAV", df.doc_id))


def test_decontaminate_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["ab", "cd", "É", "x1", "of"]
    texts = [None, "", "...", *(" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(60))]
    texts += texts[-1:] * 3
    items = [("1", " ".join(rng.choice(vocabulary, 14))), ("10", "Ab, CD"), ("2", None), ("3", "!!"), ("10", "Ab, CD"), (None, "ab x1 of"), ("7", "cd cd É of x1 x1 ab ab")]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    assert len(decontaminate.benchmark_parts(bench, 1 << 20)) == 1
    cut = [t.collect() for t in decontaminate.benchmark_parts(bench, 30)]
    assert len(cut) > 2 and sorted(map(repr, sum(cut, []))) == sorted(map(repr, bench.filter("text is not null").distinct().collect()))
    for part_bytes in (1 << 20, 30):
        hits = by_id(decontaminate.find_hits(docs, bench, width=4, part_bytes=part_bytes))
        for i, t in enumerate(texts):
            w = [x.lower() for x in decontaminate.WORD.findall((t or "").lower())]
            hit, found = [False] * len(w), set()
            for item, text in items:
                v = decontaminate.WORD.findall((text or "").lower())
                if not v:
                    continue
                n = min(4, len(v))
                for k in range(len(v) - n + 1):
                    for j in range(len(w) - n + 1):
                        if w[j : j + n] == v[k : k + n]:
                            hit[j : j + n] = [True] * n
                            found |= {item} - {None}
            r = hits[i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), sum(hit), sorted(found))
            inside = " ".join((t or "")[s["start"] : s["end"]] for s in r["spans"])
            assert len(decontaminate.WORD.findall(inside.lower())) == sum(hit)
    assert by_id(decontaminate.op3_decontaminate(docs, bench.limit(0)))[5].contaminated is False


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 60])
def test_jump_hash(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(5).integers(-(2**62), 2**62, 200).tolist()]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.s for r in df.select("k", sharding.jump_hash(df.k, shards).alias("s")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_sharding(spark):
    rows = sharding.op5_jump(documents(spark, TEXTS * 20)).collect()
    assert len(rows) == len(TEXTS) * 20 + 1
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id % len(TEXTS)] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.op5_jump(documents(spark, [])).count() == 0


def test_encoder_is_the_library(monkeypatch):
    tk = Tokenizer.from_file(BYTE)
    enc = tokens.ByteLevelEncoder(BYTE)
    many = [t or "" for t in TEXTS]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc(many)] == [tk.encode(t, add_special_tokens=False).ids for t in many]
    monkeypatch.setattr(tokens, "LONG", 50)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(many)] == [tk.encode(t, add_special_tokens=False).ids for t in many]


def test_encoder_of_each_letter():
    """All letters of plain words, and others around them, beside letters, marks and digits."""
    enc = tokens.ByteLevelEncoder(BYTE)
    assert enc.letters is not None
    letters = [chr(c) for c in range(0x41, 0x3000) if chr(c).isalpha() or c < 0x250]
    many = [f"{c}a b{c} a{c}b{c}{c}. {c}! ({c}) {c}'s {c}1 x{c}, {c}.{c}" for c in letters]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(many)] == [_bytes().encode(t, add_special_tokens=False).ids for t in many]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


def test_encoder_of_words_that_hashes_take_for_equal(monkeypatch):
    """Words of the Thue-Morse kind and their complements have equal polynomial hashes modulo 2 ** 64; words that agree
    in length, in their first and in their last bytes; words whose search begins at the same place."""
    many = []
    for n in (256, 512, 1024, 2048, 4096):
        x = thue_morse(n)
        y = x.translate({97: 98, 98: 97})
        many += [x, y, f"of {x} and {y}. {x}.", f"{y}. {x} {y}"]
    many += [" ".join(f"abcdefgh{'x' * k}{c}{'y' * k}ijklmnop" for k in range(4) for c in ("", "z", "é", "zz", "\x00")), "a\x00 a a\x00\x00 \x00a \x00 abcdefg\x00 abcdefg abcdefgh"]
    enc = tokens.ByteLevelEncoder(BYTE)
    monkeypatch.setattr(tokens, "_mixed", lambda first, last, size: np.minimum(first, np.uint64(3)) << np.uint64(60))
    enc.known = enc._fresh()
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc(many)] == [_bytes().encode(t, add_special_tokens=False).ids for t in many]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "ba", "abba", "baab", "abbabaab", "baababba", thue_morse(512), " "]), max_size=60).map("".join), max_size=4))
def test_encoder_of_long_words_of_two_letters(many):
    assert [np.frombuffer(x, "<u4").tolist() for x in _encoder()(many)] == [_bytes().encode(t, add_special_tokens=False).ids for t in many]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab.,' \n\té½²\x01\x1c ́X")), max_size=30), max_size=5))
def test_encoders_by_property(many):
    assert [np.frombuffer(x, "<u4").tolist() for x in _encoder()(many)] == [_bytes().encode(t, add_special_tokens=False).ids for t in many]
    assert _counter()(many) == [len(_words().encode(t, add_special_tokens=False)) for t in many] if many else True


@cache
def _bytes():
    return Tokenizer.from_file(BYTE)


@cache
def _words():
    return Tokenizer.from_file(WORD)


@cache
def _encoder():
    return tokens.ByteLevelEncoder(BYTE)


@cache
def _counter():
    return token_counts.Counts(WORD, [], b"")


def test_token_counts(spark):
    got = by_id(token_counts.op8_token_counts(documents(spark), WORD))
    for i, t in enumerate(TEXTS):
        n = len(_words().encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.op8_token_counts(documents(spark, []), WORD).count() == 0


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    path = token_files.write_shards(documents(spark), BYTE)
    shards = spark.read.parquet(path)
    rows = sorted(token_files.read_shards(shards).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r in rows:
        t = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = [*_bytes().encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (at, ids)
        at += len(ids)
    assert len(rows) == len(TEXTS) + 1 and shards.count() > 2
    row = next(r.asDict() for r in shards.collect() if 18 in r["doc_ids"])
    k = row["doc_ids"].index(18)
    ids = [*_bytes().encode(TEXTS[18], add_special_tokens=False).ids, 0]
    assert len(row["rules"]) and [token_files.token_at(row, k, n) for n in range(0, len(ids), 97)] == ids[::97]
    assert token_files.op6_token_files(documents(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=400), min_size=1, max_size=6))
def test_re_pair(docs):
    ids = np.concatenate([np.array(d, np.uint32) for d in docs])
    ends = np.cumsum([len(d) for d in docs])
    symbols, sym_ends, rules, lengths = token_files.re_pair(ids, ends, 4)
    stands = token_files.expansions(4, rules)
    begin, uses, free = 0, {}, {}
    for d, e in zip(docs, sym_ends.tolist(), strict=True):
        some = symbols[begin:e].tolist()
        assert np.frombuffer(b"".join(stands[s] for s in some), "<u4").tolist() == d
        for i, pair in enumerate(zip(some, some[1:], strict=False), begin):
            if free.get(pair, 0) <= i:  # occurrences that do not overlap
                uses[pair], free[pair] = uses.get(pair, 0) + 1, i + 2
        begin = e
    assert [len(x) // 4 for x in stands[4:]] == lengths.tolist()
    assert max(uses.values(), default=0) < token_files.LEAST  # it went on to its end


def test_re_pair_of_documents_that_become_one_symbol():
    symbols, ends, rules, lengths = token_files.re_pair(np.tile(np.arange(8, dtype=np.uint32), 20), np.arange(8, 168, 8), 10)
    assert len(symbols) == 20 and len(set(symbols.tolist())) == 1 and lengths.max() == 8 and len(rules) == 7
    assert len(token_files.re_pair(np.zeros(0, np.uint32), np.zeros(0, np.int64), 10)[0]) == 0


def test_re_pair_shortens(spark):
    """Measured on the tables: symbols and rules take less than 0.6 of the plain ids."""
    shards = spark.read.parquet(token_files.write_shards(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), BYTE)).collect()
    assert sum(len(r.symbols) + len(r.rules) + len(r.lengths) for r in shards) < 0.6 * sum(4 * r.n_tokens for r in shards)


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                k = bins.index(b)
                place(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def best_fit_rooms(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_best_fit_is_best_fit(case):
    capacity, sizes = case
    made = packing.best_fit({s: sizes.count(s) for s in sizes}, capacity)
    assert sorted(capacity - sum(s * k for s, k in whole) for whole, times in made for _ in range(times)) == best_fit_rooms(sizes, capacity)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 20), max_size=10), st.lists(st.integers(4, 12), max_size=12)))
def test_pack_is_optimal_when_small(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    packing_ = packing.pack(counts, 20)
    held = {}
    for whole, times in packing_:
        assert sum(s * k for s, k in whole) <= 20
        for s, k in whole:
            held[s] = held.get(s, 0) + k * times
    assert held == counts
    assert packing.lower_bound(counts, 20) <= sum(n for _, n in packing_) == fewest(sorted(sizes, reverse=True), 20)


def test_pack_beats_best_fit():
    """Sequences cut into three pieces each: best fit needs one more than there are, the search none."""
    rng = np.random.default_rng(1)
    cuts = np.sort(rng.integers(1, 2048, (1000, 2)), axis=1)
    sizes = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 2048 - cuts[:, 1]])
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes[sizes > 0], return_counts=True), strict=True)}
    assert sum(n for _, n in packing.pack(counts)) == 1000 < sum(n for _, n in packing.best_fit(counts))


def test_packing(spark):
    rows = packing.op7_packing(documents(spark, TEXTS * 9), BYTE).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert len(docs) == len(TEXTS) * 9 + 1
    for i, pieces in docs.items():
        t = "no id" if i is None else TEXTS[i % len(TEXTS)] or ""
        ids = np.array([*_bytes().encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 2048))) and all(r.length == 2048 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.op7_packing(documents(spark, []), BYTE).count() == 0


def test_ppm_brute_force():
    samples = [b"abracadabra", b"banana bandana", b""]
    tree = langid.Tree.trained(samples)
    counts = {}
    for x in samples:
        x = langid.PAD + x
        for i in range(langid.ORDER, len(x)):
            for k in range(langid.ORDER + 1):
                counts.setdefault(x[i - k : i], {}).setdefault(x[i], 0)
                counts[x[i - k : i]][x[i]] += 1

    def bits(x):
        total, x = 0.0, langid.PAD + x
        for i in range(langid.ORDER, len(x)):
            for k in range(langid.ORDER, -1, -1):
                c = counts.get(x[i - k : i])
                if c is None:
                    continue
                whole = sum(c.values()) + len(c)
                if x[i] in c:
                    total -= np.log2(c[x[i]] / whole)
                    break
                total -= np.log2(len(c) / whole)
            else:
                total += 8
        return total

    model = langid.Model.load(langid.Model(["a", "b"], [tree, tree]).dump())
    many = [b"abra banana", b"", b"xyz", "été".encode(), b"bandana" * 200]
    for size in (1 << 19, 16):
        langid.BLOCK, old = size, langid.BLOCK
        got = model.code_lengths(iter(many))
        langid.BLOCK = old
        assert np.allclose(got[:, 0], [bits(x) for x in many], rtol=1e-5) and np.array_equal(got[:, 0], got[:, 1])


def test_language_edge_cases(spark):
    got = by_id(langid.op9_language(documents(spark)))
    assert len(got) == len(TEXTS) + 1
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[5].lang_pred == "en" and got[None].held_out
    assert {r.lang_pred for r in langid.op9_language(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.op9_language(documents(spark, [])).count() == 0


def test_language_share_at_any_size():
    for size in (1, 10**6, 10**9, 10**12, 10**14, 10**18):
        part = langid.share(size) / langid.DRAWS
        assert 0 < part <= 1 and (part == 1 if size <= langid.TRAIN_BYTES else abs(part * size / langid.TRAIN_BYTES - 1) < 1e-3)


def test_language_learns_each_from_a_tiny_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_BYTES", 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert langid.train(docs).langs == sorted(r.lang for r in docs.filter("lang is not null").select("lang").distinct().collect())
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.train(docs)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op9_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) > 100").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_frequent_words_are_counted_over_all_texts(spark, monkeypatch):
    """Long texts and each of many rows count, copies too: nothing is drawn."""
    from terradelta.llm import token_counts
    from terradelta.llm.tokens import tokenizer_path

    monkeypatch.setattr(token_counts, "COUNTED", 3)
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(1, "huge " * 20_000)] + [(i, f"copy few{i % 3}") for i in range(9000)] + [(9001, None), (9002, "w" * 300)]
    words, lengths = token_counts.frequent_words(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert words == ["huge", "copy", "few0", "few1", "few2"] and len(lengths) == 5
    assert token_counts.frequent_words(spark.createDataFrame([], "doc_id long, text string"), path) == ([], b"")
