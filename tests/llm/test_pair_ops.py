"""Operators 2, 4, 10, the components under them, and the pipeline, against brute force on small tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from terradelta.llm import components, line_dedup, minhash, span_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, n long, line string"
VOCABULARY = ["of", "the", "River", "stone", "ab", "Été", "un", "mill", "x1", "grass"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "c", 2, "l") for i, t in enumerate(texts)] + ([(None, "no id here", None, None, None, None, None, None)] if texts else []), SCHEMA)


def prose(rng, words):
    return " ".join(rng.choice(VOCABULARY, words))


@pytest.fixture(scope="module")
def near_texts():
    """Groups of near copies, exact copies, chains, and short and odd texts."""
    rng = np.random.default_rng(11)
    out = [None, "", "  \n\t", "one", "One", "two words", "two words", "a b c d"]
    for _ in range(25):
        base = rng.choice(VOCABULARY, rng.integers(3, 120)).tolist()
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 5)):
            for _ in range(rng.integers(0, 3)):
                base[rng.integers(len(base))] = f"w{rng.integers(40)}"
            out.append(" ".join(base))
    return [*out, "long text " * 3000]


def word_sets(texts, width):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split() if t and " " not in t else (t or "").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def closed(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, near_texts, width, percent):
    sets = word_sets(near_texts, width)
    n = len(sets)
    links = [(a, b) for a in range(n) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closed(n, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, near_texts), width, percent).collect()}
    assert len(got) == n + 1 and got[None].kept and got[None].component_id is None
    assert [got[i].component_id for i in range(n)] == want
    assert [got[i].n_shingles for i in range(n)] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in range(n))


def test_near_duplicates_of_none_and_repeated_ids(spark):
    assert minhash.op10_near_duplicates(documents(spark, [])).count() == 0
    twice = documents(spark, ["a b c d e", "x y z"]).union(documents(spark, ["other words here", "x y z"]))
    assert minhash.op10_near_duplicates(twice).count() == 6


def test_one_of_each_by_text(spark):
    """Ids that repeat: a text that is no copy of another stays, a repeated row stays once, other columns pass through."""
    body, other = prose(np.random.default_rng(1), 60), prose(np.random.default_rng(2), 60)
    third = prose(np.random.default_rng(3), 60)
    rows = [(1, body, "p"), (2, body, "q"), (2, other, "r"), (3, third, "s"), (3, third, "s"), (3, third, "s"), (4, third + " more", "t"), (None, body, "u"), (None, body, "u"), (5, None, "v"), (5, "", "w")]
    rows += [(6, other + " end", "x"), (6, body + " end", "y")]
    for names in ("_gone", "_id", "_v", "version", "row", "doc.id"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, `{names}` string")
        got = minhash.one_of_each(docs, 5, 80)
        assert got.columns == docs.columns
        left = sorted((r[2], r[0], r[1]) for r in got.collect())
        assert [x[0] for x in left] == ["p", "r", "s", "u", "u", "v", "w"], left


def test_near_duplicates_with_repeated_ids(spark):
    body, other = prose(np.random.default_rng(1), 60), prose(np.random.default_rng(2), 60)
    docs = spark.createDataFrame([(7, body), (7, other), (8, other + " x"), (9, body + " x"), (2, "alone")] + [(7, body)] * 50, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).distinct().collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


def test_signature_distance_is_found_by_keys(spark):
    """Any two signatures with fewer than 2 * chunks different symbols share a key."""
    rng = np.random.default_rng(2)
    chunks = 3
    rows = []
    for k in range(200):
        a = rng.integers(0, 2**15, 12)
        b = a.copy()
        b[rng.choice(12, rng.integers(0, 6), replace=False)] ^= 1
        rows.append((k, a.tolist(), b.tolist()))
    df = spark.createDataFrame(rows, "k int, a array<short>, b array<short>")
    from pyspark.sql import functions as F

    common = df.select(F.arrays_overlap(minhash.keys_of(F.col("a"), chunks), minhash.keys_of(F.col("b"), chunks)).alias("x"), (minhash.least_distance(minhash.packed(F.col("a"), 12), minhash.packed(F.col("b"), 12)) < 6).alias("y"))
    assert all(r.x and r.y for r in common.collect())


@pytest.mark.parametrize("few", [0, 100_000])
def test_few_links_take_few_jobs(spark, monkeypatch, few):
    """One task and the star steps give the same; with few links a dozen jobs would fill the driver for nothing."""
    from terradelta.operators import graph

    monkeypatch.setattr(graph, "FEW_LINKS", few)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 540)] + [(7, 7), (None, 3)]
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else f"{x:04}é")):
        want = {}
        for a, b in pairs:
            if None not in (a, b) and a != b:
                united = want.get(of(a), {of(a)}) | want.get(of(b), {of(b)})
                want.update(dict.fromkeys(united, united))
        links = spark.createDataFrame([(of(a), of(b)) for a, b in pairs], f"x {kind}, y {kind}")
        spark.sparkContext.setJobGroup(f"few-{few}-{kind}", "links")
        got = sorted(map(tuple, components.components(links).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{few}-{kind}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == sorted((node, min(united)) for node, united in want.items())
        assert few == 0 or jobs <= 10


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [tuple(x) for x in rng.integers(0, 400, (260, 2)).tolist()] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 700)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    want = closed(700, [x for x in links if None not in x])
    touched = {v for a, b in links if a is not None and a != b for v in (a, b)}
    assert got == {v: want[v] for v in touched}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("ab c", max_size=14), st.text("ab c", max_size=14), st.integers(1, 3))
def test_banded_distance(a, b, edits):
    assert line_dedup.within(a, b, edits) == (line_dedup._plain(a, b) <= edits)


def test_lines_brute_force(spark):
    rng = np.random.default_rng(9)
    lines = [prose(rng, rng.integers(2, 14)) for _ in range(25)]
    texts = [None, "", "\n\n", "short"]
    for _ in range(40):
        some = []
        for _ in range(rng.integers(1, 6)):
            s = list(lines[rng.integers(len(lines))])
            for _ in range(rng.integers(0, 4) if rng.random() < 0.6 else 0):
                k = rng.integers(len(s))
                s[k : k + 1] = [[], ["q"], ["é", s[k]]][rng.integers(3)]
            some.append("".join(s))
        texts.append("  \n".join(some))
    texts += ["z" * 9000, "z" * 9001, texts[-1], texts[-1]]
    docs = documents(spark, texts)
    where = [(i, k, s) for i, t in enumerate(texts) for k, s in line_dedup.eligible(t, 12)]
    distinct = sorted({s for _, _, s in where})
    links = [(a, b) for a in range(len(distinct)) for b in range(a) if len(distinct[a]) < 1000 and abs(len(distinct[a]) - len(distinct[b])) <= 2 and line_dedup._plain(distinct[a], distinct[b]) <= 2]
    links += [(distinct.index("z" * 9000), distinct.index("z" * 9001))]
    label = closed(len(distinct), links)
    number = {s: i for i, s in enumerate(distinct)}
    got = {(r.doc_id, r.line_no): r for r in line_dedup.near_lines(docs, least=12).collect() if r.doc_id is not None}
    assert set(got) == {(i, k) for i, k, _ in where}
    degree = [sum(x in pair for pair in links) for x in range(len(distinct))]
    first = {}
    for i, k, s in where:
        first.setdefault(label[number[s]], (i, k))
        r = got[i, k]
        assert r.n_links == degree[number[s]]
        assert r.kept == (first[label[number[s]]] == (i, k))
    same = {}
    for i, k, s in where:
        same.setdefault(label[number[s]], set()).add(got[i, k].class_id)
    assert all(len(c) == 1 for c in same.values()) and len({next(iter(c)) for c in same.values()}) == len(same)

    left = {r.doc_id: r for r in line_dedup.without_lines(docs, line_dedup.near_lines(docs, least=12)).collect()}
    for i, t in enumerate(texts):
        gone = {k for (d, k), r in got.items() if d == i and not r.kept}
        want = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        assert (i in left) == (not gone or bool(want.strip()))
        if i in left:
            assert left[i].text == (t if t is None else want) and left[i].n_chars == (None if t is None else len(want))
    assert line_dedup.op2_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("names", ["_gone", "_id", "_v", "numbers", "version", "row", "n.x"])
def test_lines_with_clashing_columns(spark, names):
    """Any further column passes through, and none of documents' own is needed but id and text."""
    docs = spark.createDataFrame([(1, "a first long line\nanother line here", 5), (2, "a first long line\nown words", 6), (3, "a first long line", 7)], f"doc_id long, text string, `{names}` int")
    got = line_dedup.without_lines(docs, line_dedup.near_lines(docs))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a first long line\nanother line here", 5), (2, "own words", 6)]


def test_short_lines(spark):
    """Every line that is not blank has a row; copies of short ones are classed and removed, near ones only from NEAR on."""
    docs = documents(spark, ["Les.\n\nA\nhis own river", "Les.\nLes!\n  A ", "his own rivers\nA\nB"])
    got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.op2_lines(docs).collect() if r.doc_id is not None}
    assert got == {(0, 0): (0, True), (0, 2): (0, True), (0, 3): (1, True), (1, 0): (0, False), (1, 1): (0, True), (1, 2): (0, False), (2, 0): (1, False), (2, 1): (0, False), (2, 2): (0, True)}
    left = {r.doc_id: r.text for r in line_dedup.without_lines(docs, line_dedup.near_lines(docs)).collect()}
    assert (left[0], left[1], left[2]) == ("Les.\n\nA\nhis own river", "Les!", "B")


def test_spans_brute_force(spark):
    rng = np.random.default_rng(6)
    passage = " ".join(prose(rng, 9).capitalize() + "." for _ in range(6))
    texts = [None, "", "One.", "no end here at all " * 3, *(prose(rng, 30) + ". " + passage + " " + prose(rng, 20) + "! End\n\nof it." for _ in range(4)), passage, passage, "x. " * 4000]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in span_dedup.remove_repeated(docs).collect()}
    seen = {}
    for i, t in enumerate(texts):
        where = span_dedup.sentences(t or "")
        words = [w for *_, w in where]
        assert [x for w in words for x in w] == (t or "").lower().split()
        covered, n = set(), len(words)
        fits = lambda a, b, words=words: b - a >= span_dedup.RUN and sum(map(len, words[a:b])) >= span_dedup.LEAST_WORDS
        found = {(k, next(e for e in range(k, n + 1) if fits(k, e))) for k in range(n) if fits(k, n)}
        found |= {(next(b for b in range(e, -1, -1) if fits(b, e)), e) for e in range(n + 1) if fits(0, e)}
        for a, b in sorted(found):
            if seen.setdefault(tuple(map(tuple, words[a:b])), (i, a)) != (i, a):
                covered |= set(range(a, b))
        r = got[i]
        assert r.n_removed == len(covered)
        assert [(x["start"], x["end"]) for x in r.removed] == [where[k][:2] for k in sorted(covered)]
        assert (r.text is None) == (t is None) and (covered or r.text == t)
        if covered:
            assert all((t[where[k][0] : where[k][1]] in r.text) or k in covered for k in range(len(where)))
    assert got[4].n_removed == 0 and got[5].n_removed >= 4 and got[9].text.strip() == ""
    assert span_dedup.op4_spans(documents(spark, [])).count() == 0


def test_pipeline_by_stages(spark):
    """Each stage's rows against a plain reading of its rule, on the smallest tables."""
    import re
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs.collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, docs = kept, corpus_pipeline.saved(stage(spark, docs, sf), "test-stage")
        kept = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in kept}
        if k == 0:
            assert all(re.search(r"[^\W\d_]", r.text) for r in kept) and len(ids) >= 0.97 * len(before)
        if k == 1:
            lines = [s for r in kept for _, s in line_dedup.eligible(r.text)]
            assert len(lines) == len(set(lines)) and {s for r in before for _, s in line_dedup.eligible(r.text)} >= set(lines)
        if k == 2:
            sets = word_sets([r.text for r in before], 5)
            links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            order = sorted(range(len(before)), key=lambda i: before[i].doc_id)
            rank = {x: i for i, x in enumerate(order)}
            label = closed(len(sets), [(rank[a], rank[b]) for a, b in links])
            assert ids == {before[order[i]].doc_id for i in range(len(sets)) if label[i] == i}
        if k == 3:
            from terradelta.llm.decontaminate import windows, words

            bad = set().union(*(windows(r.text.encode(), 10) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))

            def dirty(t, bad=bad):
                s = f" {b' '.join(words(t.encode())).decode()} "
                return any(f" {w} " in s for w in bad)

            assert ids == {r.doc_id for r in before if not dirty(r.text)}
    rows = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == ids and zlib.crc32(b"") == 0
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_pipeline_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _id int, _v int"
    rows = [(None, None, None), (1, None, "en"), (1, "", "en"), (2, "the of and", "en"), (2, "the of and", "en"), (2, "of the river by the old mill", "en"), (3, "word " * 9000, None), (4, "the of and", "en"), (5, "of the river\nthe of and", "en")]
    odd = spark.createDataFrame([(i, t, lang, "s", 3, 1, 2, 3) for i, t, lang in rows], schema)
    left = []
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
        left.append(docs.collect())
    assert all(r._gone == 1 and r._id == 2 and r._v == 3 for step in left[:4] for r in step)
    texts = [sorted((r.doc_id, r.text) for r in step) for step in left[:4]]
    words = [(2, "of the river by the old mill"), (2, "the of and"), (3, "word " * 9000)]
    assert texts[0] == sorted([*words, (2, "the of and"), (4, "the of and"), (5, "of the river\nthe of and")])
    assert texts[1] == sorted([*words, (2, "the of and"), (5, "of the river")])
    assert texts[2] == texts[3] == sorted([*words, (5, "of the river")])
    assert sorted({r.doc_id for r in left[4]}) == [2, 3, 5]
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
        assert docs.count() == 0


def test_passages_inside_other_sentences(spark):
    """Passages of 54 words whose ends run into other sentences: each later copy is found."""
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passages = [f"{fresh(18)}. {fresh(36)}" for _ in range(60)]
    texts = [f"{fresh(9)} {p} {fresh(11)}. {fresh(30)}." for p in passages for _ in range(3)] + [f"{fresh(60)}." for _ in range(20)]
    got = {r.doc_id: r for r in span_dedup.op4_spans(documents(spark, texts)).collect()}
    found = [i for i in range(180) if i % 3 and got[i].changed]
    assert len(found) == 120 and not any(got[i].changed for i in range(len(texts)) if i >= 180 or i % 3 == 0)
    assert all(len(texts[i].split()) - len(got[i].text.split()) >= 20 for i in found)


def test_every_passage_inside_other_sentences(spark):
    """Each later copy of a passage of 51 to 60 words is found, wherever its ends run into other sentences, and no more
    than the words up to the first cut and behind the last one stay of it."""
    rng = np.random.default_rng(12)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passages = [f"{fresh(18)}. {fresh(36)}" if k % 2 else fresh(51 + k % 10) for k in range(120)]
    texts = [f"{fresh(9)} {p} {fresh(11)}. {fresh(30)}." for p in passages for _ in range(3)]
    got = {r.doc_id: r for r in span_dedup.op4_spans(documents(spark, texts)).collect()}
    assert [got[i].changed for i in range(len(texts))] == [i % 3 > 0 for i in range(len(texts))]
    for i in range(len(texts)):
        stays = set(got[i].text.split()) & set(passages[i // 3].split())
        assert i % 3 == 0 or len(stays) <= 2 * span_dedup.LONG


def test_cuts_of_one_word():
    """A word said over and over is cut each LONG words; any LONG words in a row have a cut."""
    assert span_dedup.cuts(["the"] * 60) == [11, 23, 35, 47, 59]
    words = [f"w{x}" for x in np.random.default_rng(0).integers(0, 9, 500)]
    at = span_dedup.cuts(words)
    assert max(np.diff([-1, *at])) <= span_dedup.LONG


def test_tails_of_passages(spark):
    """A last sentence that only the run up to it covers goes with the passage."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = f"{fresh(10)}. {fresh(10)}. {fresh(3)}."
    texts = [f"{fresh(12)}. {passage} {fresh(12)}. {fresh(12)}." for _ in range(2)]
    got = {r.doc_id: r for r in span_dedup.op4_spans(documents(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1].replace(f"{passage} ", "")
