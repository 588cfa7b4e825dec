"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geodemand.llm import bpe, licences, line_dedup, lm_score, media, merkle, mixing, ngram_join, suffix_dedup, toxicity
from geodemand.llm.queries import word_bpe_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, size long, rank int"


def made(spark, texts, sources=None):
    """Documents with columns whose names also occur inside the operators."""
    rows = [(i, t, None, sources[i] if sources else f"s{i % 3}", len(t or ""), 7, "x", 9, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample_texts(n=60, seed=4):
    r = random.Random(seed)
    words = [f"w{r.randint(0, 300)}" for _ in range(120)]
    base = " ".join(r.choice(words) for _ in range(80))
    out = [None, "", " \n\t", "One", "a b c", "A B  c", "é ü Σ", base, base, base, "x" * 400]
    while len(out) < n:
        x = base.split(" ")
        for _ in range(r.randint(0, 8)):
            x[r.randrange(len(x))] = r.choice(words)
        out.append(" ".join(x) + "\n" + " ".join(r.choice(words) for _ in range(r.randint(0, 20))) + "\nshared line")
    return out


@pytest.fixture(scope="module")
def texts():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return made(spark, texts).repartition(3).cache()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    images = spark.createDataFrame([], "id long, width int, pixels binary")
    frames = [
        mixing.mix(none), mixing.mixed_rows(none), ngram_join.join(none), bpe.encode(none, word_bpe_path()), media.copies(images, "id"),
        toxicity.score(none, labels), line_dedup.dedup_lines(none), licences.scan(none), suffix_dedup.dedup(none), lm_score.score(none),
        merkle.with_edits(none), merkle.fingerprints(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling, one source at a time."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark):
    r = random.Random(2)
    texts = [None, "", " "] + [" ".join(["w"] * r.choice([1, 3, 5, 40, 200])) for _ in range(600)]
    sources = [r.choice(["a", "a", "a", "b", "c", None, "Ä", "d0"]) for _ in texts]
    docs = made(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((x.doc_id, x.taken) for x in rows) == sorted((x.doc_id, x.taken) for x in again)
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in rows:
        n = len(WORD.findall(texts[x.doc_id] or ""))
        assert x["size"] == n and x.taken in (0, n, 2 * n)
        sizes[sources[x.doc_id]] += n
        taken[sources[x.doc_id]] += x.taken
    want = targets_of(sizes)
    for x in rows:
        s = sources[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 201 for s in sizes)
    mixed = Counter(x.doc_id for x in mixing.mixed_rows(docs).collect())
    assert all(mixed[x.doc_id] == (1 if x["size"] == 0 else x.taken // x["size"]) for x in rows)


def test_mix_repeated_rows(spark):
    docs = made(spark, ["a b c"] * 50, ["s"] * 50).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 50 and abs(sum(x.taken for x in rows) - 225) <= 3


def jaccard_groups(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, texts, docs):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(docs).collect()}
    assert got == jaccard_groups(texts)


def test_ngram_join_null_and_repeated_keys(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (5, None)]
    got = sorted(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == [(1, 1), (3, 1), (3, 1), (5, 5)]
    assert [x.component_id for x in got if x.doc_id is None] == [None]


def test_ngram_join_of_contradictory_keys(spark, texts):
    """Rows with one key and different texts are nodes of their own that hang together; the order of the rows has no say."""
    plain = jaccard_groups(texts)
    twice = [(i, t) for i, t in enumerate(texts)] + [(40, texts[20]), (40, "one two three four five six"), (2, "one two three four five six"), (None, texts[30])]
    parent = {i: c for i, (_, c) in plain.items()}

    def merge(a, b):
        a, b = parent[a], parent[b]
        for i in parent:
            if parent[i] == max(a, b):
                parent[i] = min(a, b)

    merge(40, 20)
    merge(40, 2)
    want = Counter((i, parent[i]) for i, _ in twice if i is not None)
    for order in (twice, twice[::-1]):
        got = ngram_join.join(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert Counter((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == want
        assert [x.component_id for x in got if x.doc_id is None] == [None]


def test_ngram_join_pairs_fall_in_the_cell():
    """Of two sets in a cell no pair leaves it that their sizes, or what is left behind the shared shingle, rule out."""
    at = lambda s, *rows: np.array([(s, k, n << 32 | i) for k, n, i in rows])
    told = lambda rows, pivots: [(k, p, whole) for _, k, p, _, whole in ngram_join._meet(rows, 0, pivots, 75).tolist()]
    assert told(at(1, (1, 100, 0), (2, 100, 14)), 1) == [(2, 1, 1)]
    assert told(at(1, (1, 100, 0), (2, 100, 15)), 1) == told(at(1, (1, 100, 0), (2, 74, 0)), 1) == []
    large = at(1, (1, 100, 0), (2, 100, 20), (3, 30, 0))
    assert sorted(told(large, 1)) == [(2, -1, 0), (2, 1, 0), (3, -1, 0)]
    assert told(large, 2) == []


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_bpe_path())
    r = random.Random(1)
    odd = ["x<|endoftext|>y <|startoftext|>", "don't 'S ''s I'LL", "日本 ² Ⅷ \x1c a\x1cb", "ΑΣ İx é", "aaaa" * 500]
    odd += ["".join(r.choice("aB' ́é'sSΣ1²<|>\n\x1d 日") for _ in range(r.randint(0, 40))) for _ in range(300)]
    all_texts = texts + odd
    docs = made(spark, all_texts)
    rows = bpe.encode(docs, word_bpe_path(), with_ids=True)
    back = {x.doc_id: x.text for x in bpe.decode(rows, word_bpe_path()).collect()}
    for x in rows.collect():
        ids = tok.encode(all_texts[x.doc_id] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert x.ids == ids and x.n_tokens == len(ids) and back[x.doc_id] == text
        assert x.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_image_copies(spark):
    rng, rows = np.random.default_rng(1), [(None, 4, b"1234"), (900, 5, None), (901, 3, bytes(9))]
    texts = ["\n".join(" ".join(f"w{rng.integers(0, 9999)}" for _ in range(12)) for _ in range(45)) for _ in range(15)]
    for i, t in enumerate(texts):
        b = media.render(t)
        h = b.shape[0]
        noisy = np.clip(b.astype(int) + rng.integers(-4, 5, b.shape), 0, 255).astype(np.uint8)
        edit = b.copy()
        edit[: h // 4] = rng.integers(0, 255, (h // 4, b.shape[1]))
        for j, x in enumerate((b, b[9 : h - 6, 4:46], noisy, edit, b)):
            rows.append((5 * i + j, x.shape[1], np.ascontiguousarray(x).tobytes()))
    found = {x.id: x for x in media.copies(spark.createDataFrame(rows, "id long, width int, pixels binary"), "id").collect()}
    assert len(found) == 77 and found[900].group_id == 900 and found[901].n_links == 0
    same = [found[5 * i + j].group_id == 5 * i for i in range(15) for j in range(5)]
    assert np.mean(same) >= 0.95
    assert all(found[k].group_id // 5 == k // 5 for k in range(75))


def test_image_descriptors_meet_up_to_three_bits_and_at_full_width(spark):
    rng = np.random.default_rng(2)
    texts = ["\n".join(" ".join(f"w{rng.integers(0, 9999)}" for _ in range(12)) for _ in range(45)) for _ in range(10)]
    pages = [media.render(t) for t in texts]
    assert pages[0].shape[1] == 96 and media.render("ab").tolist()[0][:2] == media.render("ab").tolist()[1][:2] != [0, 0]
    words = media.features(pages[0])[1]
    other = words.copy().view(np.uint8)
    other[:, [0, 5, 9]] ^= 1
    assert len(words) > 20 and (words == other.view(words.dtype)).any(1).all()
    rows = []
    for i, b in enumerate(pages):
        for j, x in enumerate((b, b[9 : b.shape[0] - 6, 12:90])):
            rows.append((2 * i + j, x.shape[1], np.ascontiguousarray(x).tobytes()))
    found = {x.id: x.group_id for x in media.copies(spark.createDataFrame(rows, "id long, width int, pixels binary"), "id").collect()}
    assert found == {k: k // 2 * 2 for k in range(20)}


def test_image_copies_are_found_in_crowded_cells(spark):
    """Groups as of all pairs, though every piece of a picture stands in many unrelated pictures."""
    rng = np.random.default_rng(8)
    pool = [rng.integers(0, 255, (24, 24)).astype(np.uint8) for _ in range(60)]
    pictures = []
    for _ in range(60):
        pictures.append(np.block([[pool[rng.integers(60)] for _ in range(4)] for _ in range(3)]))
    for i in range(0, 60, 4):  # half of another picture, far from it
        other = np.block([[pool[rng.integers(60)] for _ in range(4)] for _ in range(3)])
        other[:, 48:] = pictures[i][:, 48:]
        pictures.append(other)
    pictures += [pictures[7], pictures[20].copy()]
    described = [media.features(p) for p in pictures]

    def linked(i, j):
        if np.array_equal(pictures[i], pictures[j]):
            return True
        votes = Counter()
        same = (described[i][1][:, None] == described[j][1]).sum(2)
        for a, b in np.argwhere(same):
            (s, x, y), (t, u, v) = described[i][0][a].tolist(), described[j][0][b].tolist()
            dx, dy = x - round(u * 2.0 ** (s - t)), y - round(v * 2.0 ** (s - t))
            for h in (0, media.BIN // 2):
                votes[s - t, h, (dx + h) // media.BIN, (dy + h) // media.BIN] += same[a, b]
        return max(votes.values(), default=0) >= media.VOTES * media.TABLES

    group = list(range(len(pictures)))
    for i in range(len(pictures)):
        for j in range(i):
            if group[i] != group[j] and linked(i, j):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    frame = spark.createDataFrame([(i, 96, p.tobytes()) for i, p in enumerate(pictures)], "id long, width int, pixels binary")
    assert 20 < len(set(group)) < len(pictures) - 5
    assert {x.id: x.group_id for x in media.copies(frame, "id").collect()} == dict(enumerate(group))
    assert {x.id: x.group_id for x in media.copies(frame, "id", block=2000).collect()} == dict(enumerate(group))


def test_toxicity(spark, sf):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in texts.values()], "doc_id long, text string").unionByName(extra)
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows if x.doc_id is not None)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [x.predicted for x in rows if x.held_out and known.get(x.doc_id) == 0]
    bad = [x.predicted for x in rows if x.held_out and known.get(x.doc_id) == 1]
    assert np.mean(clean) <= 0.03 and np.mean(bad) >= 0.6  # a third of the labels has no toxic word behind it


def test_line_dedup(spark, texts, docs):
    lines = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    common = Counter(k for x in lines.values() for k in {key(y) for y in x} if k)
    for x in line_dedup.dedup_lines(docs).collect():
        kept = [y for y in lines[x.doc_id] if not (key(y) and common[key(y)] >= 10)]
        assert (x.n_lines, x.n_dropped, x.kept_text) == (len(lines[x.doc_id]), len(lines[x.doc_id]) - len(kept), "\n".join(kept))
        assert x.k == 7 and x.size == 9


def test_line_dedup_of_null_and_repeated_ids(spark):
    """Every row is a document: one with the id of another, or none, loses its own common lines only."""
    shared = [(i, f"shared\nown {i}") for i in range(9)]
    odd = [(50, "shared\nunique A\nunique B")] * 2 + [(None, "clean first\nSHARED "), (None, "shared\nlast"), (7, "other\nother\nother")]
    once = [(60, "a\nb")] * 9
    rows = shared + odd + once
    got = Counter((x.doc_id, x.text, x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = Counter()
    for i, t in rows:
        kept = [y for y in t.split("\n") if y.strip().lower() != "shared"]
        want[i, t, t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept)] += 1
    assert got == want


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    """Line dedup and near copies go by row: clean rows stay whatever their id."""
    import corpus_pipeline

    texts = [" ".join(f"w{i * 31 % 97 + j}" for j in range(i % 5 + 30)) for i in range(40)]
    rows = [(None, texts[0], "en", "s", 9), (None, texts[1], "en", "s", 9), (3, texts[2], "en", "s", 9), (3, texts[3], "en", "s", 9), (3, texts[2], "en", "s", 9), (1, texts[3], "en", "s", 9), (None, None, None, None, 0), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = Counter((x.doc_id, x.text) for x in corpus_pipeline.keep_first_of_near_copies(spark, docs, str(tmp_path)).collect())
    assert left == Counter({(None, texts[0]): 1, (None, texts[1]): 1, (3, texts[2]): 1, (1, texts[3]): 1, (None, None): 1, (None, ""): 1})
    none = corpus_pipeline.keep_first_of_near_copies(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == docs.columns


def test_licences(spark):
    r = random.Random(3)
    words = "gnu general public license apache cc by mit the under licensed released version 2 0 nc 4 x é".split()
    texts = [None, "", "MIT License", "cc cc by by"] + [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for x in licences.scan(made(spark, texts)).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[x.doc_id] or "").translate(LOW))
        hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (x.n_words, x.n_base) == (len(w), len(hits)) and x.base_labels == ",".join(sorted({b for _, b in hits}))
        assert (x.first_word, x.last_word) == (min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
    notice = "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated docs files"
    span = licences.scan(made(spark, ["hello " + notice])).first().spans[0]
    assert (span.label, span.first) == ("notice-mit", 1) and span.cover >= 0.75


def test_suffix_automaton_holds_every_run():
    s = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
    for number, text in enumerate([*licences.TEMPLATES.values(), *licences.PHRASES]):
        ids = [s.ids[w.encode()] for w in text.split()]
        for i in range(len(ids)):
            state = 0
            for j in range(i, len(ids)):
                state = s.automaton.arcs[state][ids[j]]
                assert (number, j) in s.automaton.ends[state]


def test_suffix_dedup(spark, texts, docs):
    more = texts + ["ab" * 200, "ab" * 150, "y" * 99, "y" * 101, "é" * 120]
    seen, want = set(), {}
    for i, t in enumerate(more):
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        want[i] = (len(b), bytes(c for j, c in enumerate(b) if j not in gone), sum(j in gone and j - 1 not in gone for j in range(len(b))))
    got = {x.doc_id: (x.n_bytes, bytes(x.kept), len(x.removed)) for x in suffix_dedup.dedup(made(spark, more).repartition(4)).collect()}
    assert got == want


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    """Equal rows are one document; rows of one id with different texts are apart; rows without id stay whole."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q, tail, long_text = word(300), word(300), word(150), word(9000)
    rows = [
        (1, p), (5, p), (5, q), (None, p), (None, None), (7, None), (7, "short"), (8, q + tail), (8, q + tail), (8, tail + p), (8, tail + word(40)),
        (9, long_text), (10, long_text[4000:] + q), (10, long_text[:120]), (10, ""),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    crowded = frame.select("*", F.lit(1).alias("k"), F.lit(2).alias("x"), F.lit("t").alias("t"), F.lit(4).alias("found"))
    number = {z.text: z.x for z in frame.where("text is not null").select("text", F.xxhash64("text").alias("x")).distinct().collect()}
    seen, cut = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda z: (z[0], number.get(z[1], 0))):
        b, gone = t.encode(), set()
        for at in range(len(b) - 99):
            if b[at : at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(b[at : at + 100])
        cut[i, t] = bytes(c for j, c in enumerate(b) if j not in gone)
    want = Counter((i, len((t or "").encode()), cut.get((i, t or ""), (t or "").encode())) for i, t in rows)
    got = Counter((z.doc_id, z.n_bytes, bytes(z.kept)) for z in suffix_dedup.dedup(crowded.repartition(5)).collect())
    assert got == want
    assert got[5, 300, q.encode()] == 1 and got[5, 300, b""] == 1 and got[None, 300, p.encode()] == 1


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(9)
    for n in (1, 2, 3, 7):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 30))) for _ in range(n)]
        out = suffix_dedup.merge_runs([suffix_dedup.front_coded(x) for x in runs])
        strings = [x[3] for x in out]
        assert strings == sorted(s for x in runs for s in x)
        for i in range(1, len(out)):
            assert out[i][2] == suffix_dedup.shared_prefix(strings[i - 1], strings[i], 0)


def test_lm_score(spark, texts, docs):
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    rows = {x.doc_id: x for x in lm_score.score(docs).collect()}
    for i, ws in tokens.items():
        x = rows[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert math.isfinite(x.score) and x.score < 0


def test_lm_score_keeps_every_ngram_seen_twice(spark):
    """Rare n-grams count in a corpus where they are far below any share of it; blocks of any size agree with one automaton."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefg") for _ in range(400)) for _ in range(1500)] + ["rare pair here"] * 8 + [None, "", "rare pair", "x rare pair here y"]
    tokens = {i: blank(t) for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    start, end = lm_score.START, lm_score.END
    counts = [Counter() for _ in range(3)]
    for i in train:
        w = [start, *tokens[i], end]
        for n in range(3):
            counts[n].update(zip(*[w[j:] for j in range(n + 1)], strict=False))
    words = {w: c for (w,), c in counts[0].items() if w != start}
    below = sum(words.values()) + 0.1 * (len(words) + 1)
    ids = {start: 0, end: 1} | {w: i + 2 for i, w in enumerate(sorted(w for w, c in words.items() if c > 1 and w != end))}
    unigrams = {i: (counts[0][(w,)], (words.get(w, 0) + 0.1) / below) for w, i in ids.items()}
    kept = [{tuple(ids[w] for w in g): c for g, c in counts[n].items() if c > 1} for n in (1, 2)]
    model = lm_score.build(ids, unigrams, kept)
    docs = made(spark, texts).repartition(3).cache()
    for how in ({}, {"block_bytes": 50_000}):
        rows = lm_score.score(docs, **how).collect()
        assert len(rows) == len(texts)
        for x in rows:
            rest = [math.log10((words.get(w, 0) + 0.1) / below) for w in tokens[x.doc_id]]
            assert x.score == pytest.approx(model.walk(tokens[x.doc_id], rest), abs=1e-6)


def blank(t):
    return (t or "").lower().encode().split()


def test_automaton_is_a_distribution():
    ids = {lm_score.START: 0, lm_score.END: 1, b"a": 2, b"b": 3, b"c": 4}
    below = 30 + 0.1 * 5
    unigrams = {0: (4, 0.1 / below)} | {i: (n, (n + 0.1) / below) for i, n in ((1, 4), (2, 10), (3, 9), (4, 7))}
    a = lm_score.build(ids, unigrams, [{(0, 2): 3, (2, 3): 6, (3, 2): 2, (3, 4): 4}, {(0, 2, 3): 2, (2, 3, 4): 3}])
    def log_p(words, last):
        """log10 of the probability of a history followed by one more word."""
        ends = lm_score.Automaton(a.ids | {lm_score.END: ids[last]}, a.arcs, a.fail, a.back, a.to_root, a.start)
        return ends.walk(words, [0.0] * len(words))

    for history in ([], [b"a"], [b"a", b"b"], [b"b"], [b"a", b"b", b"c"]):
        before = log_p(history[:-1], history[-1]) if history else 0.0
        total = sum(10 ** (log_p(history, w) - before) for w in (lm_score.END, b"a", b"b", b"c"))
        assert total == pytest.approx(1 - 0.2 / below, rel=0.02)  # the rest is for the start token and unknown words


def test_fingerprints(spark, texts, docs):
    rows = {x.doc_id: x for x in merkle.with_edits(docs).collect()}
    n = len(texts)
    assert sorted(rows) == list(range(n))
    for i, x in rows.items():
        t, after = texts[i] or "", texts[(i + 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == merkle.fingerprint(t) and x.edited_fingerprint == merkle.fingerprint(edited)
        assert x.near_next == pytest.approx(merkle.likeness(x.fingerprint, rows[(i + 1) % n].fingerprint))
    same = {x.fingerprint: (texts[i] or "") for i, x in rows.items()}
    assert all(same[x.fingerprint] == (texts[i] or "") for i, x in rows.items())
    assert len({x.fingerprint for x in rows.values()}) == len({t or "" for t in texts})


def test_fingerprints_of_null_and_equal_keys(spark):
    rows = [(None, "n"), (2, "b b"), (2, "a a"), (7, None)]
    found = merkle.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    edits = {(x.doc_id, x.n_chars): x.edited_sha256 for x in found}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == 4 and edits[(7, 0)] == sha("") and edits[(None, 1)] == sha("n")
    # Equal keys follow in the order of their texts: "a a" takes from "b b", and that from the empty text of 7.
    assert {x.edited_sha256 for x in found if x.doc_id == 2} == {sha("a b"), sha("b ")}


def test_differing_paragraphs():
    a = [f"paragraph number {i} with words" for i in range(60)]
    b = list(a)
    b[17], b[40] = "something else", "and another"
    left, right = merkle.differing_paragraphs(merkle.fingerprint("\n".join(a)), merkle.fingerprint("\n".join(b)))
    assert left == [17, 40] and right == [17, 40]


def test_pipeline_stages(spark, tmp_path):
    """Every stage keeps the columns, works on all its input, and its decisions take effect."""
    import corpus_pipeline

    r = random.Random(8)
    ordinary = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        words = [r.choice(ordinary) for _ in range(40)]
        if bad:
            for _ in range(6):
                words[r.randrange(40)] = r.choice(["vile", "nasty"])
        text = " ".join(words) + "\nshared footer line\n" + " ".join(r.choice(ordinary) for _ in range(10))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 5:
            labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[7][1].replace("shared", "shared"), "en", "s1", rows[7][4]) for i in range(3)] + [(2000, None, None, None, 0), (2001, "", "xx", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
    texts = {x[0]: x[1] for x in rows}
    kept = {x.doc_id for x in seen["toxicity"]}
    clean = {i for i, t in texts.items() if not re.search("vile|nasty", t or "")}
    assert clean <= kept and len(kept - clean) <= 4
    assert all((x.text or "") == "\n".join(y for y in (texts[x.doc_id] or "").split("\n") if y != "shared footer line") for x in seen["line_dedup"])
    assert all(x.n_chars == len(x.text or "") for x in seen["line_dedup"])
    assert {x.doc_id for x in seen["ngram_jaccard_join"]} == {i for i in kept if i < 1000 or i >= 2000}
    taken = Counter(x.doc_id for x in seen["source_mix"])
    assert set(taken.values()) <= {1, 2} and taken[2000] == taken[2001] == 1
    assert len(seen["bpe"]) == sum(taken.values()) and Counter(x.doc_id for x in seen["bpe"]) == taken
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe"])


def test_toxic_rows_go_by_row(spark, tmp_path):
    """A toxic row takes no other row with it that has the same id or, like it, none."""
    import corpus_pipeline

    rows = [(i, f"{'vile nasty ' * 6 if i % 3 == 0 else ''}word{i % 50} word{i % 7} plain text here", "en", "s", 9) for i in range(300)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    bad, good = rows[0][1], rows[1][1]
    more = [(k, t, "en", "s", 9) for k in (None, 7000) for t in (bad, good, good, bad)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.keep_ordinary(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = Counter((x.doc_id, x.text) for x in kept.collect())
    assert {k: n for k, n in left.items() if k[0] in (None, 7000)} == {(k, good): 2 for k in (None, 7000)}
    assert sum(left.values()) == 200 + 4


def test_registered_queries_and_sql(spark):
    """Every query of the subpackage runs on a given table; the SQL twin gives the same rows."""
    import duckdb

    from geodemand.llm import LLM_QUERIES, LLM_SQL

    sf = "/root/testdata/sf0.001"
    assert sorted(int(q[2:].split("_")[0]) for q in LLM_QUERIES) == list(range(1, 14))
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, run in LLM_QUERIES.items():
        mine = run(spark, sf).toPandas()
        assert len(mine) > 0
        if name in LLM_SQL:
            theirs = con.execute(LLM_SQL[name]).fetchdf()
            assert sorted(map(str, mine[sorted(mine)].itertuples(index=False))) == sorted(map(str, theirs[sorted(theirs)].itertuples(index=False)))


@pytest.mark.parametrize("gathered", [0, 1 << 20])
def test_components_of_chains_stars_and_repeated_links(spark, monkeypatch, gathered):
    from geodemand.llm import components as C

    r = random.Random(7)
    names = r.sample(range(-(10**12), 10**12), 300)
    links = list(zip(names[:80], names[1:81])) + [(names[100], x) for x in names[101:140]]
    links += [(r.choice(names[150:]), r.choice(names[150:])) for _ in range(120)] + links[:30] + [(names[5], names[5]), (None, names[3]), (names[299], names[299])]
    group = {n: n for a, b in links if a != b and a is not None for n in (a, b)}
    for _ in group:
        for a, b in links:
            if a in group and b in group:
                group[a] = group[b] = min(group[a], group[b])
    monkeypatch.setattr(C, "GATHERED", gathered)
    found = C.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(found) == len(group) and {x.node: x.component for x in found} == group
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_few_links_take_few_jobs(spark):
    """A chain took a dozen jobs of joins, each with as many tasks as there are partitions."""
    from geodemand.llm.components import components

    tracker, jobs = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("few-links", "components")
    try:
        assert components(spark.range(200).selectExpr("id AS a", "id + 1 AS b"), "a", "b").agg(F.max("component")).first()[0] == 0
        jobs = tracker.getJobIdsForGroup("few-links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6


def test_image_features_are_not_moved_again_for_every_block(spark):
    """Every two blocks meet, but what is shuffled does not grow with their number; rows of a stream are held a block at a time."""
    import pyarrow as pa

    rows = pa.record_batch([pa.array([3, 3, 9, 1, 1, 1])], ["n"])
    held = lambda block: [t.column("n").to_pylist() for t in media._held([rows.slice(0, 2), rows.slice(2)], block)]
    assert held(1000) == [[3, 3, 9, 1, 1, 1]] and held(media.TABLES * 6) == [[3, 3], [9], [1, 1, 1]]
    assert held(media.TABLES * 4) == [[3], [3], [9], [1, 1, 1]] and held(1) == [[3], [3], [9], [1], [1], [1]]
    r = random.Random(3)
    pictures = [media.render("\n".join("".join(chr(r.randint(33, 120)) for _ in range(90)) for _ in range(10))) for _ in range(12)]
    frame = spark.createDataFrame([(i % 9, 96, bytes(p.tobytes())) for i, p in enumerate(pictures + pictures[:4])], "id long, width int, pixels binary")
    seen, cross = [], media._cross_links

    def watched(rows, blocks, block):
        found = cross(rows, blocks, block)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        seen.append((blocks, "Bucketed: true" in plan))
        return found

    media._cross_links = watched
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else labels as few as these are broadcast, and nothing is asked of the storage
    try:
        whole, cut = (sorted(tuple(x)[:3] for x in media.copies(frame, "id", block=b).collect()) for b in (media.BLOCK, 100))
    finally:
        media._cross_links = cross
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert whole == cut and seen[0][0] == 1 and seen[1][0] > media.SENT and all(stays for _, stays in seen)
