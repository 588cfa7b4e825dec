"""Hard negatives, packing and lexical search against brute force on small tables with nulls, ties, repeats and clashing columns."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from geodemand.llm import hard_negatives, lexical, packing
from geodemand.llm.common import table
from geodemand.llm.queries import word_bpe_path
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def in_key_order(key):
    return (key is None, key or 0)


def negatives_by_hand(rows, positives=5, k=3, low=50, high=95):
    """rows: (key, label, vector, is_anchor)."""
    use = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a in use:
        if not a[3]:
            continue
        scored = sorted(((-dot(a[2], r[2]), in_key_order(r[0]), r[0], r[1] == a[1]) for r in use if r is not a))
        for p in [x for x in scored if x[3]][:positives]:
            ps = -p[0]
            window = [x for x in scored if not x[3] and low * ps <= -100 * x[0] <= high * ps][:k]
            out += [(a[0], p[2], i + 1, x[2], ps, -x[0]) for i, x in enumerate(window)]
    return out


def mined(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, vector array<long>, a boolean, score string, _block int")
    return [tuple(r) for r in hard_negatives.mine(df.repartition(parts), F.col("a"), **how).collect()]


@pytest.mark.parametrize("scale", [9, 3_000, 3_000_000_000])
def test_hard_negatives(spark, monkeypatch, scale):
    """Ties in plenty, scores that need 32, 64 and more than 64 bits; blocks and tiles of a few rows."""
    r = random.Random(scale)
    rows = [(i, r.choice([0, 0, 0, 1, 2, None]), [r.randint(-2, 9) * scale // 9 for _ in range(r.choice([4, 4, 4, 2, 0]))], i % 10 == 0) for i in range(400)]
    rows += [(None, 0, [scale] * 4, False), (7, 1, None, True), (8, 1, [1, None, 2, 3], True), (50, 1, [scale, 0, scale, 0], True), (50, 1, [scale, 0, scale, 0], True)]
    rows += [(1000 + i, 0, [scale, scale, 0, 0], False) for i in range(6)] + [(3, 2, [scale // 2] * 4, False)] * 3 + [(-50, 0, [-scale] * 4, True)]
    want = sorted(negatives_by_hand(rows), key=str)
    assert sorted(mined(spark, rows), key=str) == want and len(want) > 200
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 5)
    assert sorted(mined(spark, rows, block_bytes=64 * 4), key=str) == want


def test_hard_negatives_of_other_sizes(spark):
    r = random.Random(5)
    rows = [(i, r.randint(0, 3), [r.randint(0, 30) for _ in range(3)], i % 4 == 0) for i in range(120)]
    how = {"positives": 9, "k": 5, "low": 10, "high": 100}
    assert sorted(mined(spark, rows, **how)) == sorted(negatives_by_hand(rows, **how))


def test_hard_negatives_without_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1], True), (2, 0, [1], True)]) == []  # no negatives
    assert mined(spark, [(1, 0, [1], True), (2, 1, [1], False)]) == []  # no positives


def test_products_pick_an_exact_type():
    import numpy as np

    for top in (100, 10**6, 10**9, 10**17):
        a = np.random.default_rng(1).integers(-top, top, (5, 9))
        got = hard_negatives.products(a, a)
        want = a.astype(object) @ a.astype(object).T
        assert [[int(x) for x in r] for r in got] == [[max(-(2**63), min(2**63 - 1, x)) for x in r] for r in want]


def sequences_by_hand(lengths, capacity):
    """Greedy pairs of items above a third of the capacity, then best fit of the others, item by item: number of sequences."""
    large, small = (sorted((n for n in lengths if (3 * n > capacity) == big), reverse=True) for big in (True, False))
    gaps = []
    while large:
        n = large.pop(0)
        partner = next((m for m in large if n + m <= capacity), None)
        if partner is not None:
            large.remove(partner)
        gaps.append(capacity - n - (partner or 0))
    for n in small:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_is_best_fit():
    r = random.Random(6)
    for trial in range(60):
        capacity = r.choice([3, 10, 17, 64])
        lengths = [r.choice([r.randint(1, capacity), r.randint(1, max(1, capacity // 3)), capacity // 2 or 1]) for _ in range(r.randint(0, 150))]
        plan = packing.Plan(Counter(lengths), capacity)
        assert plan.sequences == sequences_by_hand(lengths, capacity)
        assert len(plan.table()) <= 14 * (capacity + 4)


def test_plan_does_not_grow_with_the_documents():
    few = {n: 1000 + n % 7 for n in range(1, 4097)}
    many = {n: 10**6 * c for n, c in few.items()}
    assert len(packing.Plan(many).table()) < 40_000
    total = sum(n * c for n, c in many.items())
    assert packing.Plan(many).sequences <= 1.02 * total / 4096


@pytest.mark.parametrize("bucket", [4_000, 3])
def test_packing(spark, monkeypatch, bucket):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    tok = Tokenizer.from_file(word_bpe_path())
    r = random.Random(bucket)
    words = "the hail Étude naïve x<|endoftext|>y 日本 don't İstanbul ß \x7f 12 a\x01b éé".split(" ")
    texts = [None, "", " \n", *words] + [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 9, 40]))) for _ in range(150)] + ["a b"] * 30
    rows = [(r.choice([i, None, 3]), t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, _row string").repartition(3)
    capacity = 16
    out = packing.pack(docs, word_bpe_path(), capacity=capacity, with_ids=True)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    got = out.collect()
    want, lengths = Counter(), []
    for key, t, _, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), capacity):
            piece = ids[s : s + capacity]
            want[key, s // capacity, s, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), tuple(piece)] += 1
            lengths.append(len(piece))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)) for x in got) == want
    inside = defaultdict(list)
    for x in got:
        inside[x.sequence_id].append((x.offset, x.length))
    for spans in inside.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    assert len(inside) == sequences_by_hand(lengths, capacity)
    whole = {x.sequence_id: x.ids for x in packing.sequences(out).collect()}
    assert sum(map(len, whole.values())) == sum(lengths) and whole.keys() == inside.keys()


def test_packing_without_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), word_bpe_path()).count() == 0


def ranked_by_hand(docs, items, k=10):
    words = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n, total, df = sum(map(bool, words)), sum(map(len, words)), Counter(w for ws in words for w in set(ws))
    out = []
    for item, text in items:
        scored = []
        for (key, _), ws in zip(docs, words, strict=True):
            tf, score = Counter(ws), 0
            for w in set(TERM.findall((text or "").translate(LOW))):
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * (10 + 90 * len(ws) * n // total)))
            if score:
                scored.append((-score, in_key_order(key), key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scored)[:k])]
    return out


def search_case(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(600)] + ["Éa", "éa", "日本", "A1", "a1"]
    docs = [(r.choice([i, i, i, None, 5]), r.choice(["-", " ", "\n\x7f"]).join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 20, 200])))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " - "), (900, "w1 w2 W3"), (901, "w1 w2 w3"), (901, "w1 w2 w3"), (None, "w1 w2 w3")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w2 w1 w1")]
    return docs, items


@pytest.mark.parametrize("run_docs", [20_000, 15])
def test_search(spark, monkeypatch, run_docs):
    monkeypatch.setattr(lexical, "RUN_DOCS", run_docs)
    docs, items = search_case()
    d = spark.createDataFrame([(*x, 3, "n") for x in docs], "doc_id long, text string, n int, score string").repartition(3)
    q = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int")
    want = sorted(ranked_by_hand(docs, items), key=str)
    got = lexical.search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    blocks = lexical.search(d, q, block_bytes=200)
    assert sorted(map(tuple, blocks.collect()), key=str) == want
    assert sorted(map(tuple, lexical.search(d, q, k=3).collect()), key=str) == sorted(ranked_by_hand(docs, items, 3), key=str)


def test_search_stops_opening_accumulators():
    """With a rare term in k documents, common terms open none; the scores of the survivors stay exact."""
    import numpy as np

    n = 1000
    lists = [[0] * (i < 10) + [1, 2] for i in range(n)]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    terms = np.concatenate([np.array(x) for x in lists])
    run = lexical.Run(np.full(n, 3), ends, terms, np.ones(len(terms), np.int64), n, 3 * n)
    calls, partition = [], np.partition
    lexical.np.partition = lambda a, k: calls.append(len(a)) or partition(a, k)
    try:
        at, score = run.best(np.array([0, 1, 2]), np.array([5000, 10, 1]), 10, 0)
    finally:
        lexical.np.partition = partition
    impact = 1_000_000_000 // (1000 + 800)
    assert at.tolist() == list(range(10)) and set(score.tolist()) == {5011 * impact}
    assert calls == [n]  # one look at the partial scores closed the list; ten documents were left to rank


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_anchors_of_the_query_may_lack_keys(spark, tmp_path):
    from geodemand.llm import LLM_QUERIES

    rows = [(None, [1.0, 0.5], 3), (0, [1.0, 0.5], 3), (50, [0.9, float("nan")], 3), (1, [1.0, 0.4], 3), (2, [0.7, 0.4], 4), (100, None, 4), (3, [0.6, 0.4], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = LLM_QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()
    assert table(spark, str(tmp_path), "embeddings").count() == 7
    # 0 becomes label 4: its one positive is 2, of score 256 * 179 + 128 * 102; the others score higher than that.
    assert got == []
