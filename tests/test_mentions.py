"""Product mentions against a direct reading of the rule, for catalogues of any size and texts of any length."""

import random
import re
import time

import pytest

from geodemand.operators import entity as E


def plain(t, letters="a-z"):
    return re.sub(" +", " ", re.sub(f"[^{letters} ]", " ", t.lower())).strip(" ")


def by_hand(texts, catalogue, generic=E.GENERIC_WORDS):
    out = {}
    for key, t in texts:
        q, cand = plain(t or ""), []
        words = set(q.split(" "))
        for item, name, ceiling in catalogue:
            v, score = plain(name), 0.0
            if not v:
                continue
            telling = [w for w in v.split(" ") if len(w) > 3 and w not in generic]
            hits = sum(w in words or w + "s" in words or w.rstrip("s") in words for w in telling)
            if len(v) > 4 and v in q:
                score = 2.0 * len(v)
            elif telling and hits / len(telling) >= 0.5:
                score = hits / len(telling) * len(v)
            if score > 0 and q:
                cand.append((score, item, ceiling))
        top = max((c[0] for c in cand), default=0)
        if top >= 5:
            best = min((c for c in cand if c[0] >= 0.75 * top), key=lambda c: (-c[2], -c[0], c[1]))
            out[key] = (best[1], round(best[0], 6))
    return out


def found(spark, texts, catalogue, **how):
    t = spark.createDataFrame(texts, "text_id long, txt string").repartition(3)
    c = spark.createDataFrame(catalogue, "item string, name string, ceiling double")
    return {r.text_id: (r.item, round(r.score, 6)) for r in E.product_mentions(t, "text_id", "txt", c, **how).collect()}


def test_mentions_of_a_small_catalogue(spark):
    catalogue = [
        ("a", "Round Baler", 3.0), ("a", "round_baler_x", 3.0), ("b", "Square Baler", 5.0), ("c", "rake", 9.0), ("d", "Orchard Sprayer", 1.0),
        ("e", "Farm Trolley", 2.0), ("f", "Trolley", 2.0), ("g", "glass", 1.0), ("h", "--", 1.0), ("i", "tanks tanks wagon", 1.0), ("j", "Tractor Unit", 50.0),
    ]
    texts = [
        "Top districts for balers?", "the round baler", "background balers", "around baler x", "orchard", "orchard sprayers and trolleys", "TROLLEY!", "rakes", "rake",
        "glas", "glasses", "hourglass", "tanks", "tank wagons", "how are tractors selling", "round sprayer baler", "", None, "!!", "round\nbaler", "xround balerx", "b rake r",
    ]
    texts = list(enumerate(texts))
    assert found(spark, texts, catalogue) == by_hand(texts, catalogue)


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_of_a_large_catalogue(spark, seed):
    r = random.Random(seed)
    words = ["plough", "seeder", "rake", "baler", "mower", "drill", "harrows", "cart", "press", "farm", "ox", "rakes"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.choice([1, 2, 2, 3, 4]))) + r.choice(["", "", f" {chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}"]) for _ in range(900)})
    catalogue = [(f"i{i % 400}", x, float(r.randint(0, 9))) for i, x in enumerate(names)]
    catalogue = [(i, x, float(int(i[1:]) % 7)) for i, x, _ in catalogue]
    texts = []
    for k in range(300):
        t = [r.choice(words + ["the", "of", "balers", "ploughs", "xrake", "rakey"]) for _ in range(r.choice([0, 1, 2, 4, 12]))]
        if k % 3 == 0:
            t.insert(r.randint(0, len(t)), r.choice(["", "x", "my"]) + r.choice(names) + r.choice(["", "s", "ed"]))
        texts.append((k, " ".join(t)))
    assert len(names) > 500
    assert found(spark, texts, catalogue) == by_hand(texts, catalogue)


def test_letters_of_the_catalogue(spark):
    texts, catalogue = [(1, "Any GEAR of brand#12?"), (2, "gear of brand#13")], [("g12", "gear brand#12", 1.0), ("g13", "gear of brand#13", 1.0)]
    assert found(spark, texts, catalogue, letters="a-z0-9")[2] == ("g13", 2.0 * len("gear of brand 13"))


def test_without_texts_or_names(spark):
    assert found(spark, [], [("a", "round baler", 1.0)]) == {} and found(spark, [(1, "round baler")], []) == {}


def test_time_grows_with_the_text_not_its_square(spark):
    """A text of one long token and of many tokens: four times the length, far less than sixteen times the seconds."""
    catalogue = [("a", "round baler", 1.0), ("b", "harrows", 1.0)]
    r = random.Random(1)

    def seconds(n):
        texts = [(1, "".join(r.choice("abcdehrosw") for _ in range(n)) + " the round baler"), (2, " ".join(r.choice(["ab", "round", "harrow", "x"]) for _ in range(n // 4)))]
        start = time.perf_counter()
        assert found(spark, texts, catalogue)[1] == ("a", 22.0)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 8 * max(seconds(40_000), 1.0)
