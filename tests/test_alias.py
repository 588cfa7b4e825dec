"""Containment of keys through their rarest run."""

import random

from geodemand.operators import entity as E


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, x string").repartition(3)


def test_contained_is_every_containment(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    parts = sorted({(r.choice("uv"), word(r.choice([0, 1, 2, 3, 4, 6]))) for _ in range(120)})
    wholes = sorted({(r.choice("uv"), word(r.choice([0, 1, 2, 3, 5, 9]))) for _ in range(120)})
    got = {tuple(x) for x in E.contained(frame(spark, parts), frame(spark, wholes), "s").collect()}
    assert got == {(s, p, w) for s, p in parts for t, w in wholes if s == t and p and p in w} and len(got) > 300


def test_names_with_one_stem_meet_few(spark):
    """Four hundred names of one stem: a name is held against those that share its rarest run, not against all."""
    names = [("u", f"nationaldistrict{i:03d}") for i in range(400)]
    longer = [("u", f"nationaldistrict{i:03d}north") for i in range(400)]
    pairs = E.candidates(frame(spark, names), frame(spark, longer), "s").groupBy("part").count().toPandas()
    assert len(pairs) == 400 and pairs["count"].max() <= 12
