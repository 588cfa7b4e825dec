"""Close pairs equal brute force, and no join key holds more than a bounded number of rows."""

import random

from pyspark.sql import functions as F

from geodemand.operators import pairs as P


def rows_of(n, seed=5):
    """Half of all rows in one group, a third of them at one value; some without group, value or key."""
    r = random.Random(seed)
    out = [("hot" if r.random() < 0.5 else f"g{r.randint(0, 6)}", 7.0 if r.random() < 0.33 else r.uniform(-20, 20), i, "x") for i in range(n)]
    return out + [(None, 1.0, -1, "x"), ("hot", None, -2, "x"), ("hot", 7.0, None, "x"), ("hot", 7.0, 0, "again"), ("edge", 2.0, -5, "x"), ("edge", 4.0, -6, "x"), ("edge", 4.1, -7, "x")]


def test_close_pairs(spark):
    for n, block in ((0, 4), (300, 7), (300, 1000)):
        rows = rows_of(n)
        frame = spark.createDataFrame(rows, "grp string, val double, id long, note string").repartition(3)
        got = sorted((x.id_a, x.id_b, x.val_a, x.val_b, x.note_a, x.note_b) for x in P.close_pairs(frame, "grp", "val", 2.0, "id", block).collect())
        full = [x for x in rows if None not in x]
        want = sorted(
            (a[2], b[2], a[1], b[1], a[3], b[3]) for a in full for b in full if a[0] == b[0] and a[2] < b[2] and abs(a[1] - b[1]) <= 2.0
        )
        assert got == want


def test_a_hot_group_is_spread(spark):
    """5,000 rows of one group and one value: no key of the join has more than two blocks' worth on a side."""
    frame = spark.range(5000).select(F.lit("g").alias("grp"), F.lit(1.0).alias("val"), "id")
    for side in P.dealt(frame, "grp", "val", 2.0, "id", 100):
        top, keys = side.groupBy("_group", "_low", "_step", "_below", "_above").count().agg(F.max("count"), F.count("*")).first()
        assert top <= 200 and keys == 50 * 51 // 2
