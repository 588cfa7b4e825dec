"""The incremental results equal the batch results."""

import datetime
import random
from pathlib import Path

from pyspark.sql import functions as F

from geodemand.plans import QUERIES
from geodemand.sources import roles
from geodemand.streaming import events as E


def test_daily_rollup_equals_batch(spark, sf):
    got = {(r.day, r.event_type): (r.n, round(r.value, 4)) for r in QUERIES["stream_event_rollup"](spark, sf).collect()}
    e = roles.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    want = {(r.day, r.event_type): (r.n, round(r.value, 4)) for r in b.collect()}
    assert got == want and got


def test_idle_sessions_do_not_overlap(spark, sf):
    s = QUERIES["stream_idle_sessions"](spark, sf).toPandas().sort_values(["user_id", "started"])
    nxt = s.groupby("user_id")["started"].shift(-1)
    assert ((nxt.isna()) | (s["expired"] <= nxt)).all() and len(s) > 0


def put(spark, folder, rows):
    """One more event file."""
    frame = spark.createDataFrame(rows, "user_id long, event_type string, value double, ts timestamp").coalesce(1)
    frame.write.mode("append").parquet(folder)


def test_batches_rewrite_only_what_they_touch(spark, tmp_path):
    """Three batches with late events: results equal those of one batch, and untouched days are not written again."""
    r = random.Random(3)
    start = datetime.datetime(2024, 3, 1)
    row = lambda day: (r.randint(1, 9), r.choice("ab"), float(r.randint(0, 9)), start + datetime.timedelta(days=day, minutes=r.randint(0, 1439)))
    batches = [[row(d) for d in (0, 1, 2, 3) for _ in range(20)], [row(d) for d in (3, 4) for _ in range(20)] + [(1, "a", 1.0, None)], [row(0) for _ in range(5)]]
    folder, keep = str(tmp_path / "in"), []
    places = {"rollup": (E.daily_rollup(), str(tmp_path / "r")), "idle": (E.idle_sessions("12 hours"), str(tmp_path / "i"))}
    for rows in batches:
        put(spark, folder, rows)
        keep += [x for x in rows if x[3]]
        got = {name: E.run_once(E.read_events(spark, folder, "*.parquet"), table, name, base).collect() for name, (table, base) in places.items()}
        want = {}
        for _, kind, value, ts in keep:
            n, v = want.get((ts.replace(hour=0, minute=0), kind), (0, 0.0))
            want[ts.replace(hour=0, minute=0), kind] = (n + 1, v + value)
        assert {(x.day, x.event_type): (x.n, x.value) for x in got["rollup"]} == want and len(got["rollup"]) == len(want)
        sessions, silence = [], datetime.timedelta(hours=12)
        for user in {x[0] for x in keep}:
            times, mine = sorted(x[3] for x in keep if x[0] == user), []
            for t in times:
                if mine and t <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], t + silence, mine[-1][2] + 1)
                else:
                    mine.append((t, t + silence, 1))
            sessions += [(user, *x) for x in mine]
        assert sorted(tuple(x) for x in got["idle"]) == sorted(sessions)
    written = [{p.name[5:] for p in (tmp_path / "r" / "rows" / f"batch={i}").glob("part=*")} for i in range(3)]
    assert written == [{"2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"}, {"2024-03-04", "2024-03-05"}, {"2024-03-01"}]


def test_a_batch_run_again_counts_once(spark, tmp_path):
    """Progress of the last batch is lost after its rows were written: the batch comes again under its number."""
    folder, base, day = str(tmp_path / "in"), tmp_path / "out", datetime.datetime(2024, 3, 1, 5)
    for _ in range(2):
        put(spark, folder, [(1, "a", 2.0, day)])
        E.run_once(E.read_events(spark, folder, "*.parquet"), E.daily_rollup(), "again", str(base))
    for path in Path(base, "progress", "commits").iterdir():
        if path.name.strip(".").split(".")[0] == "1":
            path.unlink()
    got = E.run_once(E.read_events(spark, folder, "*.parquet"), E.daily_rollup(), "again", str(base)).collect()
    assert [(x.event_type, x.n, x.value) for x in got] == [("a", 2, 4.0)]


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], "user_id long, event_type string, value double, ts timestamp").write.parquet(str(tmp_path / "in"))
    for table in (E.daily_rollup(), E.idle_sessions()):
        assert E.run_once(E.read_events(spark, str(tmp_path / "in"), "*.parquet"), table, "none").count() == 0
