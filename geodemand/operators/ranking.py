"""Ranks and exact quantiles without a single-task window.

One primitive serves all of them: the distinct values of each group with the number of rows
at and before each value. Ties collapse before the first shuffle, the ordered value range is
cut at sampled quantiles, and running counts are taken inside each cut and shifted by the
totals of the cuts before it. No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.operators.skew import SALT, add_all_salts, add_salt, hot_keys
from geodemand.session import parallelism, save_table, spread

N_TIES, N_BEFORE, N_GROUP = "n_ties", "n_before", "n_group"


def usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value))


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return (
        df.where(usable(value))
        .select(*by, F.col(value).cast("double").alias(value))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias(N_TIES))
    )


def ordered_counts(
    df: DataFrame, value: str, by: list[str], cuts: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per group and distinct value: rows at it, rows below it, rows of the group.

    A cut holds at most about 1/cuts of all distinct values, whichever groups they belong to,
    so a group with a third of the rows is spread like any other. The counts are written once:
    the bounds of the cuts, the totals and the running counts all read them.
    """
    cuts = cuts or parallelism(df.sparkSession)
    counts = counts if counts is not None else save_table(value_counts(df, value, by), "counts")
    probs = [i / cuts for i in range(1, cuts)]
    bounds = counts.agg(F.percentile_approx(value, probs, 100 * cuts)).first()[0] or []
    inner = sorted({b for b in bounds if abs(b) != float("inf")})
    if inner:
        cut = Bucketizer(
            splits=[-float("inf"), *inner, float("inf")], inputCol=value, outputCol="_cut"
        ).transform(counts)
    else:
        cut = counts.withColumn("_cut", F.lit(0.0))

    part = [F.col(c) for c in by] or [F.lit(0)]
    totals = cut.groupBy(*by, "_cut").agg(F.sum(N_TIES).alias("_n"))
    steps = Window.partitionBy(*part).orderBy("_cut")
    offsets = totals.select(
        *by,
        "_cut",
        (F.sum("_n").over(steps) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*part)).alias(N_GROUP),
    )
    local = Window.partitionBy(*by, "_cut").orderBy(value)
    running = cut.withColumn("_run", F.sum(N_TIES).over(local))
    return running.join(offsets, [*by, "_cut"]).select(
        *by,
        value,
        N_TIES,
        (F.col("_offset") + F.col("_run") - F.col(N_TIES)).alias(N_BEFORE),
        N_GROUP,
    )


def average_rank() -> Column:
    """Ascending rank with ties sharing their mean position, from 1."""
    return F.col(N_BEFORE) + (F.col(N_TIES) + 1) / 2


def pct_of_group() -> Column:
    return average_rank() / F.col(N_GROUP)


def descending_rank() -> Column:
    """Descending mean-tie rank truncated to a whole number."""
    return F.floor(F.col(N_GROUP) + 1 - average_rank()).cast("bigint")


def ranked(df: DataFrame, value: str, by: list[str], key: str, **outputs: Column) -> DataFrame:
    """Rows with rank expressions attached; rows without a usable value or without a group keep null ranks.

    The rows are moved once, to the cut of their group that their value falls in, and ranked there; what lies in
    the cuts before follows from the counts of the cuts. A value at a bound is a cut of its own: its rows tie, so
    they are spread by a salt where they are many, and so are the rows without a rank.
    """
    n = parallelism(df.sparkSession)
    v = F.when(usable(value), F.col(value).cast("double") + 0.0)
    found = df.agg(F.percentile_approx(v, [i / n for i in range(1, n)], 100 * n)).first()[0]
    rows = _with_cut(df.withColumn("_v", v), "_v", "_cut", found).drop("_v")
    for b in by:
        rows = rows.withColumn("_cut", F.when(F.col(b).isNotNull(), F.col("_cut")))
    rows = rows.withColumn("_cut", F.coalesce("_cut", F.lit(-1)))
    keys = ["_cut", *by]
    counts = save_table(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counts")
    hot = hot_keys(counts.where("_cut % 2 != 1"), keys, "_n")
    part = [F.col(b) for b in by] or [F.lit(0)]
    upto = F.sum("_n").over(Window.partitionBy(*part).orderBy("_cut"))
    at = counts.where("_cut >= 0").withColumns({"_before": upto - F.col("_n"), N_GROUP: F.sum("_n").over(Window.partitionBy(*part))})
    if hot is not None:
        rows, at = add_salt(rows, hot, keys, [key]), add_all_salts(at, hot, keys)
        keys = [*keys, SALT]
    # The value is taken from its column again, so that it does not travel twice.
    w = Window.partitionBy(*keys).orderBy(v)
    rows = spread(rows, *keys).withColumns({"_first": F.rank().over(w).cast("bigint"), "_last": F.count(F.lit(1)).over(w)})
    tied, first = F.col("_cut") % 2 == 0, F.col("_before") + F.col("_first") - 1
    ranks = {N_TIES: F.when(tied, F.col("_n")).otherwise(F.col("_last") - F.col("_first") + 1), N_BEFORE: F.when(tied, F.col("_before")).otherwise(first)}
    joined = rows.join(at, keys, "left").withColumns({c: F.when(F.col("_cut") >= 0, e) for c, e in ranks.items()})
    return joined.select(*df.columns, *[e.alias(c) for c, e in outputs.items()])


def _with_cut(rows: DataFrame, value: str, out: str, found: list | None) -> DataFrame:
    """`out`: 2i for values equal to bound i, 2i + 1 for those between it and the next; null for none. Bounds are those found, and infinity."""
    splits = [-float("inf"), *sorted({b for b in found or [] if abs(b) != float("inf")}), float("inf")]
    v = F.coalesce(F.col(value), F.lit(0.0))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(rows.withColumn("_x", v))
    else:
        rows = rows.withColumns({"_x": v, "_b": F.lit(0.0)})
    low = F.array(*[F.lit(b) for b in splits])[F.col("_b").cast("int")]
    cut = 2 * F.col("_b").cast("int") + (v != low).cast("int")
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), cut)).drop("_x", "_b")


def pct_rank(
    df: DataFrame, value: str, key: str, by: list[str] | None = None, out: str = "pct", invert=False
) -> DataFrame:
    """Percentile rank 0-100, ties averaged, nulls kept; `invert` reverses the scale."""
    e = pct_of_group() * 100
    return ranked(df, value, by or [], key, **{out: 100 - e if invert else e})


def melt(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form: one row per id and metric."""
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ]
    return df.select(*ids, F.explode(F.array(*cells)).alias("_c")).select(
        *ids, "_c.metric", "_c.value"
    )


def pct_ranks(
    df: DataFrame, key: str, metrics: list[str], scopes: dict[str, str | None]
) -> DataFrame:
    """Percentile ranks of many metrics in several scopes in one pass.

    `scopes` maps a scope name to the column that bounds it (None = all rows). The result is
    long: key, metric, scope, pct.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"pct_{s}").alias("pct")) for s in scopes])
    return scope_ranks(df, key, metrics, scopes).select(key, "metric", F.inline(cells))


def scope_ranks(
    df: DataFrame, key: str, metrics: list[str], scopes: dict[str, str | None]
) -> DataFrame:
    """Percentile ranks of many metrics: key, metric and a column pct_<scope> per scope, a row per row and metric.

    The cells (row x metric) are moved once, to the cut of their metric that their value falls in, and all
    scopes are ranked there from the same rows. A value at a bound is a cut of its own: its rows tie, so their
    ranks follow from the counts of the cuts, and they are not moved, however many they are.
    """
    by = {s: f"_by_{s}" for s, c in scopes.items() if c}
    cells = _cells(df, key, metrics, {b: scopes[s] for s, b in by.items()})
    known = cells.where("_cut is not null")
    counts = save_table(known.groupBy("_m", "_cut", *by.values()).agg(F.count(F.lit(1)).alias("_n")), "counts")

    tied, spanned = known.where("_cut % 2 = 0"), spread(known.where("_cut % 2 = 1"), "_m", "_cut")
    at = counts
    for s in scopes:
        part = ["_m", by[s]] if s in by else ["_m"]
        here = F.sum("_n").over(Window.partitionBy(*part, "_cut"))
        upto = F.sum("_n").over(Window.partitionBy(*part).orderBy("_cut"))
        at = at.withColumns({f"_here_{s}": here, f"_before_{s}": upto - here, f"_all_{s}": F.sum("_n").over(Window.partitionBy(*part))})
        w = Window.partitionBy("_cut", *part).orderBy("_v")
        # First and last position of equal values inside the cut.
        spanned = spanned.withColumns({f"_first_{s}": F.rank().over(w).cast("bigint"), f"_last_{s}": F.count(F.lit(1)).over(w)})
        tied = tied.withColumns({f"_first_{s}": F.lit(1).cast("bigint"), f"_last_{s}": F.lit(None).cast("bigint")})
    at = save_table(at.drop("_n").withColumnsRenamed({c: f"at{c}" for c in ("_m", "_cut", *by.values())}), "cuts")

    name = F.array(*[F.lit(m) for m in metrics])[F.col("_m")].alias("metric")
    same = [F.col(c).eqNullSafe(F.col(f"at{c}")) for c in ("_m", "_cut", *by.values())]
    pct = []
    for s in scopes:
        last = F.coalesce(F.col(f"_last_{s}"), F.col(f"_here_{s}"))
        p = (F.col(f"_before_{s}") + (F.col(f"_first_{s}") + last) / 2) / F.col(f"_all_{s}") * 100
        # Rows without a scope have no rank in it.
        pct.append((F.when(F.col(by[s]).isNotNull(), p) if s in by else p).alias(f"pct_{s}"))
    r = [d.join(at, same).select(key, name, *pct) for d in (tied, spanned)]
    none = [F.lit(None).cast("double").alias(f"pct_{s}") for s in scopes]
    return r[0].unionByName(r[1]).unionByName(cells.where("_cut is null").select(key, name, *none))


def _cells(df: DataFrame, key: str, metrics: list[str], scopes: dict[str, str]) -> DataFrame:
    """One row per row and metric: key, scopes, number of the metric, value, cut.

    The bounds of a metric are its sampled quantiles b1 < b2 < ...; cut 2i holds the values equal to bi, cut
    2i + 1 those between bi and the next, at most about 1/parallelism of the rows; null for no usable value.
    """
    n = parallelism(df.sparkSession)
    value = {f"_v{i}": F.when(usable(m), F.col(m).cast("double") + 0.0) for i, m in enumerate(metrics)}
    rows = spread(df.select(key, *[F.col(c).cast("string").alias(b) for b, c in scopes.items()], *[v.alias(k) for k, v in value.items()]), key)
    cell = lambda *more: F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), *[F.col(f"{x}{i}").alias(x) for x in more]) for i in range(len(metrics))]))
    probs = [i / n for i in range(1, n)]
    found = rows.select(cell("_v")).groupBy("_m").agg(F.percentile_approx("_v", probs, 100 * n).alias("b")).collect()
    bounds = {r["_m"]: r["b"] for r in found}
    for i in range(len(metrics)):
        rows = _with_cut(rows, f"_v{i}", f"_cut{i}", bounds.get(i))
    return rows.select(key, *scopes, cell("_v", "_cut"))


def quantiles(df: DataFrame, value: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name."""
    t = ordered_counts(df, value, by)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col(N_GROUP) - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col(N_BEFORE) <= at) & (at < F.col(N_BEFORE) + F.col(N_TIES))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{tag}"))
    g = t.groupBy(*by).agg(F.max(N_GROUP).alias(N_GROUP), *aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col(N_GROUP) - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return g.select(*by, *out)


def metric_quantiles(
    df: DataFrame, metrics: list[str], by: list[str], probs: dict[str, float]
) -> DataFrame:
    """Quantiles of several metrics at once: by, metric, one column per quantile."""
    return quantiles(melt(df, by, metrics), "value", [*by, "metric"], probs)


def wide(long: DataFrame, by: list[str], metrics: list[str], value: str, suffix: str = "") -> DataFrame:
    """Metric rows back to columns, with partial aggregation before the shuffle."""
    aggs = [F.max(F.when(F.col("metric") == m, F.col(value))).alias(f"{m}{suffix}") for m in metrics]
    return long.groupBy(*by).agg(*aggs)


def robust_scale(
    df: DataFrame, key: str, metrics: list[str], by: list[str] | None = None, bound: float = 5.0
) -> DataFrame:
    """(x - median) / interquartile range, degenerate ranges taken as 1, bounded."""
    by = by or []
    q = metric_quantiles(df, metrics, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    q = q.select(*by, "metric", F.struct("q2", F.when(iqr < 1e-9, 1.0).otherwise(iqr).alias("iqr")).alias("p"))
    params = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("p"))).alias(f"_p_{m}") for m in metrics]
    )
    if by:
        joined = df.join(params, by)
        p = {m: F.col(f"_p_{m}") for m in metrics}
    else:
        joined = df
        one = params.select(F.struct(*params.columns).alias("s")).scalar()
        p = {m: one[f"_p_{m}"] for m in metrics}
    z = [
        F.greatest(
            F.lit(-bound), F.least(F.lit(bound), (F.col(m) - p[m]["q2"]) / p[m]["iqr"])
        ).alias(f"{m}_z")
        for m in metrics
    ]
    return joined.select(key, *by, *z)


def zscores(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Departure from the peer mean in peer standard deviations (sample form); 0 if degenerate."""
    stats = df.groupBy(*by).agg(
        *[F.avg(m).alias(f"_m_{m}") for m in metrics],
        *[F.stddev_samp(m).alias(f"_s_{m}") for m in metrics],
    )
    j = df.join(stats, by)
    z = [
        F.coalesce(
            (F.col(m) - F.col(f"_m_{m}")) / F.when(F.col(f"_s_{m}") != 0, F.col(f"_s_{m}")), F.lit(0.0)
        ).alias(f"{m}_z")
        for m in metrics
    ]
    return j.select(*df.columns, *z)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """First n rows of each group; the group limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
