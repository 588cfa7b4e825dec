"""Choice model, contests against rivals, overlap and displacement between own products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.config import (
    BRAND_WEIGHT, CAPTURE_RATE, DISPLACEMENT_CUT, DISTANCE_SENSITIVITY, FIT_WEIGHT, OVERLAP_CUT, PRICE_SENSITIVITY,
)
from geodemand.functions.scalars import clip, floored_ratio
from geodemand.operators.pairs import close_pairs
from geodemand.session import save_table


def offers(bias: DataFrame, fit: DataFrame, price_reach: DataFrame) -> DataFrame:
    """What every player offers in a state's category, as one array per state and category.

    bias: state_id, player, bias. fit: category, player, fit (scaled to the best player of the
    category). price_reach: player, price_index, reach_km. The array is as long as the list of
    players, so a place meets its whole choice set in one row.
    """
    best = fit.groupBy("category").agg(F.max("fit").alias("_top"))
    f = fit.join(best, "category").withColumn("fit", F.col("fit") / F.col("_top"))
    t = bias.join(f, "player").join(price_reach, "player")
    base = (
        BRAND_WEIGHT * (F.col("bias") - 1) + FIT_WEIGHT * F.col("fit") + PRICE_SENSITIVITY * (F.col("price_index") - 1)
    )
    return t.groupBy("state_id", "category").agg(
        F.array_sort(F.collect_list(F.struct("player", base.alias("u"), F.col("reach_km").alias("reach")))).alias("offers")
    )


def choice_shares(places: DataFrame, offers_: DataFrame, distance: str) -> DataFrame:
    """Share of every player at every place and category: softmax over the choice set.

    Adds `shares`: array of (player, share). Worked out inside the row, so nothing of the size
    places x categories x players is ever shuffled.
    """
    j = places.join(offers_, "state_id")
    u = F.transform(
        "offers", lambda o: o["u"] + DISTANCE_SENSITIVITY * F.greatest(F.lit(0.0), F.col(distance) - o["reach"])
    )
    # Row-wide values go into the lambdas as repeated arrays: a value a lambda refers to directly
    # would be worked out again for every element.
    n = F.size("offers")
    j = j.withColumn("_u", u)
    j = j.withColumn("_e", F.zip_with("_u", F.array_repeat(F.array_max("_u"), n), lambda x, m: F.exp(x - m)))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    j = j.withColumn("_s", F.zip_with("_e", F.array_repeat(total, n), lambda x, t: x / t))
    shares = F.zip_with("offers", "_s", lambda o, x: F.struct(o["player"].alias("player"), x.alias("share")))
    return j.withColumn("shares", shares).drop("offers", "_u", "_e", "_s")


def landscape(shares: DataFrame, own: str) -> DataFrame:
    """Own share, leader, closest rival, gap and concentration of each place and category."""
    ranked = F.array_sort(
        F.transform("shares", lambda s: F.struct((-s["share"]).alias("k"), s["player"].alias("player"), s["share"].alias("share")))
    )
    s = shares.withColumn("_r", ranked)
    leader = F.get("_r", F.lit(0))
    rival = F.get(F.filter("_r", lambda r: r["player"] != own), F.lit(0))
    own_share = F.coalesce(F.get(F.filter("_r", lambda r: r["player"] == own), F.lit(0))["share"], F.lit(0.0))
    return s.select(
        *[c for c in shares.columns if c != "shares"],
        own_share.alias("own_share"),
        leader["player"].alias("leader"),
        leader["share"].alias("leader_share"),
        rival["player"].alias("closest_rival"),
        rival["share"].alias("rival_share"),
        (rival["share"] - own_share).alias("share_gap"),
        F.aggregate("shares", F.lit(0.0), lambda a, r: a + r["share"] * r["share"]).alias("hhi"),
    )


def player_shares(shares: DataFrame, group: str) -> DataFrame:
    """Mean share of each player over the places of a group."""
    e = shares.select(group, "category", F.explode("shares").alias("s"))
    return e.groupBy(group, "category", F.col("s.player").alias("player")).agg(F.avg("s.share").alias("share"))


def graded_lands(land: DataFrame, own: str) -> DataFrame:
    """The landscape with how close the contest is and what part of the units can be won or lost, the same for all products."""
    s = land.withColumn("closeness", floored_ratio(F.col("own_share"), F.col("own_share") + F.col("rival_share")))
    c = F.col("closeness")
    status = (
        F.when(F.col("leader") == own, "Leading").when(c >= 0.42, "Winnable").when(c >= 0.28, "Stretch").otherwise("Out of reach")
    )
    return s.withColumns({
        "status": status, "win_part": F.pow(clip((c - 0.25) / 0.35, 0, 1), F.lit(1.5)), "loss_part": F.pow(clip(1 - c, 0, 1), F.lit(1.2)),
    })


def grade_contests(scores: DataFrame, norm: DataFrame) -> DataFrame:
    """Own and rival units of each scored row and what can be won or lost of them.

    `scores` carries the graded landscape of its place and category; `norm` has the mean own share of a category's
    rows (category, _norm), a small stored table, so the scored rows stay where they are.
    """
    s = scores.withColumnRenamed("potential_units_yr", "market_units")
    s = s.withColumn("own_units", F.col("market_units") * F.col("own_share"))
    s = s.withColumn("competitor_units", F.col("market_units") - F.col("own_units"))
    s = s.join(norm, "category").withColumn("share_index", floored_ratio("own_share", "_norm") * 100).drop("_norm")
    win = F.col("competitor_units") * F.col("win_part") * 0.30
    lose = F.col("own_units") * F.col("loss_part") * 0.40
    return s.withColumns({"winnable_units": win, "at_risk_units": F.least(lose, F.col("own_units"))}).drop("win_part", "loss_part")


def market_sums(contests: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the contest measures for any grouping (none = one row)."""
    g = contests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("contests"),
        *[F.sum(c).alias(n) for c, n in (
            ("market_units", "market"), ("own_units", "own"), ("competitor_units", "competitor"),
            ("winnable_units", "winnable"), ("at_risk_units", "at_risk"))],
        F.avg("hhi").alias("hhi"),
        F.avg("closeness").alias("closeness"),
    )
    return g.withColumn("own_share_pct", F.when(F.col("market") != 0, F.col("own") / F.col("market") * 100).otherwise(0.0))


# ---------------------------------------------------------------- substitution


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return dot / (norm(a) * norm(b))


def item_overlap(items: DataFrame, cut: float = OVERLAP_CUT) -> DataFrame:
    """Pairs of products that compete for the same sale.

    items: sku_id, price, jobs, bands, sizes, crops, season (arrays). Only products that share
    a job can substitute, and a pair whose prices differ by too much cannot reach the cut, so
    pairs are formed by job and price band; a job of any size is dealt as a triangle of blocks.
    """
    import math

    reach = -1.4 * math.log(cut) * (1 + 1e-9)
    cols = ["sku_id", "category", "price", "_lp", "jobs", "bands", "sizes", "crops", "season", "_job"]
    it = items.withColumn("_lp", F.log("price")).withColumn("_job", F.explode("jobs")).select(*cols)
    p = close_pairs(it, "_job", "_lp", reach, "sku_id").withColumnRenamed("_job_a", "_job")
    # A pair that shares several jobs is met once per job; the first shared job speaks for it.
    shared = F.array_sort(F.array_intersect("jobs_a", "jobs_b"))
    p = p.where(F.col("_job") == shared[0])
    c = lambda n: cosine(F.col(f"{n}_a"), F.col(f"{n}_b"))
    ov = c("bands") * c("sizes") * c("crops") * (0.55 + 0.45 * c("season")) * F.exp(-F.abs(F.col("_lp_a") - F.col("_lp_b")) / 1.4)
    return p.select(
        F.col("sku_id_a").alias("sku_a"), F.col("sku_id_b").alias("sku_b"), F.concat_ws(", ", shared).alias("shared_job"),
        (F.col("category_a") == F.col("category_b")).alias("same_category"), F.col("price_a"), F.col("price_b"), ov.alias("overlap"),
    ).where(F.col("overlap") >= cut)


PAIRS_BESIDE_A_ROW = 100_000  # hot pairs, a few MB, that are put beside every place; more are joined


def _concessions(units: DataFrame, pairs: DataFrame, cut: float, rate: float) -> DataFrame:
    """Per place and hot pair: the units both count, and which product gives way.

    units: one row per place and product. The lines of a place are gathered into one map, as long as
    the catalogue, and every line looks its partners up in it: nothing of the fact is joined to
    itself, and what follows per place needs no further exchange.
    """
    hot = save_table(pairs.where(F.col("overlap") >= cut).select("sku_a", "sku_b", (F.col("overlap") * rate).alias("frac")), "hot-pairs")
    if hot.count() > PAIRS_BESIDE_A_ROW:
        j = _joined_pairs(units, hot)
    else:
        j = _pairs_in_row(units, hot)
    # Lines equal up to rounding noise count as equal, and the first one gives way.
    a_gives = F.col("ua") <= F.col("ub") + 1e-12
    return j.select(
        "place_id", "sku_a", "sku_b", "frac",
        F.least("ua", "ub").alias("shared"),
        F.when(a_gives, F.col("sku_a")).otherwise(F.col("sku_b")).alias("sku_id"),
        F.when(a_gives, F.col("ua")).otherwise(F.col("ub")).alias("own"),
    )


def _joined_pairs(units: DataFrame, hot: DataFrame) -> DataFrame:
    a = units.select("place_id", F.col("sku_id").alias("sku_a"), F.col("units").alias("ua"))
    b = units.select("place_id", F.col("sku_id").alias("sku_b"), F.col("units").alias("ub"))
    return a.join(hot, "sku_a").join(b, ["place_id", "sku_b"])


def _pairs_in_row(units: DataFrame, hot: DataFrame) -> DataFrame:
    """place_id, sku_a, sku_b, frac, ua, ub, from one row per place; products by their number."""
    skus = [r[0] for r in hot.select("sku_a").union(hot.select("sku_b")).distinct().orderBy("sku_a").collect()]
    numbers = units.sparkSession.createDataFrame(list(enumerate(skus)), f"_i int, sku_id {units.schema['sku_id'].dataType.simpleString()}")
    number = {s: i for i, s in enumerate(skus)}
    beside: list[list[tuple[int, float]]] = [[] for _ in skus]
    for r in hot.collect():
        beside[number[r["sku_a"]]].append((number[r["sku_b"]], r["frac"]))
    one = units.sparkSession.createDataFrame([(skus, beside)], "skus array<string>, beside array<array<struct<_b:int,frac:double>>>")
    partners, names = (one.select(c).scalar() for c in ("beside", "skus"))
    lines = units.join(numbers, "sku_id").groupBy("place_id").agg(F.map_from_entries(F.collect_list(F.struct("_i", "units"))).alias("_m"))
    own = lines.select("place_id", "_m", F.explode("_m").alias("_a", "ua"))
    met = own.select("place_id", "_m", "_a", "ua", F.inline(F.get(partners, F.col("_a"))))
    met = met.withColumn("ub", F.col("_m")[F.col("_b")]).where(F.col("ub").isNotNull())
    return met.select("place_id", F.get(names, F.col("_a")).alias("sku_a"), F.get(names, F.col("_b")).alias("sku_b"), "frac", "ua", "ub")


def displacement_by_pair(units: DataFrame, pairs: DataFrame, min_units: float = 1.0, cut=DISPLACEMENT_CUT, rate=CAPTURE_RATE) -> DataFrame:
    """Units and value that each pair of own products both count."""
    c = _concessions(units, pairs, cut, rate)
    g = c.groupBy("sku_a", "sku_b").agg(
        F.sum(F.when(F.col("shared") > 0.01, 1).otherwise(0)).alias("places_affected"),
        F.sum(F.col("shared") * F.col("frac")).alias("displaced_units"),
    ).where(F.col("displaced_units") >= min_units)
    return g.join(pairs, ["sku_a", "sku_b"]).withColumn(
        "displaced_value", F.col("displaced_units") * F.least("price_a", "price_b")
    )


def displacement_by_item(units: DataFrame, pairs: DataFrame, cut=DISPLACEMENT_CUT, rate=CAPTURE_RATE) -> DataFrame:
    """Units each product loses to its siblings, as a survival product so it never exceeds its own.

    At each place the smaller line of a pair gives way (the first on equal lines).
    """
    c = _concessions(units, pairs, cut, rate)
    hit = F.when(F.col("own") > 0, clip(F.col("shared") / F.greatest("own", F.lit(1e-9)) * F.col("frac"), 0, 1)).otherwise(0.0)
    kept = c.groupBy("place_id", "sku_id").agg(F.product(1 - hit).alias("retain"), F.max("own").alias("own"))
    lost = kept.groupBy("sku_id").agg(F.sum(F.col("own") * (1 - F.col("retain"))).alias("displaced_units"))
    gross = units.groupBy("sku_id").agg(F.sum("units").alias("gross_units"))
    return lost.where(F.col("displaced_units") > 0).join(gross, "sku_id").withColumn(
        "displaced_pct", floored_ratio("displaced_units", "gross_units") * 100
    )
