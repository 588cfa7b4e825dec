"""Questions about the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import config as C
from geodemand.operators import panel as P
from geodemand.operators.ranking import quantiles
from geodemand.plans import scoring as SC
from geodemand.plans.panel_role import REGRESSORS, panel
from geodemand.plans.registry import cte, query
from geodemand.session import stage
from geodemand.sources import roles


@query(
    "panel_monthly",
    """SELECT district_id, strftime(month, '%Y-%m') AS month, round(y, 2) AS y, round(x1, 8) AS x1, round(x2, 6) AS x2, round(x3, 8) AS x3,
         round(x4, 8) AS x4, n_orders FROM panel""",
    needs=("panel",),
)
def panel_monthly(spark, sf):
    p = panel(spark, sf)
    return p.select(
        "district_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("y", 2).alias("y"), F.round("x1", 8).alias("x1"),
        F.round("x2", 6).alias("x2"), F.round("x3", 8).alias("x3"), F.round("x4", 8).alias("x4"), "n_orders",
    )


@query("latest12_mean", "SELECT district_id, round(wage, 8) AS x1, round(rain, 6) AS x2 FROM latest12", needs=("latest12",))
def latest12_mean(spark, sf):
    l = P.latest_periods_mean(panel(spark, sf), "district_id", "month", ["x1", "x2"])
    return l.select("district_id", F.round("x1", 8).alias("x1"), F.round("x2", 6).alias("x2"))


cte(
    "parts12",
    """SELECT district_id, month, ln(y) AS ly, avg(ln(y)) OVER (PARTITION BY district_id, month(month)) - avg(ln(y)) OVER (PARTITION BY district_id) AS seasonal,
         b1 * x1 AS contrib_x1, b2 * x2 AS contrib_x2,
         ln(y) - (avg(ln(y)) OVER (PARTITION BY district_id, month(month)) - avg(ln(y)) OVER (PARTITION BY district_id)) - b1 * x1 - b2 * x2 AS irregular
       FROM panel JOIN (SELECT district_id, max(CASE WHEN regressor = 'x1' THEN beta END) AS b1, max(CASE WHEN regressor = 'x2' THEN beta END) AS b2
         FROM fwl GROUP BY 1) USING (district_id)""",
    "panel", "fwl",
)


def simple_parts(spark, sf):
    """Month effect, two slope contributions and the rest; they add up to the log level."""
    from pyspark.sql import Window

    p = panel(spark, sf)
    b = P.elasticities(p, "district_id", "month", "y", ["x1", "x2"])
    b = b.groupBy("district_id").agg(*[F.max(F.when(F.col("regressor") == r, F.col("beta"))).alias(f"b{r[1]}") for r in ("x1", "x2")])
    w, wm = Window.partitionBy("district_id"), Window.partitionBy("district_id", F.month("month"))
    d = p.join(b, "district_id").withColumn("ly", F.log("y"))
    d = d.withColumn("seasonal", F.avg("ly").over(wm) - F.avg("ly").over(w))
    d = d.withColumn("contrib_x1", F.col("b1") * F.col("x1")).withColumn("contrib_x2", F.col("b2") * F.col("x2"))
    return d.withColumn("irregular", F.col("ly") - F.col("seasonal") - F.col("contrib_x1") - F.col("contrib_x2"))


@query(
    "uplift_attribution",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY month DESC) AS rn FROM parts12),
       k AS (SELECT *, (rn - 1) // 12 AS blk FROM r WHERE rn <= 24),
       d AS (SELECT district_id, count(*) AS n, """
    + ", ".join(
        f"avg({c}) FILTER (blk = 0) - avg({c}) FILTER (blk = 1) AS {n}"
        for c, n in (("ly", "total"), ("seasonal", "seasonal"), ("contrib_x1", "contrib_x1"), ("contrib_x2", "contrib_x2"), ("irregular", "irregular"))
    )
    + """ FROM k GROUP BY 1 HAVING count(*) = 24)
       SELECT district_id, component, round(v, 6) AS delta_log, round(v * 100, 4) AS pp_of_growth, round((exp(total) - 1) * 100, 4) AS total_growth_pct
       FROM d UNPIVOT (v FOR component IN (seasonal, contrib_x1, contrib_x2, irregular)) WHERE abs(v) >= 1e-6""",
    needs=("parts12",),
)
def uplift_attribution(spark, sf):
    u = P.uplift(simple_parts(spark, sf), "district_id", "month", "ly", ["seasonal", "contrib_x1", "contrib_x2", "irregular"])
    return u.select("district_id", "component", F.round("delta_log", 6).alias("delta_log"), F.round("pp_of_growth", 4).alias("pp_of_growth"), F.round("total_growth_pct", 4).alias("total_growth_pct"))


cte(
    "snaive",
    """SELECT a.district_id, avg(abs(a.y - b.y) / a.y) * 100 AS mape, count(*) AS n FROM panel a JOIN panel b ON b.district_id = a.district_id AND b.month = a.month - INTERVAL 12 MONTH
       JOIN (SELECT district_id, max(month) AS last FROM panel GROUP BY 1) l ON l.district_id = a.district_id WHERE a.month > l.last - INTERVAL 12 MONTH GROUP BY 1""",
    "panel",
)


@query("seasonal_naive_mape", "SELECT district_id, round(mape, 6) AS snaive_mape, n FROM snaive", needs=("snaive",))
def seasonal_naive_mape(spark, sf):
    s = P.seasonal_naive(panel(spark, sf), "district_id", "month", "y")
    return s.select("district_id", F.round("snaive_mape", 6).alias("snaive_mape"), "n")


cte(
    "resid",
    "SELECT district_id, month, ln(y) AS ly, ln(y) - avg(ln(y)) OVER (PARTITION BY district_id, month(month)) AS e FROM panel",
    "panel",
)


@query(
    "residual_moments",
    """, m AS (SELECT district_id, count(*) AS n, avg(pow(e - mu, 2)) AS m2, avg(pow(e - mu, 3)) AS m3, avg(pow(e - mu, 4)) AS m4, var_pop(ly) AS v
          FROM (SELECT *, avg(e) OVER (PARTITION BY district_id) AS mu FROM resid) GROUP BY 1),
       k AS (SELECT *, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM m)
       SELECT district_id, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(n / 6e0 * (skew * skew + kurt * kurt / 4), 6) AS jarque_bera,
         round(exp(-n / 6e0 * (skew * skew + kurt * kurt / 4) / 2), 6) AS p_value, round(1 - m2 / v, 6) AS r2_like FROM k""",
    needs=("resid",),
)
def residual_moments(spark, sf):
    d = P.month_residual(panel(spark, sf), "district_id", "month", "y", "e").withColumn("ly", F.log("y"))
    m = P.moments(d, "district_id", "e", "ly")
    return m.select("district_id", "n", *[F.round(c, 6).alias(c) for c in ("skew", "kurt", "jarque_bera", "p_value", "r2_like")])


_LAGS = range(1, 13)


@query(
    "autocorr_lags",
    ", d AS (SELECT district_id, month, e - avg(e) OVER (PARTITION BY district_id) AS e FROM resid),"
    + " c AS (SELECT a.district_id, date_diff('month', b.month, a.month) AS k, sum(a.e * b.e) AS s FROM d a JOIN d b ON b.district_id = a.district_id AND b.month <= a.month GROUP BY 1, 2),"
    + " g AS (SELECT district_id, (SELECT count(*) FROM d WHERE d.district_id = c.district_id) AS n, "
    + ", ".join(f"sum(s) FILTER (k = {k}) / sum(s) FILTER (k = 0) AS r{k}" for k in _LAGS)
    + " FROM c GROUP BY 1) SELECT district_id, n, "
    + ", ".join(f"round(r{k}, 6) AS rho_{k}" for k in _LAGS)
    + ", round(n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in _LAGS) + "), 5) AS ljung_box FROM g",
    needs=("resid",),
)
def autocorr_lags(spark, sf):
    a = P.autocorrelations(P.month_residual(panel(spark, sf), "district_id", "month", "y", "e"), "district_id", "month", "e")
    return a.select("district_id", "n", *[F.round(f"rho_{k}", 6).alias(f"rho_{k}") for k in _LAGS], F.round("ljung_box", 5).alias("ljung_box"))


def fits(spark, sf):
    return stage(
        spark, "fits", roles.paths(sf, "orders", "lineitem", "customer", "nation"),
        lambda: P.fit_groups(panel(spark, sf), "district_id", "month", "y", REGRESSORS),
    )


@query("panel_decomposition")
def panel_decomposition(spark, sf):
    return P.decomposition(fits(spark, sf), REGRESSORS)


@query("panel_betas")
def panel_betas(spark, sf):
    return P.fitted_betas(fits(spark, sf), C.REGRESSOR_SIGN)


@query("panel_backtest")
def panel_backtest(spark, sf):
    return P.diagnostics(fits(spark, sf))


@query("regressor_vif")
def regressor_vif(spark, sf):
    return P.variance_inflation(panel(spark, sf), REGRESSORS)


@query(
    "model_quality",
    """SELECT (SELECT count(*) FROM snaive) AS groups, round((SELECT quantile_cont(mape, 0.5) FROM snaive), 5) AS median_snaive_mape,
         (SELECT count(*) FROM weight WHERE origin = 'ucm') AS empirical_weights, (SELECT count(*) FROM weight WHERE origin = 'prior') AS prior_weights,
         round((SELECT avg(CASE WHEN significant THEN 1e0 ELSE 0e0 END) FROM betas), 6) AS sig_share, (SELECT count(*) FROM betas WHERE usable) AS usable_slopes""",
    needs=("snaive", "weight", "betas"),
)
def model_quality(spark, sf):
    s = P.seasonal_naive(panel(spark, sf), "district_id", "month", "y")
    med = quantiles(s, "snaive_mape", [], {"m": 0.5}).scalar()
    w = SC.weights(spark, sf).agg(
        F.sum(F.when(F.col("origin") == "ucm", 1).otherwise(0)).alias("u"), F.sum(F.when(F.col("origin") == "prior", 1).otherwise(0)).alias("p")
    ).select(F.struct("u", "p").alias("s")).scalar()
    b = SC.betas(spark, sf).agg(
        F.avg(F.when(F.col("significant"), 1.0).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("usable"), 1).otherwise(0)).alias("u")
    ).select(F.struct("s", "u").alias("s")).scalar()
    return s.agg(F.count(F.lit(1)).alias("groups")).select(
        "groups", F.round(med, 5).alias("median_snaive_mape"), w["u"].alias("empirical_weights"), w["p"].alias("prior_weights"),
        F.round(b["s"], 6).alias("sig_share"), b["u"].alias("usable_slopes"),
    )


@query("model_quality_fits")
def model_quality_fits(spark, sf):
    """Fitted groups, how many beat the naive forecast, median errors and explained share."""
    d = P.diagnostics(fits(spark, sf)).where("ok")
    return d.agg(
        F.count(F.lit(1)).alias("groups_fitted"), F.sum(F.col("beats_snaive").cast("int")).alias("beat_naive"),
        F.round(F.median("backtest_mape"), 1).alias("median_backtest_mape"), F.round(F.median("snaive_mape"), 1).alias("median_snaive_mape"),
        F.round(F.median("r2_like"), 3).alias("median_r2"), F.sum(F.col("resid_autocorr_ok").cast("int")).alias("resid_autocorr_ok"),
    )
