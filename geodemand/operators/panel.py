"""Time-series operators on a group x month panel.

The panel is an aggregate: a group has as many rows as there are months, however many facts lie
behind it. Windows and the grouped fit below therefore work on short bounded groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.functions.stats import Z90, chi2_upper, normal_cdf

# Shortest series that is fitted, hold-out length, season length, cycle length.
MIN_OBSERVATIONS = 60
HORIZON = 12
SEASON = 12
CYCLE_MONTHS = 46


def log_departure(panel: DataFrame, group: str, y: str, out: str) -> DataFrame:
    ly = F.log(F.col(y))
    return panel.withColumn(out, ly - F.avg(ly).over(Window.partitionBy(group)))


def latest_periods_mean(panel: DataFrame, group: str, month: str, metrics: list[str], n: int = 12) -> DataFrame:
    """Mean of each metric over the n latest distinct months of the whole panel."""
    first = panel.select(month).distinct().orderBy(F.desc(month)).limit(n).agg(F.min(month).alias("m")).scalar()
    return panel.where(F.col(month) >= first).groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics])


def _recent(panel: DataFrame, group: str, month: str, n: int) -> DataFrame:
    """Rows of the latest 2n months per group with the block they are in (0 latest, 1 the one before)."""
    w = Window.partitionBy(group).orderBy(F.desc(month))
    r = panel.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * n)
    return r.withColumn("_block", F.floor((F.col("_r") - 1) / n))


def uplift(panel: DataFrame, group: str, month: str, log_total: str, components: list[str], n: int = 12) -> DataFrame:
    """Change of each component's mean, latest n months against the n before, in log points.

    Groups with fewer than 2n months and components that do not move drop out.
    """
    r = _recent(panel, group, month, n)

    def diff(c):
        return F.avg(F.when(F.col("_block") == 0, F.col(c))) - F.avg(F.when(F.col("_block") == 1, F.col(c)))

    g = r.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), diff(log_total).alias("_total"), *[diff(c).alias(c) for c in components]
    ).where(F.col("_n") == 2 * n)
    long = g.unpivot([group, "_total"], components, "component", "delta_log")
    return long.where(F.abs("delta_log") >= 1e-6).select(
        group,
        "component",
        "delta_log",
        (F.col("delta_log") * 100).alias("pp_of_growth"),
        ((F.exp("_total") - 1) * 100).alias("total_growth_pct"),
    )


def every_month(panel: DataFrame, group: str, month: str) -> DataFrame:
    """The panel with a row for every month from a group's first to its last; months it lacks hold nulls.

    On it a lag of rows is a lag of months.
    """
    ends = panel.groupBy(group).agg(F.min(F.trunc(month, "month")).alias("_a"), F.max(F.trunc(month, "month")).alias("_b"))
    calendar = ends.select(F.col(group).alias("_g"), F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("_m"))
    here = calendar["_g"].eqNullSafe(panel[group]) & (calendar["_m"] == F.trunc(panel[month], "month"))
    return calendar.join(panel, here, "left").select(
        F.col("_g").alias(group), F.col("_m").cast("date").alias(month), *[c for c in panel.columns if c not in (group, month)]
    )


def seasonal_naive(panel: DataFrame, group: str, month: str, y: str, horizon: int = HORIZON) -> DataFrame:
    """Error of repeating the same month of the year before over the last calendar months of each group.

    Months that the panel lacks, or whose forerunner it lacks, are left out.
    """
    by = Window.partitionBy(group)
    p = every_month(panel, group, month).select(
        group, y, F.lag(y, SEASON).over(by.orderBy(month)).alias("_f"), F.months_between(F.max(month).over(by), month).alias("_back")
    ).where((F.col("_back") < horizon) & F.col("_f").isNotNull() & F.col(y).isNotNull())
    return p.groupBy(group).agg(
        (F.avg(F.abs(F.col(y) - F.col("_f")) / F.col(y)) * 100).alias("snaive_mape"), F.count(F.lit(1)).alias("n")
    )


def month_residual(panel: DataFrame, group: str, month: str, y: str, out: str) -> DataFrame:
    """log y less its group's mean for the same month of the year."""
    w = Window.partitionBy(group, F.month(month))
    return panel.withColumn(out, F.log(y) - F.avg(F.log(y)).over(w))


def autocorrelations(df: DataFrame, group: str, month: str, resid: str, lags: int = 12) -> DataFrame:
    """Residual autocorrelation at each lag of months, and the portmanteau statistic over all of them.

    A pair of months counts where the panel has both.
    """
    by = Window.partitionBy(group)
    w = by.orderBy(month)
    d = every_month(df.select(group, month, resid), group, month).withColumn("_e", F.col(resid) - F.avg(resid).over(by))
    d = d.select(group, "_e", *[(F.col("_e") * F.lag("_e", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)])
    g = d.groupBy(group).agg(
        F.count("_e").alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_v"),
        *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, lags + 1)],
    )
    n = F.col("n")
    rho = [F.col(f"_p{k}") / F.col("_v") for k in range(1, lags + 1)]
    q = n * (n + 2) * sum([r * r / (n - k) for k, r in enumerate(rho, 1)], F.lit(0.0))
    h, term, total = q / 2, F.lit(1.0), F.lit(0.0)
    for i in range(lags // 2):
        total = total + term
        term = term * h / (i + 1)
    return g.select(
        group, "n", *[r.alias(f"rho_{k}") for k, r in enumerate(rho, 1)], q.alias("ljung_box"),
        (F.exp(-h) * total).alias("p_value"),
    )


def moments(df: DataFrame, group: str, resid: str, level: str) -> DataFrame:
    """Skewness, kurtosis, normality statistic and explained share of the log level."""
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.skewness(resid).alias("skew"),
        F.kurtosis(resid).alias("kurt"),
        (1 - F.var_pop(resid) / F.var_pop(level)).alias("r2_like"),
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return g.select(group, "n", "skew", "kurt", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"), "r2_like")


def elasticities(panel: DataFrame, group: str, month: str, y: str, regressors: list[str]) -> DataFrame:
    """Slope of log y on each regressor with month-of-year means removed from both sides.

    Partialling the month effects out first gives the coefficient of the joint regression.
    """
    w = Window.partitionBy(group, F.month(month))
    p = panel.select(
        group,
        (F.log(y) - F.avg(F.log(y)).over(w)).alias("_y"),
        *[(F.col(x) - F.avg(x).over(w)).alias(x) for x in regressors],
    )
    long = p.unpivot([group, "_y"], regressors, "regressor", "_x")
    g = long.groupBy(group, "regressor").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_x") * F.col("_y")).alias("_xy"),
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"),
        F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
    )
    rss = F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")
    return g.select(
        group,
        "regressor",
        "n",
        (F.col("_xy") / F.col("_xx")).alias("beta"),
        F.sqrt(rss / (F.col("n") - SEASON - 1) / F.col("_xx")).alias("se"),
    )


def audit(betas: DataFrame, expected: dict[str, str], extra: Column | None = None) -> DataFrame:
    """t value, 90 % interval, significance, agreement with the expected sign, usability."""
    names = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    b = betas.withColumn("expected_sign", names[F.col("regressor")])
    b = b.withColumn("tstat", F.when(F.col("se") > 0, F.col("beta") / F.col("se")))
    b = b.withColumn("ci_low", F.col("beta") - Z90 * F.col("se")).withColumn("ci_high", F.col("beta") + Z90 * F.col("se"))
    b = b.withColumn("significant", F.coalesce(F.abs("tstat") > Z90, F.lit(False)))
    b = b.withColumn("sign_ok", (F.col("beta") > 0) == (F.col("expected_sign") == "positive"))
    ok = F.col("significant") & F.col("sign_ok")
    return b.withColumn("usable", ok & extra if extra is not None else ok)


def pooled(betas: DataFrame) -> DataFrame:
    """Mean elasticity per regressor with the shares that are significant, rightly signed, usable."""
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return betas.groupBy("regressor", "expected_sign").agg(
        F.avg("beta").alias("beta"),
        F.avg("ci_low").alias("ci_low"),
        F.avg("ci_high").alias("ci_high"),
        share("significant").alias("sig_share"),
        share("sign_ok").alias("sign_ok_share"),
        share("usable").alias("usable_share"),
        F.count(F.lit(1)).alias("n_groups"),
    ).orderBy(F.desc(F.abs("beta")), "regressor")


def shrink(betas: DataFrame, prior_weight: float = 6.0) -> DataFrame:
    """Pull noisy group slopes toward the mean of all usable groups of the same regressor."""
    u = betas.where("usable")
    pool = u.groupBy("regressor").agg(
        F.avg("beta").alias("pool_mean"), F.coalesce(F.var_samp("beta"), F.lit(0.0)).alias("pool_var")
    )
    w = F.col("pool_var") / (F.col("pool_var") + prior_weight * F.col("se") * F.col("se") + 1e-12)
    return u.join(pool, "regressor").withColumn("shrink_weight", w).withColumn(
        "beta_shrunk", w * F.col("beta") + (1 - w) * F.col("pool_mean")
    )


def variance_inflation(df: DataFrame, regressors: list[str], threshold: float = 8.0) -> DataFrame:
    """Variance inflation of each regressor: diagonal of the inverse correlation matrix.

    Only the k x k correlations reach the driver.
    """
    pairs = [(a, b) for i, a in enumerate(regressors) for b in regressors[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    k = len(regressors)
    m = np.eye(k)
    for a, b in pairs:
        i, j = regressors.index(a), regressors.index(b)
        m[i, j] = m[j, i] = row[f"{a}|{b}"]
    vif = np.diag(np.linalg.inv(m))
    return df.sparkSession.createDataFrame(
        [(r, float(v), bool(v > threshold)) for r, v in zip(regressors, vif)],
        "regressor string, vif double, above_threshold boolean",
    )


# ---------------------------------------------------------------- grouped fit


def _design(t: np.ndarray, moy: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Level, slope, eleven sum-to-zero month contrasts, one cycle, regressors."""
    months = np.zeros((len(t), SEASON - 1))
    for m in range(1, SEASON):
        months[moy == m, m - 1] = 1.0
    months[moy == SEASON, :] = -1.0
    w = 2 * np.pi * t / CYCLE_MONTHS
    return np.column_stack([np.ones(len(t)), t, months, np.sin(w), np.cos(w), x])


def _solve(a: np.ndarray, y: np.ndarray):
    coef, _, rank, _ = np.linalg.lstsq(a, y, rcond=None)
    resid = y - a @ coef
    dof = max(len(y) - rank, 1)
    cov = np.linalg.pinv(a.T @ a) * (resid @ resid / dof)
    return coef, np.sqrt(np.maximum(np.diag(cov), 0.0)), resid


def _mape(actual: np.ndarray, forecast: np.ndarray) -> float:
    return float(np.mean(np.abs(actual - forecast) / actual) * 100)


FIT_SCHEMA = (
    "group_id string, ok boolean, reason string, n_obs int, aic double, bic double, r2_like double,"
    "ljung_box_p double, jarque_bera_p double, backtest_mape double, snaive_mape double, beats_snaive boolean,"
    "betas array<struct<regressor:string,beta:double,se:double,tstat:double,pvalue:double>>,"
    "months array<struct<month:date,observed_log:double,trend:double,seasonal:double,cycle:double,"
    "regression:double,irregular:double,fitted_log:double,contrib:array<double>>>"
)


def _fit(pdf: pd.DataFrame, regressors: list[str], min_obs: int, horizon: int) -> dict:
    pdf = pdf.sort_values("month")
    n = len(pdf)
    out = dict.fromkeys([c.split()[0] for c in ("aic", "bic", "r2_like", "ljung_box_p", "jarque_bera_p", "backtest_mape", "snaive_mape")])
    out.update(group_id=str(pdf["group_id"].iloc[0]), ok=False, reason="", n_obs=n, beats_snaive=False, betas=[], months=[])
    if n < min_obs:
        out["reason"] = f"only {n} obs"
        return out
    month = pd.to_datetime(pdf["month"])
    ly = np.log(np.maximum(pdf["y"].to_numpy(float), 1e-6))
    x = pdf[regressors].to_numpy(float)
    sd = x.std(0)
    sd[sd < 1e-12] = 1.0
    x = (x - x.mean(0)) / sd
    t = (month.dt.year * 12 + month.dt.month).to_numpy(float)
    t -= t[0]
    moy = month.dt.month.to_numpy()
    a = _design(t, moy, x)
    coef, se, resid = _solve(a, ly)
    k = len(regressors)
    beta, beta_se = coef[-k:], se[-k:]
    contrib = x * beta
    parts = {
        "trend": a[:, :2] @ coef[:2],
        "seasonal": a[:, 2 : 1 + SEASON] @ coef[2 : 1 + SEASON],
        "cycle": a[:, 1 + SEASON : 3 + SEASON] @ coef[1 + SEASON : 3 + SEASON],
        "regression": contrib.sum(1),
    }
    fitted = sum(parts.values())
    rss = float(resid @ resid)
    like = n * math.log(max(rss, 1e-300) / n)
    d = resid - resid.mean()
    v = float(d @ d)
    at = t.astype(int)  # months from the first; those the series lacks stay empty
    dense, levels = np.zeros(at[-1] + 1), np.full(at[-1] + 1, np.nan)
    dense[at], levels[at] = d, ly
    q = sum((float(dense[j:] @ dense[:-j]) / v) ** 2 / (n - j) for j in range(1, 13)) * n * (n + 2) if v > 0 else 0.0
    m2 = v / n
    if m2 > 0:
        skew, kurt = float((d**3).mean()) / m2**1.5, float((d**4).mean()) / m2**2 - 3
    else:
        skew = kurt = 0.0
    if n > horizon + 2 * SEASON:
        held = at > at[-1] - horizon
        c2, _, _ = _solve(a[~held], ly[~held])
        out["backtest_mape"] = _mape(np.exp(ly[held]), np.exp(a[held] @ c2))
        before = levels[at[held] - SEASON]
        known = ~np.isnan(before)
        if known.any():
            out["snaive_mape"] = _mape(np.exp(ly[held][known]), np.exp(before[known]))
            out["beats_snaive"] = bool(out["backtest_mape"] < out["snaive_mape"])
    tstat = np.divide(beta, beta_se, out=np.full(k, np.nan), where=beta_se > 0)
    out.update(
        ok=True,
        aic=like + 2 * a.shape[1],
        bic=like + math.log(n) * a.shape[1],
        r2_like=float(1 - np.var(resid) / np.var(ly)) if np.var(ly) > 0 else None,
        ljung_box_p=chi2_upper(q, 12),
        jarque_bera_p=chi2_upper(n / 6 * (skew**2 + kurt**2 / 4), 2),
        betas=[
            {
                "regressor": r,
                "beta": float(b),
                "se": float(s),
                "tstat": None if np.isnan(z) else float(z),
                "pvalue": None if np.isnan(z) else 2 * (1 - normal_cdf(abs(float(z)))),
            }
            for r, b, s, z in zip(regressors, beta, beta_se, tstat)
        ],
        months=[
            {
                "month": month.iloc[i].date(),
                "observed_log": float(ly[i]),
                **{name: float(v[i]) for name, v in parts.items()},
                "irregular": float(resid[i]),
                "fitted_log": float(fitted[i]),
                "contrib": [float(c) for c in contrib[i]],
            }
            for i in range(n)
        ],
    )
    return out


def fit_groups(
    panel: DataFrame, group: str, month: str, y: str, regressors: list[str], min_obs: int = MIN_OBSERVATIONS,
    horizon: int = HORIZON,
) -> DataFrame:
    """One row per group: decomposition, slopes and diagnostics of its own regression.

    A group is one series of months; groups are shuffled by key and fitted where they land.
    """
    p = panel.select(
        F.col(group).cast("string").alias("group_id"),
        F.col(month).alias("month"),
        F.col(y).cast("double").alias("y"),
        *[F.col(x).cast("double").alias(x) for x in regressors],
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_fit(pdf, regressors, min_obs, horizon)], columns=[c.split()[0] for c in _names])

    _names = ["group_id", "ok", "reason", "n_obs", "aic", "bic", "r2_like", "ljung_box_p", "jarque_bera_p",
              "backtest_mape", "snaive_mape", "beats_snaive", "betas", "months"]
    return p.groupBy("group_id").applyInPandas(run, FIT_SCHEMA)


def decomposition(fits: DataFrame, regressors: list[str]) -> DataFrame:
    d = fits.where("ok").select("group_id", F.explode("months").alias("m"))
    return d.select(
        "group_id",
        *[F.col(f"m.{c}").alias(c) for c in ("month", "observed_log", "trend", "seasonal", "cycle", "regression", "irregular", "fitted_log")],
        *[F.col("m.contrib")[i].alias(f"contrib_{r}") for i, r in enumerate(regressors)],
    )


def fitted_betas(fits: DataFrame, expected: dict[str, str]) -> DataFrame:
    b = fits.where("ok").select("group_id", "beats_snaive", F.explode("betas").alias("b"))
    b = b.select("group_id", "beats_snaive", "b.regressor", "b.beta", "b.se", "b.pvalue")
    return audit(b, expected, F.col("beats_snaive"))


def diagnostics(fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    return fits.select(
        "group_id", "ok", "reason", "n_obs", "aic", "bic", "r2_like", "ljung_box_p", "jarque_bera_p",
        "backtest_mape", "snaive_mape", "beats_snaive",
        F.coalesce(F.col("ljung_box_p") > alpha, F.lit(False)).alias("resid_autocorr_ok"),
        F.coalesce(F.col("jarque_bera_p") > alpha, F.lit(False)).alias("resid_normal_ok"),
    )
