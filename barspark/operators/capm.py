"""Single- and multi-factor regressions of many return series at once.

Every model is fitted from moments: one grouping by ticker with map-side combine
yields a row per ticker, and only these rows are solved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import DAILY, Series
from ..functions.numeric import TRADING_DAYS, ratio
from ..functions.student import p_value, t_975

MIN_ROWS = 30

# The factors of each model.
MODELS = {
    "3-factor": ("mkt_rf", "smb", "hml"),
    "5-factor": ("mkt_rf", "smb", "hml", "rmw", "cma"),
}


def factor_table(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Percent to decimals, optionally an inclusive date range."""
    df = raw.withColumns({c: F.col(c) / 100.0 for c in raw.columns if c != "date"})
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def aligned(returns: DataFrame, market: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """(ticker, date, y, x): excess returns of the asset and the market on common dates."""
    df = returns.join(market, "date").filter(F.col("ret").isNotNull() & F.col("ret_m").isNotNull())
    return df.select("ticker", "date", (F.col("ret") - risk_free).alias("y"), (F.col("ret_m") - risk_free).alias("x"))


def _error(n: Column) -> Column:
    return F.when(n < MIN_ROWS, F.concat(F.lit("Insufficient data: "), n.cast("string"),
                                         F.lit(f" observations (need >= {MIN_ROWS})")))


def capm(pairs: DataFrame, inference: bool = True) -> DataFrame:
    """OLS of y on x per ticker.  Below 30 rows the figures are NULL and ``error`` says why.

    ``inference`` adds p-values and the 95 % interval of beta.
    """
    m = pairs.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_observations"), F.avg("y").alias("_my"), F.avg("x").alias("_mx"),
        F.covar_pop("y", "x").alias("_cxy"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"))
    n = F.col("n_observations")
    beta = ratio(F.col("_cxy"), F.col("_vx"))
    m = m.withColumn("beta", F.when(n >= MIN_ROWS, beta))
    m = m.withColumn("alpha_daily", F.col("_my") - F.col("beta") * F.col("_mx"))
    r2 = ratio(F.col("beta") * F.col("_cxy"), F.col("_vy"))
    m = m.withColumn("r_squared", r2)
    noise = ratio((F.lit(1.0) - F.col("r_squared")) * F.col("_vy") * n, n - 2)
    m = m.withColumn("_s2", noise)
    sxx = F.col("_vx") * n
    m = m.withColumns({
        "alpha": F.col("alpha_daily") * TRADING_DAYS,
        "adj_r_squared": F.lit(1.0) - (F.lit(1.0) - F.col("r_squared")) * ratio(n - 1, n - 2),
        "std_error_beta": F.sqrt(ratio(F.col("_s2"), sxx)),
        "std_error_alpha": F.sqrt(F.col("_s2") * (ratio(F.lit(1.0), n) + ratio(F.col("_mx") ** 2, sxx))),
        "error": _error(n),
    })
    m = m.withColumns({"t_stat_beta": ratio(F.col("beta"), F.col("std_error_beta")),
                       "t_stat_alpha": ratio(F.col("alpha_daily"), F.col("std_error_alpha"))})
    columns = ["ticker", "n_observations", "beta", "alpha", "alpha_daily", "r_squared", "adj_r_squared",
               "std_error_beta", "std_error_alpha", "t_stat_beta", "t_stat_alpha", "error"]
    out = m.select(*columns)
    if not inference:
        return out
    half = t_975(n - 2) * F.col("std_error_beta")
    return out.withColumns({
        "p_value_beta": p_value(F.col("t_stat_beta"), n - 2), "p_value_alpha": p_value(F.col("t_stat_alpha"), n - 2),
        "_half": half,
    }).withColumns({"beta_ci_lower": F.col("beta") - F.col("_half"), "beta_ci_upper": F.col("beta") + F.col("_half")})\
        .drop("_half")


def rolling(pairs: DataFrame, rows: int = 60, min_rows: int = 30, series: Series = DAILY) -> DataFrame:
    """Rolling beta and annualised alpha over the last ``rows`` common dates."""
    w = series.last(rows)
    enough = F.count(F.lit(1)).over(w) >= min_rows
    df = pairs.withColumn("rolling_beta", F.when(
        enough, ratio(F.covar_samp("y", "x").over(w), F.var_samp("x").over(w))))
    alpha = (F.avg("y").over(w) - F.col("rolling_beta") * F.avg("x").over(w)) * TRADING_DAYS
    return df.withColumn("rolling_alpha", alpha)


def capm_report(pairs: DataFrame, rows: int = 60, inference: bool = True) -> DataFrame:
    """``capm`` with the latest rolling values."""
    current = rolling(pairs, rows).groupBy("ticker").agg(
        F.max_by("rolling_beta", "date").alias("rolling_beta_current"),
        F.max_by("rolling_alpha", "date").alias("rolling_alpha_current"))
    return capm(pairs, inference).join(current, "ticker")


_FIT_SCHEMA = ("ticker string, model string, n_observations long, term string, coefficient double, std_error double, "
               "t_stat double, r_squared double, adj_r_squared double")


def _solver(model: str, names: tuple[str, ...]):
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            cov = np.zeros((len(b), k, k))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = b[f"c_{i}_{j}"].to_numpy(float)
            cy = np.stack([b[f"y_{i}"].to_numpy(float) for i in range(k)], axis=1)
            mean = np.stack([b[f"m_{i}"].to_numpy(float) for i in range(k)], axis=1)
            inverse = np.linalg.pinv(cov, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, cy)
            alpha = b["my"].to_numpy(float) - (beta * mean).sum(axis=1)
            vy = b["vy"].to_numpy(float)
            freedom = n - k - 1
            rss = np.maximum(vy - (beta * cy).sum(axis=1), 0) * n
            s2 = rss / freedom
            se_beta = np.sqrt(s2[:, None] / n[:, None] * np.einsum("nii->ni", inverse))
            spread = np.einsum("ni,nij,nj->n", mean, inverse, mean)
            se_alpha = np.sqrt(s2 / n * (1 + spread))
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = 1 - rss / (vy * n)
                adjusted = 1 - (1 - r2) * (n - 1) / freedom
                for i, term in enumerate(("alpha", *names)):
                    coefficient = alpha if i == 0 else beta[:, i - 1]
                    error = se_alpha if i == 0 else se_beta[:, i - 1]
                    t = coefficient / error
                    yield pd.DataFrame({
                        "ticker": b["ticker"], "model": model, "n_observations": b["n"], "term": term,
                        "coefficient": coefficient, "std_error": error, "t_stat": t,
                        "r_squared": r2, "adj_r_squared": adjusted})

    return solve


def factor_exposures(returns: DataFrame, factors: DataFrame, model: str = "3-factor") -> DataFrame:
    """OLS of excess returns on the model's factors: one row per ticker and term.

    Covariances are aggregated by Spark; the small systems are solved per Arrow batch
    of tickers.  Tickers with fewer than 30 complete rows are left out.
    """
    if model not in MODELS:
        raise ValueError(f"model {model}; one of {sorted(MODELS)}")
    names = MODELS[model]
    missing = [c for c in (*names, "rf") if c not in factors.columns]
    if missing:
        raise ValueError(f"missing factors: {missing}")
    df = returns.join(factors, "date").na.drop()
    df = df.select("ticker", (F.col("ret") - F.col("rf")).alias("y"), *names)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.var_pop("y").alias("vy")]
    for i, a in enumerate(names):
        aggs += [F.avg(a).alias(f"m_{i}"), F.covar_pop("y", a).alias(f"y_{i}")]
        aggs += [F.covar_pop(a, names[j]).alias(f"c_{i}_{j}") for j in range(i, len(names))]
    moments = df.groupBy("ticker").agg(*aggs).filter(F.col("n") >= MIN_ROWS)
    fits = moments.mapInPandas(_solver(model, names), _FIT_SCHEMA)
    # NaN (no freedom, singular systems) has no tail
    tail = p_value(F.col("t_stat"), F.col("n_observations") - (len(names) + 1))
    return fits.select(*fits.columns[:7], tail.alias("p_value"), *fits.columns[7:])


def factor_report(exposures: DataFrame) -> DataFrame:
    """One row per ticker and model, exposures side by side."""
    terms = MODELS["5-factor"]
    return exposures.groupBy("ticker", "model").agg(
        F.first("n_observations").alias("n_observations"), F.first("r_squared").alias("r_squared"),
        F.first("adj_r_squared").alias("adj_r_squared"),
        F.max(F.when(F.col("term") == "alpha", F.col("coefficient") * TRADING_DAYS)).alias("alpha"),
        F.max(F.when(F.col("term") == "alpha", F.col("t_stat"))).alias("alpha_t_stat"),
        *[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"beta_{t}") for t in terms])


def compare_models(pairs: DataFrame, returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Alpha, R² and market beta of the one-, three- and five-factor models per ticker."""
    one = (capm(pairs, inference=False).filter(F.col("error").isNull())
           .select("ticker", F.lit("CAPM").alias("model"), "alpha", "r_squared", "beta"))
    out = one
    for model in MODELS:
        r = factor_report(factor_exposures(returns, factors, model))
        out = out.unionByName(r.select("ticker", "model", "alpha", "r_squared", F.col("beta_mkt_rf").alias("beta")))
    return out
