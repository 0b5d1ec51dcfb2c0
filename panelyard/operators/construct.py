"""Portfolio construction: shrunk covariance (joins), and the constructors that need linear algebra (one group a task)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

EVERY, LOOKBACK = 21, 252
# Fixed values, which decide the numbers: ridge, step, floor, tolerances and rounds of the constructors below.
RIDGE, STEP, LEAST_SHARE, SETTLED = 1e-8, 0.1, 1e-6, 1e-6
CLIP_ROUNDS, CLIP_SETTLED, SECTOR_ROUNDS, SECTOR_SLACK = 15, 1e-10, 10, 1e-9


def shrunk_covariance(returns: DataFrame, shrinkage: float = 0.5, lookback: int = LOOKBACK) -> DataFrame:
    """(a, b, cov) over the trailing rows of (t_idx, ticker, ret): pairwise sample covariances, off-diagonals shrunk."""
    last = returns.agg(F.max("t_idx").alias("last"))
    recent = returns.join(F.broadcast(last)).where(F.col("t_idx") > F.col("last") - lookback).where("ret is not null").select("t_idx", "ticker", "ret")
    left, right = recent.withColumnsRenamed({"ticker": "a", "ret": "x"}), recent.withColumnsRenamed({"ticker": "b", "ret": "y"})
    cov = left.join(right, "t_idx").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    return cov.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(F.col("c") * (1 - shrinkage)).alias("cov"))


def _trailing(df: DataFrame, lookback: int) -> DataFrame:
    """Rows (rebalance, t_idx, ticker, ret, signal): every rebalance date with its trailing window.  A row names the dates it
    counts for, and they are joined by number."""
    dates = df.select("t_idx").distinct().where(F.col("t_idx") % EVERY == 0).select(F.col("t_idx").alias("rebalance"))
    t = F.col("t_idx")
    first = F.ceil(t / EVERY) * EVERY
    ahead = F.when(first < t + lookback, F.sequence(first, t + lookback - 1, F.lit(EVERY).cast("long")))
    return df.select("t_idx", "ticker", "ret", "signal", F.explode(ahead).alias("rebalance")).join(F.broadcast(dates), "rebalance")


def _held(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Weights from the last rebalance that succeeded; 0 before the first and for names it left out."""
    marks = chosen.select(F.col("rebalance").alias("t_idx")).distinct().withColumn("_at", F.col("t_idx"))
    dates = df.select("t_idx").distinct().join(F.broadcast(marks), "t_idx", "left")
    dates = dates.withColumn("_at", F.last("_at", ignorenulls=True).over(Window.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)))  # a calendar
    out = df.join(F.broadcast(dates), "t_idx").join(chosen.withColumnRenamed("rebalance", "_at"), ["_at", "ticker"], "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_at")


def mean_variance(df: DataFrame, target_te: float = 0.1, shrinkage: float = 0.5, lookback: int = LOOKBACK, long_only: bool = False) -> DataFrame:
    """Every 21st date: pinv(cov + 1e-8 I) mu over names with a signal (5 at least), scaled to a yearly tracking error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rebalance": pd.Series(dtype="int64"), "ticker": pd.Series(dtype=str), "weight": pd.Series(dtype=float)})
        day = int(pdf["rebalance"].iloc[0])
        mu = pdf[pdf["t_idx"] == day].set_index("ticker")["signal"].dropna().sort_index()
        if len(mu) < 5:
            return none
        r = pdf.pivot(index="t_idx", columns="ticker", values="ret").reindex(columns=mu.index).dropna(how="all")
        cov = r.cov().fillna(0.0).to_numpy()
        diagonal = np.diag(np.diag(cov))
        cov = shrinkage * diagonal + (1 - shrinkage) * cov
        w = np.linalg.pinv(cov + RIDGE * np.eye(len(mu))) @ mu.to_numpy()
        w = np.clip(w, 0, None) if long_only else w
        te = float(np.sqrt(max(w @ cov @ w, 1e-12) * 252))
        return pd.DataFrame({"rebalance": day, "ticker": mu.index, "weight": w * target_te / te})

    chosen = _trailing(df, lookback).groupBy("rebalance").applyInPandas(run, "rebalance long, ticker string, weight double")
    return _held(df, chosen)


def risk_parity(df: DataFrame, lookback: int = LOOKBACK, steps: int = 200) -> DataFrame:
    """Every 21st date: equal risk contributions over names without gaps in the window (5 names and 30 rows at least)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rebalance": pd.Series(dtype="int64"), "ticker": pd.Series(dtype=str), "weight": pd.Series(dtype=float)})
        r = pdf.pivot(index="t_idx", columns="ticker", values="ret").dropna(axis=1, how="any")
        if r.shape[0] < 30 or r.shape[1] < 5:
            return none
        cov = r.cov().to_numpy()
        w = np.full(r.shape[1], 1 / r.shape[1])
        for _ in range(steps):
            marginal = cov @ w
            share = w * marginal
            new = np.clip(w - STEP * (share - share.mean()) / (marginal + 1e-12), LEAST_SHARE, None)
            w, moved = new / new.sum(), np.abs(new / new.sum() - w).max()
            if moved < SETTLED:
                break
        return pd.DataFrame({"rebalance": int(pdf["rebalance"].iloc[0]), "ticker": r.columns, "weight": w})

    chosen = _trailing(df, lookback).groupBy("rebalance").applyInPandas(run, "rebalance long, ticker string, weight double")
    return _held(df, chosen)


def capped_weights(signal: np.ndarray, sectors: np.ndarray, name_cap: float, sector_cap: float, gross: float, long_only: bool) -> np.ndarray:
    """Signal weights under a name cap and a sector cap; NaN signals get 0."""
    have = np.isfinite(signal)
    w = np.zeros(len(signal))
    if have.sum() < 2:
        return w
    s = signal[have]
    center = (lambda v: v) if long_only else (lambda v: v - v.mean())
    s = s - s.min() if long_only else s - s.mean()
    if np.abs(s).sum() == 0:
        return w
    s = s * gross / np.abs(s).sum()
    low = 0.0 if long_only else -name_cap
    for _ in range(CLIP_ROUNDS):
        clipped = center(np.clip(s, low, name_cap))
        s, done = clipped, np.allclose(s, clipped, atol=CLIP_SETTLED)
        if done:
            break
    s = np.clip(center(np.clip(s, low, name_cap)), low, name_cap)
    if np.abs(s).sum() > gross:
        s = s * gross / np.abs(s).sum()
    kinds = sectors[have]
    for _ in range(SECTOR_ROUNDS):
        over = False
        for k in np.unique(kinds):
            total = np.abs(s[kinds == k]).sum()
            if total > sector_cap + SECTOR_SLACK:
                s[kinds == k] *= sector_cap / total
                over = True
        if not over:
            break
        s = center(s)
    w[have] = s
    return w


def constrained(df: DataFrame, name_cap: float = 0.05, sector_cap: float = 0.30, gross: float = 2.0, long_only: bool = False) -> DataFrame:
    """Dates are independent: one group each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker_ord")
        cap = math.inf if pdf["sector"].isna().all() else sector_cap  # without sectors there is nothing to cap
        w = capped_weights(pdf["signal"].to_numpy(dtype=float), pdf["sector"].fillna("UNKNOWN").to_numpy(), name_cap, cap, gross, long_only)
        return pd.DataFrame({"date": pdf["date"], "ticker": pdf["ticker"], "weight": w})

    got = df.select("date", "ticker", "ticker_ord", "sector", "signal").groupBy("date").applyInPandas(run, "date date, ticker string, weight double")
    return df.join(got, ["date", "ticker"])


def from_policy(df: DataFrame, method: str, thresholds: dict[str, float]) -> DataFrame:
    """Dispatch with the policy's caps (0.05 a name, 0.30 a sector, 2.0 gross where it has none)."""
    if method == "mean_variance":
        return mean_variance(df)
    if method == "risk_parity":
        return risk_parity(df)
    if method == "signal_weighted":
        return constrained(df, thresholds.get("max_single_name_weight", 0.05), thresholds.get("max_sector_weight", 0.30), thresholds.get("gross_exposure", 2.0))
    raise ValueError(f"unknown construction {method!r}")
