"""Time-axis features as Column expressions over one window per ticker, and their registry.

All lags are row positions on the union calendar.  pct_change() carries the last price forward over gaps first (fill
"pad"), plain shifts do not.  Rolling statistics need a full window of values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_time():
    return Window.partitionBy("ticker").orderBy("t_idx")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def padded(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def pct_change(x: Column, k: int = 1, fill: str = "pad") -> Column:
    x = padded(x) if fill == "pad" else x
    return ratio(x, F.lag(x, k).over(by_time())) - 1


def rolling(aggregate: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """Over the last n rows, if at least `least` (all of them) have a value."""
    frame = by_time().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (least or n), aggregate(x).over(frame))


@dataclass(frozen=True)
class Lags:
    """The lookbacks of the built-in features, in rows."""

    skip: int = 21
    year: int = 252
    week: int = 5
    month: int = 21
    mean: int = 20


def momentum(p: Lags) -> Column:
    px = F.col("adj_close")
    return ratio(F.lag(px, p.skip).over(by_time()), F.lag(px, p.year).over(by_time())) - 1


def reversal(p: Lags) -> Column:
    return -pct_change(F.col("adj_close"), p.week)


def volatility(p: Lags) -> Column:
    return rolling(F.stddev_samp, F.col("_ret"), p.month)


def volume_shock(p: Lags) -> Column:
    v = F.nullif(F.col("volume"), F.lit(0.0))
    return F.ln(ratio(v, rolling(F.avg, v, p.mean)))


def dollar_volume(p: Lags) -> Column:
    return rolling(F.avg, F.col("close") * F.col("volume"), p.mean)


def illiquidity(p: Lags) -> Column:
    return rolling(F.avg, ratio(F.abs(F.col("_ret")), F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))), p.mean)


def day_range(p: Lags) -> Column:
    return -rolling(F.avg, ratio(F.col("high") - F.col("low"), F.col("close")), 10)


def below_high(p: Lags) -> Column:
    return ratio(F.col("adj_close"), rolling(F.max, F.col("adj_close"), p.year)) - 1


def overnight_drift(p: Lags) -> Column:
    """Mean return from one close to the next open."""
    return rolling(F.avg, ratio(F.col("open"), F.lag("close").over(by_time())) - 1, p.mean)


def signed_volume(p: Lags) -> Column:
    """Volume with the sign of its row's return."""
    return rolling(F.sum, F.signum("_ret") * F.col("volume"), p.mean)


def low_volatility(p: Lags) -> Column:
    return -rolling(F.stddev_samp, F.col("_ret"), p.year)


def idiosyncratic_volatility(p: Lags) -> Column:
    """Minus the deviation that is left beside the market (the mean return of the date): var (1 - corr^2) of 60 rows, 40
    with a return at least; a constant market explains nothing."""
    x, m = F.col("_ret"), F.when(F.col("_ret").isNotNull(), F.col("_market"))
    frame = by_time().rowsBetween(-59, 0)
    moved = (F.stddev_pop(x).over(frame) > 0) & (F.stddev_pop(m).over(frame) > 0)
    explained = F.when(moved, F.pow(F.corr(x, m).over(frame), F.lit(2.0))).otherwise(0.0)
    left = rolling(F.var_samp, x, 60, 40) * (1 - explained)
    return -F.sqrt(F.when(left > 0, left).otherwise(left * 0))


FEATURES: dict[str, Callable[[Lags], Column]] = {
    "mom_12_1": momentum,
    "reversal_5d": reversal,
    "vol_21d": volatility,
    "volume_shock": volume_shock,
    "dollar_vol_20d": dollar_volume,
    "amihud_20d": illiquidity,
    "range_feature": day_range,
    "pct_off_52w_high": below_high,
    "overnight_drift_20d": overnight_drift,
    "signed_vol_20d": signed_volume,
    "low_vol_252d": low_volatility,
    "idio_vol_60d": idiosyncratic_volatility,
}
MARKET = {"idio_vol_60d"}  # need the date's mean return, which is one more exchange


def compute(panel: DataFrame, names: list[str], lags: Lags = Lags(), registry=None) -> DataFrame:
    """panel plus one column per feature and `fwd` (the next row's return): one exchange by ticker for all of them."""
    registry = registry or FEATURES
    if unknown := [n for n in names if n not in registry]:
        raise KeyError(f"unknown features {unknown}; known: {sorted(registry)}")
    out = panel.withColumn("_ret", pct_change(F.col("adj_close")))
    if MARKET & set(names):
        out = out.withColumn("_market", F.avg("_ret").over(Window.partitionBy("date")))
    out = out.withColumns({n: registry[n](lags) for n in dict.fromkeys(names)})
    return out.withColumn("fwd", F.lead("_ret").over(by_time())).drop("_ret", "_market")
