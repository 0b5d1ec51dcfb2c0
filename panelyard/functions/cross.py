"""Cross-sectional transforms (one window per date), smoothing, and neutralisation in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_NAMES = 10


def by_date():
    return Window.partitionBy("date")


def winsorize(x: Column, pct: float = 0.01) -> Column:
    """Clip to the date's [pct, 1-pct] quantiles (linear); NULL stays NULL."""
    low, high = F.percentile(x, pct).over(by_date()), F.percentile(x, 1 - pct).over(by_date())
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def add_zscore(df: DataFrame, source: str, target: str, robust: bool = True) -> DataFrame:
    """Robust: (x - median) / (1.4826 MAD), else (x - mean) / std; a zero spread makes the date NULL."""
    x = F.col(source)
    if not robust:
        return df.withColumn(target, F.try_divide(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date())))
    df = df.withColumn("_off", x - F.median(x).over(by_date()))
    return df.withColumn(target, F.try_divide(F.col("_off"), 1.4826 * F.median(F.abs("_off")).over(by_date()))).drop("_off")


def combine(df: DataFrame, weights: dict[str, float], pct: float = 0.01, robust: bool = True, target: str = "signal") -> DataFrame:
    """Weighted sum of z-scores of the features present, over the sum of |weights|; NULL only where all are NULL."""
    names = [n for n in weights if n in df.columns]
    if not names:
        return df.withColumn(target, F.lit(None).cast("double"))
    df = df.withColumns({f"_w_{n}": winsorize(F.col(n), pct) for n in names})
    for n in names:
        df = add_zscore(df, f"_w_{n}", f"_z_{n}", robust)
    total = sum(abs(weights[n]) for n in names) or 1.0
    parts = [F.coalesce(F.col(f"_z_{n}") * F.lit(float(weights[n])), F.lit(0.0)) for n in names]
    some = F.coalesce(*[F.col(f"_z_{n}") for n in names]).isNotNull()
    value = parts[0]
    for p in parts[1:]:
        value = value + p
    return df.withColumn(target, F.when(some, value / F.lit(total))).drop(*[f"_w_{n}" for n in names], *[f"_z_{n}" for n in names])


def smooth(df: DataFrame, column: str, halflife: float | None) -> DataFrame:
    """EWMA per ticker over non-NULL values, started at the first one; NULLs carry the last value.  A frame of 80
    halflives is exact to double precision and keeps a task's buffer bounded."""
    if not halflife or halflife <= 0:
        return df
    a = 1 - math.exp(-math.log(2) / halflife)
    reach = max(100, math.ceil(80 * halflife))
    past = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", F.count(column).over(past))  # values so far: the frame below counts values, not rows
    recent = Window.partitionBy("ticker").orderBy("_n").rangeBetween(-reach, 0)
    df = df.withColumn("_l", F.collect_list(column).over(recent))
    value = F.aggregate(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), F.col("_l")[0], lambda y, x: y * (1 - a) + x * a)
    return df.withColumn(column, F.when(F.size("_l") > 0, value)).drop("_l", "_n")


def pct_rank(x: Column) -> Column:
    """Rank over the date with ties averaged, as a share of the non-NULL names."""
    ties = F.count(x).over(Window.partitionBy("date", x))
    rank = F.rank().over(Window.partitionBy("date", x.isNull()).orderBy(x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(by_date()))


def sector_neutral(x: Column, sector: Column) -> Column:
    return x - F.avg(x).over(Window.partitionBy("date", F.coalesce(sector, F.lit("UNKNOWN"))))


def neutralize(df: DataFrame, column: str, sector: str | None = None, size: str | None = None, target: str | None = None) -> DataFrame:
    """Residual of the date's regression on sector dummies and ln(size), by Frisch-Waugh-Lovell: demean both sides within
    sectors over usable rows, then one slope per date.  Fewer than MIN_NAMES usable names: NULL."""
    target = target or column
    if sector is None and size is None:
        return df.withColumn(target, F.col(column))
    log = F.ln(F.col(size)) if size else F.lit(0.0)
    usable = F.col(column).isNotNull() & log.isNotNull()
    group = [F.col("date"), F.coalesce(F.col(sector), F.lit("UNKNOWN")) if sector else F.lit(0)]
    df = df.withColumns({"_y": F.when(usable, F.col(column)), "_x": F.when(usable, log)})
    within = Window.partitionBy(*group)
    df = df.withColumns({"_yd": F.col("_y") - F.avg("_y").over(within), "_xd": F.col("_x") - F.avg("_x").over(within)})
    xx, scale = F.sum(F.col("_xd") * F.col("_xd")).over(by_date()), F.sum(F.col("_x") * F.col("_x")).over(by_date())
    slope = F.when(xx > 1e-12 * scale, F.sum(F.col("_xd") * F.col("_yd")).over(by_date()) / xx).otherwise(0.0)
    value = F.when(F.count("_y").over(by_date()) >= MIN_NAMES, F.col("_yd") - slope * F.col("_xd"))
    return df.withColumn(target, value).drop("_y", "_x", "_yd", "_xd")
