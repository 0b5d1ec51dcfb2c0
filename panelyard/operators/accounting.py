"""Returns, turnover, costs, and performance metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

YEAR = 252


def with_prior(df: DataFrame) -> DataFrame:
    """Adds `prior`, the ticker's weight one row before (0 at the start)."""
    return df.withColumn("prior", F.coalesce(F.lag("weight").over(Window.partitionBy("ticker").orderBy("t_idx")), F.lit(0.0)))


def returns(df: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """(date, gross, turnover, cost, net) of weights against forward returns; a date without returns has gross 0."""
    daily = with_prior(df).groupBy("date").agg(F.coalesce(F.sum(F.col("weight") * F.col("fwd")), F.lit(0.0)).alias("gross"), (F.sum(F.abs(F.col("weight") - F.col("prior"))) / 2).alias("turnover"))
    return daily.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))


def flat_cost(df: DataFrame, bps: float) -> DataFrame:
    return with_prior(df).groupBy("date").agg((F.sum(F.abs(F.col("weight") - F.col("prior"))) / 2 * bps / 1e4).alias("cost"))


def sqrt_cost(df: DataFrame, half_spread: float = 1.0, impact: float = 10.0, capital: float = 1.0, volume: str | None = "dollar_vol_20d", floor: float = 1e6) -> DataFrame:
    """Half spread plus square-root impact on each trade; trades without a known volume are free."""
    if volume is None:
        raise ValueError("the square-root model needs a dollar volume")
    move = F.abs(F.col("weight") - F.col("prior"))
    adv = F.when(F.col(volume).isNotNull(), F.greatest(F.col(volume), F.lit(floor)))
    bps = F.when(move > 0, half_spread + impact * F.sqrt(move * capital / adv)).otherwise(F.when(adv.isNotNull(), 0.0))
    return with_prior(df).groupBy("date").agg(F.coalesce(F.sum(move * bps), F.lit(0.0)).alias("_c")).select("date", (F.col("_c") / 1e4).alias("cost"))


def composite_cost(parts: list[DataFrame], dates: DataFrame) -> DataFrame:
    """Sum by date of (date, cost) frames; a model without a date adds 0."""
    zero = dates.select("date").distinct().withColumn("cost", F.lit(0.0))
    for p in parts:
        zero = zero.unionByName(p.select("date", "cost"))
    return zero.groupBy("date").agg(F.sum("cost").alias("cost"))


def cost_model(kind: str, df: DataFrame, **kw) -> DataFrame:
    if kind == "flat":
        return flat_cost(df, kw.get("flat_bps", 5.0))
    if kind == "sqrt_impact":
        return sqrt_cost(df, kw.get("half_spread_bps", 1.0), kw.get("impact_coefficient", 10.0), kw.get("capital", 1.0))
    if kind == "composite":
        return composite_cost([cost_model("flat", df, **kw), cost_model("sqrt_impact", df, **kw)], df)
    raise ValueError(f"unknown cost model {kind!r}")


# -- metrics of one return per date
def sharpe(x):
    return F.try_divide(F.avg(x) * YEAR, F.stddev_pop(x) * math.sqrt(YEAR))


def skew(x):
    """Bias-corrected; needs three values."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def equity(daily: DataFrame, column: str = "net", missing_as_zero: bool = False) -> DataFrame:
    """(date, equity, drawdown), a series of dates: one row a date, so one task."""
    x = F.coalesce(F.col(column), F.lit(0.0)) if missing_as_zero else F.col(column)
    rows = daily.select("date", x.alias("r")).where("r is not null")
    path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.product(1 + F.col("r")).over(path))
    return rows.select("date", "equity", (F.col("equity") / F.max("equity").over(path) - 1).alias("drawdown"))


def summary(daily: DataFrame, column: str = "net", turnover: str | None = "turnover", gross: bool = False) -> DataFrame:
    """One row, in one pass over the series; gross: with the columns of gross_addons()."""
    x = F.col(column)
    path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a series of dates
    rows = daily.withColumn("_e", F.product(1 + x).over(path))
    rows = rows.withColumn("_d", F.col("_e") / F.max("_e").over(path) - 1)
    return rows.agg(
        (F.avg(x) * YEAR).alias("ann_return"), (F.stddev_pop(x) * math.sqrt(YEAR)).alias("ann_vol"), sharpe(x).alias("sharpe"), F.avg((x > 0).cast("double")).alias("hit_rate"),
        skew(x).alias("skew"), F.count(x).alias("n_obs"), *([F.avg(turnover).alias("avg_turnover")] if turnover else []), F.min("_d").alias("max_drawdown"), *(_gross() if gross else []),
    )


def _gross() -> list:
    g, n = F.avg("gross") * YEAR, F.avg("net") * YEAR
    return [sharpe(F.col("gross")).alias("gross_sharpe"), g.alias("gross_ann_return"), (g - n).alias("cost_drag")]


def gross_addons(daily: DataFrame) -> DataFrame:
    return daily.agg(*_gross())


def decile_spread(per_decile: DataFrame) -> DataFrame:
    return per_decile.groupBy("decile").agg((F.avg("ret") * YEAR).alias("ann_return"), sharpe(F.col("ret")).alias("sharpe"), F.count("ret").alias("n"))


def information_coefficient(df: DataFrame, column: str = "signal", fwd: str = "fwd", least: int = 10) -> DataFrame:
    """(date, ic): rank correlation over names with both values; NULL below `least` names or without variation."""
    both = F.col(column).isNotNull() & F.col(fwd).isNotNull()
    pairs = df.select("date", F.when(both, F.col(column)).alias("x"), F.when(both, F.col(fwd)).alias("y"))

    def rank(c):
        ties = F.count("*").over(Window.partitionBy("date", c))
        return F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("date", F.col(c).isNull()).orderBy(c)) + (ties - 1) / 2)

    ranks = pairs.withColumns({"rx": rank("x"), "ry": rank("y")})
    n, sx, sy = F.count("rx"), F.stddev_pop("rx"), F.stddev_pop("ry")
    return ranks.groupBy("date").agg(F.when((n >= least) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop("rx", "ry"), sx * sy)).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    return ic.agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic") * math.sqrt(YEAR), F.stddev_pop("ic")).alias("ic_ir"), F.count("ic").alias("ic_n"))
