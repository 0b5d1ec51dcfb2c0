"""Exposures, constraints and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cross import pct_rank
from .accounting import YEAR, equity

METRICS = ("gross_exposure", "net_exposure", "avg_turnover", "max_drawdown", "max_sector_weight", "max_single_name_weight", "min_n_long", "min_n_short")
OPS = ("<=", "<", ">=", ">")


def exposures(w: DataFrame) -> DataFrame:
    """Per date: gross, net, largest name, longs and shorts."""
    x = F.col("weight")
    return w.groupBy("date").agg(
        F.sum(F.abs(x)).alias("gross"), F.abs(F.sum(x)).alias("net"), F.max(F.abs(x)).alias("max_name"),
        F.sum((x > 0).cast("long")).alias("n_long"), F.sum((x < 0).cast("long")).alias("n_short"),
    )


def sector_exposure(w: DataFrame) -> DataFrame:
    return w.groupBy("date", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.sum(F.abs("weight")).alias("exposure"))


def average_turnover(w: DataFrame) -> DataFrame:
    """Mean half-L1 change; the first date counts as 0 (the accounting turnover counts it in full)."""
    move = F.abs(F.col("weight") - F.lag("weight").over(Window.partitionBy("ticker").orderBy("t_idx")))
    return w.withColumn("_m", move).groupBy("date").agg((F.coalesce(F.sum("_m"), F.lit(0.0)) / 2).alias("t")).agg(F.avg("t").alias("avg_turnover"))


def by_date(w: DataFrame, cost_bps: float | None = None) -> DataFrame:
    """Per date, in one pass over the weights: what exposures(), sector_exposure() and average_turnover() hold, and with
    cost_bps also the returns (gross, turnover, cost, net) of accounting.returns()."""
    x = F.col("weight")
    before = F.lag("weight").over(Window.partitionBy("ticker").orderBy("t_idx"))
    money = "fwd" in w.columns and cost_bps is not None
    w = w.withColumns({"_m": F.abs(x - before), "_t": F.abs(x - F.coalesce(before, F.lit(0.0)))})
    part = w.groupBy("date", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(
        F.sum(F.abs(x)).alias("exposure"), F.sum(x).alias("sum"), F.max(F.abs(x)).alias("max_name"), F.sum((x > 0).cast("long")).alias("n_long"), F.sum((x < 0).cast("long")).alias("n_short"),
        F.sum("_m").alias("moved"), *([F.sum(x * F.col("fwd")).alias("gross"), F.sum("_t").alias("traded")] if money else []),
    )
    day = part.groupBy("date").agg(
        F.sum("exposure").alias("gross_exposure"), F.abs(F.sum("sum")).alias("net_exposure"), F.max("max_name").alias("max_name"), F.max("exposure").alias("max_sector"), F.sum("n_long").alias("n_long"),
        F.sum("n_short").alias("n_short"), (F.coalesce(F.sum("moved"), F.lit(0.0)) / 2).alias("moved"), *([F.coalesce(F.sum("gross"), F.lit(0.0)).alias("gross"), (F.sum("traded") / 2).alias("turnover")] if money else []),
    )
    return day.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost")) if money else day


def all_metrics(w: DataFrame, daily: DataFrame | None = None, column: str = "net", cost_bps: float | None = None) -> DataFrame:
    """(metric, value): worst case over time for caps, least breadth, mean turnover, drawdown with gaps as 0.  The drawdown is
    that of `daily`, or with cost_bps of the weights' own net returns, which takes no second pass."""
    day = by_date(w, cost_bps)
    if cost_bps is not None and daily is None:
        path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a series of dates
        day = day.withColumn("_e", F.product(1 + F.coalesce(column, F.lit(0.0))).over(path))
        day = day.withColumn("_d", F.col("_e") / F.max("_e").over(path) - 1)
    one = day.agg(
        F.max("gross_exposure").alias("gross_exposure"), F.max("net_exposure").alias("net_exposure"), F.max("max_name").alias("max_single_name_weight"), F.min("n_long").cast("double").alias("min_n_long"),
        F.min("n_short").cast("double").alias("min_n_short"), F.max("max_sector").alias("max_sector_weight"), F.avg("moved").alias("avg_turnover"), *([F.min("_d").alias("max_drawdown")] if "_d" in day.columns else []),
    )
    if daily is not None:
        one = one.join(equity(daily, column, missing_as_zero=True).agg(F.min("drawdown").alias("max_drawdown")))
    return one.unpivot([], [c for c in one.columns], "metric", "value")


def report(metrics: DataFrame, hard: DataFrame, soft: DataFrame) -> dict:
    """Metrics, broken hard constraints, soft scores, and whether all hard ones hold; a few rows each."""
    metrics = metrics.persist()
    out = {
        "metrics": {r["metric"]: r["value"] for r in metrics.collect()},
        "hard_violations": [r.asDict() for r in violations(metrics, hard).collect()],
        "soft_scores": {r["name"]: r["score"] for r in soft_scores(metrics, soft).collect()},
    }
    metrics.unpersist()
    return {**out, "passes_policy": not out["hard_violations"]}


def constraints(spark, rows: list[tuple[str, str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, metric string, op string, threshold double")


def violations(metrics: DataFrame, hard: DataFrame) -> DataFrame:
    """Constraints that a measured metric breaks; unmeasured metrics are skipped."""
    holds = F.expr("CASE op WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold END")
    return metrics.where("value is not null").join(F.broadcast(hard), "metric").where(~holds).select("name", "metric", "op", "threshold", "value")


def soft_scores(metrics: DataFrame, soft: DataFrame) -> DataFrame:
    """soft: (name, metric, target, weight)."""
    return metrics.where("value is not null").join(F.broadcast(soft), "metric").select("name", (F.abs(F.col("value") - F.col("target")) * F.col("weight")).alias("score"))


def governance(one: DataFrame, sharpe_limit: float = 0.5, ic_ir_limit: float = 2.5) -> DataFrame:
    """Flags of a row with (sharpe, ic_ir, n_violations, gross_ann_return, ann_return); unknown counts as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return one.select(
        (z("sharpe") > sharpe_limit).alias("inflated_sharpe"), (z("ic_ir") > ic_ir_limit).alias("inflated_ic_ir"),
        (F.col("n_violations") > 0).alias("hard_violations"), ((z("gross_ann_return") > 0) & (z("ann_return") < 0)).alias("costs_eat_returns"),
    )


# -- diagnostics
def ic_by_year(ic: DataFrame) -> DataFrame:
    return ic.where("ic is not null").groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic") * math.sqrt(YEAR), F.stddev_pop("ic")).alias("ic_ir"), F.count("ic").alias("n"))


def year_end_equity(daily: DataFrame, column: str = "net") -> DataFrame:
    return equity(daily, column, missing_as_zero=True).groupBy(F.year("date").alias("year")).agg(F.max_by("equity", "date").alias("equity"))


def decile_report(per_decile: DataFrame) -> DataFrame:
    """Annualised mean and Sharpe with the sample deviation (the spread table uses the population one)."""
    return per_decile.groupBy("decile").agg((F.avg("ret") * YEAR).alias("ann_mean"), F.try_divide(F.avg("ret") * math.sqrt(YEAR), F.stddev_samp("ret")).alias("sharpe"))


def feature_correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, corr) over rows where all features are known, rounded to 3 digits."""
    whole = df.select(names).dropna()
    pairs = [(a, b) for a in names for b in names]
    one = whole.agg(*[F.round(F.corr(a, b), 3).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], one.columns, "pair", "corr").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "corr")


def feature_stats(df: DataFrame, name: str) -> DataFrame:
    """Counts, quantiles, and the lag-1 autocorrelation of percentage ranks by ticker (mean and median)."""
    x = F.col(name)
    base = df.agg(F.count(x).alias("n_obs"), (1 - F.count(x) / F.count("*")).alias("nan_fraction"), *[F.percentile(x, q).alias(f"q{int(q * 100):02d}") for q in (0.01, 0.25, 0.5, 0.75, 0.99)])
    ranked = df.withColumn("_r", pct_rank(x)).withColumn("_p", F.lag("_r").over(Window.partitionBy("ticker").orderBy("t_idx")))
    both = ranked.where("_r is not null and _p is not null")
    auto = both.groupBy("ticker").agg(F.when((F.stddev_pop("_r") > 0) & (F.stddev_pop("_p") > 0), F.corr("_r", "_p")).alias("c"))
    return base.join(auto.agg(F.avg("c").alias("autocorr_mean"), F.median("c").alias("autocorr_median")))


def net_returns(w: DataFrame, costs: DataFrame) -> DataFrame:
    """(date, gross, cost, net) of weights with their own costs."""
    daily = w.groupBy("date").agg(F.coalesce(F.sum(F.col("weight") * F.col("fwd")), F.lit(0.0)).alias("gross")).join(costs, "date", "left")
    return daily.withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0)))


def candidate(w: DataFrame, costs: DataFrame) -> DataFrame:
    """One row for candidate weights: gross, net, cost drag, and Sharpe ratios with a floor under the deviation."""
    daily = net_returns(w, costs)
    ratio = lambda c: F.avg(c) * math.sqrt(YEAR) / F.greatest(F.stddev_pop(c), F.lit(1e-9))
    return daily.agg(ratio("gross").alias("gross_sharpe"), ratio("net").alias("net_sharpe"), ((F.avg("gross") - F.avg("net")) * YEAR).alias("cost_drag"))


def construction_summary(w: DataFrame) -> DataFrame:
    e = exposures(w)
    return e.agg(F.count("*").alias("n_dates"), F.avg("gross").alias("avg_gross"), F.avg("n_long").alias("avg_n_long"), F.avg("n_short").alias("avg_n_short"), F.max("max_name").alias("max_abs_weight"))
