"""Deciles and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cross import by_date


def bucket_of(rank: Column, total: Column, n: int) -> Column:
    """Quantile bucket of a rank 1..total: how many interpolated edges lie below it, in the double arithmetic that a
    quantile cut over the ranks makes.  One name alone has no bucket."""
    step = 1.0 / n
    below = F.lit(0)
    for k in range(n + 1):
        q = 1.0 if k == n else (k * step) * 100 / 100
        p = (total - 1) * F.lit(q)
        f = F.floor(p)
        a, b, t = (1 + f).cast("double"), (1 + F.least(f + 1, total - 1)).cast("double"), p - f
        edge = F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))
        below = below + F.when(edge < rank, 1).otherwise(0)
    return F.when(total > 1, F.greatest(below, F.lit(1)) - 1)


def deciles(df: DataFrame, column: str, n: int, target: str = "bucket") -> DataFrame:
    """Bucket 0..n-1 over the date's non-NULL names; ties go by ticker order."""
    x = F.col(column)
    rank = F.row_number().over(Window.partitionBy("date", x.isNull()).orderBy(x, "ticker_ord"))
    df = df.withColumns({"_r": rank, "_n": F.count(x).over(by_date())})
    return df.withColumn(target, F.when(x.isNotNull(), bucket_of(F.col("_r"), F.col("_n"), n)).cast("int")).drop("_r", "_n")


def _equal(df: DataFrame, long: Column, short: Column) -> DataFrame:
    df = df.withColumns({"_l": F.coalesce(long, F.lit(False)), "_s": F.coalesce(short, F.lit(False))})
    up, down = F.sum(F.col("_l").cast("int")).over(by_date()), F.sum(F.col("_s").cast("int")).over(by_date())
    weight = F.when(F.col("_l"), F.lit(1.0) / up).when(F.col("_s"), F.lit(-1.0) / down).otherwise(0.0)
    return df.withColumn("weight", weight).drop("_l", "_s")


def decile_weights(df: DataFrame, column: str = "signal", n: int = 10) -> DataFrame:
    """+1/n_top in the top bucket, -1/n_bottom in the bottom one, 0 elsewhere and for NULLs."""
    df = deciles(df, column, n, "_b")
    return _equal(df, F.col("_b") == n - 1, F.col("_b") == 0).drop("_b")


def sticky_weights(df: DataFrame, column: str = "signal", n: int = 10, exit_n: int | None = None) -> DataFrame:
    """Hysteresis: a name enters in the top bucket of n and stays while in the top bucket of exit_n; shorts mirror it.
    A NULL clears the state.  A name is long exactly if its last entry is later than its last exit.  With exit_n = 1 there
    is no exit but the other side's entry, which wins; with n = 1 every name is on both sides, which leaves nothing."""
    exit_n = exit_n or max(1, n // 2)
    if exit_n > n:
        raise ValueError("exit_n must not exceed n")
    df = deciles(deciles(df, column, n, "_e"), column, exit_n, "_h")
    past = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    if n == 1:
        return df.withColumn("weight", F.lit(0.0)).drop("_e", "_h")
    if exit_n == 1:
        event = F.when(F.col("_h").isNull(), 0).when(F.col("_e") == n - 1, 1).when(F.col("_e") == 0, -1)
        df = df.withColumn("_side", F.last(event, ignorenulls=True).over(past))
        return _equal(df, F.col("_side") == 1, F.col("_side") == -1).drop("_e", "_h", "_side")

    def held(enter: Column, stay: Column) -> Column:
        enter, stay = F.coalesce(enter, F.lit(False)), F.coalesce(stay, F.lit(False))
        since = lambda c: F.coalesce(F.last(F.when(c, F.col("t_idx")), ignorenulls=True).over(past), F.lit(-1))
        return since(enter) > since(~enter & ~stay)

    df = df.withColumns({"_long": held(F.col("_e") == n - 1, F.col("_h") == exit_n - 1), "_short": held(F.col("_e") == 0, F.col("_h") == 0)})
    return _equal(df, F.col("_long"), F.col("_short")).drop("_e", "_h", "_long", "_short")


def signal_weights(df: DataFrame, column: str = "signal", gross: float = 2.0) -> DataFrame:
    x = F.col(column)
    df = df.withColumn("_c", x - F.avg(x).over(by_date()))
    return df.withColumn("weight", F.coalesce(F.try_divide(F.col("_c"), F.sum(F.abs("_c")).over(by_date())) * gross, F.lit(0.0))).drop("_c")


def weigh(df: DataFrame, scheme: str, n: int = 10, exit_n: int | None = None, column: str = "signal") -> DataFrame:
    if scheme == "decile":
        return decile_weights(df, column, n)
    if scheme == "decile_sticky":
        return sticky_weights(df, column, n, exit_n)
    if scheme == "signal_weighted":
        return signal_weights(df, column)
    raise ValueError(f"unknown weighting {scheme!r}")


def per_decile(df: DataFrame, column: str = "signal", n: int = 10, fwd: str = "fwd") -> DataFrame:
    """(date, decile, ret): missing forward returns count as 0 in the mean; empty buckets are NULL rows."""
    grid = df.select("date").distinct().withColumn("decile", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    got = deciles(df, column, n, "decile").where("decile is not null").groupBy("date", "decile").agg((F.sum(F.coalesce(fwd, F.lit(0.0))) / F.count("*")).alias("ret"))
    return grid.join(got, ["date", "decile"], "left")
