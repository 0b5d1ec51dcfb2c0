"""Masks: liquidity and point-in-time membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def liquid(df: DataFrame, column: str = "signal", size: str = "dollar_vol_20d", least: float = 5e6) -> DataFrame:
    """Keeps the value where the dollar volume is known and large enough; rows stay."""
    return df.withColumn(column, F.when(F.col(size) >= least, F.col(column)))


def membership_intervals(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(ticker, lo, hi, member): membership on dates in [lo, hi), NULL bounds open.

    Walking back from today, a change after a date undoes itself: `added` was no member before, `removed` was one (and
    wins within one change).  So before an event the state is its kind, and after the last event it is today's."""
    numbered = changes.select("effective_date", "added", "removed", F.monotonically_increasing_id().alias("_n"))
    kinds = numbered.select("effective_date", "_n", F.explode(F.array(F.struct(F.col("added").alias("ticker"), F.lit(False).alias("before"), F.lit(0).alias("k")), F.struct(F.col("removed").alias("ticker"), F.lit(True).alias("before"), F.lit(1).alias("k")))).alias("e"))
    events = kinds.select("effective_date", "_n", "e.*").where(F.col("ticker").isNotNull())
    # of several events on one date the one that the backward walk meets last decides what was before
    events = events.groupBy("ticker", "effective_date").agg(F.max_by("before", F.struct(-F.col("_n"), F.col("k"))).alias("member"))
    order = Window.partitionBy("ticker").orderBy("effective_date")
    before = events.select("ticker", F.lag("effective_date").over(order).alias("lo"), F.col("effective_date").alias("hi"), "member")
    now = current.select("ticker").distinct().withColumn("_now", F.lit(True))
    last = events.groupBy("ticker").agg(F.max("effective_date").alias("lo")).join(now, "ticker", "full")
    after = last.select("ticker", "lo", F.lit(None).cast("date").alias("hi"), F.coalesce("_now", F.lit(False)).alias("member"))
    return before.unionByName(after)


def membership(dates: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """(date, ticker, member) for every date and every ticker that ever was a member: an interval join."""
    spans = membership_intervals(current, changes)
    d = F.broadcast(dates.select("date").distinct())  # a calendar
    hit = (F.col("date") >= F.coalesce("lo", F.lit("0001-01-01").cast("date"))) & (F.col("date") < F.coalesce("hi", F.lit("9999-12-31").cast("date")))
    return spans.join(d, hit).select("date", "ticker", "member")


def masked(df: DataFrame, members: DataFrame, column: str = "signal") -> DataFrame:
    """Keeps the value of members; names or dates that the mask does not know are no members."""
    m = members.select("date", "ticker", F.col("member").alias("_m"))
    return df.join(m, ["date", "ticker"], "left").withColumn(column, F.when(F.coalesce("_m", F.lit(False)), F.col(column))).drop("_m")


def average_members(members: DataFrame) -> DataFrame:
    return members.groupBy("date").agg(F.sum(F.col("member").cast("int")).alias("n")).agg(F.avg("n").alias("avg_members"))
