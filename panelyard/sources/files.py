"""Universe, bars and membership from a workspace's files, and the interface of a bar source that refreshes them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import universe
from . import panel
from .layout import Layout, write_table

BATCH = 50  # tickers that a source is asked for at a time


class BarSource(Protocol):
    """Whatever gives bars: (ticker, date, open, high, low, close, adj_close, volume) for tickers from a date on."""

    def fetch(self, spark: SparkSession, tickers: list[str], start: str, end: str) -> DataFrame: ...


def batches(tickers: list[str], size: int = BATCH) -> Iterator[list[str]]:
    for at in range(0, len(tickers), size):
        yield tickers[at : at + size]


def constituents(raw: DataFrame) -> DataFrame:
    """(ticker, name, sector) of a constituents table: columns by their usual names, tickers cleaned, rows without one
    dropped."""
    known = {c.strip().lower().replace("_", " "): c for c in raw.columns}

    def pick(*names: str):
        found = next((known[n] for n in names if n in known), None)
        return F.col(f"`{found}`") if found else F.lit(None).cast("string")

    out = raw.select(panel.clean_ticker(pick("symbol", "ticker")).alias("ticker"), pick("security", "name").alias("name"), pick("gics sector", "sector").alias("sector"))
    return out.where("ticker is not null").dropDuplicates(["ticker"])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def save_universe(layout: Layout, rows: DataFrame, date: str) -> None:
    """Adds a snapshot of (ticker, name, sector) with its date."""
    rows.withColumn("snapshot_date", F.lit(date).cast("date")).write.mode("append").parquet(layout.meta("universe"))


def load_universe(spark: SparkSession, layout: Layout) -> DataFrame:
    """The rows of the latest snapshot."""
    return panel.latest_snapshot(spark.read.parquet(layout.meta("universe")))


def refresh(spark: SparkSession, layout: Layout, source: BarSource, tickers: list[str], start: str, end: str) -> None:
    """Fetches what each ticker lacks after its last cached bar (all from `start` without one), in batches, and writes the
    merged cache: the last fetch wins."""
    path = layout.bars()
    cached = spark.read.parquet(path) if os.path.exists(path.removeprefix("file://")) else None
    since = {r["ticker"]: str(r["fetch_from"]) for r in panel.tail_start(cached, start).collect()} if cached is not None else {}
    parts = [cached] if cached is not None else []
    for some in batches(tickers):
        starts = {t: since.get(t, start) for t in some}
        got = panel.normalise_bars(source.fetch(spark, some, min(starts.values()), end))
        own = spark.createDataFrame(list(starts.items()), "ticker string, _from string")
        parts.append(got.join(F.broadcast(own), "ticker").where(F.col("date") >= F.col("_from").cast("date")).drop("_from"))
    merged = panel.keep_last(*parts)
    write_table(merged, path + ".next")
    write_table(spark.read.parquet(path + ".next"), path)


def load_bars(spark: SparkSession, layout: Layout, start: str, end: str = "today", limit: int | None = None, source: BarSource | None = None) -> DataFrame:
    """Cached bars of the universe's (first `limit`) tickers within the window, refreshed first if a source is given."""
    names = load_universe(spark, layout).select("ticker").orderBy("ticker")
    names = names.limit(limit) if limit else names
    if source is not None:
        refresh(spark, layout, source, [r["ticker"] for r in names.collect()], start, end)  # a universe is a few thousand names
    bars = panel.normalise_bars(spark.read.parquet(layout.bars()))
    return panel.window_slice(bars, start, end).join(F.broadcast(names), "ticker").withColumn("sector", F.lit(None).cast("string"))


def save_changes(layout: Layout, raw: DataFrame) -> None:
    write_table(panel.changes_table(raw), layout.meta("changes"))


def load_membership(spark: SparkSession, layout: Layout, dates: DataFrame) -> DataFrame:
    """(date, ticker, member) for the dates, from the current universe and the changes table."""
    return universe.membership(dates, load_universe(spark, layout).select("ticker"), spark.read.parquet(layout.meta("changes")))


def save_membership(layout: Layout, members: DataFrame) -> None:
    write_table(members, layout.meta("membership"))


def cached_membership(spark: SparkSession, layout: Layout) -> DataFrame | None:
    path = layout.meta("membership")
    return spark.read.parquet(path) if os.path.exists(path.removeprefix("file://")) else None
