"""Bars and the dense (date, ticker) grid that every other module works on.

One long table: date DATE, t_idx (position in the union calendar), ticker, ticker_ord (column order), sector, open, high,
low, close, adj_close, volume.  Missing is NULL, never NaN.  The grid has one row per date and ticker; nothing after it
may filter rows, only set values to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def clean_number(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Tolerant renames, adj_close falling back to close, dates at midnight, NaN to NULL; other columns are dropped."""
    names = {c: c.strip().lower().replace(" ", "_") for c in raw.columns}
    df = raw.withColumnsRenamed(names)
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    df = df.withColumn("adj_close", F.coalesce(clean_number(F.col("adj_close").cast("double")), F.col("close").cast("double")))
    return df.select(F.to_date("date").alias("date"), "ticker", *[clean_number(F.col(c).cast("double")).alias(c) for c in FIELDS if c in df.columns])


def clean_ticker(x: Column) -> Column:
    """NULL for '', 'nan', 'none' and '-'; otherwise upper case with '.' as '-'."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin("", "nan", "none", "-"), F.replace(F.upper(t), F.lit("."), F.lit("-")))


def keep_last(*batches: DataFrame) -> DataFrame:
    """Cache refresh: batches in order of arrival, one row per (ticker, date), the last one wins."""
    tagged = None
    for n, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(n))
        tagged = b if tagged is None else tagged.unionByName(b, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in ("ticker", "date", "_batch")]
    last = tagged.groupBy("ticker", "date").agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
    return last.select("ticker", "date", "_r.*")


def tail_start(cached: DataFrame, start: str) -> DataFrame:
    """Per ticker, the first date that a refresh has to fetch: the day after the last cached one (never a backfill)."""
    return cached.groupBy("ticker").agg(F.date_add(F.max("date"), 1).alias("fetch_from")).withColumn("requested", F.lit(start).cast("date"))


def window_slice(bars: DataFrame, start: str, end: str = "today") -> DataFrame:
    end = F.current_date() if end == "today" else F.lit(end).cast("date")
    return bars.where(F.col("date").between(F.lit(start).cast("date"), end))


def requested(bars: DataFrame, tickers: list[str], limit: int | None = None) -> DataFrame:
    """Rows for the requested tickers in their order; a ticker without bars keeps one row of NULLs."""
    ordered = list(dict.fromkeys(tickers))[:limit]
    asked = bars.sparkSession.createDataFrame([(t, i) for i, t in enumerate(ordered)], "ticker string, asked int")
    return F.broadcast(asked).join(bars, "ticker", "left")


def from_lineitem(spark: SparkSession, sf_dir: str, by: str = "nation", freq: str = "week") -> DataFrame:
    """Bars from the order lines: ticker = nation or supplier, one bar per day or week."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))  # integers add up the same in any order
    price = F.round(cents / F.lit(100.0) / F.sum("l_quantity"), 6)
    rows = rows.withColumns({"date": F.date_trunc(freq, "l_shipdate").cast("date"), "ticker": F.col("n_name" if by == "nation" else "s_name"), "sector": F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))})
    return rows.groupBy("date", "ticker", "sector").agg(
        F.round(F.avg(unit), 6).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), price.alias("close"), price.alias("adj_close"), F.sum("l_quantity").alias("volume")
    )


def dense(bars: DataFrame, fill: bool = False) -> DataFrame:
    """The grid: all dates of any ticker times all tickers with data.  fill: prices carried forward, volume 0."""
    dates = bars.select("date").distinct().withColumn("t_idx", F.row_number().over(Window.orderBy("date")) - 1)  # a calendar: thousands of rows
    tickers = bars.groupBy("ticker").agg(F.max("sector").alias("sector")).withColumn("ticker_ord", F.row_number().over(Window.orderBy("ticker")) - 1)
    grid = tickers.crossJoin(F.broadcast(dates))
    fields = [c for c in FIELDS if c in bars.columns]
    out = grid.join(bars.select("date", "ticker", *fields), ["date", "ticker"], "left")
    if fill:
        past = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.coalesce("volume", F.lit(0.0)) if c == "volume" else F.last(c, ignorenulls=True).over(past) for c in fields})
    return out.select("date", "t_idx", "ticker", "ticker_ord", "sector", *fields)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rows of the last snapshot date."""
    last = snapshots.agg(F.max("snapshot_date").alias("snapshot_date"))
    return snapshots.join(F.broadcast(last), "snapshot_date")


def changes_table(raw: DataFrame, date_col: str = "date", added_col: str = "added", removed_col: str = "removed") -> DataFrame:
    """Membership changes: dates coerced, tickers cleaned, rows without a date or without both tickers dropped, sorted."""
    out = raw.select(F.try_to_timestamp(F.col(date_col).cast("string")).cast("date").alias("effective_date"), clean_ticker(F.col(added_col)).alias("added"), clean_ticker(F.col(removed_col)).alias("removed"))
    return out.where(F.col("effective_date").isNotNull() & (F.col("added").isNotNull() | F.col("removed").isNotNull())).orderBy("effective_date")
