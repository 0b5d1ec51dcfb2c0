"""Every operator as a query over the star-schema tables: QUERIES[name](spark, sf_dir).  SQL twins are in oracle.py."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from .functions import cross, features
from .operators import accounting, construct, ranking, risk, stores, universe
from .plans import backtest, sandbox
from .sources import panel as src
from .streaming import bars as stream

WEIGHTS = {"reversal_5d": 1.0, "vol_21d": -0.5, "volume_shock": 0.5}
LEAST_DOLLARS = 150_000.0
CONFIG = backtest.Config(features=WEIGHTS, min_dollar_vol=LEAST_DOLLARS, n_deciles=5, exit_n_deciles=2, halflife=3.0, weighting="decile_sticky")
ROUNDED = {"ann_return": 8, "ann_vol": 8, "sharpe": 6, "hit_rate": 8, "skew": 6, "avg_turnover": 8, "max_drawdown": 8, "ic_mean": 8, "ic_ir": 6, "gross_sharpe": 6, "gross_ann_return": 8, "cost_drag": 8}
QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def r(column, digits: int = 8, name: str | None = None):
    """Rounded for comparison; no negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, digits) + F.lit(0.0)).alias(name or column)


def grid(spark, d, by="nation", freq="week", fill=True) -> DataFrame:
    return src.dense(src.from_lineitem(spark, d, by, freq), fill)


def featured(spark, d, *names, **kw) -> DataFrame:
    return features.compute(grid(spark, d, **kw), list(names))


def signalled(spark, d) -> DataFrame:
    """Combined and liquid signal, rounded so that ranks do not hang on the last bit."""
    df = cross.combine(featured(spark, d, *WEIGHTS, "dollar_vol_20d"), WEIGHTS).withColumn("signal", F.round("signal", 9))
    return universe.liquid(df, "signal", "dollar_vol_20d", LEAST_DOLLARS)


def weighted(spark, d) -> DataFrame:
    return ranking.decile_weights(signalled(spark, d), "signal", 5)


def daily(spark, d) -> DataFrame:
    return accounting.returns(weighted(spark, d), 5.0)


# -- scans and masks
@query
def panel_dense(spark, d):
    return grid(spark, d).select("date", "t_idx", "ticker", "ticker_ord", "sector", r("open", 6), r("high", 6), r("low", 6), r("close", 6), "volume")


@query
def panel_dense_raw(spark, d):
    return grid(spark, d, by="supplier", fill=False).select("date", "t_idx", "ticker", "ticker_ord", "sector", r("close", 6), "volume")


@query
def panel_slice(spark, d):
    return src.window_slice(src.from_lineitem(spark, d), "1996-01-01", "1997-12-31").select("date", "ticker", r("close", 6), "volume")


@query
def cache_refresh_keep_last(spark, d):
    bars = src.from_lineitem(spark, d).select("date", "ticker", "close", "volume")
    newer = bars.where("date >= '2000-01-01'").withColumn("close", F.round(F.col("close") * 2, 6))
    return src.keep_last(bars.where("date < '2000-06-01'"), newer).select("date", "ticker", r("close", 6), "volume")


@query
def cache_tail_start(spark, d):
    return src.tail_start(src.from_lineitem(spark, d).where("date < '2000-06-01'"), "1995-01-01")


@query
def ticker_clean(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "nan").when(F.col("p_partkey") % 7 == 1, " - ").when(F.col("p_partkey") % 7 == 2, "None").otherwise(F.concat(F.lit(" brk."), F.col("p_brand"))).alias("raw"))
    return raw.select("p_partkey", src.clean_ticker(F.col("raw")).alias("ticker"))


@query
def requested_tickers(spark, d):
    asked = [f"NATION_{i}" for i in (3, 99, 1, 3, 2, 98, 4)]
    return src.requested(src.from_lineitem(spark, d).select("ticker", "date", "volume"), asked, 5).select("ticker", "asked", "date", "volume")


def _changes(spark, d):
    ordered = grid(spark, d).select("ticker", "ticker_ord").distinct()
    n = ordered.withColumnsRenamed({"ticker": "added", "ticker_ord": "k"}).where("k < 10")
    n = n.withColumn("_r", F.col("k") + 7).join(ordered.withColumnsRenamed({"ticker": "removed", "ticker_ord": "_r"}), "_r", "left")
    return ordered.where("ticker_ord % 5 <> 0").select("ticker"), n.select(F.expr("date_add(date'1996-01-01', cast(97 * k as int))").alias("effective_date"), "added", "removed")


@query
def universe_changes(spark, d):
    raw = _changes(spark, d)[1].select(F.when(F.col("added") == "NATION_1", "soon").otherwise(F.col("effective_date").cast("string")).alias("date"), F.lower("added").alias("added"), F.coalesce("removed", F.lit("nan")).alias("removed"))
    return src.changes_table(raw)


@query
def membership_pit(spark, d):
    return universe.membership(grid(spark, d).select("date"), *_changes(spark, d))


@query
def membership_average(spark, d):
    return universe.average_members(membership_pit(spark, d)).select(r("avg_members", 6))


@query
def mask_liquidity(spark, d):
    df = featured(spark, d, "reversal_5d", "dollar_vol_20d").withColumnRenamed("reversal_5d", "signal")
    return universe.liquid(df, "signal", "dollar_vol_20d", LEAST_DOLLARS).select("date", "ticker", r("signal"))


@query
def mask_membership(spark, d):
    df = featured(spark, d, "reversal_5d").withColumnRenamed("reversal_5d", "signal")
    return universe.masked(df, membership_pit(spark, d)).select("date", "ticker", r("signal"))


@query
def calendar_business_days(spark, d):
    return src.business_days(spark, "1995-01-01", "2001-12-31")


# -- features
def _feature(name: str, digits: int = 8):
    def run(spark, d):
        return featured(spark, d, name).select("date", "ticker", r(name, digits))

    QUERIES[f"f_{name}"] = run


for _name, _digits in (("mom_12_1", 8), ("reversal_5d", 8), ("vol_21d", 8), ("volume_shock", 8), ("dollar_vol_20d", 4), ("amihud_20d", 12), ("range_feature", 7), ("pct_off_52w_high", 8), ("overnight_drift_20d", 8), ("signed_vol_20d", 4), ("low_vol_252d", 8), ("idio_vol_60d", 6)):
    _feature(_name, _digits)


@query
def f_forward_return(spark, d):
    return featured(spark, d).select("date", "ticker", r("fwd"))


@query
def f_gaps_padded(spark, d):
    """Raw panel with missing bars: padded changes next to plain shifts."""
    return featured(spark, d, "reversal_5d", "vol_21d", "mom_12_1", by="supplier", fill=False).select("date", "ticker", r("reversal_5d"), r("vol_21d", 6), r("mom_12_1"), r("fwd"))


@query
def f_user_defined(spark, d):
    source = "def drift(p):\n    return (p['close'] / p['open'] - 1).rolling(5).mean()\n"
    return sandbox.apply(grid(spark, d), source).select("date", "ticker", r("drift"))


# -- cross-section
@query
def xs_winsorize(spark, d):
    return featured(spark, d, "reversal_5d").withColumn("x", cross.winsorize(F.col("reversal_5d"), 0.05)).select("date", "ticker", r("x"))


@query
def xs_z_robust(spark, d):
    return cross.add_zscore(featured(spark, d, "reversal_5d"), "reversal_5d", "z").select("date", "ticker", r("z"))


@query
def xs_z_std(spark, d):
    return cross.add_zscore(featured(spark, d, "reversal_5d"), "reversal_5d", "z", robust=False).select("date", "ticker", r("z"))


@query
def xs_combine(spark, d):
    return cross.combine(featured(spark, d, *WEIGHTS), WEIGHTS).select("date", "ticker", r("signal", 7))


@query
def xs_ewma(spark, d):
    return cross.smooth(signalled(spark, d), "signal", 3.0).select("date", "ticker", r("signal", 7))


@query
def xs_pct_rank(spark, d):
    return featured(spark, d, "reversal_5d").withColumn("x", F.round("reversal_5d", 3)).withColumn("p", cross.pct_rank(F.col("x"))).select("date", "ticker", r("p"))


@query
def neut_sector(spark, d):
    return featured(spark, d, "reversal_5d").withColumn("x", cross.sector_neutral(F.col("reversal_5d"), F.col("sector"))).select("date", "ticker", r("x"))


@query
def neut_size(spark, d):
    return cross.neutralize(signalled(spark, d), "signal", None, "dollar_vol_20d", "x").select("date", "ticker", r("x", 7))


@query
def neut_full(spark, d):
    return cross.neutralize(signalled(spark, d), "signal", "sector", "dollar_vol_20d", "x").select("date", "ticker", r("x", 7))


# -- ranking and accounting
@query
def rank_deciles(spark, d):
    return ranking.deciles(signalled(spark, d), "signal", 5).select("date", "ticker", "bucket")


@query
def rank_deciles_wide(spark, d):
    """Ten buckets over the supplier panel."""
    df = featured(spark, d, "reversal_5d", by="supplier").withColumn("x", F.round("reversal_5d", 9))
    return ranking.deciles(df, "x", 10).select("date", "ticker", "bucket")


@query
def w_decile(spark, d):
    return weighted(spark, d).select("date", "ticker", r("weight"))


@query
def w_sticky(spark, d):
    return ranking.sticky_weights(signalled(spark, d), "signal", 5, 2).select("date", "ticker", r("weight"))


@query
def w_sticky_wide_exit(spark, d):
    """exit_n = 1: a name stays until the other side's bucket."""
    return ranking.sticky_weights(signalled(spark, d), "signal", 5, 1).select("date", "ticker", r("weight"))


@query
def w_signal(spark, d):
    return ranking.signal_weights(signalled(spark, d)).select("date", "ticker", r("weight", 7))


@query
def per_decile(spark, d):
    return ranking.per_decile(signalled(spark, d), "signal", 5).select("date", F.col("decile").cast("int").alias("decile"), r("ret"))


@query
def bt_returns(spark, d):
    return daily(spark, d).select("date", r("gross"), r("turnover"), r("cost", 10), r("net"))


@query
def cost_flat(spark, d):
    return accounting.flat_cost(weighted(spark, d), 10.0).select("date", r("cost", 10))


@query
def cost_sqrt(spark, d):
    return accounting.sqrt_cost(weighted(spark, d), 1.0, 10.0, 1e6).select("date", r("cost", 10))


@query
def cost_composite(spark, d):
    return accounting.cost_model("composite", weighted(spark, d), flat_bps=5.0, capital=1e6).select("date", r("cost", 10))


@query
def m_summary(spark, d):
    return _rounded(accounting.summary(daily(spark, d)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c, ROUNDED[c]) if c in ROUNDED else F.col(c) for c in df.columns])


@query
def m_drawdown(spark, d):
    """Of a hundredth of the returns, so that the path stays in a range that doubles can tell apart."""
    return accounting.equity(daily(spark, d).withColumn("net", F.col("net") / 100)).select("date", r("equity"), r("drawdown"))


@query
def m_decile_spread(spark, d):
    return _rounded(accounting.decile_spread(ranking.per_decile(signalled(spark, d), "signal", 5)))


@query
def m_ic(spark, d):
    df = signalled(spark, d).withColumn("fwd", F.round("fwd", 9))
    return accounting.information_coefficient(df).select("date", r("ic"))


@query
def m_ic_summary(spark, d):
    return _rounded(accounting.ic_summary(accounting.information_coefficient(signalled(spark, d).withColumn("fwd", F.round("fwd", 9)))))


@query
def m_gross(spark, d):
    return _rounded(accounting.gross_addons(daily(spark, d)))


# -- risk and diagnostics
@query
def r_exposures(spark, d):
    return risk.exposures(ranking.sticky_weights(signalled(spark, d), "signal", 5, 2)).select("date", r("gross"), r("net"), r("max_name"), "n_long", "n_short")


@query
def r_sector(spark, d):
    return risk.sector_exposure(weighted(spark, d)).select("date", "sector", r("exposure"))


@query
def r_turnover(spark, d):
    return risk.average_turnover(weighted(spark, d)).select(r("avg_turnover"))


@query
def r_metrics(spark, d):
    return risk.all_metrics(weighted(spark, d), cost_bps=5.0).select("metric", r("value", 7))


HARD = [("gross", "gross_exposure", "<=", 1.5), ("net", "net_exposure", "<=", 0.1), ("turnover", "avg_turnover", "<", 0.1), ("drawdown", "max_drawdown", ">=", -0.5), ("breadth", "min_n_long", ">", 2.0), ("unmeasured", "ic_ir", ">=", 1.0)]
SOFT = [("turnover", "avg_turnover", 0.2, 1.0), ("sector", "max_sector_weight", 0.3, 2.0), ("unmeasured", "sharpe", 0.3, 1.0)]


@query
def r_violations(spark, d):
    return risk.violations(r_metrics(spark, d), risk.constraints(spark, HARD))


@query
def r_soft(spark, d):
    return risk.soft_scores(r_metrics(spark, d), spark.createDataFrame(SOFT, "name string, metric string, target double, weight double")).select("name", r("score", 6))


@query
def d_ic_by_year(spark, d):
    ic = accounting.information_coefficient(signalled(spark, d).withColumn("fwd", F.round("fwd", 9)))
    return risk.ic_by_year(ic).select("year", r("ic_mean"), r("ic_ir", 6), "n")


@query
def d_equity_year_end(spark, d):
    return risk.year_end_equity(daily(spark, d)).select("year", r("equity"))


@query
def d_decile_report(spark, d):
    return risk.decile_report(ranking.per_decile(signalled(spark, d), "signal", 5)).select("decile", r("ann_mean", 6), r("sharpe", 6))


@query
def d_feature_corr(spark, d):
    return risk.feature_correlations(featured(spark, d, *WEIGHTS), list(WEIGHTS)).select("a", "b", (F.col("corr") + 0.0).alias("corr"))


@query
def d_feature_stats(spark, d):
    df = featured(spark, d, "reversal_5d").withColumn("reversal_5d", F.round("reversal_5d", 6))
    out = risk.feature_stats(df, "reversal_5d")
    return out.select("n_obs", *[r(c, 6) for c in out.columns if c != "n_obs"])


@query
def d_candidate(spark, d):
    w = weighted(spark, d)
    return risk.candidate(w, accounting.sqrt_cost(w, 1.0, 10.0, 1e6)).select(r("gross_sharpe", 6), r("net_sharpe", 6), r("cost_drag", 7))


@query
def d_governance(spark, d):
    w = weighted(spark, d).persist()  # returns and violations read it
    day = accounting.returns(w)
    one = accounting.summary(day).select("sharpe", "ann_return").join(accounting.gross_addons(day).select("gross_ann_return")).join(m_ic_summary(spark, d).select("ic_ir")).join(risk.violations(risk.all_metrics(w, cost_bps=5.0), risk.constraints(spark, HARD)).agg(F.count("*").alias("n_violations")))
    return risk.governance(one)


# -- construction
@query
def p_shrink_cov(spark, d):
    df = features.compute(grid(spark, d), []).withColumn("ret", features.pct_change(F.col("adj_close")))
    return construct.shrunk_covariance(df).select("a", "b", r("cov", 9))


def _constructed(spark, d):
    return signalled(spark, d).withColumn("ret", features.pct_change(F.col("adj_close")))


@query
def p_mean_variance(spark, d):
    return construct.mean_variance(_constructed(spark, d)).select("date", "ticker", r("weight", 6))


@query
def p_risk_parity(spark, d):
    return construct.risk_parity(_constructed(spark, d)).select("date", "ticker", r("weight", 6))


@query
def p_constrained(spark, d):
    return construct.constrained(_constructed(spark, d), 0.15, 0.5, 1.0).select("date", "ticker", r("weight", 6))


@query
def p_summary(spark, d):
    s = risk.construction_summary(weighted(spark, d))
    return s.select("n_dates", *[r(c, 7) for c in s.columns if c != "n_dates"])


# -- stores; runs, forecasts and versions are read out of the events table
def _runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("run-"), F.col("event_id")).alias("run_id"), (F.col("value") / 100).alias("sharpe"), F.create_map(F.col("event_type"), F.lit(1.0)).alias("feature_weights"))


@query
def j_top_runs(spark, d):
    return stores.top_runs(_runs(spark, d), 5).select("seq", "run_id", "sharpe")


@query
def j_recent_runs(spark, d):
    return stores.recent_runs(_runs(spark, d), 20).select("seq", "run_id", "sharpe")


@query
def j_best_run(spark, d):
    return stores.best_run(_runs(spark, d))


@query
def j_best_by_feature(spark, d):
    return stores.best_by_feature(_runs(spark, d))


def _ledger(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    e = stores.windowed_next(e, "value", "user_id", "ts")
    base = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.array(F.col("user_id").cast("string")).alias("key"), (F.col("value") * 1.2).alias("low"), (F.col("value") * 0.8).alias("high"), "actual")
    return stores.recorded(base)


@query
def k_resolved(spark, d):
    return stores.resolved(_ledger(spark, d)).select("seq", "type", "in_range", r("miss", 6))


@query
def k_summary(spark, d):
    out = stores.ledger_summary(stores.resolved(_ledger(spark, d)).withColumn("miss", F.round("miss", 6)))
    return out.select("type", "n", "n_hits", *[(F.round(c, 2) + 0.0).alias(c) for c in ("hit_rate", "mean_miss", "mean_miss_outside")])


@query
def k_recent(spark, d):
    return stores.recent_resolved(stores.resolved(_ledger(spark, d)), 8).select("seq", "type", "in_range")


@query
def k_resolve_pairs(spark, d):
    pending = spark.createDataFrame([("p1", "correlation", ["vol_21d", "reversal_5d"], -1.0, 1.0, "pending"), ("p2", "correlation", ["volume_shock", "vol_21d"], 0.9, 1.0, "pending"), ("p3", "sharpe", ["x"], 0.0, 1.0, "pending")], "id string, type string, key array<string>, low double, high double, status string")
    return stores.resolve_pairs(pending, d_feature_corr(spark, d)).select("id", r("actual", 3), "in_range", r("miss", 3))


@query
def k_resolve_by_type(spark, d):
    pending = spark.createDataFrame([("p1", "net_sharpe", ["a"], -5.0, 5.0, "pending"), ("p2", "turnover", ["b"], 0.0, 0.01, "pending"), ("p3", "other", ["c"], 0.0, 1.0, "pending")], "id string, type string, key array<string>, low double, high double, status string")
    one = m_summary(spark, d).select("sharpe", "avg_turnover").unpivot([], ["sharpe", "avg_turnover"], "type", "actual")
    return stores.resolve_by_type(pending, one).select("id", r("actual", 6), "in_range", r("miss", 6))


def _versions(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("agent"), F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("version"), F.col("props").alias("text"), (F.col("value") > 20).alias("promoted"), (F.col("value") > 60).alias("rolled_back"))


@query
def v_heads(spark, d):
    return stores.version_heads(_versions(spark, d))


@query
def v_line_diff(spark, d):
    docs = spark.read.parquet(f"{d}/conversations.parquet")
    pairs = docs.groupBy(F.col("conv_id").alias("pair")).agg(F.min_by("text", "turn").alias("old"), F.max_by("text", "turn").alias("new"))
    return stores.line_diff(pairs).groupBy("pair", "change").agg(F.count("*").alias("n"))


@query
def v_slug(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", stores.slugify(F.concat_ws(" -- ", "p_name", "p_brand", "p_type")).alias("slug"))


@query
def v_proposals(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", stores.valid_proposal(F.col("role"), F.col("text"), F.substring("text", 1, 31), ["user", "assistant"]).alias("outcome"))


@query
def o_promotion(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cases = e.select("event_id", (F.col("event_id") % 500).alias("n_obs"), (F.col("value") / 100).alias("delta"), (F.col("user_id") % 30).alias("n_tests"), (F.col("event_id") % 97 / 97).alias("avg_turnover"))
    return stores.promotion(cases).select("event_id", "decision")


@query
def o_verdict(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 5 == 0, "we say Approved").when(F.col("event_id") % 5 == 1, "audit_required, not approved").when(F.col("event_id") % 5 == 2, "vetoed and approved").when(F.col("event_id") % 5 == 3, "nothing")
    return e.select("event_id", stores.verdict(text).alias("verdict"))


# -- whole runs
@query
def pipeline_full(spark, d):
    """Combine, masks, smoothing, neutralisation, sticky buckets, accounting, all metrics: one row."""
    panel = grid(spark, d)
    signal = _settled(backtest.make_signal(panel, CONFIG, membership_pit(spark, d))).persist()  # weights and IC read it
    return _rounded(backtest.report(backtest.run(panel, CONFIG, signal=signal)))


def _settled(df: DataFrame) -> DataFrame:
    """Rounded, so that ranks do not hang on the last bit."""
    return df.withColumns({"signal": F.round("signal", 7), "fwd": F.round("fwd", 9)})


def _cells(spark, d):
    panel = grid(spark, d)
    base = replace(CONFIG, halflife=0.0)
    return panel, base


@query
def compare_variants(spark, d):
    panel, base = _cells(spark, d)
    kinds = {"decile": replace(base, weighting="decile"), "sticky": base, "signal": replace(base, weighting="signal_weighted")}
    out = backtest.compare(panel, kinds, prepare=_settled)
    return out.select("variant", "n_obs", "ic_n", r("ic_ir", 4), r("ann_return", 4), r("avg_turnover", 4))


@query
def grid_pivot(spark, d):
    panel, base = _cells(spark, d)
    cells = backtest.grid(panel, base, [0.0, 3.0], [None, 2], prepare=_settled)
    return backtest.grid_table(cells.withColumn("avg_turnover", F.round("avg_turnover", 4)), "avg_turnover")


@query
def stream_bars(spark, d):
    return stream.tumbling_bars(spark.read.parquet(f"{d}/events.parquet")).select("date", "ticker", "open", "high", "low", "close", "volume")


def flagship(spark, d):
    """One row for the plain decile run."""
    return m_summary(spark, d)
