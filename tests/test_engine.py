"""Operators against pandas, numpy and plain loops on small panels with gaps."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import cross, features
from panelyard.operators import accounting, construct, ranking, risk, stores, universe
from panelyard.plans import backtest, cycle, policy, sandbox, session
from panelyard.sources import layout, panel as src
from panelyard.streaming import bars as stream


def wide(spark, values: np.ndarray, column="signal", **more):
    """Long grid from a dates x tickers array; more: further columns of the same shape."""
    rows, names = [], [column, *more]
    start = dt.date(2020, 1, 1)
    for t in range(values.shape[0]):
        for k in range(values.shape[1]):
            cells = [None if not np.isfinite(m[t, k]) else float(m[t, k]) for m in (values, *more.values())]
            rows.append((start + dt.timedelta(days=t), t, f"T{k:03d}", k, "A" if k % 2 else "B", *cells))
    return spark.createDataFrame(rows, "date date, t_idx int, ticker string, ticker_ord int, sector string, " + ", ".join(f"{n} double" for n in names))


def back(df, column):
    pdf = df.select("t_idx", "ticker", column).toPandas()
    return pdf.pivot(index="t_idx", columns="ticker", values=column).to_numpy(dtype=float)


def gappy(rng, shape, share=0.15):
    x = rng.normal(size=shape)
    x[rng.random(shape) < share] = np.nan
    return x


def same(a, b, tol=1e-9):
    return np.allclose(a, b, atol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(42)
    return 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, (300, 8)), axis=0))


@pytest.fixture(scope="module")
def panel(spark, prices):
    volume = np.random.default_rng(1).integers(10**6, 10**7, prices.shape).astype(float)
    return wide(spark, prices, "adj_close", open=prices, high=prices * 1.01, low=prices * 0.99, close=prices, volume=volume).persist()


def test_features(spark, panel, prices):
    out = features.compute(panel, ["mom_12_1", "reversal_5d", "vol_21d", "volume_shock", "dollar_vol_20d", "amihud_20d"]).persist()
    px = pd.DataFrame(prices)
    mom = back(out, "mom_12_1")
    assert np.isnan(mom[:252]).all() and not np.isnan(mom[252:]).any()
    assert same(back(out, "reversal_5d"), (-(px / px.shift(5) - 1)).to_numpy())
    assert same(back(out, "vol_21d"), px.pct_change().rolling(21).std().to_numpy())
    assert same(back(out, "fwd"), px.pct_change().shift(-1).to_numpy())
    flat = features.compute(panel.withColumn("volume", F.lit(1e6)), ["volume_shock"])
    shock = back(flat, "volume_shock")
    assert np.isnan(shock[:19]).all() and np.abs(shock[19:]).max() < 1e-12
    with pytest.raises(KeyError):
        features.compute(panel, ["nope"])


def test_gaps_are_padded_in_changes_only(spark):
    x = np.array([[1.0], [np.nan], [2.0], [4.0]])
    df = wide(spark, x, "adj_close").withColumn("r", features.pct_change(F.col("adj_close"))).withColumn("n", features.pct_change(F.col("adj_close"), fill="none"))
    assert same(back(df, "r").ravel(), [np.nan, 0, 1, 1]) and same(back(df, "n").ravel(), [np.nan, np.nan, np.nan, 1])


def test_cross_section(spark):
    rng = np.random.default_rng(3)
    x = gappy(rng, (30, 12))
    df = wide(spark, x, "x").withColumn("w", cross.winsorize(F.col("x"), 0.1))
    lo, hi = np.nanquantile(x, 0.1, axis=1, keepdims=True), np.nanquantile(x, 0.9, axis=1, keepdims=True)
    assert same(back(df, "w"), np.where(np.isnan(x), np.nan, np.clip(x, lo, hi)))
    off = x - np.nanmedian(x, axis=1, keepdims=True)
    assert same(back(cross.add_zscore(df, "x", "z"), "z"), off / (1.4826 * np.nanmedian(np.abs(off), axis=1, keepdims=True)))
    std = (x - np.nanmean(x, axis=1, keepdims=True)) / np.nanstd(x, axis=1, ddof=1, keepdims=True)
    assert same(back(cross.add_zscore(df, "x", "z", robust=False), "z"), std)
    assert same(back(df.withColumn("p", cross.pct_rank(F.round("x", 1))), "p"), pd.DataFrame(np.round(x, 1)).rank(axis=1, pct=True).to_numpy())
    both = wide(spark, np.array([[1.0, -1.0, 3.0]] * 3), "a", b=np.array([[-1.0, 1.0, -3.0]] * 3))
    assert np.abs(back(cross.combine(both, {"a": 1.0, "b": 1.0, "absent": 2.0}), "signal")).max() < 1e-12
    assert np.isnan(back(cross.add_zscore(wide(spark, np.full((2, 4), 5.0), "x"), "x", "z"), "z")).all()


@pytest.mark.parametrize("halflife", [1.0, 3.0])
def test_smoothing_on_sparse_series(spark, halflife):
    rng = np.random.default_rng(5)
    x = gappy(rng, (400, 3), 0.5)
    x[50:, 2] = np.nan  # left long ago: carries its last value
    x[5:250, 1] = np.nan
    got = back(cross.smooth(wide(spark, x), "signal", halflife), "signal")
    assert same(got, pd.DataFrame(x).ewm(halflife=halflife, adjust=False, ignore_na=True).mean().ffill().to_numpy())
    assert cross.smooth(wide(spark, x[:3]), "signal", 0).columns == wide(spark, x[:3]).columns


def test_neutralize_is_least_squares(spark):
    rng = np.random.default_rng(7)
    y, size = gappy(rng, (20, 24)), np.exp(rng.normal(15, 1, (20, 24)))
    y[4, 8:] = np.nan  # too few names
    size[6, 3] = 0.0
    df = wide(spark, y, "y", size=size)
    got = back(cross.neutralize(df, "y", "sector", "size", "r"), "r")
    dummy = np.array([k % 2 for k in range(24)], float)
    for t in range(20):
        ok = np.isfinite(y[t]) & (size[t] > 0)
        want = np.full(24, np.nan)
        if ok.sum() >= 10:
            x = np.column_stack([np.ones(ok.sum()), dummy[ok], np.log(size[t, ok])])
            want[ok] = y[t, ok] - x @ np.linalg.lstsq(x, y[t, ok], rcond=None)[0]
        assert same(got[t], want, 1e-8)
    assert np.abs(np.nanmean(back(df.withColumn("s", cross.sector_neutral(F.col("y"), F.col("sector"))), "s")[:, 1::2], axis=1)).max() < 1e-9


@pytest.mark.parametrize("n", [3, 5, 7, 10])
def test_buckets_are_quantile_cuts(spark, n):
    sizes = [1, 2, 3, 5, 8, 10, 19, 22, 31, 64, 91, 100, 171]
    x = np.full((len(sizes), max(sizes)), np.nan)
    rng = np.random.default_rng(n)
    for t, m in enumerate(sizes):
        x[t, :m] = np.round(rng.normal(size=m), 1)  # ties
    got = back(ranking.deciles(wide(spark, x), "signal", n), "bucket")
    for t, m in enumerate(sizes):
        want = np.full(max(sizes), np.nan)
        if m > 1:
            want[:m] = pd.qcut(pd.Series(x[t, :m]).rank(method="first"), n, labels=False)
        assert same(got[t], want), (n, m)


def test_sticky_state(spark):
    rng = np.random.default_rng(9)
    x = gappy(rng, (60, 20), 0.1)
    n, m = 10, 5
    got = back(ranking.sticky_weights(wide(spark, x), "signal", n, m), "weight")
    entry, exit_ = (back(ranking.deciles(wide(spark, x), "signal", k), "bucket") for k in (n, m))
    long, short = np.zeros(20, bool), np.zeros(20, bool)
    for t in range(60):
        long = (entry[t] == n - 1) | (long & (exit_[t] == m - 1))
        short = (entry[t] == 0) | (short & (exit_[t] == 0))
        w = np.where(long, 1 / max(1, long.sum()), 0) - np.where(short, 1 / max(1, short.sum()), 0)
        assert same(got[t], w)
    with pytest.raises(ValueError):
        ranking.sticky_weights(wide(spark, x), "signal", 5, 6)


def test_weights_and_accounting(spark):
    ladder = wide(spark, np.tile(np.arange(10.0), (5, 1)), "signal", fwd=np.tile(np.arange(10.0) / 100, (5, 1)))
    w = ranking.decile_weights(ladder, "signal", 10)
    assert same(back(w, "weight")[0], [-1, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    day = accounting.returns(w, 10.0).orderBy("date").toPandas()
    assert same(day["gross"], [0.09] * 5) and same(day["turnover"], [1, 0, 0, 0, 0]) and abs(day["net"][0] - (0.09 - 0.001)) < 1e-12
    s = back(ranking.signal_weights(ladder), "weight")
    assert np.abs(s.sum(axis=1)).max() < 1e-12 and same(np.abs(s).sum(axis=1), [2] * 5)
    assert ranking.per_decile(ladder, "signal", 20).where("ret is null").count() == 50
    with pytest.raises(ValueError):
        ranking.weigh(ladder, "other")


def test_costs(spark):
    x = np.array([[0, 0, 0], [0.5, -0.5, 0], [0.5, -0.5, 0], [0, -0.5, 0.5], [0, -0.5, 0.5]])
    w = wide(spark, x, "weight", dollar_vol_20d=np.full((5, 3), 1e7))
    costs = lambda df: df.orderBy("date").toPandas()["cost"].to_numpy()
    assert abs(costs(accounting.flat_cost(w, 10.0))[1] - 0.0005) < 1e-12
    small, large = costs(accounting.sqrt_cost(w, capital=1e6)), costs(accounting.sqrt_cost(w, capital=1e8))
    assert large[1] > small[1] > 0 and small[2] == 0
    both = costs(accounting.cost_model("composite", w, flat_bps=10.0, capital=1e6))
    assert same(both, costs(accounting.flat_cost(w, 10.0)) + small)
    free = w.withColumn("dollar_vol_20d", F.lit(None).cast("double"))
    assert (costs(accounting.sqrt_cost(free, capital=1e8)) == 0).all()
    with pytest.raises(ValueError):
        accounting.sqrt_cost(w, volume=None)
    with pytest.raises(ValueError):
        accounting.cost_model("odd", w)


def test_metrics(spark):
    rng = np.random.default_rng(11)
    r = rng.normal(0.001, 0.01, 60)
    day = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=k), float(v), 0.1) for k, v in enumerate(r)], "date date, net double, turnover double")
    got = accounting.summary(day).first()
    eq = np.cumprod(1 + r)
    assert abs(got["sharpe"] - r.mean() * 252 / (r.std() * np.sqrt(252))) < 1e-9 and abs(got["max_drawdown"] - (eq / np.maximum.accumulate(eq) - 1).min()) < 1e-12
    assert abs(got["skew"] - pd.Series(r).skew()) < 1e-9 and got["n_obs"] == 60 and abs(got["hit_rate"] - (r > 0).mean()) < 1e-12
    x, y = gappy(rng, (10, 15)), gappy(rng, (10, 15))
    x[0, 5:] = np.nan
    ic = accounting.information_coefficient(wide(spark, np.round(x, 1), "signal", fwd=y)).orderBy("date").toPandas()["ic"].to_numpy(dtype=float)
    for t in range(10):
        ok = np.isfinite(x[t]) & np.isfinite(y[t])
        want = pd.Series(np.round(x[t, ok], 1)).rank().corr(pd.Series(y[t, ok]).rank()) if ok.sum() >= 10 else np.nan
        assert same(ic[t], want)


def test_membership_walk(spark):
    changes = [(dt.date(2020, 6, 15), "AAA", None), (dt.date(2021, 3, 10), "BBB", "OLD1"), (dt.date(2022, 9, 1), "CCC", "OLD2")]
    current = ["AAA", "BBB", "CCC", "ALWAYS"]
    dates = src.business_days(spark, "2020-06-01", "2022-09-30")
    got = {(r.date, r.ticker): r.member for r in universe.membership(dates, spark.createDataFrame([(t,) for t in current], "ticker string"), spark.createDataFrame(changes, "effective_date date, added string, removed string")).collect()}
    for d in {k[0] for k in got}:
        members = set(current)
        for when, added, removed in sorted(changes, key=lambda c: c[0], reverse=True):
            if when > d:
                members.discard(added)
                members |= {removed} - {None}
        assert {t for (day, t), m in got.items() if day == d and m} == members
    assert got[(dt.date(2020, 6, 15), "AAA")] and not got[(dt.date(2020, 6, 12), "AAA")]
    assert all(d.weekday() < 5 for d, _ in got)


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("2020-01-02", "A", 1.0, 2.0, 0.5, float("nan"), 10)], "`Date` string, ticker string, Open double, High double, Low double, Close double, Volume long")
    one = src.normalise_bars(raw).first()
    assert one["date"] == dt.date(2020, 1, 2) and one["close"] is None and one["adj_close"] is None and one["volume"] == 10.0
    cleaned = spark.createDataFrame([(x,) for x in (" brk.b ", "nan", "None", "-", "", None)], "t string").select(src.clean_ticker(F.col("t")).alias("t"))
    assert [r.t for r in cleaned.collect()] == ["BRK-B", None, None, None, None, None]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in src.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()) == [1, 2]
    bars = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 5.0), ("B", dt.date(2020, 1, 3), 2.0, 6.0)], "ticker string, date date, close double, volume double").withColumn("sector", F.lit("S"))
    grid = src.dense(bars, fill=True).orderBy("ticker", "date").collect()
    assert [(r.ticker, r.t_idx, r.close, r.volume) for r in grid] == [("A", 0, 1.0, 5.0), ("A", 1, 1.0, 0.0), ("B", 0, None, 0.0), ("B", 1, 2.0, 6.0)]
    newer = bars.withColumn("close", F.lit(9.0)).where("ticker = 'A'")
    assert {r.ticker: r.close for r in src.keep_last(bars, newer).collect()} == {"A": 9.0, "B": 2.0}
    snaps = spark.createDataFrame([("2020-01-01", "A"), ("2021-01-01", "B")], "snapshot_date string, ticker string")
    assert [r.ticker for r in src.latest_snapshot(snaps).collect()] == ["B"]


def test_risk(spark):
    w = wide(spark, np.array([[0.3, -0.2, 0.5, -0.4]] * 3), "weight").withColumn("sector", F.when(F.col("ticker_ord") < 2, "X").otherwise("Y"))
    e = risk.sector_exposure(w).where("date = '2020-01-01'").collect()
    assert {r.sector: round(r.exposure, 9) for r in e} == {"X": 0.5, "Y": 0.9}
    metrics = risk.all_metrics(w)
    hard = risk.constraints(spark, [("g", "gross_exposure", "<=", 1.0), ("ok", "gross_exposure", "<=", 2.0), ("u", "max_drawdown", ">=", -0.5), ("b", "min_n_long", ">", 2.0)])
    assert {r.name for r in risk.violations(metrics, hard).collect()} == {"g", "b"}
    cov = construct.shrunk_covariance(wide(spark, np.random.default_rng(1).normal(size=(40, 3)), "ret"), shrinkage=1.0).collect()
    assert all((r.cov == 0) == (r.a != r.b) for r in cov)


def test_constructors(spark):
    rng = np.random.default_rng(42)
    df = wide(spark, rng.normal(size=(64, 10)), "signal", ret=rng.normal(0, 0.01, (64, 10)))
    mv = back(construct.mean_variance(df, lookback=30), "weight")
    assert np.isfinite(mv).all() and same(mv[21], mv[41]) and not same(mv[41], mv[42])
    rp = back(construct.risk_parity(df, lookback=40), "weight")
    assert (rp >= 0).all() and (rp[:42] == 0).all() and same(rp[42:].sum(axis=1), np.ones(22))
    c = back(construct.constrained(df, 0.1, 0.5, 1.0), "weight")
    assert np.abs(c).max() <= 0.1 + 1e-6 and np.abs(c).sum(axis=1).max() <= 1.0 + 1e-9


def test_policy():
    good = {"name": "p", "hard_constraints": [{"name": "n", "metric": "net_exposure", "op": "<=", "threshold": 0.1}], "cost_model": {"type": "flat", "flat_bps": 5}}
    p = policy.from_dict(good)
    assert policy.errors(p) == [] and policy.net_neutral(p) and "net_exposure" in policy.render(p)
    bad = policy.from_dict({"holdout": {"in_sample_end": "2030-01-01"}, "cost_model": {"type": "flat", "flat_bps": -1}, "hard_constraints": [{"name": "x", "metric": "beauty", "op": "=", "threshold": 1}], "governance": {"flag_inflated_sharpe_threshold": 0}})
    assert len(policy.errors(bad)) == 5
    with pytest.raises(TypeError):
        policy.from_dict({"universe": {"no_such": 1}})


REJECTED = [
    "import os\ndef f(p): return p['close']", "from os import path\ndef f(p): return p['close']", "def f(p): return open('x')", "def f(p): return eval('1')", "def f(p): exec('1')", "def f(p): return __import__('os')",
    "def f(p): return p.__class__", "def f(p): return getattr(p, 'x')", "def f(p):\n    global g\n    return p['close']", "def f(p): return p['close'].shift(-1)", "def f(p): return p['close'].shift(periods=-2)", "def f(p): return pd.read_parquet('x')", "def f(p): return p.to_csv('x')", "def f(p): return (",
]


@pytest.mark.parametrize("source", REJECTED)
def test_sandbox_rejects(source):
    with pytest.raises(sandbox.Rejected):
        sandbox.compile_feature(source)


def test_stores(spark):
    runs = spark.createDataFrame([(k, f"r{k}", s, {"a": 1.0}) for k, s in enumerate([0.1, 0.3, 0.2, 0.05, 0.25, float("nan"), None, 0.3])], "seq long, run_id string, sharpe double, feature_weights map<string,double>")
    assert [r.run_id for r in stores.top_runs(runs, 3).collect()] == ["r1", "r7", "r4"] and stores.best_run(runs).first().run_id == "r1"
    rows = [(k, "t", ["a"], 0.1, -0.1, a) for k, a in enumerate([0.05, 0.0, 0.3])]
    done = stores.resolved(stores.recorded(spark.createDataFrame(rows, "seq long, type string, key array<string>, low double, high double, actual double")))
    one = stores.ledger_summary(done).first()
    assert one.hit_rate == 0.667 and one.mean_miss == 0.117 and one.n_hits == 2
    cases = spark.createDataFrame([(100, 1.0, 20, 0.1), (300, 0.1, 20, 0.1), (300, 0.2, 20, 0.8), (300, 0.2, 20, 0.1)], "n_obs long, delta double, n_tests long, avg_turnover double")
    assert [r.decision for r in stores.promotion(cases).collect()] == ["INSUFFICIENT", "NO_IMPROVEMENT", "IPS_VIOLATION", "PROMOTED"]
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx")], "pair long, old string, new string")
    assert [r.change for r in stores.line_diff(pairs).orderBy("pos").collect()] == ["same", "changed", "removed"]


def test_cycle(tmp_path):
    p = policy.Policy()
    assert cycle.run_cycle(p)["verdict"] == "DRY_RUN"
    assert cycle.run_cycle(p, lambda a, m: "approved" if a == "critic" else "ok")["verdict"] == "APPROVED"
    assert cycle.run_cycle(p, lambda a, m: 1 / 0)["verdict"] == "ERROR"
    v = cycle.Versions(str(tmp_path))
    first = v.propose("alpha", "x" * 200, "y" * 30)
    second = v.propose("alpha", "x" * 199 + "\nz", "y" * 30)
    assert (first.version, second.version, second.parent_version) == (1, 2, 1) and v.diff("alpha", 1, 2)
    assert cycle.run_meta_cycle(p, v, lambda x: ({"sharpe": 0.0}, {"n_obs": 300, "sharpe": 0.1 * x.version})) == {"alpha v1": "NO_IMPROVEMENT", "alpha v2": "PROMOTED"}
    assert v.latest_promoted("alpha").version == 2 and v.rollback(second).rolled_back and v.latest_promoted("alpha") is None
    with pytest.raises(ValueError):
        v.propose("alpha", "short", "short")
    assert json.loads(open(cycle.save_cycle({"a": 1}, str(tmp_path / "c"))).read()) == {"a": 1}


def test_session_and_run(spark, panel, tmp_path):
    config = backtest.Config(min_dollar_vol=None, n_deciles=4, exit_n_deciles=2, lags=features.Lags(2, 5, 5, 5, 5))
    s = session.Session(panel.where("t_idx < 60"), str(tmp_path), config)
    assert s.propose_feature("def rng(p):\n    return (p['high'] - p['low']) / p['close']\n") == "OK: rng"
    assert s.propose_feature("import os").startswith("REJECTED") and s.analyze_last_run().startswith("ERROR")
    assert s.record_prediction([{"type": "turnover", "key": "x", "low": 5, "high": 0}, {"type": "bad"}]).startswith("ERROR")
    out = json.loads(s.run_backtest_tool({"reversal_5d": 1.0, "rng": 0.5}, 2.0))
    assert out["n_obs"] == 60 and json.loads(s.calibration_report())["by_type"]["turnover"]["hit_rate"] == 1.0
    assert s.run_backtest_tool({"unknown": 1.0}).startswith("ERROR") and len(json.loads(s.list_journal_runs())) == 1
    assert "rng" in session.Session(panel.where("t_idx < 60"), str(tmp_path), config).registry
    one = s.last[1]
    where = layout.save_run(layout.Layout(str(tmp_path)), "r", one, s.last[2])
    assert spark.read.parquet(f"{where}/returns").count() == 60


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k // 40, (k * 7) % 24, k % 60), k % 3, float(k % 11)) for k in range(160)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    events.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = stream.write_once(stream.tumbling_bars(source), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    got = {(r.date, r.ticker): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.date, r.ticker): (r.open, r.high, r.low, r.close, r.volume) for r in stream.tumbling_bars(events).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 3


@pytest.mark.parametrize(("n", "exit_n"), [(3, None), (2, None), (5, 1), (1, 1)])
def test_sticky_without_an_exit_band(spark, n, exit_n):
    """Against the state machine date by date: enter, hold while known, the entry wins where both sides would hold."""
    rng = np.random.default_rng(31)
    x = gappy(rng, (40, 9))
    got = back(ranking.sticky_weights(wide(spark, x, "signal"), "signal", n, exit_n), "weight")
    buckets = lambda k: back(ranking.deciles(wide(spark, x, "signal"), "signal", k, "b"), "b")
    entry, hold = buckets(n), buckets(exit_n or max(1, n // 2))
    top = (exit_n or max(1, n // 2)) - 1
    long, short = np.zeros(9, bool), np.zeros(9, bool)
    for t in range(40):
        up, down = entry[t] == n - 1, entry[t] == 0
        new_long, new_short = up | (long & (hold[t] == top)), down | (short & (hold[t] == 0))
        both = new_long & new_short
        long, short = new_long & (~both | up), new_short & (~both | down)
        want = np.where(long, 1 / max(1, long.sum()), 0) - np.where(short, 1 / max(1, short.sum()), 0)
        assert same(got[t], want)


def test_constructors_against_plain_numpy(spark):
    rng = np.random.default_rng(43)
    signal, ret = rng.normal(size=(66, 8)), rng.normal(0, 0.01, (66, 8))
    signal[30:, 3], ret[5, 2] = np.nan, np.nan
    df = wide(spark, signal, "signal", ret=ret)
    mv, rp = back(construct.mean_variance(df, lookback=30), "weight"), back(construct.risk_parity(df, lookback=40), "weight")
    hold_mv, hold_rp = np.zeros(8), np.zeros(8)
    for t in range(66):
        if t % 21 == 0:
            have = np.isfinite(signal[t])
            past = pd.DataFrame(ret[max(0, t - 29) : t + 1][:, have])
            cov = past.cov().fillna(0).to_numpy() * 0.5 + np.diag(np.diag(past.cov().fillna(0).to_numpy())) * 0.5
            w = np.linalg.pinv(cov + 1e-8 * np.eye(have.sum())) @ signal[t, have]
            hold_mv = np.zeros(8)
            hold_mv[have] = w * 0.1 / np.sqrt(max(w @ cov @ w, 1e-12) * 252)
            window = ret[max(0, t - 39) : t + 1]
            full = np.isfinite(window).all(axis=0)
            if len(window) >= 30 and full.sum() >= 5:
                cov, w = np.cov(window[:, full].T), np.full(full.sum(), 1 / full.sum())
                for _ in range(200):
                    part = w * (cov @ w)
                    new = np.maximum(w - 0.1 * (part - part.mean()) / (cov @ w + 1e-12), 1e-6)
                    new /= new.sum()
                    w, moved = new, np.abs(new - w).max()
                    if moved < 1e-6:
                        break
                hold_rp = np.zeros(8)
                hold_rp[full] = w
        assert np.allclose(mv[t], hold_mv, atol=1e-9) and np.allclose(rp[t], hold_rp, atol=1e-9)


def test_risk_metrics_in_one_pass(spark):
    rng = np.random.default_rng(44)
    w = wide(spark, rng.normal(size=(30, 6)) * 0.1, "weight", fwd=rng.normal(0, 0.01, (30, 6))).withColumn("sector", F.when(F.col("ticker_ord") < 2, "X"))
    daily = accounting.returns(w, 5.0)
    got = {r.metric: r.value for r in risk.all_metrics(w, cost_bps=5.0).collect()}
    e = risk.exposures(w).agg(F.max("gross"), F.max("net"), F.max("max_name"), F.min("n_long"), F.min("n_short")).first()
    want = dict(zip(("gross_exposure", "net_exposure", "max_single_name_weight", "min_n_long", "min_n_short"), e, strict=True))
    want |= {"max_sector_weight": risk.sector_exposure(w).agg(F.max("exposure")).first()[0], "avg_turnover": risk.average_turnover(w).first()[0]}
    want["max_drawdown"] = accounting.equity(daily, "net", missing_as_zero=True).agg(F.min("drawdown")).first()[0]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.metric: r.value for r in risk.all_metrics(w, daily).collect()} == pytest.approx(want)
    out = risk.report(risk.all_metrics(w), risk.constraints(spark, [("g", "gross_exposure", "<=", 0.0)]), spark.createDataFrame([("s", "net_exposure", 0.0, 2.0)], "name string, metric string, target double, weight double"))
    assert not out["passes_policy"] and out["hard_violations"][0]["name"] == "g" and out["soft_scores"]["s"] == pytest.approx(2 * want["net_exposure"])


LOOKING_AHEAD = ["def f(p): return p['close'].shift(**{'periods': -1})", "def f(p):\n    g = p['close'].shift\n    return g(-1)", "def f(p): return p['close'].rolling(5, center=True).mean()", "def f(p): return p['close'] / p['close'].iloc[-1]"]


@pytest.mark.parametrize("source", LOOKING_AHEAD)
def test_sandbox_notices_looking_ahead(spark, panel, source):
    with pytest.raises(Exception, match="looks ahead|not allowed|literal number"):
        sandbox.apply(panel.where("t_idx < 40"), source).count()


def test_policy_tolerates_what_it_does_not_know(tmp_path):
    assert policy.from_dict(None) == policy.Policy() and policy.from_dict({"notes": 1, "name": "p", "universe": None}).name == "p"
    (tmp_path / "p.yaml").write_text("")
    assert policy.load(str(tmp_path / "p.yaml")) == policy.Policy()


def test_journal_and_ledger(tmp_path):
    j = session.Journal(str(tmp_path / "j"))
    assert not j.exists() and j.best() is None and j.total_runs() == 0 and "No runs yet" in j.recap()
    for k, v in enumerate([0.1, 0.3, None, float("nan"), 0.3]):
        j.record({"feature_weights": {"a": 1.0}}, {"sharpe": v, "ic_ir": 0.5})
    with j.path.open("a") as f:
        f.write("broken\n\n")
    assert j.total_runs() == 6 and j.best()["run_id"] == j.rows()[1]["run_id"] and [r["summary"]["sharpe"] for r in j.top(3)] == [0.3, 0.3, 0.1]
    assert j.save_feature("a", "def a(p): return p['close']", "closing price") == 1 and j.save_feature("a", "def a(p): return p['open']") == 2
    j.note_sharpe({"a"}, 0.2)
    j.note_sharpe({"a"}, 0.1)
    (meta,) = j.feature_metadata()
    assert meta["description"] == "closing price" and meta["best_sharpe"] == 0.2 and "source" not in meta
    (j.root / "features" / "bad.json").write_text("{")
    (j.root / "features" / "worse.json").write_text('{"name": "w", "source": "import os"}')
    assert list(j.features()) == ["a"] and len(j.warnings) == 2
    text = j.recap()
    assert "closing price" in text and "Top 3 runs" in text and "Runs on record: 6" in text
    j.clear()
    assert not j.exists()
    ledger = session.Ledger(str(tmp_path / "l"))
    ledger.add("turnover", "x", 1.0, 0.0)
    with ledger.path.open("a") as f:
        f.write("broken\n[1]\n")
    assert len(session.Ledger(str(tmp_path / "l")).items) == 1


def bars_of(panel):
    return panel.select("date", "ticker", "sector", *src.FIELDS)


def test_windows_tools_and_candidates(spark, panel, tmp_path):
    first, middle, last = (str(r[0]) for r in panel.where("t_idx in (0, 40, 79)").select("date").distinct().orderBy("date").collect())
    before_middle = str(panel.where("t_idx = 39").first()["date"])
    p = policy.from_dict({"holdout": {"in_sample_start": first, "in_sample_end": before_middle, "holdout_start": middle, "holdout_end": last}, "universe": {"min_dollar_vol_usd": 0}, "cost_model": {"type": "flat", "flat_bps": 7}, "hard_constraints": [{"name": "d", "metric": "max_drawdown", "op": ">=", "threshold": 0.5}], "soft_constraints": [{"name": "t", "metric": "avg_turnover", "target": 0.1}]})
    config = backtest.Config(min_dollar_vol=None, n_deciles=4, exit_n_deciles=2, lags=features.Lags(2, 5, 5, 5, 5))
    seen, hidden = session.Session.in_sample(bars_of(panel), str(tmp_path / "a"), p, config=config), session.Session.holdout(bars_of(panel), str(tmp_path / "b"), p, config=config)
    assert seen.panel.agg(F.max("date")).first()[0] < hidden.panel.agg(F.min("date")).first()[0]
    assert seen.panel.select("t_idx").distinct().count() == hidden.panel.select("t_idx").distinct().count() == 40
    assert hidden.panel.where("t_idx < 5").agg(F.count("mom_12_1")).first()[0] == 0  # looks back inside the window only
    assert session.from_policy(p).cost_bps == 7 and seen.headline() == {}
    assert "error" in json.loads(seen.evaluate_candidate())
    columns = set(seen.panel.columns)
    json.loads(seen.run_backtest_tool({"reversal_5d": 1.0}, 2.0))
    assert set(seen.panel.columns) == columns and set(seen.headline()) == {"sharpe", "gross_sharpe", "ic_ir", "avg_turnover", "max_drawdown"}
    out = json.loads(seen.evaluate_candidate())
    assert out["weights_source"].startswith("fallback") and out["verdict"] == "REJECTED" and out["hard_violations"][0]["metric"] == "max_drawdown" and "t" in out["soft_scores"]
    seen.construct_signal_weighted()
    assert "signal_weighted" in json.loads(seen.evaluate_candidate())["weights_source"]
    assert json.loads(seen.calibration_check())["n_resolved"] == json.loads(seen.calibration_summary())["n_resolved"] == 0
    assert "error" in json.loads(seen.propose_prompt_rewrite("alpha", "short", "short")) and "error" in json.loads(seen.propose_prompt_rewrite("nobody", "x" * 300, "y" * 40))
    assert json.loads(seen.propose_prompt_rewrite("alpha", "x" * 300, "y" * 40))["version"] == 1
    assert json.loads(seen.list_prompt_versions("alpha"))[0]["promoted"] is False
    assert "Runs on record: 1" in seen.state_recap() and seen.message("find").endswith("find")


def test_run_from_files(spark, panel, tmp_path):
    from panelyard.sources import files

    lay = layout.Layout(str(tmp_path))
    raw = spark.createDataFrame([("A.B", "Name", "S1"), (None, "x", "S1"), ("-", "y", "S2")], "Symbol string, Security string, `GICS Sector` string")
    assert [(r.ticker, r.name, r.sector) for r in files.constituents(raw).collect()] == [("A-B", "Name", "S1")]
    names = panel.select("ticker", F.lit("n").alias("name"), "sector").distinct()
    files.save_universe(lay, names.withColumn("sector", F.lit("old")), "2020-01-01")
    files.save_universe(lay, names, "2021-01-01")
    bars = bars_of(panel).drop("sector")
    layout.write_table(bars.where("t_idx < 30") if "t_idx" in bars.columns else bars.where(F.col("date") < panel.where("t_idx = 30").first()["date"]), lay.bars())
    files.save_changes(lay, spark.createDataFrame([("2019-01-01", "T0", None)], "date string, added string, removed string"))
    asked = []

    class Source:
        def fetch(self, spark, tickers, start, end):
            asked.append((len(tickers), start))
            return bars.where(F.col("ticker").isin(tickers) & (F.col("date") >= F.lit(start).cast("date")))

    dates = [str(r[0]) for r in panel.select("date").distinct().orderBy("date").collect()]
    (tmp_path / "c.yaml").write_text(f"start: {dates[0]}\nend: {dates[-1]}\nfeatures: {{reversal_5d: 1.0}}\nliquidity: {{min_dollar_vol_usd: 0}}\nmembership: {{point_in_time: true}}\nneutralize: {{sector: true, size: false}}\nbacktest: {{weighting: decile, n_deciles: 4, cost_bps: 5.0}}\n")
    result, summary, folder = backtest.run_from_files(spark, str(tmp_path / "c.yaml"), lay, source=Source())
    assert asked and asked[0][1] > dates[0] and spark.read.parquet(lay.bars()).count() == bars.count()
    assert json.loads(open(f"{folder}/summary.json").read())["n_obs"] == summary["n_obs"] == len(dates) and summary["avg_members"] > 0
    assert {r.sector for r in result.signal.select("sector").distinct().collect()} == {r.sector for r in names.select("sector").distinct().collect()}
    cells = spark.createDataFrame([(0.0, "off", 0.1), (0.0, "5", 0.2)], "halflife double, exit string, sharpe double")
    assert spark.read.parquet(layout.save_grid(lay, "g", cells) + "/grid").count() == 2 and len(json.loads(open(f"{lay.output('g')}/grid.json").read())) == 2
    files.save_membership(lay, files.load_membership(spark, lay, panel.select("date")))
    assert files.cached_membership(spark, lay).count() > 0 and files.cached_membership(spark, layout.Layout(str(tmp_path / "none"))) is None
    one = layout.save_research(str(tmp_path / "run"), "goal", "report", [{"tool": "a"}, {"text": "x"}, {"tool": "b"}], "n" * 7000)
    assert layout.load_research(one)["tools"] == ["a", "b"] and cycle.review_prompt([layout.load_research(one)]).count("n" * 6000) == 1


def test_orchestrate(tmp_path):
    (tmp_path / "p.yaml").write_text("name: p\n")
    assert cycle.orchestrate(str(tmp_path / "p.yaml"), str(tmp_path / "o"))["verdict"] == "DRY_RUN"
    versions, calls = cycle.Versions(str(tmp_path / "v")), []
    versions.propose("alpha", "x" * 200, "y" * 30)

    class Seen:
        def headline(self):
            return {"sharpe": 1.0}

    out = cycle.orchestrate(str(tmp_path / "p.yaml"), str(tmp_path / "o"), lambda p: Seen(), lambda p: "hidden", lambda a, m: "approved", versions, lambda v, s, h: calls.append(h) or ({"sharpe": 0.0}, {"n_obs": 300, "sharpe": 9.0}))
    assert out["alpha_metrics"] == {"sharpe": 1.0} and out["promotions"] == {"alpha v1": "PROMOTED"} and calls == ["hidden"]
    (tmp_path / "bad.yaml").write_text("cost_model: {type: odd}\n")
    with pytest.raises(ValueError):
        cycle.orchestrate(str(tmp_path / "bad.yaml"), str(tmp_path / "o"))
