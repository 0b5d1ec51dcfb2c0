"""The same queries in SQL, built from named steps; run by another engine over the same tables."""

from __future__ import annotations


def _bars(by: str) -> str:
    return f"""bars AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {by} AS ticker, 'R' || n_regionkey AS sector,
  round(avg(l_extendedprice / l_quantity), 6) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  round(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE / sum(l_quantity), 6) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


GRID = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t_idx FROM (SELECT DISTINCT date FROM bars)),
tick AS (SELECT ticker, max(sector) AS sector, row_number() OVER (ORDER BY ticker) - 1 AS ticker_ord FROM bars GROUP BY ticker),
raw AS (SELECT c.date, c.t_idx, t.ticker, t.sector, t.ticker_ord, b.open, b.high, b.low, b.close, b.volume FROM cal c CROSS JOIN tick t LEFT JOIN bars b ON b.date = c.date AND b.ticker = t.ticker)"""
FILL = """panel AS (SELECT date, t_idx, ticker, sector, ticker_ord, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
  last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume
  FROM raw WINDOW w AS (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
FEATURES = """changed AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY t_idx), 0) - 1 AS ret FROM panel),
feat AS (SELECT *, lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1 AS mom_12_1, -(close / nullif(lag(close, 5) OVER w, 0) - 1) AS reversal_5d,
  CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 END AS vol_21d,
  CASE WHEN volume <> 0 AND count(nullif(volume, 0)) OVER w20 = 20 THEN ln(volume / avg(nullif(volume, 0)) OVER w20) END AS volume_shock,
  CASE WHEN count(close * volume) OVER w20 = 20 THEN avg(close * volume) OVER w20 END AS dollar_vol_20d,
  CASE WHEN count(abs(ret) / nullif(close * volume, 0)) OVER w20 = 20 THEN avg(abs(ret) / nullif(close * volume, 0)) OVER w20 END AS amihud_20d,
  CASE WHEN count((high - low) / nullif(close, 0)) OVER w10 = 10 THEN -avg((high - low) / nullif(close, 0)) OVER w10 END AS range_feature,
  CASE WHEN count(close) OVER w252 = 252 THEN close / nullif(max(close) OVER w252, 0) - 1 END AS pct_off_52w_high, lead(ret) OVER w AS fwd,
  CASE WHEN count(night) OVER w20 = 20 THEN avg(night) OVER w20 END AS overnight_drift_20d, CASE WHEN count(sign(ret) * volume) OVER w20 = 20 THEN sum(sign(ret) * volume) OVER w20 END AS signed_vol_20d,
  CASE WHEN count(ret) OVER w252 = 252 THEN -stddev_samp(ret) OVER w252 END AS low_vol_252d, CASE WHEN count(ret) OVER w60 >= 40 THEN -sqrt(greatest(var_samp(ret) OVER w60 * (1 - CASE WHEN stddev_pop(ret) OVER w60 > 0 AND stddev_pop(mkt) OVER w60 > 0 THEN pow(corr(ret, mkt) OVER w60, 2) ELSE 0 END), 0)) END AS idio_vol_60d
  FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN avg(ret) OVER (PARTITION BY date) END AS mkt, open / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY t_idx), 0) - 1 AS night FROM changed) WINDOW w AS (PARTITION BY ticker ORDER BY t_idx), w10 AS (PARTITION BY ticker ORDER BY t_idx ROWS 9 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY t_idx ROWS 19 PRECEDING),
  w21 AS (PARTITION BY ticker ORDER BY t_idx ROWS 20 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY t_idx ROWS 59 PRECEDING), w252 AS (PARTITION BY ticker ORDER BY t_idx ROWS 251 PRECEDING))"""


def _z(names: dict[str, float]) -> str:
    """Steps from feat to comb(signal)."""
    clip = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, quantile_cont({n}, 0.01) OVER d), quantile_cont({n}, 0.99) OVER d) END AS c_{n}" for n in names)
    off = ", ".join(f"c_{n} - median(c_{n}) OVER d AS o_{n}" for n in names)
    z = ", ".join(f"o_{n} / nullif(1.4826 * median(abs(o_{n})) OVER d, 0) AS z_{n}" for n in names)
    total = " + ".join(f"coalesce(z_{n} * ({w}), 0)" for n, w in names.items())
    return f"""clipped AS (SELECT *, {clip} FROM feat WINDOW d AS (PARTITION BY date)), centred AS (SELECT *, {off} FROM clipped WINDOW d AS (PARTITION BY date)),
scored AS (SELECT *, {z} FROM centred WINDOW d AS (PARTITION BY date)),
comb AS (SELECT *, CASE WHEN coalesce({", ".join("z_" + n for n in names)}) IS NOT NULL THEN ({total}) / {sum(abs(w) for w in names.values())} END AS signal FROM scored)"""


COMBINE = _z({"reversal_5d": 1.0, "vol_21d": -0.5, "volume_shock": 0.5})
LIQUID = "sig AS (SELECT * EXCLUDE (signal), CASE WHEN dollar_vol_20d >= 150000 THEN round(signal, 9) END AS signal FROM comb)"


def _deciles(source: str, column: str, n: int, target: str, out: str) -> str:
    return f"""{out} AS (SELECT * EXCLUDE (_r, _n), CASE WHEN {column} IS NOT NULL AND _n > 1 THEN (greatest(ceil((_r - 1) * {n}::DOUBLE / (_n - 1)), 1) - 1)::INTEGER END AS {target}
FROM (SELECT *, row_number() OVER (PARTITION BY date, {column} IS NULL ORDER BY {column}, ticker_ord) AS _r, count({column}) OVER (PARTITION BY date) AS _n FROM {source}))"""


def _equal(source: str, long: str, short: str, out: str = "wts") -> str:
    return f"""{out} AS (SELECT *, CASE WHEN _l THEN 1.0::DOUBLE / sum(_l::INT) OVER (PARTITION BY date) WHEN _s THEN -1.0::DOUBLE / sum(_s::INT) OVER (PARTITION BY date) ELSE 0.0 END::DOUBLE AS weight
FROM (SELECT *, coalesce({long}, false) AS _l, coalesce({short}, false) AS _s FROM {source}))"""


def _sticky(source: str, column: str) -> str:
    since = lambda c: f"coalesce(last_value(CASE WHEN {c} THEN t_idx END IGNORE NULLS) OVER w, -1)"
    up, stay_up, down, stay_down = "coalesce(e5 = 4, false)", "coalesce(h2 = 1, false)", "coalesce(e5 = 0, false)", "coalesce(h2 = 0, false)"
    return f"""{_deciles(source, column, 5, "e5", "d5")}, {_deciles("d5", column, 2, "h2", "d2")},
held AS (SELECT *, {since(up)} > {since(f"NOT {up} AND NOT {stay_up}")} AS is_long, {since(down)} > {since(f"NOT {down} AND NOT {stay_down}")} AS is_short
  FROM d2 WINDOW w AS (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), {_equal("held", "is_long", "is_short")}"""


SIG = ", ".join([_bars("n_name"), GRID, FILL, FEATURES, COMBINE, LIQUID])
PANEL, FEAT = ", ".join([_bars("n_name"), GRID, FILL]), ", ".join([_bars("n_name"), GRID, FILL, FEATURES])
WTS = ", ".join([SIG, _deciles("sig", "signal", 5, "bucket", "dec"), _equal("dec", "bucket = 4", "bucket = 0")])
MOVED = "moved AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY t_idx), 0) AS prior FROM wts)"
DAILY = f"""{MOVED}, daily AS (SELECT date, coalesce(sum(weight * fwd), 0) AS gross, sum(abs(weight - prior)) / 2 AS turnover, sum(abs(weight - prior)) / 2 * 5.0 / 1e4 AS cost,
  coalesce(sum(weight * fwd), 0) - sum(abs(weight - prior)) / 2 * 5.0 / 1e4 AS net FROM moved GROUP BY date)"""
EQUITY = """eq0 AS (SELECT date, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM daily),
eq AS (SELECT date, equity, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq0)"""
PERDEC = """pd AS (SELECT c.date, k.decile, g.ret FROM cal c CROSS JOIN (SELECT unnest(range(5))::INTEGER AS decile) k
  LEFT JOIN (SELECT date, bucket AS decile, sum(coalesce(fwd, 0)) / count(*) AS ret FROM dec WHERE bucket IS NOT NULL GROUP BY 1, 2) g ON g.date = c.date AND g.decile = k.decile)"""


def _ic(source: str) -> str:
    return f"""pairs AS (SELECT date, CASE WHEN signal IS NOT NULL AND fwd IS NOT NULL THEN signal END AS x, CASE WHEN signal IS NOT NULL AND fwd IS NOT NULL THEN round(fwd, 9) END AS y FROM {source}),
ranks AS (SELECT date, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE END AS rx,
  CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY date, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0::DOUBLE END AS ry FROM pairs),
ics AS (SELECT date, CASE WHEN count(rx) >= 10 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM ranks GROUP BY date)"""


CHANGES = """current AS (SELECT ticker FROM tick WHERE ticker_ord % 5 <> 0),
changes AS (SELECT DATE '1996-01-01' + CAST(97 * a.ticker_ord AS INTEGER) AS effective_date, a.ticker AS added, b.ticker AS removed FROM tick a LEFT JOIN tick b ON b.ticker_ord = a.ticker_ord + 7 WHERE a.ticker_ord < 10)"""
# Walks back from today for every date and ticker: the first change after the date decides.
MEMBERS = f"""{CHANGES}, ev AS (SELECT effective_date, added AS ticker, false AS before FROM changes WHERE added IS NOT NULL UNION ALL SELECT effective_date, removed, true FROM changes WHERE removed IS NOT NULL),
names AS (SELECT ticker FROM current UNION SELECT ticker FROM ev),
members AS (SELECT c.date, n.ticker, coalesce((SELECT arg_min(e.before, e.effective_date) FROM ev e WHERE e.ticker = n.ticker AND e.effective_date > c.date), n.ticker IN (SELECT ticker FROM current)) AS member FROM cal c CROSS JOIN names n)"""


def _neutral(source: str, column: str, sector: str | None, out: str) -> str:
    group = f"date, {sector}" if sector else "date"
    return f"""n1 AS (SELECT *, CASE WHEN {column} IS NOT NULL AND dollar_vol_20d > 0 THEN {column} END AS _y, CASE WHEN {column} IS NOT NULL AND dollar_vol_20d > 0 THEN ln(dollar_vol_20d) END AS _x FROM {source}),
n2 AS (SELECT *, _y - avg(_y) OVER g AS _yd, _x - avg(_x) OVER g AS _xd FROM n1 WINDOW g AS (PARTITION BY {group})),
n3 AS (SELECT *, CASE WHEN sum(_xd * _xd) OVER d > 1e-12 * sum(_x * _x) OVER d THEN sum(_xd * _yd) OVER d / sum(_xd * _xd) OVER d ELSE 0 END AS _b, count(_y) OVER d AS _k FROM n2 WINDOW d AS (PARTITION BY date)),
{out} AS (SELECT *, CASE WHEN _k >= 10 THEN _yd - _b * _xd END AS resid FROM n3)"""


def _ewma(source: str, halflife: float, out: str) -> str:
    a = f"(1 - exp(-ln(2) / {halflife}))"
    return f"""{out} AS (SELECT * EXCLUDE (signal, _l), CASE WHEN len(_l) > 0 THEN list_reduce(_l, lambda y, x: y * (1 - {a}) + x * {a}) END AS signal FROM
(SELECT *, list(signal) FILTER (WHERE signal IS NOT NULL) OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _l FROM {source}))"""


def _r(expr: str, digits: int = 8, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name or expr}"


SHARPE = "avg({0}) * 252 / nullif(stddev_pop({0}) * sqrt(252), 0)"
SUMMARY = f"""SELECT {_r("avg(net) * 252", 8, "ann_return")}, {_r("stddev_pop(net) * sqrt(252)", 8, "ann_vol")}, {_r(SHARPE.format("net"), 6, "sharpe")}, {_r("avg((net > 0)::INT::DOUBLE)", 8, "hit_rate")},
{_r("skewness(net)", 6, "skew")}, count(net) AS n_obs, {_r("avg(turnover)", 8, "avg_turnover")}, {_r("(SELECT min(drawdown) FROM eq)", 8, "max_drawdown")}"""
ICS = f"""{_r("avg(ic)", 8, "ic_mean")}, {_r("avg(ic) * sqrt(252) / nullif(stddev_pop(ic), 0)", 6, "ic_ir")}, count(ic) AS ic_n"""
GROSS = f"""{_r(SHARPE.format("gross"), 6, "gross_sharpe")}, {_r("avg(gross) * 252", 8, "gross_ann_return")}, {_r("avg(gross) * 252 - avg(net) * 252", 8, "cost_drag")}"""
SECTORS = "sx AS (SELECT date, coalesce(sector, 'UNKNOWN') AS sector, sum(abs(weight)) AS exposure FROM wts GROUP BY 1, 2)"
TURN = "tn AS (SELECT date, coalesce(sum(m), 0) / 2 AS t FROM (SELECT date, abs(weight - lag(weight) OVER (PARTITION BY ticker ORDER BY t_idx)) AS m FROM wts) GROUP BY date)"
EXPO = "ex AS (SELECT date, sum(abs(weight)) AS gross, abs(sum(weight)) AS net, max(abs(weight)) AS max_name, sum((weight > 0)::INT)::BIGINT AS n_long, sum((weight < 0)::INT)::BIGINT AS n_short FROM wts GROUP BY date)"
METRICS = f"""{DAILY}, {EQUITY}, {SECTORS}, {TURN}, {EXPO}, metrics AS (SELECT metric, round(value, 7) + 0.0::DOUBLE AS value FROM (
SELECT 'gross_exposure' AS metric, max(gross)::DOUBLE AS value FROM ex UNION ALL SELECT 'net_exposure', max(net) FROM ex UNION ALL SELECT 'max_single_name_weight', max(max_name) FROM ex
UNION ALL SELECT 'min_n_long', min(n_long)::DOUBLE FROM ex UNION ALL SELECT 'min_n_short', min(n_short)::DOUBLE FROM ex UNION ALL SELECT 'max_sector_weight', max(exposure) FROM sx
UNION ALL SELECT 'avg_turnover', avg(t) FROM tn UNION ALL SELECT 'max_drawdown', min(drawdown) FROM eq))"""
HARD = "hard AS (SELECT * FROM (VALUES ('gross', 'gross_exposure', '<=', 1.5::DOUBLE), ('net', 'net_exposure', '<=', 0.1), ('turnover', 'avg_turnover', '<', 0.1), ('drawdown', 'max_drawdown', '>=', -0.5), ('breadth', 'min_n_long', '>', 2.0), ('unmeasured', 'ic_ir', '>=', 1.0)) t(name, metric, op, threshold))"
BROKEN = "broken AS (SELECT name, metric, op, threshold, value FROM metrics JOIN hard USING (metric) WHERE NOT CASE op WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold ELSE value > threshold END)"
RUNS = "runs AS (SELECT event_id AS seq, 'run-' || event_id AS run_id, value / 100 AS sharpe, event_type AS feature FROM events)"
LEDGER = """led AS (SELECT event_id AS seq, event_type AS type, least(value * 0.8, value * 1.2) AS low, greatest(value * 0.8, value * 1.2) AS high, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS actual FROM events),
done AS (SELECT seq, type, actual BETWEEN low AND high AS in_range, actual - (low + high) / 2 AS miss FROM led WHERE actual IS NOT NULL)"""
CORR = ", ".join(f"round(corr({a}, {b}), 3) AS \"{a}|{b}\"" for a in ("reversal_5d", "vol_21d", "volume_shock") for b in ("reversal_5d", "vol_21d", "volume_shock"))
CORRS = f"""corrs AS (SELECT split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, corr + 0.0::DOUBLE AS corr FROM (UNPIVOT (SELECT {CORR} FROM feat WHERE reversal_5d IS NOT NULL AND vol_21d IS NOT NULL AND volume_shock IS NOT NULL) ON * INTO NAME pair VALUE corr))"""
RAWFEAT = """pad AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM raw),
pr AS (SELECT *, px / nullif(lag(px) OVER w, 0) - 1 AS ret FROM pad WINDOW w AS (PARTITION BY ticker ORDER BY t_idx)),
pf AS (SELECT *, -(px / nullif(lag(px, 5) OVER w, 0) - 1) AS reversal_5d, CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 END AS vol_21d,
  lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1 AS mom_12_1, lead(ret) OVER w AS fwd
  FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY t_idx), w21 AS (PARTITION BY ticker ORDER BY t_idx ROWS 20 PRECEDING))"""
FULL = ", ".join([PANEL, FEATURES, COMBINE, "liq AS (SELECT * EXCLUDE (signal), CASE WHEN dollar_vol_20d >= 150000 THEN signal END AS signal FROM comb)", MEMBERS,
                  "mem AS (SELECT l.* EXCLUDE (signal), CASE WHEN coalesce(m.member, false) THEN l.signal END AS signal FROM liq l LEFT JOIN members m ON m.date = l.date AND m.ticker = l.ticker)",
                  _ewma("mem", 3.0, "smo"), _neutral("smo", "signal", "sector", "neu"), "sig AS (SELECT * EXCLUDE (signal, fwd), round(resid, 7) AS signal, round(fwd, 9) AS fwd FROM neu)"])


def _edges(n: int) -> str:
    """How many interpolated edges lie below rank _r of _n, in doubles."""
    out = []
    for k in range(n + 1):
        p = f"((_n - 1) * {1.0 if k == n else (k * (1.0 / n)) * 100 / 100!r}::DOUBLE)"
        a, b, t = f"(1 + floor({p}))", f"(1 + least(floor({p}) + 1, _n - 1))", f"({p} - floor({p}))"
        out.append(f"(CASE WHEN {t} < 0.5 THEN {a} + ({b} - {a}) * {t} ELSE {b} - ({b} - {a}) * (1 - {t}) END < _r)::INT")
    return " + ".join(out)


def W(steps: str, final: str) -> str:
    return f"WITH {steps} {final}"


HARD_WTS = ", ".join([_deciles("sig", "signal", 5, "bucket", "dec"), _equal("dec", "bucket = 4", "bucket = 0")])
SIGNAL_WTS = "wts AS (SELECT *, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY date), 0) * 2.0, 0)::DOUBLE AS weight FROM (SELECT *, signal - avg(signal) OVER (PARTITION BY date) AS c FROM sig))"


def _neutral_signal(halflife: float) -> str:
    """Steps to sig: liquid, smoothed, neutral and rounded."""
    liq = "liq AS (SELECT * EXCLUDE (signal), CASE WHEN dollar_vol_20d >= 150000 THEN signal END AS signal FROM comb)"
    smooth = [_ewma("liq", halflife, "smo")] if halflife else ["smo AS (SELECT * FROM liq)"]
    return ", ".join([PANEL, FEATURES, COMBINE, liq, *smooth, _neutral("smo", "signal", "sector", "neu"), "sig AS (SELECT * EXCLUDE (signal, fwd), round(resid, 7) AS signal, round(fwd, 9) AS fwd FROM neu)"])


def _variants() -> str:
    each = []
    for name, steps in (("decile", HARD_WTS), ("sticky", _sticky("sig", "signal")), ("signal", SIGNAL_WTS)):
        numbers = f"count(net) AS n_obs, {_r('avg(net) * 252', 4, 'ann_return')}, {_r('avg(turnover)', 4, 'avg_turnover')}"
        ics = f"count(ic) AS ic_n, {_r('avg(ic) * sqrt(252) / nullif(stddev_pop(ic), 0)', 4, 'ic_ir')}"
        each.append(f"SELECT * FROM ({W(', '.join([_neutral_signal(0), steps, DAILY, _ic('sig')]), f'SELECT {name!r} AS variant, * FROM (SELECT {numbers} FROM daily), (SELECT {ics} FROM ics)')})")
    return " UNION ALL ".join(each)


def _cells() -> str:
    each = []
    for halflife in (0.0, 3.0):
        cells = [f'(SELECT * FROM ({W(", ".join([_neutral_signal(halflife), steps, DAILY]), "SELECT round(avg(turnover), 4) FROM daily")})) AS "{exit_}"' for exit_, steps in (("2", _sticky("sig", "signal")), ("off", HARD_WTS))]
        each.append(f"SELECT {halflife}::DOUBLE AS halflife, {', '.join(cells)}")
    return " UNION ALL ".join(each)


SQL: dict[str, str] = {
    "panel_dense": W(PANEL, f"SELECT date, t_idx, ticker, ticker_ord, sector, {', '.join(_r(c, 6) for c in ('open', 'high', 'low', 'close'))}, volume FROM panel"),
    "panel_dense_raw": W(_bars("s_name") + ", " + GRID, f"SELECT date, t_idx, ticker, ticker_ord, sector, {_r('close', 6)}, volume FROM raw"),
    "panel_slice": W(_bars("n_name"), f"SELECT date, ticker, {_r('close', 6)}, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    "cache_refresh_keep_last": W(_bars("n_name"), "SELECT date, ticker, CASE WHEN date >= DATE '2000-01-01' THEN round(round(close * 2, 6), 6) ELSE round(close, 6) END + 0.0::DOUBLE AS close, volume FROM bars"),
    "cache_tail_start": W(_bars("n_name"), "SELECT ticker, max(date) + 1 AS fetch_from, DATE '1995-01-01' AS requested FROM bars WHERE date < DATE '2000-06-01' GROUP BY ticker"),
    "ticker_clean": "SELECT p_partkey, CASE WHEN p_partkey % 7 <= 2 THEN NULL ELSE 'BRK-' || replace(upper(p_brand), '.', '-') END AS ticker FROM part",
    "requested_tickers": W(_bars("n_name"), "SELECT a.ticker, a.asked::INTEGER AS asked, b.date, b.volume FROM (VALUES ('NATION_3', 0), ('NATION_99', 1), ('NATION_1', 2), ('NATION_2', 3), ('NATION_98', 4)) a(ticker, asked) LEFT JOIN bars b ON b.ticker = a.ticker"),
    "universe_changes": W(", ".join([_bars("n_name"), GRID, CHANGES]), "SELECT effective_date, added, removed FROM changes WHERE added <> 'NATION_1'"),
    "membership_pit": W(", ".join([_bars("n_name"), GRID, MEMBERS]), "SELECT date, ticker, member FROM members"),
    "membership_average": W(", ".join([_bars("n_name"), GRID, MEMBERS]), "SELECT round(avg(n), 6) + 0.0::DOUBLE AS avg_members FROM (SELECT date, sum(member::INT)::DOUBLE AS n FROM members GROUP BY date)"),
    "mask_liquidity": W(FEAT, f"SELECT date, ticker, {_r('CASE WHEN dollar_vol_20d >= 150000 THEN reversal_5d END', 8, 'signal')} FROM feat"),
    "mask_membership": W(FEAT + ", " + MEMBERS, f"SELECT f.date, f.ticker, {_r('CASE WHEN coalesce(m.member, false) THEN f.reversal_5d END', 8, 'signal')} FROM feat f LEFT JOIN members m ON m.date = f.date AND m.ticker = f.ticker"),
    "calendar_business_days": "SELECT d::DATE AS date FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5",
    **{f"f_{n}": W(FEAT, f"SELECT date, ticker, {_r(n, k)} FROM feat") for n, k in (("mom_12_1", 8), ("reversal_5d", 8), ("vol_21d", 8), ("volume_shock", 8), ("dollar_vol_20d", 4), ("amihud_20d", 12), ("range_feature", 7), ("pct_off_52w_high", 8), ("overnight_drift_20d", 8), ("signed_vol_20d", 4), ("low_vol_252d", 8), ("idio_vol_60d", 6))},
    "f_forward_return": W(FEAT, f"SELECT date, ticker, {_r('fwd')} FROM feat"),
    "f_gaps_padded": W(", ".join([_bars("s_name"), GRID, RAWFEAT]), f"SELECT date, ticker, {_r('reversal_5d')}, {_r('vol_21d', 6)}, {_r('mom_12_1')}, {_r('fwd')} FROM pf"),
    "f_user_defined": W(PANEL, "SELECT date, ticker, round(CASE WHEN count(x) OVER w = 5 THEN avg(x) OVER w END, 8) + 0.0::DOUBLE AS drift FROM (SELECT *, close / open - 1 AS x FROM panel) WINDOW w AS (PARTITION BY ticker ORDER BY t_idx ROWS 4 PRECEDING)"),
    "xs_winsorize": W(FEAT, f"SELECT date, ticker, {_r('CASE WHEN reversal_5d IS NOT NULL THEN least(greatest(reversal_5d, quantile_cont(reversal_5d, 0.05) OVER d), quantile_cont(reversal_5d, 0.95) OVER d) END', 8, 'x')} FROM feat WINDOW d AS (PARTITION BY date)"),
    "xs_z_robust": W(FEAT, f"SELECT date, ticker, {_r('o / nullif(1.4826 * median(abs(o)) OVER (PARTITION BY date), 0)', 8, 'z')} FROM (SELECT *, reversal_5d - median(reversal_5d) OVER (PARTITION BY date) AS o FROM feat)"),
    "xs_z_std": W(FEAT, f"SELECT date, ticker, {_r('(reversal_5d - avg(reversal_5d) OVER d) / nullif(stddev_samp(reversal_5d) OVER d, 0)', 8, 'z')} FROM feat WINDOW d AS (PARTITION BY date)"),
    "xs_combine": W(FEAT + ", " + COMBINE, f"SELECT date, ticker, {_r('signal', 7)} FROM comb"),
    "xs_ewma": W(SIG + ", " + _ewma("sig", 3.0, "smo"), f"SELECT date, ticker, {_r('signal', 7)} FROM smo"),
    "xs_pct_rank": W(FEAT, f"SELECT date, ticker, {_r('CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(x) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE) / count(x) OVER (PARTITION BY date) END', 8, 'p')} FROM (SELECT date, ticker, round(reversal_5d, 3) AS x FROM feat)"),
    "neut_sector": W(FEAT, f"SELECT date, ticker, {_r('reversal_5d - avg(reversal_5d) OVER (PARTITION BY date, sector)', 8, 'x')} FROM feat"),
    "neut_size": W(SIG + ", " + _neutral("sig", "signal", None, "neu"), f"SELECT date, ticker, {_r('resid', 7, 'x')} FROM neu"),
    "neut_full": W(SIG + ", " + _neutral("sig", "signal", "sector", "neu"), f"SELECT date, ticker, {_r('resid', 7, 'x')} FROM neu"),
    "rank_deciles": W(SIG + ", " + _deciles("sig", "signal", 5, "bucket", "dec"), "SELECT date, ticker, bucket FROM dec"),
    "rank_deciles_wide": W(", ".join([_bars("s_name"), GRID, FILL, FEATURES, "x AS (SELECT date, ticker, ticker_ord, round(reversal_5d, 9) AS x FROM feat)",
        "y AS (SELECT *, row_number() OVER (PARTITION BY date, x IS NULL ORDER BY x, ticker_ord) AS _r, count(x) OVER (PARTITION BY date) AS _n FROM x)"]),
        f"SELECT date, ticker, CASE WHEN x IS NOT NULL AND _n > 1 THEN greatest({_edges(10)}, 1) - 1 END::INTEGER AS bucket FROM y"),
    "w_decile": W(WTS, f"SELECT date, ticker, {_r('weight')} FROM wts"),
    "w_sticky": W(SIG + ", " + _sticky("sig", "signal"), f"SELECT date, ticker, {_r('weight')} FROM wts"),
    "w_sticky_wide_exit": W(SIG + ", " + _deciles("sig", "signal", 5, "e5", "d5") + """, side AS (SELECT *, last_value(CASE WHEN e5 IS NULL THEN 0 WHEN e5 = 4 THEN 1 WHEN e5 = 0 THEN -1 END IGNORE NULLS)
  OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM d5), """ + _equal("side", "s = 1", "s = -1"), f"SELECT date, ticker, {_r('weight')} FROM wts"),
    "w_signal": W(SIG, f"SELECT date, ticker, {_r('coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY date), 0) * 2.0, 0)', 7, 'weight')} FROM (SELECT *, signal - avg(signal) OVER (PARTITION BY date) AS c FROM sig)"),
    "per_decile": W(", ".join([SIG, _deciles("sig", "signal", 5, "bucket", "dec"), PERDEC]), f"SELECT date, decile, {_r('ret')} FROM pd"),
    "bt_returns": W(WTS + ", " + DAILY, f"SELECT date, {_r('gross')}, {_r('turnover')}, {_r('cost', 10)}, {_r('net')} FROM daily"),
    "cost_flat": W(WTS + ", " + MOVED, f"SELECT date, {_r('sum(abs(weight - prior)) / 2 * 10.0 / 1e4', 10, 'cost')} FROM moved GROUP BY date"),
    "cost_sqrt": W(WTS + ", " + MOVED, f"SELECT date, {_r('coalesce(sum(CASE WHEN dollar_vol_20d IS NOT NULL THEN abs(weight - prior) * CASE WHEN abs(weight - prior) > 0 THEN 1.0 + 10.0 * sqrt(abs(weight - prior) * 1e6 / greatest(dollar_vol_20d, 1e6)) ELSE 0 END END), 0) / 1e4', 10, 'cost')} FROM moved GROUP BY date"),
    "cost_composite": W(WTS + ", " + MOVED, f"SELECT date, {_r('sum(abs(weight - prior)) / 2 * 5.0 / 1e4 + coalesce(sum(CASE WHEN dollar_vol_20d IS NOT NULL THEN abs(weight - prior) * CASE WHEN abs(weight - prior) > 0 THEN 1.0 + 10.0 * sqrt(abs(weight - prior) * 1e6 / greatest(dollar_vol_20d, 1e6)) ELSE 0 END END), 0) / 1e4', 10, 'cost')} FROM moved GROUP BY date"),
    "m_summary": W(", ".join([WTS, DAILY, EQUITY]), SUMMARY + " FROM daily"),
    "m_drawdown": W(", ".join([WTS, DAILY, EQUITY.replace("1 + net", "1 + net / 100")]), f"SELECT date, {_r('equity')}, {_r('drawdown')} FROM eq"),
    "m_decile_spread": W(", ".join([SIG, _deciles("sig", "signal", 5, "bucket", "dec"), PERDEC]), f"SELECT decile, {_r('avg(ret) * 252', 8, 'ann_return')}, {_r(SHARPE.format('ret'), 6, 'sharpe')}, count(ret) AS n FROM pd GROUP BY decile"),
    "m_ic": W(SIG + ", " + _ic("sig"), f"SELECT date, {_r('ic')} FROM ics"),
    "m_ic_summary": W(SIG + ", " + _ic("sig"), f"SELECT {ICS} FROM ics"),
    "m_gross": W(WTS + ", " + DAILY, f"SELECT {GROSS} FROM daily"),
    "r_exposures": W(", ".join([SIG, _sticky("sig", "signal"), EXPO]), f"SELECT date, {_r('gross')}, {_r('net')}, {_r('max_name')}, n_long, n_short FROM ex"),
    "r_sector": W(WTS + ", " + SECTORS, f"SELECT date, sector, {_r('exposure')} FROM sx"),
    "r_turnover": W(WTS + ", " + TURN, f"SELECT {_r('avg(t)', 8, 'avg_turnover')} FROM tn"),
    "r_metrics": W(WTS + ", " + METRICS, "SELECT metric, value FROM metrics"),
    "r_violations": W(", ".join([WTS, METRICS, HARD, BROKEN]), "SELECT name, metric, op, threshold, value FROM broken"),
    "r_soft": W(WTS + ", " + METRICS, f"SELECT name, {_r('abs(value - target) * weight', 6, 'score')} FROM metrics JOIN (VALUES ('turnover', 'avg_turnover', 0.2::DOUBLE, 1.0::DOUBLE), ('sector', 'max_sector_weight', 0.3, 2.0)) s(name, metric, target, weight) USING (metric)"),
    "d_ic_by_year": W(SIG + ", " + _ic("sig"), f"SELECT year(date)::INTEGER AS year, {_r('avg(ic)', 8, 'ic_mean')}, {_r('avg(ic) * sqrt(252) / nullif(stddev_pop(ic), 0)', 6, 'ic_ir')}, count(ic) AS n FROM ics WHERE ic IS NOT NULL GROUP BY 1"),
    "d_equity_year_end": W(", ".join([WTS, DAILY, EQUITY]), f"SELECT year(date)::INTEGER AS year, {_r('arg_max(equity, date)', 8, 'equity')} FROM eq GROUP BY 1"),
    "d_decile_report": W(", ".join([SIG, _deciles("sig", "signal", 5, "bucket", "dec"), PERDEC]), f"SELECT decile, {_r('avg(ret) * 252', 6, 'ann_mean')}, {_r('avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0)', 6, 'sharpe')} FROM pd GROUP BY decile"),
    "d_feature_corr": W(FEAT + ", " + CORRS, "SELECT a, b, corr FROM corrs"),
    "d_feature_stats": W(FEAT + """, x AS (SELECT t_idx, ticker, date, round(reversal_5d, 6) AS v FROM feat),
rk AS (SELECT *, CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY date, v IS NULL ORDER BY v) + (count(v) OVER (PARTITION BY date, v) - 1) / 2.0::DOUBLE) / count(v) OVER (PARTITION BY date) END AS p FROM x),
lg AS (SELECT ticker, p, lag(p) OVER (PARTITION BY ticker ORDER BY t_idx) AS q FROM rk), ac AS (SELECT ticker, corr(p, q) AS c FROM lg WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ticker)""",
        f"SELECT count(v) AS n_obs, {_r('1 - count(v) / count(*)', 6, 'nan_fraction')}, " + ", ".join(_r(f"quantile_cont(v, {q})", 6, f"q{int(q * 100):02d}") for q in (0.01, 0.25, 0.5, 0.75, 0.99)) + f", {_r('(SELECT avg(c) FROM ac)', 6, 'autocorr_mean')}, {_r('(SELECT median(c) FROM ac)', 6, 'autocorr_median')} FROM x"),
    "d_candidate": W(WTS + ", " + MOVED + """, g AS (SELECT date, coalesce(sum(weight * fwd), 0) AS gross, coalesce(sum(CASE WHEN dollar_vol_20d IS NOT NULL THEN abs(weight - prior) * CASE WHEN abs(weight - prior) > 0 THEN 1.0 + 10.0 * sqrt(abs(weight - prior) * 1e6 / greatest(dollar_vol_20d, 1e6)) ELSE 0 END END), 0) / 1e4 AS cost FROM moved GROUP BY date)""",
        f"SELECT {_r('avg(gross) * sqrt(252) / greatest(stddev_pop(gross), 1e-9)', 6, 'gross_sharpe')}, {_r('avg(gross - cost) * sqrt(252) / greatest(stddev_pop(gross - cost), 1e-9)', 6, 'net_sharpe')}, {_r('(avg(gross) - avg(gross - cost)) * 252', 7, 'cost_drag')} FROM g"),
    "d_governance": W(", ".join([WTS, METRICS, HARD, BROKEN, _ic("sig")]), f"SELECT coalesce({SHARPE.format('net')}, 0) > 0.5 AS inflated_sharpe, (SELECT coalesce(avg(ic) * sqrt(252) / nullif(stddev_pop(ic), 0), 0) > 2.5 FROM ics) AS inflated_ic_ir, (SELECT count(*) > 0 FROM broken) AS hard_violations, avg(gross) > 0 AND avg(net) < 0 AS costs_eat_returns FROM daily"),
    "p_shrink_cov": W(FEAT + ", rc AS (SELECT t_idx, ticker, ret FROM feat WHERE ret IS NOT NULL AND t_idx > (SELECT max(t_idx) FROM feat) - 252)", f"SELECT a.ticker AS a, b.ticker AS b, {_r('CASE WHEN a.ticker = b.ticker THEN covar_samp(a.ret, b.ret) ELSE covar_samp(a.ret, b.ret) * 0.5 END', 9, 'cov')} FROM rc a JOIN rc b ON a.t_idx = b.t_idx GROUP BY a.ticker, b.ticker"),
    "p_summary": W(WTS + ", " + EXPO, f"SELECT count(*) AS n_dates, {_r('avg(gross)', 7, 'avg_gross')}, {_r('avg(n_long)', 7, 'avg_n_long')}, {_r('avg(n_short)', 7, 'avg_n_short')}, {_r('max(max_name)', 7, 'max_abs_weight')} FROM ex"),
    "j_top_runs": W(RUNS, "SELECT seq, run_id, sharpe FROM runs WHERE sharpe IS NOT NULL AND NOT isnan(sharpe) ORDER BY sharpe DESC, seq LIMIT 5"),
    "j_recent_runs": W(RUNS, "SELECT seq, run_id, sharpe FROM runs ORDER BY seq DESC LIMIT 20"),
    "j_best_run": W(RUNS, "SELECT run_id, sharpe FROM runs ORDER BY sharpe DESC, seq LIMIT 1"),
    "j_best_by_feature": W(RUNS, "SELECT feature, max(sharpe) AS best_sharpe, first(run_id ORDER BY sharpe DESC, seq) AS run_id, count(*) AS n_runs FROM runs GROUP BY feature"),
    "k_resolved": W(LEDGER, f"SELECT seq, type, in_range, {_r('miss', 6)} FROM done"),
    "k_summary": W(LEDGER, "SELECT type, count(*) AS n, sum(in_range::INT)::BIGINT AS n_hits, round(avg(in_range::INT), 2) + 0.0::DOUBLE AS hit_rate, round(avg(round(miss, 6)), 2) + 0.0::DOUBLE AS mean_miss, round(avg(CASE WHEN NOT in_range THEN round(miss, 6) END), 2) + 0.0::DOUBLE AS mean_miss_outside FROM done GROUP BY type"),
    "k_recent": W(LEDGER, "SELECT seq, type, in_range FROM done ORDER BY seq DESC LIMIT 8"),
    "k_resolve_pairs": W(FEAT + ", " + CORRS, f"SELECT p.id, {_r('c.corr', 3, 'actual')}, c.corr BETWEEN p.low AND 1.0 AS in_range, {_r('c.corr - (p.low + 1.0) / 2', 3, 'miss')} FROM (VALUES ('p1', 'reversal_5d', 'vol_21d', -1.0::DOUBLE), ('p2', 'vol_21d', 'volume_shock', 0.9)) p(id, a, b, low) JOIN corrs c USING (a, b)"),
    "k_resolve_by_type": W(", ".join([WTS, DAILY, EQUITY]), f"SELECT p.id, {_r('v', 6, 'actual')}, v BETWEEN low AND high AS in_range, {_r('v - (low + high) / 2', 6, 'miss')} FROM (SELECT round({SHARPE.format('net')}, 6) AS s, round(avg(turnover), 8) AS t FROM daily), LATERAL (VALUES ('p1', s, -5.0::DOUBLE, 5.0::DOUBLE), ('p2', t, 0.0, 0.01)) p(id, v, low, high)"),
    "v_heads": """WITH v AS (SELECT event_type AS agent, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS version, props, value FROM events)
SELECT agent, max(version) AS latest, max(CASE WHEN value > 20 AND NOT value > 60 THEN version END) AS latest_promoted, max(version) + 1 AS next_version, substr(sha256(arg_max(props, version)), 1, 16) AS latest_hash FROM v GROUP BY agent""",
    "v_line_diff": r"""WITH p AS (SELECT conv_id AS pair, string_split(arg_min(text, turn), chr(10)) AS o, string_split(arg_max(text, turn), chr(10)) AS n FROM conversations GROUP BY conv_id),
l AS (SELECT pair, unnest(range(greatest(len(o), len(n)))) + 1 AS k, o, n FROM p)
SELECT pair, CASE WHEN k > len(o) THEN 'added' WHEN k > len(n) THEN 'removed' WHEN o[k] <> n[k] THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM l GROUP BY 1, 2""",
    "v_slug": r"SELECT p_partkey, substr(regexp_replace(lower(concat_ws(' -- ', p_name, p_brand, p_type)), '\W+', '_', 'g'), 1, 64) AS slug FROM part",
    "v_proposals": "SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'unknown agent' WHEN length(text) < 200 THEN 'text too short' WHEN length(substr(text, 1, 31)) < 30 THEN 'rationale too short' ELSE 'ok' END AS outcome FROM conversations",
    "o_promotion": "SELECT event_id, CASE WHEN event_id % 500 < 252 THEN 'INSUFFICIENT' WHEN value / 100 <= 0.6::DOUBLE / sqrt(greatest(user_id % 30, 1)) THEN 'NO_IMPROVEMENT' WHEN (event_id % 97) / 97.0::DOUBLE > 0.5 THEN 'IPS_VIOLATION' ELSE 'PROMOTED' END AS decision FROM events",
    "o_verdict": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'AUDIT_REQUIRED' WHEN 2 THEN 'VETOED' WHEN 3 THEN 'AUDIT_REQUIRED' ELSE 'DRY_RUN' END AS verdict FROM events",
    "pipeline_full": W(", ".join([FULL, _sticky("sig", "signal"), DAILY, EQUITY, _ic("sig")]), f"SELECT * FROM ({SUMMARY} FROM daily), (SELECT {ICS} FROM ics), (SELECT {GROSS} FROM daily)"),
    "compare_variants": _variants(),
    "grid_pivot": _cells(),
    "stream_bars": "SELECT date_trunc('day', ts)::DATE AS date, user_id::VARCHAR AS ticker, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2",
}
