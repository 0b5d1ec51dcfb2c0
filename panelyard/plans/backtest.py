"""One run from a panel to its numbers, and comparisons over runs.  All frames are lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..functions import cross, features
from ..functions.features import Lags
from ..operators import accounting, ranking, universe
from ..sources import files as bars_source, panel as src
from ..sources.layout import save_run


@dataclass(frozen=True)
class Config:
    features: dict[str, float] = field(default_factory=lambda: {"mom_12_1": 1.0, "reversal_5d": 1.0, "volume_shock": 0.5})
    min_dollar_vol: float | None = 5e6
    sector: bool = True
    size: bool = True
    halflife: float = 0.0
    weighting: str = "decile"
    n_deciles: int = 10
    exit_n_deciles: int | None = 5
    cost_bps: float = 5.0
    remask: bool = False  # by default smoothing may revive a masked name
    lags: Lags = Lags()

    @staticmethod
    def from_dict(d: dict) -> Config:
        b, n = d.get("backtest", {}), d.get("neutralize", {})
        return Config(
            features=dict(d["features"]), min_dollar_vol=d.get("liquidity", {}).get("min_dollar_vol_usd"), sector=n.get("sector", False), size=n.get("size", False),
            halflife=d.get("smoothing", {}).get("halflife_days", 0), weighting=b.get("weighting", "decile"), n_deciles=b.get("n_deciles", 10),
            exit_n_deciles=b.get("exit_n_deciles"), cost_bps=b.get("cost_bps", 5.0),
        )

    @staticmethod
    def from_yaml(path: str) -> Config:
        import yaml

        with open(path) as f:
            return Config.from_dict(yaml.safe_load(f))


@dataclass
class Result:
    signal: DataFrame
    weights: DataFrame
    returns: DataFrame
    per_decile: DataFrame
    ic: DataFrame | None
    config: Config


def make_signal(panel: DataFrame, config: Config, members: DataFrame | None = None, registry=None) -> DataFrame:
    """panel with features, fwd and `signal`: combine, liquidity, membership, smoothing, neutralisation, in that order."""
    names = [*config.features, "dollar_vol_20d"]
    df = cross.combine(features.compute(panel, names, config.lags, registry), config.features)

    def mask(df: DataFrame) -> DataFrame:
        if config.min_dollar_vol is not None:
            df = universe.liquid(df, "signal", "dollar_vol_20d", config.min_dollar_vol)
        return universe.masked(df, members) if members is not None else df

    df = cross.smooth(mask(df), "signal", config.halflife)
    df = mask(df) if config.remask else df
    return cross.neutralize(df, "signal", "sector" if config.sector else None, "dollar_vol_20d" if config.size else None)


def run(panel: DataFrame, config: Config, members: DataFrame | None = None, signal: DataFrame | None = None, registry=None) -> Result:
    df = signal if signal is not None else make_signal(panel, config, members, registry)
    weights = ranking.weigh(df, config.weighting, config.n_deciles, config.exit_n_deciles)
    return Result(df, weights, accounting.returns(weights, config.cost_bps), ranking.per_decile(df, "signal", config.n_deciles), accounting.information_coefficient(df), config)


def report(result: Result) -> DataFrame:
    """One row: net summary, IC, gross numbers."""
    return accounting.summary(result.returns, gross=True).join(accounting.ic_summary(result.ic))


def compare(panel: DataFrame, variants: dict[str, Config], members: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per variant.  Variants that share a signal share its frame, which is computed once and kept while their rows
    are made; a row is made in one job.  prepare: what a signal's frame goes through before it is ranked."""
    by_signal: dict[tuple, list[tuple[str, Config]]] = {}
    for name, config in variants.items():
        key = (tuple(sorted(config.features.items())), config.min_dollar_vol, config.sector, config.size, config.halflife, config.remask, config.lags)
        by_signal.setdefault(key, []).append((name, config))
    rows, schema = {}, None
    for group in by_signal.values():
        signal = make_signal(panel, group[0][1], members)
        signal = (prepare(signal) if prepare else signal).persist()
        ic = accounting.ic_summary(accounting.information_coefficient(signal)).persist()  # no weights in it
        for name, config in group:
            weights = ranking.weigh(signal, config.weighting, config.n_deciles, config.exit_n_deciles)
            one = accounting.summary(accounting.returns(weights, config.cost_bps), gross=True).join(ic).withColumn("variant", F.lit(name))
            rows[name], schema = one.first(), one.schema
        ic.unpersist()
        signal.unpersist()
    return panel.sparkSession.createDataFrame([rows[name] for name in variants], schema)


def grid(panel: DataFrame, base: Config, halflives: list[float], exits: list[int | None], members: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per (halflife, exit) cell; exit None is the plain decile scheme, shown as 'off'."""
    cells = {}
    for h in halflives:
        for e in exits:
            cells[f"{h}|{e or 'off'}"] = replace(base, halflife=h, weighting="decile_sticky" if e else "decile", exit_n_deciles=e)
    got = compare(panel, cells, members, prepare)
    return got.withColumns({"halflife": F.split_part("variant", F.lit("|"), F.lit(1)).cast("double"), "exit": F.split_part("variant", F.lit("|"), F.lit(2))}).drop("variant")


GRID_METRICS = ("sharpe", "gross_sharpe", "avg_turnover", "max_drawdown", "ic_ir")


def grid_table(cells: DataFrame, metric: str) -> DataFrame:
    return cells.groupBy("halflife").pivot("exit").agg(F.first(metric))


def grid_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """One halflife x exit table per metric."""
    return {m: grid_table(cells, m) for m in GRID_METRICS}


def run_from_files(spark, config_path: str, layout, limit: int | None = None, source=None, save: bool = True) -> tuple[Result, dict, str | None]:
    """A run from a YAML file to its sinks: universe, bars (refreshed from `source` if one is given), membership, signal,
    weights, numbers, files.  Returns the result, its summary and the folder."""
    import yaml

    with open(config_path) as f:
        raw = yaml.safe_load(f)
    start, end = str(raw["start"]), str(raw.get("end", "today"))
    universe_ = bars_source.load_universe(spark, layout)
    bars = bars_source.load_bars(spark, layout, start, end, limit=limit, source=source)
    panel = src.dense(bars.drop("sector").join(universe_.select("ticker", "sector"), "ticker", "left")).persist()
    members = bars_source.load_membership(spark, layout, panel.select("date")) if raw.get("membership", {}).get("point_in_time") else None
    config = Config.from_dict(raw)
    signal = make_signal(panel, config, members).persist()
    result = run(panel, config, members, signal)
    summary = {**report(result).first().asDict(), "weighting": config.weighting}
    if members is not None:
        summary["avg_members"] = universe.average_members(members).first()[0]
    folder = save_run(layout, f"sample_run_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}", result, summary) if save else None
    return result, summary, folder
