"""The policy document: loading, validation, rendering."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from ..operators.risk import METRICS, OPS


# Sections and fields are those of the YAML documents in use; the defaults are a large-cap setting.
@dataclass
class Universe:
    source: str = "wikipedia"
    symbol_set: str = "sp500"
    point_in_time: bool = True
    min_dollar_vol_usd: float = 5_000_000


@dataclass
class Data:
    start: str = "2014-01-01"
    end: str = "today"
    fields: list[str] = field(default_factory=lambda: ["open", "high", "low", "close", "adj_close", "volume"])


@dataclass
class Holdout:
    in_sample_start: str = "2014-01-01"
    in_sample_end: str = "2021-12-31"
    holdout_start: str = "2022-01-01"
    holdout_end: str = "2026-04-17"
    min_observations: int = 252
    bonferroni_n_tests: int = 20


@dataclass
class Costs:
    type: str = "sqrt_impact"
    flat_bps: float = 5.0
    half_spread_bps: float = 1.0
    impact_coefficient: float = 10.0
    capital: float = 1.0


@dataclass
class Hard:
    name: str
    metric: str
    op: str
    threshold: float
    description: str = ""


@dataclass
class Soft:
    name: str
    metric: str
    target: float
    weight: float = 1.0
    description: str = ""


@dataclass
class Governance:
    require_oos_evaluation: bool = True
    multi_testing_correction: bool = True
    flag_inflated_sharpe_threshold: float = 0.5
    flag_inflated_ic_ir_threshold: float = 2.5


@dataclass
class Policy:
    name: str = "default"
    description: str = ""
    universe: Universe = field(default_factory=Universe)
    data: Data = field(default_factory=Data)
    holdout: Holdout = field(default_factory=Holdout)
    cost_model: Costs = field(default_factory=Costs)
    hard_constraints: list[Hard] = field(default_factory=list)
    soft_constraints: list[Soft] = field(default_factory=list)
    governance: Governance = field(default_factory=Governance)


def from_dict(d: dict | None) -> Policy:
    """Unknown keys inside a section raise TypeError; unknown sections are ignored, and an empty document is the default."""
    d = {k: v for k, v in (d or {}).items() if k in {f.name for f in fields(Policy)} and v is not None}
    parts = {"universe": Universe, "data": Data, "holdout": Holdout, "cost_model": Costs, "governance": Governance}
    lists = {"hard_constraints": Hard, "soft_constraints": Soft}
    built = {k: parts[k](**v) if k in parts else [lists[k](**x) for x in v] if k in lists else v for k, v in d.items()}
    return Policy(**built)


def load(path: str) -> Policy:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f))


def errors(p: Policy) -> list[str]:
    """What is wrong with a policy; nothing if it is valid.  Dates are compared as ISO strings."""
    out = []
    if p.holdout.in_sample_end >= p.holdout.holdout_start:
        out.append("the in-sample window must end before the holdout starts")
    c = p.cost_model
    checked = {"sqrt_impact": ("half_spread_bps", "impact_coefficient"), "flat": ("flat_bps",), "composite": ()}
    if c.type not in checked:
        out.append(f"unknown cost model {c.type!r}")
    out += [f"cost_model.{k} must not be negative" for k in checked.get(c.type, ()) if getattr(c, k) < 0]
    for h in p.hard_constraints:
        if h.metric not in METRICS:
            out.append(f"{h.name}: unknown metric {h.metric!r}")
        if h.op not in OPS:
            out.append(f"{h.name}: unknown operator {h.op!r}")
    g = p.governance
    out += [f"governance.{k} must be positive" for k in ("flag_inflated_sharpe_threshold", "flag_inflated_ic_ir_threshold") if getattr(g, k) <= 0]
    return out


def net_neutral(p: Policy) -> bool:
    """Whether the policy asks for (nearly) no net exposure."""
    return any(h.metric == "net_exposure" and h.op in ("<=", "<") and h.threshold <= 0.15 for h in p.hard_constraints)


def render(p: Policy) -> str:
    lines = [f"Policy {p.name}: {p.description}".rstrip(), f"Universe: {p.universe.symbol_set}, dollar volume from {p.universe.min_dollar_vol_usd:,.0f}"]
    lines += [f"In sample {p.holdout.in_sample_start} to {p.holdout.in_sample_end}, holdout {p.holdout.holdout_start} to {p.holdout.holdout_end}", f"Costs: {p.cost_model.type}"]
    lines += [f"Hard: {h.name}: {h.metric} {h.op} {h.threshold:g}" for h in p.hard_constraints]
    lines += [f"Soft: {s.name}: {s.metric} near {s.target:g} (weight {s.weight:g})" for s in p.soft_constraints]
    return "\n".join([*lines, *(f"Governance: {k} = {v}" for k, v in asdict(p.governance).items())])


def hard_frame(spark, p: Policy):
    return spark.createDataFrame([(h.name, h.metric, h.op, float(h.threshold)) for h in p.hard_constraints], "name string, metric string, op string, threshold double")


def soft_frame(spark, p: Policy):
    return spark.createDataFrame([(s.name, s.metric, float(s.target), float(s.weight)) for s in p.soft_constraints], "name string, metric string, target double, weight double")
