"""A research session: persisted panel and features, runs with a ring buffer, and the tool surface.

Tools are plain methods that return JSON or text and report a failure as text, never as an exception.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections import deque
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..functions import features
from ..operators import accounting, construct, risk, stores, universe
from ..sources import files, panel as src
from . import backtest, cycle, policy as policies, sandbox

KEPT_RUNS = 5


class Journal:
    """Runs as JSON lines, and one JSON file per accepted feature."""

    def __init__(self, root: str):
        self.root, self.warnings = Path(root), []
        (self.root / "features").mkdir(parents=True, exist_ok=True)

    @property
    def path(self) -> Path:
        return self.root / "runs.jsonl"

    def record(self, config: dict, summary: dict) -> str:
        run_id = uuid.uuid4().hex[:12]
        row = {"run_id": run_id, "timestamp": datetime.now(timezone.utc).isoformat(), "config": config, "summary": {k: v for k, v in summary.items() if isinstance(v, int | float)}}
        with self.path.open("a") as f:
            f.write(json.dumps(row) + "\n")
        return run_id

    def rows(self) -> list[dict]:
        """All readable lines; blank and broken ones are skipped."""
        out = []
        for line in self.path.read_text().splitlines() if self.path.exists() else []:
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
        return out

    def frame(self, spark) -> DataFrame:
        """The same as a table (seq, run_id, sharpe, feature_weights)."""
        data = [(k, r["run_id"], r["summary"].get("sharpe"), {a: float(b) for a, b in r["config"].get("feature_weights", {}).items()}) for k, r in enumerate(self.rows())]
        return spark.createDataFrame(data, "seq long, run_id string, sharpe double, feature_weights map<string,double>")

    def total_runs(self) -> int:
        """Lines that are not blank, readable or not."""
        return sum(bool(x.strip()) for x in self.path.read_text().splitlines()) if self.path.exists() else 0

    def exists(self) -> bool:
        return self.path.exists() or any((self.root / "features").glob("*.json"))

    def best(self) -> dict | None:
        """The earliest run with the largest known Sharpe ratio."""
        known = [r for r in self.rows() if isinstance(v := r.get("summary", {}).get("sharpe"), int | float) and v == v]
        return max(known, key=lambda r: r["summary"]["sharpe"], default=None)

    def top(self, k: int = 5) -> list[dict]:
        known = [r for r in self.rows() if isinstance(v := r.get("summary", {}).get("sharpe"), int | float) and v == v]
        return sorted(known, key=lambda r: -r["summary"]["sharpe"])[:k]

    def save_feature(self, name: str, source: str, description: str = "") -> int:
        at = self.root / "features" / f"{stores_slug(name)}.json"
        old = json.loads(at.read_text()) if at.exists() else {}
        now = datetime.now(timezone.utc).isoformat()
        new = {"name": name, "source": source, "description": description or old.get("description", ""), "revision_count": old.get("revision_count", 0) + 1}
        at.write_text(json.dumps({**new, "created_at": old.get("created_at", now), "updated_at": now, "best_sharpe": old.get("best_sharpe")}))
        return new["revision_count"]

    def note_sharpe(self, names, sharpe: float | None) -> None:
        """Keeps the best Sharpe ratio of runs that used a feature."""
        for at in (self.root / "features").glob("*.json"):
            d = self._read(at)
            if d and d.get("name") in names and sharpe is not None and sharpe == sharpe and (d.get("best_sharpe") is None or sharpe > d["best_sharpe"]):
                at.write_text(json.dumps({**d, "best_sharpe": sharpe}))

    def _read(self, at: Path) -> dict | None:
        try:
            d = json.loads(at.read_text())
            return d if isinstance(d, dict) else None
        except (ValueError, OSError):
            return None

    def feature_metadata(self) -> list[dict]:
        """What is kept about each feature but its source; unreadable files are skipped."""
        found = [self._read(at) for at in sorted((self.root / "features").glob("*.json"))]
        return [{k: v for k, v in d.items() if k != "source"} for d in found if d and "name" in d]

    def features(self) -> dict[str, str]:
        """Sources that still pass the check; `warnings` tells about the others."""
        out, self.warnings = {}, []
        for at in sorted((self.root / "features").glob("*.json")):
            d = self._read(at)
            try:
                sandbox.check(d["source"])
                out[d["name"]] = d["source"]
            except (ValueError, KeyError, TypeError) as e:
                self.warnings.append(f"{at.name}: {e or 'unreadable'}")
        return out

    def clear(self) -> None:
        """Removes the whole tree."""
        shutil.rmtree(self.root, ignore_errors=True)
        (self.root / "features").mkdir(parents=True, exist_ok=True)

    def recap(self, ledger: Ledger | None = None, features: int = 10, runs: int = 5) -> str:
        """The state of the research as text: best run, known features, top runs, totals, forecasts."""
        number = lambda v, spec: "unknown" if v is None else format(v, spec)
        lines, best = ["# Prior research state"], self.best()
        if best is None:
            lines.append("No runs yet: the baseline is where to begin.")
        else:
            s = best["summary"]
            lines += [f"Best run: {best['run_id']} ({best['timestamp']})", f"  config: {json.dumps(best['config'], default=str)}"]
            lines.append(f"  net Sharpe {number(s.get('sharpe'), '+.3f')}, gross Sharpe {number(s.get('gross_sharpe'), '+.3f')}, IC IR {number(s.get('ic_ir'), '+.3f')}, turnover {number(s.get('avg_turnover'), '+.2%')}, drawdown {number(s.get('max_drawdown'), '+.2%')}")
        known = self.feature_metadata()
        if known:
            lines += ["", f"Features of earlier sessions ({len(known)}, at most {features} shown):"]
            for d in known[:features]:
                text = " ".join((d.get("description") or "").split())
                lines.append(f"  - {d['name']}: {text if len(text) <= 120 else text[:117] + '...'} (best net Sharpe: {number(d.get('best_sharpe'), '+.3f')})")
        top = self.top(runs)
        if len(top) > 1:
            lines += ["", f"Top {len(top)} runs by net Sharpe:"]
            lines += [f"  - {r['run_id']}: {r['summary']['sharpe']:+.3f}, IC IR {number(r['summary'].get('ic_ir'), '+.3f')}, weights {r['config'].get('feature_weights')}, halflife {r['config'].get('halflife_days')}, {r['config'].get('weighting')}" for r in top]
        lines += ["", f"Runs on record: {self.total_runs()}. Propose what is new, or say why a variant should do better."]
        if ledger is not None and (text := ledger.recap()):
            lines += ["", text]
        return "\n".join(lines)


def stores_slug(text: str) -> str:
    import re

    return re.sub(r"\W+", "_", text.lower())[:64]


class Ledger:
    """Forecasts as JSON lines."""

    def __init__(self, root: str):
        self.path = Path(root) / "ledger.jsonl"
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.items: list[dict] = []
        for line in self.path.read_text().splitlines() if self.path.exists() else []:
            try:
                item = json.loads(line)
            except ValueError:  # a broken line is skipped
                continue
            if isinstance(item, dict) and {"type", "key", "low", "high", "status"} <= set(item):
                self.items.append(item)

    def add(self, kind: str, key, low: float, high: float, note: str = "") -> dict:
        item = {"id": uuid.uuid4().hex[:12], "type": kind, "key": [key] if isinstance(key, str) else list(key), "low": min(low, high), "high": max(low, high), "note": note, "status": "pending"}
        self.items.append(item)
        self._save()
        return item

    def resolve(self, measured: dict[str, float], match=None, run_id: str | None = None) -> int:
        """Pending forecasts whose type (and key, if match is given) was measured."""
        done = 0
        for item in self.items:
            if item["status"] == "pending" and item["type"] in measured and (match is None or sorted(item["key"]) == sorted(match)):
                a = measured[item["type"]]
                if a is not None:
                    item |= {"status": "resolved", "actual": a, "in_range": item["low"] <= a <= item["high"], "miss": a - (item["low"] + item["high"]) / 2, "run_id": run_id}
                    done += 1
        self._save()
        return done

    def _save(self) -> None:
        self.path.write_text("".join(json.dumps(x) + "\n" for x in self.items))

    def summary(self) -> dict:
        out: dict = {}
        for kind in sorted({x["type"] for x in self.items}):
            done = [x for x in self.items if x["type"] == kind and x["status"] == "resolved"]
            if done:
                misses = [x["miss"] for x in done if not x["in_range"]]
                out[kind] = {"n": len(done), "n_hits": sum(x["in_range"] for x in done), "hit_rate": round(sum(x["in_range"] for x in done) / len(done), 3), "mean_miss": round(sum(x["miss"] for x in done) / len(done), 3), "mean_miss_outside": round(sum(misses) / len(misses), 3) if misses else None}
        return {"by_type": out, "n_resolved": sum(v["n"] for v in out.values()), "n_pending": sum(x["status"] == "pending" for x in self.items)}

    def recap(self) -> str:
        """Text for people; empty while nothing is resolved, and a word on bias from three forecasts on."""
        lines = []
        for kind, s in self.summary()["by_type"].items():
            bias = f", off by {s['mean_miss']:+.3f} on average" if s["n"] >= 3 else ""
            lines.append(f"{kind}: {s['n_hits']} of {s['n']} in range{bias}")
        recent = [x for x in reversed(self.items) if x["status"] == "resolved"][:6]
        return "\n".join([*lines, *(f"- {x['type']} {x['key']}: {x['actual']:.3f} in [{x['low']:.3f}, {x['high']:.3f}]: {'hit' if x['in_range'] else 'miss'}" for x in recent)])


def tool(function):
    def run(self, *args, **kw):
        try:
            out = function(self, *args, **kw)
            return out if isinstance(out, str) else json.dumps(out, default=str)
        except sandbox.Rejected as e:
            return f"REJECTED: {e}"
        except Exception as e:  # noqa: BLE001  (a tool answers in text)
            return f"ERROR: {type(e).__name__}: {str(e)[:500]}"

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


BASELINE = ("mom_12_1", "reversal_5d", "volume_shock", "dollar_vol_20d", "vol_21d", "amihud_20d")


class Session:
    @classmethod
    def from_bars(cls, bars: DataFrame, workdir: str, start: str, end: str, limit: int | None = None, members=None, **kw) -> Session:
        """A session over the bars of a window.  Bars are cut before anything looks back, so that features warm up inside the
        window.  members: (current, changes) of the universe, or None."""
        bars = src.window_slice(bars, start, end)
        if limit:
            bars = bars.join(F.broadcast(bars.select("ticker").distinct().orderBy("ticker").limit(limit)), "ticker")
        panel = src.dense(bars)
        return cls(panel, workdir, members=universe.membership(panel.select("date"), *members) if members else None, **kw)

    @classmethod
    def from_cache(cls, spark, layout, workdir: str, start: str = "2014-01-01", end: str = "today", limit: int | None = None, **kw) -> Session:
        """A session over a workspace's cached bars, with its latest universe (sectors) and membership."""
        names = files.load_universe(spark, layout).select("ticker", "sector")
        bars = files.load_bars(spark, layout, start, end, limit=limit).drop("sector").join(F.broadcast(names), "ticker", "left")
        panel = src.dense(bars)
        return cls(panel, workdir, members=files.load_membership(spark, layout, panel.select("date")), **kw)

    @classmethod
    def in_sample(cls, bars: DataFrame, workdir: str, policy: policies.Policy, **kw) -> Session:
        """What agents may see: the in-sample window only."""
        return cls.from_bars(bars, workdir, policy.holdout.in_sample_start, policy.holdout.in_sample_end, policy=policy, **{"config": from_policy(policy), **kw})

    @classmethod
    def holdout(cls, bars: DataFrame, workdir: str, policy: policies.Policy, **kw) -> Session:
        """The window that only promotion decisions see."""
        return cls.from_bars(bars, workdir, policy.holdout.holdout_start, policy.holdout.holdout_end, policy=policy, **{"config": from_policy(policy), **kw})

    def __init__(self, panel: DataFrame, workdir: str, config: backtest.Config | None = None, members: DataFrame | None = None, policy: policies.Policy | None = None):
        self.spark, self.panel, self.members = panel.sparkSession, panel.persist(), members
        self.config, self.policy = config or backtest.Config(neutral_defaults()), policy or policies.Policy()
        self.journal, self.ledger = Journal(workdir), Ledger(workdir)
        self.registry, self.user = dict(features.FEATURES), {}
        self.memo: set[str] = set()
        self.runs: deque = deque()
        self.candidate: DataFrame | None = None
        self.method = "unknown"
        self.versions = cycle.Versions(str(Path(workdir) / "versions"))
        self.table(list(BASELINE))
        loaded = self.journal.features()
        self.warnings: list[str] = list(self.journal.warnings)
        for name, source in loaded.items():
            try:
                self._register(source, name, save=False)
            except Exception as e:  # noqa: BLE001
                self.warnings.append(f"{name}: {e}")

    def table(self, names: list[str]) -> DataFrame:
        """The panel with these features.  Each is computed once, and kept as a column of the session's panel."""
        if unknown := [n for n in names if n not in self.registry]:
            raise KeyError(f"unknown features {unknown}")
        new = [n for n in dict.fromkeys(names) if n not in self.memo and n not in self.user]
        if new:
            old = self.panel
            self.panel = features.compute(old, new, self.config.lags, self.registry).select(*old.columns, *new).persist()
            self.panel.count()
            old.unpersist()
            self.memo |= set(new)
            self.registry |= {n: (lambda lags, c=n: F.col(c)) for n in new}
        return self.panel

    def _register(self, source: str, name: str | None, save: bool = True, description: str = "") -> str:
        name, _ = sandbox.compile_feature(source, name)
        got = sandbox.apply(self.panel, source, name)
        n, known = got.agg(F.count("*"), F.count(name)).first()
        if n != self.panel.count() or not known:
            raise sandbox.Rejected("the feature must give one value per row, and some that are known")
        self.panel = got.persist()
        self.registry[name] = lambda lags, c=name: F.col(c)
        self.user[name] = source
        if save:
            self.journal.save_feature(name, source, description)
        return name

    def run(self, weights: dict[str, float], halflife: float = 3.0, weighting: str = "decile_sticky", exit_n: int | None = None) -> dict:
        if not weights:
            raise ValueError("no feature weights")
        if unknown := [w for w in weights if w not in self.registry]:
            raise KeyError(f"unknown features {unknown}")
        self.table([*weights, "dollar_vol_20d"])
        config = replace(self.config, features=weights, halflife=halflife, weighting=weighting, exit_n_deciles=exit_n or self.config.exit_n_deciles, sector=True, size=True)
        signal = backtest.make_signal(self.panel, config, self.members, self.registry).persist()
        result = backtest.run(self.panel, config, self.members, signal=signal, registry=self.registry)
        summary = backtest.report(result).first().asDict()
        run_id = self.journal.record({"feature_weights": weights, "halflife_days": halflife, "weighting": weighting, "exit_n_deciles": exit_n}, summary)
        self.ledger.resolve({"net_sharpe": summary["sharpe"], "sharpe": summary["sharpe"], "turnover": summary["avg_turnover"], "ic_ir": summary["ic_ir"]}, run_id=run_id)
        self.journal.note_sharpe(set(weights), summary["sharpe"])
        self.runs.append((run_id, result, summary))
        if len(self.runs) > KEPT_RUNS:
            self.runs.popleft()[1].signal.unpersist()
        return {"run_id": run_id, **summary}

    @property
    def last(self):
        if not self.runs:
            raise ValueError("nothing has run yet")
        return self.runs[-1]

    @tool
    def list_features(self):
        return sorted(self.registry)

    @tool
    def propose_feature(self, source: str, name: str | None = None, description: str = ""):
        return f"OK: {self._register(source, name, description=description)}"

    @tool
    def run_backtest_tool(self, weights: dict, halflife_days: float = 3.0, weighting: str = "decile_sticky", exit_n_deciles: int | None = None):
        return self.run(weights, halflife_days, weighting, exit_n_deciles)

    @tool
    def analyze_last_run(self):
        _, result, _ = self.last
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  (a few rows each)
        return {"deciles": rows(risk.decile_report(result.per_decile).orderBy("decile")), "ic_by_year": rows(risk.ic_by_year(result.ic).orderBy("year")), "equity": rows(risk.year_end_equity(result.returns).orderBy("year"))}

    @tool
    def feature_correlations(self, names: list[str]):
        df = self.table(names)
        got = risk.feature_correlations(df, names).collect()
        for r in got:
            self.ledger.resolve({"correlation": r["corr"]}, match=[r["a"], r["b"]])
        return [r.asDict() for r in got]

    @tool
    def feature_stats(self, name: str):
        df = self.table([name])
        out = risk.feature_stats(df, name).first().asDict()
        self.ledger.resolve({"rank_autocorr": out["autocorr_mean"]}, match=[name])
        return out

    @tool
    def record_prediction(self, predictions: list[dict]):
        """Stops at the first bad one; those before it stay recorded."""
        for k, p in enumerate(predictions):
            if not {"type", "key", "low", "high"} <= set(p):
                return f"ERROR: prediction {k} lacks a field"
            self.ledger.add(p["type"], p["key"], float(p["low"]), float(p["high"]), p.get("note", ""))
        return f"OK: {len(predictions)} recorded"

    @tool
    def calibration_report(self):
        return {**self.ledger.summary(), "recent": [x for x in reversed(self.ledger.items) if x["status"] == "resolved"][:8]}

    @tool
    def calibration_check(self):
        """The ledger's summary, for whoever reviews a run."""
        return self.ledger.summary()

    @tool
    def calibration_summary(self):
        """The same across sessions: the ledger is kept in the working folder."""
        return self.ledger.summary()

    @tool
    def list_prompt_versions(self, agent: str):
        return [{"version": v.version, "parent_version": v.parent_version, "rationale": v.rationale, "created_at": v.created_at, "promoted": v.promoted, "rolled_back": v.rolled_back, "metrics_at_promotion": v.metrics} for v in self.versions.list(agent)]

    @tool
    def propose_prompt_rewrite(self, agent: str, text: str, rationale: str):
        """A new version that waits for its holdout numbers, or {"error": ...}."""
        try:
            v = self.versions.propose(agent, text or "", rationale or "")
        except ValueError as e:
            return {"error": str(e)}
        return {"status": "PROPOSED_PENDING_VALIDATION", "agent": agent, "version": v.version, "parent_version": v.parent_version, "text_hash": v.text_hash}

    @tool
    def state_recap(self):
        return self.journal.recap(self.ledger)

    def message(self, goal: str) -> str:
        """What an agent is told: the state of the research, and its goal."""
        return f"{self.journal.recap(self.ledger)}\n\n# Goal\n{goal}"

    def headline(self) -> dict:
        """Five numbers of the last run; nothing before one."""
        return {k: self.runs[-1][2].get(k) for k in ("sharpe", "gross_sharpe", "ic_ir", "avg_turnover", "max_drawdown")} if self.runs else {}

    @tool
    def list_journal_runs(self, limit: int = 20):
        return [{"run_id": r["run_id"], **{k: r["summary"].get(k) for k in ("sharpe", "ann_return", "avg_turnover", "ic_ir", "max_drawdown")}} for r in self.journal.rows()[-limit:]]

    @tool
    def best_runs(self, k: int = 5):
        return [r.asDict() for r in stores.top_runs(self.journal.frame(self.spark), k).select("run_id", "sharpe").collect()]

    def _construct(self, method: str):
        _, result, _ = self.last
        df = result.signal.withColumn("ret", features.pct_change(F.col("adj_close")))
        thresholds = {h.metric: h.threshold for h in self.policy.hard_constraints}
        self.candidate, self.method = construct.from_policy(df, method, thresholds).persist(), method
        return risk.construction_summary(self.candidate).first().asDict()

    @tool
    def construct_signal_weighted(self):
        return self._construct("signal_weighted")

    @tool
    def construct_mean_variance(self):
        return self._construct("mean_variance")

    @tool
    def construct_risk_parity(self):
        return self._construct("risk_parity")

    @tool
    def evaluate_candidate(self):
        """Costs by the policy's model (with its capital), the risk report of the weights with their net returns, and a
        verdict.  Without a candidate the last run's weights are taken."""
        if self.candidate is not None:
            weights, source = self.candidate, f"candidate_weights ({self.method})"
        elif self.runs:
            weights, source = self.last[1].weights, "fallback_to_alpha_backtest_weights"
        else:
            return {"error": "there is no candidate, and nothing has run yet"}
        c = self.policy.cost_model
        weights = weights.persist()
        costs = accounting.cost_model(c.type, weights, flat_bps=c.flat_bps, half_spread_bps=c.half_spread_bps, impact_coefficient=c.impact_coefficient, capital=c.capital)
        one = risk.candidate(weights, costs).first().asDict()
        metrics = risk.all_metrics(weights, risk.net_returns(weights, costs))
        found = risk.report(metrics, policies.hard_frame(self.spark, self.policy), policies.soft_frame(self.spark, self.policy))
        return {**found, **one, "weights_source": source, "verdict": "APPROVED" if found["passes_policy"] else "REJECTED"}


def from_policy(policy: policies.Policy) -> backtest.Config:
    """The run settings that a policy fixes."""
    return backtest.Config(neutral_defaults(), min_dollar_vol=policy.universe.min_dollar_vol_usd, cost_bps=policy.cost_model.flat_bps)


def neutral_defaults() -> dict[str, float]:
    return {"mom_12_1": 1.0, "reversal_5d": 1.0, "volume_shock": 0.5}
