"""The policy cycle: agents in turn, a verdict, and promotion of text versions.  Agents are callables that are passed in;
there is no network here.  A dry run renders text only."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from ..operators.stores import threshold_value
from . import policy as policies

AGENTS = ("alpha", "portfolio", "cost_risk", "critic")
CARRIED = 2500  # characters of each earlier answer that the next agent sees


@dataclass
class Version:
    agent: str
    version: int
    text: str
    rationale: str = ""
    parent_version: int | None = None
    promoted: bool = False
    rolled_back: bool = False
    metrics: dict = field(default_factory=dict)
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    @property
    def text_hash(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()[:16]


class Versions:
    """One JSON file per version."""

    def __init__(self, root: str):
        self.root = Path(root)

    def _path(self, agent: str, n: int) -> Path:
        return self.root / agent / f"v{n:04d}.json"

    def list(self, agent: str) -> list[Version]:
        return [Version(**json.loads(p.read_text())) for p in sorted((self.root / agent).glob("v*.json"))]

    def latest(self, agent: str) -> Version | None:
        return next(reversed(self.list(agent)), None)

    def latest_promoted(self, agent: str) -> Version | None:
        return next((v for v in reversed(self.list(agent)) if v.promoted and not v.rolled_back), None)

    def save(self, v: Version) -> Version:
        path = self._path(v.agent, v.version)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(v)))
        return v

    def propose(self, agent: str, text: str, rationale: str) -> Version:
        if agent not in (*AGENTS, "meta"):
            raise ValueError(f"unknown agent {agent!r}")
        if len(text) < 200 or len(rationale) < 30:
            raise ValueError("a proposal needs 200 characters of text and 30 of rationale")
        last = self.latest(agent)
        return self.save(Version(agent, last.version + 1 if last else 1, text, rationale, last.version if last else None))

    def promote(self, v: Version, metrics: dict) -> Version:
        v.promoted, v.metrics = True, metrics
        return self.save(v)

    def rollback(self, v: Version) -> Version:
        v.rolled_back = True
        return self.save(v)

    def diff(self, agent: str, a: int, b: int) -> list[tuple[str, str]]:
        """('-', line) and ('+', line) where the two texts differ, position by position."""
        x, y = ({v.version: v for v in self.list(agent)}[n].text.split("\n") for n in (a, b))
        out = []
        for k in range(max(len(x), len(y))):
            p, q = (s[k] if k < len(s) else None for s in (x, y))
            if p != q:
                out += [(sign, line) for sign, line in (("-", p), ("+", q)) if line is not None]
        return out


def verdict(text: str | None, dry: bool = False) -> str:
    if dry or text is None:
        return "DRY_RUN"
    return next((v for v in ("VETOED", "AUDIT_REQUIRED", "APPROVED") if v in text.upper()), "AUDIT_REQUIRED")


def run_cycle(policy: policies.Policy, invoke: Callable[[str, str], str] | None = None) -> dict:
    """Agents see the policy and the (cut) answers before theirs; the first failure ends the cycle with ERROR."""
    if found := policies.errors(policy):
        raise ValueError("; ".join(found))
    said: dict[str, str] = {}
    for agent in AGENTS:
        message = "\n\n".join([policies.render(policy), *(f"{a}:\n{t[:CARRIED]}" for a, t in said.items())])
        if invoke is None:
            said[agent] = f"[dry run] {agent} would see {len(message)} characters"
            continue
        try:
            said[agent] = invoke(agent, message)
        except Exception as e:  # noqa: BLE001
            return {"outputs": said, "verdict": "ERROR", "error": f"{agent}: {e}"}
    return {"outputs": said, "verdict": verdict(said["critic"], dry=invoke is None)}


def decide(policy: policies.Policy, before: dict, after: dict) -> str:
    """Promotion of a version from holdout numbers (n_obs, sharpe, avg_turnover) of the old and the new text."""
    if after.get("n_obs", 0) < policy.holdout.min_observations:
        return "INSUFFICIENT"
    if (after.get("sharpe") or 0.0) - (before.get("sharpe") or 0.0) <= threshold_value(policy.holdout.bonferroni_n_tests):
        return "NO_IMPROVEMENT"
    caps = [h.threshold for h in policy.hard_constraints if h.metric == "avg_turnover" and h.op == "<="]
    return "IPS_VIOLATION" if any((after.get("avg_turnover") or 0.0) > c for c in caps) else "PROMOTED"


def run_meta_cycle(policy: policies.Policy, versions: Versions, measure: Callable[[Version], tuple[dict, dict]]) -> dict[str, str]:
    """Decides every version that is neither promoted nor rolled back; rejected ones stay pending."""
    out = {}
    for agent in AGENTS:
        for v in versions.list(agent):
            if not v.promoted and not v.rolled_back:
                before, after = measure(v)
                out[f"{agent} v{v.version}"] = decision = decide(policy, before, after)
                if decision == "PROMOTED":
                    versions.promote(v, after)
    return out


def orchestrate(policy_path: str, folder: str, in_sample=None, holdout=None, invoke: Callable[[str, str], str] | None = None, versions: Versions | None = None, measure=None) -> dict:
    """From a policy file to a saved cycle.  in_sample, holdout: callables policy -> session, called only for a live run, and
    the holdout only where versions are decided: measure(version, in-sample session, holdout session) gives the numbers of
    the text before and after.  Without `invoke` it is a dry run."""
    policy = policies.load(policy_path)
    if found := policies.errors(policy):
        raise ValueError("; ".join(found))
    live = invoke is not None
    session = in_sample(policy) if live and in_sample else None
    out = run_cycle(policy, invoke)
    if session is not None:
        out["alpha_metrics"] = session.headline()
    if versions is not None and measure is not None:
        hidden = holdout(policy) if live and holdout else None
        out["promotions"] = run_meta_cycle(policy, versions, lambda v: measure(v, session, hidden))
    out["saved"] = save_cycle(out, folder)
    return out


def save_cycle(cycle: dict, folder: str) -> str:
    path = Path(folder) / f"cycle-{datetime.now(timezone.utc):%Y%m%d-%H%M%S}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(cycle, indent=2, default=str))
    return str(path)


def review_prompt(runs: list[dict], most: int = 6000) -> str:
    """Goal, report, tools and the end of the notes of each run."""
    return "\n\n".join(f"Goal: {r.get('goal', '')}\nTools: {', '.join(r.get('tools', []))}\nNotes: {r.get('notes', '')[-most:]}\nReport: {r.get('report', '')}" for r in runs)
