"""Where a workspace keeps its files, and the sinks of a run."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Layout:
    root: str

    def bars(self) -> str:
        return f"{self.root}/data/raw"

    def meta(self, name: str) -> str:
        return f"{self.root}/data/meta/{name}"

    def output(self, run: str) -> str:
        return f"{self.root}/outputs/{run}"


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_run(layout: Layout, run: str, result, summary: dict) -> str:
    """returns, weights, per-decile returns and IC as Parquet, the summary as JSON."""
    out = layout.output(run)
    write_table(result.returns, f"{out}/returns")
    write_table(result.weights, f"{out}/weights")
    write_table(result.per_decile, f"{out}/per_decile_returns")
    if result.ic is not None:
        write_table(result.ic, f"{out}/ic")
    Path(out).mkdir(parents=True, exist_ok=True)
    (Path(out) / "summary.json").write_text(json.dumps(summary, default=str, indent=2))
    return out


def save_rows(layout: Layout, run: str, name: str, rows: DataFrame) -> str:
    """A small table (comparison, grid) as Parquet and as JSON records."""
    out = layout.output(run)
    write_table(rows, f"{out}/{name}")
    Path(out).mkdir(parents=True, exist_ok=True)
    (Path(out) / f"{name}.json").write_text(json.dumps([r.asDict() for r in rows.collect()], default=str, indent=2))
    return out


def save_comparison(layout: Layout, run: str, rows: DataFrame) -> str:
    return save_rows(layout, run, "comparison", rows)


def save_grid(layout: Layout, run: str, cells: DataFrame) -> str:
    """`exit` mixes numbers and 'off', so it is a string."""
    return save_rows(layout, run, "grid", cells.withColumn("exit", F.col("exit").cast("string")))


def save_research(folder: str, goal: str, report: str, messages: list[dict], notes: str = "") -> str:
    """A research run for people: goal, report, notes, and the transcript as JSON lines."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    for name, text in (("goal.txt", goal), ("report.md", report), ("notes.md", notes)):
        (at / name).write_text(text)
    (at / "messages.jsonl").write_text("".join(json.dumps(m, default=str) + "\n" for m in messages))
    return str(at)


def load_research(folder: str) -> dict:
    """What review_prompt() takes: goal, report, notes, and the tools in order of use.  Broken lines are skipped."""
    at = Path(folder)
    text = lambda name: (at / name).read_text() if (at / name).exists() else ""
    tools = []
    for line in text("messages.jsonl").splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and row.get("tool"):
            tools.append(row["tool"])
    return {"goal": text("goal.txt"), "report": text("report.md"), "notes": text("notes.md"), "tools": tools}
