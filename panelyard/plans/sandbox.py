"""User features: a function of one ticker's frame (sorted by date), checked before it may run.

The check works by allowlist: only the syntax, names and attributes below, no imports, no private names; shift, pct_change
and diff take literal numbers that are not negative.  Accepted features run by groupBy(ticker).applyInPandas and must
return one value per row.  Looking ahead is tested where it would happen: the feature is computed again on the rows up to
two cuts, and must give there what it gives on all rows.
"""

from __future__ import annotations

import ast
import math

import pandas as pd
from pyspark.sql import DataFrame

# What a feature may name, and which attributes it may use.
BUILTINS = {"abs", "min", "max", "len", "range", "float", "int", "bool", "round", "sum", "zip", "enumerate", "sorted", "list", "dict", "tuple", "set", "any", "all", "isinstance", "ValueError", "True", "False", "None"}
ATTRIBUTES = {
    "abs", "add", "astype", "clip", "corr", "cov", "cummax", "cummin", "cumprod", "cumsum", "diff", "div", "dropna", "ewm", "exp", "expanding", "ffill", "fillna",
    "float64", "index", "isna", "iloc", "inf", "isfinite", "log", "log1p", "mad", "max", "maximum", "mean", "median", "min", "minimum", "mul", "nan", "notna", "pct_change", "prod",
    "quantile", "rank", "replace", "rolling", "shift", "sign", "sqrt", "std", "sub", "sum", "values", "var", "where", "DataFrame", "Series",
}
AHEAD = {"shift", "pct_change", "diff"}
BANNED = (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.ClassDef, ast.AsyncFunctionDef, ast.Await, ast.Yield, ast.YieldFrom, ast.With, ast.Try, ast.Delete)


class Rejected(ValueError):
    """The source is not acceptable."""


def _number(node: ast.AST) -> float | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _number(node.operand)
        return None if inner is None else -inner
    return float(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, int | float) else None


def check(source: str) -> ast.Module:
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise Rejected(f"syntax: {e.msg}") from None
    made = {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in (*n.args, *n.kwonlyargs, *n.posonlyargs)}
    made |= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    for node in ast.walk(tree):
        if isinstance(node, BANNED):
            raise Rejected(f"{type(node).__name__} is not allowed")
        if isinstance(node, ast.Name) and (node.id.startswith("__") or node.id not in made | BUILTINS | {"np", "pd"}):
            raise Rejected(f"name {node.id!r} is not allowed")
        if isinstance(node, ast.Attribute) and node.attr not in ATTRIBUTES:
            raise Rejected(f"attribute {node.attr!r} is not allowed")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in AHEAD:
            for arg in (*node.args[:1], *(k.value for k in node.keywords if k.arg == "periods")):
                number = _number(arg)
                if number is None or number < 0:
                    raise Rejected(f"{node.func.attr} needs a literal number that does not look ahead")
    return tree


def compile_feature(source: str, name: str | None = None):
    """(name, function): the function called `name`, or the only one."""
    import numpy as np

    tree = check(source)
    found = [n.name for n in tree.body if isinstance(n, ast.FunctionDef)]
    if name is None and len(found) != 1:
        raise Rejected("exactly one function is needed")
    name = name or found[0]
    if name not in found:
        raise Rejected(f"no function {name!r}")
    builtins = __builtins__ if isinstance(__builtins__, dict) else vars(__builtins__)
    space = {"__builtins__": {k: builtins[k] for k in BUILTINS if k in builtins}, "np": np, "pd": pd}
    exec(compile(tree, "<feature>", "exec"), space)  # noqa: S102  (checked above)
    return name, space[name]


def looks_ahead(feature, frame: pd.DataFrame, got: pd.Series) -> bool:
    """Whether values change when later rows are not there."""
    import numpy as np

    whole = pd.to_numeric(got, errors="coerce").to_numpy(dtype=float)
    for cut in {len(frame) // 2, len(frame) * 4 // 5} - {0, len(frame)}:
        part = pd.to_numeric(feature(frame.iloc[:cut].copy()), errors="coerce").to_numpy(dtype=float)
        if len(part) != cut or not np.allclose(part, whole[:cut], rtol=1e-6, atol=1e-9, equal_nan=True):
            return True
    return False


def apply(panel: DataFrame, source: str, name: str | None = None) -> DataFrame:
    """panel plus the feature's column; the source travels and is checked again where it runs."""
    name, _ = compile_feature(source, name)
    fields = [c for c in panel.columns if c in ("open", "high", "low", "close", "adj_close", "volume")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx").reset_index(drop=True)
        feature, frame = compile_feature(source, name)[1], pdf[fields].astype(float)
        got = feature(frame.copy())
        if not isinstance(got, pd.Series) or len(got) != len(pdf):
            raise TypeError("a feature returns one value per row")
        if looks_ahead(feature, frame, got):
            raise Rejected("the feature looks ahead: its values change when later rows are taken away")
        value = [None if x is None or not math.isfinite(x) else float(x) for x in got]
        return pd.DataFrame({"date": pdf["date"], "ticker": pdf["ticker"], name: pd.Series(value, dtype=object)})

    got = panel.select("date", "t_idx", "ticker", *fields).groupBy("ticker").applyInPandas(run, f"date date, ticker string, `{name}` double")
    return panel.join(got, ["date", "ticker"], "left")
