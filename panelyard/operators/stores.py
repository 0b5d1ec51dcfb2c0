"""The journal of runs, the forecast ledger, versioned texts and promotion rules, as queries over their JSON rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN_SCHEMA = "run_id string, timestamp string, config struct<feature_weights: map<string,double>, halflife_days: double, weighting: string>, summary map<string,double>"
LEDGER_SCHEMA = "id string, timestamp string, type string, key array<string>, low double, high double, note string, status string, actual double, in_range boolean, miss double, resolved_at string, run_id string"


# -- journal: rows (seq, run_id, sharpe, feature_weights)
def known(x: Column) -> Column:
    """NaN counts as unknown, so that it can be neither the best nor unbeatable."""
    return F.when(~F.isnan(x), x)


def top_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.withColumn("sharpe", known(F.col("sharpe"))).where("sharpe is not null").orderBy(F.desc("sharpe"), "seq").limit(k)


def recent_runs(runs: DataFrame, k: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("seq")).limit(k)


def best_run(runs: DataFrame) -> DataFrame:
    """The earliest of the runs with the largest Sharpe ratio."""
    return runs.where(known(F.col("sharpe")).isNotNull()).agg(F.max_by(F.struct("run_id", "sharpe"), F.struct("sharpe", -F.col("seq"))).alias("b")).select("b.*")


def best_by_feature(runs: DataFrame) -> DataFrame:
    each = runs.where(known(F.col("sharpe")).isNotNull()).select("seq", "run_id", "sharpe", F.explode(F.map_keys("feature_weights")).alias("feature"))
    return each.groupBy("feature").agg(F.max("sharpe").alias("best_sharpe"), F.max_by("run_id", F.struct("sharpe", -F.col("seq"))).alias("run_id"), F.count("*").alias("n_runs"))


# -- ledger: rows (id, type, key array, low, high)
def recorded(forecasts: DataFrame) -> DataFrame:
    """New forecasts: bounds in order, pending."""
    return forecasts.withColumns({"low": F.least("low", "high"), "high": F.greatest("low", "high"), "status": F.lit("pending")})


def resolved(forecasts: DataFrame, actual: str = "actual") -> DataFrame:
    """in_range is closed on both ends; miss is signed from the middle."""
    a = F.col(actual)
    return forecasts.where(a.isNotNull()).withColumns({"in_range": a.between(F.col("low"), F.col("high")), "miss": a - (F.col("low") + F.col("high")) / 2, "status": F.lit("resolved")})


def resolve_pairs(pending: DataFrame, correlations: DataFrame) -> DataFrame:
    """Pending correlation forecasts with the measured value of their pair, in either order."""
    measured = correlations.select(F.sort_array(F.array("a", "b")).alias("_k"), F.col("corr").alias("actual")).dropDuplicates(["_k"])
    return resolved(pending.where("status = 'pending' and type = 'correlation'").withColumn("_k", F.sort_array("key")).join(measured, "_k").drop("_k"))


def resolve_by_type(pending: DataFrame, results: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Every pending forecast of a type takes the run's result (type, actual); its key does not matter."""
    names = rename or {"net_sharpe": "sharpe", "turnover": "avg_turnover"}
    kind = F.coalesce(*[F.when(F.col("type") == a, F.lit(b)) for a, b in names.items()], F.col("type"))
    return resolved(pending.where("status = 'pending'").withColumn("_t", kind).join(F.broadcast(results.withColumnRenamed("type", "_t")), "_t").drop("_t"))


def ledger_summary(done: DataFrame) -> DataFrame:
    miss = F.when(~F.col("in_range"), F.col("miss"))
    return done.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("in_range").cast("long")).alias("n_hits"), F.round(F.avg(F.col("in_range").cast("double")), 3).alias("hit_rate"), F.round(F.avg("miss"), 3).alias("mean_miss"), F.round(F.avg(miss), 3).alias("mean_miss_outside"))


def recent_resolved(done: DataFrame, k: int = 8) -> DataFrame:
    return done.orderBy(F.desc("seq")).limit(k)


# -- versions: rows (agent, version, text, promoted, rolled_back)
def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def version_heads(versions: DataFrame) -> DataFrame:
    """Per agent: latest, latest promoted and not rolled back, and the number the next one gets."""
    live = F.when(F.col("promoted") & ~F.col("rolled_back"), F.col("version"))
    return versions.groupBy("agent").agg(F.max("version").alias("latest"), F.max(live).alias("latest_promoted"), (F.max("version") + 1).alias("next_version"), F.max_by(text_hash(F.col("text")), F.col("version")).alias("latest_hash"))


def line_diff(pairs: DataFrame, old: str = "old", new: str = "new", key: str = "pair") -> DataFrame:
    """(pair, pos, change, old_line, new_line): lines compared by position."""
    lines = lambda c, as_: pairs.select(key, F.posexplode(F.split(c, "\n")).alias("pos", as_))
    both = lines(old, "old_line").join(lines(new, "new_line"), [key, "pos"], "full")
    change = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "removed").when(F.col("old_line") != F.col("new_line"), "changed").otherwise("same")
    return both.select(key, "pos", change.alias("change"), "old_line", "new_line")


def slugify(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(x), r"\W+", "_"), 1, 64)


def valid_proposal(agent: Column, text: Column, rationale: Column, agents: list[str]) -> Column:
    return F.when(~agent.isin(agents), "unknown agent").when(F.length(text) < 200, "text too short").when(F.length(rationale) < 30, "rationale too short").otherwise("ok")


# -- promotion
def bonferroni(tests: Column) -> Column:
    return F.lit(2.0 * 0.3) / F.sqrt(F.greatest(tests, F.lit(1)))


def promotion(cases: DataFrame, least: int = 252, cap: float = 0.5) -> DataFrame:
    """cases: (n_obs, delta, n_tests, avg_turnover)."""
    out = F.when(F.col("n_obs") < least, "INSUFFICIENT").when(F.col("delta") <= bonferroni(F.col("n_tests")), "NO_IMPROVEMENT").when(F.col("avg_turnover") > cap, "IPS_VIOLATION").otherwise("PROMOTED")
    return cases.withColumn("decision", out)


def verdict(text: Column) -> Column:
    t = F.upper(text)
    return F.when(text.isNull(), "DRY_RUN").when(t.contains("VETOED"), "VETOED").when(t.contains("AUDIT_REQUIRED"), "AUDIT_REQUIRED").when(t.contains("APPROVED"), "APPROVED").otherwise("AUDIT_REQUIRED")


def last_notes(text: Column, most: int = 6000) -> Column:
    return F.right(text, F.lit(most))


def sum_weights(weights: Column) -> Column:
    return F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + F.abs(x))


def threshold_value(n: int) -> float:
    """The scalar form of bonferroni()."""
    return 2.0 * 0.3 / math.sqrt(max(1, n))


def windowed_next(df: DataFrame, column: str, key: str, order: str) -> DataFrame:
    return df.withColumn("actual", F.lead(column).over(Window.partitionBy(key).orderBy(order)))
