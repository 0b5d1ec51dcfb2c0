"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows fall into parts by a keyed hash of the id.  2. The driver draws, for the part counts and the exact shard sizes
(at most one row apart), how many rows each part sends to each shard: the row sums are the part counts, the column
sums the shard sizes, and the law is that of a uniform permutation.  3. Every part is permuted locally by a second
keyed hash and cut at the drawn counts.  4. After the exchange, each shard is permuted again by a third keyed hash,
block by block, and rows get gapless slots from 0.

The matrix has parts x shards numbers; the parts grow with the rows so that one part stays near ROWS_PER_PART rows,
within MAX_PARTS.  Only ids, sizes and checksums travel; texts stay in the table.

Edge cases: a null text has 0 bytes (size 1) and checksum 0; equal texts are separate rows; a null id hashes like any
other; an empty table gives no rows; other columns are ignored; a rerun with one seed gives the same shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .shared import stored

ROWS_PER_PART, MIN_PARTS, MAX_PARTS = 500_000, 256, 1 << 17


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` without replacement.  numpy's own sampler ends at 1e9; beyond, inversion of
    the probabilities around the mode, which are summed as far as they count (14 standard deviations)."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad, draws) < 10**9 and good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    mean = draws * (good / n)
    wide = 14 * math.sqrt(max(1.0, mean * (bad / n) * ((n - draws) / max(1, n - 1)))) + 14
    lo, hi = max(lo, math.floor(mean - wide)), min(hi, math.ceil(mean + wide))
    if hi <= lo:
        return lo
    k = np.arange(lo, hi, dtype=np.float64)
    # ratios p(k+1)/p(k), so that no logarithm of a huge factorial is needed
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return lo + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """parts x shards counts: row sums `counts`, column sums at most one apart."""
    rng, total = np.random.default_rng(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        for s in range(shards - 1):
            rest = sum(room[s + 1 :])
            out[p, s] = took = hypergeometric(rng, room[s], rest, n)
            room[s] -= took
            n -= took
        out[p, shards - 1] = n
        room[shards - 1] -= n
    return out


def shard(rows: DataFrame, id_col: str = "doc_id", shards: int = 8, seed: int = 20_240) -> DataFrame:
    """rows plus (shard, slot).  `rows` must be cheap to read again (a stored table)."""
    spark = rows.sparkSession
    total = rows.count()
    parts = min(MAX_PARTS, max(MIN_PARTS, -(-total // ROWS_PER_PART)))
    mixed = lambda k: F.xxhash64(F.lit(seed + k), F.col(id_col))
    rows = rows.withColumn("_part", F.pmod(mixed(0), F.lit(parts)).cast("int"))
    counted = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # at most MAX_PARTS numbers
    counts = [counted.get(p, 0) for p in range(parts)]
    cuts = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])
    plan = spark.createDataFrame([(p, [int(x) for x in cuts[p]]) for p in range(parts)], schema)
    ties = [F.col(c) for c in rows.columns if c not in (id_col, "_part")]
    local = Window.partitionBy("_part").orderBy(mixed(1), F.col(id_col), *ties)
    sent = rows.withColumn("_at", F.row_number().over(local)).join(F.broadcast(plan), "_part")  # bounded: MAX_PARTS rows
    sent = sent.withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_at"))).cast("int"))
    blocks = max(32, parts // shards)
    sent = sent.withColumn("_block", F.pmod(mixed(2), F.lit(blocks)).cast("int")).drop("_part", "_at", "_cuts")
    sent = stored(sent, "shard-sent")
    sums = sent.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_block").orderBy(mixed(3), F.col(id_col), *ties)
    out = sent.withColumn("_at", F.row_number().over(again)).join(starts, ["shard", "_block"])
    return out.withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_block", "_at", "_start")


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shard(stored(docs, "shard-rows"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
