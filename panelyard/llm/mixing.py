"""Mixing sources to target weights by systematic sampling.

Every source's target is its weighted share of all words, capped at `cap` times the words it has; what the caps
cut off is shared again by weight (water filling, in closed form over the sources sorted by cap/weight).  Within a
source every document expects target/source_size copies.  The k-th document of a source, in a fixed order, is taken
floor(k*e + u) - floor((k-1)*e + u) times: one copy for each integer boundary that its stretch of the prefix sum
crosses, after one offset u per source.  As e is the same within a source, the prefix sum is rank * e, and the rank
comes from counts per (source, size class, hash part), so that no task ever holds a whole source.  Ordering by size
class keeps the taken words close to the target.

Edge cases: a null text has 0 words; a null source is a source of its own and comes last; an empty table gives an
empty result; repeated rows are separate documents; other columns are ignored; texts without words are taken 0 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import stored, word_count

PARTS = 256  # hash parts of one (source, size class)


def size_class(size):
    """Sizes that agree in their bit length and three bits below the highest share a class (within 12.5 %)."""
    bits = F.char_length(F.bin(size))
    return (bits * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0))))).cast("int")


def targets(rows: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, offset) for rows with (source, size); sources are few beside the rows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    share = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = share.withColumn("nth", F.row_number().over(by_name))
    share = share.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") - 1) % len(weights) + 1))
    share = share.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(by_room), F.lit(0.0))
    share = share.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))))
    # The level rises while sources are capped and falls behind the first one that is not: its maximum is the final one.
    share = share.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return share.select("source", "nth", "source_size", "target", offset.alias("offset"))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: how often the mix takes each document, and in words.

    Columns in `also` come along, and tell rows apart that repeat an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *also)
    rows = stored(rows, "mix-sizes")
    share = targets(rows, weights, cap)
    share = stored(share, "mix-targets")
    part = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int") % PARTS
    rows = rows.withColumns({"class": size_class(F.col("size")), "part": part})
    placed = rows.alias("r").join(share.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("doc_id", "size", "class", "part", "nth", "source_size", "target", "offset", *also)
    placed = stored(placed, "mix-rows")
    counts = placed.groupBy("nth", "class", "part").agg(F.count("*").alias("n"))
    classes = counts.groupBy("nth", "class").agg(F.sum("n").alias("n"))
    ahead = (Window.unboundedPreceding, -1)
    classes = classes.select("nth", "class", F.coalesce(F.sum("n").over(Window.partitionBy("nth").orderBy("class").rowsBetween(*ahead)), F.lit(0)).alias("base"))
    parts = counts.select("nth", "class", "part", F.coalesce(F.sum("n").over(Window.partitionBy("nth", "class").orderBy("part").rowsBetween(*ahead)), F.lit(0)).alias("inner"))
    starts = parts.join(classes, ["nth", "class"]).select("nth", "class", "part", (F.col("base") + F.col("inner")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("nth", "class", "part").orderBy("size", F.col("doc_id").asc_nulls_last(), *also))
    ranked = placed.withColumn("rank", rank).join(starts, ["nth", "class", "part"])
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    k = (F.col("start") + F.col("rank")).cast("double")
    copies = (F.floor(k * expected + F.col("offset")) - F.floor((k - 1) * expected + F.col("offset"))).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *also).withColumn("taken", F.col("copies") * F.col("size"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, ((nth - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0::DOUBLE)) AS level
       FROM s2 WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap, (max(level) OVER ()) * weight) AS target, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s3),
r AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.u,
        row_number() OVER (PARTITION BY s4.nth ORDER BY length(bin(d.size)) * 16 + floor(d.size / pow(2.0, greatest(length(bin(d.size)) - 4, 0))),
            ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 2))::BIGINT, d.size, d.doc_id NULLS LAST)::DOUBLE AS k
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (floor(k * (target / source_size::DOUBLE) + u) - floor((k - 1) * (target / source_size::DOUBLE) + u))::BIGINT * size END::BIGINT AS taken
FROM r
"""
