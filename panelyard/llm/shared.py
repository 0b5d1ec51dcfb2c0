"""What the training-data operators have in common: shared scratch tables and byte-exact text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The contract's word pattern and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_watched: list[list[str]] = []


@contextmanager
def watched():
    """Collects the scratch paths that are made inside, for a later discard()."""
    _watched.append(paths := [])
    try:
        yield paths
    finally:
        _watched.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing will read again."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python by their bytes: texts may be long, and 10,000 of them no batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where that setting is missing and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelyard-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    return path


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """A scratch table that results may still read goes when the driver ends (the pipeline deletes its own earlier)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored(df: DataFrame, label: str, fmt: str = "parquet", **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and every executor can read it again."""
    lean(df.sparkSession)
    path = scratch(df.sparkSession, label)
    df.write.options(**options).format(fmt).save(path)
    kept_until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def folded(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty.  lower() is enough (and faster) where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


BUCKET_BITS = 32768  # of one bitmap of bitmap_construct_agg()
LEAST_BITS, MOST_BITS = 1 << 21, 1 << 27  # of a filter: 256 KiB to 16 MiB as a broadcast


def filter_bits(n: int) -> int:
    """Bits of a filter over n values: 16 a value within the bounds; beyond them it clears less, and is never wrong."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length())) if n else LEAST_BITS


def marked(rows: DataFrame, wanted: DataFrame, column: str, bits: int = LEAST_BITS) -> tuple[DataFrame, str]:
    """rows with one more column, whose name comes second: false only if `column` is surely not among `wanted`."""
    tag = uuid.uuid4().hex[:12]  # no column of the input has such a name
    slot, block, marks_col, byte, hit = (f"_{x}_{tag}" for x in ("slot", "block", "marks", "byte", "hit"))
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    marks = wanted.select(place.alias(slot)).select(F.floor(F.col(slot) / BUCKET_BITS).alias(block), (F.col(slot) % BUCKET_BITS).alias("at"))
    marks = marks.groupBy(block).agg(F.bitmap_construct_agg("at").alias(marks_col))  # at most bits / BUCKET_BITS rows
    rows = rows.withColumn(slot, place).withColumn(block, F.floor(F.col(slot) / BUCKET_BITS))
    value = F.conv(F.hex(F.substring(marks_col, ((F.col(slot) % BUCKET_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(marks), block, "left").withColumn(byte, F.coalesce(value, F.lit(0)))
    return found.withColumn(hit, F.expr(f"shiftright({byte}, cast({slot} % 8 as int)) & 1 = 1")).drop(block, slot, marks_col, byte), hit


def maybe_in(rows: DataFrame, wanted: DataFrame, column: str, bits: int = LEAST_BITS) -> DataFrame:
    """Rows whose `column` may be among `wanted`: a bitmap test in the scan, with false positives, no false negatives.

    The bitmap has `bits` bits (see filter_bits), at most MOST_BITS, so that it can be broadcast."""
    found, hit = marked(rows, wanted, column, bits)
    return found.where(F.col(hit)).drop(hit)


def without(rows: DataFrame, ids: DataFrame, column: str, bits: int = LEAST_BITS) -> DataFrame:
    """Anti-join that moves only rows which the bitmap does not clear; nulls stay."""
    found, hit = marked(rows, ids, column, bits)
    clear, rest = found.where(~F.col(hit)), found.where(F.col(hit)).join(ids, column, "left_anti")
    return clear.select(*rows.columns).unionByName(rest.select(*rows.columns))


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) of an undirected graph (u, v) of longs: root is the component's smallest node.  Only nodes with an
    edge appear.  Alternating large-star and small-star steps; each ends in a stored table, so lineage stays short."""

    def sign(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = sign(e)
    for _ in range(most):
        # small star first: it folds what a node is linked to onto its smallest neighbour, which shrinks the table
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        pulled = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(pulled.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        after = sign(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components() did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
