"""Documents to training tokens in five stages: STAGES, run() and its queries' registration as `pipeline`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  Scratch tables of a stage are deleted when the next
one starts: by then its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard.llm import byte_bpe, exact_dedup, jaccard, mixing, shared, toxicity

_before: list[str] = []  # scratch tables of the stage before


def _stage(function):
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.discard(spark, _before)
        with shared.watched() as made:
            out = function(spark, docs, sf_dir)
        _before.extend(made)
        return out

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


def _named(docs: DataFrame) -> DataFrame:
    """docs with `_name`: rows that repeat an id are documents of their own (no two have one text after exact dedup)."""
    return docs.withColumn("_name", F.xxhash64("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


@_stage
def toxicity_stage(spark, docs, sf_dir):
    """Documents that the classifier scores 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


@_stage
def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased) the document with the largest id stays."""
    return exact_dedup.survivors(docs)


@_stage
def jaccard_stage(spark, docs, sf_dir):
    """Of documents linked by 5-word shingles at 0.8 or more, the one with the smallest id stays."""
    rows = _named(docs)
    near = jaccard.join(rows, words=5, num=80, den=100, id_col="_name").where("doc_id <> component_id").select(F.col("doc_id").alias("_name"), "component_id")
    near = shared.stored(near, "pipeline-near")
    # a component goes by one of its names, and the document with the smallest id may be another one
    members = near.unionByName(near.select(F.col("component_id").alias("_name"), "component_id")).distinct()
    members = shared.stored(shared.maybe_in(rows.select("doc_id", "_name"), members, "_name").join(members, "_name").distinct(), "pipeline-members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_name"))).getField("_name").alias("_first"))
    lost = members.join(first, "component_id").where("_name <> _first").select("_name")
    return shared.without(rows, shared.stored(lost, "pipeline-lost"), "_name").select(*docs.columns)


@_stage
def mixing_stage(spark, docs, sf_dir):
    """Every document is repeated as often as the mix takes it."""
    rows = _named(docs)
    copies = mixing.mix(rows, also=("_name",)).where("copies > 0").select("_name", F.col("copies").alias("_copies"))
    taken = rows.join(copies, "_name")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


@_stage
def bpe_stage(spark, docs, sf_dir):
    """Token ids of every document, and digests of the ids and of what they decode to."""
    return byte_bpe.digests(byte_bpe.round_trip(docs), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

ORACLE_SQL = None  # hashing, learned weights and tokenizers are beyond SQL: tests/llm compares with brute force


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list[str] = []
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        path = shared.scratch(spark, f"pipeline-{name.split()[0]}")
        out.write.parquet(path)
        shared.discard(spark, done)  # the stage's input has been read for the last time
        done.append(path)
        docs = spark.read.parquet(path)
    return docs
