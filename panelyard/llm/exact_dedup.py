"""Exact dedup with a log-structured merge index of text digests, in DataFrame functions only.

* Flush: every scan task is a memtable.  It writes one run of (digest, doc_id, ...) rows, sorted by digest, as a
  Parquet file with statistics and a Bloom filter on the digest (`flush`).
* Compaction: all runs are merged into one row per digest, with its smallest and largest id and the number of its
  rows; partial aggregation in the map tasks means that a hot digest travels once per task (`compact`).
* Byte verification: only rows whose digest was hit more than once are looked at again.  A filter over the hits, sized by
  their number and small enough to broadcast (shared.filter_bits), drops nearly all other rows in the scan, before
  anything moves; grouping the rest by (digest, bytes) settles which hits are the same bytes.  Where two texts share a digest, the rows of that
  digest are kept apart by their bytes, so a collision costs time and never a document.
  The filter is read a second time over the runs: rows that it clears are groups of one and never move again.
* Growing (`ingest`): a batch is a new run on level 0; FAN runs of one level are compacted into one run of the next, so
  that each digest is rewritten once a level.  `lookup` asks the levels for a batch of new documents: a bitmap filter of
  the batch prunes each run before the join, and `verified` settles hits by their bytes.  The Bloom filters in the files
  prune row groups for readers that ask for few digests (`find`).

Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest id stays
(keep="largest"; "smallest" is the usual choice of a growing index).  Edge cases: a null text counts as empty, and so
equals empty ones; a null id is smaller than any other; rows that repeat an id are separate rows with one keep_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import filter_bits, folded, marked, maybe_in, stored, without

FAN = 4  # runs of one level that are compacted into one of the next


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """Sorted runs with filters, one per scan task.  digest: Column -> Column, SHA-256 unless a test wants collisions."""
    text = folded(F.col(text_col))
    sha = F.sha2(text.cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256"), (digest(text) if digest else sha).alias("digest"))
    return stored(rows.sortWithinPartitions("digest"), "dedup-runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"})


def compact(runs: DataFrame) -> DataFrame:
    """One row per digest: smallest and largest id, rows.  Of runs as flush() writes them, or of compacted ones."""
    if "n" in runs.columns:
        merged = runs.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
    else:
        merged = runs.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count("*").alias("n"))
    return stored(merged.sortWithinPartitions("digest"), "dedup-index", **{"parquet.bloom.filter.enabled#digest": "true"})


def ingest(levels: list[list[DataFrame]], docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[DataFrame]]:
    """The index with a batch more: levels[k] has fewer than FAN compacted runs, each some FAN times those of levels[k-1]."""
    out = [list(runs) for runs in levels] or [[]]
    out[0].append(compact(flush(docs, id_col, text_col)))
    for k in range(len(out)):
        if len(out[k]) >= FAN:
            union = out[k][0]
            for run in out[k][1:]:
                union = union.unionByName(run)
            if k + 1 == len(out):
                out.append([])
            out[k + 1].append(compact(union))
            out[k] = []
    return out


def find(levels: list[list[DataFrame]], digests: list[str]) -> DataFrame:
    """The index rows of a few digests; statistics and Bloom filters skip row groups without them."""
    few = [run.where(F.col("digest").isin(digests)) for runs in levels for run in runs]
    out = few[0]
    for run in few[1:]:
        out = out.unionByName(run)
    return out.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))


def lookup(levels: list[list[DataFrame]], docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New documents (doc_id, digest) with `smallest`: the smallest id that the index has for their digest, and `known`."""
    text = folded(F.col(text_col))
    new = stored(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest")), "dedup-batch")
    asked = new.select("digest").distinct()
    bits = filter_bits(new.count())
    hits = None
    for runs in levels:
        for run in runs:
            part = maybe_in(run, asked, "digest", bits).join(asked, "digest", "left_semi")
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return new.select("doc_id", "digest", F.lit(None).cast("long").alias("smallest"), F.lit(False).alias("known"))
    hits = hits.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.lit(True).alias("known"))
    return new.join(hits, "digest", "left").select("doc_id", "digest", "smallest", F.coalesce("known", F.lit(False)).alias("known"))


def verified(found: DataFrame, docs: DataFrame, known_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits of lookup() whose bytes are the same as those of the document `smallest`: (doc_id, smallest)."""
    text = folded(F.col(text_col)).alias("bytes")
    hits = stored(found.where("known and smallest is not null").select("doc_id", "smallest").distinct(), "dedup-hits")
    new = maybe_in(docs.select(F.col(id_col).alias("doc_id"), text), hits, "doc_id").join(hits, "doc_id")
    old = maybe_in(known_docs.select(F.col(id_col).alias("smallest"), text), hits, "smallest")
    return new.join(old, ["smallest", "bytes"]).select("doc_id", "smallest").distinct()


def dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per document."""
    runs = flush(docs, id_col, text_col, digest)
    index = compact(runs)
    hits = stored(index.where("n > 1").select("digest"), "dedup-hits")
    bits = filter_bits(hits.count())
    text = folded(F.col(text_col))
    full = docs.select(F.col(id_col).alias("doc_id"), text.alias("bytes"), (digest(text) if digest else F.sha2(text.cast("binary"), 256)).alias("digest"))
    full = maybe_in(full, hits, "digest", bits)  # what passes the filter by chance is a group of one
    best = F.max if keep == "largest" else F.min
    proven = full.groupBy("digest", "bytes").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    proven = stored(proven.select("digest", F.sha2(F.col("bytes").cast("binary"), 256).alias("text_sha256"), "keep_id", "n", F.octet_length("bytes").alias("length")), "dedup-proven")
    clash = proven.groupBy("digest", "text_sha256").count().where("count > 1").select("digest")
    if clash.isEmpty():  # no two texts share digest and SHA-256: these two name a proven group
        rows, hit = marked(runs, hits, "digest", bits)
        alone = rows.where(~F.col(hit)).select(*runs.columns, F.lit(None).cast(docs.schema[id_col].dataType).alias("keep_id"), F.lit(1).cast("long").alias("n"))
        out = rows.where(hit).drop(hit).join(proven.select("digest", "text_sha256", "keep_id", "n"), ["digest", "text_sha256"], "left")
        out = out.select(*alone.columns).unionByName(alone)
    else:
        by_bytes = docs.select(F.col(id_col).alias("doc_id"), text.alias("bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
        out = by_bytes.join(by_bytes.groupBy("bytes").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n")), "bytes")
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.  Of rows that repeat the id and the text, one stays."""
    found = stored(dedup(docs, keep, id_col, text_col).where("group_size > 1"), "dedup-found")
    ids = found.where("doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    # rows that an id does not tell apart: ids that come more than once, and rows without an id
    again = maybe_in(docs.select(id_col), ids, id_col).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_id"))
    odd = stored(again.unionByName(found.where("doc_id is null").select(F.col("doc_id").alias("_id"))).distinct(), "dedup-odd")
    lost = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    if odd.isEmpty():
        return without(docs, lost, id_col)
    is_odd = F.col(id_col).eqNullSafe(F.col("_id"))
    out = without(docs, lost.join(odd, is_odd, "left_anti"), id_col)
    rest = out.join(odd, is_odd, "left_anti")
    few = out.join(odd, is_odd, "left_semi").withColumn("_sha", F.sha2(folded(F.col(text_col)).cast("binary"), 256))
    # these go by id and text: a row stays if its text is in no group, or once if its id is the group's
    named = found.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_group")).distinct()
    few = few.join(named, "_sha", "left").where(F.col("_group").isNull() | F.col(id_col).eqNullSafe(F.col("_keep"))).dropDuplicates([id_col, "_sha"])
    return rest.unionByName(few.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
k AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
