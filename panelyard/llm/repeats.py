"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts somewhere else.

Suffixes are sorted block by block, one suffix bucket at a time, and long ties are resolved by the ranks of a difference
cover's sample.  As strings of LENGTH bytes decide, suffixes are cut there, and those that cannot matter are never made:

1. Texts that are the same as a whole are settled by their SHA-256: one of them stands for all, and all of its bytes go
   if there are at least LENGTH.
2. A suffix falls into the bucket of the smallest hash of the GRAM-byte strings in its first LENGTH bytes.  Equal strings
   share a bucket, and a bucket's suffixes in a text are runs, some 170 suffixes long.  Buckets are counted over all
   texts; a bucket with one run and one occurrence holds nothing repeated and is dropped.
3. The runs of the other buckets travel as their bytes, once.  A task takes whole buckets, block by block (BLOCK_BYTES):
   * the sample: positions whose place in their run is in a difference cover modulo PERIOD (5 of 16), so that any two
     suffixes i, j have a distance d < PERIOD at which i + d and j + d are both in it.  Its strings of LENGTH - PERIOD
     bytes are ranked by prefix doubling, which is exact;
   * the block's suffixes are sorted by bucket, first PERIOD bytes and last PERIOD bytes of the LENGTH;
   * ties are resolved by the cover: for each distance d, ranks at i + d order the tied suffixes that have it, and equal
     ones are the same in all LENGTH bytes.  Each suffix is looked up at 5 distances; nothing is compared in pairs.
   No hash decides there, bytes do.  Runs with the same bytes are sorted once.
4. A bucket with more than HOT_BYTES of runs is never in one task: its strings are counted by a fingerprint of 128 bits
   with partial aggregation, and joined back.
5. Repeated strings become spans; texts are cut in one pass.

Which buckets repeat is known to the second scan by a bitmap while there are at most BROADCAST_BUCKETS; beyond that runs
are joined to the buckets as rows (bucket, text, place), and texts to their runs.  Either way there is one second scan.

Edge cases: a null text counts as empty; shorter texts keep all bytes; strings never cross documents, overlapping
occurrences count, and strings are judged on the input; spans may cut through a character, so kept texts are bytes;
rows that repeat an id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from .arrowio import slices, tidy
from .shared import BUCKET_BITS, filter_bits, maybe_in, stored, without

LENGTH, GRAM, PERIOD = 400, 64, 16  # LENGTH: whole periods, two at least
CHUNK = 1 << 19  # suffixes of one text that are in work at a time
TASK_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20  # of runs in one task, and in work at a time
HOT_BYTES = 8 << 20  # of one bucket's runs
BROADCAST_BUCKETS = 1 << 23
BUCKET_FILTER, HOT_FILTER = 1 << 27, 1 << 21  # bits: 16 MiB and 256 KiB at most
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd; of the two polynomials
ID = 16  # bytes of a text's SHA-256 that name it between stages


class Powers:
    """base^i and base^-i modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.back, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 16, 2 * n)
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.n, b, np.uint64)), dtype=np.uint64) for b in (self.base, self.back))
        return self.up, self.down


_powers = [Powers(b) for b in BASES]


def fingerprints(data: np.ndarray, size: int, which: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes."""
    up, down = _powers[which].upto(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        x = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, length: int, gram: int, count: bool = False) -> Iterator[tuple]:
    """(bucket, first window, windows, 1 or 2) arrays of a text, chunk by chunk.  2: a bucket whose smallest hash occurs
    more than once in the run's bytes (known only if asked for)."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, CHUNK):
        grams = fingerprints(data[at : at + CHUNK + length - 1], gram, 0)
        least = sliding_minimum(grams, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        many = np.diff(np.append(first, len(least)))
        twice = np.ones(len(first), np.int64)
        if count:
            ends = first + many + length - gram
            twice = np.array([min(2, np.count_nonzero(grams[a:b] == v)) for a, b, v in zip(first, ends, least[first], strict=True)], np.int64)
        yield least[first], first + at, many, twice


def counted(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """bucket, n (1 or 2), size (bytes) for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(b.view(np.int64), n, m + length - 1) for x in part.column("text").to_pylist() for b, _, m, n in runs(x, length, gram, True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], ["bucket", "n", "size"])

    return rows.select("text").mapInArrow(tidy(run), "bucket bigint, n bigint, size bigint")


def bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """One bit per bucket (its low bits), as bytes: bits / 8 of them, whatever the input."""
    low = F.expr(f"bucket & {bits - 1}L").alias("s")
    marks = buckets.select(low).select(F.floor(F.col("s") / BUCKET_BITS).alias("b"), (F.col("s") % BUCKET_BITS).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in marks.collect():  # at most bits / BUCKET_BITS rows of 4 KiB
        part = np.frombuffer(r["bits"], np.uint8)
        at = r["b"] * (BUCKET_BITS // 8)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def has(marks: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    low = buckets & np.uint64(len(marks) * 8 - 1)
    return (marks[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


COLD, HOT = "bucket bigint, did binary, at bigint, data binary", "bucket bigint, did binary, at bigint, print bigint, print2 bigint"


def cold_batch(found: list[tuple]) -> pa.RecordBatch:
    """Runs as they travel, from (bucket, did, at, data)."""
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["bucket", "did", "at", "data"])


def hot_batch(found: list[tuple], length: int) -> pa.RecordBatch:
    """Fingerprints of each string in the runs (bucket, did, at, data)."""
    data = [np.frombuffer(f[3], np.uint8) for f in found]
    many = [len(x) - length + 1 for x in data]
    row = np.repeat(np.arange(len(found)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.array([f[2] for f in found])[row]
    prints = [pa.array(np.concatenate([fingerprints(x, length, which) for x in data]).view(np.int64)) for which in (1, 0)]
    return pa.RecordBatch.from_arrays([pa.array(np.array([f[0] for f in found])[row]), pa.array([f[1] for f in found], pa.binary()).take(pa.array(row)), pa.array(place), *prints], ["bucket", "did", "at", "print", "print2"])


def sent(found: list[tuple], length: int, hot: bool, last: bool, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; empties `found` when it sends."""
    if found and (last or sum(len(f[3]) for f in found) > most):
        yield hot_batch(found, length) if hot else cold_batch(found)
        found.clear()


def picked(rows: DataFrame, marks, hot, length: int, gram: int, want_hot: bool) -> DataFrame:
    """Runs of repeated buckets, by bitmaps: COLD, or HOT for the strings of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, heated = marks.value, hot.value
        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for did, text in zip(part.column("did").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for bucket, first, many, _ in runs(text, length, gram):
                        take = has(wanted, bucket) & (has(heated, bucket) == want_hot)
                        out += [(b, did, s, text[s : s + n + length - 1]) for b, s, n in zip(bucket[take].view(np.int64).tolist(), first[take].tolist(), many[take].tolist(), strict=True)]
                        yield from sent(out, length, want_hot, False)
                yield from sent(out, length, want_hot, True)

    return rows.select("did", "text").mapInArrow(tidy(run), HOT if want_hot else COLD)


def joined(rows: DataFrame, buckets: DataFrame, length: int, gram: int) -> DataFrame:
    """(did, text, runs) of texts with runs in `buckets` (bucket, hot): the way without a bitmap."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for did, text in zip(part.column("did").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for bucket, first, many, _ in runs(text, length, gram):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array([did] * len(first), pa.binary()), pa.array(first), pa.array(many)], ["bucket", "did", "at", "many"])

    found = rows.select("did", "text").mapInArrow(tidy(places), "bucket bigint, did binary, at bigint, many bigint").join(buckets, "bucket")
    of_text = found.groupBy("did").agg(F.collect_list(F.struct("bucket", "at", "many", "hot")).alias("runs"))  # no more than the text itself
    return stored(rows.join(of_text, "did").select("did", "text", "runs"), "repeat-joined")


def from_joined(rows: DataFrame, length: int, want_hot: bool) -> DataFrame:
    """What picked() gives, from joined()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for did, text, found in zip(*(part.column(c).to_pylist() for c in ("did", "text", "runs")), strict=True):
                    for r in found:
                        if r["hot"] == want_hot:
                            out.append((r["bucket"], did, r["at"], text[r["at"] : r["at"] + r["many"] + length - 1]))
                            yield from sent(out, length, want_hot, False)
                yield from sent(out, length, want_hot, True)

    return rows.mapInArrow(tidy(run), HOT if want_hot else COLD)


# -- sorting a block
@functools.lru_cache
def cover(period: int) -> np.ndarray:
    """A smallest set whose differences are all residues modulo `period`."""
    for size in itertools.count(1):
        for some in itertools.combinations(range(1, period), size - 1):
            chosen = (0, *some)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return np.array(chosen)
    raise AssertionError


def ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        x = key[order]
        new[1:] |= x[1:] != x[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(parts: list[bytes], bucket: np.ndarray, length: int, period: int) -> np.ndarray:
    """For each suffix of the runs `parts` (run after run), whether its first `length` bytes come again in the block."""
    sizes = np.array([len(x) for x in parts], np.int64)
    many, starts = sizes - length + 1, np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts) + bytes(length + 8), np.uint8)
    total = len(data) - length - 8
    words = np.zeros(total + length, np.uint64)  # eight bytes from each place on, as a number
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    ends = lambda at: [words[at + k] for k in range(0, period, 8)]
    # the sample, and the ranks of its strings of length - period bytes
    wanted = np.isin(np.arange(period), cover(period))
    inside = np.arange(total) - np.repeat(starts, sizes)
    sample = np.flatnonzero(wanted[inside % period])
    del inside
    rank = np.zeros(total + length, np.int32)
    rank[sample] = ranked(*ends(sample))
    size, goal = period, length - period
    while size < goal:  # the last step overlaps
        step = min(size, goal - size)
        rank[sample] = ranked((rank[sample].astype(np.uint64) << np.uint64(32)) | rank[sample + step].astype(np.uint64))
        size += step
    # suffixes, sorted by bucket and both ends
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(parts)), many)
    inside = np.arange(len(row)) - np.repeat(first, many)
    at = inside + starts[row]
    group = ranked(bucket[row], *ends(at), *ends(at + goal))
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    group, at, inside = group[tied], at[tied], inside[tied]
    # ties, by the ranks at each distance
    again = np.zeros(len(tied), bool)
    for d in range(period):
        mine = np.flatnonzero(wanted[(inside + d) % period])
        key = (group[mine].astype(np.uint64) << np.uint64(32)) | rank[at[mine] + d].astype(np.uint64)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again[mine[order[1:][same]]] = True
        again[mine[order[:-1][same]]] = True
    out = np.zeros(len(row), bool)
    out[tied] = again
    return out


def spans(again: np.ndarray, parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each run, the stretches (first, last) of its suffixes that are repeated."""
    many = np.array([len(x) - length + 1 for x in parts], np.int64)
    row = np.repeat(np.arange(len(parts)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    edge = row[1:] != row[:-1]
    begin = again & np.concatenate([[True], ~again[:-1] | edge])
    end = again & np.concatenate([~again[1:] | edge, [True]])
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for r, a, b in zip(row[begin].tolist(), place[begin].tolist(), place[end].tolist(), strict=True):
        out[r].append((a, b))
    return out


def matcher(length: int, period: int = PERIOD):
    """applyInArrow over whole buckets: stretches of repeated suffixes (did, low, high), block by block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table.column("bucket")))
        bucket, at = table.column("bucket").to_numpy(), table.column("at").to_numpy()
        data, did = table.column("data"), table.column("did")
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        out: list[tuple] = []
        parts: dict[bytes, list[int]] = {}  # the block: equal runs are of one bucket, and sorted once

        def solve() -> None:
            keys = list(parts)
            again = repeated(keys, np.array([bucket[parts[k][0]] for k in keys]), length, period)
            for key, found in zip(keys, spans(again, keys, length), strict=True):
                rows = parts[key]
                for a, b in [(0, len(key) - length)] if len(rows) > 1 else found:
                    out.extend((did[r].as_py(), int(at[r]) + a, int(at[r]) + b) for r in rows)
            parts.clear()

        size = 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for r in range(a, b):
                key = data[r].as_py()
                rows = parts.setdefault(key, [])
                size += 0 if rows else len(key)
                rows.append(r)
            if size > BLOCK_BYTES:
                solve()
                size = 0
        if parts:
            solve()
        return pa.table({"did": pa.array([o[0] for o in out], pa.binary()), "low": pa.array([o[1] for o in out], pa.int64()), "high": pa.array([o[2] for o in out], pa.int64())})

    return run


def windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, period: int = PERIOD, hot_bytes: int = HOT_BYTES, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """(did, low, high): stretches of repeated suffixes, for different texts (did, text binary)."""
    spark = rows.sparkSession
    buckets = stored(counted(rows, length, gram).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > 1"), "repeat-buckets")
    is_hot = F.col("size") > hot_bytes
    total = buckets.agg(F.count("*").alias("buckets"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max(is_hot), F.lit(False)).alias("hot")).first()
    if total["buckets"] <= broadcast_buckets:
        marks = spark.sparkContext.broadcast(bitmap(buckets, min(BUCKET_FILTER, filter_bits(total["buckets"]))))
        hot = spark.sparkContext.broadcast(bitmap(buckets.where(is_hot), HOT_FILTER))
        take = lambda want: picked(rows, marks, hot, length, gram, want)
    else:
        texts = joined(rows, buckets.select("bucket", is_hot.alias("hot")), length, gram)
        take = lambda want: from_joined(texts, length, want)
    tasks = max(1, -(-total["bytes"] // TASK_BYTES))
    found = take(False).withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks))).groupBy("task").applyInArrow(matcher(length, period), "did binary, low bigint, high bigint")
    if total["hot"]:
        prints = stored(take(True), "repeat-prints")
        key = ["bucket", "print", "print2"]
        often = stored(prints.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeat-often")
        again = prints.join(often, key).select("did", "at").distinct()
        place = F.col("at") - F.row_number().over(Window.partitionBy("did").orderBy("at"))  # the same in a stretch
        found = found.unionByName(again.withColumn("stretch", place).groupBy("did", "stretch").agg(F.min("at").alias("low"), F.max("at").alias("high")).drop("stretch"))
    return stored(found, "repeat-windows")


def cut(text: bytes, low: np.ndarray, high: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed spans."""
    order = np.argsort(low, kind="stable")
    spans: list[list[int]] = []
    for a, b in zip(low[order].tolist(), (high[order] + length).tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), [tuple(s) for s in spans]


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", period: int = PERIOD, hot_bytes: int = HOT_BYTES, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed (low, high)), sha256 of what is left."""
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    did = F.substring(F.unhex("sha"), 1, ID)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = stored(rows.select("doc_id", digest(F.col("text")).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "repeat-base")
    copies = stored(base.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("n_bytes").alias("size")).where("n > 1"), "repeat-copies")
    # one row stands for all copies of a text
    name = F.concat_ws(":", F.col("doc_id").cast("string"), "sha")
    spare = stored(base.join(copies, "sha").where("doc_id <> first or doc_id is null").select(name.alias("name")), "repeat-spare")
    named = rows.where(F.octet_length("text") >= length).withColumn("sha", digest(F.col("text"))).withColumn("name", name)
    long = without(named, spare, "name", filter_bits(spare.count()))
    orphans = copies.where("first is null").select("sha")  # no copy has an id: any one of them stands for all
    if not orphans.isEmpty():
        long = long.unionByName(stored(named.where("doc_id is null").join(orphans, "sha").dropDuplicates(["sha"]).select(*named.columns), "repeat-orphans"))
    long = long.select(did.alias("did"), "text")
    found = windows(long, length, gram, period, hot_bytes, broadcast_buckets)
    # texts with copies go as a whole; the others with repeated strings are cut
    whole = copies.where(F.col("size") >= length).select("sha", did.alias("did"), F.lit(True).alias("whole"))
    found = stored(found.join(whole, "did", "left_anti").groupBy("did").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "repeat-found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, shas, gone = part.column("did"), [], []
                for x, low, high in zip(*(part.column(c).to_pylist() for c in ("text", "low", "high")), strict=True):
                    left, cuts = cut(x, np.array(low), np.array(high), length)
                    shas.append(hashlib.sha256(left).hexdigest())
                    gone.append([{"low": a, "high": b} for a, b in cuts])
                yield pa.RecordBatch.from_arrays([names, pa.array(shas, pa.string()), pa.array(gone, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], ["did", "kept", "spans"])

    cuts = maybe_in(long, found.select("did"), "did", filter_bits(found.count())).join(found, "did").select("did", "text", "low", "high")
    cuts = stored(cuts.mapInArrow(tidy(run), "did binary, kept string, spans array<struct<low:bigint,high:bigint>>"), "repeat-cuts").dropDuplicates(["did"])
    out = base.withColumn("did", did).join(cuts, "did", "left").join(whole.drop("did"), "sha", "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high")))
    gone = F.when(F.col("whole"), all_of_it).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")))
    kept = F.when(F.col("whole"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha"))
    return out.select("doc_id", "n_bytes", gone.alias("spans"), kept.alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"])
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("n_removed", removed)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("changed"), "spans")
