"""Exact top-k inner products with KD-trees per shard.

Vectors are scaled to integers.  Shards are the cells of a top-level KD-tree: planes at medians of the widest dimension,
fitted on a bounded sample (SAMPLE_ROWS; it decides only where rows lie, every row is indexed), at most MOST_SHARDS
cells; a cell with more than twice SHARD_ROWS rows (one common vector, say) is dealt by hash into several trees.  Each
tree splits at medians and keeps tight bounding boxes; the cells' tight boxes are broadcast.  The bound of a box is the
largest inner product any point in it could have.

A query visits cells best bound first, in three waves: the best cell, the next NEXT_SHARDS, and the rest.  After a wave
its k-th score so far is propagated, and only cells whose bound reaches it are asked in the next one.  Inside a tree the
walk is best first, too, and ends when the best bound is below the k-th score.  Queries travel to the cells that they
ask; a tree is copied only once for each QUERY_BLOCK queries that ask it.

Edge cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; shorter
vectors count as if filled with zeros; rows with the query's own id are no candidates, and of several rows with one
query id the smallest vector asks; equal scores rank by id; scores beyond a long count as the largest or smallest long;
with fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from .arrowio import tidy
from .shared import stored

SHARD_ROWS, MOST_SHARDS, SAMPLE_ROWS = 4096, 1024, 16_384
QUERY_BLOCK, LEAF_ROWS, NEXT_SHARDS = 4096, 128, 3
MOST = (1 << 63) - 1  # of a score; the least is -MOST


def clamped(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -MOST, MOST)


def upper(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """queries x boxes: the largest inner product that a point of the box could have."""
    out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return clamped(out) if out.dtype == object else out


class Tree:
    """points: float64 holding integers; ids: int64."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.nodes, self.low, self.high = points, ids, [], [], []
        self.build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def build(self, rows: np.ndarray) -> int:
        me, part = len(self.nodes), self.points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        self.nodes.append(None)
        self.low.append(low)
        self.high.append(high)
        wide = int(np.argmax(high - low)) if len(low) else 0
        if len(rows) <= LEAF_ROWS or not len(low) or high[wide] == low[wide]:
            order = np.argsort(self.ids[rows], kind="stable")
            self.nodes[me] = (part[order], self.ids[rows][order])
        else:
            middle = len(rows) // 2
            order = np.argpartition(part[:, wide], middle)
            self.nodes[me] = (self.build(rows[order[:middle]]), self.build(rows[order[middle:]]))
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
        """For each query up to k (score, id) with score >= least, best first."""
        bounds = upper(queries, self.low, self.high)
        for q, mine, floor, bound in zip(queries, own, least, bounds, strict=True):
            best: list[tuple[float, int]] = []  # a heap whose first entry is the worst: (score, -id)
            ahead = [(-bound[0], 0)]
            while ahead:
                over, at = heapq.heappop(ahead)
                need = best[0][0] if len(best) == k else floor
                if -over < max(need, floor):
                    break
                node = self.nodes[at]
                if isinstance(node[0], int):
                    for child in node:
                        heapq.heappush(ahead, (-bound[child], child))
                    continue
                scores = node[0] @ q if node[0].dtype != object else clamped(node[0] @ q)
                hot = np.flatnonzero((scores >= max(need, floor)) & (node[1] != mine))
                if len(hot) > k:  # ids ascend in a leaf, so a stable sort keeps the smaller of equal scores
                    hot = hot[np.argsort(-scores[hot], kind="stable")[:k]]
                for i in hot:
                    entry = (scores[i], -int(node[1][i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            yield sorted(best, reverse=True)


def matrix(vectors: pa.ChunkedArray | pa.ListArray, width: int) -> np.ndarray:
    rows = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of the planes of a KD-tree in heap order; a point lies to the right from `value` on."""
    dims, values = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    parts = {0: sample}
    for node in range(len(dims)):
        part = parts.pop(node)
        if len(part) > 1:
            dims[node] = wide = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            values[node] = np.partition(part[:, wide], len(part) // 2)[len(part) // 2]
        right = part[:, dims[node]] >= values[node] if part.shape[1] else np.zeros(len(part), bool)
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return dims, values


def cells(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which cell each point lies in."""
    dims, values = tree
    node = np.zeros(len(points), np.int64)
    while len(node) and node[0] < len(dims):  # all are at one depth
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= values[node])
    return node - len(dims)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As they are while all sums of products are exact in doubles, and as Python integers beyond."""
    big = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    if big * big * max(1, arrays[0].shape[1]) < 2.0**53:
        return list(arrays)
    return [np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) for a in arrays]


def searcher(k: int, width: int):
    """Cogrouped applyInArrow: one tree's points, and the queries that ask it."""

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if trees.num_rows and asked.num_rows:
            ids = np.frombuffer(trees.column("ids")[0].as_py(), np.int64)
            points, queries = exact(np.frombuffer(trees.column("points")[0].as_py()).reshape(len(ids), width), matrix(asked.column("vector"), width))
            own, least = asked.column("query_id").to_numpy(), asked.column("least").to_pylist()
            floors = np.array([-np.inf if x is None else x for x in least], dtype=object)
            for query, hits in zip(own.tolist(), Tree(points, ids).search(queries, own, floors, k), strict=True):
                found += [(query, -other, int(score)) for score, other in hits]
        a = np.array(found, dtype=np.int64).reshape(-1, 3)
        return pa.table({"query_id": a[:, 0], "vec_id": a[:, 1], "score": a[:, 2]})

    return run


def forest(rows: DataFrame, width: int, total: int, shard_rows: int) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """(shard, tree, ids, points) of all rows, trees per shard, and (shard, low, high): the shards' tight boxes."""
    spark = rows.sparkSession
    depth = min(max(0, -(-total // shard_rows) - 1).bit_length(), MOST_SHARDS.bit_length() - 1)
    share = F.lit(int(min(1.0, SAMPLE_ROWS / max(1, total)) * (1 << 30)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(21), "vec_id"), F.lit(1 << 30)) < share).select("vector") if depth else rows.limit(0).select("vector")
    table = sample.toArrow()  # about SAMPLE_ROWS vectors
    tree = planes(matrix(table.column("vector"), width) if table.num_rows else np.zeros((0, width)), depth)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cells(points, sent.value).astype(np.int32)), batch.column("vector")], ["vec_id", "shard", "vector"])

    placed = stored(rows.select("vec_id", "vector").mapInArrow(tidy(place), "vec_id bigint, shard int, vector array<double>"), "topk-placed")
    trees = {r["shard"]: -(-r["count"] // (2 * shard_rows)) for r in placed.groupBy("shard").count().collect()}  # at most MOST_SHARDS

    def build(table: pa.Table) -> pa.Table:
        points = matrix(table.column("vector"), width)
        box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (points.min(axis=0), points.max(axis=0))]
        ids = np.ascontiguousarray(table.column("vec_id").to_numpy())
        return pa.table([table.column("shard")[:1], table.column("tree")[:1], *box, pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(points).tobytes()], pa.binary())], ["shard", "tree", "low", "high", "ids", "points"])

    many = F.element_at(F.create_map(*(F.lit(x) for pair in trees.items() for x in pair)), F.col("shard")) if trees else F.lit(1)
    dealt = placed.withColumn("tree", F.pmod(F.xxhash64(F.lit(22), "vec_id"), many).cast("int"))
    built = dealt.groupBy("shard", "tree").applyInArrow(build, "shard int, tree int, low array<double>, high array<double>, ids binary, points binary")
    built = stored(built, "topk-forest")
    sides = built.select("shard", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
    sides = sides.groupBy("shard", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    return built.drop("low", "high"), trees, sides


def top_k(rows: DataFrame, asking: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score.  rows, asking: (vec_id, vector array<double> of integers)."""
    spark = rows.sparkSession
    rows, asking = stored(rows, "topk-rows"), stored(asking.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "topk-asking")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, size["width"] or 0, asking.agg(F.max(F.size("vector"))).first()[0] or 0)
    built, trees, sides = forest(rows, width, size["n"], shard_rows)
    order = sorted(trees)
    low, high = np.zeros((len(order), width)), np.zeros((len(order), width))
    for r in sides.collect():  # at most MOST_SHARDS boxes
        low[order.index(r["shard"]), r["at"]], high[order.index(r["shard"]), r["at"]] = r["low"], r["high"]
    sent = spark.sparkContext.broadcast((np.array(order), [trees[x] for x in order], low, high))

    def asked(queries: DataFrame, first: int, last: int) -> DataFrame:
        """(shard, tree, query_id, vector, least): queries with the trees of those cells from the first to the last by
        bound that may hold a better score than `least`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards, many, lows, highs = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    points, boxes_low, boxes_high = exact(matrix(part.column("vector"), width), lows, highs)
                    bounds = upper(points, boxes_low, boxes_high)
                    out = []
                    for i, least in enumerate(part.column("least").to_pylist()):
                        ranked = sorted(range(len(shards)), key=lambda s: (-bounds[i, s], s))[first:last]
                        out += [(i, int(shards[s]), tree) for s in ranked if least is None or bounds[i, s] >= least for tree in range(many[s])]
                    where = pa.array([o[0] for o in out], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), *(part.column(c).take(where) for c in ("query_id", "vector", "least"))], ["shard", "tree", "query_id", "vector", "least"])

        return queries.select("query_id", "vector", "least").mapInArrow(tidy(run), "shard int, tree int, query_id bigint, vector array<double>, least bigint")

    def search(queries: DataFrame, first: int, last: int) -> DataFrame:
        asks = stored(asked(queries, first, last), "topk-asks")
        blocks = asks.groupBy("shard", "tree").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        copies = built.join(blocks, ["shard", "tree"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = asks.join(blocks, ["shard", "tree"]).withColumn("block", F.pmod(F.xxhash64(F.lit(23), "query_id"), F.col("blocks")).cast("int"))
        key = ["shard", "tree", "block"]
        found = copies.select(*key, "ids", "points").groupBy(*key).cogroup(dealt.select(*key, "query_id", "vector", "least").groupBy(*key))
        return found.applyInArrow(searcher(k, width), "query_id bigint, vec_id bigint, score bigint")

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, queries = None, asking.withColumn("least", F.lit(None).cast("long"))
    for first, last in ((0, 1), (1, 1 + NEXT_SHARDS), (1 + NEXT_SHARDS, len(order))):
        if first < max(1, len(order)):
            more = search(queries, first, last)
            found = more if found is None else found.unionByName(more)
            found = stored(found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "topk-found")
            floors = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
            queries = asking.join(floors, "query_id", "left")
    return found.withColumn("rank", best).select("query_id", "rank", "vec_id", "score")


def whole(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector): usable vectors, each component floor(scale * x)."""
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # from 2^53 on a double is an integer already, and a long may not hold it
    vector = F.transform(vector_col, lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return embeddings.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
