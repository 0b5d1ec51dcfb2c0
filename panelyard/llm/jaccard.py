"""N-gram Jaccard self-join: signature trees inside candidate groups.

Two documents link when the Jaccard similarity of their word-shingle sets reaches a threshold; the result is every
document's connected component.  Three steps, none of which emits the pairs of a group:

1. Candidates, exactly.  Linked sets of n tokens differ in at most k = floor((|x|+|y|)(1-t)/(1+t)) tokens.  Token
   hashes are cut into more ranges than that.  Each document emits the keys (hashes of a range's tokens) of its first
   E = k + 1 + (k + 1) / 4 ranges that are not empty, for the range counts its partners may use (powers of two by set
   size); of the shorter of two such lists at most k ranges differ, so linked documents share E - k keys or more.  A
   document with too few ranges that are not empty emits keys for the empty ones, too.  Keys are read in order as a
   stream, and a document with fewer than E - k keys that any other has, too, is out: that alone drops most documents
   which share passages or lines only.  The sets of the others are stored, and their tokens counted.  Of a set's tokens,
   rarest first, a partner must have one of the first n - ceil(t n) + 1: sets that share such a token are joined to its
   smallest one in a compatible size (a star), and stars are closed to components.  What many documents share is not
   rare, so that passages and lines join only documents which have little else.
   Rows that share a key are folded in the scan already, one row a key and slice of the scan.
2. Links, inside each candidate component.  A task builds a signature tree over its documents: nodes hold the OR and the
   AND of token bitmaps and the range of set sizes.  A dual traversal prunes node pairs by the largest overlap possible:
   a token whose bit is not in the other node's OR bitmap cannot be shared.  Pairs that union-find already has in one
   component are skipped; the rest are settled by the exact sets.  A task returns links of a spanning forest only.
   Components beyond TASK_TOKENS are dealt by hash into blocks.  Some members (guests, a bounded share of a block) go to
   every block, so that families of near copies become one component across blocks at once, and sets move once.  What
   is then outside the largest component of its group is compared with all of the group: as a broadcast against the
   stored sets while it has at most REST_TOKENS, block by block otherwise.
3. Components over all links, by star contraction.

Only representatives of equal sets take part in 1 and 2 (the smallest id of each set), so copies cost nothing.  Sets are
equal when 128 bits of hash over their tokens are; tokens are 64-bit hashes of shingles.

Edge cases: a null or empty text, or one without words, has the empty set and is linked with nothing, not even its
like; with fewer words than a shingle has, the whole sequence is the one shingle; a null id is a document like others
but names no component unless alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrowio import slices, tidy
from .shared import components, filter_bits, maybe_in, stored

TASK_TOKENS = 2_000_000  # of the sets that one group holds (16 MB)
GUESTS = 8  # guests take one part in so many of a block
REST_TOKENS = 1_000_000  # of sets that are broadcast (8 MB)
BITMAP_WORDS = 32  # 2,048 bits a document
LEAF = 48
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[3]
    x = (x ^ (x >> np.uint64(27))) * ODD[4]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.  bytes.lower() and bytes.split() know ASCII only, as asked."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, words):
            out = mixed(out * ODD[0] + h[k : k + n])
        return np.unique(mixed(out + ODD[2]))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of hash as two longs."""
    import xxhash

    first, second = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()
    return first, second


class Threshold:
    """Jaccard similarity of at least num/den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def apart(self, total: int) -> int:
        """Tokens in which linked sets of `total` tokens together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def wanted(self, apart: int) -> int:
        """Keys that are emitted where linked sets may differ in so many tokens."""
        return apart + 1 + (apart + 1) // 4

    def level(self, n: int) -> int:
        """log2 of the number of ranges for pairs whose larger set has n tokens."""
        apart = self.apart(2 * n)
        return 0 if apart == 0 else int(1.1 * self.wanted(apart) + 1).bit_length()

    def least(self, n: Column) -> Column:
        """Keys that a set of n tokens shares with any partner, at least."""
        smallest = F.ceil(n * self.num / F.lit(self.den))
        return F.lit(1) + F.floor((F.floor((n + smallest) * (self.den - self.num) / F.lit(self.den + self.num)) + 1) / 4)

    def keys(self, tokens: np.ndarray) -> list[np.ndarray]:
        n, out = len(tokens), []
        largest = n * self.den // self.num
        want = self.wanted(self.apart(n + largest))
        with np.errstate(over="ignore"):
            inner = mixed(tokens * ODD[1])
            for j in range(self.level(n), self.level(largest) + 1):
                part = tokens >> np.uint64(64 - j) if j else np.zeros(n, np.uint64)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                here = part[starts]
                keys = mixed(np.add.reduceat(inner, starts) + here * ODD[0] + np.uint64(j) * ODD[2])
                out.append(keys[:want])
                if len(keys) < want:  # only empty ranges might agree
                    gaps = np.setdiff1d(np.arange(1 << j, dtype=np.uint64), here)
                    out.append(mixed(gaps * ODD[4] + np.uint64(j) * ODD[3] + ODD[1]))
        return out


# -- documents to sets, and sets to candidate components
def measured(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, cls, cls2 (128 bits of hash of the set; null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(x, words) for x in part.column("text").to_pylist()]
                n = pa.array([len(s) for s in sets], pa.int64())
                cls = [set_key(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, *(pa.array([c[i] for c in cls], pa.int64()) for i in (0, 1))], ["doc_id", "n_shingles", "cls", "cls2"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, cls bigint, cls2 bigint")


def keyed(rows: DataFrame, words: int, t: Threshold) -> DataFrame:
    """(key, cls, n).  n null: the document has that key.  Where documents of one slice share a key, one row stands for
    all of them, with n = 0, and rows (cls, cls, n) tell how many keys of cls were settled so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                keys, cls = [], []
                for x in part.column("text").to_pylist():
                    s = shingles(x, words)
                    if len(s):
                        new = t.keys(s)
                        keys += new
                        cls.append(np.full(sum(map(len, new)), set_key(s)[0], np.int64))
                if not keys:
                    continue
                k, c = np.concatenate(keys).view(np.int64), np.concatenate(cls)
                order = np.lexsort((c, k))
                k, c = k[order], c[order]
                once = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])  # copies have one vote
                k, c = k[once], c[once]
                new = np.concatenate([[True], k[1:] != k[:-1]])
                many = np.diff(np.append(np.flatnonzero(new), len(k))) > 1
                done, n = np.unique(c[many[np.cumsum(new) - 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(c[new]), pa.array(np.zeros(len(many), np.int64), mask=~many)], ["key", "cls", "n"])
                if len(done):  # dealt by cls, which is as good as random
                    yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(done), pa.array(n)], ["key", "cls", "n"])

    return rows.select("text").mapInArrow(tidy(run), "key bigint, cls bigint, n bigint")


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over keyed() rows in the order of (key, cls): (cls, n), keys of cls that another one has, too.  It holds
    one batch and one row, however often a key comes."""
    held = np.zeros((0, 4), np.int64)  # the last row: key, cls, settled, its key has come with another cls
    for batch in batches:
        n = batch.column("n").fill_null(-1).to_numpy()
        key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
        told, rows = n > 0, n <= 0
        key_rows = np.stack([key[rows], cls[rows], n[rows] == 0, np.zeros(int(rows.sum()), np.int64)], axis=1)
        key_rows = np.concatenate([held, key_rows])
        out_cls, out_n = [cls[told]], [n[told]]
        if len(key_rows):
            k, c, settled, shared = key_rows.T
            once = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            at = np.cumsum(once) - 1
            settled = np.bincount(at, settled) > 0
            k, c, shared = k[once], c[once], shared[once]
            group = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
            several = (np.bincount(group) > 1) | (np.bincount(group, shared) > 0)
            count = several[group] & ~settled
            out_cls.append(c[count])
            out_n.append(np.ones(int(count.sum()), np.int64))
            held = np.array([[k[-1], c[-1], settled[-1] or several[-1], several[-1]]], np.int64)
        found, where = np.unique(np.concatenate(out_cls), return_inverse=True)
        if len(found):
            total = np.bincount(where, np.concatenate(out_n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], ["cls", "n"])


def pairs_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distinct pairs (u, v) with u <> v."""
    pairs = np.stack([u, v], axis=1)[u != v]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def starred(t: Threshold):
    """mapInArrow over (key, n, node) in that order: edges (u, v), each row with the first one of its key and size.  Between
    neighbours whose sizes cannot link a new star begins: nothing links across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n, first = None, 0, 0
        for batch in batches:
            key, n, node = (batch.column(c).to_numpy() for c in ("key", "n", "node"))
            if not len(key):
                continue
            before = np.concatenate([[last_n], n[:-1]])
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]]) | (t.den * before < t.num * n)
            own = np.concatenate([[first], node[new]])[np.cumsum(new)]
            last, last_n, first = int(key[-1]), int(n[-1]), int(own[-1])
            pairs = pairs_of(node, own)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return run


def token_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens) for wanted (doc_id, cls, cls2); node is the set's representative.  A row that repeats an id and
    its text gives its set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, first, second, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "cls", "cls2", "text")), strict=True):
                    s = shingles(text, words)
                    if len(s) and set_key(s) == (first, second):  # a row that repeats an id may have another text
                        out.append((doc_id, len(s), s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "tokens"])

    near = maybe_in(rows, wanted.select("doc_id"), "doc_id", filter_bits(wanted.count())).join(wanted, "doc_id")
    return near.select("doc_id", "cls", "cls2", "text").mapInArrow(tidy(run), "node bigint, n bigint, tokens binary")


def tokens_of(sets: DataFrame) -> DataFrame:
    """(token, n, node) of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tokens"):
                packed = part.column("tokens").to_pylist()
                many = [len(x) // 8 for x in packed]
                n, node = (np.repeat(part.column(c).to_numpy(), many) for c in ("n", "node"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(n), pa.array(node)], ["token", "n", "node"])

    return sets.select("node", "n", "tokens").mapInArrow(tidy(run), "token bigint, n bigint, node bigint")


def prefixes(sets: DataFrame, t: Threshold) -> DataFrame:
    """(key, n, node): each set's rarest tokens, as many as one of them must be in any partner, without those that no other
    set has.  Tokens go by (number of sets, token): linked sets share at least t n of n tokens, so that of the first
    n - ceil(t n) + 1 in any common order one is shared."""
    tokens = tokens_of(sets)
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    mine = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(mine)  # tokens of one set only come first, and lead nowhere
    first = F.col("n") - F.ceil(F.col("n") * t.num / F.lit(t.den)) + 1 - alone
    ranked = tokens.join(often, "token").withColumns({"first": first, "at": F.row_number().over(mine.orderBy("sets", "token"))})
    return ranked.where("at <= first").select(F.col("token").alias("key"), "n", "node")


def candidates(rows: DataFrame, classes: DataFrame, words: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Sets (node, n, tokens) that may have a link, and (node, n, comp): components of shared prefix tokens among them."""
    shared = keyed(rows, words, t).repartition("key").sortWithinPartitions("key", "cls").mapInArrow(tidy(tallied), "cls bigint, n bigint")
    shared = shared.groupBy("cls").agg(F.sum("n").alias("shared"))
    wanted = classes.join(shared, "cls").where(F.col("shared") >= t.least(F.col("n"))).select(F.col("rep").alias("doc_id"), "cls", "cls2")
    sets = stored(token_sets(rows, stored(wanted, "jaccard-wanted"), words), "jaccard-sets")
    many = sets.agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes")).first()
    if many["rows"] > many["nodes"]:  # rows that repeat an id and its text
        sets = stored(sets.dropDuplicates(["node"]), "jaccard-sets")
    edges = prefixes(sets, t).repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(tidy(starred(t)), "u bigint, v bigint")
    comps = components(edges).select("node", F.col("root").alias("comp"))
    return sets, sets.select("node", "n").join(comps, "node")


# -- links inside a component
class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class SignatureTree:
    """Over sets `members` (indexes into sets), ordered by size; children halve a node."""

    def __init__(self, members: list[int], sizes: np.ndarray, bitmaps: np.ndarray):
        self.members = np.array(sorted(members, key=lambda i: (sizes[i], bitmaps[i].tobytes())), dtype=np.int64)
        self.sizes, self.bitmaps, self.nodes = sizes[self.members], bitmaps[self.members], {}

    def node(self, a: int, b: int):
        """(OR bitmap, AND bitmap, least size, largest size) of members a to b."""
        if (a, b) not in self.nodes:
            if b - a <= LEAF:
                part = self.bitmaps[a:b]
                self.nodes[a, b] = (np.bitwise_or.reduce(part), np.bitwise_and.reduce(part), int(self.sizes[a]), int(self.sizes[b - 1]))
            else:
                m = (a + b) // 2
                x, y = self.node(a, m), self.node(m, b)
                self.nodes[a, b] = (x[0] | y[0], x[1] & y[1], x[2], y[3])
        return self.nodes[a, b]


def bitmaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITMAP_WORDS words for each set."""
    out = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
    for at in range(0, len(sets), 1024):
        some = sets[at : at + 1024]
        bits = np.zeros((len(some), BITMAP_WORDS * 64), bool)
        bits[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some) & np.uint64(BITMAP_WORDS * 64 - 1)] = True
        out[at : at + 1024] = np.packbits(bits, axis=1).view(np.uint64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], bitmaps: np.ndarray, t: Threshold, left: list[int], right: list[int] | None, forest: Forest) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join two trees of the forest, among `left` or between `left` and `right`."""
    sizes = np.array([len(s) for s in sets], np.int64)
    a = SignatureTree(left, sizes, bitmaps)
    b = a if right is None else SignatureTree(right, sizes, bitmaps)
    todo = [((0, len(a.members)), (0, len(b.members)))]
    while todo:
        x, y = todo.pop()
        if x[0] == x[1] or y[0] == y[1]:
            continue
        same = a is b and x == y
        ox, nx, lox, hix = a.node(*x)
        oy, ny, loy, hiy = b.node(*y)
        if not same:
            if t.den * hix < t.num * loy or t.den * hiy < t.num * lox:
                continue
            most = min(hix - int(np.bitwise_count(nx & ~oy).sum()), hiy - int(np.bitwise_count(ny & ~ox).sum()))
            if (t.num + t.den) * most < t.num * (lox + loy):
                continue
        if x[1] - x[0] > LEAF or y[1] - y[0] > LEAF:
            mx, my = (x[0] + x[1]) // 2, (y[0] + y[1]) // 2
            if same:
                todo += [((x[0], mx), (mx, x[1])), ((mx, x[1]), (mx, x[1])), ((x[0], mx), (x[0], mx))]
            elif x[1] - x[0] >= y[1] - y[0]:
                todo += [((mx, x[1]), y), ((x[0], mx), y)]
            else:
                todo += [(x, (my, y[1])), (x, (y[0], my))]
            continue
        xs, ys = a.members[x[0] : x[1]], b.members[y[0] : y[1]]
        rx, ry = np.array([forest.find(i) for i in xs]), np.array([forest.find(i) for i in ys])
        if (rx == rx[0]).all() and (ry == rx[0]).all():
            continue
        bx, by, sx, sy = a.bitmaps[x[0] : x[1]], b.bitmaps[y[0] : y[1]], a.sizes[x[0] : x[1]], b.sizes[y[0] : y[1]]
        over_x = sx[:, None] - np.bitwise_count(bx[:, None, :] & ~by[None, :, :]).sum(axis=2, dtype=np.int64)
        over_y = sy[None, :] - np.bitwise_count(by[None, :, :] & ~bx[:, None, :]).sum(axis=2, dtype=np.int64)
        maybe = ((t.num + t.den) * np.minimum(over_x, over_y) >= t.num * (sx[:, None] + sy[None, :])) & (rx[:, None] != ry[None, :])
        for p, q in np.argwhere(np.triu(maybe, 1) if same else maybe):
            i, j = int(xs[p]), int(ys[q])
            if forest.find(i) != forest.find(j) and t.linked(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                forest.join(i, j)
                yield i, j


SOLVED = "u bigint, v bigint, comp bigint, big boolean, tokens binary"


def solver(t: Threshold):
    """applyInArrow: rows (task, comp, node, label, side, keep, tokens) to links (u, v, comp, big).  side 0 is joined with
    itself where the group has no side 1, and with side 1 otherwise; rows of one label are connected already.  Rows with
    `keep` come back with their sets (u is the node, v null): what is compared again later needs not move again."""

    def run(table: pa.Table) -> pa.Table:
        comp, node, label, side = (np.asarray(table.column(c).to_pylist(), dtype=np.int64) for c in ("comp", "node", "label", "side"))
        keep, big = (table.column(c).to_numpy().astype(bool) for c in ("keep", "big"))
        raw = table.column("tokens")
        u, v, of, large = [], [], [], []
        order = np.argsort(comp, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            sets = [np.frombuffer(raw[int(r)].as_py(), np.uint64) for r in rows]
            forest, first = Forest(len(rows)), {}
            for i, r in enumerate(rows):
                forest.join(first.setdefault(int(label[r]), i), i)
            left, right = [i for i, r in enumerate(rows) if side[r] == 0], [i for i, r in enumerate(rows) if side[r]]
            for i, j in links(sets, bitmaps_of(sets), t, left, right or None, forest):
                u.append(int(node[rows[i]]))
                v.append(int(node[rows[j]]))
                of.append(int(comp[rows[i]]))
                large.append(bool(big[rows[i]]))
        names = ["u", "v", "comp", "big", "tokens"]
        out = pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(of, pa.int64()), pa.array(large, pa.bool_()), pa.nulls(len(u), pa.binary())], names)
        if not keep.any():
            return out
        kept = table.filter(pa.array(keep))
        sets = pa.table([kept.column("node"), pa.nulls(len(kept), pa.int64()), kept.column("comp"), pa.array([True] * len(kept)), kept.column("tokens")], names)
        return pa.concat_tables([out, sets])

    return run


def solve(rows: DataFrame, t: Threshold) -> DataFrame:
    return rows.select("task", "comp", "node", "label", "side", "keep", "big", "tokens").groupBy("task").applyInArrow(solver(t), SOLVED)


def planned(nodes: DataFrame, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """nodes (node, n, comp) with `parts` (1: the component fits a task), `block`, `blocks` (where it goes: all of them, if
    it is a guest) and `bin`.  Small components share tasks (bins); large ones are dealt into blocks by hash.  All from
    counts, before any set moves."""
    sums = stored(nodes.groupBy("comp").agg(F.sum("n").alias("total")), "jaccard-comps")
    total = sums.agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-2 * int(total) // task_tokens))
    large = sums.where(F.col("total") > task_tokens).select("comp", F.ceil(F.col("total") / task_tokens).cast("int").alias("parts"), F.lit(task_tokens // GUESTS) / F.col("total"))
    large = large.toDF("comp", "parts", "share")  # at most one row for each task_tokens tokens
    out = nodes.join(large, "comp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    guest = F.coalesce(F.pmod(F.xxhash64(F.lit(6), "node"), F.lit(1 << 30)) < F.col("share") * (1 << 30), F.lit(False))
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int")
    blocks = F.when(guest, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(block))
    return stored(out.select("node", "comp", "parts", block.alias("block"), blocks.alias("blocks"), F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin")), "jaccard-planned")


def compared(big: DataFrame, rest: dict[int, tuple[list, list, list]], t: Threshold) -> DataFrame:
    """Links between stored sets and the broadcast `rest`: {comp: (nodes, labels, sets as bytes)}.  Nothing moves."""
    sent = big.sparkSession.sparkContext.broadcast(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple] = {}
        for batch in batches:
            for part in slices(batch, "tokens", 1 << 24):
                u, v = [], []
                by_comp: dict[int, list[int]] = {}
                for i, c in enumerate(part.column("comp").to_pylist()):
                    by_comp.setdefault(c, []).append(i)
                node, raw = part.column("u").to_pylist(), part.column("tokens")
                for c, mine in by_comp.items():
                    if c not in ready:
                        nodes, labels, packed = sent.value[c]
                        others = [np.frombuffer(x, np.uint64) for x in packed]
                        ready[c] = (nodes, labels, others, bitmaps_of(others))
                    nodes, labels, others, marks = ready[c]
                    own = [np.frombuffer(raw[i].as_py(), np.uint64) for i in mine]
                    names = [node[i] for i in mine] + nodes
                    forest, first = Forest(len(names)), {}
                    for i, x in enumerate([*names[: len(own)], *labels]):
                        forest.join(first.setdefault((i >= len(own), x), i), i)
                    same = {x: i for i, x in enumerate(nodes)}
                    for i, x in enumerate(names[: len(own)]):
                        if x in same:  # a document of the rest itself
                            forest.join(i, len(own) + same[x])
                    for i, j in links(own + others, np.concatenate([bitmaps_of(own), marks]), t, list(range(len(own))), list(range(len(own), len(names))), forest):
                        u.append(names[i])
                        v.append(names[j])
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return big.where(F.col("comp").isin(list(rest))).select("u", "comp", "tokens").mapInArrow(tidy(run), "u bigint, v bigint")


def forest_links(sets: DataFrame, plan: DataFrame, t: Threshold, task_tokens: int = TASK_TOKENS, rest_tokens: int = REST_TOKENS) -> DataFrame:
    """Links (u, v) whose components are those of all links, from the sets (node, n, tokens) and planned()."""
    is_big = F.col("parts") > 1
    task = F.when(is_big, F.xxhash64("comp", "goes")).otherwise(F.xxhash64(F.lit(0), "bin"))
    start = sets.select("node", "tokens").join(plan, "node").withColumn("goes", F.explode("blocks"))
    start = start.withColumns({"label": F.col("node"), "side": F.lit(0), "big": is_big, "keep": is_big & (F.col("goes") == F.col("block")), "task": task})
    solved = stored(solve(start, t), "jaccard-solved")
    found = solved.where("v is not null").select("u", "v")
    if plan.where(is_big).isEmpty():
        return found
    big = solved.where("v is null")  # sets move again only where they must
    names = big.select(F.col("u").alias("node"), "comp", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    roots = components(solved.where("v is not null and big").select("u", "v"))
    now = stored(names.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root").distinct(), "jaccard-labels")
    main = now.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = stored(now.join(main, "comp").where("label <> main").drop("main"), "jaccard-rest")
    left = rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    if left["rows"] == 0:
        return found
    with_sets = lambda chosen: maybe_in(big.select(F.col("u").alias("node"), "tokens"), chosen.select("node"), "node", filter_bits(left["rows"])).dropDuplicates(["node"]).join(chosen, "node")
    if left["tokens"] <= rest_tokens:
        by_comp: dict[int, tuple[list, list, list]] = {}
        for r in with_sets(rest).select("comp", "node", "label", "tokens").toLocalIterator():  # at most rest_tokens
            for out, x in zip(by_comp.setdefault(r["comp"], ([], [], [])), (r["node"], r["label"], bytes(r["tokens"])), strict=True):
                out.append(x)
        more = compared(big, by_comp, t)
    else:
        chunks = rest.groupBy("comp").agg(F.ceil(F.sum("n") / task_tokens).cast("int").alias("chunks"))
        blocks = now.groupBy("comp").agg(F.ceil(F.sum("n") / task_tokens).cast("int").alias("blocks"))
        plan = chunks.join(blocks, "comp")
        of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n))
        asked = with_sets(rest).join(plan, "comp").withColumn("chunk", of(4, "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
        every = big.select(F.col("u").alias("node"), "tokens").join(now, "node").join(plan, "comp").withColumn("block", of(1, "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(0))
        last = every.unionByName(asked).withColumns({"task": F.xxhash64(F.lit(5), "comp", "block", "chunk"), "keep": F.lit(False), "big": F.lit(True)})
        more = solve(last, t).select("u", "v")
    return found.unionByName(stored(more, "jaccard-links"))


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", task_tokens: int = TASK_TOKENS, rest_tokens: int = REST_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    t = Threshold(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = stored(measured(rows, words), "jaccard-base")
    classes = base.where("cls is not null and doc_id is not null").groupBy("cls", "cls2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    sets, nodes = candidates(rows, classes, words, t)
    found = components(forest_links(sets, planned(nodes, task_tokens), t, task_tokens, rest_tokens))
    named = stored(classes.join(found, classes.rep == found.node, "left").select("cls", "cls2", F.coalesce("root", "rep").alias("component_id")), "jaccard-classes")
    return base.join(named, ["cls", "cls2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)
