"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Features are the presence of words, of word beginnings (compounds share them), of pairs of neighbours and of pairs
with one word between, hashed to 2^BITS coordinates; those that are rare in the sample are left out.  FTRL-proximal keeps two numbers per coordinate: a per-coordinate learning rate, and an L1 term that
leaves most weights at exactly 0, so that the model is a short list of (coordinate, weight), small enough to broadcast
(at most 2^BITS entries).  Learning is online: the driver streams the stored features of a bounded sample, one
partition in memory at a time.  Scoring maps over all documents with whole texts.

SAMPLE_ROWS bounds the labelled rows used for fitting; they are chosen by a hash of the id.  Rows whose
crc32(id as text) mod 5 is 0 are held out.  Edge cases: a null text counts as empty; an empty text scores the bias;
rows of `labels` without a label or without a document are ignored, and of several labels the largest counts; without
any label every score is 0.5 (predicted 1, as the threshold says); an empty table gives no rows; other columns and
repeated rows make no difference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowio import slices, tidy
from .shared import stored

BITS = 22
SAMPLE_ROWS = 12_000  # labelled rows for fitting, at most about this many
STEMS = (3, 4, 5, 6)  # letters of a word's beginning that count as a word of their own: compounds share them
CACHE_WORDS = 300_000  # entries of one worker's table of words
PASSES = 4  # over the sample, whatever its size
MIN_ROWS = 4  # a coordinate counts if so many sample rows have it, whatever their number
# Chosen by four-fold cross-validation inside the rows that are not held out (README); held-out labels took no part.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
# Fixed value: ASCII punctuation and capitals are folded before words are cut.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def cut(text: str) -> list[bytes]:
    return text.lower().encode().translate(FOLD).split()


def stems(word: bytes) -> list[str]:
    text = word.decode()
    return [f"{n} {text[:n]}" for n in STEMS]


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbour pairs and of pairs with a gap of one, from the words' hashes."""
    with np.errstate(over="ignore"):
        near = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        gap = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    return np.concatenate([near ^ (near >> np.uint64(29)), gap ^ (gap >> np.uint64(31))])


def coordinates(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Coordinates of a text's words, word beginnings, neighbour pairs and pairs with a gap of one, each once."""
    import xxhash

    digest, words = xxhash.xxh3_64_intdigest, cut(text)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    begun = {x for w in set(words) for x in stems(w)}
    return np.unique(coordinates(np.concatenate([h, np.fromiter(map(digest, begun), np.uint64, len(begun)), pairs(h)])))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias (never shrunk)."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates and weights that are not 0, and the bias."""
        at = np.flatnonzero(np.abs(self.z[:-1]) > L1)
        return at.astype(np.int32), self.weights(at).astype(np.float32), float(self.weights(np.array([len(self.z) - 1]))[0])


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(features binary, label) of the bounded sample, in an order that a hash of the id decides."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = rows.where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    rows = rows.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = text.join(F.broadcast(rows), "doc_id")  # bounded by SAMPLE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [features(x).astype("<i4").tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(found, pa.binary()), part.column("doc_id")], ["label", "at", "doc_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = picked.select("label", "text", "doc_id").mapInArrow(tidy(run), f"label int, at binary, doc_id {kind}")
    return stored(found.repartition(8, F.xxhash64(F.lit(11), "doc_id")).sortWithinPartitions(F.xxhash64(F.lit(13), "doc_id"), "doc_id"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    sample = training_rows(docs, labels, id_col, text_col, label_col)
    ftrl, seen, total = Ftrl(), np.zeros(1 << BITS, np.int32), 0
    for row in sample.select("at").toLocalIterator():
        seen[np.frombuffer(row["at"], "<i4")] += 1
        total += 1
    usual = seen >= MIN_ROWS
    for _ in range(PASSES if total else 0):
        for row in sample.select("at", "label").toLocalIterator():
            at = np.frombuffer(row["at"], "<i4").astype(np.int64)
            ftrl.learn(at[usual[at]], row["label"])
    return ftrl.model()


class Scorer(dict):
    """word -> hash, for as many words as fit; `telling` has the weighted coordinates of those words that have any."""

    def __init__(self, model):
        import xxhash

        at, weight, self.bias = model
        self.digest, self.telling, self.dense = xxhash.xxh3_64_intdigest, {}, np.zeros(1 << BITS, np.float64)
        self.dense[at] = weight

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.digest(word)
        own = [x >> (64 - BITS) for x in (value, *map(self.digest, stems(word)))]
        if any(self.dense[own]):
            self.telling[word] = [x for x in own if self.dense[x]]
        return value

    def score(self, text: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.telling.clear()
        words = cut(text)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        found = coordinates(pairs(h))
        found = set(found[self.dense[found] != 0].tolist())
        for w in self.telling.keys() & words:
            found.update(self.telling[w])
        total = self.bias + float(self.dense[sorted(found)].sum())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([scorer.score(x) for x in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The documents whose score is below `most`, with all their columns; nothing is shuffled.  A model that has learned
    nothing (no labels) rejects nothing."""
    if not len(model[0]) and not model[2]:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([scorer.score(x or "") < most for x in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
