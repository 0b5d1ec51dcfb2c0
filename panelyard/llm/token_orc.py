"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on the document id.

Documents are range-partitioned by id (texts travel, they are smaller than ids), encoded in order, and written as one
ORC file per range, sorted by id.  Integer columns get ORC's run-length encoding, every 10,000 rows a row index, and
the id column a Bloom filter; readers split files by stripe and skip stripes by these.  `position` numbers the rows in
file order (range number and row number in one long), so that offsets need only one sum per range.

Encoding goes word by word: the tokenizer drops white space before it looks at anything else, so that texts split at
ASCII white space encode as their words do.  Words are looked up in a bounded table.  Those of a slice that are not there
go to the tokenizers library in batches: whole, or, where their characters are plain (lower case and composition need no
context), lower-cased and split by the tokenizer's own pattern first, so that pieces are encoded once however they are
written.  A piece ends with the vocabulary's end-of-word mark, which tells the pieces of a batch apart.

Edge cases: a null text counts as empty and holds only the end id; null ids sort first; rows that repeat an id are
kept, ordered by their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from .arrowio import slices, tidy
from .shared import kept_until_exit, scratch, stored

END_ID = 1
CACHE_WORDS = 500_000  # entries of one worker's tables of words and of pieces (some 90 MB each), and those of one slice more
JOINED = 64  # pieces that go to the library as one string
SLICE_BYTES = 8 << 20  # words of a slice are looked up once
LOOKED_AT = 2048  # words that are examined as one string
PLAIN = re.compile("[\n!-~\u00a1-\u024f]+")  # characters whose lower case and composition need no context
# Fixed value: the tokenizer's own split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words(dict):
    """word (without ASCII white space) -> packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole, self.by_piece = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.by_piece.normalizer = normalizers.Sequence([])
        self.by_piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab, suffix = self.whole.get_vocab(), self.whole.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT)

    def cut(self, words: list[str]) -> list[str | list[str] | None]:
        """The pieces of each plain word (or its only one), looked at together; None for other words."""
        text = "\n".join(words)
        low = text.lower()
        if PLAIN.fullmatch(low) and "<|" not in low and (low.isascii() or "İ" not in text and unicodedata.is_normalized("NFC", text)):
            return [w if w.isalpha() else self.split.findall(w) for w in low.split("\n")]
        return [x for word in words for x in self.cut([word])] if len(words) > 1 else [None]

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of new pieces into the table."""
        texts = [" ".join(pieces[at : at + JOINED]) for at in range(0, len(pieces), JOINED)]
        found = self.by_piece.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(pieces):
            raise RuntimeError("the vocabulary's end-of-word marks do not tell pieces apart")
        packed, at = ids.tobytes(), 0
        for piece, stop in zip(pieces, stops, strict=True):
            self.pieces[piece] = packed[at:stop]
            at = stop

    def add(self, words: list[str]) -> None:
        """Puts new words into the table."""
        whole, parts, odd = {}, {}, []
        for at in range(0, len(words), LOOKED_AT):
            some = words[at : at + LOOKED_AT]
            for word, pieces in zip(some, self.cut(some), strict=True):
                if type(pieces) is str:
                    whole[word] = pieces
                elif pieces is None:
                    odd.append(word)
                else:
                    parts[word] = pieces
        known = self.pieces
        if new := set(whole.values()).union(*parts.values()).difference(known):
            self.learn(list(new))
        self.update(zip(whole, map(known.__getitem__, whole.values()), strict=True))
        for word, pieces in parts.items():
            self[word] = b"".join([known[p] for p in pieces])
        for word, found in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False) if odd else (), strict=True):
            self[word] = array("I", found.ids).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids one after the other."""
        for table in (self, self.pieces):
            if len(table) >= CACHE_WORDS:  # the words that came first are the frequent ones
                for word in list(itertools.islice(table, CACHE_WORDS // 2, None)):
                    del table[word]
        words = pa.compute.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, names))
        if new := [i for i, x in enumerate(found) if x is None]:
            self.add([names[i] for i in new if names[i]])
            for i in new:
                found[i] = self[names[i]] if names[i] else b""
        each = pa.array(found, pa.binary()).take(coded.indices)
        offsets, start = np.frombuffer(each.buffers()[1], np.int32)[each.offset : each.offset + len(each) + 1], words.offsets.to_numpy()
        flat = np.frombuffer(each.buffers()[2], np.uint32)[offsets[0] // 4 : offsets[-1] // 4] if len(each) and offsets[-1] else np.empty(0, np.uint32)
        return np.diff(offsets[start - start[0]]) // 4, flat


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (doc_id, position, n_tokens, ids) as ORC files in ascending id order."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = words(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                many, ids = tool.ids(part.column("text"))
                ends = np.cumsum(many + 1)
                out = np.empty(len(ids) + len(many), np.uint32)
                inside = np.ones(len(out), bool)
                inside[ends - 1] = False
                out[inside], out[ends - 1] = ids, end_id
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((many + 1).astype(np.int64)), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint, ids array<int>").withColumn("position", F.monotonically_increasing_id())
    rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.stripe.size", str(16 << 20)).orc(target)


def read(spark, target: str, doc_ids: list | None = None) -> DataFrame:
    """The files' rows; with doc_ids, stripes without them are skipped by statistics and Bloom filters."""
    rows = spark.read.orc(target)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def checked(rows: DataFrame) -> DataFrame:
    """doc_id, position, n_tokens, ids_crc32 of the ids as they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = pa.array((ends[1:] - ends[:-1]).astype("int64"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("position"), n, pa.array(crc, pa.int64())], ["doc_id", "position", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "position", "ids").mapInArrow(tidy(run), f"doc_id {kind}, position bigint, n_tokens bigint, ids_crc32 bigint")


def starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before, to rows with (position, n_tokens)."""
    rows = rows.withColumn("_range", F.shiftright("position", 33))
    before = (Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("_range").orderBy("position").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("_inner", inner).join(sums, "_range").withColumn("start", F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")


def query(spark, sf_dir: str) -> DataFrame:
    target = scratch(spark, "token-orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)
    kept_until_exit(spark, target)
    return starts(stored(checked(read(spark, target)), "token-sums")).select("doc_id", "start", "n_tokens", "ids_crc32")
