"""Byte-level BPE encoding and decoding as a reduction over a tree of halves.

Encoding is a monoid: a leaf (a short text or a short piece) is encoded directly; two neighbours are joined by
encoding a window around their border again, and the window grows until the tokens outside are proven stable.

* Between pieces (matches of the pattern): a border between a non-space and a blank is a match border in every
  context, because no alternative of the pattern spans one.  The window grows on both sides to the nearest such border.
* Inside one long piece: a token sequence is the BPE encoding of its bytes exactly when each pair of neighbours is
  the encoding of the pair's bytes.  The window grows until the pairs at both of its ends hold; all others held before.

Decoding concatenates the tokens' bytes up the same kind of tree.

Edge cases: a null text counts as empty and has no tokens; special tokens' strings are ordinary text; texts of any
length are whole; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowio import slices, tidy
from .shared import lean

LEAF_CHARS = 1 << 10  # texts up to this length are leaves
LEAF_BYTES = 512  # the same for one piece
LEAF_TOKENS = 1 << 10  # and for decoding
RUN = re.compile(r"\S{%d}" % (2 * LEAF_BYTES))
BORDER = re.compile(r"\S(?=[ \n])")


@functools.lru_cache(maxsize=4)
def codec(path: str):
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes = {i: b for b, i in self.ranks.items()}

    # -- one piece
    def holds(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.core.encode_single_piece(b"".join(self.bytes[x] for x in left[a:] + right[:b]))
            if (a == 0 or self.holds(left[a - 1], window[0])) and (b == len(right) or self.holds(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.core.encode_single_piece(data)
        return self.join_piece(self.piece(data[: len(data) // 2]), self.piece(data[len(data) // 2 :]))

    # -- texts
    def leaf(self, text: str) -> list[int]:
        if RUN.search(text):
            return [x for m in self.pattern.findall(text) for x in self.piece(m.encode())]
        return self.core.encode_ordinary(text)

    def join_text(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        width, cut = 64, 0
        while cut == 0 and width < 2 * len(a):  # the last stable border of the left text
            found = [m.end() for m in BORDER.finditer(a, max(0, len(a) - width))]
            cut, width = (found[-1] if found else 0), width * 2
        m = BORDER.search(b)
        end = m.end() if m else len(b)
        drop, keep = len(a[cut:].encode()), len(left)
        while drop > 0:
            keep -= 1
            drop -= len(self.bytes[left[keep]])
        skip, first = len(b[:end].encode()), 0
        while skip > 0:
            skip -= len(self.bytes[right[first]])
            first += 1
        return left[:keep] + self.leaf(a[cut:] + b[:end]) + right[first:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        a, b = text[: len(text) // 2], text[len(text) // 2 :]
        return self.join_text(a, self.encode(a), b, self.encode(b))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LEAF_CHARS and not RUN.search(text):
            return bytes(self.core.encode_to_tiktoken_buffer(text, set()))
        import numpy as np

        return np.asarray(self.encode(text), dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.core.decode_bytes(ids)
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers).  path: of the ranks, the same on every executor."""
    path = path or default_path()
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [tool.packed(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [tool.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(tidy(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: encode() and then decode() of its ids, in one Python worker a task instead of two."""
    path = path or default_path()
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tool = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [tool.packed(x) for x in part.column("text").to_pylist()]
                out = [tool.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    return decoded.select(
        "doc_id",
        *["ids"] * keep_ids,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")))
