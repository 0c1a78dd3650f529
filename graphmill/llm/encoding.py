"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; each distinct piece is merged by a segment
tree over its byte positions. Leaf i holds the rank of the pair of live tokens that begins at byte i,
inner nodes the leftmost minimum, so the root names the next merge; a merge touches the leaves of the
two live neighbours only, each with a logarithmic point update. A piece of n bytes costs O(n log n),
however long it is. Each Python worker keeps the ids of short pieces it has met, up to a bound.

No special tokens exist: their names in a text are ordinary text. Null and empty texts give an empty list.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files on the driver; a parameter of every operator here.
TOKENIZERS = os.environ.get("GRAPHMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNICODE = regex.compile(PATTERN)
#: The same pattern where a text is plain ASCII.
_ASCII = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)

NO_PAIR = 1 << 60


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: pairs merge by lowest rank, leftmost first, until none is left."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # leftmost wins among equal ranks
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    follow = list(range(1, n + 1))  # where the token at a live position ends
    before = list(range(-1, n - 1))
    while (top := tree[1]) != NO_PAIR:
        i = top % size
        j = follow[i]
        end = follow[j]
        follow[i] = end
        if end < n:
            before[end] = i
        p = before[i]
        for at, pair in ((j, None), (i, piece[i : follow[end]] if end < n else None), (p, piece[p:end] if p >= 0 else None)):
            if at < 0:
                continue
            r = rank(pair) if pair is not None else None
            value = NO_PAIR if r is None else r * size + at
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : follow[i]]])
        i = follow[i]
    return ids


class Encoder(dict):
    """Pieces met so far with their ids; at most ``keep`` short ones are kept."""

    def __init__(self, path: str, keep: int = 200_000, longest: int = 48):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.keep, self.longest = keep, longest

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= self.longest:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = ids
        return ids

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of each piece of a text, in order."""
        return map(self.__getitem__, (_ASCII if text.isascii() else _UNICODE).findall(text))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text))) if text else 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def shipped(spark: SparkSession, folder: str) -> Callable[[], str]:
    """Sends the vocabulary of the driver's ``folder`` to all executors with the job; gives its place on whichever machine it is called."""
    spark.sparkContext.addFile(os.path.join(folder, VOCABULARY))
    return lambda: SparkFiles.get(VOCABULARY)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): one row per row of ``df``. Null and empty texts give an empty list; only two columns are read."""
    path = shipped(df.sparkSession, folder)
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path())
        for batch in batches:
            each = [known.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(each), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens): as encode_texts, but only the number of ids leaves the worker."""
    path = shipped(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path())
        for batch in batches:
            counts = pa.array([known.count(t) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, n_tokens int")
