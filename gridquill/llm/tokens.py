"""Encoding of texts with a public byte-level BPE vocabulary.

``encode`` gives the ids of every text, ``count_tokens`` only their number. Texts up to
``LONG`` characters are encoded where they are read, without a shuffle. Longer ones are cut
into leaves of ``LEAF`` characters at arbitrary places; leaves are encoded in parallel and
concatenated as a tree: around each join a window of tokens is encoded again and grows until
its first and last tokens are those that the two sides have there. A sequence of BPE tokens
is the encoding of its text exactly if each pair of neighbours is, so agreement at both ends
of the window makes the whole concatenation exact.

Null, empty: an empty list (0 tokens). White space is text like any other. Special-token
strings in a text are ordinary text. Repeated rows come out as often as they went in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of byte_bpe_50k lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pre-tokenization pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 16_384
LEAF = 8_192
#: Tokens in the first window on each side of a join, and how many must agree at its ends.
WINDOW, AGREE = 8, 3


class BytePairs:
    """A vocabulary with its encoder; one per Python worker and path."""

    _loaded: dict[str, BytePairs] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    @classmethod
    def at(cls, path: str) -> BytePairs:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), np.int32)

    def join(self, a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """The encoding of two neighbouring stretches of text from their own encodings."""
        (left, x), (right, y) = a, b
        if not len(x) or not len(y):
            return left + right, x if len(x) else y
        size = WINDOW
        while True:
            m, start = self._back(left, x, size)
            n, end = self._ahead(right, y, size)
            seen = self.ids((left[start:] + right[:end]).decode("utf-8"))
            whole_left, whole_right = m == len(x), n == len(y)
            same_left = whole_left or (len(seen) > AGREE and np.array_equal(seen[:AGREE], x[len(x) - m :][:AGREE]))
            same_right = whole_right or (len(seen) > AGREE and np.array_equal(seen[-AGREE:], y[:n][-AGREE:]))
            if same_left and same_right:
                return left + right, np.concatenate([x[: len(x) - m], seen, y[n:]])
            size *= 2

    def _back(self, text: bytes, ids: np.ndarray, size: int) -> tuple[int, int]:
        """How many of the last tokens, at least ``size``, start on a character; and where."""
        n = min(size, len(ids))
        at = len(text) - int(self.length[ids[len(ids) - n :]].sum())
        while n < len(ids) and text[at] & 0xC0 == 0x80:
            n += 1
            at -= int(self.length[ids[len(ids) - n]])
        return n, at

    def _ahead(self, text: bytes, ids: np.ndarray, size: int) -> tuple[int, int]:
        """How many of the first tokens, at least ``size``, end on a character; and where."""
        n = min(size, len(ids))
        at = int(self.length[ids[:n]].sum())
        while n < len(ids) and text[at] & 0xC0 == 0x80:
            at += int(self.length[ids[n]])
            n += 1
        return n, at

    def concatenate(self, leaves: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Neighbouring leaves joined two by two, until one is left."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0][1] if leaves else np.zeros(0, np.int32)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _encode_short(df: DataFrame, key: str, text: str, path: str, counts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.at(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if counts:
                encode = pairs.encoding.encode_ordinary
                got: pa.Array = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            else:
                got = _lists([pairs.ids(t) if t else np.zeros(0, np.int32) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, v {'bigint' if counts else 'array<int>'}")


def _encode_long(df: DataFrame, key: str, text: str, path: str, counts: bool) -> DataFrame:
    import pandas as pd

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.at(path)
        for batch in batches:
            ids = [pairs.ids(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=["k", "r", "n", "t", "i"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        leaves = [(t.encode("utf-8"), np.asarray(i, np.int32)) for t, i in zip(group["t"], group["i"], strict=True)]
        ids = BytePairs.at(path).concatenate(leaves)
        return pd.DataFrame({"k": [group["k"].iloc[0]], "v": [len(ids) if counts else ids.tolist()]})

    kind = df.schema[key].dataType.simpleString()
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / LEAF).cast("int"))
    leaves = (
        df.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .withColumn("r", F.monotonically_increasing_id())  # keeps repeated keys apart
        .select("k", "r", "t", F.explode(starts).alias("n"))
        .select("k", "r", "n", F.expr(f"substring(t, n * {LEAF} + 1, {LEAF})").alias("t"))
        .repartition("r", "n")
    )
    encoded = leaves.mapInArrow(leaf_ids, f"k {kind}, r bigint, n int, t string, i array<int>")
    return encoded.groupBy("r").applyInPandas(whole, f"k {kind}, v {'bigint' if counts else 'array<int>'}")


def _split(df: DataFrame, key: str, text: str, path: str, counts: bool) -> DataFrame:
    long: Column = F.coalesce(F.length(F.col(text)), F.lit(0)) > LONG
    return _encode_short(df.where(~long), key, text, path, counts).unionByName(_encode_long(df.where(long), key, text, path, counts))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key``, ids array<int>: one row per input row, without special tokens."""
    return _split(df, key, text, path, counts=False).select(F.col("k").alias(key), F.col("v").alias("ids"))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key``, n_tokens bigint: one row per input row."""
    return _split(df, key, text, path, counts=True).select(F.col("k").alias(key), F.col("v").alias("n_tokens"))
