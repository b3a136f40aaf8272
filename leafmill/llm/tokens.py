"""Encoding of texts with a public byte-level BPE vocabulary.

Merges are found with a segment tree over the ranks of adjacent pairs: the root holds the lowest rank, leftmost first; a merge changes
three leaves, each updated on its path to the root, so a piece of n bytes takes O(n log n) however long it is. Pieces (the matches of
the vocabulary's split pattern) repeat throughout a corpus, so each worker keeps the ids of short pieces it has met."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The split pattern of the vocabulary (public, as published with it); white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class SegmentTreeBPE(dict):
    """piece -> tuple of ids; computes and keeps what is missing. keep: pieces kept at most (speed only)."""

    def __init__(self, vocabulary: bytes, keep: int = 200_000, keep_chars: int = 48):
        super().__init__()
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.single = [ids[s] for s in byte_symbols()]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = rank, ids[a + b]
        self.keep, self.keep_chars = keep, keep_chars
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.merge([self.single[b] for b in piece.encode("utf-8", "replace")])
        if len(piece) <= self.keep_chars:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = found
        return found

    def merge(self, ids: list[int]) -> tuple[int, ...]:
        n = len(ids)
        if n < 2:
            return tuple(ids)
        pairs, size = self.pairs, 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = pairs.get((ids[i], ids[i + 1]))
            if found:
                tree[size + i] = found[0] * n + i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                left, right = tree[2 * i], tree[2 * i + 1]
                low = left if left < right else right
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while (low := tree[1]) < NONE:
            i = low % n
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                found = pairs.get((ids[i], ids[k]))
                put(i, found[0] * n + i if found else NONE)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                found = pairs.get((ids[h], ids[i]))
                put(h, found[0] * n + h if found else NONE)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0


_loaded: dict[int, SegmentTreeBPE] = {}


def worker_bpe(vocabulary: Broadcast) -> SegmentTreeBPE:
    """One encoder per Python worker and vocabulary."""
    key = hash(vocabulary.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SegmentTreeBPE(vocabulary.value)
    return _loaded[key]


def shared_vocabulary(spark: SparkSession, tokenizer: str) -> Broadcast:
    """The vocabulary file (of fixed size, under 2 MB) for all workers, so that only the driver needs its path."""
    with open(tokenizer, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids array<int>) of each row: token ids without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text; white space and control characters
    are encoded as they are. Rows are kept as they are, repeated ids included; other columns are not read. A narrow map: no shuffle."""
    vocabulary = shared_vocabulary(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocabulary)
        for batch in batches:
            ids, ends, at = [], np.zeros(batch.num_rows + 1, np.int64), 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = bpe.encode(text)
                at += len(found)
                ids.append(np.array(found, np.int32))
                ends[i + 1] = at
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            for lo, hi in chunks(ends):
                values = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(flat[ends[lo] : ends[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], ["id", "ids"])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def chunks(ends: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` list items (one row at least), as list offsets are 32 bit and batches should stay small."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens bigint) of each row; 0 for null and empty texts. A narrow map: no shuffle."""
    vocabulary = shared_vocabulary(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocabulary)
        for batch in batches:
            counts = pa.array([bpe.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["id", "n_tokens"])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
