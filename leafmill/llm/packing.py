"""Filling containers of fixed capacity: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import prefix_sums, written
from leafmill.llm.tokens import TOKENIZER, token_counts


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(containers, lengths)]: packing patterns for counts[length] items of each length in 1..capacity.

    Lengths are placed longest first. Each goes to the shortest pack that leaves no gap if there is one, else to the shortest pack it
    fits into, else to new packs. Open patterns are kept by free space with the number of packs they stand for; placing a length
    splits at most one pattern and uses up the others, so patterns stay within a small multiple of the number of lengths."""
    by_free: dict[int, list[list]] = defaultdict(list)  # free space -> [[packs, lengths]]
    full: list[tuple[int, list[int]]] = []
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        new: dict[int, list[list]] = defaultdict(list)

        def put(packs: int, lengths: list[int], free: int, into: dict[int, list[list]]) -> None:
            if free == 0:
                full.append((packs, lengths))
            else:
                into[free].append([packs, lengths])

        frees = [length] * (length in by_free) + sorted((f for f in by_free if f > length), reverse=True)
        for free in frees:
            while left and by_free[free]:
                packs, lengths = by_free[free][-1]
                # one pack may take several items of the length, as long as the next shorter packs are not emptier
                used = min(packs, left)
                if used == packs:
                    by_free[free].pop()
                else:
                    by_free[free][-1][0] -= used
                left -= used
                put(used, [*lengths, length], free - length, new)
            if not by_free[free]:
                del by_free[free]
            if not left:
                break
        while left:  # what this length filled may take it once more before new packs are opened
            again = max((f for f in new if f >= length), default=0)
            if not again:
                break
            packs, lengths = new[again].pop()
            used = min(packs, left)
            if used < packs:
                new[again].append([packs - used, lengths])
            if not new[again]:
                del new[again]
            left -= used
            put(used, [*lengths, length], again - length, new)
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            if whole:
                put(whole, [length] * each, capacity - each * length, new)
            if rest:
                put(1, [length] * rest, capacity - rest * length, new)
        for free, patterns in new.items():
            by_free[free] += patterns
    return full + [(n, lengths) for patterns in by_free.values() for n, lengths in patterns if n]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, end rank, first container): the items of a length by rank, each interval filling containers in a row."""
    out, taken, base = [], defaultdict(int), 0
    for n, lengths in patterns:
        for length in lengths:
            out.append((length, taken[length], taken[length] + n, base))
            taken[length] += n
        base += n
    return out


def pieces_of(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, length): items over the capacity are cut into full pieces and a rest, the others stay whole."""
    last = F.expr(f"cast((`{size_col}` - 1) div {capacity} as bigint)")
    return (
        sizes.where(F.col(size_col) > 0)
        .select(F.col(id_col), F.col(size_col).alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
        .select(id_col, "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.col("_size") - F.col("piece_no") * capacity, F.lit(capacity)).cast("bigint").alias("length"))
    )


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, piece_no, start, length, container): every item with a size over 0 in containers of the capacity.

    Only an item larger than the capacity is cut: into full pieces of start..start+capacity and a rest. Items of null, zero or negative
    size are in no container; repeated ids are items of their own. An empty frame gives an empty frame.

    The driver gets the histogram only, at most `capacity` rows; the patterns are joined back by the rank of an item among those of its
    length. Ranks come from prefix sums over range partitions, so a length that a third of all items have is spread over tasks."""
    spark = sizes.sparkSession
    items = written(pieces_of(sizes, id_col, size_col, capacity), "items")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = pack_histogram(counts, capacity)
    # a length's places are as many as the patterns that hold it: bounded by the histogram, whatever the number of items
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, lo, _, base in slots(patterns):
        found[length].append((lo, base))
    sent = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in found.items()})
    ranked = prefix_sums(items, ["length"], [id_col, "piece_no"], F.lit(1), "_rank").select(id_col, "piece_no", "start", "length", "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            container = np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                at = sent.value[int(length)]
                i = np.searchsorted(at[:, 0], ranks[own], "right") - 1
                container[own] = at[i, 1] + ranks[own] - at[i, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], [id_col, "piece_no", "start", "length", "container"])

    return ranked.mapInArrow(place, f"`{id_col}` {dict(ranked.dtypes)[id_col]}, piece_no bigint, start bigint, length bigint, container bigint")


def pack_documents(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """pack() of texts sized in tokens; null and empty texts have no tokens and no place, blank ones have both."""
    return pack(token_counts(documents, id_col, text_col, tokenizer), capacity, id_col)
