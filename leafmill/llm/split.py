"""Splitting oversized items at natural boundaries, by byte ranges.

An item is read as byte ranges with halos. Each range reports its own character count and the boundaries inside it (positions only).
Prefix sums of the counts stitch the range tables to one boundary table per item; the cuts are chosen on it; pieces are then read by
offset, again from ranges. Neither step needs the whole of an item."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import prefix_sums, written

RANGE_BYTES = 1 << 16
PARAGRAPH, LINE, SENTENCE, SPACE = 4, 3, 2, 1
_strong = re.compile(r"\n[^\S\n]*\n\s*|\n|[.!?…][\"'”’)\]]*[^\S\n]+(?=\S)|[。！？]")
_space = re.compile(r"\s+(?=\S)")


def column_ranges(items: DataFrame, key: str, text: str, limit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, n_bytes, rng, lo, body): the byte ranges of each text of more than `limit` characters; a body has a halo on both sides."""
    halo = 4 * limit + 64
    data = F.col(text).cast("binary")
    return (
        items.where(F.length(text) > limit)
        .select(key, F.octet_length(text).cast("bigint").alias("n_bytes"), data.alias("_data"))
        .select(key, "n_bytes", "_data", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {range_bytes})")).alias("rng"))
        .select(key, "n_bytes", "rng", *_body(F.col("_data"), range_bytes, halo))
    )


def _body(data: Column, range_bytes: int, halo: int) -> list[Column]:
    lo = F.greatest(F.col("rng") * range_bytes - halo, F.lit(0)).cast("int")
    return [lo.cast("bigint").alias("lo"), F.substring(data, lo + 1, F.lit(range_bytes + 2 * halo)).alias("body")]


def file_ranges(spark: SparkSession, paths: list[str], limit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """column_ranges() of UTF-8 files on a file system that all workers mount: each task seeks to its ranges and reads only these."""
    import os

    halo = 4 * limit + 64
    sizes = [(p, os.path.getsize(p)) for p in paths]
    rows = spark.createDataFrame([(p, n) for p, n in sizes if n], "path string, n_bytes bigint")
    rows = rows.select("path", "n_bytes", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {range_bytes})")).alias("rng")).repartition("path", "rng")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n, rng in zip(*(c.to_pylist() for c in batch.columns)):
                lo = max(0, rng * range_bytes - halo)
                with open(path, "rb") as f:
                    f.seek(lo)
                    body = f.read((rng + 1) * range_bytes + halo - lo)
                yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": pa.array([n], pa.int64()), "rng": pa.array([rng], pa.int64()), "lo": pa.array([lo], pa.int64()), "body": pa.array([body], pa.binary())})

    return rows.mapInArrow(read, "path string, n_bytes bigint, rng bigint, lo bigint, body binary")


def _char_start(body: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def _parts(body: bytes, lo: int, rng: int, range_bytes: int) -> tuple[str, str, str]:
    """Halo before, the range's own characters (those that begin in it), and halo after."""
    a, b = _char_start(body, max(0, rng * range_bytes - lo)), _char_start(body, min(len(body), (rng + 1) * range_bytes - lo))
    left, end = _char_start(body, 0), len(body)
    decode = lambda x: x.decode("utf-8", "replace")
    after = body[b:end]
    for cut in range(1, 4):  # a character that the halo's end cuts is left out
        if len(after) >= cut and after[-cut] >= 0xC0:
            if (0xF0 <= after[-cut] and cut < 4) or (0xE0 <= after[-cut] and cut < 3) or cut < 2:
                after = after[:-cut]
            break
    return decode(body[left:a]), decode(body[a:b]), decode(after)


def range_boundaries(before: str, own: str, after: str, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, strengths) of the boundaries in `own`, relative to its first character; a place is where the next piece may begin.

    Paragraph, line and sentence ends are always given; spaces only where there is none of these within a gap of more than `gap`
    characters. Both depend on at most `gap` characters around a place, so they come out the same however an item is cut to ranges."""
    k = 8  # a little context for patterns that the halo's end would cut
    text, base, end = before[-gap - k :] + own + after[: gap + k], min(len(before), gap + k), min(len(before), gap + k) + len(own)
    places, strengths = [], []
    for m in _strong.finditer(text):
        found = m.group()
        places.append(m.end())
        strengths.append(PARAGRAPH if found.count("\n") > 1 else LINE if "\n" in found else SENTENCE)
    edges = [-gap - k, *places, len(text) + gap + k]
    for a, b in zip(edges, edges[1:]):
        if b - a > gap:
            for m in _space.finditer(text, max(a, 0), min(b, len(text))):
                places.append(m.end())
                strengths.append(SPACE)
    p, s = np.array(places, np.int64), np.array(strengths, np.int8)
    keep = (p >= base) & (p < end)
    p, s = p[keep] - base, s[keep]
    order = np.argsort(p, kind="stable")
    return p[order], s[order]


def choose_cuts(n: int, places: np.ndarray, strengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[(start, end)] of the pieces of an item of n characters.

    A piece ends at the strongest boundary in the second half of what it may hold (the last of these), else at the last boundary of
    the first half after its overlap, else at the limit. The next begins `overlap` characters before that."""
    pieces, start, at = [], 0, places.tolist()
    while n - start > limit:
        low, mid, high = bisect.bisect_right(at, start + overlap), bisect.bisect_right(at, start + limit // 2), bisect.bisect_right(at, start + limit)
        if high > mid:
            window = strengths[mid:high]
            end = at[high - 1 - int(np.argmax(window[::-1]))]
        else:
            end = at[mid - 1] if mid > low else start + limit
        pieces.append((start, end))
        start = max(end - overlap, start + 1)
    return [*pieces, (start, n)]


def boundary_table(ranges: DataFrame, key: str, limit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, rng, n_chars, places, strengths) of each range: what the workers detect; no text."""
    gap = limit // 2
    kind = dict(ranges.dtypes)[key]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rngs, counts, ps, ss = batch.column(0), batch.column(1), [], [], []
            for rng, lo, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                before, own, after = _parts(body, lo, rng, range_bytes)
                p, s = range_boundaries(before, own, after, gap)
                counts.append(len(own))
                ps.append(p.astype(np.int32))
                ss.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([keys, rngs, pa.array(counts, pa.int64()), pa.array(ps, pa.list_(pa.int32())), pa.array(ss, pa.binary())], ["key", "rng", "n_chars", "places", "strengths"])

    return ranges.select(key, "rng", "lo", "body").mapInArrow(detect, f"key {kind}, rng bigint, n_chars bigint, places array<int>, strengths binary")


def piece_offsets(boundaries: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, piece_no, start, end) in characters from the ranges' boundary tables, stitched by prefix sums of their lengths."""
    kind = dict(boundaries.dtypes)["key"]
    # one row an item: positions only, about a hundredth of its text
    stitched = boundaries.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rng", "n_chars", "places", "strengths"))).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for key, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bases = np.concatenate([[0], np.cumsum([r["n_chars"] for r in ranges])])
                places = np.concatenate([np.array(r["places"], np.int64) + b for r, b in zip(ranges, bases)])
                strengths = np.concatenate([np.frombuffer(r["strengths"], np.int8) for r in ranges])
                for no, (start, end) in enumerate(choose_cuts(int(bases[-1]), places, strengths, limit, overlap)):
                    for column, value in zip(rows, (key, no, start, end)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in rows[1:])], ["key", "piece_no", "start", "end"])

    return stitched.mapInArrow(cut, f"key {kind}, piece_no bigint, start bigint, end bigint")


def piece_texts(ranges: DataFrame, offsets: DataFrame, boundaries: DataFrame, key: str, limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, piece_no, start, end, text): each piece from the one range it begins in, whose halo holds its rest.

    A start inside a word moves on to the next word of the overlap."""
    kind = dict(ranges.dtypes)[key]
    bases = prefix_sums(boundaries.select("key", "rng", F.col("n_chars").alias("n")), ["key"], ["rng"], F.col("n"), "base")
    mine = offsets.join(bases, "key").where("start >= base and start < base + n")
    mine = mine.groupBy("key", "rng").agg(F.first("base").alias("base"), F.collect_list(F.struct("piece_no", "start", "end")).alias("pieces"))
    joined = ranges.withColumnRenamed(key, "key").join(mine, ["key", "rng"]).select("key", "rng", "lo", "body", "base", "pieces")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key_, rng, lo, body, base, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                before, own, after = _parts(body, lo, rng, range_bytes)
                text, shift = own + after, base
                out = []
                for p in pieces:
                    a, b = p["start"] - shift, p["end"] - shift
                    if p["piece_no"] and not (text[a - 1] if a else before[-1:] or " ").isspace():
                        for i in range(a, min(a + overlap, b)):
                            if text[i].isspace():
                                a = i + 1
                                break
                    out.append((key_, p["piece_no"], a + shift, p["end"], text[a:b]))
                names = ["key", "piece_no", "start", "end", "text"]
                types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return joined.mapInArrow(emit, f"key {kind}, piece_no bigint, start bigint, end bigint, text string")


def split_pages(pages: DataFrame, limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, doc_id, page_num, piece_no, chunk_index, start, end, text): the pages of more than `limit` characters as pieces.

    pages needs id (unique), doc_id, page_num, raw_text; other columns are ignored. Consecutive pieces have at most `limit` characters
    and together cover the text; each but a page's first begins with at most `overlap` characters of the one before. chunk_index runs
    per doc_id from 0 over all of its pages in the order (page_num, id), nulls first: a page of up to `limit` characters counts as one
    piece, null and empty pages as none; only pieces of oversized pages are given. Null doc_ids form one document. Rows of a document
    are numbered by prefix sums over range partitions, so a document may hold any share of the rows."""
    ranges = column_ranges(pages, "id", "raw_text", limit, range_bytes)
    boundaries = written(boundary_table(ranges, "id", limit, range_bytes), "boundaries")
    offsets = written(piece_offsets(boundaries, limit, overlap), "offsets")
    texts = piece_texts(ranges, offsets, boundaries, "id", limit, overlap, range_bytes)
    counts = offsets.groupBy(F.col("key").alias("id")).agg(F.count("*").alias("_n"))
    narrow = pages.select("id", "doc_id", "page_num", F.length("raw_text").alias("_len")).join(counts, "id", "left")
    pieces = F.coalesce("_n", F.when(F.col("_len") > 0, 1), F.lit(0))
    numbered = prefix_sums(written(narrow, "counted"), ["doc_id"], ["page_num", "id"], pieces, "_first").where("_n is not null")
    return texts.join(numbered, texts["key"] == numbered["id"]).select(F.col("id").alias("page_id"), "doc_id", "page_num", "piece_no", (F.col("_first") + F.col("piece_no")).alias("chunk_index"), "start", "end", "text")


def oversized_pages(pages: DataFrame, limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id) of the pages that split_pages() cuts, from the cuts themselves."""
    ranges = column_ranges(pages, "id", "raw_text", limit, range_bytes)
    offsets = piece_offsets(boundary_table(ranges, "id", limit, range_bytes), limit, overlap)
    return offsets.where("piece_no = 1").select(F.col("key").alias("page_id"))
