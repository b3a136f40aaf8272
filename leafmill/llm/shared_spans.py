"""Long exact spans shared between records.

Paragraphs here are all windows of the span length, not the text's own ones, as a shared run may begin and end anywhere. Each window's
sketch is the least hash of its sub-windows of ANCHOR characters (a MinHash of one value; a local minimum, as in winnowing): two equal
windows have the same least sub-window at the same place, so the one band has a recall of 1. Texts are reduced to these anchors, about
one in 75 characters; anchors that meet in two records are verified with the text around them: at once where the whole neighbourhood
is equal, else window by window in a second pass over just these places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import components, dropped, sized, written

_MULT = 0xD6E8FEB86659FD93
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, m in (("up", _MULT), ("down", _INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any window of a text from prefix sums: equal windows have equal hashes, whatever their place."""

    def __init__(self, text: str):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        up, self.down = _power(len(chars) + 1)
        chars = (chars + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        chars ^= chars >> np.uint64(32)
        self.sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * up[:-1], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: str, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, around, left, right) of the anchors: windows first..last of `span` characters have theirs at `place`.

    around: hash of the text from first to last + span, the neighbourhood these windows cover. left and right: hashes of the half of it
    that a window must reach on one of the two sides (0 where these windows can't)."""
    r = Rolling(text)
    h = r.windows(anchor)
    w = span - anchor + 1
    place = _leftmost(h, sliding_min(h, w), w)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.concatenate([start[1:], [len(place)]]) - 1
    p, half = place[start], (span - anchor + 1) // 2
    left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    ok = start <= p - half
    left[ok] = r.spans(p[ok] - half, p[ok])
    ok = end + span >= p + anchor + half
    right[ok] = r.spans(p[ok] + anchor, p[ok] + anchor + half)
    data = memoryview(text.encode("utf-32-le", "surrogatepass"))
    # a hash of another kind than the anchor's, so that texts made for the one do not defeat both
    around = np.array([xxhash.xxh3_64_intdigest(data[4 * a : 4 * (b + span)]) for a, b in zip(start.tolist(), end.tolist())], np.uint64)
    return h[p], p, start, end, around, left, right


def _leftmost(h: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the first place that holds its least one (repetitive texts have several)."""
    n = len(least)
    order = np.arange(len(h))
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = np.empty(n, np.int64)
    for a, b in zip(change.tolist(), [*change[1:].tolist(), n]):
        hits = order[a : b - 1 + w][h[a : b - 1 + w] == least[a]]
        if len(hits) == 1:
            out[a:b] = hits[0]
        else:
            out[a:b] = hits[np.searchsorted(hits, np.arange(a, b))]
    return out


ANCHORS = "doc_id bigint, h bigint, place int, first int, last int, around bigint, left bigint, right bigint"


def anchor_table(documents: DataFrame, span: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, p, a, b, c, x, y = anchors(text, span, anchor)
                for col, v in zip(cols, (np.full(len(h), doc, np.int64), h.view(np.int64), p.astype(np.int32), a.astype(np.int32), b.astype(np.int32), c.view(np.int64), x.view(np.int64), y.view(np.int64))):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["doc_id", "h", "place", "first", "last", "around", "left", "right"])

    return documents.where(F.length("text") >= span).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ANCHORS)


def window_table(documents: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """(doc_id, k1, k2, at) of each window named in places (doc_id, wanted array<struct<first, last>>); the keys are a 128-bit hash of its
    text. Places are sent to the documents where they are few, so that no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data, keys = text.encode("utf-32-le", "surrogatepass"), []
                ats = sorted({i for p in wanted for i in range(p["first"], p["last"] + 1)})
                for i in ats:
                    keys.append(xxhash.xxh3_128_digest(data[4 * i : 4 * (i + span)]))
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(ats), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ats, pa.int32())], ["doc_id", "k1", "k2", "at"])

    rows = documents.select(F.col("doc_id").cast("bigint"), "text").join(sized(places), "doc_id").select("doc_id", "text", "wanted")
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, at int")


def matches(documents: DataFrame, span: int, anchor: int | None = None) -> DataFrame:
    """(doc_id, first, last, grp): the windows first..last of `span` characters of a document that also stand in another document.

    documents: doc_id (unique) and text; null and shorter texts have no windows; other columns are ignored. grp names what is shared,
    the same for all documents that share it. Groups are only aggregated (least and greatest document), never paired, so a passage
    that a third of all documents hold costs as much as any other text. Tables are removed as soon as no later step reads them."""
    spark, anchor = documents.sparkSession, anchor or span // 3
    half = (span - anchor + 1) // 2
    found = written(anchor_table(documents, span, anchor), "anchors")
    two = [F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")]
    # places that meet in two documents
    meet = written(found.groupBy("h").agg(*two).where("_lo < _hi").select("h"), "meet")
    met = written(found.join(sized(meet), "h"), "met")
    dropped(spark, found, meet)
    # where all that these windows cover is the same in two documents, nothing is left to verify
    same = written(met.groupBy("h", "around").agg(*two).where("_lo < _hi").select("h", "around", F.lit(True).alias("sure")), "same")
    met_same = met.join(sized(same), ["h", "around"], "left")
    sure = written(met_same.where("sure").select("doc_id", "first", "last", F.col("around").alias("grp")), "sure")
    # elsewhere a shared window reaches the half on the left or on the right of its anchor, which must then be shared as well
    halves = [written(met.where(f"{side} <> 0").groupBy("h", side).agg(*two).where("_lo < _hi").select("h", side, F.lit(True).alias(f"by_{side}")), side) for side in ("left", "right")]
    tried = met_same.join(sized(halves[0]), ["h", "left"], "left").join(sized(halves[1]), ["h", "right"], "left").where("by_left or by_right")
    lo = F.when(F.col("by_left"), F.col("first")).otherwise(F.greatest("first", F.col("place") - half + 1))
    hi = F.when(F.col("by_right"), F.col("last")).otherwise(F.least("last", F.col("place") - half + (1 if (span - anchor) % 2 else 0)))
    tried = written(tried.select("doc_id", "h", "around", "sure", lo.alias("first"), hi.alias("last")).where("first <= last"), "tried")
    dropped(spark, met, same, *halves)
    unsure = tried.where("sure is null").select("doc_id", "h", "first", "last")
    # of the groups that they could match two documents each are enough
    ends = F.struct("doc_id", "first", "last")
    partners = tried.where("sure").join(sized(written(unsure.select("h").distinct(), "open")), "h", "left_semi").groupBy("h", "around").agg(F.min_by(ends, "doc_id").alias("p"), F.max_by(ends, "doc_id").alias("q"))
    partners = partners.select(F.explode(F.array("p", "q")).alias("x")).select("x.*")
    places = unsure.select("doc_id", "first", "last").union(partners).groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("wanted"))
    places = written(places, "places")
    dropped(spark, tried)
    windows = written(window_table(documents, places, span), "windows")
    # a window that stands twice is known by its two places; only those that stand more often are looked up again
    at = [F.min_by("at", F.col("doc_id")).alias("_at_lo"), F.max_by("at", F.col("doc_id")).alias("_at_hi"), F.count("*").alias("_n")]
    shared = written(windows.groupBy("k1", "k2").agg(*two, *at).where("_lo < _hi"), "shared")
    twice = shared.where("_n = 2").select(F.explode(F.array(F.struct(F.col("_lo").alias("doc_id"), F.col("_at_lo").alias("at")), F.struct(F.col("_hi").alias("doc_id"), F.col("_at_hi").alias("at")))).alias("x"), "k1").select("x.*", "k1")
    often = windows.join(sized(shared.where("_n > 2").select("k1", "k2")), ["k1", "k2"]).select("doc_id", "at", "k1")
    edge = twice.union(often).select("doc_id", F.col("at").alias("first"), F.col("at").alias("last"), F.col("k1").alias("grp"))
    out = written(sure.union(edge), "matches")
    dropped(spark, sure, places, windows, shared)
    return out


def sharing_documents(documents: DataFrame, span: int) -> DataFrame:
    """(doc_id) of the documents with a run of at least `span` characters that also stands in another one: those of shared_spans()."""
    return matches(documents, span).select("doc_id").distinct()


def shared_spans(documents: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end): the longest runs of a document that are covered by windows found elsewhere; runs do not overlap."""
    return _islands(matches(documents, span), span)


def _islands(found: DataFrame, span: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # windows that overlap or touch make one run
    runs = found.select("doc_id", "first", "last").distinct().withColumn("_new", F.when(before.isNull() | (F.col("first") > before + span), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "_run").agg(F.min("first").alias("start"), (F.max("last") + span).alias("end")).select("doc_id", "start", "end")


def shared_amounts(documents: DataFrame, span: int) -> DataFrame:
    """(doc_id, n_spans, shared_chars, n_chars, component) of each document: how much of it stands elsewhere, and the connected
    component of documents that share with each other (its least doc_id; a document that shares nothing is its own)."""
    found = matches(documents, span)
    amount = _islands(found, span).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    # each group is a star around its least document
    stars = found.select("doc_id", "grp").distinct()
    stars = stars.join(stars.groupBy("grp").agg(F.min("doc_id").alias("hub")), "grp").select("doc_id", "hub").distinct()
    parts = components(stars, "doc_id", "hub")
    out = documents.select(F.col("doc_id").cast("bigint"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    out = out.join(amount, "doc_id", "left").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"), "n_chars", F.coalesce("component", "doc_id").alias("component"))
