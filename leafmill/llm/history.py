"""Deduplicating new batches against all history with bit-difference fingerprints in rotated block tables.

A document's fingerprint is a row of LANES byte-wide lanes, each the low byte of a MinHash of its word sequences; the share of differing
lanes estimates the distance of two texts. The full MinHashes are cut into rotated blocks, one table each: documents that agree in a
whole block are candidates, checked by the Hamming distance of their fingerprints and then by their word sequences themselves. With
32 tables of 4 lanes, texts that overlap by 0.7 meet in some table with a probability of 0.9998, by 0.65 of 0.998.

A batch is checked against a store of what was accepted before it: its block keys are looked up in the stored block table, the
fingerprints and texts of just the documents found are read, and what the batch adds is appended in one commit. The stored tables are
never fingerprinted, shuffled or rewritten again."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import common
from leafmill.llm.common import filesystem, new_path, row_bytes, sized, written

LANES, TABLES = 128, 32
WIDTH = LANES // TABLES
SHINGLE, LEAST_WORDS, OVERLAP = 3, 50, 0.6
#: Fingerprints of texts that overlap by 0.6 agree in 77 of 128 lanes on average, with a deviation of 5.5.
LEAST_LANES = 48
#: Members of a block that all others are compared with in the first round; four times as many in each further one.
HUBS = 64
#: Kinds of keys: file hash, hash of all words, block of lanes.
HASH, WORDS, BLOCK = 0, 1, 2
#: Folders that stored fingerprints and texts are spread over; a lookup reads only those of the documents it found. More for larger stores.
SLOTS = 8
#: Batches that the first load of a backlog takes; every load is some hundred small stages, whatever it holds.
FIRST_LOAD = 6
_words = re.compile(r"[^\W_]+").findall
_rng = np.random.Generator(np.random.PCG64(20_240_229))
_A = _rng.integers(1, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, LANES, dtype=np.uint32)
_M = [np.uint64(x | 1) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64).tolist()]
COLUMNS = ["doc_id", "batch_no", "hash", "text"]
PRINTS = "doc_id bigint, batch_no int, hkey string, ckey string, lanes binary, blocks array<bigint>"


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, seen: _WordHash, size: int = SHINGLE, least: int = LEAST_WORDS) -> tuple[np.ndarray | None, str]:
    """(hashes of the word sequences in order, 128-bit hash of all words); (None, "") if there are fewer words than `least`."""
    words = _words(text.lower()) if text else []
    if len(words) < max(least, size):
        return None, ""
    w = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    s = np.zeros(n, np.uint64)
    for i in range(size):
        s = _mixed(s + w[i : i + n] * _M[i])
    return s, xxhash.xxh3_128_hexdigest(w.tobytes())


def min_hashes(s: np.ndarray) -> np.ndarray:
    """The LANES MinHashes of a set of hashes, from their high halves (32-bit products are vectorised)."""
    low, high = np.full(LANES, 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 256):  # products stay in the cache
        low = np.minimum(low, (high[i : i + 256, None] * _A + _B).min(axis=0))
    return low


def plain_hash(h: Column) -> Column:
    """A file hash without letter case and leading algorithm name; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(h)), r"^(?:sha|md|blake|crc|xxh)[a-z0-9\-/_]*[:=\s]+", ""), F.lit(""))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, batch_no, hkey, ckey, lanes, blocks): ckey, lanes and blocks are null for texts of fewer than 50 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            ckeys, lanes, blocks = [], [], []
            for text in batch.column(3).to_pylist():
                s, key = shingles(text, seen)
                if s is None:
                    ckeys.append(None), lanes.append(None), blocks.append(None)
                    continue
                low = min_hashes(s)
                ckeys.append(key)
                lanes.append(low.astype(np.uint8).tobytes())
                rows = low.astype(np.uint64).reshape(TABLES, WIDTH)
                key = np.arange(TABLES, dtype=np.uint64)
                for i in range(WIDTH):
                    key = _mixed(key + rows[:, i] * _M[i])
                blocks.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ckeys, pa.string()), pa.array(lanes, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))],
                ["doc_id", "batch_no", "hkey", "ckey", "lanes", "blocks"],
            )

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("batch_no").cast("int"), plain_hash(F.col("hash")).alias("hkey"), "text")
    return narrow.mapInArrow(run, PRINTS)


def near_prints(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, la, lb) whose fingerprints agree in enough lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, LANES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_LANES))

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a bigint, b bigint")


def overlapping(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) whose texts' word sequences overlap by OVERLAP; texts: (node, text). Each text is hashed once."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            found = [shingles(t, seen)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if s is None else np.unique(s).tobytes() for s in found], pa.binary())], ["node", "s"])

    sets = written(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(hashed, "node bigint, s binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) if v.is_valid else np.zeros(0, np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= OVERLAP * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return p.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _hubs(members: DataFrame, most: int) -> DataFrame:
    """(key, hubs): the `most` earliest nodes of each block."""
    # a salted first pass keeps a block that holds a third of all nodes from being sorted in one task
    w = Window.partitionBy("key", "_salt").orderBy("ord", "node")
    few = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(64))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    hubs = few.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("ord", "node"))), 1, most).alias("hubs"))
    return hubs.select("key", F.col("hubs.node").alias("hubs"))


def _meetings(blocks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): each block's hubs with all of its members, once a pair, and the members left, among which the rest must meet.

    blocks: (key, node, ord, dead). Dead nodes are no hubs, so that two of them do not meet, but each meets every hub."""
    met = blocks.join(_hubs(blocks.where("not dead"), most), "key")
    pairs = met.select("node", F.explode("hubs").alias("hub")).where("hub <> node").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return pairs, met.where(~F.array_contains("hubs", F.col("node"))).drop("hubs")


def _open_blocks(members: DataFrame) -> DataFrame:
    """The members of blocks that hold two or more nodes, at least one of them not dead; _n: how many."""
    many = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("dead").alias("_dead")).where("_n > 1 and not _dead")
    return members.join(sized(written(many.select("key", "_n"), "open")), "key")


def gathered(*tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What puts a table into one partition if all of these together take at most a broadcast's bytes, so that joins and aggregates over
    it are single stages; beyond that it leaves it as it is. Only the plan depends on it."""
    size = sum(t.agg(F.sum(row_bytes(t.schema))).first()[0] or 0 for t in tables)
    return (lambda df: df.coalesce(1)) if size <= common.MOST_BYTES else (lambda df: df)


def resolve(docs: DataFrame, edges: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """docs with their state: A accepted, R rejected, U open, and whether they are busy. docs: (doc_id, ord, hkey, node, state, twin).

    A document is rejected once an accepted one shares its hash or node or has a similar node, and accepted once no earlier document
    does that is not rejected; nodes in `blocked` have comparisons open and cannot be accepted yet. Each round decides all documents
    whose earlier neighbours are decided; groups are only ever aggregated to their earliest members. Documents that are no twin (no
    other one has their hash or words) and in no edge are not busy: they are decided at once and take no part in the rounds."""
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    linked = sized(written(both.select("node").distinct(), "linked")).withColumn("_g", F.lit(True))
    marks = docs.join(linked, "node", "left")
    if blocked is not None:
        marks = marks.join(sized(written(blocked.select("node").distinct(), "held")).withColumn("held", F.lit(True)), "node", "left")
    else:
        marks = marks.withColumn("held", F.lit(None).cast("boolean"))
    columns = ["doc_id", "ord", "hkey", "node", "state", "held"]
    marks = written(marks.select(*columns, (F.col("twin") | F.col("_g").isNotNull()).alias("busy")), "marks")
    alone = marks.where("not busy").withColumn("state", F.when(F.col("held") | (F.col("state") != "U"), F.col("state")).otherwise("A"))
    busy, first = marks.where("busy").select(*columns), lambda state: F.min(F.when(F.col("state") == state, F.col("ord"))) if state else F.min("ord")
    one = gathered(busy, edges)
    docs, both, was = one(busy), one(both), None
    while True:
        live = docs.where("state <> 'R'")
        by_hash = live.where("hkey is not null").groupBy("hkey").agg(first("").alias("h1"), first("A").alias("ha")).hint("merge")
        by_node = live.groupBy("node").agg(first("").alias("n1"), first("A").alias("na")).hint("merge")
        near = both.join(by_node.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("n1").alias("x1"), F.min("na").alias("xa")).hint("merge")
        j = docs.where("state = 'U'").join(by_hash, "hkey", "left").join(by_node, "node", "left").join(near, "node", "left")
        j = j.withColumn("_a", F.least("ha", "na", "xa")).withColumn("_1", F.least("h1", "n1", "x1"))
        state = F.when(F.col("_a").isNotNull(), "R").when(F.col("held").isNull() & (F.col("_1") >= F.col("ord")), "A").otherwise("U")
        new = written(docs.where("state <> 'U'").union(j.withColumn("state", state).select(*columns)), "states")
        left = new.where("state = 'U'").count()
        if not left or left == was:
            return new.withColumn("busy", F.lit(True)).union(alone.select(*columns, F.lit(False))).drop("held")
        docs, was = one(new), left


class History:
    """Accepted documents in a folder, appended part by part.

    keys: (key, exact, node, part), bucketed by key as the keys of a batch are, so that a lookup shuffles nothing that is stored.
    lanes, text: (doc_id, lanes or text, part) in SLOTS folders by doc_id; a lookup reads only the folders of the documents it found.
    A part counts once its commit mark is there: rows of a failed append are never read, and the next append takes another number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the store, or makes an empty one of `buckets` buckets (the session's shuffle partitions by default)."""
        self.spark, self.path = spark, path.rstrip("/")
        layout = self._names("layout")
        self.buckets = int(layout[0]) if layout else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not layout:
            self._mark("layout", str(self.buckets))
        self.tables: list[str] = []
        self.stored = self._bucketed(f"{self.path}/keys", "part int")

    def _bucketed(self, path: str, more: str) -> str:
        """The name of a table of keys in buckets, in the session's catalogue only: the files stay when the name goes. Keys are hashes,
        which no codec makes smaller."""
        name = "leafmill_" + hashlib.md5(path.encode()).hexdigest()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key bigint, exact string, node bigint, {more}) USING parquet OPTIONS (compression 'snappy') CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.tables.append(name)
        return name

    def _names(self, kind: str) -> list[str]:
        fs, p = filesystem(self.spark, f"{self.path}/{kind}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _mark(self, kind: str, name: str) -> None:
        fs, p = filesystem(self.spark, f"{self.path}/{kind}/{name}")
        fs.create(p, False).close()

    def parts(self) -> list[int]:
        return [int(x) for x in self._names("commits")]

    def _committed(self, rows: DataFrame) -> DataFrame:
        parts = self.parts()
        failed = sorted({int(x) for x in self._names("begun")} - set(parts))
        return rows.where((F.col("part") <= max(parts, default=-1)) & ~F.col("part").isin(failed))

    def staged(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch (key, exact, node) as a table in the store's buckets: shuffled once, for all that is asked of it."""
        name = self._bucketed(new_path(self.spark, "keys"), "kind tinyint")
        keys.select("key", "exact", "node", "kind").repartition(self.buckets, "key").write.insertInto(name)
        return self.spark.table(name)

    def touched(self, staged: DataFrame) -> DataFrame:
        """(key, node, kind, old, n) of a batch's keys that a stored document `old` has, or n > 1 nodes of the batch.

        Each key is looked up once, however many nodes have it."""
        held = self._committed(self.spark.table(self.stored)).select("key", F.col("exact").alias("_e"), F.col("node").alias("old"))
        # the full key is compared in a case, as an equality would become one more key to shuffle by
        equal = F.coalesce(F.when(F.col("exact").isNull(), F.col("_e").isNull()).otherwise(F.col("exact") == F.col("_e")), F.lit(False))
        # hashed by bucket, not sorted: a bucket holds no more of a batch than the store's layout lets it
        asked = staged.groupBy("key", "exact").agg(F.count("*").alias("n")).hint("shuffle_hash").join(held, "key", "left")
        asked = asked.withColumn("old", F.when(equal, F.col("old"))).where("n > 1 or old is not null").select("key", F.col("exact").alias("_e"), "n", "old")
        return written(staged.join(sized(written(asked, "asked")), "key").where(equal).select("key", "node", "kind", "old", "n"), "touched")

    def joined(self, ids: DataFrame, by: str, column: str) -> DataFrame:
        """ids, a written table, with `column` (lanes or text) of the stored documents that its column `by` names."""
        slots = [r[0] for r in ids.select(F.pmod(F.xxhash64(by), F.lit(SLOTS)).alias("s")).distinct().collect()]  # at most SLOTS rows
        if not slots:
            return ids.withColumn(column, F.lit(None).cast("binary" if column == "lanes" else "string"))
        held = self.spark.read.schema(f"doc_id bigint, {column} {'binary' if column == 'lanes' else 'string'}, part int, slot int").parquet(f"{self.path}/{column}")
        held = self._committed(held).where(F.col("slot").isin(slots)).select(F.col("doc_id").alias(by), column)
        return held.join(sized(ids), by).select(*ids.columns, column)

    def append(self, keys: DataFrame, *documents: DataFrame) -> None:
        """Adds accepted documents as one part: their keys (key, exact, node), and two tables (doc_id, lanes) and (doc_id, text)."""
        part = max([int(x) for x in self._names("begun")], default=-1) + 1
        self._mark("begun", f"{part:09d}")
        keys.select("key", "exact", "node", F.lit(part).alias("part")).repartition(self.buckets, "key").write.insertInto(self.stored)
        for rows in documents:
            rows = rows.withColumn("part", F.lit(part)).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
            # several files a folder where the store is large
            rows = rows.repartition("slot", F.pmod(F.col("doc_id"), F.lit(max(1, self.buckets // SLOTS))))
            rows.write.mode("append").option("compression", "zstd").partitionBy("slot").parquet(f"{self.path}/{rows.columns[1]}")
        self._mark("commits", f"{part:09d}")

    def close(self) -> None:
        """Takes the tables' names out of the session's catalogue; the folder stays."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def document_keys(prints: DataFrame, kinds: tuple[int, ...] = (HASH, WORDS, BLOCK)) -> DataFrame:
    """(key, exact, node, kind) of fingerprints() rows; exact is the full hash behind a key, null for blocks, which are hashes of lanes."""
    entry = lambda kind, key, exact: F.struct(key.alias("key"), exact.cast("string").alias("exact"), F.lit(kind).cast("tinyint").alias("kind"))
    none = F.array().cast("array<struct<key:bigint,exact:string,kind:tinyint>>")
    parts = [F.when(F.col(c).isNotNull(), F.array(entry(k, F.xxhash64(F.lit(k), F.col(c)), F.col(c)))) for k, c in ((HASH, "hkey"), (WORDS, "ckey")) if k in kinds]
    parts += [F.transform("blocks", lambda b: entry(BLOCK, b, F.lit(None)))] if BLOCK in kinds else []
    return prints.select(F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("k"), F.col("doc_id").alias("node")).select("k.*", "node")


@dataclass
class Checked:
    """What check_batch() found. pairs: (doc_id, accepted_id) of each rejected document and every accepted one it repeats. states:
    (doc_id, node, state), A or R. prints: fingerprints() rows. keys: the batch's keys in the store's buckets."""

    pairs: DataFrame
    states: DataFrame
    prints: DataFrame
    keys: DataFrame


def check_batch(documents: DataFrame, history: History) -> Checked:
    """New documents, checked against the history and each other in order (batch_no, doc_id).

    Documents need doc_id (unique, and not in the history), batch_no, hash, text; other columns are ignored. Null and empty hashes equal
    nothing; texts that are null or have under 50 words only compare by hash; null batch numbers come first. An empty frame gives empty
    frames.

    Documents with the same words are one node, so copies are never compared with each other; a hash or node that a third of all
    documents have is only aggregated, and asked for once."""
    prints = written(fingerprints(documents.select(*COLUMNS)), "prints")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("node"), "text")
    ord_ = F.struct("batch_no", "doc_id")
    # the earliest document with the same words stands for all of them
    many = sized(written(prints.where("ckey is not null").groupBy("ckey").agg(F.count("*").alias("n")).where("n > 1").select("ckey"), "many"))
    reps = prints.select("ckey", "batch_no", "doc_id").join(many, "ckey", "left_semi").groupBy("ckey").agg(F.min(ord_).alias("o")).select("ckey", F.col("o.doc_id").alias("rep"))
    docs = prints.select("doc_id", ord_.alias("ord"), "hkey", "ckey").join(sized(written(reps, "reps")), "ckey", "left").select("doc_id", "ord", "hkey", F.coalesce("rep", "doc_id").alias("node"))
    docs = written(docs, "docs")
    later = written(docs.where("node <> doc_id").select("doc_id", "node"), "copies")
    copies = later.select(F.col("doc_id").alias("node")).union(later.select("node"))
    first = prints.join(sized(later.select("doc_id")), "doc_id", "left_anti")
    nodes = sized(first.where("lanes is not null").select(F.col("doc_id").alias("node"), "lanes"))
    keys = history.staged(document_keys(prints, (HASH,)).unionByName(document_keys(first, (WORDS, BLOCK))))
    touched = history.touched(keys)
    kind = lambda k: touched.where((F.col("kind") == k) & F.col("old").isNotNull())
    old_hash = kind(HASH).select(F.col("node").alias("doc_id"), F.col("old").alias("accepted_id")).distinct()
    same = kind(WORDS).select(F.col("node").alias("a"), F.col("old").alias("b")).distinct()
    met = written(kind(BLOCK).select(F.col("node").alias("a"), F.col("old").alias("b")).distinct().join(same, ["a", "b"], "left_anti"), "met")
    close_old = near_prints(history.joined(met, "b", "lanes").withColumnRenamed("lanes", "lb").join(nodes.toDF("a", "la"), "a"))
    # and with each other
    members = touched.where((F.col("kind") == BLOCK) & (F.col("n") > 1)).select("key", "node", F.lit(False).alias("dead"), F.col("n").alias("_n")).distinct()
    rest = written(members.join(docs.select("node", "doc_id", "ord").where("node = doc_id").drop("doc_id"), "node"), "blocks")
    most, largest = HUBS, rest.agg(F.max("_n")).first()[0] or 0
    close = written(close_old.withColumn("old", F.lit(True)).union(_close(_meetings(rest, most)[0], nodes).withColumn("old", F.lit(False))), "close")
    stored = history.joined(written(close.where("old").select(F.col("b").alias("node")).distinct(), "asked"), "node", "text")
    # ids of the history and of the batch differ, so a pair is of one kind
    edges = overlapping(close.select("a", "b"), texts.unionByName(stored)).join(close, ["a", "b"])
    edges = written(edges.union(same.withColumn("old", F.lit(True))), "edges")
    old_edges, edges, tested = edges.where("old").select("a", "b"), edges.where("not old").select("a", "b"), close.where("not old").select("a", "b")
    twins = touched.where((F.col("kind") == HASH) & (F.col("n") > 1)).select("node").union(copies.select("node")).distinct()
    known = docs.join(sized(written(old_edges.select(F.col("a").alias("node")).distinct(), "near")).withColumn("_t", F.lit(True)), "node", "left")
    known = known.join(sized(written(old_hash.select("doc_id").distinct(), "same")).withColumn("_h", F.lit(True)), "doc_id", "left")
    known = known.join(sized(written(twins, "twins")).select(F.col("node").alias("doc_id"), F.lit(True).alias("_w")), "doc_id", "left")
    states = written(known.select("doc_id", "ord", "hkey", "node", F.when(F.coalesce("_t", "_h", F.lit(False)), "R").otherwise("U").alias("state"), F.coalesce("_w", F.lit(False)).alias("twin")), "known")
    while largest > most:  # blocks with members that have not met yet
        rest = written(_open_blocks(_meetings(rest, most)[1].drop("_n")), "rest")
        live = resolve(states, edges, rest).where("state <> 'R'").select("node").distinct().withColumn("_live", F.lit(True))
        rest = written(_open_blocks(rest.join(live, "node", "left").withColumn("dead", F.col("_live").isNull()).drop("_live", "_n")), "marked")
        most, largest = most * 4, rest.agg(F.max("_n")).first()[0] or 0
        if largest:
            more = written(_close(_meetings(rest, most)[0].join(tested, ["a", "b"], "left_anti"), nodes), "close")
            edges, tested = edges.union(written(overlapping(more, texts), "edges")), tested.union(more)
    states = resolve(states, edges, None)
    one = gathered(states.where("busy"), edges)
    busy, both = one(states.where("busy")), one(edges.union(edges.select("b", "a")).toDF("node", "other"))
    accepted, rejected = busy.where("state = 'A'"), busy.where("state = 'R'")
    same_hash = accepted.where("hkey is not null").select("hkey", F.col("doc_id").alias("accepted_id"), F.col("ord").alias("_before"))
    by_hash = rejected.join(same_hash.hint("merge"), "hkey").where("_before < ord").select("doc_id", "accepted_id")
    holders = accepted.select(F.col("node").alias("other"), F.col("doc_id").alias("accepted_id"), F.col("ord").alias("_before"))
    links = one(both.union(busy.select("node", F.col("node").alias("other")).distinct()))
    by_text = rejected.join(links.hint("merge"), "node").join(holders.hint("merge"), "other").where("_before < ord").select("doc_id", "accepted_id")
    old_text = docs.select("doc_id", "node").join(sized(old_edges.select(F.col("a").alias("node"), F.col("b").alias("accepted_id"))), "node").select("doc_id", "accepted_id")
    pairs = by_hash.union(by_text).union(old_hash).union(old_text).distinct()
    return Checked(pairs, states.select("doc_id", "node", "state"), prints, keys)


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """near_prints() of pairs (a, b) of nodes (node, lanes)."""
    return near_prints(pairs.join(nodes.toDF("a", "la"), "a").join(nodes.toDF("b", "lb"), "b"))


def accept(documents: DataFrame, history: History) -> DataFrame:
    """Checks a new batch against the history and appends what is accepted to it; (doc_id, accepted_id) of the rejected ones."""
    found = check_batch(documents, history)
    pairs = written(found.pairs, "pairs")
    new = written(found.states.where("state = 'A'").select("doc_id", "node"), "accepted")
    ids, later = sized(new.select("doc_id")), sized(new.where("doc_id <> node").select("doc_id"))
    # an accepted document whose words an earlier, rejected one had first
    keys = found.keys.join(ids.withColumnRenamed("doc_id", "node"), "node", "left_semi").unionByName(document_keys(found.prints.join(later, "doc_id", "left_semi"), (WORDS, BLOCK)))
    lanes = found.prints.where("lanes is not null").select("doc_id", "lanes").join(ids, "doc_id", "left_semi")
    history.append(keys, lanes, documents.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id", "left_semi"))
    return pairs


def loads(batches: list, first: int = FIRST_LOAD) -> list[list]:
    """The batches of a backlog in loads that double: each takes as many as the store then holds, so that n batches need log n loads and
    all lookups together read the store about twice. A batch that arrives later is a load of its own."""
    out: list[list] = []
    while batches:
        n = max(first, sum(map(len, out)))
        out, batches = [*out, batches[:n]], batches[n:]
    return out


def repeats(documents: DataFrame, history: History | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b) of each rejected document and the accepted one it repeats, smaller id first.

    The table is a backlog of batches: loads() of them go through the store one after the other, each checked against what was
    accepted before and within itself in order of arrival. A load reads its own rows only, which a table partitioned by batch_no finds by
    its folders. Null batch numbers come first. The result does not depend on the loads."""
    spark = documents.sparkSession
    store = history or History(spark, new_path(spark, "history"))
    batches = sorted((r[0] for r in documents.select("batch_no").distinct().collect()), key=lambda b: (b is not None, b))
    found = []
    for load in loads(batches):
        own = F.col("batch_no").isin([b for b in load if b is not None])
        found.append(accept(documents.where(own | F.col("batch_no").isNull() if None in load else own), store))
    if history is None:
        store.close()
    none = spark.createDataFrame([], "doc_id bigint, accepted_id bigint")
    pairs = functools.reduce(DataFrame.union, found, none)
    return pairs.select(F.least("doc_id", "accepted_id").alias("doc_id_a"), F.greatest("doc_id", "accepted_id").alias("doc_id_b")).distinct()
