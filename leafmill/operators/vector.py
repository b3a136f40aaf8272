"""Exact vector search in blocks, and the default embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_BYTES = 64 << 20
_ascii = re.compile("[a-z0-9]+").findall


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def vector_topk(items: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k items of highest cosine for each question (query_id, vector), rounded to 6 places.

    Questions are a stated, small set: blocks of them of about MOST_BYTES are sent to the workers one after the other; each task keeps
    its own k best of a question, so the shuffle carries k rows per task and question. `where` filters items before they are scored.
    Ties go to the lower key; null vectors, and vectors of another length than the longest item, are left out."""
    items = items.where(F.col(vector).isNotNull() if where is None else where & F.col(vector).isNotNull())
    spark, kind = items.sparkSession, dict(items.dtypes)[key]
    asked = questions.select("query_id", "vector").where("vector is not null")
    dim = items.select(F.max(F.size(vector))).first()[0] or 0
    asked = asked.where(F.size("vector") == dim)
    most = max(1, MOST_BYTES // (8 * max(dim, 1)))
    # blocks are read one at a time, each by its own part of the questions
    n = max(1, -(-asked.count() // most))
    parts = [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
    out = None
    for part in parts:
        block = part.collect()
        ids = np.array([r["query_id"] for r in block], np.int64)
        m = np.array([r["vector"] for r in block], np.float64).reshape(-1, dim)
        sent = spark.sparkContext.broadcast((ids, _unit(m), dim))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, dim = sent.value
            keep_k: list[np.ndarray] = []
            keep_s = np.zeros((len(ids), 0))
            names: list = []
            for b in batches:
                ok = [(x, v) for x, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == dim]
                if not ok or not len(ids):
                    continue
                s = np.round(q @ _unit(np.array([v for _, v in ok], np.float64)).T, 6)
                at = len(names)
                names += [x for x, _ in ok]
                place = np.broadcast_to(np.arange(at, at + len(ok)), s.shape)
                keep_s = np.concatenate([keep_s, s], axis=1)
                keep_k = np.concatenate([keep_k, place], axis=1) if len(keep_k) else place
                if keep_s.shape[1] > 4 * k + 1024:
                    order = np.argsort(-keep_s, axis=1, kind="stable")
                    order = [[*o[:k], *(i for i in o[k:] if row[i] == row[o[k - 1]])] for o, row in zip(order, keep_s)]
                    width = max(map(len, order))
                    if width < keep_s.shape[1]:
                        order = np.array([[*o, *o[:1] * (width - len(o))] for o in order])
                        keep_s, keep_k = np.take_along_axis(keep_s, order, 1), np.take_along_axis(keep_k, order, 1)
            rows = {(int(i), names[p], float(x)) for i, ps, xs in zip(ids, keep_k, keep_s) for p, x in zip(ps, xs)}
            by: dict[int, list] = {}
            for i, x, s in rows:
                by.setdefault(i, []).append((-s, x))
            top = [(i, x, -s) for i, l in by.items() for s, x in sorted(l)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in top], pa.int64()), pa.array([t[1] for t in top], pa.int64()), pa.array([t[2] for t in top], pa.float64())], ["query_id", "key", "score"])

        found = items.select(F.col(key).cast("bigint"), vector).mapInArrow(best, "query_id bigint, key bigint, score double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("key", F.col("key").cast(kind))


def hash_embed(text: Column, dim: int = 64) -> Column:
    """The default embedding: hashed bag of words, of length one; all zeros for a null text or one without words.

    Arrow batches: folding words into buckets as a plan expression costs dim steps a word, a counter one."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def bucket(t: str) -> int:
            if t not in known:
                if len(known) > 500_000:
                    known.clear()
                known[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
            return known[t]

        def one(t: str | None) -> np.ndarray:
            found = [bucket(w) for w in _ascii(t.lower())] if isinstance(t, str) else []
            v = np.bincount(found, minlength=dim).astype(np.float64) if found else np.zeros(dim)
            n = np.sqrt((v * v).sum())
            return v / n if n else v

        return texts.map(one)

    return embed(text)
