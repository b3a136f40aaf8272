import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import packing, tokens
from leafmill.llm.common import components, prefix_sums

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary")
TEXTS = [None, "", " ", "\n\t x", "Hello <|endoftext|> world's 123  ", "naïve café — 手順 📄", "\x00\x1c\x85 ", "ab" * 3000, "a" * 5000, "é" * 7, "don't DON'T we'll"]


def test_encoding_equals_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    rnd = random.Random(11)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x3000), rnd.randrange(0xE000, 0x10FFFF)])) for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, x, "other") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}


def test_encoding_of_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, tokens.encode(df).collect())) == sorted(["Row(doc_id=1, ids=[64, 275])"] * 2 + ["Row(doc_id=None, ids=[66])"])
    assert tokens.encode(df.limit(0)).collect() == []


def test_histogram_is_packed_whole():
    rnd = random.Random(2)
    for _ in range(60):
        c = rnd.randrange(1, 60)
        counts = {rnd.randrange(1, c + 1): rnd.randrange(0, 300) for _ in range(rnd.randrange(0, 20))}
        patterns = packing.pack_histogram(counts, c)
        placed = Counter()
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= c
            for x in lengths:
                placed[x] += n
        assert placed == Counter({k: n for k, n in counts.items() if n})
        need = sum(k * n for k, n in counts.items())
        assert sum(n for n, _ in patterns) <= 1 + 1.8 * need / c + max([0, *counts.values()])


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([5, 5, 5, rnd.randrange(1, 64), rnd.randrange(64, 900)])) for i in range(3000)] + [(7, 5), (7, 5), (9000, 0), (9001, None), (9002, -3), (None, 4)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = packing.pack(df, 64).collect()
    assert Counter((r["doc_id"]) for r in rows if r["piece_no"] == 0) == Counter(i for i, n in sizes if n and n > 0)
    used = Counter()
    for r in rows:
        used[r["container"]] += r["length"]
        assert r["piece_no"] == 0 or r["start"] == 64 * r["piece_no"]
    assert max(used.values()) <= 64 and sorted(used) == list(range(len(used)))
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    want = Counter()
    for i, n in sizes:
        want[i] += n if n and n > 0 else 0
    assert total == +want
    assert len(used) <= 1.03 * sum(used.values()) / 64 + 1
    assert packing.pack(df.limit(0), 64).collect() == []


def test_prefix_sums_with_a_hot_group(spark):
    rows = [("h" if i % 3 else None, i, i % 7) for i in range(500)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, i int, w int"), ["g"], ["i"], F.col("w"), "s").collect()
    run = Counter()
    want = {}
    for g, i, w in rows:
        want[i] = run[g]
        run[g] += w
    assert {r["i"]: r["s"] for r in got} == want


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
