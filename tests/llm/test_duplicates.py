import random
import re

import numpy as np
import pytest

from leafmill.llm import common, history, residue, shared_spans

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.35:
            t = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 3, 8, 20])):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            t = " ".join(t)
        elif kind < 0.4:
            t = rnd.choice([None, "", " ", "short text"])
        else:
            t = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(40, 160)))
        if t and len(t) > 60:
            texts.append(t)
        h = rnd.choice([None, "", f"{rnd.randrange(30):064x}", f"sha256:{rnd.randrange(30):064X}", f"{rnd.randrange(10**9):064x}"])
        rows.append((i, rnd.choice([1, 2, 3]), h, t, f"f{i}"))
    return rows


def brute(rows):
    accepted, pairs = [], set()
    for i, b, h, t, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        k = re.sub("^sha256:", "", h.lower()) if h else None
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        s = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 50 else None
        hit = [a for a, ak, s2 in accepted if (k and ak == k) or (s and s2 and len(s & s2) >= 0.6 * len(s | s2))]
        pairs |= {(min(i, a), max(i, a)) for a in hit}
        if not hit:
            accepted.append((i, k, s))
    return pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, batch_no int, hash string, text string, filename string")


def test_repeats_equal_the_sequential_rule(spark, monkeypatch):
    rows = corpus()
    for first in (1, 4):
        monkeypatch.setattr(history.loads, "__defaults__", (first,))
        assert {tuple(r) for r in history.repeats(frame(spark, rows)).collect()} == brute(rows)
    assert history.loads([1, 2, 3, 4, 5, 6], 1) == [[1], [2], [3, 4], [5, 6]]
    assert history.repeats(frame(spark, rows).limit(0)).collect() == []


def test_hot_copies_and_near_copies(spark):
    base = [WORDS[i % 400] for i in range(120)]
    rows = [(i, 1, None, " ".join(base), "f") for i in range(60)]
    rows += [(100 + i, 2, None, " ".join([*base[:i], "new", *base[i + 1 :]]), "f") for i in range(60)]
    rows += [(200 + i, 3, "AB" * 32, f"t{i}", "f") for i in range(40)]
    assert {tuple(r) for r in history.repeats(frame(spark, rows)).collect()} == brute(rows)


def test_large_blocks_keep_pairs_with_all_accepted_documents(spark):
    rnd = random.Random(4)
    first = [f"a{i}" for i in range(150)]
    other = [*first[:107], *(f"b{i}" for i in range(43))]
    between = [*first[:128], *other[128:]]

    def changed(i):
        at = rnd.randrange(150)
        return " ".join([*between[:at], f"new{i}", *between[at + 1 :]])

    # `other` is accepted, and no hub of its blocks; the documents after it repeat both it and `first`
    rows = [(0, 1, None, " ".join(first), "f"), *((1 + i, 2, None, changed(i), "f") for i in range(20))]
    rows += [(50, 3, None, " ".join(other), "f"), *((100 + i, 4, None, changed(100 + i), "f") for i in range(40))]
    want = brute(rows)
    assert len(want) == 20 + 2 * 40
    assert {tuple(r) for r in history.repeats(frame(spark, rows)).collect()} == want


def test_batches_against_a_store(spark, tmp_path):
    rows = corpus(5, 45)
    store = history.History(spark, str(tmp_path / "store"))
    got = set()
    for b in (1, 2, 3):
        got |= {(min(r), max(r)) for r in history.accept(frame(spark, [r for r in rows if r[1] == b]), store).collect()}
    assert got == brute(rows)


def test_rows_of_a_failed_append_do_not_count(spark, tmp_path):
    rows = corpus(7, 40)
    store = history.History(spark, str(tmp_path / "store"), buckets=3)
    first, second = [r for r in rows if r[1] == 1], [r for r in rows if r[1] > 1]
    pairs = {tuple(r) for r in history.accept(frame(spark, first), store).collect()}
    commit, store._mark = store._mark, lambda kind, name: commit(kind, name) if kind != "commits" else None
    history.accept(frame(spark, second), store)  # ends before its commit
    again = history.History(spark, str(tmp_path / "store"))
    assert again.buckets == 3 and again.parts() == [0]
    pairs |= {tuple(r) for r in history.accept(frame(spark, second), again).collect()}
    assert {(min(p), max(p)) for p in pairs} == brute(rows) and again.parts() == [0, 2]


def test_rejected_document_of_a_large_block_meets_all_it_repeats(spark, monkeypatch):
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        parts = [[*base[: 24 * j], *(f"x{g}.{j}.{i}" for i in range(24)), *base[24 * j + 24 :]] for j in range(5)]
        rows += [(100 * g + j, 1 + j % 2, None, " ".join(p + [f"y{g}.{j}.{i}" for i in range(18)]), "f") for j, p in enumerate(parts)]
        rows += [(100 * g + 50, 3, None, " ".join(base), "f"), (100 * g + 51, 3, None, " ".join([*base[:-1], "last"]), "f")]
    want = brute(rows)
    for hubs in (1, 64):
        monkeypatch.setattr(history, "HUBS", hubs)
        one_batch = [(i, 1, h, t, f) for i, _, h, t, f in rows]
        assert {tuple(r) for r in history.repeats(frame(spark, rows)).collect()} == want
        assert {tuple(r) for r in history.repeats(frame(spark, one_batch)).collect()} == brute(one_batch)


def test_broadcast_or_shuffle_give_the_same(spark, monkeypatch):
    rows = corpus(11, 50)
    for most in (0, 1 << 40):
        monkeypatch.setattr(common, "MOST_BYTES", most)
        assert {tuple(r) for r in history.repeats(frame(spark, rows)).collect()} == brute(rows)


def shared_brute(texts, span):
    grams = {}
    for i, t in texts.items():
        for j in range(len(t or "") - span + 1):
            grams.setdefault(t[j : j + span], set()).add(i)
    out = {}
    for i, t in texts.items():
        covered = set()
        for j in range(len(t or "") - span + 1):
            if len(grams[t[j : j + span]]) > 1:
                covered |= set(range(j, j + span))
        if covered:
            out[i] = len(covered)
    return out


@pytest.mark.parametrize("most", [0, 1 << 40])
def test_shared_spans(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BYTES", most)
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdé \n📄") for _ in range(n))
    passages = [make(n) for n in (29, 30, 31, 45, 120)]
    texts = {0: None, 1: "", 2: "x" * 29, 3: "ab" * 100, 4: "ab" * 90}
    for i in range(5, 45):
        texts[i] = make(rnd.randrange(0, 80)) + "".join(rnd.choice(passages) + make(rnd.randrange(0, 20)) for _ in range(rnd.randrange(0, 3))) + make(rnd.randrange(0, 60))
    texts |= {i: texts[10] + texts[11] for i in range(50, 60)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, h int")
    want = shared_brute(texts, 30)
    assert {r[0] for r in shared_spans.sharing_documents(df, 30).collect()} == set(want)
    rows = {r["doc_id"]: r for r in shared_spans.shared_amounts(df, 30).collect()}
    assert {i: r["shared_chars"] for i, r in rows.items() if r["shared_chars"]} == want and set(rows) == set(texts)
    assert len({rows[i]["component"] for i in range(50, 60)}) == 1
    assert shared_spans.sharing_documents(df.limit(0), 30).collect() == []


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 3, 7, 200):
        assert shared_spans.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]


def test_residue(spark):
    yes = ["[Empty page]", " [Summarization failed]\n", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet", "TBD TBD TBD", "[74834] Dit document is tijdelijk niet beschikbaar. Probeer het later opnieuw.", "The export of {{unit_name}} holds 5 rows.",
           "Oops! We can't seem to find what you were looking for. Error code: 549", "HTTP Error 503: the service is temporarily unavailable. Please try again later.", "This page describes XXXX and was last changed on XXXX.", "=== Page 3 ===\nPlease enable JavaScript to view this page."]
    no = [None, "", " \n", "Incident report on the 503 errors seen by users of Lomvik: cause and measures.", "Browsers must have JavaScript enabled for the module; the page describes how.", "The page explains how {{datum}} and similar merge fields in letter templates are filled by Oxaris.",
          "The guideline forbids lorem ipsum in published pages.", "=== Page 3 ===", "This section lists the error pages, among them 'Page not found' (404)."]
    rows = [(i, t, "x") for i, t in enumerate(yes + no + yes)]
    df = spark.createDataFrame(rows, "id long, summary_text string, node string")
    n = len(yes)
    assert {r["id"] for r in residue.residue_rows(df).collect()} == {*range(n), *range(n + len(no), 2 * n + len(no))}
    assert residue.residue_rows(df.limit(0)).collect() == []


def test_labels_spread_over_near_duplicates(spark, monkeypatch):
    rnd = random.Random(3)
    steps = [" ".join(rnd.choice(sorted(residue.FILLER_WORDS)) for _ in range(60))]
    for i in range(3):  # each further from the trusted text, and near the one before
        steps.append(steps[-1] + "".join(f" strange{'abc'[i]}{'bcdfghjk'[j]}" for j in range(8)))
    assert [residue.trusted_residue(t) for t in steps] == [True, False, False, False]
    other = "A quarterly report on the credit desk and on what its owners agreed in the spring."
    rows = [(1, "lorem ipsum dolor sit amet " * 9)] + [(10 + i, t) for i, t in enumerate(steps)] + [(20, steps[2].upper()), (30, other), (31, other), (32, None)]
    for most in (0, 1 << 40):
        monkeypatch.setattr(common, "MOST_BYTES", most)
        got = {r["id"]: r["kind"] for r in residue.residue_rows(spark.createDataFrame(rows, "id long, summary_text string")).collect()}
        assert got == {1: "residue", 10: "residue", 11: "near", 12: "near", 13: "near", 20: "near"}


def test_labels_reach_every_text_that_overlaps_enough(spark):
    rnd = random.Random(6)
    filler, letters = sorted(residue.FILLER_WORDS), "bcdfghjklmnp"
    rows, want = [], set()
    for i in range(60):
        known = [rnd.choice(filler) for _ in range(60)]
        added = ["".join(rnd.choice(letters) for _ in range(8)) for _ in range(rnd.choice([8, 11, 14, 16, 30]))]
        variant = " ".join(known + added)
        assert not residue.trusted_residue(variant)
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (known, known + added))
        rows += [(i, " ".join(known)), (100 + i, variant)]
        want |= {i} | ({100 + i} if len(x & y) >= 0.8 * len(x | y) else set())
    got = {r["id"]: r["kind"] for r in residue.residue_rows(spark.createDataFrame(rows, "id long, summary_text string")).collect()}
    assert set(got) == want and 80 < len(want) < 120 and sum(k == "near" for k in got.values()) == len(want) - 60
