import datetime
import random

import pytest

from leafmill.llm import conversations, split

LIMIT, OVERLAP = 80, 10


def pages(spark, rows):
    return spark.createDataFrame(rows, "id long, doc_id string, page_num int, raw_text string, extra int")


def test_pieces_whatever_the_ranges(spark):
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice(["word ", "öäü ", "End. ", "\n", "\n\n", "📄📄", "x" * 30, "手順。", " "]) for _ in range(n))
    rows = [(i, rnd.choice(["a", "a", None]), rnd.choice([1, 2, 3, None]), make(rnd.randrange(0, 60)), 0) for i in range(40)]
    rows += [(100, "b", 1, None, 0), (101, "b", 2, "", 0), (102, "b", 3, "y" * 1000, 0), (103, "b", 3, "z" * LIMIT, 0), (104, "b", 4, "q" * (LIMIT + 1), 0)]
    df = pages(spark, rows)
    text = {r[0]: r[3] or "" for r in rows}
    found = [sorted(split.split_pages(df, LIMIT, OVERLAP, r).collect(), key=lambda x: (x["page_id"], x["piece_no"])) for r in (50, 333, 1 << 16)]
    assert found[0] == found[1] == found[2]
    by = {}
    for r in found[0]:
        by.setdefault(r["page_id"], []).append(r)
    assert set(by) == {i for i, t in text.items() if len(t) > LIMIT} == {r["page_id"] for r in split.oversized_pages(df, LIMIT, OVERLAP).collect()}
    for i, ps in by.items():
        at = 0
        for k, p in enumerate(ps):
            assert p["piece_no"] == k and len(p["text"]) <= LIMIT and text[i][p["start"] : p["end"]] == p["text"]
            assert p["start"] <= at and at - p["start"] <= OVERLAP and p["chunk_index"] == ps[0]["chunk_index"] + k
            at = p["end"]
        assert at == len(text[i])
    order = sorted((r for r in rows if r[1] == "a"), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    first = 0
    for r in order:
        if r[0] in by:
            assert by[r[0]][0]["chunk_index"] == first
        first += len(by[r[0]]) if r[0] in by else (1 if r[3] else 0)
    assert split.split_pages(df.limit(0), LIMIT, OVERLAP).collect() == []


def test_natural_boundaries(spark):
    t = ("A sentence of some words here. " * 3).strip() + "\n\n" + "Next paragraph goes on and on. " * 3
    ends = [r["text"] for r in split.split_pages(pages(spark, [(1, "d", 1, t, 0)]), LIMIT, OVERLAP).orderBy("piece_no").collect()]
    assert ends[0].endswith(". ") and any(x.endswith("\n\n") for x in ends)


def test_files_by_range(spark, tmp_path):
    t = "Line of text, number one.\n" * 50 + "é" * 300
    (tmp_path / "f.txt").write_text(t, encoding="utf-8")
    ranges = split.file_ranges(spark, [str(tmp_path / "f.txt")], LIMIT, 64)
    b = split.boundary_table(ranges, "path", LIMIT, 64)
    o = split.piece_offsets(b, LIMIT, OVERLAP)
    rows = split.piece_texts(ranges, o, b, "path", LIMIT, OVERLAP, 64).orderBy("piece_no").collect()
    at = 0
    for r in rows:
        assert r["text"] == t[r["start"] : r["end"]] and r["start"] <= at
        at = r["end"]
    assert at == len(t)


def at(s):
    return None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


SESSIONS = {
    "good": [("user", "q", 0), ("bot", "a", 1)],
    "late": [("assistant", "a", 5), ("Human ", "q", 0)],
    "hours": [("user", "q", 0), ("ai", "a", 4000), ("user", "r", 8000), ("assistant", "<think>x</think>", 8001), ("assistant", "b", 90000)],
    "repeat": [("user", "q", 3598), ("USER", "q", 3602), ("user", "q", 3606), ("assistant", "a", 3610)],
    "twice": [("user", "q", 0), ("user", "q", 6), ("assistant", "a", 9)],
    "blank": [("user", "​  ", 0), ("assistant", "a", 1)],
    "null": [("user", None, 0), ("assistant", "a", 1)],
    "thinks": [("user", "q", 0), ("assistant", "<think>still", 1)],
    "noreply": [("user", "q", 0), ("assistant", "a", 1), ("user", "r", 2)],
    "leads": [("assistant", "a", 0), ("user", "q", 1), ("assistant", "b", 2)],
    "role": [("user", "q", 0), ("tool", "x", 1), ("assistant", "a", 2)],
    "norole": [("user", "q", 0), (None, "x", 1), ("assistant", "a", 2)],
    "notime": [("user", "q", 0), ("assistant", "a", 1), ("assistant", "b", None)],
    "system": [("system", "s", 0), ("user", "q", 1), ("assistant", "a", 2)],
    "timeless system": [("system", "s", None), ("user", "q", 1), ("assistant", "a", 2)],
    "resumed": [("user", "q", 0), ("assistant", "a", 1), ("assistant", "b", 86400 * 20), ("user", "r", 86400 * 20 + 1), ("assistant", "c", 86400 * 20 + 2)],
    "resumed without reply": [("user", "q", 0), ("assistant", "a", 1), ("user", "r", 86400 * 20)],
    "reply after the timeout": [("user", "q", 0), ("assistant", "a", 86400 * 20)],
    "future": [("user", "q", 0), ("assistant", "a", 1), ("user", "r", 4_000_000_000), ("assistant", "b", 4_000_000_001)],
    "": [("user", "q", 0), ("assistant", "a", 1)],
    "old": [("user", "q", -2_000_000_000), ("assistant", "a", -1_999_999_999)],
    "empty": [],
}
GOOD = {"good", "late", "hours", "repeat", "system", "old", "resumed", "reply after the timeout", "future", ""}


@pytest.mark.parametrize("triggers", [1, 4])
def test_conversations(spark, triggers):
    rows = [(i, s, role, content, at(t)) for i, (s, (role, content, t)) in enumerate((s, m) for s, ms in SESSIONS.items() for m in ms)]
    rows.append((999, None, "user", "nobody", at(0)))
    m = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp_ntz")
    found = conversations.Replay(m.repartition(3), triggers=triggers)
    assert found.late == 0
    sessions = spark.createDataFrame([(s,) for s in SESSIONS] + [(None,)], "session_id string")
    assert {r[0] for r in conversations.dropped_sessions(sessions, found).collect()} == set(SESSIONS) - GOOD
    out = {}
    for r in conversations.conversations(found).orderBy("session_id", "position").collect():
        out.setdefault(r["session_id"], []).append((r["position"], r["role"], r["content"]))
    assert set(out) == GOOD
    assert out["late"] == [(0, "user", "q"), (1, "assistant", "a")] and out["repeat"] == [(0, "user", "q"), (1, "assistant", "a")]
    assert [x[0] for x in out["hours"]] == [0, 1, 2, 3, 4]


def test_late_rows_are_counted(spark):
    rows = [(0, "a", "user", "q", at(0)), (1, "b", "user", "q", at(86400 * 40)), (2, "b", "assistant", "a", at(86400 * 40 + 1)), (3, "a", "assistant", "too late", at(1))]
    m = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp_ntz")
    found = conversations.Replay(m, "1 day", triggers=4)
    assert found.late == 1
    assert {r[0] for r in conversations.dropped_sessions(m.select("session_id"), found).collect()} == {"a"}
    assert conversations.Replay(m, "60 days", triggers=4).late == 0


def test_no_messages(spark):
    m = spark.createDataFrame([], "id long, session_id string, role string, content string, created_at timestamp_ntz")
    found = conversations.Replay(m)
    assert found.blocks.count() == 0 and conversations.conversations(found).count() == 0 and conversations.dropped_sessions(spark.createDataFrame([("a",)], "session_id string"), found).count() == 1
