import random

from leafmill.llm import scan_noise as S

CLEAN = ["The control tester reviews the settlement file before the end of the quarter.", "Decision states that the contract holder confirms each follow-up memo in total.", "An independent validator questions the machine-readable report of the records office."]


def tables(spark, pages, results=()):
    body = [(i + 1000, f"d{i % 9}", 1 + i // 9, CLEAN[i % 3] + " " + CLEAN[(i + 1) % 3], 0) for i in range(90)]
    p = spark.createDataFrame(body + list(pages), "id long, doc_id string, page_num int, raw_text string, other int")
    r = spark.createDataFrame(list(results), "result_id long, doc_id string, headers string")
    s = spark.createDataFrame([(1, "Scope of the report"), (2, None)], "id long, summary_text string")
    g = spark.createDataFrame([(1, "Scope", "en"), (2, "Quality assurance", "en"), (3, "Annex 4", "en")], "term_id int, term string, lang string")
    return p, r, s, g


PAGES = [
    (1, "a", 4, "POLICY LOG    6\n\nThe c0ntrol tester reviews the settle-\nment file.", 0),
    (2, "a", 5, "POLICY LOG    7\n\nThe con trol tester reviews the follow-\nup memo.", 0),
    (3, "b", 1, "Scope\n\nThe control tester reviews\n301", 0),
    (4, "b", 2, "Scope\n\nThe contract holder. It has 2O4 rows.\nPage 2 of 9", 0),
    (5, "c", 1, None, 0), (6, "c", 2, "", 0), (7, "c", 3, " \n ", 0), (8, None, None, "x" * 20_000 + "-\n" + "y" * 20_000, 0),
    (9, "e", 3, "Internal use only – KYD-12345\nThe control tester.\niii", 0),
    (10, "a", 5, "POLICY LOG    7\n\nThe con trol tester reviews the follow-\nup memo.", 0),
]
RESULTS = [(1, "a", "POLICY LOG | Scope"), (2, "b", "Scope …… 12 | Quality assur-\nance"), (3, "b", None), (4, "b", ""), (5, "b", "Annex 4"), (6, "b", "Qua1ity assurance | 31"), (7, "z", "Desk report | KYD-12345 | Scope")]
WANT = {
    ("pages", 1, "hyphenation"), ("pages", 1, "misread"), ("pages", 1, "running_header"), ("pages", 1, "page_number"), ("pages", 2, "misread"), ("pages", 2, "running_header"), ("pages", 2, "page_number"),
    ("pages", 10, "misread"), ("pages", 10, "running_header"), ("pages", 10, "page_number"), ("pages", 4, "misread"), ("pages", 4, "page_number"), ("pages", 9, "running_header"), ("pages", 9, "page_number"),
    ("search_results", 1, "running_header"), ("search_results", 2, "page_number"), ("search_results", 2, "hyphenation"), ("search_results", 6, "misread"), ("search_results", 6, "page_number"), ("search_results", 7, "running_header"),
}


def with_terms(results):
    return results + [(100 + i, "q", "Quality assurance | Scope") for i in range(12)]


def test_kinds(spark, monkeypatch):
    t = tables(spark, PAGES, with_terms(RESULTS))
    got = {tuple(r) for r in S.noise(*t).collect()}
    assert {x for x in got if x[1] < 100} == WANT
    # beyond the size for sending them, the statistics are joined to the rows, with the same result
    monkeypatch.setattr(S, "MOST_SENT", -1)
    assert {tuple(r) for r in S.noise(*t).collect()} == got


def test_clean_text(spark):
    p, r, s, g = tables(spark, PAGES, with_terms(RESULTS))
    text = {x["page_id"]: x["text"] for x in S.clean_pages(p, r, s, g).collect()}
    assert text[1] == "The control tester reviews the settlement file."
    assert text[2] == "The control tester reviews the follow-up memo." and text[5] is None and text[4].startswith("Scope\n\nThe contract holder. It has 204 rows.")
    heads = {x["result_id"]: x["headers"] for x in S.clean_headings(p, r, s, g).collect()}
    assert heads[1] == "Scope" and heads[2] == "Scope | Quality assurance" and heads[3] is None and heads[6] == "Quality assurance" and heads[7] == "Scope"


def test_no_rows(spark):
    p, r, s, g = tables(spark, [])
    assert S.noise(p.limit(0), r, s.limit(0), g.limit(0)).collect() == []


def test_undoubted_lines_are_left_as_decoding_would(spark):
    rnd = random.Random(3)
    words = ["control", "tester", "total", "record", "in", "a", "modern"]
    known = {w: (50, None, 0.0, []) for w in words} | {"c0ntrol": (1, "control", -5.0, [("control", -0.1)]), "tota1": (1, "total", -5.0, [("total", -0.1)]), "rec": (0, None, 0.0, []), "ord": (0, None, 0.0, [])}
    fast, slow = S.Reader(known, {}, 1000), S.Reader(known, {}, 1000)

    class Always(dict):
        def __missing__(self, key):
            return True

    slow.doubt = Always()
    for _ in range(300):
        line = " ".join(rnd.choice([*words, "c0ntrol", "tota1", "rec ord", "12", "2O1", "zzz", "(tester)"]) for _ in range(rnd.randrange(0, 8)))
        assert S.repair(line, fast) == S.repair(line, slow)


def test_edits():
    assert S.edits("c0ntrol", "control") == [("o", "0")] and S.edits("rnodel", "model") == [("m", "rn")] and S.edits("same", "same") == []
    assert S.edits("conrol", "control") is None and S.edits("corm", "com") is None
    assert S.skeletons("rnrn") >= {S.skeleton("mm"), S.skeleton("mrn"), S.skeleton("rnrn")} and len(S.skeletons("rn" * 12)) > 24


def test_channel_weighs_confusions_and_neighbours():
    channel = S.Channel({("o", "0"): 0.0, ("l", "1"): 0.0, ("l", "i"): 0.0}, 0.001, 0.2)
    best, same, options = channel.weigh("c0ntrol", 1, [("control", 500)])
    assert best == "control" and same < -1 and options[0][:1] == ("control",) and options[0][2] == 500
    # twice as frequent words, and readings far too frequent to be errors, stay; both words of a class stay candidates
    assert channel.weigh("falls", 600, [("fails", 1200)])[0] is None
    both = channel.weigh("wei1", 1, [("well", 2200), ("weil", 550)])
    assert {w for w, *_ in both[2]} == {"well", "weil"}
    known = {"wei1": (1, both[0], both[1], [(w, p) for w, p, _ in both[2]]), "well": (2200, None, 0.0, []), "weil": (550, None, 0.0, []), "sagt": (300, None, 0.0, []), "as": (900, None, 0.0, [])}
    reader = S.Reader(known, {"sagt weil": 40, "as well": 80}, 100_000)
    assert reader.viterbi(["sagt", "wei1"]) == ["sagt", "weil"] and reader.viterbi(["as", "wei1"]) == ["as", "well"]
    real = {"falls": (600, None, -0.01, [("fails", -5.0)]), "fails": (1200, None, 0.0, []), "check": (500, None, 0.0, []), "it": (900, None, 0.0, [])}
    reader = S.Reader(real, {"check fails": 300, "it falls": 200}, 1_000_000)
    assert reader.line("it falls") == ("it falls", False) and reader.line("check falls") == ("check fails", True)


def test_both_plans_read_cut_words_alike(spark, monkeypatch):
    pages = [(1, "x", 1, "The desk in ter-\nnational affairs and con-\ntrol con-\ntrol te-\nster. The con trol c0n-\ntrol.", 0)]
    extra = [(2000 + i, "y", i, "The international desk in national affairs.", 0) for i in range(12)]
    t = tables(spark, pages + extra)
    found = []
    for most in (1 << 40, -1):
        monkeypatch.setattr(S, "MOST_SENT", most)
        found.append(sorted(map(tuple, S.clean_pages(*t).collect())))
    assert found[0] == found[1]


def test_pairs_on_both_sides_decide(spark):
    rare = [(i, f"r{i}", 1, f"Fester wounds heal slowly {x}.", 0) for i, x in ((1, "north"), (2, "south"), (3, "inland"))]
    p, r, s, g = tables(spark, [*rare, (4, "r4", 1, "The fester control tester reviews.", 0)])
    c = S.Corpus(p, r, s, g)
    assert {x["key"]: x["best"] for x in c.lexicon.collect()}["fester"] == "tester"
    pairs = {x["key"]: x["n"] for x in c.pairs.collect()}
    assert pairs["fester wounds"] == 3 and pairs["fester control"] == pairs["the fester"] == 1
    reader = S.Reader({x["key"]: S._entry(x) for x in c.lexicon.collect()}, pairs, c.total)
    assert reader.viterbi(["fester", "wounds"]) == ["fester", "wounds"] and reader.viterbi(["fester", "control"]) == ["tester", "control"]
