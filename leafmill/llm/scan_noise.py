"""Noise in text from scanned pages: cut and misread words, running lines, printed page numbers.

Misread words are decoded with a noisy channel: the probability that a word's characters were read as the ones seen, estimated from the
corpus, times the likelihood of the word and its neighbours there (counts of words and word pairs over all pages and summaries).
Candidates come from an equi-join: characters that are mistaken for each other share a class, and words with equal classes are candidates
of each other, however many. Each line is decoded by Viterbi over its words' candidates. What runs along a file (title and notice lines,
page numbers) is found by aggregates over the file; a running line has 3 to 90 characters, a printed number's line up to 100, a line with
a leader up to 160."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import row_bytes, sized, written

#: Characters that are mistaken for each other, a class a line, and pairs read for one character (fixed values).
CLASSES = ["ec(éè", "il1|!íìï", "o0óò", "t†f", "vy", "bh68", "g9", "a@àá", "s5$", "uúùü", "z2"]
PAIRS = {"rn": "m", "ri": "n", "cl": "d", "ii": "u", "vv": "w", "i)": "d", "nn": "m", "rí": "n", "r1": "n", "c1": "d", "c|": "d", "r|": "n", "íí": "u", "l)": "d"}
#: How much more frequent a word must be than what was read of it with a usual confusion, and its least count.
ODDS, LEAST_COUNT = 10, 3
#: Longest run of characters that can be a word; least probability of a candidate.
WORD_CHARS, LEAST_P = 64, 0.002
#: Most bytes of word statistics that are sent to all workers; beyond it they are joined to the pages, with the same result.
MOST_SENT = 24 << 20

_class = str.maketrans({c: x[0] for x in CLASSES for c in x})
# all patterns stay linear in long runs of characters without spaces
_token = re.compile(r"[A-Za-z0-9À-ɏ†|@()$!]+")
_hyphen = re.compile(r"[-¬‐­] ?\n[ \t]*")
_left = re.compile(r"[^\s\-¬‐­]{1,65}\Z")
_right = re.compile(r"[^\s\-¬‐­]{1,65}")
_edge = ".,;:!?\"'“”‘’«»[]{}"
_number = re.compile(r"[\dOoIlSB|]+(?:[.,/:][\dOoIlSB|]+)*")
_code = re.compile(r"[A-Z]{2,3}-(?=[\dOoIlSB|]*[OoIlSB|])[\dOoIlSB|]{4,6}")
_mixed = re.compile(r"\d[.,/:]?[OoIlSB|]|[OoIlSB|][.,/:]?\d")
_digits = str.maketrans("OoIl|SB", "0011158")
_page_forms = re.compile(r"(?P<strong>\[(?P<a>{n})\]|(?P<b>{n}) ?/ ?{n}|[-–—] ?(?P<c>{n}) ?[-–—]|(?:p\.|page|pagina|seite|pag\.|s\.) ?(?P<d>{n})(?: (?:of|van|von|/) {n})?)|(?P<e>{n})|(?P<f>[ivxlc]+)".replace("{n}", r"[\dOolI|]{1,6}"), re.I)
_leader = re.compile(r"(.*?\S)\s*(?:\.{3,}|…+|(?:\. ){2,}\.?|·{3,}|_{3,})\s*([\dOolI|]{1,6})")
_joined = re.compile(r"(?:(?P<n1>[\dOolI|]{1,6}) {2,}(?P<t1>\S.*))|(?:(?P<t2>.*\S) {2,}(?P<n2>[\dOolI|]{1,6}))")
_notice = re.compile(r"[^|·/–]{4,60}? ?[–|·/] ?[A-Z0-9|()l]{2,4}-[\dOolI|SB]{4,6}")


def skeleton(word: str) -> str:
    return word.lower().translate(_class)


def skeletons(word: str) -> set[str]:
    """The classes of a word as read, with none, one or two of its character pairs taken for single characters."""
    found = level = {word.lower()}
    for _ in range(2):
        level = {x[:i] + PAIRS[x[i : i + 2]] + x[i + 2 :] for x in level for i in range(len(x) - 1) if x[i : i + 2] in PAIRS}
        found = found | level
    return {x.translate(_class) for x in found}


def edits(read: str, true: str) -> list[tuple[str, str]] | None:
    """[(character, what was read for it)] that make `read` of `true`, as few as can be; None if the channel has no way."""
    paths: dict[int, list[tuple[str, str]]] = {0: []}  # place in what was read -> edits so far
    for c in true:
        now: dict[int, list[tuple[str, str]]] = {}
        for i, done in paths.items():
            one, two = read[i : i + 1], read[i : i + 2]
            ways = [(i + 1, done if one == c else [*done, (c, one)])] if one and (one == c or one.translate(_class) == c.translate(_class)) else []
            ways += [(i + 2, [*done, (c, two)])] if two in PAIRS and PAIRS[two].translate(_class) == c.translate(_class) else []
            for j, path in ways:
                if j not in now or len(path) < len(now[j]):
                    now[j] = path
        paths = now
    return paths.get(len(read))


def _trim(t: str) -> tuple[int, int] | None:
    """(start, end) of the word in a run of word characters; outer brackets stay only where they make a word of it."""
    if len(t) > WORD_CHARS:
        return None
    a, b = 0, len(t)
    while b and t[b - 1] in "!$)":
        if t[b - 1] == ")" and "i" in t[b - 2 : b - 1].lower() and "(" not in t:
            break
        b -= 1
    if b - a > 1 and t[0] == "(":
        a = 1
    return (a, b) if a < b and any(c.isalpha() for c in t[a:b]) else None


class _Words(dict):
    """run of word characters -> the word in lower case, or None."""

    def __missing__(self, t: str) -> str | None:
        at = _trim(t)
        found = t[at[0] : at[1]].lower() if at else None
        if len(self) > 300_000:
            self.clear()
        self[t] = found
        return found


def raw_tokens(line: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words of a line."""
    found = []
    for m in _token.finditer(line):
        at = _trim(m.group())
        if at:
            found.append((m.start() + at[0], m.start() + at[1], m.group()[at[0] : at[1]]))
    return found


def breaks(text: str) -> Iterator[tuple[int, int, int, str, str]]:
    """(start, hyphen, end, left, right) of the words that a hyphen at a line's end cuts in two."""
    for m in _hyphen.finditer(text):
        left, right = _left.search(text[max(0, m.start() - WORD_CHARS - 1) : m.start()]), _right.match(text, m.end())
        if left and right:
            yield m.start() - len(left.group()), m.start(), right.end(), left.group(), right.group()


def unbroken(text: str, join: Callable[[str, str, str], str]) -> str:
    """text with each cut word replaced by what join(left, hyphen, right) gives, followed by the line's end."""
    out, last = [], 0
    for start, hyphen, end, left, right in breaks(text):
        if start >= last:
            out += [text[last:start], join(left, text[hyphen], right), "\n"]
            last = end
    return "".join(out) + text[last:] if out else text


def _key(line: str) -> str:
    """A line as compared over a file: classes of its letters and digits, without spaces and signs."""
    w = line.lower()
    for pair, one in PAIRS.items():
        w = w.replace(pair, one)
    return re.sub(r"[^\w†]", "", w.translate(_class))


def _value(n: str) -> int | None:
    n = n.translate(_digits)
    return int(n) if n.isdigit() else None


_roman = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(s: str) -> int | None:
    values = [_roman[c] for c in s.lower()] if s and all(c in _roman for c in s.lower()) else []
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values)) if values else None


def page_numbers(line: str, edge: bool) -> list[tuple[int, bool]]:
    """[(number, strong)] that a line may print; only lines at a page's edge can be a number of their own."""
    out = []
    if len(line) <= 160 and (m := _leader.fullmatch(line)):
        out.append((_value(m[2]), False))
    if edge and len(line) <= 100:
        if m := _page_forms.fullmatch(line):
            n = next((m[g] for g in "abcde" if m[g]), None)
            if n and any(c.isdigit() or c in "lIO|" for c in n):
                out.append((_value(n), bool(m["strong"])))
            if re.fullmatch("[ivxlc]+", line, re.I):
                out.append((roman(line), False))
        elif m := _joined.fullmatch(line):
            out.append((_value(m["n1"] or m["n2"]), False))
    return [(n, s) for n, s in out if n is not None]


def running_text(line: str) -> str:
    """A line without the page number set apart at its side."""
    m = _joined.fullmatch(line) if len(line) <= 100 else None
    return (m["t1"] or m["t2"]) if m else line


def edges(text: str) -> tuple[list[str], set[int]]:
    """A page's lines that hold anything, and which of them lie at its top or bottom."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return lines, {i for i in (0, 1, len(lines) - 2, len(lines) - 1) if 0 <= i < len(lines)}


FACTS = "kind string, id bigint, doc_id string, page_num int, key string, n bigint, flag boolean"


def _facts(texts: Iterator[pa.RecordBatch], pages: bool) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: counts of words (w) and word pairs (b), lines at page edges (e), numbers that may be printed (p)."""
    known = _Words()
    for batch in texts:
        runs: Counter = Counter()
        twos: Counter = Counter()
        words: Counter = Counter()
        pairs: Counter = Counter()
        rows = []
        for id_, doc, page, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text or not text.strip():
                continue
            plain = text
            if "-" in text or "¬" in text or "‐" in text or "\u00ad" in text:
                for *_, left, right in breaks(text):
                    a, b = raw_tokens(left)[-1:], raw_tokens(right)[:1]
                    if a and b:
                        words[(a[0][2] + b[0][2]).lower()] += 0
                plain = unbroken(text, lambda *_: "")
            found = _token.findall(plain)
            runs.update(found)
            twos.update(zip(found, found[1:]))
            if pages:
                lines, edge = edges(text)
                for i in edge:
                    t = running_text(lines[i])
                    if 3 <= len(t) <= 90:
                        rows.append(("e", id_, doc, page, _key(t), i, bool(_notice.fullmatch(t))))
                for i, line in enumerate(lines):
                    if i in edge or ("..." in line or "…" in line or ". ." in line or "··" in line or "__" in line):
                        rows += [("p", id_, doc, page, None, n, strong) for n, strong in page_numbers(line, i in edge)]
        for t, n in runs.items():
            w = known[t]
            if w:
                words[w] += n
                if t[0] == "(" and len(t) > 3 and ")" not in t:
                    words["(" + w] += 0
        for (t, u), n in twos.items():
            if (x := known[t]) and (y := known[u]) and n > 0:
                pairs[x, y] += n
        rows += [("w", None, None, None, w, n, None) for w, n in words.items()]
        rows += [("b", None, None, None, f"{a} {b}", n, None) for (a, b), n in pairs.items()]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["kind", "id", "doc_id", "page_num", "key", "n", "flag"])


def _shaped(df: DataFrame, id_: str, doc: str | None, page: str | None, text: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(F.col(id_).cast("bigint").alias("id"), (F.col(doc) if doc else none("string")).alias("doc_id"), (F.col(page).cast("int") if page else none("int")).alias("page_num"), F.col(text).alias("text"))


CANDIDATES = "key string, best string, same double, options array<struct<word: string, logp: double, m: bigint>>"


def corrections(words: DataFrame) -> DataFrame:
    """(key, best, same, options) of the words that may have been misread; words: (key, n).

    The channel: what was read comes from any word of the same classes that is not itself a reading of a more frequent one, by the
    confusion probabilities of its characters. Those are estimated from the corpus itself: from the words ODDS times as frequent as a
    reading of them, how often each character was read as each other one, against how often it stands there; and how often a misread
    word has one more misread character, as errors come together. `same` is the log probability that the reading is right, an option's that
    it comes from that word, both before looking at the neighbours; best is the likeliest word where the reading itself is unlikely."""

    def alternatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, skels = [], [], []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in skeletons(k):
                    keys.append(k), counts.append(n), skels.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(skels, pa.string())], ["key", "n", "skel"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skels = [skeleton(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(skels, pa.string())], ["word", "m", "skel"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, word in zip(*(x.to_pylist() for x in batch.columns)):
                way = edits(key, word) or []
                rows += [(c, r, n) for c, r in way] + [("", "", n * (len(way) - 1))] * (len(way) > 1)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int64())], ["c", "r", "n"])

    plain = F.col("key").rlike(r"^\p{L}+$")
    lexicon = words.where(plain & (F.length("key") >= 3) & (F.col("n") >= LEAST_COUNT)).select("key", "n").mapInArrow(classes, "word string, m bigint, skel string")
    seen = words.where(F.length("key") >= 3).select("key", F.greatest("n", F.lit(1)).alias("n")).mapInArrow(alternatives, "key string, n bigint, skel string")
    met = written(seen.join(lexicon, "skel").where(F.col("word") != F.col("key")).select("key", "n", "word", "m").distinct(), "met")
    sure = met.where(F.col("m") >= ODDS * F.col("n")).groupBy("key", "n").agg(F.max_by("word", F.struct("m", "word")).alias("word"))
    sure = written(sure, "sure")
    misread = sized(sure.select(F.col("key").alias("word")))
    # both tables have a row for a pair of characters that the channel knows, or for a letter
    read = {(x["c"], x["r"]): x["n"] for x in sure.mapInArrow(changes, "c string, r string, n bigint").groupBy("c", "r").agg(F.sum("n").alias("n")).collect()}
    more, total = read.pop(("", ""), 0), sum(read.values())
    letters = words.where(plain).select(F.explode(F.split("key", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    stands = {x["c"]: x["n"] for x in letters.where(F.col("c").isin(sorted({c for c, _ in read}))).collect()}
    rate = {k: (n + 0.5) / (stands.get(k[0], 0) + 1000) for k, n in read.items()}
    usual = math.exp(sum(n * math.log(rate[k]) for k, n in read.items()) / max(total, 1)) if read else 1e-3
    channel = Channel({k: math.log(v / usual) for k, v in rate.items()}, usual, (more + 1) / (total + 10))
    met = met.join(misread, "word", "left_anti").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("m", "word")), False).alias("words"))  # a class holds few words

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [channel.weigh(k, n, [(w["word"], w["m"]) for w in ws]) for k, n, ws in zip(*(c.to_pylist() for c in batch.columns))]
            options = pa.array([[{"word": w, "logp": p, "m": m} for w, p, m in o[2]] for o in out], pa.list_(pa.struct([("word", pa.string()), ("logp", pa.float64()), ("m", pa.int64())])))
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), options], ["key", "best", "same", "options"])
            yield rows.filter(pa.array([bool(o[2]) for o in out], pa.bool_()))

    return met.mapInArrow(weighed, CANDIDATES)


class Channel:
    """How likely characters are to be misread. ratio: log of a confusion's probability against a usual one's; unseen ones are rarer by
    UNSEEN. usual: that one's probability. more: the probability of one more misread character in a word that has one."""

    UNSEEN = -3.4

    def __init__(self, ratio: dict[tuple[str, str], float], usual: float, more: float):
        self.ratio, self.usual, self.more = ratio, usual, more

    def weigh(self, key: str, n: int, words: list[tuple[str, int]]) -> tuple[str | None, float, list[tuple[str, float, int]]]:
        """(best, same, options) of a reading seen n times that may come from words (word, count)."""
        found = []
        for word, m in words:
            way = edits(key, word)
            if way:
                found.append((m * self.usual * math.exp(sum(self.ratio.get(e, self.UNSEEN) for e in way) + (len(way) - 1) * math.log(self.more)), word, m))
        total = sum(w for w, *_ in found)
        if not total:
            return None, 0.0, []
        # how much more of the word there is than of the reading, by a usual confusion; what mixes letters and signs is hardly a word
        lead = math.log(total / self.usual / n) - math.log(ODDS if len(key) >= 4 else 4 * ODDS) * key.isalpha()
        misread = 1 / (1 + math.exp(-max(min(lead, 50), -50)))
        by_chance = min(total / n, 0.5)
        share = [(word, (misread + (1 - misread) * by_chance) * w / total, m) for w, word, m in found]
        options = sorted(((word, math.log(p), m) for word, p, m in share if p >= LEAST_P), key=lambda x: (-x[1], x[0]))
        return (options[0][0] if options and misread > 0.5 else None), math.log((1 - misread) * (1 - by_chance) + 1e-9), options


#: word -> (count, best, log probability that it is right, other words it may be with theirs)
Known = dict[str, tuple[int, str | None, float, list[tuple[str, float]]]]
_UNKNOWN: tuple[int, None, float, list] = (0, None, 0.0, [])


class _Doubt(dict):
    """run of word characters -> 1 if a line that holds it has to be decoded, 2 if only where its neighbours do not know it, else 0."""

    def __init__(self, known: Known):
        super().__init__()
        self.known, self.torn = known, set()
        for w, (n, best, *_) in known.items():
            if best is None and n >= LEAST_COUNT and len(w) >= 5 and w.isalpha():
                for i in range(1, len(w)):
                    for part in (w[:i], w[i:]):
                        if ODDS * max(known.get(part, _UNKNOWN)[0], 1) <= n:
                            self.torn.add(part)

    def __missing__(self, t: str) -> int:
        at = _trim(t)
        w = t[at[0] : at[1]].lower() if at else None
        n, best, _, options = self.known.get(w, _UNKNOWN) if w else _UNKNOWN
        found = 0 if w is None else 1 if best is not None or n < LEAST_COUNT or w in self.torn else 2 if options else 0
        if len(self) > 300_000:
            self.clear()
        self[t] = found
        return found


class Reader:
    """Decodes lines: counts of words and what they may be, counts of word pairs, words in all."""

    def __init__(self, known: Known, pairs: dict[str, int], total: int):
        self.known, self.pairs, self.total = known, pairs, max(total, 1)
        self.doubt = _Doubt(known)

    def doubtful(self, text: str) -> bool:
        runs = _token.findall(text)
        marks = [self.doubt[t] for t in runs]
        if 1 in marks or _mixed.search(text) is not None:
            return True
        words = [t.lower() for t in runs] if 2 in marks else []
        return any(m == 2 and not any(self.pairs.get(f"{x} {y}", 0) > 1 for x, y in zip(words[max(i - 1, 0) : i + 1], words[max(i, 1) : i + 2])) for i, m in enumerate(marks))

    def count(self, w: str) -> int:
        return self.known.get(w, _UNKNOWN)[0]

    def best(self, w: str) -> str | None:
        return self.known.get(w, _UNKNOWN)[1]

    def is_word(self, w: str) -> bool:
        n, best, *_ = self.known.get(w, _UNKNOWN)
        return best is not None or n >= LEAST_COUNT

    def cut(self, left: str, right: str) -> bool:
        """Whether left-right at a line's end is one word, rather than a compound broken at its own hyphen."""
        a, b = left.lower(), right.lower()
        if not b[:1].isalpha() or not a[-1:].isalpha() or right[:1].isupper() and not left.isupper():
            return False
        if self.is_word(a + b):
            return True
        return not (self.is_word(a) and self.is_word(b))

    def pair(self, p: str, o: str, as_read: bool) -> float:
        """How much more often a word pair stands in the corpus than by chance, both smoothed by one, 0 if it does not; where both are as
        read, the pair at hand is no evidence for itself."""
        n = self.pairs.get(f"{p} {o}", 0) - as_read
        return max(math.log1p(n) - math.log1p(self.count(p) * self.count(o) / self.total), 0.0) if n > 0 else 0.0

    def viterbi(self, words: list[str]) -> list[str]:
        """The likeliest words for those read in a line."""
        paths: dict[str, tuple[float, list[str]]] = {}
        for last, w in zip(["", *words], words):
            _, _, same, others = self.known.get(w, _UNKNOWN)
            options = {w: same, **dict(others)}
            now = {}
            for o, score in options.items():
                before = max(((s + (self.pair(p, o, p == last and o == w) if len(options) > 1 or len(paths) > 1 else 0), path) for p, (s, path) in paths.items()), key=lambda x: x[0], default=(0.0, []))
                now[o] = (before[0] + score, [*before[1], o])
            if len(now) == 1:  # nothing earlier can change any more
                ((o, (s, path)),) = now.items()
                now = {o: (0.0, path)}
            paths = now
        return max(paths.values(), key=lambda x: x[0])[1] if paths else []

    def line(self, line: str) -> tuple[str, bool]:
        """(repaired line, whether anything was misread or torn)."""
        if not self.doubtful(line):
            return line, False
        found = raw_tokens(line)
        out, last, hit = [], 0, False
        lower = []
        for a, b, t in found:
            w = t.lower()
            if a and line[a - 1] == "(" and ")" not in t and not self.is_word(w) and self.best("(" + w):
                w = "(" + w
            lower.append(w)
        decoded = self.viterbi(lower)
        i = 0
        while i < len(found):
            a, b, t = found[i]
            w, best = lower[i], decoded[i]
            if w[0] == "(" and w != t.lower():
                a -= 1
            if i + 1 < len(found) and line[b : found[i + 1][0]] == " " and best == w:
                n, whole = found[i + 1], w + lower[i + 1]
                if t.isalpha() and n[2].isalpha() and len(whole) >= 5:
                    least = min(self.count(w), self.count(lower[i + 1]))
                    c = self.count(whole) if self.best(whole) is None else 0
                    if c >= LEAST_COUNT and c >= ODDS * max(least, 1) and (least == self.count(w) or len(lower[i + 1]) > 0):
                        out.append(line[last:b] + n[2])
                        last, hit, i = n[1], True, i + 2
                        continue
            if best != w:
                out.append(line[last:a] + _cased(best, line[a:b]))
                last, hit = b, True
            i += 1
        text = "".join(out) + line[last:]
        if _mixed.search(text) is None:
            return text, hit
        fixed = _number.sub(lambda m: m.group().translate(_digits) if _alone(text, m) else m.group(), text)
        fixed = _code.sub(lambda m: m.group()[: m.group().index("-")] + m.group()[m.group().index("-") :].translate(_digits), fixed)
        return fixed, hit or fixed != text


def _alone(text: str, m: re.Match) -> bool:
    a, b = m.span()
    if len(m.group()) > 24 or not any(c.isdigit() for c in m.group()) or not any(c in "OoIlSB|" for c in m.group()):
        return False
    return (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "|†@$")) and (b == len(text) or not (text[b].isalnum() or text[b] in "|†@$")) and len(re.findall(r"\d", m.group())) * 2 >= len(re.findall(r"[OoIlSB|]", m.group()))


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[0].upper() + word[1:] if letters and letters[0].isupper() else word


def repair(text: str, reader: Reader) -> tuple[str, bool, bool]:
    """(text with cut words joined and misread ones replaced, whether words were cut, whether any was misread)."""
    cut = False

    def join(left: str, hyphen: str, right: str) -> str:
        nonlocal cut
        a, b = raw_tokens(left)[-1:], raw_tokens(right)[:1]
        if a and b and a[0][1] == len(left) and b[0][0] == 0 and reader.cut(a[0][2], b[0][2]):
            cut = True
            return left + right
        return left + hyphen + right

    text = unbroken(text, join)
    if not reader.doubtful(text):
        return text, cut, False
    lines = [reader.line(x) for x in text.split("\n")]
    return "\n".join(x for x, _ in lines), cut, any(hit for _, hit in lines)


def paragraphs(text: str) -> str:
    """Lines of a paragraph run on; a blank line stays."""
    return "\n\n".join(" ".join(x.strip() for x in p.split("\n") if x.strip()) for p in re.split(r"\n\s*\n", text) if p.strip())


class Corpus:
    """What the pages and summaries say together: word statistics, corrections, each file's running lines and numbering."""

    def __init__(self, pages: DataFrame, results: DataFrame, summaries: DataFrame, glossary: DataFrame):
        spark = pages.sparkSession
        facts = _shaped(pages, "id", "doc_id", "page_num", "raw_text").mapInArrow(lambda b: _facts(b, True), FACTS)
        heads = results.withColumn("headers", F.regexp_replace("headers", r" \| ", "\n"))
        more = _shaped(summaries, "id", None, None, "summary_text").union(_shaped(heads, "result_id", None, None, "headers")).union(_shaped(glossary, "term_id", None, None, "term")).mapInArrow(lambda b: _facts(b, False), FACTS)
        facts = written(facts.union(more), "facts")
        self.words = written(facts.where("kind = 'w'").groupBy("key").agg(F.sum("n").alias("n")), "words")
        best = written(corrections(self.words), "corrections")
        lexicon = self.words.join(best, "key", "left").where(f"best is not null or n >= {LEAST_COUNT}")
        self.lexicon = written(lexicon.withColumn("same", F.coalesce("same", F.lit(0.0))), "lexicon")
        self.total = facts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
        unsure = best.select(F.col("key").alias("word")).union(best.select(F.explode("options.word").alias("word"))).distinct()
        # a doubtful word is decided by what stands on either side of it
        pairs = facts.where("kind = 'b'").groupBy("key").agg(F.sum("n").alias("n"))
        pairs = pairs.select("key", "n", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
        self.pairs = written(pairs.join(unsure, "word", "left_semi").select("key", "n").distinct(), "pairs")
        # a running line stands at the edge of two pages of its file at least, and is no heading of the glossary
        headings = glossary.select("term").where("term is not null")
        keyed = headings.mapInArrow(_term_keys, "key string").distinct()
        lines = facts.where("kind = 'e'").select("id", "doc_id", "page_num", "key", "flag")
        runs = lines.groupBy("doc_id", "key").agg(F.count_distinct("page_num").alias("_n"), F.bool_or("flag").alias("_notice")).where("_n > 1 or _notice")
        self.runs = written(runs.join(keyed, "key", "left_anti").select("doc_id", "key"), "runs")
        self.run_pages = lines.join(self.runs, ["doc_id", "key"]).select("id", "key").distinct()
        # numbers differ from the page's place by the same amount throughout a file
        numbers = facts.where("kind = 'p'").select("id", "doc_id", "n", F.col("flag").alias("strong"), (F.col("n") - F.col("page_num")).alias("off"))
        usual = numbers.groupBy("doc_id", "off").agg(F.count_distinct("id").alias("c"), F.count_if("strong").alias("s")).where("off is not null")
        usual = usual.groupBy("doc_id").agg(F.max_by("off", F.struct("c", "s", -F.abs("off"))).alias("usual"), F.max("c").alias("c"))
        ok = F.col("strong") | (F.col("off") == 0) | ((F.col("off") == F.col("usual")) & (F.col("c") > 1))
        self.numbered = numbers.join(usual, "doc_id", "left").where(ok).select("id", "n").distinct()
        self.spark = spark

    def reader(self) -> Broadcast | None:
        """The word statistics for all workers, if they are few enough to send."""
        size = sum(t.agg(F.sum(row_bytes(t.schema))).first()[0] or 0 for t in (self.lexicon, self.pairs))
        if size > MOST_SENT:
            return None
        known = {r["key"]: _entry(r) for r in self.lexicon.toLocalIterator()}
        pairs = {r["key"]: r["n"] for r in self.pairs.toLocalIterator()}
        return self.spark.sparkContext.broadcast((known, pairs, self.total))

    def repaired(self, rows: DataFrame) -> DataFrame:
        """(id, text, cut, misread) of (id, text) rows."""
        sent, total = self.reader(), self.total
        schema = "id bigint, text string, cut boolean, misread boolean"
        if sent is not None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                reader = Reader(*sent.value)
                for batch in batches:
                    yield _repaired(batch.column(0), batch.column(1).to_pylist(), [reader] * batch.num_rows)

            return rows.select("id", "text").mapInArrow(run, schema)
        # each row's own part of the statistics is joined to it: its words with what they may be, then the pairs of these
        entry = F.struct("key", "n", "best", "same", "options")
        known = self._looked_up(rows.select("id", "text").mapInArrow(_wanted_words, "id bigint, key string"), self.lexicon).groupBy("id").agg(F.collect_list(entry).alias("known"))
        texts = written(rows.select("id", "text").join(known, "id", "left"), "known")
        pairs = self._looked_up(texts.where("known is not null").select("id", "text", "known").mapInArrow(_wanted_pairs, "id bigint, key string"), self.pairs).groupBy("id").agg(F.collect_list(F.struct("key", "n")).alias("pairs"))

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [{x["key"]: x["n"] for x in p or []} for p in batch.column(3).to_pylist()]
                yield _repaired(batch.column(0), batch.column(1).to_pylist(), [Reader(_own(k), p, total) for k, p in zip(batch.column(2).to_pylist(), both)])

        return texts.join(pairs, "id", "left").select("id", "text", "known", "pairs").mapInArrow(run_joined, schema)

    def _looked_up(self, wanted: DataFrame, table: DataFrame) -> DataFrame:
        """wanted (id, key) with the table's columns. Keys that make up a 10 000th of all words are at most 10 000, and are sent to the
        rows; so none of those that are shuffled is frequent."""
        head = F.broadcast(table.where(F.col("n") * 10_000 >= self.total))
        tail = table.where(F.col("n") * 10_000 < self.total)
        return wanted.join(head, "key").unionByName(wanted.join(head.select("key"), "key", "left_anti").join(tail, "key"))


def _entry(x: dict) -> tuple:
    return x["n"], x["best"], x["same"], [(o["word"], o["logp"]) for o in x["options"] or []]


def _own(known: list[dict] | None) -> Known:
    """The statistics of one row's words and of what they may be."""
    out: Known = {o["word"]: (o["m"], None, 0.0, []) for x in known or [] for o in x["options"] or []}
    return out | {x["key"]: _entry(x) for x in known or []}


def _repaired(ids: pa.Array, texts: list, readers: list[Reader]) -> pa.RecordBatch:
    out = [(None, False, False) if t is None else repair(t, r) for t, r in zip(texts, readers)]
    return pa.RecordBatch.from_arrays([ids, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.bool_())], ["id", "text", "cut", "misread"])


def _neighbours(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(words, what its last word is if it goes on in the next line) of each line, whichever cut words are joined."""
    cut = {hyphen: (left, right) for _, hyphen, _, left, right in breaks(text)}
    at = 0
    for line in text.split("\n"):
        words, whole = [t.lower() for _, _, t in raw_tokens(line)], []
        end = next((at + i for i in range(max(len(line) - 2, 0), len(line)) if at + i in cut), None)
        if end is not None:
            whole = [t.lower() for _, _, t in raw_tokens("".join(cut[end]))][-1:]
        yield words, whole
        at += len(line) + 1


def _wanted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words that repairing a row may look up: its words, cut words joined, neighbours taken together."""
    for batch in batches:
        ids, keys = [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            need: dict[str, None] = {}
            for *_, left, right in breaks(text or ""):
                a, b = raw_tokens(left)[-1:], raw_tokens(right)[:1]
                for w in (a[0][2] + b[0][2], a[0][2], b[0][2]) if a and b else ():
                    need[w.lower()] = None
            for words, whole in _neighbours(text or ""):
                for w in words + whole:
                    need[w] = need["(" + w] = None
                for x, y in [*zip(words, words[1:]), *((x, w) for x in words[-2:-1] for w in whole)]:
                    need[x + y] = None
            ids += [id_] * len(need)
            keys += need
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])


def _wanted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word pairs of a row, each word as read and as what it may be."""
    for batch in batches:
        ids, keys = [], []
        for id_, text, known in zip(*(c.to_pylist() for c in batch.columns)):
            own, need = _own(known), {}
            options = lambda w: [w, "(" + w, *(o for x in (w, "(" + w) for o, _ in own.get(x, _UNKNOWN)[3])]  # noqa: E731, B023
            for words, whole in _neighbours(text or ""):
                for x, y in [*zip(words, words[1:]), *((x, w) for x in words[-2:-1] for w in whole)]:
                    for p in options(x):
                        for q in options(y):
                            need[f"{p} {q}"] = None
            ids += [id_] * len(need)
            keys += need
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])


def _term_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_key(t) for t in batch.column(0).to_pylist()], pa.string())], ["key"])


def heading_pieces(headers: str) -> list[str]:
    """The headings of a joined list; a code alone belongs to the running line before it."""
    out: list[str] = []
    for piece in (p.strip() for p in headers.split(" | ")):
        if out and re.fullmatch(r"[A-Z0-9|()l]{2,4}-[\dOolI|SB]{4,6}", piece):
            out[-1] += " | " + piece
        else:
            out.append(piece)
    return out


def heading_number(piece: str) -> bool:
    """Whether a heading is or ends in a printed page number."""
    if len(piece) > 160:
        return False
    if _leader.fullmatch(piece) or _joined.fullmatch(piece):
        return True
    if re.fullmatch("[ivxlc]+", piece):
        return roman(piece) is not None
    m = _page_forms.fullmatch(piece)
    return bool(m) and any(c.isdigit() for c in piece)


def _heading_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for id_, doc, headers in zip(*(c.to_pylist() for c in batch.columns)):
            for piece in heading_pieces(headers) if headers and headers.strip() else ():
                if not piece:
                    continue
                m = _leader.fullmatch(piece) if len(piece) <= 160 else None
                text = m[1] if m else running_text(piece)
                number = heading_number(piece)
                rows.append((id_, doc, _key(text), number, bool(_notice.fullmatch(text))))
        types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["id", "doc_id", "key", "number", "notice"])


def noise(pages: DataFrame, results: DataFrame, summaries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(tbl, row_id, kind) of each kind of noise in pages.raw_text and search_results.headers, one row per record and kind.

    Null and blank texts have none; pages stored twice are judged alike, their copies not taken for repetition; rows without a file or
    page number have no running lines by repetition; other columns are ignored."""
    corpus = Corpus(pages, results, summaries, glossary)
    one = lambda df, tbl, kind: df.select(F.lit(tbl).alias("tbl"), F.col("id").alias("row_id"), F.lit(kind).alias("kind")).distinct()
    heads = results.select(F.col("result_id").cast("bigint").alias("id"), "doc_id", F.col("headers").alias("text"))
    both = _shaped(pages, "id", "doc_id", "page_num", "raw_text").select((F.col("id") * 2).alias("id"), "text").union(heads.select((F.col("id") * 2 + 1).alias("id"), F.regexp_replace("text", r" \| ", "\n").alias("text")))
    fixed = written(corpus.repaired(both.where("text is not null")).where("cut or misread").select("id", "cut", "misread"), "fixed")
    fixed = fixed.select(F.when(F.col("id") % 2 == 0, "pages").otherwise("search_results").alias("tbl"), F.floor(F.col("id") / 2).cast("bigint").alias("row_id"), F.explode(F.array_compact(F.array(F.when(F.col("cut"), "hyphenation"), F.when(F.col("misread"), "misread")))).alias("kind"))
    facts = written(heads.select("id", "doc_id", "text").mapInArrow(_heading_facts, "id bigint, doc_id string, key string, number boolean, notice boolean"), "headings")
    running = facts.where("not notice").join(corpus.runs, ["doc_id", "key"], "left_semi").select("id").union(facts.where("notice").select("id"))
    return (
        fixed.union(one(corpus.run_pages, "pages", "running_header"))
        .union(one(corpus.numbered, "pages", "page_number"))
        .union(one(running, "search_results", "running_header"))
        .union(one(facts.where("number"), "search_results", "page_number"))
    )


def clean_pages(pages: DataFrame, results: DataFrame, summaries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_num, text): each page as continuous paragraphs, without running lines, page numbers and noise."""
    corpus = Corpus(pages, results, summaries, glossary)
    runs = corpus.run_pages.groupBy("id").agg(F.collect_set("key").alias("runs"))
    numbers = corpus.numbered.groupBy("id").agg(F.collect_set("n").alias("numbers"))
    rows = _shaped(pages, "id", "doc_id", "page_num", "raw_text").join(runs, "id", "left").join(numbers, "id", "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs, numbers in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if text and (runs or numbers):
                    text = _without(text, set(runs or ()), set(numbers or ()))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    bare = rows.select("id", "text", "runs", "numbers").mapInArrow(strip, "id bigint, text string")
    fixed = corpus.repaired(bare)

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else paragraphs(t) for t in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    flowed = fixed.select("id", "text").mapInArrow(flow, "page_id bigint, text string")
    return flowed.join(pages.select(F.col("id").cast("bigint").alias("page_id"), "doc_id", "page_num"), "page_id").select("page_id", "doc_id", "page_num", "text")


def _without(text: str, runs: set[str], numbers: set[int]) -> str:
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    edge = {full[i] for i in (0, 1, len(full) - 2, len(full) - 1) if 0 <= i < len(full)}
    out = []
    for i, line in enumerate(lines):
        x = line.strip()
        if i in edge and x and _key(running_text(x)) in runs:
            continue
        if i in edge and x and any(n in numbers for n, _ in page_numbers(x, True)):
            m = _leader.fullmatch(x) if len(x) <= 160 else None
            if m:
                out.append(m[1])
            continue
        out.append(line)
    return "\n".join(out)


def clean_headings(pages: DataFrame, results: DataFrame, summaries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(result_id, headers): headings repaired, without running lines and page numbers, joined again."""
    corpus = Corpus(pages, results, summaries, glossary)
    heads = results.select(F.col("result_id").cast("bigint").alias("id"), "doc_id", F.col("headers").alias("text"))
    runs = corpus.runs.groupBy("doc_id").agg(F.collect_set("key").alias("runs"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text:
                    kept = []
                    for p in heading_pieces(text):
                        m = _leader.fullmatch(p) if len(p) <= 160 else None
                        p = m[1] if m else running_text(p)
                        if p and not heading_number(p) and _key(p) not in (keys or ()) and not _notice.fullmatch(p):
                            kept.append(p)
                    text = "\n\n".join(kept)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    bare = heads.join(runs, "doc_id", "left").select("id", "text", "runs").mapInArrow(strip, "id bigint, text string")
    fixed = corpus.repaired(bare)
    return fixed.select(F.col("id").alias("result_id"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s*\n\s*\n\s*", " | "), r"\s*\n\s*", " ").alias("headers"))
