"""Template residue, filler, error pages and script notices in place of real content.

Rules name texts that are residue beyond doubt (trusted labels). Variants that no rule knows are found as near-duplicates of these:
texts that overlap by OVERLAP share one of the first hashes of their five-word sequences, which a join finds without loss and the overlap
itself checks, from label to label until the connected components of the trusted texts are exhausted. Unfilled placeholders are judged
by the rules alone, as the text around them is often real."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import sized, written

SHINGLE, OVERLAP = 5, 0.8

#: What an unfilled field looks like in common template languages and forms (fixed patterns).
PLACEHOLDER = re.compile(
    r"\{\{.{1,80}?\}\}|\{%.{1,80}?%\}|\$\{[^{}]{1,80}\}|\{\d{1,3}\}|@@[\w .-]{1,60}@@|<<[\w .-]{1,60}>>|«[\w.-]{1,60}»|\[\[[\w .-]{1,60}\]\]|##[\w .-]{1,60}##"
    r"|\b__[a-z][a-z0-9_]*__|(?<![\w%])%[a-z][a-z_]*%(?!\w)|<[\w .-]{1,60} here>|<(?:insert|enter|your) [\w .-]{1,60}>|\bx{4,}\b"
    r"|\[(?:insert|enter|add|fill in|your|vul in|to do|todo|tbd)\b[^\[\]]{0,60}\]|\[[^\[\]]{1,60} (?:invullen|invoegen|einfügen|eintragen|ergänzen)\]",
    re.I,
)
#: A sentence with one of these words speaks about fields instead of leaving one open (fixed values).
ABOUT = re.compile(r"\b(?:templates?|place-?holders?|merge fields?|form fields?|variables?|sjablo\w+|invulveld\w*|samenvoegveld\w*|platzhalter\w*|vorlagen?\w*|serienbrief\w*|seriendruck\w*)\b", re.I)
MARKER = re.compile(r"\[(?:empty page|summari[sz]ation failed|no (?:summary|content|text)|lege pagina|leere seite)\]", re.I)
#: The words of the usual filler text (fixed values).
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_N = r"[#\d]+"
#: Sentences that stand in place of content, lower-cased and with digits as #; a text is residue if all of its sentences are (fixed patterns).
SENTENCES = [
    # filler
    r"(?:tb[dc]|todo|n/?a)(?:[ ,;]+(?:tb[dc]|todo|n/?a))*", r"(?:(?:asdf|jkl|qwerty|foo|bar|test)\b[ ;,]*)+(?: ?#+)?", r"(?:bla[ ,]*){2,}.*", r"(?:hier )?(?:komt )?tekst (?:volgt|komt hier)", r"#+", r"blindtext\b.*",
    r"(?:nog )?in te vullen|nog invullen", r"sample (?:heading|body|text|paragraph|title)\b.*", r"to be (?:completed|added|written|filled in|defined)\b.*", r"[\w ]{0,40}\b(?:text|content|summary|title|description) goes here(?: ?\(#+\))?", r"(?:text|inhalt) folgt|platzhalter(?:text)?\b.*",
    # scripts
    r"(?:please |you (?:need|have) to |you must )(?:enable|allow|activate|turn on) (?:java ?)?scripts?\b.*", r"java ?script is (?:disabled|not enabled|required|blocked|turned off)\b.*", r"turn it on and reload.*", r"your browser does not (?:support|allow|run) (?:java ?)?scripts?\b.*",
    r"deze (?:toepassing|pagina|website|app) werkt alleen (?:als|met) (?:java ?)?scripts?\b.*", r"schakel (?:java ?)?scripts? in\b.*", r"(?:bitte )?(?:aktivieren|erlauben) sie (?:bitte )?(?:java ?)?scripts?\b.*", r"loading (?:viewer|page|application|document)\b.{0,20}", r"if nothing happens, switch on script support.*", r"build #+",
    # errors
    r"(?:http )?(?:error:? ?)?#{3}(?: ?[-:–|])? ?(?:error )?(?:page|seite|pagina) (?:not found|nicht gefunden|niet gevonden)", r"(?:error )?(?:page|file|document) not found", r"pagina niet gevonden", r"seite nicht gefunden", r"(?:http )?(?:status|error) #{3}(?!#).*", r"gateway time-?out\b.*", r"bad gateway\b.*", r"internal server error", r"service unavailable",
    r"(?:the )?server (?:could not|was unable to|cannot) (?:complete|process|handle|fulfil) your request.*", r"traceback\b.*", r"(?:an )?(?:unexpected )?error (?:occurred|has occurred)\b.*", r"oops|error", r"we can(?:'t|not) (?:seem to )?find (?:what|the page) you .*",
    r"(?:the|this|your) (?:requested )?(?:(?:wiki |web )?page(?: you requested)?|document(?: behind this link)?|file|attachment|preview|content|link|request|service|macro|viewer)(?: you requested)? (?:could not|can(?:'t|not)) be (?:found|loaded|displayed|opened|rendered|processed|shown)\b.{0,40}",
    r"(?:the|this|your) (?:requested )?(?:(?:wiki |web )?page(?: you requested)?|document(?: behind this link)?|file|attachment|preview|content|link|request|service|macro|viewer)(?: you requested)? (?:failed to load|took too long to respond|timed out|is restricted|is (?:temporarily|currently) (?:unavailable|not available)|is no longer available|has been (?:moved|deleted|removed)(?: or (?:moved|deleted|removed))?|was (?:moved|deleted)|does(?: not|n't) exist(?: or was (?:moved|deleted|removed))?)",
    r"(?:your )?session (?:has )?expired", r"access denied", r"(?:403 )?forbidden", r"you (?:do not|don't) have (?:permission|access|the rights?)\b.{0,60}", r"u heeft geen (?:rechten|toegang|toestemming)\b.{0,60}", r"sie haben keine (?:berechtigung|rechte)\b.{0,60}", r"er is iets misgegaan\b.{0,60}",
    r"(?:de opgevraagde pagina|deze pagina|dit document|uw aanvraag|de bijlage|het voorbeeld) (?:kan niet worden (?:gevonden|geladen|geopend|weergegeven)|kon niet worden (?:verwerkt|gevonden|geladen|geopend)|is (?:tijdelijk |momenteel )?niet beschikbaar|is verplaatst of verwijderd|bestaat niet(?: meer)?(?: of is (?:verplaatst|verwijderd))?)",
    r"(?:die (?:angeforderte )?seite|das dokument|dieses dokument|der anhang|die vorschau|ihre anfrage) (?:wurde nicht gefunden|konnte nicht (?:geladen|gefunden|verarbeitet|geöffnet) werden|ist (?:vorübergehend|derzeit) nicht (?:erreichbar|verfügbar)|wurde verschoben(?: oder gelöscht)?|existiert nicht(?: mehr)?)",
    # what follows an error
    r"(?:please )?(?:try again|retry)\b.{0,40}", r"please log ?in again\b.{0,30}", r"(?:please )?contact (?:your|the) (?:administrator|help ?desk|owner|support)\b.{0,20}", r"ask the (?:\w+ )?(?:owner|administrator) for (?:access|permission)", r"(?:please )?check the (?:address|url|link)\b.{0,30}", r"(?:please )?(?:refresh|reload) the page\b.{0,60}",
    r"(?:error|request|reference|incident)(?: code| id| no\.?| number)?:? ?#+", r"(?:foutcode|referentie|aanvraag|fehlercode|vorgang|referenz):? ?#+", r"ga terug naar\b.{0,40}", r"probeer het (?:later )?opnieuw|probeer het later nog eens", r"neem contact op met\b.{0,40}", r"bitte versuchen sie es\b.{0,40}", r"wenden sie sich an\b.{0,40}", r"\(#+\)",
]
_residue = re.compile("(?:" + "|".join(SENTENCES) + r")[\s.!?…:;]*\Z")
_banner = re.compile(r"={2,} ?page #+ ?={2,}\s*|-{3,} ?page #+ ?-{3,}\s*")
_prefix = re.compile(r"(?:\[#+\]|#+ ?\||oops!|error:)\s*")
_sentence = re.compile(r"(?<=[.!?…])\s+")
_words = re.compile(r"[^\W_]+|#+")


def masked(text: str) -> str:
    """Lower case, one space between words, digits as #."""
    return re.sub(r"\d", "#", re.sub(r"\s+", " ", text).strip().lower())


def open_placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands in a sentence that doesn't speak about such fields."""
    if not PLACEHOLDER.search(text):
        return False
    return any(PLACEHOLDER.search(s) and not ABOUT.search(s) for s in _sentence.split(text))


def is_filler(m: str) -> bool:
    words = [w for w in _words.findall(m) if w[0] != "#"]
    return len(words) >= 3 and sum(w in FILLER_WORDS for w in words) >= 0.9 * len(words)


def trusted_residue(m: str) -> bool:
    """Whether a masked text is residue from beginning to end."""
    m = _banner.sub("", m)
    if not m:
        return False
    if MARKER.fullmatch(m) or is_filler(m):
        return True
    m = _prefix.sub("", m, count=1)
    parts = [p for p in _sentence.split(m) if p]
    return bool(parts) and all(_residue.match(p) for p in parts)


def shingle_hashes(m: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word sequences; a shorter text is one sequence."""
    words = _words.findall(m)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(n)], np.uint64))


def first_hashes(s: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set, so many that any set that overlaps with it by OVERLAP has one of them among its own."""
    return s[: len(s) - math.ceil(OVERLAP * len(s) - 1e-9) + 1].view(np.int64)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        masks = [masked(t) for t in texts]
        sets = [shingle_hashes(m) for m in masks]
        columns = [
            batch.column(0), pa.array([open_placeholder(t) for t in texts], pa.bool_()), pa.array([trusted_residue(m) for m in masks], pa.bool_()), pa.array([xxhash.xxh3_128_hexdigest(m) for m in masks], pa.string()),
            pa.array(masks, pa.string()), pa.array([len(s) for s in sets], pa.int32()), pa.array([first_hashes(s) for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "open", "trusted", "node", "m", "size", "keys"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, np.ndarray] = {}
        keep = []
        for texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x, y = (known[t] if t in known else known.setdefault(t, shingle_hashes(t)) for t in texts)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= OVERLAP * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["node"]).filter(pa.array(keep, pa.bool_()))


def residue_rows(rows: DataFrame, id_col: str = "id", text_col: str = "summary_text") -> DataFrame:
    """(id, kind) of the rows to leave out; kind is placeholder, residue (by rule) or near (by its likeness to residue).

    Null and blank texts are none; every other row is judged by its own text, repeated rows alike; other columns are ignored. Texts that
    differ in digits, case and spaces only are one node, so copies are never compared. Labels spread from the trusted nodes: each round
    looks up the first hashes of the newly labelled nodes among all others, which stay where they are as long as the labelled are few,
    and compares texts of like size, until no node is added; no pair that overlaps by OVERLAP is missed. Comparisons are those of new
    labels with unlabelled nodes, each made once; real texts are never compared with each other."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(r"t rlike '\\S'")
    judged = written(texts.mapInArrow(_judged, f"id {kind}, open boolean, trusted boolean, node string, m string, size int, keys array<bigint>"), "judged")
    closed = judged.where("not open")
    columns = ["node", "m", "size", "keys"]
    once = lambda df: df.groupBy("node").agg(*(F.first(c).alias(c) for c in columns[1:]))
    new = written(once(closed.where("trusted").select(*columns)), "trusted")
    labelled, first = new.select("node"), True
    keyed = closed.where("not trusted").select("node", "size", F.explode("keys").alias("key"))
    while not new.isEmpty():
        seeds = written(new.select(F.col("node").alias("seed"), F.col("size").alias("n"), F.explode("keys").alias("key")), "seeds")
        pairs = keyed.join(sized(seeds), "key").where(F.least("size", "n") >= OVERLAP * F.greatest("size", "n") - 1e-9).select("node", "seed").distinct()
        pairs = written(pairs if first else pairs.join(labelled, "node", "left_anti"), "pairs")
        met = written(once(closed.join(sized(written(pairs.select("node").distinct(), "met")), "node", "left_semi").select(*columns)), "near")
        close = pairs.join(met.select("node", F.col("m").alias("x")), "node").join(new.select(F.col("node").alias("seed"), F.col("m").alias("y")), "seed").select("node", "x", "y")
        near = written(close.mapInArrow(_compared, "node string").distinct(), "new")
        new, first = met.join(near, "node", "left_semi"), False
        labelled = labelled.union(near)
    found = judged.where("open").select("id", F.lit("placeholder").alias("kind")).union(closed.where("trusted").select("id", F.lit("residue").alias("kind")))
    added = labelled.join(judged.where("trusted").select("node").distinct(), "node", "left_anti")
    return found.union(closed.join(added, "node", "left_semi").select("id", F.lit("near").alias("kind"))).withColumnRenamed("id", id_col)
