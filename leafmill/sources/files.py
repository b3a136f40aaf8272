"""Files as page rows: plain text, word documents, sheets, slides, web pages. Bytes are read by Spark and parsed in Arrow batches."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import html

PAGES = "path string, page_num int, raw_text string, headers array<string>, has_tables boolean, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_num, raw_text): each file as one page, UTF-8 or else Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit(1).alias("page_num"), decoded(F.col("content")).alias("raw_text"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def flatten(headers: list[str], cells: list[str]) -> str:
    out = []
    for i, v in enumerate(cells):
        h = headers[i].strip() if i < len(headers) else ""
        if v.strip():
            out.append(f"{h}: {v.strip()}" if h else v.strip())
    return " | ".join(out)


def flatten_sheet(rows: list[list[str]]) -> str:
    """Rows under a header as `Header: value` lines; blank rows are skipped, the first row that holds anything is the header."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    return "\n".join(flatten(rows[0], r) for r in rows[1:]) if rows else ""


def docx_pages(data: bytes, most: int = 5000) -> list[tuple[str, list[str], bool]]:
    """Sections at headings of level 1 to 4; a table is a page of its own under the heading that holds; long sections are cut at lines."""
    from leafmill.operators.chunking import line_pages

    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    pages: list[tuple[str, list[str], bool]] = []
    heading, lines = "", []

    def flush() -> None:
        nonlocal lines
        pages.extend((p, [heading] if heading else [], False) for p in line_pages("\n".join(lines), most))
        lines = []

    for el in body if body is not None else []:
        if el.tag == f"{_W}p":
            style = el.find(f"{_W}pPr/{_W}pStyle")
            text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
            if text and style is not None and re.match(r"heading ?[1-4]", style.get(f"{_W}val", ""), re.I):
                flush()
                heading, lines = text, [text]
            elif text:
                lines.append(text)
        elif el.tag == f"{_W}tbl":
            flush()
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")]
            text = flatten_sheet(rows) or " | ".join(c for r in rows for c in r if c.strip())
            if text:
                pages.append((text, [heading] if heading else [], True))
    flush()
    return pages


def _sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet of a workbook in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")] if "xl/workbook.xml" in names else []
    for i, n in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))):
        rows = []
        for r in ET.fromstring(z.read(n)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in r.iter(f"{_S}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                text = shared[int(text)] if c.get("t") == "s" and text else text
                cells += [""] * (at - 1 - len(cells)) + [text]
            rows.append(cells)
        yield titles[i] if i < len(titles) else "", rows


def xlsx_pages(data: bytes) -> list[tuple[str, list[str], bool]]:
    """A page for each sheet that holds anything."""
    return [(flatten_sheet(rows), [name] if name else [], True) for name, rows in _sheets(data) if flatten_sheet(rows)]


def pptx_pages(data: bytes) -> list[tuple[str, list[str], bool]]:
    """A page for each slide: its title is the heading, then the text of its shapes, line by line."""
    z = zipfile.ZipFile(io.BytesIO(data))
    out = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        title, lines = "", []
        for sp in ET.fromstring(z.read(n)).iter(f"{_P}sp"):
            text = "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in sp.iter(f"{_A}p")) if x)
            ph = sp.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            if not title and text and ph is not None and ph.get("type") in ("title", "ctrTitle"):
                title = text
            if text:
                lines.append(text)
        out.append(("\n".join(lines), [title] if title else [], False))
    return out


def markdown(rows: list[list[str]]) -> str:
    """Rows as a markdown table, padded or cut to the first one's width."""
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((c.strip().replace("\n", " ") for c in [*r, *[""] * width][:width])) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])


def _cells(table: ET.Element, row: str, cell: str, text: str) -> list[list[str]]:
    return [["".join(t.text or "" for t in c.iter(text)) for c in r.iter(cell)] for r in table.iter(row)]


def docx_markdown(data: bytes) -> list[tuple[str, list[str], bool]]:
    """A word document as one page of markdown: headings by level, tables in their place, blocks apart by a blank line."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out, tables = [], False
    for el in body if body is not None else []:
        if el.tag == f"{_W}tbl":
            tables = True
            out.append(markdown(_cells(el, f"{_W}tr", f"{_W}tc", f"{_W}t")))
        elif el.tag == f"{_W}p":
            style = el.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"heading ?(\d)", style.get(f"{_W}val", "") if style is not None else "", re.I)
            text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
            out.append("#" * int(level[1]) + " " + text if level and text else text)
    text = "\n\n".join(filter(None, out))
    return [(text, [], tables)] if text else []


def xlsx_markdown(data: bytes) -> list[tuple[str, list[str], bool]]:
    """Each sheet as a line that sums it up and a markdown table; blank rows are left out."""
    out = []
    for name, rows in _sheets(data):
        rows = [r for r in rows if any(c.strip() for c in r)]
        if rows:
            heads = [h.strip() for h in rows[0]]
            more = f" (+{len(heads) - 8} more)" if len(heads) > 8 else ""
            out.append((f"Sheet: {name}. Columns: {', '.join(heads[:8])}{more}. Rows: {len(rows) - 1}.\n\n{markdown(rows)}", [name], True))
    return out


def _slides(data: bytes) -> Iterator[tuple[str, list[str], list[list[list[str]]], bool, str]]:
    """(title, texts of the other shapes, tables, whether there is a picture, notes) of each slide in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    paragraphs = lambda e: "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in e.iter(f"{_A}p"))))
    for n in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        slide, title, texts = ET.fromstring(z.read(n)), "", []
        for sp in slide.iter(f"{_P}sp"):
            ph, text = sp.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph"), paragraphs(sp)
            if text and not title and ph is not None and ph.get("type") in ("title", "ctrTitle"):
                title = text
            elif text:
                texts.append(text)
        tables = [_cells(t, f"{_A}tr", f"{_A}tc", f"{_A}t") for t in slide.iter(f"{_A}tbl")]
        notes = n.replace("slides/slide", "notesSlides/notesSlide")
        yield title, texts, tables, next(slide.iter(f"{_P}pic"), None) is not None, paragraphs(ET.fromstring(z.read(notes))) if notes in names else ""


def pptx_markdown(data: bytes) -> list[tuple[str, list[str], bool]]:
    """Each slide as markdown: its title, shapes, tables, and its notes in brackets."""
    out = []
    for title, texts, tables, _, notes in _slides(data):
        parts = [f"# {title}" if title else "", *texts, *map(markdown, tables), f"[Notes: {notes}]" if notes else ""]
        out.append(("\n\n".join(filter(None, parts)), [title] if title else [], bool(tables)))
    return out


def pptx_by_class(data: bytes, describe: Callable[[int], str] = lambda slide: "") -> list[tuple[str, list[str], bool]]:
    """Slides by what they hold: tables each as a page of `Header: value` lines, with the text beside them from 20 words on; pictures with
    under 20 words by their description, or their text where there is none; other text from 5 words on."""
    out = []
    for i, (title, texts, tables, picture, _) in enumerate(_slides(data), 1):
        text = "\n".join(filter(None, [title, *texts]))
        n, head = len(text.split()), [title] if title else []
        out += [(flatten_sheet(t), head, True) for t in tables if flatten_sheet(t)]
        if tables:
            kept = text if n >= 20 else ""
        elif picture:
            kept = "\n".join(filter(None, [text, describe(i)])) if n >= 20 else describe(i) or text
        else:
            kept = text if n >= 5 else ""
        out += [(kept, head, False)] if kept else []
    return out


def html_sections(data: bytes) -> list[tuple[str, list[str], bool]]:
    """The direct children of an exported page's body: tables as `Header: value` lines, other elements of five words on, each under the
    heading that holds and with the number of headings so far."""
    p = html.page(_text(data))
    body = next((i for i, e in enumerate(p.elements) if e.tag == "body"), None)
    out, heading, section, at = [], "", 0, body + 1 if body is not None else 0
    while at < (p.elements[body].after if body is not None else len(p.elements)):
        e = p.elements[at]
        if e.tag in html.HEADINGS:
            heading, section = p.text(e), section + 1
        elif e.tag == "table":
            heads, rows = html.grid(p, at)
            text = "\n".join(filter(None, (flatten(heads, r) for r in rows)))
            out += [(text, [f"{section}. {heading}"] if heading else [], True)] if text else []
        elif len(p.text(e).split()) >= 5:
            out.append((p.text(e), [f"{section}. {heading}"] if heading else [], False))
        at = e.after
    return out


def html_pages(data: bytes) -> list[tuple[str, list[str], bool]]:
    return [(c["text"], [c["heading"]] if c["heading"] else [], c["kind"].startswith("table")) for c in html.chunks(_text(data))]


def txt_pages(data: bytes) -> list[tuple[str, list[str], bool]]:
    return [(_text(data), [], False)]


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


#: Parsers by extension; a parser for another format (such as scanned or portable documents) is added as a function of bytes.
PARSERS: dict[str, Callable[[bytes], list[tuple[str, list[str], bool]]]] = {"docx": docx_pages, "xlsx": xlsx_pages, "pptx": pptx_pages, "html": html_pages, "htm": html_pages, "txt": txt_pages}


#: Parsers of the first generation: markdown, one page a document, sheet or slide.
MARKDOWN = PARSERS | {"docx": docx_markdown, "xlsx": xlsx_markdown, "pptx": pptx_markdown}
#: Parsers of the third generation, which sort slides and exported pages by what they hold.
BY_CLASS = PARSERS | {"pptx": pptx_by_class, "html": html_sections, "htm": html_sections}


def read_files(spark: SparkSession, path: str, parsers: dict | None = None, files: DataFrame | None = None) -> DataFrame:
    """The pages of all files below a path (path, page_num, raw_text, headers, has_tables, error).

    A file that can't be parsed, or whose extension has no parser, gives one row with the error instead of stopping the rest."""
    known = PARSERS | (parsers or {})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = known.get(p.rsplit(".", 1)[-1].lower())
                try:
                    if f is None:
                        raise ValueError("unsupported file type")
                    rows += [(p, i + 1, t, h, tab, None) for i, (t, h, tab) in enumerate(f(data))]
                except Exception as e:  # one bad file must not end the job
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["path", "page_num", "raw_text", "headers", "has_tables", "error"])

    files = files if files is not None else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, PAGES)
