"""Parsers from bytes to text, as Arrow UDFs that return ``struct<text, error>``: one bad document never fails a job.

HTML, LaTeX e-prints, JATS and DOCX use the standard library; PDF needs an optional package and reports an error without it. XML with a
document type or entities is refused.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.errors import ParsingError

#: Most bytes a packed document may unfold to.
MOST_BYTES = 64 * 1024 * 1024
PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


class _Visible(HTMLParser):
    HIDDEN = ("script", "style", "template", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.HIDDEN))
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(data: bytes) -> str:
    """Visible text, every run of white space as one space; broken markup is read leniently."""
    p = _Visible()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    return " ".join("".join(p.parts).split())


def safe_xml(data: bytes) -> ET.Element:
    """Root of a document; one that declares entities, wherever the declaration stands and however it is encoded, is refused."""

    def refuse(*_: object) -> None:
        raise ParsingError("documents that declare entities are refused")

    scan = expat.ParserCreate()
    scan.EntityDeclHandler = refuse
    try:
        scan.Parse(data, True)
        return ET.fromstring(data)
    except (ET.ParseError, expat.ExpatError) as e:
        raise ParsingError(str(e)) from e


def docx_text(data: bytes) -> str:
    """Paragraphs, table rows with tabs; deletions and field codes are skipped."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if z.getinfo("word/document.xml").file_size > MOST_BYTES:
                raise ParsingError("the document is too large")
            root = safe_xml(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise ParsingError(str(e)) from e

    def plain(node: ET.Element) -> str:
        out = []
        for x in node.iter():
            if x.tag == f"{w}t":
                out.append(x.text or "")
            elif x.tag in (f"{w}tab", f"{w}br"):
                out.append("\t" if x.tag.endswith("tab") else "\n")
        return "".join(out)

    lines = []
    for block in root.find(f"{w}body") if root.find(f"{w}body") is not None else ():
        if block.tag == f"{w}p":
            lines.append(plain(block))
        elif block.tag == f"{w}tbl":
            lines += ["\t".join(plain(c) for c in row.iter(f"{w}tc")) for row in block.iter(f"{w}tr")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def latex_text(data: bytes) -> str:
    """Source of an e-print (tar, gzip or plain): comments stripped, inputs expanded from each root in name order, orphans appended."""
    if data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            data = g.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ParsingError("the e-print is too large")
    if data[:4] == b"%PDF":
        raise ParsingError("the e-print is a PDF")
    files: dict[str, str] = {}
    try:
        room = MOST_BYTES
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.name.endswith(".tex"):
                    room -= m.size
                    if room < 0:
                        raise ParsingError("the e-print is too large")
                    files[m.name.removeprefix("./")] = t.extractfile(m).read().decode("utf-8", "replace")
    except tarfile.ReadError:
        files = {"main.tex": data.decode("utf-8", "replace")}
    files = {n: re.sub(r"(?<!\\)%.*", "", t) for n, t in files.items()}
    used: set[str] = set()

    def expand(name: str, above: tuple[str, ...]) -> str:
        used.add(name)

        def inner(m: re.Match) -> str:
            target = next((x for x in (m[1], m[1] + ".tex") if x in files), None)
            return expand(target, (*above, name)) if target and target not in (*above, name) else ""

        return re.sub(r"\\(?:input|include|subfile)\{([^{}]+)\}", inner, files[name])

    roots = sorted(n for n, t in files.items() if "\\documentclass" in t)
    out = [expand(n, ()) for n in roots]
    return "\n\n".join([*out, *(files[n] for n in sorted(files) if n not in used)]).strip()


def jats_article(data: bytes) -> dict:
    """tables (rows of tab-separated cells), title, abstract, sections, authors, keywords, journal, published, identifiers, references of a JATS article."""
    root = safe_xml(data)
    plain = lambda n: " ".join("".join(n.itertext()).split()) if n is not None else ""
    meta = root.find(".//article-meta")
    meta = meta if meta is not None else root
    dates = []
    for d in meta.iter("pub-date"):
        y, m, day = (d.findtext(x) for x in ("year", "month", "day"))
        if y and re.fullmatch(r"\d{4}", y.strip()):
            dates.append("-".join([y.strip(), *([m.strip().zfill(2)] if m and m.strip().isdigit() else []), *([day.strip().zfill(2)] if m and day and day.strip().isdigit() else [])]))
    ids: dict[str, str] = {}
    for x in meta.iter("article-id"):
        ids.setdefault(x.get("pub-id-type", ""), plain(x))

    def sections(node: ET.Element, level: int) -> list[dict]:
        return [s for sec in node.findall("sec") for s in [{"level": level, "title": plain(sec.find("title")), "text": "\n\n".join(plain(p) for p in sec.findall("p"))}, *sections(sec, level + 1)]]

    body = root.find("body")
    abstract = next((a for a in meta.iter("abstract") if not a.get("abstract-type")), None)
    tables = ["\n".join("\t".join(plain(c) for c in row if c.tag in ("td", "th")) for row in t.iter("tr")) for t in root.iter("table")]
    return {
        "tables": tables, "title": plain(meta.find(".//article-title")), "abstract": plain(abstract), "sections": sections(body, 1) if body is not None else [],
        "authors": [" ".join(x for x in (plain(c.find(".//given-names")), plain(c.find(".//surname"))) if x) for c in meta.iter("contrib") if c.get("contrib-type", "author") == "author"],
        "keywords": [plain(k) for k in meta.iter("kwd")], "journal": plain(root.find(".//journal-title")), "published": min(dates, default=None),
        "identifiers": ids, "references": [plain(r) for r in root.iter("ref")],
    }


def jats_text(data: bytes) -> str:
    a = jats_article(data)
    return "\n\n".join(x for x in (a["title"], a["abstract"], *(t for s in a["sections"] for t in (s["title"], s["text"])), *a["tables"]) if x)


def pdf_text(data: bytes) -> str:
    try:
        import pdfplumber
    except ImportError as e:
        raise ParsingError("PDF needs the optional package pdfplumber") from e
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [p.extract_text() or "" for p in pdf.pages]
        rows = [" | ".join(c or "" for c in r) for p in pdf.pages for t in p.extract_tables() for r in t]
    return "\n".join(pages) + ("\n--- EXTRACTED TABLES ---\n" + "\n".join(rows) if rows else "")


PARSERS: dict[str, Callable[[bytes], str]] = {"html": html_text, "docx": docx_text, "latex": latex_text, "jats": jats_text, "pdf": pdf_text}


def parsed(data: Column, kind: str | Callable[[bytes], str]) -> Column:
    """``struct<text, error>`` of a binary column; NULL bytes give NULL text and no error. ``kind``: a name of ``PARSERS``, or a function from bytes to text."""
    parse = kind if callable(kind) else PARSERS[kind]

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        if b is None:
            return None, None
        try:
            return parse(bytes(b)), None
        except Exception as e:  # noqa: BLE001 - any fault of a document is that document's result
            return None, f"{type(e).__name__}: {e}"[:4096]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(b) for b in s], columns=["text", "error"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, PARSED)(data)
