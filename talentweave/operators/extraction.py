"""Extraction of structured records from Word files and HTML pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Section headings and the names of their sections.
SECTIONS = {
    "agency overview": "agency_overview",
    "primary purpose of the role": "primary_purpose",
    "key accountabilities": "key_accountabilities",
    "key challenges": "key_challenges",
    "key relationships": "key_relationships",
    "role dimensions": "role_dimensions",
    "decision making": "decision_making",
    "reporting line": "reporting_line",
    "direct reports": "direct_reports",
    "budget/expenditure": "budget_expenditure",
    "key knowledge and experience": "key_knowledge_and_experience",
    "essential requirements": "essential_requirements",
    "capabilities for the role": "capabilities_for_the_role",
    "focus capabilities": "focus_capabilities",
    "complementary capabilities": "complementary_capabilities",
}
#: Sections whose lines are items of a list, and those whose content is required.
LISTS = ("key_accountabilities", "key_challenges", "key_knowledge_and_experience", "essential_requirements")
REQUIRED = (("Role title", "title"), ("Primary purpose", "primary_purpose"), ("Key accountabilities", "key_accountabilities"), ("Key challenges", "key_challenges"), ("Key relationships", "key_relationships"), ("Essential requirements", "essential_requirements"), ("Capabilities", "capabilities"))
LEVELS = ("foundational", "intermediate", "adept", "advanced", "highly advanced")

RECORD = (
    "path string, title string, fields array<struct<sequence:int,name:string,value:string>>, sections map<string,string>, items array<struct<section:string,sequence:int,text:string>>, "
    "relationships array<struct<grouping:string,sequence:int,who:string,why:string>>, capabilities array<struct<kind:string,sequence:int,grouping:string,name:string,code:string,level:string,indicators:array<string>>>, "
    "issues array<struct<issue_type:string,field:string,severity:string>>, status string"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def squeeze(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def heading_of(text: str) -> str | None:
    plain = lambda x: squeeze(re.sub(r"[^a-z0-9]+", " ", x.lower()))
    return {plain(k): v for k, v in SECTIONS.items()}.get(plain(text))


def docx_blocks(data: bytes) -> Iterator[str | list[list[str]]]:
    """Paragraph texts and tables (rows of cell texts) of a Word file, in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")

    def text(node) -> str:
        return "".join("\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))

    def walk(node):
        for child in node:
            if child.tag == f"{_W}p":
                yield text(child)
            elif child.tag == f"{_W}tbl":
                yield [["\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            elif child.tag in (f"{_W}sdt", f"{_W}sdtContent"):
                yield from walk(child)

    yield from walk(body)


def html_blocks(html: str) -> Iterator[str]:
    """Texts of headings, paragraphs, list items and cells of a page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in ("h1", "h2", "h3", "h4", "p", "li", "td", "div", "br", "tr"):
                self.flush()

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0
            if tag in ("h1", "h2", "h3", "h4", "p", "li", "td", "div", "tr"):
                self.flush()

        def handle_data(self, data):
            if not self.hidden:
                self.now.append(data)

        def flush(self):
            if text := squeeze("".join(self.now)):
                self.out.append(text)
            self.now = []

    reader = Reader()
    reader.feed(html or "")
    reader.flush()
    yield from reader.out


def _embedded(text: str) -> Iterator[tuple[str | None, str]]:
    """(section or None, text) parts of a block that has headings inside."""
    names = sorted((k for k, v in SECTIONS.items() if v in (*LISTS, "key_relationships", "role_dimensions", "capabilities_for_the_role")), key=len, reverse=True)
    parts = re.split(rf"(?i)(?<=\s)({'|'.join(map(re.escape, names))})(?=\s|$)", text)
    yield None, parts[0]
    for k in range(1, len(parts), 2):
        yield heading_of(parts[k]), parts[k + 1]


def extract(path: str, blocks: Iterator[str | list[list[str]]]) -> dict:
    """A record from blocks: a state machine whose state is the section that the last heading opened."""
    title, section, kind, group = "", "front", "Unclassified", ""
    lines: dict[str, list[str]] = {}
    fields: list[dict] = []
    relations: list[dict] = []
    capabilities: list[dict] = []
    for block in blocks:
        if isinstance(block, str):
            text = squeeze(block)
            if not text:
                continue
            if found := heading_of(text):
                section = found
                kind = {"focus_capabilities": "Focus", "complementary_capabilities": "Complementary"}.get(found, kind)
                continue
            if not title and section == "front":
                title = text
                continue
            for name, part in _embedded(block):
                section = name or section
                lines.setdefault(section, []).extend(squeeze(x) for x in part.splitlines() if squeeze(x))
            continue
        for row in block:
            cells = [squeeze(c) for c in row]
            if not any(cells):
                continue
            if found := heading_of(cells[0]):
                section = found
                kind = {"focus_capabilities": "Focus", "complementary_capabilities": "Complementary"}.get(found, kind)
            elif section == "key_relationships":
                if cells[0].lower() in ("who", "internal", "external") or len(cells) == 1:
                    group = cells[0] if cells[0].lower() != "who" else group
                else:
                    relations.append({"grouping": group, "sequence": len(relations) + 1, "who": cells[0], "why": cells[1]})
            elif "capabilit" in section:
                level = next((c for c in cells if c.lower() in LEVELS or re.fullmatch(r"(?i)level \d+", c)), "")
                if level:
                    name = next((squeeze(x) for c in row for x in c.splitlines() if squeeze(x) and squeeze(x) != level), "")
                    m = re.fullmatch(r"(.*?)\s*\(([A-Z0-9]+)\)", name)
                    notes = [squeeze(x) for c in row[1:] for x in c.splitlines() if squeeze(x) not in ("", level, name)]
                    capabilities.append({"kind": kind, "sequence": len(capabilities) + 1, "grouping": group, "name": m[1] if m else name, "code": m[2] if m else "", "level": level, "indicators": notes})
            elif len(cells) > 1:
                fields.append({"sequence": len(fields) + 1, "name": cells[0], "value": cells[1]})
    sections = {k: "\n".join(v) for k, v in lines.items() if k not in LISTS and k != "front"}
    items = [{"section": s, "sequence": k, "text": t} for s in LISTS for k, t in enumerate(_rejoin(lines.get(s, [])), 1)]
    have = {"title": title, "key_relationships": relations, "capabilities": capabilities, **sections, **{s: lines.get(s) for s in LISTS}}
    issues = [{"issue_type": "Missing mandatory content", "field": label, "severity": "High"} for label, key in REQUIRED if not have.get(key)]
    issues += [{"issue_type": "Incomplete relationship row", "field": "Key relationships", "severity": "Medium"} for r in relations if not (r["who"] and r["why"])]
    status = "Extraction requires review" if issues else "Extraction complete"
    return {"path": path, "title": title, "fields": fields, "sections": sections, "items": items, "relationships": relations, "capabilities": capabilities, "issues": issues, "status": status}


def _rejoin(lines: list[str]) -> list[str]:
    out: list[str] = []
    for line in lines:
        if out and line[:1].islower() and out[-1][-1:] not in ".;:!?":
            out[-1] += f" {line}"
        else:
            out.append(line)
    return out


def extract_files(files: DataFrame) -> DataFrame:
    """Records of Word files read as (path, content); a file that can't be read has an issue instead of a record."""

    def one(path: str, content: bytes) -> dict:
        try:
            return extract(path, docx_blocks(content))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return extract(path, iter(())) | {"issues": [{"issue_type": "Unreadable file", "field": type(e).__name__, "severity": "High"}], "status": "Extraction failed"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, RECORD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Records of HTML pages (url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([extract(u, html_blocks(h)) for u, h in zip(frame["url"], frame["html"], strict=True)])

    return pages.select("url", "html").mapInPandas(run, RECORD)


def best_framework(names: DataFrame, signatures: DataFrame) -> DataFrame:
    """(doc, framework, shared): the framework whose signature shares most names with a document, the first on ties."""
    hits = names.distinct().join(signatures, "name").groupBy("doc", "framework", "place").agg(F.count("*").alias("shared"))
    return hits.groupBy("doc").agg(F.max_by(F.struct("framework", "shared"), F.struct("shared", -F.col("place"))).alias("x")).select("doc", "x.*")
