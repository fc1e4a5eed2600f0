"""Word, presentation and spreadsheet files, from zip and XML of the standard library.

Parsers yield raw elements in document order; cleaning is native (see ``clean_sections``).
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions import tables
from quirestream.functions.markdown import ELEMENT, element
from quirestream.functions.text import clean_span, clean_text, strip
from quirestream.sources.html import _element, clean_spans

# Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SHEET_CUT = "(Hoja recortada a {} de {} columnas: parece una hoja de maquetación o un diagrama de Gantt, no una tabla de datos.)"
TITLES = ("title", "título", "subtitle", "subtítulo")
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


class Package:
    """The parts of one file."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Id: target, type, whether it is outside of the file."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            outside, target = r.get("TargetMode") == "External", r.get("Target", "")
            if not outside:
                target = posixpath.normpath(posixpath.join(folder, target)).lstrip("/") if not target.startswith("/") else target[1:]
            out[r.get("Id")] = (target, r.get("Type", ""), outside)
        return out


def _on(node: ET.Element | None) -> bool:
    return node is not None and node.get(f"{W}val", "true").lower() not in ("0", "false", "off", "none")


def _run_text(run: ET.Element) -> str:
    out = []
    for c in run:
        out.append(c.text or "" if c.tag == f"{W}t" else "\t" if c.tag == f"{W}tab" else "\n" if c.tag in (f"{W}br", f"{W}cr") else "-" if c.tag == f"{W}noBreakHyphen" else "")
    return "".join(out)


def heading_level(style: str, most: int) -> int | None:
    name = style.strip().lower()
    if name in TITLES:
        return 1
    if name.startswith(("heading", "título")):
        n = re.search(r"\d+", name)
        return max(1, min(int(n[0]), most)) if n else 1
    return None


class Word:
    def __init__(self, data: bytes) -> None:
        pack = Package(data)
        self.body = pack.xml("word/document.xml").find(f"{W}body")
        self.links = {i: t for i, (t, _, outside) in pack.relations("word/document.xml").items() if outside}
        self.styles: dict[str, ET.Element] = {}
        self.default = None
        styles = pack.xml("word/styles.xml")
        for s in styles.findall(f"{W}style") if styles is not None else ():
            self.styles[s.get(f"{W}styleId")] = s
            if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true"):
                self.default = s.get(f"{W}styleId")
        self.formats: dict[tuple[str, int], str] = {}
        numbering = pack.xml("word/numbering.xml")
        if numbering is not None:
            kinds = {a.get(f"{W}abstractNumId"): {int(x.get(f"{W}ilvl", 0)): f.get(f"{W}val", "") for x in a.findall(f"{W}lvl") if (f := x.find(f"{W}numFmt")) is not None} for a in numbering.findall(f"{W}abstractNum")}
            for n in numbering.findall(f"{W}num"):
                ref = n.find(f"{W}abstractNumId")
                for level, fmt in kinds.get(ref.get(f"{W}val") if ref is not None else None, {}).items():
                    self.formats[n.get(f"{W}numId"), level] = fmt

    def style(self, p: ET.Element) -> tuple[str, list[ET.Element]]:
        """Name of a paragraph's style, and the style with those that it is based on."""
        ref = p.find(f"{W}pPr/{W}pStyle")
        at, chain = ref.get(f"{W}val") if ref is not None else self.default, []
        while at in self.styles and self.styles[at] not in chain:
            chain.append(self.styles[at])
            up = chain[-1].find(f"{W}basedOn")
            at = up.get(f"{W}val") if up is not None else None
        name = chain[0].find(f"{W}name") if chain else None
        return (name.get(f"{W}val", "") if name is not None else "", chain)

    def numbering(self, p: ET.Element, chain: list[ET.Element]) -> tuple[int, bool, bool]:
        """Level, whether the list is numbered, and whether the paragraph itself says so."""
        own = p.find(f"{W}pPr/{W}numPr")
        found = next((n for s in (p, *chain) if (n := s.find(f"{W}pPr/{W}numPr")) is not None), None)
        value = lambda tag: None if found is None or found.find(f"{W}{tag}") is None else found.find(f"{W}{tag}").get(f"{W}val")
        level = int(value("ilvl") or 0)
        fmt = self.formats.get((value("numId"), level))
        return level, fmt not in (None, "bullet", "none"), own is not None

    def spans(self, p: ET.Element) -> list[dict]:
        out = []
        for c in p:
            if c.tag == f"{W}r":
                runs, url = [c], None
            elif c.tag == f"{W}hyperlink":
                runs, url = c.findall(f"{W}r"), self.links.get(c.get(f"{R}id"))
            else:
                continue
            if url:
                if text := "".join(map(_run_text, runs)).strip():
                    out.append({"text": text, "bold": False, "italic": False, "link": url})
                continue
            for r in runs:
                if text := _run_text(r):
                    out.append({"text": text, "bold": _on(r.find(f"{W}rPr/{W}b")), "italic": _on(r.find(f"{W}rPr/{W}i")), "link": None})
        return out

    def text(self, p: ET.Element) -> str:
        return "".join(_run_text(r) for c in p for r in ([c] if c.tag == f"{W}r" else c.findall(f"{W}r") if c.tag == f"{W}hyperlink" else ()))

    def rows(self, t: ET.Element) -> list[list[str]]:
        out = []
        for tr in t.findall(f"{W}tr"):
            row = []
            for tc in tr.findall(f"{W}tc"):
                span = tc.find(f"{W}tcPr/{W}gridSpan")
                row += ["\n".join(self.text(p) for p in tc.findall(f"{W}p"))] * (int(span.get(f"{W}val", 1)) if span is not None else 1)
            out.append(row)
        return out

    def elements(self, most: int) -> list[dict]:
        out: list[dict] = []
        for c in self.body:
            if c.tag == f"{W}tbl":
                if rows := self.rows(c):
                    out.append(_element("table", rows=rows))
            elif c.tag == f"{W}p" and (text := self.text(c)).strip():
                name, chain = self.style(c)
                level, ordered, own = self.numbering(c, chain)
                spans = self.spans(c) or [{"text": text, "bold": False, "italic": False, "link": None}]
                if (h := heading_level(name, most)) is not None:
                    out.append(_element("heading", level=h, text=text))
                elif own or "list" in name.lower():
                    item = {"spans": spans, "level": level, "ordered": ordered}
                    if out and out[-1]["kind"] == "list" and out[-1]["rich_items"][-1]["ordered"] == ordered:
                        out[-1]["rich_items"].append(item)
                    else:
                        out.append(_element("list", items=[], rich_items=[item]))
                else:
                    out.append(_element("paragraph", text=text, spans=spans))
        return out


def read_word(data: bytes, most: int) -> list[list[dict]]:
    return [Word(data).elements(most)]


def _frame(body: ET.Element | None) -> list[str]:
    """Paragraphs of a text frame."""
    out = []
    for p in body.findall(f"{A}p") if body is not None else ():
        out.append("".join((c.findtext(f"{A}t") or "") if c.tag in (f"{A}r", f"{A}fld") else "\n" if c.tag == f"{A}br" else "" for c in p))
    return out


def _slide(root: ET.Element, notes: ET.Element | None) -> list[dict]:
    out: list[dict] = []
    shapes = list(root.find(f"{P}cSld/{P}spTree"))
    kind = lambda s: next((ph.get("type", "obj") for ph in s.iterfind(f"{P}nvSpPr/{P}nvPr/{P}ph")), None)
    title = next((s for s in shapes if s.tag == f"{P}sp" and kind(s) in ("title", "ctrTitle")), None)
    if title is not None and (text := "\n".join(_frame(title.find(f"{P}txBody")))).strip():
        out.append(_element("heading", level=1, text=text))
    for s in shapes:
        if s is title:
            continue
        if s.tag == f"{P}graphicFrame":
            if (table := s.find(f".//{A}tbl")) is not None:
                if rows := [["\n".join(_frame(tc.find(f"{A}txBody"))) for tc in tr.findall(f"{A}tc")] for tr in table.findall(f"{A}tr")]:
                    out.append(_element("table", rows=rows))
        elif s.tag == f"{P}sp":
            paras = [p for p in _frame(s.find(f"{P}txBody")) if p.strip()]
            if len(paras) > 1:
                out.append(_element("list", items=paras))
            elif paras:
                out.append(_element("paragraph", text=paras[0]))
    if notes is not None:
        body = next((s for s in notes.iterfind(f"{P}cSld/{P}spTree/{P}sp") if kind(s) == "body"), None)
        lines = [x for p in _frame(body.find(f"{P}txBody") if body is not None else None) for x in p.splitlines() if x.strip()]
        if lines:
            out += [_element("heading", level=2, text="Notas"), *(_element("paragraph", text=x) for x in lines)]
    return out


def read_slides(data: bytes, most: int) -> list[list[dict]]:
    pack = Package(data)
    deck = "ppt/presentation.xml"
    rels, out = pack.relations(deck), []
    for ref in pack.xml(deck).iterfind(f"{P}sldIdLst/{P}sldId"):
        part = rels[ref.get(f"{R}id")][0]
        notes = next((t for t, kind, _ in pack.relations(part).values() if kind.endswith("/notesSlide")), None)
        out.append(_slide(pack.xml(part), pack.xml(notes) if notes else None))
    return out


def _value(cell: ET.Element, shared: list[str], dates: set[int], epoch: dt.datetime) -> str:
    kind, v = cell.get("t", "n"), cell.findtext(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iterfind(f".//{S}t"))
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "True" if v == "1" else "False"
    if kind != "n":
        return v
    if int(cell.get("s", 0)) in dates:
        at = epoch + dt.timedelta(seconds=round(float(v) * 86400))
        return str(at.time()) if float(v) < 1 else str(at)
    return v if re.fullmatch(r"-?\d+", v) else str(float(v))


def read_sheets(data: bytes, max_rows: int) -> list[list[dict]]:
    """Per worksheet a heading and a table of raw cells, cut at ``max_rows``."""
    pack = Package(data)
    book = "xl/workbook.xml"
    root, rels = pack.xml(book), pack.relations(book)
    strings = pack.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in strings.findall(f"{S}si")] if strings is not None else []
    styles, dates = pack.xml("xl/styles.xml"), set()
    if styles is not None:
        own = {int(f.get("numFmtId")) for f in styles.iterfind(f"{S}numFmts/{S}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)}
        dates = {i for i, x in enumerate(styles.iterfind(f"{S}cellXfs/{S}xf")) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}
    props = root.find(f"{S}workbookPr")
    epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    out = []
    for sheet in root.iterfind(f"{S}sheets/{S}sheet"):
        part, kind, _ = rels[sheet.get(f"{R}id")]
        if not kind.endswith("/worksheet"):
            continue
        rows: list[list[str]] = []
        for r in pack.xml(part).iterfind(f"{S}sheetData/{S}row"):
            at = int(r.get("r", len(rows) + 1)) - 1
            if at >= max_rows:
                break
            while len(rows) <= at:
                rows.append([])
            for c in r.findall(f"{S}c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                col = len(rows[at])
                if letters:
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    col -= 1
                rows[at] += [""] * (col + 1 - len(rows[at]))
                rows[at][col] = _value(c, shared, dates, epoch)
        out.append([_element("heading", level=1, text=sheet.get("name") or "Hoja"), _element("sheet", rows=rows)])
    return out


def parse_office(config: Config = DEFAULT):
    """A pandas function: (content, extension) to raw sections and the error."""
    rows, most = config.xlsx_max_rows, config.heading_max_levels

    @F.pandas_udf(f"sections array<array<{ELEMENT}>>, error string")
    def parse(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        readers = {".docx": lambda d: read_word(d, most), ".pptx": lambda d: read_slides(d, most), ".xlsx": lambda d: read_sheets(d, rows)}
        out = []
        for data, x in zip(content, extension, strict=True):
            try:
                out.append((readers[x](data), None))
            except Exception as e:  # any broken file is a row in the quarantine, never a failed task
                locked = "password" in str(e).lower() or "encrypt" in str(e).lower() or (data or b"")[:4] == b"\xd0\xcf\x11\xe0"
                out.append((None, "INFRA_PASSWORD_PROTECTED" if locked else "INFRA_CORRUPT_FILE"))
        return pd.DataFrame(out, columns=["sections", "error"])

    return parse


def clean_sections(files: DataFrame, name: str = "sections", config: Config = DEFAULT) -> DataFrame:
    """``files`` with the raw office elements of the column ``name`` made final. Worksheets
    go through the steps of their cleaning as columns, one after another."""
    clean = lambda t: strip(clean_text(t, config))
    frag = lambda t: clean_span(t, config)

    def one(e: Column) -> Column:
        cells = F.transform(e["rows"], lambda r: F.transform(r, lambda c: clean_text(c, config)))
        rich = F.transform(e["rich_items"], lambda i: i.withField("spans", clean_spans(i["spans"], frag)))
        return e.withField("text", clean(e["text"])).withField("spans", clean_spans(e["spans"], frag)).withField("items", F.transform(e["items"], clean)).withField("rich_items", rich).withField("rows", cells)

    def each(change):
        return F.transform(name, lambda es: F.transform(es, change))

    def on_sheets(step):
        return lambda e: F.when(e["kind"] == "sheet", e.withField("rows", step(e["rows"]))).otherwise(e)

    files = files.withColumn(name, each(one))
    for step in tables.sheet_steps(config):
        files = files.withColumn(name, each(on_sheets(step)))

    def sheet(e: Column) -> Column:
        cols = F.size(F.get(e["rows"], 0))
        notice = element("paragraph", text=F.format_string(SHEET_CUT.replace("{}", "%d"), F.lit(config.xlsx_max_cols), cols))
        cut = element("table", rows=F.transform(e["rows"], lambda r: F.slice(r, 1, config.xlsx_max_cols)))
        return F.when(F.size(e["rows"]) == 0, F.array().cast(f"array<{ELEMENT}>")).when(cols > config.xlsx_max_cols, F.array(notice, cut)).otherwise(F.array(cut))

    final = lambda e: F.when(e["kind"] == "sheet", sheet(e)).otherwise(F.array(e))
    return files.withColumn(name, F.transform(name, lambda es: F.flatten(F.transform(es, final))))
