"""Whole documents: lines and tables of all pages to pieces, one fold over each document. What it
decides is what the operators of ``layout``, ``page_tables`` and ``assemble`` decide one by one
(repeated and junk lines, headings, language, tables across pages, pieces of blocks)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache, partial
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions.text import LANGUAGE_WORD, STOP_EN, STOP_ES
from quirestream.operators.assemble import page_pieces
from quirestream.operators.lines import LINES
from quirestream.operators.page_tables import grow

PIECE = "struct<kind:string,level:int,bold:boolean,joined:boolean,parts:array<array<string>>>"
_ROWS = pa.list_(pa.list_(pa.string()))
_PAGES = pa.list_(pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("bold", pa.bool_()), ("joined", pa.bool_()), ("parts", _ROWS)])))
#: Of a line: its place in the tuple.
ORD, TEXT, SIZE, BOLD, TOP, BLOCK = range(6)
_DIGITS, _NUMBERED, _WORD = re.compile(r"\d+"), re.compile(r"\d+[.)]\s", re.ASCII), re.compile(LANGUAGE_WORD)
_ES, _EN = frozenset(STOP_ES), frozenset(STOP_EN)
_PLACE = itemgetter(TOP, ORD, TEXT)


def documents_to_pieces(lines: DataFrame, tables: DataFrame, counts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, language and ``pages`` (their pieces) from the lines of pages (doc_id, page, lines), the
    accepted tables and the number of each document's pages (doc_id, pages). Documents without pieces have no row."""
    null = lambda kind: F.lit(None).cast(kind)
    page = F.col("page").cast("int").alias("page")
    rows = lines.select("doc_id", page, "lines", null("int").alias("tbl_ord"), null("double").alias("top"), null("array<array<string>>").alias("rows"), null("bigint").alias("pages"))
    rows = rows.unionByName(tables.select("doc_id", page, null(LINES).alias("lines"), F.col("tbl_ord").cast("int").alias("tbl_ord"), F.col("top").cast("double").alias("top"), "rows", null("bigint").alias("pages")))
    rows = rows.unionByName(counts.select("doc_id", null("int").alias("page"), null(LINES).alias("lines"), null("int").alias("tbl_ord"), null("double").alias("top"), null("array<array<string>>").alias("rows"), "pages"))
    whole = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(partial(_fold, config=config), f"doc_id {kind}, language string, pages array<array<{PIECE}>>")


def _entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, page, lines (tuples), table (tbl_ord, top, rows) and number of pages of each row."""
    lines = batch.column("lines")
    fields = [c.to_pylist() for i, c in enumerate(lines.flatten().flatten()) if i != 5]  # x0 decides nothing
    flat = list(zip(*fields, strict=True))
    sizes = lines.value_lengths().to_pylist()
    columns = [batch.column(c).to_pylist() for c in ("doc_id", "page", "tbl_ord", "top", "rows", "pages")]
    at = 0
    for n, doc, page, tbl, top, rows, pages in zip(sizes, *columns, strict=True):
        own = flat[at : at + (n or 0)]
        at += n or 0
        yield doc, page, own, None if tbl is None else (tbl, top, rows), pages


def _fold(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[pa.RecordBatch]:
    doc, held, kind = None, [], None

    def made(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], _PAGES)], ["doc_id", "language", "pages"])

    for batch in batches:
        done, kind = [], batch.schema.field("doc_id").type
        for entry in _entries(batch):
            if held and entry[0] != doc:
                done += _document(doc, held, config)
                held = []
            doc = entry[0]
            held.append(entry)
        if done:
            yield made(done)
    if held and (done := _document(doc, held, config)):
        yield made(done)


def _document(doc, entries: list[tuple], config: Config) -> list[tuple]:
    pages: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    count = None
    for _, page, lines, table, n in entries:
        if n is not None:
            count = n
        elif table is not None:
            pages[page][1].append(table)
        else:
            pages[page][0].extend(lines)
    language, made = pieces_of({p: pages[p] for p in sorted(pages)}, count, config)
    return [(doc, language, made)] if made else []


def _height(line: tuple) -> tuple:
    return -math.inf if line[TOP] is None else line[TOP], line[ORD], line[TEXT]


def line_key(text: str) -> str:
    return _DIGITS.sub("#", text.lower()).strip()


@lru_cache(10_000)
def rounded(size: float | None) -> float | None:
    """To one place, halves to the even one, as the number is written."""
    if size is None or not math.isfinite(size):
        return size
    return float(Decimal(repr(size)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))


def language_of(text: str) -> str:
    words = _WORD.findall(text[:20000].lower())
    return "en" if len(words) >= 8 and sum(map(_EN.__contains__, words)) > sum(map(_ES.__contains__, words)) else "es"


def repeated(pages: dict[int, tuple[list, list]], count: int | None, config: Config) -> set[str]:
    """Keys of lines that stand among the first or last lines of many pages."""
    if not config.remove_repeated or count is None or count < config.repeated_min_pages:
        return set()
    seen = defaultdict(set)
    for page, (lines, _) in pages.items():
        full = [text for _, text in sorted((x[ORD], x[TEXT]) for x in lines if x[TEXT].strip())]
        for text in full[: config.repeated_head_lines] + full[max(len(full) - config.repeated_tail_lines, 0) :]:
            seen[line_key(text)].add(page)
    return {k for k, on in seen.items() if k and len(on) >= config.repeated_page_ratio * count}


def levels_of(kept: dict[int, list[tuple]], config: Config) -> dict[int, list[int]]:
    """Heading levels of each page's lines."""
    if not config.detect_headings:
        return {p: [0] * len(lines) for p, lines in kept.items()}
    n, first = Counter(), {}
    for p, lines in kept.items():
        own = [rounded(x[SIZE]) for x in lines]
        n.update(own)
        for s in set(own) - first.keys():
            first[s] = p, min(x[ORD] for x, t in zip(lines, own, strict=True) if t == s)
    body = min(n, key=lambda s: (-n[s], first[s]), default=None)
    large = sorted((s for s in n if s is not None and body is not None and s >= config.heading_size_ratio * body), reverse=True)[: config.heading_max_levels]
    levels = {s: i for i, s in enumerate(large, 1)}
    looks = min(len(levels) + 1, config.heading_max_levels)
    out = {}
    for p, lines in kept.items():
        own = out[p] = []
        for x in lines:
            level = levels.get(rounded(x[SIZE]))
            if level is None and not x[BOLD]:
                level = 0
            elif level is None:
                plain = x[TEXT].strip()
                named = 1 <= len(plain) <= config.heading_short_line_max_len and not plain.endswith(".") and (plain.endswith(":") or _NUMBERED.match(plain))
                level = looks if named else 0
            own.append(level)
    if config.heading_demote_title_block and out.get(1):
        _demote(out[1], config)
    return out


def _demote(levels: list[int], config: Config) -> None:
    """The headings that open the first page step down one by one; where body text ends them from -1."""
    lead = levels[0]
    end = next((i for i, level in enumerate(levels) if level <= 0 or level != lead), len(levels))
    if end >= 2:
        base = -1 if end < len(levels) and levels[end] <= 0 else lead
        levels[:end] = [min(base + k, config.heading_max_levels) for k in range(end)]


def _short(piece: dict, config: Config) -> dict:
    """Lines of paragraphs and items as one where no hyphen can vanish between them: fewer texts to hand over."""
    if config.join_lines and piece["kind"] in ("paragraph", "list"):
        piece["parts"] = [x if len(x) < 2 or any(t.endswith("-") for t in x) else [" ".join(x)] for x in piece["parts"]]
    return piece


def pieces_of(pages: dict[int, tuple[list, list]], count: int | None, config: Config) -> tuple[str, list[list[dict]]]:
    """Language and pieces of each page; ``pages`` (in order): lines and tables (tbl_ord, top, rows)."""
    gone = repeated(pages, count, config)
    kept = {}
    for p, (lines, _) in pages.items():
        own = [x for x in lines if len(plain := x[TEXT].strip()) > config.junk_line_max_len or plain.startswith(config.bullet_markers)]
        if gone:
            own = [x for x in own if line_key(x[TEXT]) not in gone]
        try:
            kept[p] = sorted(own, key=_PLACE)
        except TypeError:  # some have no height
            kept[p] = sorted(own, key=_height)
    levels = levels_of(kept, config)
    language = language_of(" ".join(x[TEXT] for lines in kept.values() for x in lines))
    # blocks in order of height, text before tables at one height
    blocks = []
    for p, (lines, tables) in pages.items():
        tops: dict[int, float] = {}
        for x in lines:
            top = math.inf if x[TOP] is None else x[TOP]
            if top < tops.get(x[BLOCK], math.inf) or x[BLOCK] not in tops:
                tops[x[BLOCK]] = top
        held = defaultdict(list)
        for x, level in zip(kept[p], levels[p], strict=True):
            held[x[BLOCK]].append((x[TEXT], level, x[BOLD]))
        own = [((-math.inf if top == math.inf else top), False, k, {"kind": "text", "rows": [], "lines": held.get(k)}) for k, top in tops.items()]
        own += [((-math.inf if top is None else top), True, k, {"kind": "table", "rows": [list(r) for r in rows]}) for k, top, rows in tables]
        blocks.append([b for *_, b in sorted(own, key=lambda b: b[:3])])
    if config.merge_tables_across_pages:
        blocks = grow(blocks, config)
    made = []
    for page in blocks:
        own = [b for b in page if b["kind"] == "table" or b["lines"]]
        if not own:
            continue
        joined = iter([bool(b.get("joined")) for b in own if b["kind"] == "table"])
        found = page_pieces([(b["kind"], b["rows"] if b["kind"] == "table" else b["lines"]) for b in own], config)
        made.append([_short(x, config) | {"joined": x["kind"] == "table" and next(joined)} for x in found])
    return language, [page for page in made if page]
