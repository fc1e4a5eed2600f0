"""Blocks of lines to elements: headings, lists, paragraphs; merging of split headings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config
from quirestream.functions.markdown import element
from quirestream.functions.tables import polish
from quirestream.functions.text import heading_text, join_lines, key_value_rows, let, strip, syllabus_items
from quirestream.operators.layout import furniture_label, furniture_labels

PIECES = "doc_id long, page int, piece_ord int, kind string, level int, bold boolean, parts array<array<string>>"
_NUMBERED = re.compile(r"\d+[.)]\s")
_ENDS = (".", ":", ";", "?", "!")


def _bullet(text: str, marks: tuple[str, ...]) -> str | None:
    if not text.startswith(marks):
        return None
    for m in marks:
        if text.startswith(m + " ") and (rest := text[len(m) :].strip()):
            return rest
    return None


def _may_join(previous: str, text: str) -> bool:
    return not previous.endswith(_ENDS) and not _NUMBERED.match(previous) and not _NUMBERED.match(text)


def pieces(lines: list[tuple[str, int, bool]], config: Config) -> list[dict]:
    """Lines (text, heading level, bold) of one block to pieces: kind, level, bold, parts.
    A heading's parts are the lines it was split into; a list's parts are its items' lines."""
    out: list[dict] = []
    for text, level, bold in lines:
        text = text.strip()
        if not text:
            continue
        last = out[-1] if out else None
        if config.detect_headings and level > 0:
            if config.merge_consecutive_headings and last and last["kind"] == "heading" and last["level"] == level and _may_join(last["parts"][-1][0], text):
                last["parts"].append([text])
            else:
                out.append({"kind": "heading", "level": level, "bold": False, "parts": [[text]]})
        elif (rest := _bullet(text, config.bullet_markers)) is not None:
            if last and last["kind"] == "list":
                last["parts"].append([rest])
            else:
                out.append({"kind": "list", "level": 0, "bold": False, "parts": [[rest]]})
        elif last and last["kind"] == "list":
            last["parts"][-1].append(text)
        elif last and last["kind"] == "paragraph":
            last["parts"][0].append(text)
            last["bold"] = False
        else:
            out.append({"kind": "paragraph", "level": 0, "bold": bold, "parts": [[text]]})
    return out


def page_pieces(blocks: list[tuple[str, list]], config: Config) -> list[dict]:
    """Blocks (text with lines, or table with rows) of a page to pieces; a heading that a
    block boundary splits is one."""
    out: list[dict] = []
    for kind, content in blocks:
        if kind == "table":
            out.append({"kind": "table", "level": 0, "bold": False, "parts": content})
            continue
        new = pieces(content, config)
        last = out[-1] if out else None
        if new and last and config.merge_consecutive_headings and last["kind"] == new[0]["kind"] == "heading" and last["level"] == new[0]["level"] and _may_join(last["parts"][-1][0], new[0]["parts"][0][0]):
            last["parts"] += new[0]["parts"]
            new = new[1:]
        out += new
    return out


def blocks_to_pieces(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``blocks``: doc_id, page, block_ord, kind, lines (text, level, bold), rows."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.sort_values("block_ord").itertuples()
        made = page_pieces([(r.kind, [list(x) for x in r.rows] if r.kind == "table" else [(x["text"], x["level"], x["bold"]) for x in r.lines]) for r in rows], config)
        key = (page["doc_id"].iloc[0], page["page"].iloc[0])
        return pd.DataFrame([(*key, i, p["kind"], p["level"], p["bold"], p["parts"]) for i, p in enumerate(made)], columns=["doc_id", "page", "piece_ord", "kind", "level", "bold", "parts"])

    return blocks.groupBy("doc_id", "page").applyInPandas(run, PIECES)


def pieces_to_elements(made: DataFrame, lang: Column, config: Config = DEFAULT) -> DataFrame:
    """Native: texts joined and cased, syllabus and key-value paragraphs turned, labels dropped.
    ``made`` has PIECES and what ``lang`` needs."""
    joined = lambda: F.transform("parts", lambda p: join_lines(p, config))
    heading = F.array_join(F.transform("parts", lambda p: heading_text(F.get(p, 0), F.col("level"), lang, config)), " ")
    text = F.when(F.col("kind") == "heading", strip(heading)).when(F.col("kind") == "paragraph", F.get(joined(), 0))
    w = Window.partitionBy("doc_id", "page").orderBy("piece_ord")
    named = made.withColumn("__text", text).withColumn("__lang", lang)
    after = F.lag(F.when(F.col("kind") == "heading", F.lower(strip(F.col("__text"))))).over(w)
    named = named.withColumn("__after", F.coalesce(after, F.lit("")))
    t = F.col("__text")
    listed = (F.col("kind") == "paragraph") & F.col("__after").isin(list(config.bullet_trigger_headings))
    named = named.withColumn("__items", F.when(listed, syllabus_items(t, config))).withColumn("__table", F.when(F.col("kind") == "paragraph", key_value_rows(t, F.col("__lang"), config)))
    items, table = F.col("__items"), F.col("__table")
    para = F.when(items.isNotNull(), element("list", items=items)).when(table.isNotNull(), element("table", rows=table)).otherwise(element("paragraph", text=t, strong=F.col("bold") & F.lit(config.mark_bold)))
    made_ = F.when(F.col("kind") == "heading", element("heading", level=F.col("level"), text=t)).when(F.col("kind") == "table", element("table", rows=F.col("parts"))).when(F.col("kind") == "list", element("list", items=joined())).otherwise(para)
    out = named.withColumn("element", made_).withColumn("elem_ord", F.col("piece_ord")).drop("__text", "__lang", "__after", "__items", "__table")
    return furniture_labels(out, config)


def page_elements(page: Column, lang: Column, config: Config = DEFAULT) -> Column:
    """Elements of a page from its ``page`` of pieces (an array in order: kind, level, bold, joined, parts), as
    ``pieces_to_elements`` has them as rows; lines come without white space at their ends, tables that were joined across pages are polished."""

    def text(p: Column) -> Column:
        heading = F.array_join(F.transform(p["parts"], lambda x: heading_text(F.get(x, 0), p["level"], lang, config)), " ")
        return F.when(p["kind"] == "heading", strip(heading)).when(p["kind"] == "paragraph", join_lines(F.get(p["parts"], 0), config, stripped=True))

    def made(p: Column, before: Column) -> Column:
        t = p["text"]
        after = F.coalesce(F.when(before["kind"] == "heading", F.lower(strip(before["text"]))), F.lit(""))
        items = F.when(after.isin(list(config.bullet_trigger_headings)), syllabus_items(t, config))
        table = F.when(F.contains(t, F.lit(":")) & F.rlike(t, F.lit(r"\d\.\d")), key_value_rows(t, lang, config))
        plain = element("paragraph", text=t, strong=p["bold"] & F.lit(config.mark_bold))
        turned = lambda i: F.when(i.isNotNull(), element("list", items=i)).otherwise(let(table, lambda k: F.when(k.isNotNull(), element("table", rows=k)).otherwise(plain)))
        rows = F.when(p["joined"], polish(p["parts"], config)).otherwise(p["parts"])
        return (
            F.when(p["kind"] == "heading", element("heading", level=p["level"], text=t)).when(p["kind"] == "table", element("table", rows=rows))
            .when(p["kind"] == "list", element("list", items=F.transform(p["parts"], lambda x: join_lines(x, config, stripped=True)))).otherwise(let(items, turned))
        )

    def elements(ps: Column) -> Column:
        return F.transform(ps, lambda p, i: made(p, F.get(ps, i - 1)))

    texts = F.transform(page, lambda p: F.struct(p["kind"].alias("kind"), p["level"].alias("level"), p["bold"].alias("bold"), p["joined"].alias("joined"), p["parts"].alias("parts"), text(p).alias("text")))
    out = let(texts, elements)
    if not config.remove_furniture:
        return out
    return let(out, lambda es: F.when(F.coalesce(furniture_label(F.get(es, 0), config) & (F.get(es, 1)["kind"] == "heading"), F.lit(False)), F.slice(es, F.lit(2), F.size(es))).otherwise(es))
