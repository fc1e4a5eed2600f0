"""Tables found on pages: which are accepted, and how those cut by a page end grow together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions import tables as T
from quirestream.operators.layout import containers


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, not computed anew for each mention: a generator's output is never
    put in place of its name, neither by what follows nor by a filter on it."""
    made = F.explode(F.array(value)).alias("__made")
    return df.select("*", made).withColumn(name, F.col("__made")).drop("__made")


def select_tables(boxes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every candidate with ``rows`` tidied (and polished where accepted) and ``verdict``:
    the first reason that rejects it, or accepted."""
    key = ["doc_id", "page", "tbl_ord"]
    outer = containers(boxes).select(*key, F.lit(True).alias("__outer"))
    found = _once(boxes.join(outer, key, "left"), "rows", T.tidy(F.col("rows"), config))
    rows, cols = F.col("rows"), F.coalesce(F.size(F.get("rows", 0)), F.lit(0))
    verdict = F.when(F.coalesce("__outer", F.lit(False)) & F.lit(config.table_drop_containers), "container").when(F.size(rows) < config.table_min_rows, "rows").when(T.is_bullet_list(rows, config), "bullets")
    few = (cols < config.table_min_cols) & ~T.is_clean_data_table(rows, config)
    clean = T.is_clean_data_table(rows, config)
    verdict = verdict.when(few, "columns").when(~clean & (T.concentration(rows) > config.table_max_cell_concentration), "concentration").otherwise("accepted")
    if not config.extract_tables:
        verdict = F.lit("off")
    found = _once(found, "verdict", verdict)
    return found.withColumn("rows", F.when(F.col("verdict") == "accepted", T.polish(rows, config)).otherwise(rows)).drop("__outer")


def _score(row: list[str], config: Config) -> list[str]:
    """The scores of an orphan score row; none if it is no such row."""
    lead = config.score_row_empty_leading
    rest = [c for c in row[lead:] if c]
    return rest if not any(row[:lead]) and rest and all(re.fullmatch(r"\d+([.,]\d+)?", c) for c in rest) else []


def grow(pages: list[list[dict]], config: Config) -> list[list[dict]]:
    """Blocks of each page (kind, top, rows, lines), with tables continued across pages.

    A fold over pages: the table that ends a page stays open over blank pages; a table that
    opens the next page first gives its score row to the open one, is widened if it is a
    little narrower, and joins it if it is as wide."""
    out, running = [], None
    header: list[str] = []
    for page in pages:
        blocks = list(page)
        head = blocks[0] if blocks and blocks[0]["kind"] == "table" else None
        if running is not None and head is not None:
            scores = _score(head["rows"][0], config) if config.merge_orphan_score_row and head["rows"] else []
            if scores:
                last = running["rows"][-1]
                if len(scores) <= len(last):
                    for i, s in enumerate(scores, len(last) - len(scores)):
                        piece = f"**({s})**" if config.score_bold_parens else s
                        last[i] = f"{last[i]} {piece}" if last[i] else piece
                head["rows"] = head["rows"][1:]
                if not head["rows"]:
                    blocks, head = blocks[1:], None
                    head = blocks[0] if blocks and blocks[0]["kind"] == "table" else None
            if head is not None and head["rows"]:
                wide, narrow = len(running["rows"][0]), len(head["rows"][0])
                if 0 < wide - narrow <= config.merge_pad_narrower_max:
                    head["rows"] = [[""] * (wide - narrow) + r for r in head["rows"]]
                if len(head["rows"][0]) == wide:
                    more = head["rows"][1:] if config.merge_drop_repeated_header and head["rows"][0] == header else head["rows"]
                    running["rows"] = running["rows"] + more
                    running["joined"] = True
                    blocks = blocks[1:]
                    if not blocks:
                        out.append(blocks)
                        continue
        if blocks:
            running = blocks[-1] if blocks[-1]["kind"] == "table" and blocks[-1]["rows"] else None
            header = list(running["rows"][0]) if running else []
        out.append(blocks)
    return out


def merge_across_pages(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``tables`` (doc_id, page, block_ord, kind, rows; all blocks, text blocks with null rows)
    with tables joined across pages; one group is one document."""

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        first, last = int(doc["page"].min()), int(doc["page"].max())
        pages: list[list[dict]] = [[] for _ in range(first, last + 1)]
        for r in doc.sort_values(["page", "block_ord"]).itertuples():
            pages[r.page - first].append({"block_ord": r.block_ord, "kind": r.kind, "rows": [list(x) for x in r.rows] if r.rows is not None else []})
        out = [(doc["doc_id"].iloc[0], first + p, b["block_ord"], b["kind"], b["rows"] if b["kind"] == "table" else None, bool(b.get("joined"))) for p, blocks in enumerate(grow(pages, config)) for b in blocks]
        return pd.DataFrame(out, columns=["doc_id", "page", "block_ord", "kind", "rows", "joined"])

    if not config.merge_tables_across_pages:
        return tables.withColumn("joined", F.lit(False))
    found = tables.select("doc_id", "page", "block_ord", "kind", "rows").groupBy("doc_id").applyInPandas(run, "doc_id long, page int, block_ord int, kind string, rows array<array<string>>, joined boolean")
    return found.withColumn("rows", F.when(F.col("joined"), T.polish(F.col("rows"), config)).otherwise(F.col("rows")))


def log_lines(tables: DataFrame) -> Iterator[str]:
    """What the verbose output says about each candidate."""
    for r in tables.select("doc_id", "page", "tbl_ord", "verdict").orderBy("doc_id", "page", "tbl_ord").toLocalIterator():
        yield f"[table] document {r.doc_id}, page {r.page}, table {r.tbl_ord}: {r.verdict}"
