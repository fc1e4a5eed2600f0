"""Words of pages to lines, many pages at once: what ``layout.words_to_lines`` and
``layout.lines_to_paragraphs`` give, without a row for each word and line on the way."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config
from quirestream.operators.layout import PAGE

LINES = "array<struct<line_ord:bigint,text:string,size:double,bold:boolean,top:double,x0:double,block_ord:int>>"


def words_to_page_lines(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page and ``lines`` of each page with words (an array of what the two operators have as rows)."""
    number = [F.col(c).cast("double").alias(c) for c in ("x0", "top", "bottom", "size")]
    # the window lays the words of a page side by side, and says how many they are
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAGE)).alias("n")
    laid = words.select("doc_id", "page", F.col("word_ord").cast("long").alias("word_ord"), "text", *number, "fontname").select("*", n)
    key = ", ".join(f"{c} {laid.schema[c].dataType.simpleString()}" for c in PAGE)
    return laid.mapInArrow(partial(_whole_pages, config=config), f"{key}, lines {LINES}")


def _whole_pages(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    missing = 0
    for batch in batches:
        held.append(batch)
        missing -= batch.num_rows
        if missing > 0:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        counts, starts, at = table["n"].to_numpy(), [], 0
        while at < len(counts) and at + counts[at] <= len(counts):
            starts.append(at)
            at += int(counts[at])
        missing = at + int(counts[at]) - len(counts) if at < len(counts) else 0
        held = table.slice(at).to_batches() if missing else []
        if starts:
            with np.errstate(all="ignore"):
                yield _lines(table.slice(0, at), np.array(starts), config)


def _low(values: np.ndarray) -> np.ndarray:
    """For sorting: what is not there comes first."""
    return np.where(np.isnan(values), -np.inf, values)


def _medians(values: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Median of each group (numbered, side by side), without what is not there."""
    low = np.fmin.reduceat(values, starts)
    if np.array_equal(low, np.fmax.reduceat(values, starts), equal_nan=True):
        return low
    ranked = values[np.lexsort((values, group))]  # not-a-number is last
    n = np.add.reduceat(~np.isnan(values), starts, dtype=np.int64)
    return 0.5 * ranked[starts + np.maximum(n - 1, 0) // 2] + 0.5 * ranked[starts + np.minimum(n // 2, np.maximum(n - 1, 0))]


def _line_of(cy: np.ndarray, page: np.ndarray, tolerance: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Line of each word, numbered through: a line reaches as far as the tolerance from its
    first word, whose height stays the measure."""
    c, p = cy[order], page[order]
    reach = tolerance[p]
    new = np.ones(len(c), dtype=bool)
    new[1:] = (np.diff(p) != 0) | ~(np.diff(c) <= reach[1:])
    # only runs that are higher than the tolerance have to be gone through
    runs = np.append(np.flatnonzero(new), len(c))
    for k in np.flatnonzero(c[runs[1:] - 1] - c[runs[:-1]] > reach[runs[:-1]]).tolist():
        anchor, most = c[runs[k]], reach[runs[k]]
        for i in range(runs[k] + 1, runs[k + 1]):
            if c[i] - anchor > most:
                new[i], anchor = True, c[i]
    out = np.empty(len(c), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _bold(fonts: pa.Array, config: Config) -> np.ndarray:
    coded = fonts.dictionary_encode()
    marked = re.compile("|".join(config.bold_font_markers)).search
    known = np.array([bool(marked(f)) for f in coded.dictionary.to_pylist()] + [np.nan], dtype=float)
    return known[coded.indices.fill_null(len(known) - 1).to_numpy()]


def _lines(words: pa.Table, starts: np.ndarray, config: Config) -> pa.RecordBatch:
    number = lambda name: words[name].to_numpy()  # noqa: E731  null is not-a-number
    x0, top, bottom, size = map(number, ("x0", "top", "bottom", "size"))
    bold = _bold(words["fontname"].combine_chunks(), config)
    place = words["word_ord"].fill_null(-(1 << 63)).to_numpy()
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x0))))
    cy = (top + bottom) / 2
    tolerance = np.fmax(2.0, 0.4 * _medians(bottom - top, page, starts))
    order = np.lexsort((place, _low(x0), _low(cy), page) if np.isnan(cy).any() else (cy, page))
    line = _line_of(cy, page, tolerance, order)

    text = words["text"].combine_chunks()
    keys = (place, _low(cy), _low(x0), line)
    tied = lambda o, ks: np.logical_and.reduce([np.diff(k[o]) == 0 for k in ks]).any()
    order = np.lexsort(keys[2:])
    if tied(order, keys[2:]):
        order = np.lexsort(keys)
    if tied(order, keys):  # words of one place: by text
        texts = text.to_pylist()
        rank = np.empty(len(texts), dtype=np.int64)
        rank[sorted(range(len(texts)), key=lambda i: (texts[i] is not None, (texts[i] or "").encode()))] = np.arange(len(texts))
        order = np.lexsort((rank, *keys))
    x0, top, size, bold, line, page = (v[order] for v in (x0, top, size, bold, line, page))
    first = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(np.append(first, len(line)))
    text = text.take(pa.array(order))
    begins = np.append(first, len(line))
    if text.null_count:  # left out
        there = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
        text, begins = text.take(pa.array(there)), np.searchsorted(there, begins)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), text), " ")
    known = ~np.isnan(bold)
    share = np.add.reduceat(np.where(known, bold, 0.0), first) / np.add.reduceat(known, first, dtype=np.int64)

    page = page[first]
    offsets = np.searchsorted(page, np.arange(len(starts) + 1))
    line_ord = np.arange(len(first)) - offsets[page]
    height = np.fmin.reduceat(top, first)
    order = np.lexsort((line_ord, _low(height), page))
    gap = np.diff(height[order], prepend=np.nan)
    gap[offsets[:-1]] = np.nan
    middle = _medians(gap, page, offsets[:-1])[page]
    new = np.cumsum((middle > 0) & (gap > 1.6 * middle))
    block = np.empty(len(first), dtype=np.int32)
    block[order] = new - new[offsets[:-1]][page]

    real = lambda v: pa.array(v, pa.float64(), from_pandas=True)
    values = {
        "line_ord": pa.array(line_ord, pa.int64()), "text": joined, "size": real(_medians(size, np.repeat(np.arange(len(first)), count), first)),
        "bold": pa.array(share >= config.bold_line_ratio, pa.bool_(), mask=np.isnan(share)), "top": real(height), "x0": real(np.fmin.reduceat(x0, first)), "block_ord": pa.array(block, pa.int32()),
    }
    lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(values.values()), list(values)))
    key = [words[c].take(pa.array(starts)).combine_chunks() for c in PAGE]
    return pa.RecordBatch.from_arrays([*key, lines], [*PAGE, "lines"])
