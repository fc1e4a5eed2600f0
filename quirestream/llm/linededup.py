"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. A line's ratio is the pages of the host that contain it
over all pages of the host; lines above ``max_ratio`` that stand on ``min_pages`` pages
at least are boilerplate and go from every page of that host. Only 64-bit line hashes
are shuffled, summed before the shuffle; what comes back per host is the list of its
boilerplate hashes, which ratio bounds: at most (mean lines a page) / ``max_ratio``.

Defined results: lines are trimmed of spaces and tabs for the comparison; empty lines
are never boilerplate and stay where they are; a null text or host gives no lines or
the host ''; a line that is repeated on a page counts once for it; repeated rows count
as pages of their own; an empty table gives an empty result; other columns stay, and
where one has the name of a result the result's name gets a ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.llm.naming import free
from quirestream.llm.staging import stage

#: Share of a host's pages from which a line is boilerplate, and fewest pages: one alone repeats nothing.
MAX_RATIO, MIN_PAGES = 0.2, 2

#: Boilerplate hashes of all hosts (8 bytes each) that are sent to every task at most.
SEND = 1_000_000

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCK_TAG = r"(?i)</?(?:html|head|body|title|meta|link|nav|ul|ol|li|div|article|section|header|footer|main|aside|h[1-6]|p|br|hr|table|thead|tbody|tr|td|th|pre|blockquote|form|!doctype)\b[^>]*>"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port or user; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text of a page, a line for each block of it: scripts, styles and
    comments go, block tags end a line, inline tags vanish."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCK_TAG, "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.translate(line, "\t\r", "  ")))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  ")) == ""


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float, min_pages: int) -> DataFrame:
    """One row per host that has boilerplate: ``host`` and the hashes of its lines.
    (``explode_outer``: for ``explode`` Spark would compute the keys twice, to filter by them.)"""
    lines = pages.select(host.alias("host"), F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: ~_blank(x)), _key)).alias("keys"))
    totals = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.select("host", F.explode_outer("keys").alias("key")).where("key is not null").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("drop"))


def drop_boilerplate(pages: DataFrame, *, host: Column, text: Column, out: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``out`` holding the text without boilerplate lines, and with the
    columns ``n_lines`` and ``n_dropped`` (non-empty lines seen and dropped)."""
    seen, gone = free([*pages.columns, out], "n_lines", "n_dropped")
    site, every, drop, kept = free([*pages.columns, out, seen, gone], "host", "lines", "drop", "kept")
    drops = stage(boilerplate(pages, host, text, max_ratio, min_pages).toDF(site, drop), "boilerplate")
    if (drops.agg(F.sum(F.size(drop))).first()[0] or 0) <= SEND:  # else pages and hashes meet in a shuffle
        drops = F.broadcast(drops)
    joined = pages.withColumn(site, host).withColumn(every, F.split(text, "\n")).join(drops, site, "left")
    none = F.col(drop).isNull()
    left = F.when(none, F.col(every)).otherwise(F.filter(every, lambda x: _blank(x) | ~F.array_contains(F.col(drop), _key(x))))
    full = lambda c: F.coalesce(F.size(F.filter(c, lambda x: ~_blank(x))), F.lit(0)).cast("long")
    joined = joined.withColumn(kept, left).withColumn(seen, full(every))
    joined = joined.withColumn(gone, F.when(none, F.lit(0).cast("long")).otherwise(F.col(seen) - full(kept))).withColumn(out, F.array_join(kept, "\n"))
    return joined.select(*dict.fromkeys([*pages.columns, out, seen, gone]))
