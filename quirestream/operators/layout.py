"""Layout of pages: words to lines, lines to paragraphs, headings, repeated lines, glyphs, boxes.

Relations (all keyed by ``doc_id``, ``page``): words (word_ord, text, x0, x1, top, bottom,
size, fontname), lines (line_ord, text, size, bold, top, x0), boxes (tbl_ord, x0, top, x1,
bottom, rows), chars (char_ord, text, x0, top).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config
from quirestream.functions.text import is_all_caps, line_key, rstrip, strip

PAGE = ["doc_id", "page"]


def words_outside_tables(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in no accepted table of their page (borders count as inside)."""
    w, b = words.alias("w"), boxes.alias("b")
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page") == F.col("b.page")) & cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.top"), F.col("b.bottom"))
    return w.join(b, inside, "left_anti")


def containers(boxes: DataFrame) -> DataFrame:
    """Boxes that hold another box of their page whole, and are not held by it."""
    a, b = boxes.alias("a"), boxes.alias("b")
    holds = lambda x, y: (F.col(f"{x}.x0") <= F.col(f"{y}.x0")) & (F.col(f"{x}.top") <= F.col(f"{y}.top")) & (F.col(f"{x}.x1") >= F.col(f"{y}.x1")) & (F.col(f"{x}.bottom") >= F.col(f"{y}.bottom"))
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.tbl_ord") != F.col("b.tbl_ord"))
    return a.join(b, same & holds("a", "b") & ~holds("b", "a"), "left_semi")


def _line_numbers(words: Column, tolerance: Column) -> Column:
    """Line of each word, words in order of height: a line reaches as far as the tolerance
    from its first word, whose height stays the measure."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(w["cy"] - s["anchor"]) > tolerance)
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(F.when(new, w["cy"]).otherwise(s["anchor"]).alias("anchor"), line.alias("line"), F.concat(s["out"], F.array(line)).alias("out"))

    return F.aggregate(words, start, step, lambda s: s["out"])


def words_to_lines(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Lines of each page, top to bottom."""
    cy = (F.col("top") + F.col("bottom")) / 2
    bold = F.rlike(F.col("fontname"), F.lit("|".join(config.bold_font_markers))).cast("int")
    word = F.struct(cy.alias("cy"), F.col("x0"), F.col("word_ord"), F.col("text"), F.col("size"), F.col("top"), bold.alias("bold"))
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("ws"), F.greatest(F.lit(2.0), 0.4 * F.median(F.col("bottom") - F.col("top"))).alias("tol"))
    flat = pages.withColumn("n", _line_numbers(F.col("ws"), F.col("tol"))).select(*PAGE, F.explode(F.arrays_zip("ws", "n")).alias("x")).select(*PAGE, F.col("x.n").alias("line_ord"), "x.ws.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "cy", "word_ord", "text"))), lambda w: w["text"]), " ")
    return flat.groupBy(*PAGE, "line_ord").agg(text.alias("text"), F.median("size").alias("size"), (F.avg("bold") >= config.bold_line_ratio).alias("bold"), F.min("top").alias("top"), F.min("x0").alias("x0"))


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """``lines`` with ``block_ord``: a gap above 1.6 times the page's median gap starts a block."""
    order = Window.partitionBy(*PAGE).orderBy("top", "line_ord")
    gap = F.col("top") - F.lag("top").over(order)
    spaced = lines.withColumn("__gap", gap).withColumn("__mid", F.median("__gap").over(Window.partitionBy(*PAGE)))
    new = F.coalesce((F.col("__mid") > 0) & (F.col("__gap") > 1.6 * F.col("__mid")), F.lit(False)).cast("int")
    return spaced.withColumn("block_ord", F.sum(new).over(order).cast("int")).drop("__gap", "__mid")


def repeated_keys(lines: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id and key of lines that stand among the first or last lines of many pages."""
    full = lines.where(strip(F.col("text")) != "").withColumn("key", line_key(F.col("text")))
    w = Window.partitionBy(*PAGE)
    at = full.withColumn("a", F.row_number().over(w.orderBy("line_ord"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("line_ord"))))
    ends = at.where((F.col("a") <= config.repeated_head_lines) | (F.col("z") <= config.repeated_tail_lines)).where("key <> ''")
    count = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = ends.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n"))
    return seen.join(count, "doc_id").where((F.col("pages") >= config.repeated_min_pages) & (F.col("n") >= config.repeated_page_ratio * F.col("pages"))).select("doc_id", "key")


def remove_repeated(lines: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every line whose key repeats goes, wherever it stands."""
    if not config.remove_repeated:
        return lines
    keyed = lines.withColumn("key", line_key(F.col("text")))
    return keyed.join(repeated_keys(lines, pages, config), ["doc_id", "key"], "left_anti").drop("key")


def is_junk(text: Column, config: Config = DEFAULT) -> Column:
    """Very short lines that are no bullet."""
    plain = strip(text)
    marks = F.array(*map(F.lit, config.bullet_markers))
    return (F.length(plain) <= config.junk_line_max_len) & ~F.exists(marks, lambda m: F.startswith(plain, m))


def body_size(lines: DataFrame) -> DataFrame:
    """The most frequent font size of each document; of equals the one that comes first."""
    sizes = lines.where(strip(F.col("text")) != "").withColumn("s", F.bround("size", 1))
    count = sizes.groupBy("doc_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line_ord")).alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return count.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", F.col("s").alias("body"))


def is_reinforced_heading(text: Column, bold: Column, config: Config = DEFAULT) -> Column:
    plain = strip(text)
    return bold & F.length(plain).between(1, config.heading_short_line_max_len) & ~F.endswith(plain, F.lit(".")) & (F.rlike(plain, F.lit(r"^\d+[.)]\s")) | F.endswith(plain, F.lit(":")))


def assign_headings(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``lines`` with ``heading_level``: by size above the body, else by looks; 0 for none."""
    if not config.detect_headings:
        return lines.withColumn("heading_level", F.lit(0))
    sized = lines.withColumn("s", F.bround("size", 1)).join(body_size(lines), "doc_id", "left")
    large = sized.where((strip(F.col("text")) != "") & (F.col("s") >= config.heading_size_ratio * F.col("body"))).select("doc_id", "s").distinct()
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("s")))
    levels = large.withColumn("level", level).where(F.col("level") <= config.heading_max_levels)
    count = levels.groupBy("doc_id").agg(F.max("level").alias("levels"))
    joined = sized.join(levels, ["doc_id", "s"], "left").join(count, "doc_id", "left")
    looks = F.when(is_reinforced_heading(F.col("text"), F.col("bold"), config), F.least(F.coalesce("levels", F.lit(0)) + 1, F.lit(config.heading_max_levels)))
    out = joined.withColumn("heading_level", F.coalesce("level", looks, F.lit(0)).cast("int")).drop("s", "body", "level", "levels")
    return demote_title_block(out, config) if config.heading_demote_title_block else out


def demote_title_block(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The headings that open the first page, if there are two or more of one level, step
    down one by one. Where body text ends them, the count starts at -1 (kept as it is known)."""
    order = Window.partitionBy("doc_id").orderBy("top", "line_ord")
    first = lines.where((F.col("page") == 1) & (strip(F.col("text")) != "")).withColumn("k", F.row_number().over(order)).withColumn("lead", F.first("heading_level").over(order))
    stop = (F.col("heading_level") <= 0) | (F.col("heading_level") != F.col("lead"))
    ends = first.where(stop).groupBy("doc_id").agg(F.min(F.struct("k", "heading_level")).alias("e"))
    run = first.join(ends, "doc_id", "left").where(F.col("e").isNull() | (F.col("k") < F.col("e.k")))
    base = F.when(F.col("e.heading_level") <= 0, F.lit(-1)).otherwise(F.col("lead"))
    run = run.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("n >= 2")
    changed = run.select("doc_id", "page", "line_ord", F.least(base + F.col("k") - 1, F.lit(config.heading_max_levels)).cast("int").alias("__level"))
    return lines.join(changed, ["doc_id", "page", "line_ord"], "left").withColumn("heading_level", F.coalesce("__level", "heading_level")).drop("__level")


def duplicate_glyphs(chars: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pages on which a glyph is printed twice at one place."""
    t = config.dedupe_tolerance
    spots = chars.groupBy(*PAGE, "text", F.bround(F.col("x0") / t).alias("gx"), F.bround(F.col("top") / t).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    return spots.where("n > 1").select(*PAGE).distinct()


def without_duplicate_glyphs(chars: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first glyph of each place."""
    t = config.dedupe_tolerance
    w = Window.partitionBy(*PAGE, "text", F.bround(F.col("x0") / t), F.bround(F.col("top") / t)).orderBy("char_ord")
    return chars.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def furniture_label(e: Column, config: Config = DEFAULT) -> Column:
    """Whether an element is a short label in capitals."""
    words = F.size(F.filter(F.split(e["text"], r"\s+"), lambda x: x != ""))
    return (e["kind"] == "paragraph") & e["spans"].isNull() & words.between(1, config.furniture_max_words) & ~F.endswith(rstrip(e["text"]), F.lit(".")) & is_all_caps(e["text"])


def furniture_labels(elements: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``elements`` (doc_id, page, elem_ord, element) without short labels in capitals that
    open a page right before a heading."""
    if not config.remove_furniture:
        return elements
    w = Window.partitionBy(*PAGE).orderBy("elem_ord")
    label = (F.row_number().over(w) == 1) & furniture_label(F.col("element"), config) & (F.lead("element.kind").over(w) == "heading")
    return elements.withColumn("__drop", F.coalesce(label, F.lit(False))).where("not __drop").drop("__drop")
