"""Optical character recognition: recognised words to lines, and which images to read.

The recogniser itself is a hook: a function from an image to words. Decisions are made
from the page's relations alone, so they can be tested without one.
"""

from __future__ import annotations

import importlib.util
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config


def available() -> bool:
    return importlib.util.find_spec("pytesseract") is not None and shutil.which("tesseract") is not None


def words_to_lines(words: DataFrame, key: list[str], config: Config = DEFAULT) -> DataFrame:
    """Lines of recognised words (key, ord, text, conf, block_num, par_num, line_num), in the
    order in which they were first seen; unsure and blank words go."""
    sure = words.where((F.col("conf") >= config.ocr_min_conf) & (F.trim("text") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return sure.groupBy(*key, "block_num", "par_num", "line_num").agg(text.alias("line"), F.min("ord").alias("first_ord"))


def image_decisions(images: DataFrame, words: DataFrame, pages: DataFrame, *, recogniser: bool, config: Config = DEFAULT) -> DataFrame:
    """``images`` with area ratio, words whose middle lies on them and ``decision``: small, text, ocr, skip,
    placeholder or off; at most the configured number of a page is acted on."""
    key = ["doc_id", "page", "img_ord"]
    i, w = images.alias("i"), words.alias("w")
    over = (F.col("i.doc_id") == F.col("w.doc_id")) & (F.col("i.page") == F.col("w.page")) & ((F.col("w.x0") + F.col("w.x1")) / 2).between(F.col("i.x0"), F.col("i.x1")) & ((F.col("w.top") + F.col("w.bottom")) / 2).between(F.col("i.top"), F.col("i.bottom"))
    counted = i.join(w, over, "left").groupBy(*[F.col(f"i.{c}") for c in images.columns]).agg(F.count("w.x0").alias("n_words"))
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0)) * F.greatest(F.col("bottom") - F.col("top"), F.lit(0))
    sized = counted.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).withColumn("area_ratio", area / (F.col("width") * F.col("height")))
    act = F.lit("ocr") if recogniser else F.when(F.col("area_ratio") < config.ocr_placeholder_min_area_ratio, "skip").otherwise("placeholder")
    first = F.when(F.lit(not config.ocr_images), "off").when(F.col("area_ratio") < config.ocr_image_min_area_ratio, "small").when(F.col("n_words") > 5, "text").otherwise(act)
    out = sized.withColumn("decision", first)
    acted = F.sum(F.col("decision").isin("ocr", "placeholder").cast("int")).over(Window.partitionBy("doc_id", "page").orderBy("img_ord"))
    late = F.col("decision").isin("ocr", "placeholder") & (acted > config.ocr_max_images)
    return out.withColumn("decision", F.when(late, "skip").otherwise(F.col("decision"))).select(*key, "area_ratio", "n_words", "decision")


def within_budget(decisions: DataFrame, seconds: Column, config: Config = DEFAULT) -> DataFrame:
    """``decisions`` (of ``image_decisions``) under the time budget of a document: images are
    read in order as long as the seconds spent before are below it; later ones are skipped,
    or noted where they are large. ``seconds`` is what an image takes, so reruns agree."""
    w = Window.partitionBy("doc_id").orderBy("page", "img_ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(F.col("decision") == "ocr", seconds).otherwise(0.0)).over(w), F.lit(0.0))
    late = F.when(F.col("area_ratio") < config.ocr_placeholder_min_area_ratio, "skip").otherwise("placeholder")
    return decisions.withColumn("__spent", spent).withColumn("decision", F.when((F.col("decision") == "ocr") & (F.col("__spent") >= config.ocr_total_budget_seconds), late).otherwise(F.col("decision"))).drop("__spent")
