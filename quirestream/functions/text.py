"""Text cleaning as native column expressions. Plain functions of strings fuse into one
code-generated stage; ``transform``, ``filter`` and ``aggregate`` over arrays are interpreted
by Spark, still without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config

# White space as Unicode text splitting has it, word lists, patterns.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
CID = r"\(cid:(\d+)\)"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("…", "..."))
SINGLE_FROM, SINGLE_TO = "‘’‚‛“”„‟–—‒−​", "''''\"\"\"\"----"
MINOR_ES = "de del la el los las un una unos unas y e o u a en con por para al".split()
ACRONYMS_ES = "UML RUP BPMN IDEF RSU PPT APF PA PROY TF PC SQL CRC UTP HDFS NoSQL BD".split()
MINOR_EN = "a an the and or but nor for so yet as at by in of on to up via vs with from into onto than".split()
STOP_ES = (
    "el la los las de del que y en un una para con por como su es son al se los su desde entre sobre pero más también sin ya fue eran esta este "
    "esa ese sus les nos o e u a"
).split()
STOP_EN = (
    "the and of in on at to for by as is are that this with from or an a be was were will would can could should their its into about which "
    "these those has have had not"
).split()
LANGUAGE_WORD = "[a-záéíóúñü]+"
KEY_VALUE = r"(\d+(?:\.\d+)+)\.?\s*([^:]+?):\s*(.+?)(?=\s+\d+(?:\.\d+)+\.?\s|\z)"
SYLLABUS_SPLIT = r"(?<=[.?])\s+(?=[A-ZÁÉÍÓÚÑ])|\s+[-–]\s*(?=[A-ZÁÉÍÓÚÑ])"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def stitched(text: Column, pattern: str, group: int, inner) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``inner(group of the match)``:
    the pieces between matches and the matches, laid side by side."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(inner(F.get(found, i)), F.lit("")))), "")


def repair_cid(text: Column) -> Column:
    """``(cid:n)`` to the Latin-1 character n where that is printable, else to nothing."""

    def one(code: Column) -> Column:
        n = code.try_cast("int")
        return F.when(n.between(0x20, 0x7E) | n.between(0xA0, 0xFF), F.char(n)).otherwise("")

    return let(text, lambda t: F.when(F.contains(t, F.lit("(cid:")), stitched(t, CID, 1, one)).otherwise(t))


def strip_private(text: Column, config: Config = DEFAULT) -> Column:
    """Without characters of the private-use range."""
    return F.regexp_replace(text, rf"[\x{{{config.pua_start:X}}}-\x{{{config.pua_end:X}}}]", "")


def normalize_unicode(text: Column) -> Column:
    """Ligatures, typographic quotes, dashes and dots to plain ones; zero-width space to nothing."""
    out = F.translate(repair_cid(text), SINGLE_FROM, SINGLE_TO)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def punctuation_spacing(text: Column) -> Column:
    """No blank before closing marks, none after opening ones."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+([,.;:!?)\]»])", "$1"), r"([(\[«])[ \t]+", "$1")


#: What cleaning may change: text without it stays as it is.
UNCLEAN = r"[^ -~]|  |\A | \z|\(cid:| [,.;:!?)\]]|[(\[] "


def clean_cell(text: Column, config: Config = DEFAULT) -> Column:
    """``clean_text`` of a short text that is often clean (a column or variable, since it is named three times)."""
    if config.pua_start <= 0x7E:
        return clean_text(text, config)
    return F.when(F.rlike(text, F.lit(UNCLEAN)), clean_text(text, config)).otherwise(text)


def collapse_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\n\f]+", " ")


def clean_text(text: Column, config: Config = DEFAULT) -> Column:
    return punctuation_spacing(squeeze(normalize_unicode(strip_private(text, config))))


def clean_span(text: Column, config: Config = DEFAULT) -> Column:
    """Cleaning inside of a paragraph: blanks collapse but stay at the ends."""
    return F.regexp_replace(normalize_unicode(strip_private(text, config)), r"[\t\n\r ]+", " ")


def is_all_caps(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{Lu}")) & ~F.rlike(text, F.lit(r"\p{Ll}"))


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def _has_digit(word: Column) -> Column:
    return F.rlike(word, F.lit(r"\p{Nd}"))


def title_case(text: Column, lang: Column | str = "es") -> Column:
    """Title case for text in capitals; other text stays."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return let(text, lambda t: _title_case(t, lang))


def _title_case(text: Column, lang: Column) -> Column:
    words = F.split(text, " ", -1)
    es = lambda w, i: F.when((w == "") | w.isin(ACRONYMS_ES) | _has_digit(w), w).when((i > 0) & F.lower(w).isin(MINOR_ES), F.lower(w)).otherwise(capitalized(w))
    en = lambda w, i: F.when((w == "") | _has_digit(w), w).when((i > 0) & (i < F.size(words) - 1) & F.lower(w).isin(MINOR_EN), F.lower(w)).otherwise(capitalized(w))
    cased = F.when(lang == "en", F.array_join(F.transform(words, en), " ")).otherwise(F.array_join(F.transform(words, es), " "))
    return F.when(is_all_caps(text), cased).otherwise(text)


def heading_text(text: Column, level: Column, lang: Column | str = "es", config: Config = DEFAULT) -> Column:
    """A page heading: one closing colon goes; title case below the first level."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    if config.heading_strip_trailing_colon:
        text = rstrip(F.regexp_replace(rstrip(text), r":\z", ""))
    return let(text, lambda t: F.when(level > 1, _title_case(t, lang)).otherwise(t)) if config.titlecase_headings else text


def detect_language(text: Column) -> Column:
    """en where English stop words outnumber Spanish ones in the first 20 000 characters
    (of eight words or more), else es."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, 20000)), F.lit(LANGUAGE_WORD), F.lit(0))
    hits = lambda stop: F.size(F.filter(words, lambda w: w.isin(stop)))
    return F.when((F.size(words) >= 8) & (hits(STOP_EN) > hits(STOP_ES)), "en").otherwise("es")


def line_key(text: Column) -> Column:
    """A line's key for repeats: lower case, digit runs as #."""
    return strip(F.regexp_replace(F.lower(text), r"\p{Nd}+", "#"))


def key_value_rows(text: Column, lang: Column | str = "es", config: Config = DEFAULT) -> Column:
    """Rows of ``1.1 Label: value`` paragraphs, header first; null where the text is no such thing."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return let(text, lambda t: _key_value_rows(t, lang, config))


def _key_value_rows(text: Column, lang: Column, config: Config) -> Column:
    group = lambda g: F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(g))
    items = F.arrays_zip(group(1).alias("num"), group(2).alias("label"), group(3).alias("value"), group(0).alias("all"))
    head = lambda k: F.array(*map(F.lit, config.kv_table_headers[k]))
    row = lambda m: F.array(F.concat(m["num"], F.lit(" "), strip(m["label"])), strip(m["value"]))

    def table(items: Column) -> Column:
        covered = F.aggregate(items, F.lit(0), lambda a, m: a + F.length(m["all"]))
        rows = F.concat(F.array(F.when(lang == "en", head("en")).otherwise(head("es"))), F.transform(items, row))
        enough = (F.size(items) >= config.kv_min_pairs) & (covered / F.greatest(F.length(text), F.lit(1)) >= config.kv_min_coverage)
        return F.when(enough & F.lit(config.kv_to_table), rows)

    return let(F.filter(items, lambda m: F.length(strip(m["label"])) <= config.kv_label_max_len), table)


def syllabus_items(text: Column, config: Config = DEFAULT) -> Column:
    """Items of a syllabus paragraph; null for fewer than two."""
    items = F.filter(F.transform(F.split(text, SYLLABUS_SPLIT, -1), lambda s: F.regexp_replace(s, r"^[ \-–]+|[ \-–]+\z", "")), lambda s: s != "")
    return let(items, lambda i: F.when((F.size(i) >= 2) & F.lit(config.temario_to_bullets), i))


def join_lines(lines: Column, config: Config = DEFAULT, stripped: bool = False) -> Column:
    """Lines as one text; a hyphen before a small letter vanishes with the line end. ``stripped``: they have no white space at their ends."""
    lines = lines if stripped else F.transform(lines, strip)
    if not config.join_lines:
        return punctuation_spacing(F.array_join(lines, "\n"))

    def add(raw: Column, t: Column) -> Column:
        broken = F.endswith(raw, F.lit("-")) & F.rlike(t, F.lit(r"^\p{Ll}"))
        return F.when(raw.isNull(), t).when(broken, F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), t)).otherwise(F.concat(raw, F.lit(" "), t))

    return punctuation_spacing(F.coalesce(F.aggregate(lines, F.lit(None).cast("string"), add), F.lit("")))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where it is valid (a leading mark goes), else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.when(F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF")), F.regexp_replace(text, "^﻿", "")).otherwise(text)
