"""Elements to Markdown, as native column expressions.

An element is a struct: kind (heading, paragraph, list, table, raw), level, text, strong,
spans, items, rich_items, rows. ``spans`` and ``rich_items`` win over ``text`` and ``items``
where they are not null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions.text import SPACE, let, strip

SPAN = "struct<text:string,bold:boolean,italic:boolean,link:string>"
ELEMENT = f"struct<kind:string,level:int,text:string,strong:boolean,spans:array<{SPAN}>,items:array<string>,rich_items:array<struct<spans:array<{SPAN}>,level:int,ordered:boolean>>,rows:array<array<string>>>"
#: Fixed value: an address in running text.
URL = rf"https?://(?:(?!{SPACE})[^)])+"


def element(kind: str, *, level: Column | None = None, text: Column | None = None, strong: Column | None = None, spans: Column | None = None, items: Column | None = None, rich_items: Column | None = None, rows: Column | None = None) -> Column:
    given = dict(kind=F.lit(kind), level=level, text=text, strong=strong, spans=spans, items=items, rich_items=rich_items, rows=rows)
    return F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in given.items())).cast(ELEMENT)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_])", r"\\$1")


def url_label(url: Column, lang: Column) -> Column:
    host = F.regexp_extract(url, r"^https?://([^/]*)", 1)
    library = F.when(lang == "en", "View in library").otherwise("Ver en biblioteca")
    return F.when(F.contains(F.lower(host), F.lit("biblioteca")), library).otherwise(host)


def inline(text: Column, lang: Column | str = "es", config: Config = DEFAULT) -> Column:
    """Escaped text in which bare addresses are links; the addresses are not escaped."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    if not config.autolink_urls:
        return escape(text)

    def link(raw: Column) -> Column:
        return let(F.regexp_replace(raw, r"[.,;:)\]]+\z", ""), lambda url: _link(raw, url))

    def _link(raw: Column, url: Column) -> Column:
        return F.concat(F.lit("["), url_label(url, lang), F.lit("]("), url, F.lit(")"), escape(F.substring(raw, F.length(url) + 1, F.length(raw))))

    def linked(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(URL), F.lit(0))
        return let(found, lambda f: F.array_join(F.transform(F.split(t, URL, -1), lambda p, i: F.concat(escape(p), F.coalesce(link(F.get(f, i)), F.lit("")))), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("http")), linked(t)).otherwise(escape(t)))


def cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def table(rows: Column) -> Column:
    """A pipe table; the first row is the header."""
    return let(rows, _table)


def _table(rows: Column) -> Column:
    cols = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), (cols - F.size(r)).cast("int"))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), cols.cast("int")), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def span(s: Column) -> Column:
    text = F.coalesce(s["text"], F.lit(""))
    core = escape(strip(text))
    mark = F.when(s["bold"] & s["italic"], "***").when(s["bold"], "**").when(s["italic"], "*").otherwise("")
    mark = F.when(core == "", "").otherwise(F.coalesce(mark, F.lit("")))
    lead, trail = F.regexp_extract(text, f"^({SPACE}*)", 1), F.regexp_extract(text, rf"({SPACE}*)\z", 1)
    label = F.when(core == "", s["link"]).otherwise(core)
    return F.when(F.coalesce(s["link"], F.lit("")) != "", F.concat(F.lit("["), label, F.lit("]("), s["link"], F.lit(")"))).otherwise(F.concat(lead, mark, core, mark, trail))


def spans(column: Column) -> Column:
    return strip(F.array_join(F.transform(column, span), ""))


def rich_list(items: Column) -> Column:
    lines = F.transform(items, lambda i: F.struct(spans(i["spans"]).alias("body"), F.concat(F.repeat(F.lit("  "), F.greatest(i["level"], F.lit(0))), F.when(i["ordered"], "1. ").otherwise("- ")).alias("mark")))
    return F.array_join(F.transform(F.filter(lines, lambda x: x["body"] != ""), lambda x: F.concat(x["mark"], x["body"])), "\n")


def render_element(e: Column, lang: Column | str = "es", config: Config = DEFAULT) -> Column:
    return let(e, lambda x: _render_element(x, F.lit(lang) if isinstance(lang, str) else lang, config))


def _render_element(e: Column, lang: Column, config: Config) -> Column:
    text = F.coalesce(e["text"], F.lit(""))
    head = F.when(strip(text) == "", "").otherwise(F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), escape(strip(text))))
    body = inline(text, lang, config)
    if config.mark_bold:
        body = let(body, lambda b: F.when(F.coalesce(e["strong"], F.lit(False)) & (b != ""), F.concat(F.lit("**"), b, F.lit("**"))).otherwise(b))
    para = F.when(e["spans"].isNotNull(), spans(e["spans"])).otherwise(body)
    plain = F.array_join(F.transform(F.filter(e["items"], lambda i: i != ""), lambda i: F.concat(F.lit("- "), inline(i, lang, config))), "\n")
    listing = F.when(e["rich_items"].isNotNull(), rich_list(e["rich_items"])).otherwise(plain)
    return (
        F.when(e["kind"] == "heading", head).when(e["kind"] == "paragraph", para).when(e["kind"] == "list", listing).when(e["kind"] == "table", table(e["rows"]))
        .when(e["kind"] == "raw", F.regexp_replace(text, r"^\n+|\n+\z", "")).otherwise("")
    )


def join_parts(parts: Column) -> Column:
    """Rendered parts as a document: blank lines between, no more than one, a line end last."""
    single = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    bare = lambda t: F.when(F.rlike(ends(t), F.lit(SPACE)), strip(t)).otherwise(t)
    return let(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"), lambda t: F.concat(let(single(t), bare), F.lit("\n")))


def render_sections(sections: Column, lang: Column | str = "es", config: Config = DEFAULT) -> Column:
    """``array<array<element>>`` to one Markdown text."""

    def part(elements: Column, i: Column) -> Column:
        out = F.transform(elements, lambda e: render_element(e, lang, config))
        if config.page_markers:
            out = F.concat(F.array(F.concat(F.lit("<!-- pagina "), (i + 1).cast("string"), F.lit(" -->"))), out)
        return F.when(i < F.size(sections) - 1, F.concat(out, F.array(F.lit("---")))).otherwise(out) if config.page_break else out

    return join_parts(F.flatten(F.transform(sections, part)))
