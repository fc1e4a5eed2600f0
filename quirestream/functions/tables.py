"""Table shaping on ``array<array<string>>`` columns: rows of cells, the first is the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions.text import clean_cell, let, strip

#: Numbers as text, scores, separator dashes.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SCORE = r"^\d+([.,]\d+)?$"
DASHES = r"^-{2,}$"
EMPTY = "array<array<string>>"


def none() -> Column:
    return F.array().cast(EMPTY)


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def padded(rows: Column) -> Column:
    """All rows as wide as the widest."""
    return let(rows, lambda t: let(width(t), lambda w: F.transform(t, lambda r: F.concat(r, F.array_repeat(F.lit(""), (w - F.size(r)).cast("int"))))))


def _columns(rows: Column) -> Column:
    """Column numbers, from 0; none for an empty table."""
    return let(width(rows), lambda w: F.when(w > 0, F.sequence(F.lit(0), w - 1)).otherwise(F.array().cast("array<int>")))


def take_columns(rows: Column, keep: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(keep, lambda i: F.get(r, i)))


def _kept(rows: Column, worth) -> Column:
    """Rows and columns in which some cell is worth it; padded."""

    def cut(t: Column) -> Column:
        keep = F.filter(_columns(t), lambda i: F.exists(t, lambda r: worth(F.get(r, i))))
        return let(keep, lambda k: take_columns(t, k))

    return F.when(F.size(rows) == 0, none()).otherwise(let(padded(rows), cut))


def blank_errors(rows: Column, config: Config = DEFAULT) -> Column:
    """Formula errors become empty cells."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.when(strip(c).isin(list(config.xlsx_error_values)), "").otherwise(c)))


def trim_empty(rows: Column) -> Column:
    full = lambda c: c != ""
    return let(F.filter(rows, lambda r: F.exists(r, full)), lambda t: _kept(t, full))


def number_of(cell: Column) -> Column:
    """The number that a cell says, with point or comma; null for other text."""
    plain = F.replace(strip(cell), F.lit(","), F.lit("."))
    return F.when(F.rlike(plain, F.lit(NUMBER)), plain.try_cast("double"))


def is_zeroish(cell: Column) -> Column:
    return (strip(cell) == "") | F.coalesce(number_of(cell) == 0, F.lit(False))


def drop_zero_only(rows: Column) -> Column:
    """Without rows and columns that hold only blanks and zeros."""
    worth = lambda c: ~is_zeroish(c)
    return let(F.filter(rows, lambda r: F.exists(r, worth)), lambda t: _kept(t, worth))


def is_counter(cells: Column) -> Column:
    """Three integers or more, 60 % of what is filled, strictly rising."""

    def judge(filled: Column) -> Column:
        whole = F.filter(F.transform(filled, number_of), lambda n: n.isNotNull() & (n == F.floor(n)))
        rising = lambda w: F.forall(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.coalesce(F.get(w, i) > F.get(w, i - 1), F.lit(True)))
        return let(whole, lambda w: (F.size(w) >= 3) & (F.size(w) >= 0.6 * F.size(filled)) & rising(w))

    return let(F.filter(cells, lambda c: strip(c) != ""), judge)


def trim_dead_tail(rows: Column) -> Column:
    """Without the last rows that have no number or text outside of counter columns; one row stays."""
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))

    def cut(t: Column) -> Column:
        free = F.filter(_columns(t), lambda i: ~is_counter(F.transform(t, lambda r: cell(r, i))))
        content = let(free, lambda f: F.when(F.size(f) > 0, f).otherwise(_columns(t)))
        last = let(content, lambda c: F.array_max(F.transform(t, lambda r, k: F.when(F.exists(c, lambda i: ~is_zeroish(cell(r, i))), k + 1))))
        return F.slice(t, F.lit(1), F.greatest(F.coalesce(last, F.lit(1)), F.lit(1)))

    return let(rows, cut)


def trim_sparse_columns(rows: Column, config: Config = DEFAULT) -> Column:
    """Without columns that are filled below the least share of rows."""

    def cut(t: Column) -> Column:
        fill = lambda i: F.size(F.filter(t, lambda r: strip(F.get(r, i)) != "")) / F.size(t)
        keep = F.filter(_columns(t), lambda i: fill(i) >= config.xlsx_min_col_fill)
        return let(keep, lambda k: F.when(F.size(k) > 0, take_columns(t, k)).otherwise(none()))

    return let(padded(rows), cut)


def sheet_steps(config: Config = DEFAULT) -> list:
    """How a worksheet is cleaned, step by step (rows to rows): errors and empty lines go, then
    the dead tail, then the layout columns of wide sheets. Steps are columns of their own in
    ``clean_sheets``: nested in one another they would take the analyser very long."""
    steps = [lambda r: blank_errors(r, config), trim_empty]
    if config.xlsx_trim_dead_tail:
        steps += [lambda r: F.when(F.size(r) == 0, r).otherwise(trim_dead_tail(r)), trim_empty]
    if config.xlsx_clean_layout:
        wide = lambda step: lambda r: let(r, lambda t: F.when(width(t) < config.xlsx_layout_min_cols, t).otherwise(step(t)))
        steps += [wide(lambda t: _layout(t, config)), trim_empty]
    return steps


def _layout(rows: Column, config: Config) -> Column:
    return let(drop_zero_only(rows), lambda t: trim_sparse_columns(t, config))


def clean_sheets(df: DataFrame, name: str, config: Config = DEFAULT) -> DataFrame:
    """``df`` with the column ``name`` (rows of a worksheet) cleaned."""
    for step in sheet_steps(config):
        df = df.withColumn(name, step(F.col(name)))
    return df


def clean_csv(rows: Column, config: Config = DEFAULT) -> Column:
    return trim_empty(blank_errors(rows, config))


def tidy(rows: Column, config: Config = DEFAULT) -> Column:
    """A table found on a page: cells cleaned, empty lines gone."""
    return trim_empty(F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(clean_cell(c, config), F.lit("")))))


def _lengths(rows: Column) -> Column:
    return F.transform(F.filter(F.flatten(rows), lambda c: c != ""), F.length)


def fill_ratio(rows: Column) -> Column:
    n = F.size(F.flatten(rows))
    return F.when(n > 0, F.size(_lengths(rows)) / n).otherwise(0.0)


def concentration(rows: Column) -> Column:
    """Share of all text that is in the longest cell."""
    total = F.aggregate(_lengths(rows), F.lit(0), lambda a, x: a + x)
    return F.when(total > 0, F.array_max(_lengths(rows)) / total).otherwise(0.0)


def mean_cell_length(rows: Column) -> Column:
    n = F.size(_lengths(rows))
    return F.when(n > 0, F.aggregate(_lengths(rows), F.lit(0), lambda a, x: a + x) / n).otherwise(0.0)


def is_clean_data_table(rows: Column, config: Config = DEFAULT) -> Column:
    return let(rows, lambda t: _clean_data(t, config))


def _clean_data(rows: Column, config: Config) -> Column:
    cols = F.coalesce(F.size(F.get(rows, 0)), F.lit(0))
    return (
        cols.between(config.table_clean_min_cols, config.table_clean_max_cols) & (F.size(rows) >= config.table_clean_min_rows) & (fill_ratio(rows) >= config.table_clean_min_fill)
        & (concentration(rows) <= config.table_clean_max_cell_concentration) & (mean_cell_length(rows) <= config.table_clean_max_avg_cell_len)
    )


def is_bullet_list(rows: Column, config: Config = DEFAULT) -> Column:
    """Two columns at most, one nearly empty, and the fullest mostly starting with a bullet."""
    return let(rows, lambda t: _bullets(t, config))


def _bullets(rows: Column, config: Config) -> Column:
    cols = F.coalesce(F.size(F.get(rows, 0)), F.lit(0))
    empty = F.transform(F.sequence(F.lit(0), F.greatest(cols - 1, F.lit(0))), lambda i: F.struct((F.size(F.filter(rows, lambda r: F.get(r, i) == "")) / F.size(rows)).alias("share"), i.alias("i")))
    data = F.array_min(empty)["i"]
    cells = F.filter(F.transform(rows, lambda r: F.get(r, data)), lambda c: c != "")
    marked = F.filter(cells, lambda c: F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1).isin(list(config.bullet_markers)))
    return F.coalesce((F.size(rows) > 0) & cols.between(1, config.bullet_table_max_cols) & (F.array_max(empty)["share"] >= config.bullet_empty_col_ratio) & (F.size(cells) > 0) & (F.size(marked) / F.size(cells) >= 0.5), F.lit(False))


def join_split_words(cell: Column, config: Config = DEFAULT) -> Column:
    """Glues short lower-case fragments to a long word before them that ends as none does."""
    stem = rf"^.*\p{{Ll}}$"

    def add(out: Column, tok: Column) -> Column:
        prev = F.element_at(out, -1)
        glue = (
            (F.size(out) > 0) & F.length(tok).between(1, config.cell_join_max_frag) & F.rlike(tok, F.lit(r"^\p{Ll}+$")) & (F.length(prev) >= config.cell_join_min_stem)
            & F.rlike(prev, F.lit(stem)) & ~F.contains(F.lit(config.cell_word_valid_endings), F.right(prev, F.lit(1)))
        )
        return F.when(glue, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(prev, tok)))).otherwise(F.concat(out, F.array(tok)))

    joined = F.array_join(F.aggregate(F.split(cell, " ", -1), F.array().cast("array<string>"), lambda o, t: F.when(F.size(o) == 0, F.array(t)).otherwise(add(o, t))), " ")
    return F.when(F.rlike(cell, F.lit(r"\p{Ll} \p{Ll}")), joined).otherwise(cell)  # else nothing can be glued


def is_score_row(row: Column, config: Config = DEFAULT) -> Column:
    """First cells empty, the others numbers."""
    lead = config.score_row_empty_leading
    rest = F.filter(F.slice(row, F.lit(lead + 1), F.greatest(F.size(row) - lead, F.lit(0))), lambda c: c != "")
    return (F.size(row) > lead) & ~F.exists(F.slice(row, 1, lead), lambda c: c != "") & (F.size(rest) > 0) & F.forall(rest, lambda c: F.rlike(c, F.lit(SCORE)))


def is_separator_row(row: Column) -> Column:
    full = F.filter(row, lambda c: c != "")
    return (F.size(full) > 0) & F.forall(full, lambda c: F.rlike(c, F.lit(DASHES)))


def _scored(cell: Column, score: Column, config: Config) -> Column:
    piece = F.concat(F.lit("**("), score, F.lit(")**")) if config.score_bold_parens else score
    return F.when(cell == "", piece).otherwise(F.trim(F.concat(cell, F.lit(" "), piece)))


def append_scores(row: Column, scores: Column, config: Config = DEFAULT) -> Column:
    """Scores onto the last cells of a row; more scores than cells are none."""
    start = F.size(row) - F.size(scores)
    out = F.transform(row, lambda c, i: F.when(i >= start, _scored(c, F.get(scores, i - start), config)).otherwise(c))
    return F.when(F.size(scores).between(1, F.size(row)), out).otherwise(row)


def polish(rows: Column, config: Config = DEFAULT) -> Column:
    """Split words joined, separators dropped, score rows written onto the row above."""
    if not config.polish_tables:
        return rows
    joined = F.transform(rows, lambda r: F.transform(r, lambda c: join_split_words(c, config)))
    kept = F.filter(joined, lambda r: ~is_separator_row(r)) if config.drop_separator_rows else joined
    if not config.merge_score_rows:
        return kept

    def add(out: Column, row: Column) -> Column:
        prev = F.element_at(out, -1)
        merged = F.transform(prev, lambda c, i: F.when(F.coalesce(F.get(row, i), F.lit("")) == "", c).otherwise(_scored(c, F.get(row, i), config)))
        return F.when(is_score_row(row, config), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(row)))

    return F.aggregate(kept, none(), lambda o, r: F.when(F.size(o) == 0, F.array(r)).otherwise(add(o, r)))
