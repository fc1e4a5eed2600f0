"""Options of a conversion. Values are fixed when a plan is built and become literals in it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType


@dataclass(frozen=True)
class Config:
    # output
    extract_tables: bool = True
    detect_headings: bool = True
    mark_bold: bool = True
    remove_repeated: bool = True
    join_lines: bool = True
    single_column: bool = False
    page_markers: bool = False
    page_break: bool = False
    overwrite: bool = False
    verbose: bool = False
    autolink_urls: bool = True
    # optical character recognition
    ocr: bool = False
    ocr_lang: str = "spa+eng"
    ocr_images: bool = True
    ocr_image_min_area_ratio: float = 0.12
    ocr_placeholder_min_area_ratio: float = 0.5
    ocr_min_conf: float = 40.0
    ocr_max_images: int = 30
    ocr_timeout: float = 6.0
    ocr_total_budget_seconds: float = 4.0
    # glyphs
    dedupe_chars: bool = True
    dedupe_tolerance: float = 1.0
    pua_start: int = 0xE000
    pua_end: int = 0xF8FF
    # inputs
    supported_extensions: tuple[str, ...] = (".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md", ".csv", ".tsv", ".html", ".htm")
    max_file_size_bytes: int = 25 * 1024 * 1024
    max_files: int = 20
    max_total_bytes: int = 60 * 1024 * 1024
    pdf_max_pages: int = 300
    zip_max_entries: int = 2000
    zip_max_uncompressed_bytes: int = 400 * 1024 * 1024
    zip_max_ratio: float = 120.0
    # spreadsheets
    xlsx_max_rows: int = 1000
    xlsx_max_cols: int = 50
    xlsx_trim_dead_tail: bool = True
    xlsx_clean_layout: bool = True
    xlsx_layout_min_cols: int = 30
    xlsx_min_col_fill: float = 0.08
    xlsx_error_values: tuple[str, ...] = ("#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "#GETTING_DATA")
    # headings
    heading_size_ratio: float = 1.15
    heading_max_levels: int = 4
    heading_short_line_max_len: int = 80
    titlecase_headings: bool = True
    heading_strip_trailing_colon: bool = True
    heading_demote_title_block: bool = True
    merge_consecutive_headings: bool = True
    bold_font_markers: tuple[str, ...] = ("Bold", "Black", "Heavy", "Semibold")
    bold_line_ratio: float = 0.6
    # page furniture and repeated lines
    remove_furniture: bool = True
    furniture_max_words: int = 3
    repeated_head_lines: int = 3
    repeated_tail_lines: int = 3
    repeated_page_ratio: float = 0.5
    repeated_min_pages: int = 3
    junk_line_max_len: int = 3
    space_gap_min: float = 1.2
    space_gap_size_factor: float = 0.28
    # paragraphs that become tables or lists
    kv_to_table: bool = True
    kv_min_pairs: int = 3
    kv_min_coverage: float = 0.75
    kv_label_max_len: int = 40
    kv_table_headers: MappingProxyType = field(default_factory=lambda: MappingProxyType({"es": ("Campo", "Detalle"), "en": ("Field", "Detail")}), hash=False)
    temario_to_bullets: bool = True
    bullet_trigger_headings: tuple[str, ...] = ("temario", "contenido", "contenidos", "syllabus", "course outline", "contents", "topics")
    bullet_markers: tuple[str, ...] = ("●", "•", "‣", "▪", "◦", "-", "*", "·")
    # tables
    table_min_rows: int = 2
    table_min_cols: int = 4
    table_max_cell_concentration: float = 0.6
    table_drop_containers: bool = True
    table_report_fill: float = 0.4
    table_report_height_ratio: float = 1.3
    table_clean_min_cols: int = 2
    table_clean_max_cols: int = 3
    table_clean_min_rows: int = 3
    table_clean_min_fill: float = 0.8
    table_clean_max_cell_concentration: float = 0.35
    table_clean_max_avg_cell_len: float = 60.0
    bullet_table_max_cols: int = 2
    bullet_empty_col_ratio: float = 0.7
    polish_tables: bool = True
    cell_join_max_frag: int = 2
    cell_join_min_stem: int = 7
    cell_word_valid_endings: str = "aeiouáéíóúünrsldzxy"
    merge_score_rows: bool = True
    score_row_empty_leading: int = 2
    score_bold_parens: bool = True
    merge_orphan_score_row: bool = True
    drop_separator_rows: bool = True
    merge_tables_across_pages: bool = True
    merge_drop_repeated_header: bool = True
    merge_pad_narrower_max: int = 2

    def but(self, **changes) -> Config:
        return replace(self, **changes)


DEFAULT = Config()
