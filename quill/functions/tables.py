"""Pipe tables in text: cells, rows, readable lists, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space

SEPARATOR = r"^:?-{3,}:?$"
ENUMERATOR = r"(?i)^(\(?\d+[a-z]?\)|[a-z]\.|[ivxlcdm]+\.)$"


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def is_table_line(c: Column) -> Column:
    """Two bars or more."""
    return F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))) >= 2


def clean_cell(c: Column) -> Column:
    """Without images, outer bars, blanks and semicolons."""
    v = F.regexp_replace(normalize_space(c), r"!\[[^\]]*\]\([^)]+\)", "")
    return _strip(normalize_space(_strip(v, r"\s|")), " ;")


def _nonempty(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean_cell), lambda x: x != "")


def table_rows(text: Column) -> Column:
    """Array of rows of cells, separator rows left out; a table on one line has an empty cell between rows."""
    bar = r"\|"
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    many = F.transform(lines, lambda x: _nonempty(F.split(_strip(F.trim(x), "|"), bar)))
    one = F.transform(F.split(F.array_join(F.transform(F.split(text, bar), lambda c: F.coalesce(F.nullif(clean_cell(c), F.lit("")), F.lit("\u0001"))), "\u0002"), "\u0001"), lambda r: F.filter(F.split(r, "\u0002"), lambda x: x != ""))
    rows = F.when(F.contains(text, F.lit("\n")), many).otherwise(one)
    kept = F.filter(rows, lambda r: (F.size(r) > 0) & ~F.forall(r, lambda c: c.rlike(SEPARATOR)))
    return F.when(F.contains(text, F.lit("|")), kept).otherwise(F.array().cast("array<array<string>>"))


def table_row_text(cells: Column) -> Column:
    """An enumerator and its text side by side, else cells with dashes between."""
    kept = F.filter(cells, lambda c: (c != "") & ~c.rlike(SEPARATOR))
    numbered = (F.size(kept) >= 2) & F.coalesce(F.get(kept, F.lit(0)), F.lit("")).rlike(ENUMERATOR)
    return _strip(normalize_space(F.when(numbered, F.array_join(kept, " ")).otherwise(F.array_join(kept, " - "))), " ;")


def table_text(text: Column) -> Column:
    rows = F.filter(F.transform(table_rows(text), table_row_text), lambda x: x != "")
    return F.when(F.size(rows) == 0, normalize_space(text)).otherwise(_strip(normalize_space(F.array_join(rows, "; ")), " ;"))


def list_text(text: Column) -> Column:
    """Tidies the punctuation of lists."""
    v = normalize_space(text)
    for pattern, to in ((r"\s+([,.;:])", "$1"), (r"(?i)([a-z])\.;\s+", "$1. "), (r"(?i)\b([a-z])\.\s*;\s*", "$1. "), (r":\s*;", ":"), (r"(?i);\s+(dan|atau);", "; $1"), (r";\s*;", ";")):
        v = F.regexp_replace(v, pattern, to)
    return _strip(normalize_space(v), " ;")


def extracted_text(text: Column, block_type: Column) -> Column:
    is_table = (block_type == "table_or_row") | F.contains(text, F.lit("|"))
    return list_text(F.when(is_table, table_text(text)).otherwise(text))


def readability(text: Column) -> Column:
    """Struct of counts, reasons and status of a table as evidence."""
    rows = table_rows(text)
    cells = F.flatten(rows)
    plain = normalize_space(F.array_join(cells, " "))
    words = F.size(F.regexp_extract_all(plain, F.lit(r"(?i)(?<![\wÀ-ÿ])[a-zÀ-ÿ]{3,}(?![\wÀ-ÿ])"), F.lit(0)))
    symbols = F.size(F.regexp_extract_all(plain, F.lit("[=∑√×÷±^]"), F.lit(0)))
    codes = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^[HD]\|[A-Z0-9]"), F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(plain.rlike("[�]|Ã.|â€"), "mojibake"),
            F.when((F.size(rows) < 3) | (F.size(cells) < 4), "insufficient_table_structure"),
            F.when(codes >= 2, "record_code_fragment"),
            F.when(words < 4, "insufficient_natural_language"),
            F.when((symbols >= 2) & (words < 10), "formula_dominant"),
        )
    )
    return F.struct(
        F.when(F.size(reasons) == 0, "readable").otherwise("quarantined").alias("status"),
        (F.size(reasons) == 0).alias("is_readable"),
        reasons.alias("reasons"),
        F.size(rows).alias("row_count"),
        F.size(cells).alias("nonempty_cell_count"),
        words.alias("natural_word_count"),
        symbols.alias("formula_symbol_count"),
    )
