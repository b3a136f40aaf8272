"""Rows of cells as text: header-value lines, markdown, sheet summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten_row(headers: Column, cells: Column) -> Column:
    """`Header: value` of the cells that hold something, joined by ` | `; the value alone where there is no header."""
    pairs = F.zip_with(headers, cells, lambda h, v: F.when(F.trim(F.coalesce(v, F.lit(""))) == "", F.lit(None)).when(F.trim(F.coalesce(h, F.lit(""))) == "", F.trim(v)).otherwise(F.concat(F.trim(h), F.lit(": "), F.trim(v))))
    return F.array_join(pairs, " | ")


def markdown_row(cells: Column, width: Column | None = None) -> Column:
    """A markdown table row, padded or cut to `width` cells."""
    if width is not None:
        cells = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\n", " ")), " | "), F.lit(" |"))


def injected_row(headers: Column, cells: Column) -> Column:
    """A markdown row whose cells repeat their header as `Header: value`."""
    filled = F.zip_with(headers, F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers)), lambda h, v: F.when((F.trim(h) != "") & (F.trim(F.coalesce(v, F.lit(""))) != ""), F.concat(F.trim(h), F.lit(": "), F.trim(v))).otherwise(F.coalesce(F.trim(v), F.lit(""))))
    return markdown_row(filled)


def sheet_summary(name: Column, headers: Column, n_rows: Column) -> Column:
    """One line on a sheet: its first eight columns, how many more there are, and its rows."""
    more = F.when(F.size(headers) > 8, F.concat(F.lit(" (+"), F.size(headers) - 8, F.lit(" more)"))).otherwise("")
    return F.concat(F.lit("Sheet: "), name, F.lit(". Columns: "), F.array_join(F.slice(headers, 1, 8), ", "), more, F.lit(". Rows: "), n_rows, F.lit("."))
