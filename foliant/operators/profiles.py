"""Profiles of tables as if they were sheets of workbooks: cells, what columns hold, and sizes that a strategy follows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(sheet: DataFrame, name: str, file: str) -> DataFrame:
    """file_key, sheet, column, value of every cell of a wide table; `file` is the column that says which workbook a row is in."""
    columns = [c for c in sheet.columns if c != file]
    texts = sheet.select(F.col(file).cast("string").alias("file_key"), F.lit(name).alias("sheet"), *(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    return texts.unpivot(["file_key", "sheet"], columns, "column", "value")


def all_cells(sheets: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Cells of several sheets, given by name with the column of their workbook."""
    out = None
    for name, (sheet, file) in sheets.items():
        rows = cells(sheet, name, file)
        out = rows if out is None else out.unionByName(rows)
    return out


def filled(value: str = "value"):
    return F.trim(F.coalesce(F.col(value), F.lit(""))) != ""


def column_profiles(cells_: DataFrame) -> DataFrame:
    """By workbook, sheet and column: cells, filled ones, those that read as numbers, least and greatest text, longest one."""
    number = F.expr("try_cast(trim(value) as double)")
    value = F.when(filled(), F.col("value"))
    return cells_.groupBy("file_key", "sheet", "column").agg(
        F.count("*").alias("n_cells"), F.count_if(filled()).alias("n_filled"), F.count(F.when(filled(), number)).alias("n_numbers"),
        F.min(value).alias("least"), F.max(value).alias("greatest"), F.max(F.length(value)).alias("longest"),
    )


def workbook_stats(cells_: DataFrame) -> DataFrame:
    """By workbook: sheets, and cells that aren't blank. A workbook without any cell isn't there; who joins this treats it as
    unreadable (-1)."""
    by_sheet = cells_.groupBy("file_key", "sheet").agg(F.count_if(filled()).alias("n"))
    return by_sheet.groupBy("file_key").agg(F.count("*").alias("sheets"), F.sum("n").alias("cells"))


def with_workbook_stats(inventory: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Files with the sheets and cells of their workbook, -1 each where it couldn't be read."""
    side = stats.select(F.col("file_key").alias("_file"), F.col("sheets").alias("_sheets"), F.col("cells").alias("_cells"))
    met = inventory.join(side.hint("merge"), F.col(key).cast("string") == F.col("_file"), "left")
    unread = F.lit(-1).cast("long")
    return met.withColumns({"sheets": F.coalesce("_sheets", unread), "cells": F.coalesce("_cells", unread)}).drop("_file", "_sheets", "_cells")
