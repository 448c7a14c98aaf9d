"""Grids: one record per sheet row (`sheet_id, sheet_name, row_no, cells`), from other shapes, and their leading rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhead.functions.once import once
from gridhead.functions.text import WHITE_SPACE, is_blank, render_cell

#: Rows that may be the header, rows below that speak for it, and rows of the preview.
MAX_ROWS, LOOKAHEAD, PREVIEW = 30, 5, 5


def prefix(max_rows: int = MAX_ROWS, lookahead: int = LOOKAHEAD, preview: int = PREVIEW) -> int:
    """Non-blank rows of a sheet that can have any effect."""
    return max_rows + max(lookahead, preview)


def leading_cells(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """The cells of the first `limit` non-blank rows of each sheet, in the partitioning by sheet.

    The filter stands on the bare rank of the rows that have a non-blank cell, so each task passes on no more than the
    limit's rows of any sheet, however tall. Cells that hold only white space, where there are any, are looked up in a join.
    """
    order = Window.partitionBy("sheet_id").orderBy("row_no")
    full = cells.where(~is_blank(F.col("value"))).withColumn("_rank", F.dense_rank().over(order))
    kept = full.where(F.col("_rank") <= (limit or prefix())).drop("_rank")
    white = cells.where(F.col("value").isNotNull() & is_blank(F.col("value")))
    return kept.unionByName(white.join(kept.select("sheet_id", "row_no").distinct(), ["sheet_id", "row_no"], "left_semi")).repartition("sheet_id")


def grid_from_cells(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """One record per cell (`sheet_id, row_no, col_no, value`, perhaps `sheet_name`) to one per row, as wide as the sheet; gaps are null.

    Of several cells at one place the greatest value counts; cells without a place (no column, or one before the first) are
    left out. Widths are combined before they are shuffled, so a tall sheet is no task of its own. With a `limit`, only
    that many non-blank rows of each sheet are made, as wide as the widest of them, and only their cells are shuffled. Work
    grows with the cells and the width.
    """
    name = F.col("sheet_name") if "sheet_name" in cells.columns else F.lit("Sheet")
    named = cells.select("sheet_id", name.alias("sheet_name"), "row_no", "col_no", "value").where("col_no >= 0")
    taken = named if limit is None else leading_cells(named, limit)
    rows = taken.groupBy("sheet_id", "sheet_name", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "value"))).alias("all"))
    last_of_place = F.filter("all", lambda c, i: (i == F.size("all") - 1) | (F.get("all", i + 1)["col_no"] != c["col_no"]))
    found = rows.withColumn("at", last_of_place).withColumn("end", F.get("at", F.size("at") - 1)["col_no"] + 1).drop("all")
    if limit is None:
        found = found.join(named.groupBy("sheet_id").agg((F.max("col_no") + 1).alias("width")), "sheet_id")
    else:
        found = found.withColumn("width", F.max("end").over(Window.partitionBy("sheet_id")))
    nothing = F.lit(None).cast("string")

    def with_gap(c: Column, i: Column) -> Column:
        before = F.coalesce(F.get("at", i - 1)["col_no"], F.lit(-1))
        return F.concat(F.array_repeat(nothing, (c["col_no"] - before - 1).cast("int")), F.array(c["value"]))

    full = F.transform("at", lambda c: c["value"])
    filled = F.concat(F.when(F.size("at") == F.col("end"), full).otherwise(F.flatten(F.transform("at", with_gap))), F.array_repeat(nothing, (F.col("width") - F.col("end")).cast("int")))
    return found.select("sheet_id", "sheet_name", "row_no", filled.alias("cells"))


def grid_from_columns(table: DataFrame, sheet_id: Column, row_no: Column, columns: Sequence[str] | None = None, sheet_name: Column | None = None) -> DataFrame:
    """A table without a header of its own: the columns, in order, are the cells."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    cells = F.array(*(render_cell(F.col(c), kinds[c]) for c in columns or table.columns))
    return table.select(sheet_id.alias("sheet_id"), (F.lit("Sheet") if sheet_name is None else sheet_name).alias("sheet_name"), row_no.cast("int").alias("row_no"), cells.alias("cells"))


def grid_from_text(texts: DataFrame, sheet_id: Column, text: Column, delimiter: str = ",", sheet_name: str = "Sheet", limit: int | None = None) -> DataFrame:
    """Delimited text without quoting: a row per line (empty lines kept), a cell per field; rows differ in length. `delimiter` is a regular expression.

    With a `limit`, a sheet of more lines than twice that has only its first `limit` non-blank lines (the first line, if all
    are blank), and usually no more than the text's head is taken apart for them.
    """
    named = texts.select(sheet_id.alias("sheet_id"), F.lit(sheet_name).alias("sheet_name"), text.alias("_text"))
    if limit is None:
        lines = named.select("sheet_id", "sheet_name", F.posexplode(F.split("_text", "\n", -1)).alias("row_no", "line"))
        return lines.select("sheet_id", "sheet_name", "row_no", F.split("line", delimiter, -1).alias("cells"))

    def non_blank(line: Column) -> Column:
        if re.fullmatch(r"[,;:|\t]", delimiter):
            return line.rlike(f"[^{WHITE_SPACE}{delimiter}]")
        return F.regexp_replace(line, delimiter, "").rlike(f"[^{WHITE_SPACE}]")

    def lines_of(part: Column) -> Column:
        return F.transform(F.split(part, "\n", -1), lambda line, i: F.struct(i.cast("int").alias("row_no"), line.alias("line")))

    def leading(part: Column) -> Column:
        return F.slice(F.filter(lines_of(part), lambda r: non_blank(r["line"])), 1, limit)

    # a text of few lines is its own head
    headed = named.withColumn("_head", F.substring_index("_text", "\n", 2 * limit))
    long = F.octet_length("_head") < F.octet_length("_text")
    some = headed.withColumn("_rows", F.when(long, leading(F.col("_head"))).otherwise(lines_of(F.col("_text"))))
    whole = some.withColumn("_rows", F.when(long & (F.size("_rows") < limit), leading(F.col("_text"))).otherwise(F.col("_rows")))
    lines = whole.select("sheet_id", "sheet_name", F.inline(F.when(F.size("_rows") == 0, F.slice(lines_of(F.col("_head")), 1, 1)).otherwise(F.col("_rows"))))
    return lines.select("sheet_id", "sheet_name", "row_no", F.split("line", delimiter, -1).alias("cells"))


@once
def is_empty_row() -> Column:
    """Whether the row's cells are all blank (or it has none)."""
    return ~F.coalesce(F.exists("cells", lambda c: ~is_blank(c)), F.lit(False))


def drop_blank_rows(grid: DataFrame) -> DataFrame:
    return grid.where(~is_empty_row())


def kept_rows(grid: DataFrame, limit: int | None = None) -> DataFrame:
    """The first `limit` non-blank rows of each sheet, with their place among the non-blank rows (`row_idx`, from 0).

    The filter stands on the bare row number, so that each task passes on no more than the limit of any sheet.
    """
    order = Window.partitionBy("sheet_id").orderBy("row_no")
    numbered = drop_blank_rows(grid).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= (limit or prefix()))
    return numbered.withColumn("row_idx", F.col("_rn") - 1).drop("_rn")


def kept_rows_or_one(grid: DataFrame, limit: int | None = None) -> DataFrame:
    """`kept_rows`, and one row (`row_idx` null) of each sheet that has none, in the same single shuffle."""
    number, leading, one, index = _numbered(limit or prefix())
    numbered = grid.withColumn("_blank", is_empty_row()).withColumn("_rn", number).where(leading).where(one)
    return numbered.withColumn("row_idx", index).drop("_rn", "_blank")


@once
def _numbered(limit: int) -> tuple[Column, ...]:
    number, blank = F.col("_rn"), F.col("_blank")
    order = Window.partitionBy("sheet_id").orderBy("_blank", "row_no")
    return F.row_number().over(order), number <= limit, ~blank | (number == 1), F.when(~blank, number - 1)
