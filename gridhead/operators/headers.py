"""The best row of each sheet, its headers, and the preview of the rows below it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhead.functions.once import once
from gridhead.functions.text import excel_column_name, normalize_cell
from gridhead.operators.grid import MAX_ROWS, PREVIEW

HEADERS = "array<struct<name:string,column_index:int,excel_column_name:string>>"


def _code(score: Column, row_idx: Column, max_rows: int) -> Column:
    """One number whose maximum is the highest score and, among ties, the first row (plain numbers aggregate by hash)."""
    return score * max_rows + (max_rows - 1 - row_idx)


def _decoded(code: Column, max_rows: int) -> tuple[Column, Column]:
    return F.floor(code / max_rows).cast("int"), (max_rows - 1 - F.pmod(code, F.lit(max_rows))).cast("int")


def confidence(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), score))


def best_header_rows(scored: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One record per sheet of `row_scores`: the first of the best rows, or nulls where no row has a positive score.

    `header_row_index` and `header_row_number` count non-blank rows (from 0 and 1); `sheet_row_no` is the row's true place.
    """
    code = _code(F.col("score"), F.col("row_idx"), max_rows)
    best = scored.where(F.col("row_idx") < max_rows).groupBy("sheet_id", "sheet_name").agg(F.max(code).alias("code"), F.max_by("row_no", code).alias("row_no"))
    score, index = _decoded(F.col("code"), max_rows)
    found = score > 0
    return best.select(
        "sheet_id",
        "sheet_name",
        F.when(found, index).alias("header_row_index"),
        F.when(found, index + 1).alias("header_row_number"),
        F.when(found, confidence(score)).alias("confidence_score"),
        F.when(found, F.col("row_no")).alias("sheet_row_no"),
    )


def headers_of(cells: Column) -> Column:
    """The named columns of a header row: name, place from 0 (gaps kept), letters. Repeated names stay."""
    every = F.transform(cells, lambda c, i: F.struct(normalize_cell(c).alias("name"), i.cast("int").alias("column_index"), excel_column_name(i + 1).alias("excel_column_name")))
    return F.filter(every, lambda h: h["name"] != "")


def preview_columns(ordered: Column) -> Column:
    """Array of (first place, name, place): each name once, in the order of first places, with the last column of that name.

    `ordered` is a column of the header structs sorted by name and place (`by_name`), so that this stays cheap for very wide rows.
    """
    first = F.filter(ordered, lambda h, i: (i == 0) | (F.get(ordered, i - 1)["name"] != h["name"]))
    last = F.filter(ordered, lambda h, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["name"] != h["name"]))
    return F.sort_array(F.zip_with(first, last, lambda a, b: F.struct(a["place"].alias("first"), a["name"].alias("name"), b["place"].alias("place"))))


def by_name(headers: Column) -> Column:
    """The headers as (name, place), sorted."""
    return F.sort_array(F.transform(headers, lambda h: F.struct(h["name"].alias("name"), h["column_index"].alias("place"))))


def preview_value(cells: Column, place: Column) -> Column:
    """The raw cell; the empty text where the row is too short."""
    return F.when(place < F.size(cells), F.get(cells, place)).otherwise("")


def with_header_index(scored: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of `row_scores` with their sheet's `header_row_index` (null where no row has a positive score).

    A maximum over the sheet as it is partitioned already, so nothing is shuffled or read again.
    """
    code = F.when(F.col("row_idx") < max_rows, _code(F.col("score"), F.col("row_idx"), max_rows))
    marked = scored.withColumn("_code", F.max(code).over(Window.partitionBy("sheet_id")))
    score, index = _decoded(F.col("_code"), max_rows)
    return marked.withColumn("header_row_index", F.when(score > 0, index)).drop("_code")


def header_rows(scored: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The header rows of the sheets of `row_scores` that have one, with their `cells`."""
    return with_header_index(scored, max_rows).where("row_idx = header_row_index")


def build_headers(rows: DataFrame) -> DataFrame:
    """One record per named column: `sheet_id, name, column_index, excel_column_name`."""
    return rows.select("sheet_id", F.explode(headers_of(F.col("cells"))).alias("h")).select("sheet_id", "h.*")


def preview_rows_by_join(kept: DataFrame, detected: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """The rows below each header: an equi-join by sheet with a range of rows; `preview_no` from 1."""
    found = detected.where("header_row_index IS NOT NULL").select("sheet_id", "header_row_index")
    near = kept.join(found, "sheet_id").where(F.col("row_idx").between(F.col("header_row_index") + 1, F.col("header_row_index") + preview))
    return near.select("sheet_id", (F.col("row_idx") - F.col("header_row_index")).alias("preview_no"), "row_no", "cells")


def sheets(scored: DataFrame, max_rows: int = MAX_ROWS, preview: int = PREVIEW, carried: Sequence[str] = ()) -> DataFrame:
    """One record per sheet with everything found: nested `headers`, `columns` (see `preview_columns`) and `below` (the rows under the header).

    `scored` has at most `prefix()` rows of a sheet, so the collected rows are bounded. Sheets whose only row has no
    `row_idx` are empty (`n_rows` 0). Of the columns `carried`, the greatest value of the sheet's rows goes along.
    """
    whole, steps, told = _of_sheets(max_rows, preview, tuple(carried))
    found = scored.groupBy("sheet_id", "sheet_name").agg(*whole)
    for name, column in steps.items():
        found = found.withColumn(name, column)
    return found.select(*told)


@once
def _of_sheets(max_rows: int, preview: int, carried: tuple[str, ...]) -> tuple[list[Column], dict[str, Column], list[Column | str]]:
    row = F.struct("row_idx", "row_no", "score", "cells")
    listed = F.sort_array(F.collect_list(F.when(F.col("row_idx").isNotNull(), row)))
    codes = F.transform(F.filter("rows", lambda r: r["row_idx"] < max_rows), lambda r: _code(r["score"], r["row_idx"], max_rows))
    score, index = _decoded(F.col("_code"), max_rows)
    steps = {
        "n_rows": F.size("rows"),
        "_code": F.array_max(codes),
        "_index": F.when(score > 0, index),
        "_header": F.get("rows", F.col("_index")),
        "headers": headers_of(F.col("_header.cells")),
        "_ordered": by_name(F.col("headers")),
    }
    told = [
        "sheet_id",
        "sheet_name",
        "n_rows",
        F.col("_index").alias("header_row_index"),
        (F.col("_index") + 1).alias("header_row_number"),
        F.when(F.col("_index").isNotNull(), confidence(score)).alias("confidence_score"),
        F.col("_header.row_no").alias("sheet_row_no"),
        "headers",
        preview_columns(F.col("_ordered")).alias("columns"),
        F.when(F.col("_index").isNotNull(), F.slice("rows", F.col("_index") + 2, preview)).alias("below"),
        *carried,
    ]
    return [listed.alias("rows"), *(F.max(c).alias(c) for c in carried)], steps, told


def preview_long(scored: DataFrame, max_rows: int = MAX_ROWS, preview: int = PREVIEW) -> DataFrame:
    """One record per preview cell of the sheets of `row_scores`: `sheet_id, preview_no, name, value`.

    The header row alone works out its columns; the rows below it take them over a window of the same partitioning.
    """
    index = F.col("header_row_index")
    near = with_header_index(scored, max_rows).where(F.col("row_idx").between(index, index + preview))
    # a column of its own, as it is read for every element
    named = near.withColumn("_ordered", F.when(F.col("row_idx") == index, by_name(headers_of(F.col("cells")))))
    order = Window.partitionBy("sheet_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = F.last(preview_columns(F.col("_ordered")), ignorenulls=True).over(order)
    below = named.withColumn("_columns", columns).where(F.col("row_idx") > index)
    cells = below.select("sheet_id", (F.col("row_idx") - index).alias("preview_no"), "cells", F.explode("_columns").alias("c"))
    return cells.select("sheet_id", "preview_no", F.col("c.name").alias("name"), preview_value(F.col("cells"), F.col("c.place")).alias("value"))
