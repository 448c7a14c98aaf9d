"""Whole detections: sheets in, results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhead.functions.once import once
from gridhead.functions.text import LONG
from gridhead.operators.grid import LOOKAHEAD, MAX_ROWS, PREVIEW, kept_rows, kept_rows_or_one, prefix
from gridhead.operators.headers import best_header_rows, preview_value, sheets
from gridhead.operators.scoring import row_scores

# The messages of a detection.
DETECTED = "Headers detected successfully"
EMPTY = "Excel sheet is empty"
NOT_FOUND = "Could not detect header row"


def best_headers(grid: DataFrame, max_rows: int = MAX_ROWS, lookahead: int = LOOKAHEAD, longest: int = LONG) -> DataFrame:
    """The header row of every sheet that has a non-blank row; one shuffle, of at most `prefix` rows a sheet and task."""
    return best_header_rows(row_scores(kept_rows(grid, prefix(max_rows, lookahead, 0)), lookahead, longest), max_rows)


def scored_rows(grid: DataFrame, max_rows: int = MAX_ROWS, lookahead: int = LOOKAHEAD, preview: int = PREVIEW, longest: int = LONG) -> DataFrame:
    """The rows of every sheet that can matter, with their scores."""
    return row_scores(kept_rows(grid, prefix(max_rows, lookahead, preview)), lookahead, longest)


def found_sheets(grid: DataFrame, max_rows: int = MAX_ROWS, lookahead: int = LOOKAHEAD, preview: int = PREVIEW, longest: int = LONG, carried: Sequence[str] = ()) -> DataFrame:
    """`headers.sheets` of every sheet of the grid, empty ones too."""
    return sheets(row_scores(kept_rows_or_one(grid, prefix(max_rows, lookahead, preview)), lookahead, longest), max_rows, preview, carried)


def status() -> Column:
    """The message for a record of `found_sheets`."""
    return F.when(F.col("n_rows") == 0, EMPTY).when(F.col("header_row_index").isNull(), NOT_FOUND).otherwise(DETECTED)


def detect_headers(grid: DataFrame, max_rows: int = MAX_ROWS, lookahead: int = LOOKAHEAD, preview: int = PREVIEW, longest: int = LONG, error: str | None = None) -> DataFrame:
    """`sheet_id, success, message, data`: one record per sheet, nested as the result of a single detection.

    `data` is null where nothing was detected. Preview values are the cells' raw texts, keyed by header name; of equal
    names the last column counts. If the grid has a column `error`, a text in it is the message of its sheet.
    """
    message, told = _told(error)
    return found_sheets(grid, max_rows, lookahead, preview, longest, [error] if error else []).withColumn("message", message).select(*told)


@once
def _told(error: str | None) -> tuple[Column, list[Column | str]]:
    rows = F.transform("below", lambda r: F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"], preview_value(r["cells"], c["place"])))))
    data = F.struct("sheet_name", "header_row_index", "header_row_number", "confidence_score", "sheet_row_no", "headers", rows.alias("preview_rows"))
    success = F.col("message") == DETECTED
    message = status() if error is None else F.coalesce(F.col(error), status())
    return message, ["sheet_id", success.alias("success"), "message", F.when(success, data).alias("data")]
