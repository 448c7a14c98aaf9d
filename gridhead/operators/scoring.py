"""Row profiles and scores. All measures are narrow expressions on `cells`; only the look-ahead needs the sheet's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhead.functions.once import once
from gridhead.functions.text import LONG, folded, has_alphabet, is_date_like, is_number_like, is_very_long, normalize_cell
from gridhead.operators.grid import LOOKAHEAD

#: Points of the rules.
TEXT_POINTS, NUMBER_POINTS, DATE_POINTS, LONG_POINTS = 10, -8, -8, -10
UNIQUE_POINTS, REPEATED_POINTS = 20, -20
WORDY_POINTS, TERSE_POINTS = 25, -10
BELOW_POINTS = 10


def non_empty_cells(cells: Column | str = "cells") -> Column:
    """The cells' normalized texts, in order, without the empty ones."""
    return F.filter(F.transform(cells, normalize_cell), lambda c: c != "")


def row_profile(rows: DataFrame, longest: int = LONG) -> DataFrame:
    """Adds the number of cells: not empty, with letters, numbers, dates (these three overlap), different, and very long."""

    cells, measures = _measures(longest)
    return rows.withColumn("_cells", cells).withColumns(measures).drop("_cells")


@once
def _measures(longest: int) -> tuple[Column, dict[str, Column]]:
    def count(test) -> Column:  # noqa: ANN001
        return F.size(F.filter("_cells", test))

    return F.coalesce(non_empty_cells(), F.array().cast("array<string>")), {
        "n_nonempty": F.size("_cells"),
        "n_text": count(has_alphabet),
        "n_number": count(is_number_like),
        "n_date": count(is_date_like),
        "n_unique": F.size(F.array_distinct(F.transform("_cells", folded))),
        "n_long": count(lambda c: is_very_long(c, longest)),
    }


@once
def static_score() -> Column:
    """The rules that look at the row alone; ratios are compared as integers."""
    n, text, unique = F.col("n_nonempty"), F.col("n_text"), F.col("n_unique")
    score = TEXT_POINTS * text + NUMBER_POINTS * F.col("n_number") + DATE_POINTS * F.col("n_date") + LONG_POINTS * F.col("n_long")
    score += F.when(5 * unique >= 4 * n, UNIQUE_POINTS).otherwise(REPEATED_POINTS)
    return score + F.when(5 * text >= 3 * n, WORDY_POINTS).otherwise(TERSE_POINTS)


def enough_cells(score: Column) -> Column:
    """Rows with fewer than two cells have no score at all."""
    return F.when(F.col("n_nonempty") < 2, 0).otherwise(score)


def rows_below(profiled: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Adds `rows_below`: how many of the next rows have at least two cells and at least half as many as this one."""
    following, useful = _following(lookahead)
    return profiled.withColumns(following).withColumn("rows_below", useful).drop(*following)


@once
def _following(lookahead: int) -> tuple[dict[str, Column], Column]:
    order = Window.partitionBy("sheet_id").orderBy("row_idx")
    following = {f"_next{j}": F.lead("n_nonempty", j).over(order) for j in range(1, lookahead + 1)}
    useful = [F.when((F.col(c) >= 2) & (2 * F.col(c) >= F.col("n_nonempty")), 1).otherwise(0) for c in following]
    return following, sum(useful, F.lit(0))


def row_scores(kept: DataFrame, lookahead: int = LOOKAHEAD, longest: int = LONG) -> DataFrame:
    """`kept_rows` with profile, `rows_below` and `score`."""
    return rows_below(row_profile(kept, longest), lookahead).withColumn("score", _score())


@once
def _score() -> Column:
    return enough_cells(static_score() + BELOW_POINTS * F.col("rows_below"))
