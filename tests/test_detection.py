import random
import time

import pytest
from pyspark.sql import functions as F

from gridhead.operators.grid import drop_blank_rows, grid_from_cells, grid_from_columns, grid_from_text, kept_rows
from gridhead.operators.headers import best_header_rows, preview_long
from gridhead.operators.scoring import row_scores
from gridhead.plans import fixtures
from gridhead.plans.detection import EMPTY, NOT_FOUND, best_headers, detect_headers, scored_rows
from tests.conftest import SF

GRID = "sheet_id string, sheet_name string, row_no int, cells array<string>"
N = None
B1 = [["Sales Report", N, N], ["Name", "Qty", "Date"], ["Ann", "3", "01/02/2024"], ["Bob", "4", "02/02/2024"]]

# id: (rows, score of each kept row, index and confidence of the header)
GOLDEN = {
    "b1": (B1, [0, 95, 14, 4], (1, 95)),
    "b2": ([B1[0], [" ", N, "\t"], *B1[1:]], [0, 95, 14, 4], (1, 95)),
    "b3": ([[f"a{i}", f"b{i}"] for i in range(7)], [115, 115, 105, 95, 85, 75, 65], (0, 100)),
    "b4": ([["Name", " Name", "Qty", "Price", "Date"], ["a", "b", "1", "2", "3"]], [105, 6], (0, 100)),
    "b5": ([["1", "2"], ["3", "4"]], [4, -6], (0, 4)),
    "b5b": ([["1", "2"]], [-6], NOT_FOUND),
    "b6": ([["a"], ["b"]], [0, 0], NOT_FOUND),
    "b7": ([[" ", N]], [], EMPTY),
    "b8": ([["note"]] * 30 + [["Name", "Qty"], ["Ann", "1"]], [0] * 30 + [75, 12], NOT_FOUND),
    "b8b": ([["note"]] * 29 + [["Name", "Qty"], ["Ann", "1"]], [0] * 29 + [75, 12], (29, 75)),
    "b9": ([["1e5", "x"]], [57], (0, 57)),
    "b10": ([["a", "A", "b"]], [35], (0, 35)),
    "b11": ([["a", "b", "c", "1", "2"]], [59], (0, 59)),
    "b11b": ([["a", "b", "1", "2"]], [14], (0, 14)),
    "b12": ([["x" * 40, "b"]], [65], (0, 65)),
    "b12b": ([["x" * 41, "b"]], [55], (0, 55)),
    "b13": ([["a", "b", "c", "d", "e"], ["x", "y", N, N, N]], [95, 65], (0, 95)),
    "b13b": ([["a", "b", "c", "d", "e"], ["x", "y", "z", N, N]], [105, 75], (0, 100)),
    "b14": ([["Name", "Qty"], ["Ann"], ["Bob", N]], [65, 0, 0], (0, 65)),
    "b15": ([["日付", "数量"]], [10], (0, 10)),
    "b16": ([["2024-01-02 00:00:00", "x"]], [20], (0, 20)),
    "b16b": ([["2024-01-02", "x"]], [12], (0, 12)),
    "b17": ([["  Unit \n Price ", N, "Qty"]], [65], (0, 65)),
    "nocells": ([N], [], EMPTY),
}


def grid(spark, sheets=GOLDEN):
    return spark.createDataFrame([(k, "S", i, r) for k, v in sheets.items() for i, r in enumerate(v[0])], GRID).repartition(3)


def test_golden_scores(spark):
    got = {}
    for r in row_scores(kept_rows(grid(spark))).orderBy("sheet_id", "row_idx").collect():
        got.setdefault(r.sheet_id, []).append(r.score)
    assert got == {k: v[1] for k, v in GOLDEN.items() if v[1]}


def test_golden_results(spark):
    for r in detect_headers(grid(spark)).collect():
        want = GOLDEN[r.sheet_id][2]
        got = (r.data.header_row_index, r.data.confidence_score) if r.success else r.message
        assert got == want, r.sheet_id
        assert (r.data is None) == (not r.success)
        if r.success:
            assert r.data.header_row_number == r.data.header_row_index + 1


def test_details(spark):
    data = {r.sheet_id: r.data for r in detect_headers(grid(spark)).collect()}
    assert [tuple(h) for h in data["b17"].headers] == [("Unit Price", 0, "A"), ("Qty", 2, "C")]
    assert data["b2"].sheet_row_no == 2 and data["b2"].header_row_number == 2
    assert data["b4"].preview_rows == [{"Name": "b", "Qty": "1", "Price": "2", "Date": "3"}]
    assert data["b14"].preview_rows == [{"Name": "Ann", "Qty": ""}, {"Name": "Bob", "Qty": None}]
    assert [h.name for h in data["b4"].headers] == ["Name", "Name", "Qty", "Price", "Date"]
    long = {(r.preview_no, r.name): r.value for r in preview_long(scored_rows(grid(spark))).where("sheet_id = 'b1'").collect()}
    assert long == {(1, "Name"): "Ann", (1, "Qty"): "3", (1, "Date"): "01/02/2024", (2, "Name"): "Bob", (2, "Qty"): "4", (2, "Date"): "02/02/2024"}


def test_parameters_move_the_prefix(spark):
    assert best_headers(grid(spark), max_rows=31).where("sheet_id = 'b8'").first().header_row_index == 30
    assert best_headers(grid(spark), lookahead=0).where("sheet_id = 'b3'").first().confidence_score == 65


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_one_shuffle_and_a_partial_limit(spark):
    landed = f"{SF}/../sf0.001"
    rows = spark.read.parquet(f"{landed}/lineitem.parquet").select(F.col("l_orderkey").alias("sheet_id"), F.lit("S").alias("sheet_name"), "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("cells")).withColumnRenamed("l_linenumber", "row_no")
    for f in (best_headers, detect_headers):
        n, plan = exchanges(f(rows))
        assert n == 1, plan
        limits = [line for line in plan.split("\n") if "WindowGroupLimit" in line]
        assert any("Partial" in x for x in limits), plan
        assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def _best(df):
    return {r.sheet_id: tuple(r)[2:5] for r in best_headers(df).collect()}


def test_what_changes_nothing(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Name", "Qty", "3", "1/2/24", "x y", "", None, "4.5", "a" * 45])
    sheets = {f"s{i}": ([[word() for _ in range(4)] for _ in range(rng.randrange(1, 45))],) for i in range(25)}
    base = _best(grid(spark, sheets))
    kept = {k: [r for r in v[0] if any(c and c.strip() for c in r)] for k, v in sheets.items()}
    assert _best(grid(spark, {k: (v[:35] + [["zz", "yy", "xx", "ww"]] * (len(v) > 35),) for k, v in kept.items()})) == base
    assert _best(grid(spark, {k: ([x for r in v[0] for x in (r, [" ", None])],) for k, v in sheets.items()})) == base
    assert _best(grid(spark, {k: ([[c and c.upper() for c in r] for r in v[0]],) for k, v in sheets.items()})) == base
    assert _best(grid(spark, {k: ([[*r, None, ""] for r in v[0]],) for k, v in sheets.items()})) == base


def test_grid_from_cells_is_rectangular(spark):
    cells = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 2, "z"), ("a", 5, 1, "y"), ("b", 1, 0, "q")], "sheet_id string, row_no int, col_no int, value string")
    got = {(r.sheet_id, r.row_no): r.cells for r in grid_from_cells(cells).collect()}
    assert got == {("a", 0): ["x", None, "z"], ("a", 5): [None, "y", None], ("b", 1): ["q"]}
    twice = cells.unionByName(spark.createDataFrame([("a", 0, 0, "w"), ("a", 0, 0, None), ("a", 5, 1, "z")], cells.schema))
    got = {(r.sheet_id, r.row_no): r.cells for r in grid_from_cells(twice).collect()}
    assert got == {("a", 0): ["x", None, "z"], ("a", 5): [None, "z", None], ("b", 1): ["q"]}


def test_wide_rows_take_linear_time(spark):
    """35 rows of 16,384 cells, with gaps."""
    cells = spark.range(35 * 16_384).select(F.lit("w").alias("sheet_id"), (F.col("id") / 16_384).cast("int").alias("row_no"), (F.col("id") % 16_384).cast("int").alias("col_no"), F.col("id").cast("string").alias("value")).where("col_no % 3 <> 1")
    grid_from_cells(cells.where("row_no = 0")).collect()
    began = time.time()
    rows = grid_from_cells(cells).where(F.size("cells") == 16_384).select("row_no", "cells").collect()
    assert time.time() - began < 8  # a map look-up for every place took over 40 s
    assert len(rows) == 35 and all(r.cells[c] == (None if c % 3 == 1 else str(r.row_no * 16_384 + c)) for r in rows for c in range(0, 16_384, 97))


def shuffled_rows(df):
    """Rows that all shuffles of the plan wrote."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ReusedExchangeExec":
            return 0
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_tall_sheet_of_cells_moves_its_leading_rows_only(spark):
    cells = spark.range(0, 1_000_000, 1, 8).select(F.lit("tall").alias("sheet_id"), F.pmod(F.col("id") * 7919, F.lit(250_000)).cast("int").alias("row_no"), (F.col("id") / 250_000).cast("int").alias("col_no"), F.when(F.col("id") % 1000 == 1, " ").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("value"))
    limited = best_headers(grid_from_cells(cells, 35))
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert any("WindowGroupLimit" in x and "dense_rank" in x and "Partial" in x for x in plan.split("\n")), plan
    assert shuffled_rows(limited) < 15_000  # 8 tasks pass on 35 rows of 4 cells each, and the cells of white space once
    assert shuffled_rows(grid_from_cells(cells)) > 250_000


def test_limited_cells_give_the_same_headers(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["Name", "Qty", "3", "1/2/24", " ", "\t", "", None, "4.5"])
    sheets = {f"s{i}": ([[word() if rng.random() < 0.5 else None for _ in range(5)] for _ in range(rng.randrange(1, 90))],) for i in range(40)}
    cells = grid(spark, sheets).select("sheet_id", "sheet_name", "row_no", F.posexplode("cells").alias("col_no", "value"))
    for given in (cells, cells.where("value IS NOT NULL")):
        whole = {r.sheet_id: r for r in detect_headers(grid_from_cells(given)).collect()}
        some = {r.sheet_id: r for r in detect_headers(grid_from_cells(given, 35)).collect()}
        assert {k: v for k, v in whole.items() if v.message != EMPTY} == some


def test_leading_lines_of_texts(spark):
    rng = random.Random(13)
    texts = ["", " ", "\n\n", None, "a,b\n1,2", *("\n".join(rng.choice(["", " , ,", "a,b", "x", ",,", "\u3000"]) for _ in range(rng.randrange(200))) for _ in range(60)), "\n" * 500 + "a,b\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = detect_headers(grid_from_text(df, F.col("i"), F.col("t")))
    some = detect_headers(grid_from_text(df, F.col("i"), F.col("t"), limit=35))
    assert sorted(whole.collect(), key=lambda r: r.sheet_id) == sorted(some.collect(), key=lambda r: r.sheet_id) and some.count() == len(texts) - 1


def test_a_long_text_is_not_taken_apart(spark):
    """Of a million lines 35 are made rows; what is left of the text costs no more than its bytes."""
    df = spark.createDataFrame([(1, "a,b\n" * 1_000_000)], "i int, t string")
    rows = grid_from_text(df, F.col("i"), F.col("t"), limit=35)
    assert rows.count() == 35
    began = time.time()
    assert rows.where("row_no = 34").count() == 1 and time.time() - began < 3


def test_cells_in_headers_out(spark):
    cells = grid(spark).select("sheet_id", "sheet_name", "row_no", F.posexplode("cells").alias("col_no", "value")).where("value IS NOT NULL")
    got = {r.sheet_id: r for r in detect_headers(grid_from_cells(cells)).collect()}
    for r in detect_headers(grid(spark)).collect():
        if r.message not in (EMPTY, NOT_FOUND):
            assert got[r.sheet_id].data.headers == r.data.headers and got[r.sheet_id].data.confidence_score == r.data.confidence_score
            assert got[r.sheet_id].data.sheet_name == "S"


def test_grid_from_columns(spark):
    table = spark.createDataFrame([(1, 0, True, 0.5, "t"), (1, 1, None, None, None)], "s int, r int, b boolean, d double, t string")
    rows = grid_from_columns(table, F.col("s"), F.col("r"), ["b", "d", "t"]).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["True", "0.5", "t"], [None, None, None]]
    assert drop_blank_rows(grid_from_columns(table, F.col("s"), F.col("r"), ["b", "d", "t"])).count() == 1


def test_empty_grid(spark):
    none = spark.createDataFrame([], GRID)
    assert best_headers(none).isEmpty() and detect_headers(none).isEmpty()


def test_no_header_is_null(spark):
    r = best_header_rows(row_scores(kept_rows(grid(spark)))).where("sheet_id = 'b6'").first()
    assert (r.header_row_index, r.header_row_number, r.confidence_score, r.sheet_row_no) == (None,) * 4


@pytest.mark.parametrize("nation", [24, 23])
def test_ledger_caps(spark, nation):
    r = best_headers(fixtures.ledger_sheets(spark, SF)).where(F.col("sheet_id") == nation).first()
    assert r is None or r.header_row_index == (29 if nation == 23 else None)


def test_what_a_task_sorts_does_not_grow_with_the_table(spark, monkeypatch):
    """A larger table has more tasks, not larger ones, and the sheets' windows run where its rows were dealt."""
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 500)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = best_headers(fixtures.order_sheets(spark, SF))
    n, plan = exchanges(found)
    assert n == 1, plan
    assert found.rdd.getNumPartitions() == -(-rows // 500)
