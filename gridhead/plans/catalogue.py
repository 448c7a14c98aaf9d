"""Registered queries over the test tables, and the SQL they are checked against.

The SQL is written from the rules in another shape (cells as records, joins instead of windows), so that a
mistake is not made twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhead.functions.text import DATE, LETTER, NUMBER, WHITE_SPACE, excel_column_name, has_alphabet, is_blank, is_date_like, is_number_like, is_very_long, normalize_cell, normalize_header_name
from gridhead.operators.grid import grid_from_cells, grid_from_columns, kept_rows, prefix
from gridhead.operators.headers import best_header_rows, build_headers, header_rows, preview_long, preview_rows_by_join
from gridhead.operators.scoring import enough_cells, row_profile, row_scores, rows_below, static_score
from gridhead.plans import fixtures
from gridhead.plans.detection import best_headers, detect_headers, scored_rows
from gridhead.sources.files import answer_directory, answered, answers, file_gate, write_results
from gridhead.sources.shared import shared_path
from gridhead.sources.workbooks import register
from gridhead.streaming.landing import drain, stream_detect

QUERIES: dict = {}
ORACLES: dict = {}

_PROFILE = ("n_nonempty", "n_text", "n_number", "n_date", "n_unique", "n_long")
_BEST = ("sheet_id", "header_row_index", "header_row_number", "confidence_score", "sheet_row_no")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the SQL's building blocks ---


def _norm(x: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace({x}, '[{WHITE_SPACE}]+', ' ', 'g'), '^ | $', '', 'g'), '')"


_NUMBER_TEXT = "CAST(CAST({} AS DECIMAL(12,2)) AS VARCHAR)".format

_ORDERS = f"""
    l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(fixtures.LINE_ORDER)}) - 1 AS k FROM lineitem),
    g AS (SELECT l_orderkey AS sheet_id, k + 3 AS row_no, [CAST(k AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), {_NUMBER_TEXT("l_quantity")}, {_NUMBER_TEXT("l_extendedprice")}, strftime(l_shipdate, '%d/%m/%Y'), l_returnflag] AS cells FROM l
          UNION ALL SELECT DISTINCT l_orderkey, 0, ['Order ' || l_orderkey, NULL, NULL, NULL, NULL, NULL, NULL] FROM lineitem
          UNION ALL SELECT DISTINCT l_orderkey, 1, ['  ', NULL, chr(9), NULL, NULL, NULL, NULL] FROM lineitem
          UNION ALL SELECT DISTINCT l_orderkey, 2, {list(fixtures.ORDER_HEADER)} FROM lineitem)"""

_LEDGER = f"""
    t AS (SELECT c_nationkey AS sheet_id, CASE c_nationkey WHEN 24 THEN 31 WHEN 23 THEN 29 ELSE c_nationkey % 5 END AS notes FROM customer GROUP BY 1),
    g AS (SELECT c_nationkey AS sheet_id, 2 * notes + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_no, [CAST(c_custkey AS VARCHAR), c_name, lower(c_mktsegment), {_NUMBER_TEXT("c_acctbal")}, c_mktsegment] AS cells FROM customer JOIN t ON c_nationkey = sheet_id
          UNION ALL SELECT sheet_id, 2 * i, ['note ' || i, NULL, NULL, NULL, NULL] FROM t, range(31) r(i) WHERE i < notes
          UNION ALL SELECT sheet_id, 2 * i + 1, [NULL, NULL, NULL, NULL, NULL] FROM t, range(31) r(i) WHERE i < notes
          UNION ALL SELECT sheet_id, 2 * notes, {list(fixtures.LEDGER_HEADER)} FROM t)"""

_DOCS = """
    d AS (SELECT doc_id AS sheet_id, string_split(text, chr(10)) AS lines FROM documents),
    g AS (SELECT sheet_id, generate_subscripts(lines, 1) - 1 AS row_no, string_split(unnest(lines), ',') AS cells FROM d)"""

_CUSTOMERS = f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    g AS (SELECT o_custkey AS sheet_id, k + 1 AS row_no, [CAST(o_orderkey AS VARCHAR), o_orderstatus, {_NUMBER_TEXT("o_totalprice")}, strftime(o_orderdate, '%d/%m/%Y')] AS cells FROM o
          UNION ALL SELECT DISTINCT o_custkey, 0, ['Orders of ' || o_custkey, NULL, NULL, NULL] FROM orders
          UNION ALL SELECT DISTINCT o_custkey, 1, {list(fixtures.CUSTOMER_HEADER)} FROM orders)"""

_CELLS = f"""
    c AS (SELECT sheet_id, row_no, len(cells) AS width, generate_subscripts(cells, 1) - 1 AS col_no, unnest(cells) AS raw FROM g),
    n AS (SELECT *, {_norm("raw")} AS v FROM c)"""

# rows before are counted, not numbered: DuckDB misplaces a limit on the row numbers of a materialized part
_KEPT = """
    b AS (SELECT DISTINCT sheet_id, row_no FROM n WHERE v <> ''),
    kept AS (SELECT *, count(*) OVER (PARTITION BY sheet_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS row_idx FROM b)"""

_PROFILED = f"""
    p AS (SELECT sheet_id, row_no, row_idx, count(*) AS n_nonempty,
                 count(*) FILTER (regexp_matches(v, '{LETTER}')) AS n_text, count(*) FILTER (regexp_matches(v, '{NUMBER}')) AS n_number,
                 count(*) FILTER (regexp_matches(v, '{DATE}')) AS n_date, count(DISTINCT lower(v)) AS n_unique, count(*) FILTER (length(v) > 40) AS n_long
          FROM n JOIN kept USING (sheet_id, row_no) WHERE v <> '' GROUP BY ALL)"""

_STATIC = """10 * n_text - 8 * n_number - 8 * n_date - 10 * n_long + CASE WHEN n_unique / n_nonempty >= 0.8 THEN 20 ELSE -20 END
    + CASE WHEN n_text / n_nonempty >= 0.6 THEN 25 ELSE -10 END"""

_SCORED = f"""
    w AS (SELECT a.sheet_id, a.row_idx, count(z.row_idx) AS rows_below
          FROM p a LEFT JOIN p z ON a.sheet_id = z.sheet_id AND z.row_idx BETWEEN a.row_idx + 1 AND a.row_idx + 5 AND z.n_nonempty >= greatest(2, a.n_nonempty * 0.5) GROUP BY ALL),
    s AS (SELECT p.*, rows_below, CASE WHEN n_nonempty < 2 THEN 0 ELSE {_STATIC} + 10 * rows_below END AS score FROM p JOIN w USING (sheet_id, row_idx))"""

_FOUND = """
    x AS (SELECT sheet_id, max(score) AS best FROM s WHERE row_idx < 30 GROUP BY 1),
    h AS (SELECT sheet_id, best, min(row_idx) AS header_row_index FROM x JOIN s USING (sheet_id) WHERE best > 0 AND score = best AND row_idx < 30 GROUP BY 1, 2),
    f AS (SELECT x.sheet_id, header_row_index, header_row_index + 1 AS header_row_number, CASE WHEN best > 0 THEN least(100, h.best) END AS confidence_score,
                 kept.row_no AS sheet_row_no FROM (SELECT sheet_id FROM x) x LEFT JOIN h USING (sheet_id) LEFT JOIN kept ON kept.sheet_id = h.sheet_id AND kept.row_idx = h.header_row_index)"""

_HEADERS = """
    hd AS (SELECT n.sheet_id, v AS name, col_no AS column_index FROM f JOIN n ON f.sheet_id = n.sheet_id AND f.sheet_row_no = n.row_no WHERE v <> '')"""

_PREVIEW = """
    pr AS (SELECT kept.sheet_id, kept.row_no, kept.row_idx - header_row_index AS preview_no FROM f JOIN kept ON f.sheet_id = kept.sheet_id AND kept.row_idx BETWEEN header_row_index + 1 AND header_row_index + 5),
    pc AS (SELECT sheet_id, name, max(column_index) AS col_no FROM hd GROUP BY 1, 2),
    pv AS (SELECT pr.sheet_id, preview_no, name, CASE WHEN c.width IS NULL THEN '' ELSE c.raw END AS value
           FROM pr JOIN pc USING (sheet_id) LEFT JOIN c ON c.sheet_id = pr.sheet_id AND c.row_no = pr.row_no AND c.col_no = pc.col_no)"""

_UP_TO_BEST = ", ".join((_CELLS, _KEPT, _PROFILED, _SCORED, _FOUND))


def _letters(i: str) -> str:
    """The letters of the 1-based column `i`, by repeated division."""
    low = f"(({i}) - 1)"
    return f"""CASE WHEN {low} >= 702 THEN chr(CAST(65 + ({low} - 702) // 676 AS INT)) ELSE '' END || CASE WHEN {low} >= 26 THEN chr(CAST(65 + (({low} - 26) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + {low} % 26 AS INT))"""


def _with(*parts: str, then: str) -> str:
    """Each part is worked out once, however often it is read."""
    return f"WITH {re.sub(r'(?m)^( *\w+) AS [(]', r'\1 AS MATERIALIZED (', ', '.join(parts))} {then}"


# --- queries ---


@_query(_with(_DOCS, _CELLS, then=f"SELECT sheet_id, row_no, col_no, v AS text, {_norm('v')} AS name FROM n"))
def normalize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.doc_sheets(spark, sf_dir).select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "raw"))
    text = normalize_cell(F.col("raw"))
    return cells.select("sheet_id", "row_no", "col_no", text.alias("text"), normalize_header_name(text).alias("name"))


def _classified(rows: DataFrame) -> DataFrame:
    cells = rows.select("sheet_name", "sheet_id", "row_no", F.posexplode("cells").alias("col_no", "raw")).withColumn("v", normalize_cell(F.col("raw")))
    v = F.col("v")
    kinds = {"letters": has_alphabet(v), "number": is_number_like(v), "date": is_date_like(v), "long": is_very_long(v), "blank": is_blank(F.col("raw"))}
    return cells.select("sheet_name", "sheet_id", "row_no", "col_no", *(k.alias(name) for name, k in kinds.items()))


_CLASSIFIED = f"sheet_id, row_no, col_no, regexp_matches(v, '{LETTER}') AS letters, regexp_matches(v, '{NUMBER}') AS number, regexp_matches(v, '{DATE}') AS date, length(v) > 40 AS long, v = '' AS blank FROM n"


@_query(f"SELECT 'Doc' AS sheet_name, * FROM ({_with(_DOCS, _CELLS, then=f'SELECT {_CLASSIFIED}')}) UNION ALL SELECT 'Ledger', * FROM ({_with(_LEDGER, _CELLS, then=f'SELECT {_CLASSIFIED}')})")
def classify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(fixtures.doc_sheets(spark, sf_dir)).unionByName(_classified(fixtures.ledger_sheets(spark, sf_dir)))


@_query(f"SELECT p_partkey, p_partkey % 16384 + 1 AS column_number, {_letters('p_partkey % 16384 + 1')} AS letters FROM part")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_partkey") % 16384 + 1
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", number.alias("column_number"), excel_column_name(number).alias("letters"))


@_query(_with(_ORDERS, then="SELECT sheet_id, row_no, generate_subscripts(cells, 1) - 1 AS col_no, unnest(cells) AS value FROM g"))
def grid_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid_from_cells(fixtures.order_cells(spark, sf_dir))
    return rows.select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "value"))


@_query(_with(_LEDGER, _CELLS, _KEPT, then="SELECT sheet_id, row_no, row_idx FROM kept WHERE row_idx < 35"))
def kept_rows_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_rows(fixtures.ledger_sheets(spark, sf_dir)).select("sheet_id", "row_no", "row_idx")


@_query(_with(_ORDERS, _CELLS, _KEPT, _PROFILED, then=f"SELECT sheet_id, row_idx, {', '.join(_PROFILE)} FROM p WHERE row_idx < 35"))
def row_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_profile(kept_rows(fixtures.order_sheets(spark, sf_dir))).select("sheet_id", "row_idx", *_PROFILE)


@_query(_with(_DOCS, _CELLS, _KEPT, _PROFILED, then=f"SELECT sheet_id, row_idx, CASE WHEN n_nonempty < 2 THEN 0 ELSE {_STATIC} END AS static_score FROM p WHERE row_idx < 35"))
def static_score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = row_profile(kept_rows(fixtures.doc_sheets(spark, sf_dir, prefix())))
    return rows.select("sheet_id", "row_idx", enough_cells(static_score()).alias("static_score"))


@_query(_with(_LEDGER, _CELLS, _KEPT, _PROFILED, _SCORED, then="SELECT sheet_id, row_idx, rows_below FROM s WHERE row_idx < 30"))
def rows_below_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_below(row_profile(kept_rows(fixtures.ledger_sheets(spark, sf_dir))))
    return rows.where("row_idx < 30").select("sheet_id", "row_idx", "rows_below")


@_query(_with(_ORDERS, _CELLS, _KEPT, _PROFILED, _SCORED, then="SELECT sheet_id, row_idx, score FROM s WHERE row_idx < 30"))
def row_scores_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_scores(kept_rows(fixtures.order_sheets(spark, sf_dir))).where("row_idx < 30").select("sheet_id", "row_idx", "score")


@_query(_with(_ORDERS, _UP_TO_BEST, then=f"SELECT {', '.join(_BEST)} FROM f"))
def best_header_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_headers(fixtures.order_sheets(spark, sf_dir)).select(*_BEST)


@_query(_with(_LEDGER, _UP_TO_BEST, then=f"SELECT {', '.join(_BEST)} FROM f"))
def best_header_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_headers(fixtures.ledger_sheets(spark, sf_dir)).select(*_BEST)


@_query(_with(_DOCS, _UP_TO_BEST, then=f"SELECT {', '.join(_BEST)} FROM f"))
def best_header_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_headers(fixtures.doc_sheets(spark, sf_dir, prefix())).select(*_BEST)


@_query(_with(_ORDERS, _UP_TO_BEST, _HEADERS, then=f"SELECT sheet_id, name, column_index, {_letters('column_index + 1')} AS excel_column_name FROM hd"))
def headers_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_headers(header_rows(scored_rows(fixtures.order_sheets(spark, sf_dir))))


@_query(_with(_ORDERS, _UP_TO_BEST, _HEADERS, _PREVIEW, then="SELECT sheet_id, preview_no, name, value FROM pv"))
def preview_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview_long(scored_rows(fixtures.order_sheets(spark, sf_dir)))


@_query(_with(_LEDGER, _UP_TO_BEST, _HEADERS, _PREVIEW, then="SELECT sheet_id, preview_no, name, value FROM pv"))
def preview_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview_long(scored_rows(fixtures.ledger_sheets(spark, sf_dir)))


@_query(_with(_LEDGER, _UP_TO_BEST, _HEADERS, _PREVIEW, then="SELECT sheet_id, preview_no, row_no FROM pr"))
def preview_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_rows(fixtures.ledger_sheets(spark, sf_dir))
    return preview_rows_by_join(kept, best_header_rows(row_scores(kept))).select("sheet_id", "preview_no", "row_no")


@_query(_with(_DOCS, _UP_TO_BEST, _HEADERS, _PREVIEW, then="SELECT sheet_id, preview_no, name, value FROM pv"))
def preview_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview_long(scored_rows(fixtures.doc_sheets(spark, sf_dir, prefix())))


_GATE = """
    nm AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'f' || doc_id || '.xlsx' WHEN 1 THEN 'F' || doc_id || '.XLSM' WHEN 2 THEN 'f' || doc_id || '.csv' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'f' || doc_id || '.xlsx.bak' END AS file_name FROM documents),
    gate AS (SELECT *, CASE WHEN file_name IS NULL OR file_name = '' THEN 'Excel file is required' WHEN NOT regexp_matches(file_name, '(?i)[.]xls[xm]$') THEN 'Only .xlsx and .xlsm files are supported right now' END AS message FROM nm)"""


@_query(_with(_GATE, then="SELECT doc_id, file_name, message, CASE WHEN message IS NOT NULL THEN false END AS success FROM gate"))
def file_gate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_gate(fixtures.file_names(spark, sf_dir))


@_query(
    _with(
        _GATE,
        _DOCS,
        _UP_TO_BEST,
        then="""SELECT gate.doc_id, gate.message IS NULL AND f.header_row_index IS NOT NULL AS success,
        coalesce(gate.message, CASE WHEN f.sheet_id IS NULL THEN 'Excel sheet is empty' WHEN f.header_row_index IS NULL THEN 'Could not detect header row' ELSE 'Headers detected successfully' END) AS message
        FROM gate LEFT JOIN f ON gate.doc_id = f.sheet_id""",
    )
)
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = file_gate(fixtures.file_names(spark, sf_dir))
    found = detect_headers(fixtures.doc_sheets(spark, sf_dir, prefix())).select(F.col("sheet_id").alias("doc_id"), F.col("success").alias("_success"), F.col("message").alias("_message"))
    joined = gated.join(found, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("success", "_success").alias("success"), F.coalesce("message", "_message").alias("message"))


@_query(
    _with(
        _ORDERS,
        _UP_TO_BEST,
        _HEADERS,
        _PREVIEW,
        f"""
    e AS (SELECT sheet_id, 0 AS preview_no, column_index, name, {_letters("column_index + 1")} AS value FROM hd UNION ALL SELECT sheet_id, preview_no, NULL, name, value FROM pv)""",
        then="""SELECT f.sheet_id, f.header_row_index IS NOT NULL AS success, CASE WHEN f.header_row_index IS NULL THEN 'Could not detect header row' ELSE 'Headers detected successfully' END AS message,
        CASE WHEN f.header_row_index IS NOT NULL THEN 'Order' END AS sheet_name, header_row_index, header_row_number, confidence_score, sheet_row_no, preview_no, column_index, name, value
        FROM f LEFT JOIN e USING (sheet_id)""",
    )
)
def detect_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`detect_headers` of every order sheet, its nested result taken apart: a row for each header (`preview_no` 0) and each preview cell."""
    headers = F.transform("data.headers", lambda h: F.struct(F.lit(0).alias("preview_no"), h["column_index"].alias("column_index"), h["name"].alias("name"), h["excel_column_name"].alias("value")))
    cells = F.transform("data.preview_rows", lambda r, i: F.transform(F.map_entries(r), lambda e: F.struct((i + 1).cast("int").alias("preview_no"), F.lit(None).cast("int").alias("column_index"), e["key"].alias("name"), e["value"].alias("value"))))
    plain = ("sheet_name", "header_row_index", "header_row_number", "confidence_score", "sheet_row_no")
    found = detect_headers(fixtures.order_sheets(spark, sf_dir))
    told = found.select("sheet_id", "success", "message", *(f"data.{c}" for c in plain), F.explode_outer(F.concat(headers, F.flatten(cells))).alias("e"))
    return told.select("sheet_id", "success", "message", *plain, "e.preview_no", "e.column_index", "e.name", "e.value")


@_query(_with(_ORDERS, _UP_TO_BEST, then=f"SELECT {', '.join(_BEST)} FROM f"))
def detect_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in, header rows out."""
    return best_headers(grid_from_cells(fixtures.order_cells(spark, sf_dir))).select(*_BEST)


@_query(_with(_LEDGER, _UP_TO_BEST, _HEADERS, _PREVIEW, then="SELECT sheet_id, preview_no, name, value FROM pv"))
def preview_cells_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tall sheets in, previews out; of each sheet only the leading rows' cells are shuffled."""
    return preview_long(scored_rows(grid_from_cells(fixtures.ledger_cells(spark, sf_dir), prefix())))


@_query(
    """WITH e AS (SELECT event_id, [CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END,
                   event_type, CAST(value AS VARCHAR), CASE WHEN value > 50 THEN 'True' WHEN value <= 50 THEN 'False' END] AS cells FROM events)
    SELECT event_id % 100 AS sheet_id, 'Events' AS sheet_name, CAST(event_id AS INT) AS row_no, generate_subscripts(cells, 1) - 1 AS col_no, unnest(cells) AS value FROM e"""
)
def grid_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns as cells: whole numbers, moments, texts, doubles and truth values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("high", F.col("value") > 50)
    grid = grid_from_columns(events, F.col("event_id") % 100, F.col("event_id"), ["event_id", "ts", "event_type", "value", "high"], F.lit("Events"))
    return grid.select("sheet_id", "sheet_name", "row_no", F.posexplode("cells").alias("col_no", "value"))


@_query(
    _with(
        _CUSTOMERS,
        _UP_TO_BEST,
        _HEADERS,
        then="""SELECT 'customers/' || f.sheet_id || '.xlsx' AS path, true AS success, 'Headers detected successfully' AS message, header_row_index, confidence_score, sheet_row_no, names
        FROM f JOIN (SELECT sheet_id, string_agg(name, '|' ORDER BY column_index) AS names FROM hd GROUP BY 1) USING (sheet_id)""",
    )
)
def workbook_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(answers(fixtures.customer_workbooks(spark, sf_dir)))


def _told(found: DataFrame) -> DataFrame:
    names = F.concat_ws("|", F.transform("data.headers", lambda h: h["name"]))
    return found.select("path", "success", "message", "data.header_row_index", "data.confidence_score", "data.sheet_row_no", names.alias("names"))


_LANDED = _with(
    _CUSTOMERS,
    _UP_TO_BEST,
    _HEADERS,
    then="""SELECT f.sheet_id || CASE WHEN f.sheet_id % 7 = 0 THEN '.csv' ELSE '.xlsx' END AS path, f.sheet_id % 7 <> 0 AS success,
        CASE WHEN f.sheet_id % 7 = 0 THEN 'Only .xlsx and .xlsm files are supported right now' ELSE 'Headers detected successfully' END AS message,
        CASE WHEN f.sheet_id % 7 <> 0 THEN header_row_index END AS header_row_index, CASE WHEN f.sheet_id % 7 <> 0 THEN confidence_score END AS confidence_score,
        CASE WHEN f.sheet_id % 7 <> 0 THEN sheet_row_no END AS sheet_row_no, CASE WHEN f.sheet_id % 7 <> 0 THEN names ELSE '' END AS names
        FROM f JOIN (SELECT sheet_id, string_agg(name, '|' ORDER BY column_index) AS names FROM hd GROUP BY 1) USING (sheet_id)""",
)


def _file(found: DataFrame) -> DataFrame:
    return _told(found).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))


@_query(_LANDED)
def directory_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a folder, answered, written as JSON and read again."""
    out, found = shared_path(spark, "answers"), answer_directory(spark, fixtures.landed_files(spark, sf_dir))
    write_results(found, out)
    return _file(spark.read.schema(found.schema).json(out))


@_query(_LANDED)
def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a folder, answered by the stream in several batches, and the answers read again."""
    out, state = shared_path(spark, "streamed"), shared_path(spark, "stream-state")
    drain(stream_detect(spark, fixtures.landed_files(spark, sf_dir), out, state, files_per_batch=2000))
    return _file(spark.read.parquet(out))


_FAULTS = {1: "File is not a zip file", 2: "File is not a zip file", 3: f"Excel file is over its budget of {fixtures.FAULTS_BUDGET.inflated_bytes} (inflated_bytes)", 4: f"Excel file is over its budget of {fixtures.FAULTS_BUDGET.depth} (depth)", 7: "Only .xlsx and .xlsm files are supported right now"}


@_query(
    _with(
        _CUSTOMERS,
        _UP_TO_BEST,
        f"""
    m AS (SELECT *, CASE sheet_id % 8 {" ".join(f"WHEN {k} THEN '{m}'" for k, m in _FAULTS.items())} END AS fault FROM f)""",
        then="""SELECT sheet_id || CASE WHEN sheet_id % 8 = 7 THEN '.txt' ELSE '.xlsx' END AS path, fault IS NULL AS success, coalesce(fault, 'Headers detected successfully') AS message,
        CASE WHEN fault IS NULL THEN header_row_index END AS header_row_index, CASE WHEN fault IS NULL THEN confidence_score END AS confidence_score FROM m""",
    )
)
def workbook_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of good and bad files: empty ones, cut off ones, ones that are over their budget, refused ones; each is answered alone."""
    found = answer_directory(spark, fixtures.faulty_files(spark, sf_dir), budget=fixtures.FAULTS_BUDGET)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "success", "message", "data.header_row_index", "data.confidence_score")


@_query(_LANDED)
def source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a folder, read by the data source of workbooks as rows, and answered."""
    register(spark)
    rows = spark.read.format("workbooks").option("taskBytes", 64 << 20).load(fixtures.landed_files(spark, sf_dir))
    return _file(answered(rows))
