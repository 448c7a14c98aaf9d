"""Grids made from the test tables by Spark: sheets of orders, ledgers, documents and customers, and file names."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhead.operators.grid import grid_from_text
from gridhead.sources.shared import shared_path
from gridhead.sources.store import filesystem
from gridhead.sources.workbook import Budget, gathered

ORDER_HEADER = (" Line  No ", "Part Key", "Supp Key", "Qty", "Unit  Price", "Ship Date", "Flag")
LEDGER_HEADER = ("Cust Key", "Name", "Name", "Balance", "Segment")
#: Where the lines of an order stand (line numbers are not unique).
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task sorts, and orders of which one task makes workbooks.
ROWS_PER_TASK, ORDERS_PER_TASK = 100_000, 20_000


def _dealt(rows: DataFrame, key: str, per_task: int | None = None) -> DataFrame:
    """The rows of a table (counted from its files' footers) dealt by `key` to tasks of a bounded number of rows, so that what
    a task sorts does not grow with the table; of few rows each core has less, and Spark deals them as it likes."""
    tasks = -(-rows.count() // (per_task or ROWS_PER_TASK))
    return rows.repartition(tasks, key) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def _text(*values: str | None) -> Column:
    return F.array(*(F.lit(v).cast("string") for v in values))


def _number(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def _rows(*rows: tuple[Column | int, Column]) -> Column:
    return F.array(*(F.struct((F.lit(no) if isinstance(no, int) else no).cast("int").alias("row_no"), cells.alias("cells")) for no, cells in rows))


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small sheet per order: a title, a blank row, the header, and its lines."""
    lines = _dealt(_table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1)
    data = F.array(F.col("k").cast("string"), *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")), _number("l_quantity"), _number("l_extendedprice"), F.date_format("l_shipdate", "dd/MM/yyyy"), F.col("l_returnflag"))
    line = (F.col("k") + 3, data)
    title = F.concat(F.array(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))), _text(*[None] * 6))
    top = _rows((0, title), (1, _text("  ", None, "\t", *[None] * 4)), (2, _text(*ORDER_HEADER)), line)
    rows = lines.select(F.col("l_orderkey").alias("sheet_id"), F.explode(F.when(F.col("k") == 0, top).otherwise(_rows(line))).alias("r"))
    return rows.select("sheet_id", F.lit("Order").alias("sheet_name"), "r.row_no", "r.cells")


def ledger_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tall sheet per nation: notes (each followed by a blank row), a header with a repeated name, and its customers."""
    n = F.when(F.col("c_nationkey") == 24, 31).when(F.col("c_nationkey") == 23, 29).otherwise(F.col("c_nationkey") % 5)
    rows = _table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).withColumn("notes", n)
    data = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.lower("c_mktsegment"), _number("c_acctbal"), F.col("c_mktsegment"))
    line = (2 * F.col("notes") + F.col("k"), data)
    note = F.transform(F.sequence(F.lit(0), 2 * F.col("notes")), lambda i: F.struct(i.cast("int").alias("row_no"), F.when(i == 2 * F.col("notes"), _text(*LEDGER_HEADER)).when(i % 2 == 0, F.concat(F.array(F.concat(F.lit("note "), (i / 2).cast("int").cast("string"))), _text(*[None] * 4))).otherwise(_text(*[None] * 5)).alias("cells")))
    spread = rows.select(F.col("c_nationkey").alias("sheet_id"), F.explode(F.when(F.col("k") == 1, F.concat(note, _rows(line))).otherwise(_rows(line))).alias("r"))
    return spread.select("sheet_id", F.lit("Ledger").alias("sheet_name"), "r.row_no", "r.cells")


def doc_sheets(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """One ragged sheet per document: its lines (the leading ones that `limit` asks for), cut at commas."""
    return grid_from_text(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), ",", "Doc", limit)


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`order_sheets` as one record per cell that is not null."""
    cells = order_sheets(spark, sf_dir).select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "value"))
    return cells.where("value IS NOT NULL")


def ledger_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ledger_sheets` as one record per cell."""
    return ledger_sheets(spark, sf_dir).select("sheet_id", "sheet_name", "row_no", F.posexplode("cells").alias("col_no", "value"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for documents, accepted and refused ones."""
    number, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    names = (F.concat(F.lit("f"), number, F.lit(".xlsx")), F.concat(F.lit("F"), number, F.lit(".XLSM")), F.concat(F.lit("f"), number, F.lit(".csv")), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("f"), number, F.lit(".xlsx.bak")))
    name = names[5]
    for k in range(5):
        name = F.when(kind == k, names[k]).otherwise(name)
    return _table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"))


CUSTOMER_HEADER = ("Order", "Status", "Total", "Date")


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`c_custkey, row_no, cells`: a title, the header, and the customer's orders."""
    orders = _dealt(_table(spark, sf_dir, "orders"), "o_custkey", ORDERS_PER_TASK).withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    line = (F.col("k") + 1, F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), _number("o_totalprice"), F.date_format("o_orderdate", "dd/MM/yyyy")))
    title = F.concat(F.array(F.concat(F.lit("Orders of "), F.col("o_custkey").cast("string"))), _text(*[None] * 3))
    top = _rows((0, title), (1, _text(*CUSTOMER_HEADER)), line)
    return orders.select(F.col("o_custkey").alias("c_custkey"), F.explode(F.when(F.col("k") == 1, top).otherwise(_rows(line))).alias("r")).select("c_custkey", "r.row_no", "r.cells")


def _letters(n: int) -> str:
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


class _Workbook:
    """A workbook of one sheet with inline strings, written row by row."""

    _MAIN, _OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def __init__(self, name: str = "Sheet1"):
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{self._MAIN}" xmlns:r="{self._OFFICE}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{self._OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w")
        self.sheet.write(f'<worksheet xmlns="{self._MAIN}"><sheetData>'.encode())

    def add(self, row_no: int, cells: list[str | None]) -> None:
        texts = (f'<c r="{_letters(j)}{row_no + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(cells, 1) if v is not None)
        self.sheet.write(f'<row r="{row_no + 1}">{"".join(texts)}</row>'.encode())

    def content(self) -> bytes:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        return self.out.getvalue()


def workbook_bytes(rows: list[list[str | None]], name: str = "Sheet1") -> bytes:
    book = _Workbook(name)
    for i, cells in enumerate(rows):
        book.add(i, cells)
    return book.content()


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, place, cells) to a workbook per key, written as they come."""
    last, book = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [f"customers/{last}.xlsx"], "content": pa.array([book.content()], pa.binary())})

    for b in batches:
        for key, row_no, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if book:
                    yield done()
                last, book = key, _Workbook()
            book.add(row_no, cells)
    if book:
        yield done()


def _sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer_rows` in order; the numbering of orders has brought a customer's together already."""
    return customer_rows(spark, sf_dir).select("c_custkey", "row_no", "cells").sortWithinPartitions("c_custkey", "row_no")


def customer_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`path, content`: a workbook file per customer with orders."""
    return _sorted_rows(spark, sf_dir).mapInArrow(lambda batches: gathered(_books(batches)), "path string, content binary")


def _saved(spark: SparkSession, sf_dir: str, named: Callable[[int, bytes], tuple[str, bytes]]) -> str:
    """A new folder with a file for every customer workbook, under the name and with the content that `named` makes of key and content."""
    folder = shared_path(spark, "landing")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        saved = 0
        for b in _books(batches):
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, content = named(int(path.removeprefix("customers/").removesuffix(".xlsx")), content)
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
            saved += len(b)
        yield pa.RecordBatch.from_pydict({"n": [saved]})

    _sorted_rows(spark, sf_dir).mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return folder


def landed_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with a file per customer with orders: its workbook, under a name that is refused for each seventh."""
    return _saved(spark, sf_dir, lambda key, content: (f"{key}{'.csv' if key % 7 == 0 else '.xlsx'}", content))


#: The budget of the faulty files: less than what some of them unpack to.
FAULTS_BUDGET = Budget(inflated_bytes=1 << 20, depth=20)
_BLANKS, _NESTED = 2 << 20, 40


def _changed(content: bytes, change: Callable[[str, bytes], tuple[str, bytes]], first: bytes = b"") -> bytes:
    """The workbook with every part renamed and rewritten, behind a part that no one reads."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as new:
        if first:
            new.writestr("media/unread.bin", first, zipfile.ZIP_STORED)
        for name in old.namelist():
            new.writestr(*change(name, old.read(name)))
    return out.getvalue()


def _faulty(key: int, content: bytes) -> tuple[str, bytes]:
    def inside(name: str, part: bytes, text: bytes) -> tuple[str, bytes]:
        return name, part.replace(b"<sheetData>", text + b"<sheetData>") if name.startswith("xl/worksheets") else part

    def moved(name: str, part: bytes) -> tuple[str, bytes]:
        return name.replace("xl/_rels/workbook", "book/_rels/main").replace("xl/workbook", "book/main").replace("xl/", "book/"), part

    kind = key % 8
    if kind == 1:
        content = b""
    elif kind == 2:
        content = content[: len(content) // 2]
    elif kind == 3:
        content = _changed(content, lambda n, p: inside(n, p, b" " * _BLANKS))
    elif kind == 4:
        content = _changed(content, lambda n, p: inside(n, p, b"<a>" * _NESTED))
    elif kind == 5:
        content = _changed(content, lambda n, p: (n, p), bytes(100_000))
    elif kind == 6:
        out = io.BytesIO(_changed(content, moved))
        with zipfile.ZipFile(out, "a") as z:
            z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{_Workbook._OFFICE}/officeDocument" Target="book/main.xml"/></Relationships>')
        content = out.getvalue()
    return f"{key}{'.txt' if kind == 7 else '.xlsx'}", content


def faulty_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with a file per customer with orders, by the eighth: as it is, empty, cut off, unpacking to far more than it
    is long, nested, with a long part that no one reads, with its main part elsewhere, and refused."""
    return _saved(spark, sf_dir, _faulty)
