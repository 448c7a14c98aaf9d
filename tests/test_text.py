import datetime as dt
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhead.functions import text as X


def values(spark, function, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "yes", "no"),
    [
        (X.is_number_like, ["3", "-3", "+.5", "5.", "1e5", "1_000", "inf", "-Infinity", "NaN", "٣"], ["", "1,000", "$5", "5%", "0x10", "0x1p3", "1d", "1f", "1__0", "_1", "1_", "- 1", "²"]),
        (X.is_date_like, ["1/2/24", "01-02-2024", "2024-1-2", "99/99/999", "1-2/2024", "١/٢/٢٠٢٤"], ["", "1.2.2024", "2024-01-02 00:00:00", "1/2/2", "1/2/20244", "24-1-2024x"]),
        (X.has_alphabet, ["a", "1e5", "#N/A", "True"], ["", "日付", "É", "12:00"]),
        (X.is_very_long, ["x" * 41, "😀" * 41], ["x" * 40, ""]),
        (X.is_blank, ["", " \t\n", None, " "], ["a", "​"]),
    ],
)
def test_kinds(spark, function, yes, no):
    assert values(spark, function, yes) == [True] * len(yes)
    assert values(spark, function, no) == [False] * len(no)


def test_number_like_is_what_python_reads_as_a_float(spark):
    import itertools

    items = ["".join(c) for n in range(1, 5) for c in itertools.product("1.e-_+x", repeat=n)]

    def reads(s):
        try:
            return float(s) is not None
        except ValueError:
            return False

    assert values(spark, X.is_number_like, items) == [reads(s) for s in items]


def test_normalize_cell(spark):
    assert values(spark, X.normalize_cell, ["\x1c a \x1d\xa0b", None, " \t\n", "​", "a  b"]) == ["a b", "", "", "​", "a b"]


def test_column_letters(spark):
    def letters(n):
        return (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)

    got = spark.range(1, 16385).select("id", X.excel_column_name(F.col("id"))).collect()
    assert all(b == letters(a) for a, b in got)
    assert dict(got)[16384] == "XFD"


@pytest.mark.parametrize(
    ("kind", "value", "text"),
    [
        (T.BooleanType(), True, "True"),
        (T.BooleanType(), False, "False"),
        (T.IntegerType(), 3, "3"),
        (T.DoubleType(), 1.0, "1.0"),
        (T.DoubleType(), 1e-05, "1e-05"),
        (T.DoubleType(), 1e16, "1e+16"),
        (T.DoubleType(), float("nan"), "nan"),
        (T.DateType(), dt.date(2024, 1, 2), "2024-01-02"),
        (T.TimestampType(), dt.datetime(2024, 1, 2), "2024-01-02 00:00:00"),
        (T.TimestampType(), dt.datetime(2024, 1, 2, 3, 4, 5, 60), "2024-01-02 03:04:05.000060"),
        (T.StringType(), None, None),
        (T.DoubleType(), None, None),
        (T.BooleanType(), None, None),
    ],
)
def test_render(spark, kind, value, text):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    assert df.select(X.render_cell(F.col("v"), kind)).first()[0] == text


def test_double_text_is_what_python_writes(spark):
    rng = random.Random(1)
    bits = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(400_000)]
    scaled = [rng.random() * 10 ** rng.randrange(-8, 20) for _ in range(400_000)]
    plain = [round(rng.random() * 10**6, rng.randrange(6)) for _ in range(200_000)]
    edges = [s * 10.0**e * m for s in (1, -1) for e in range(-324, 309) for m in (1, 1.5, 1 / 3)]
    odd = [*(k * 5e-324 for k in range(-300, 300)), 2.2250738585072014e-308, 1.7976931348623157e308, 8.41e21, 2e-3, 9007199254740993.0, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), None]
    items = [v for v in (*bits, *scaled, *plain, *edges) if v == v] + odd
    df = spark.createDataFrame(pa.table({"v": pa.array(items, pa.float64(), from_pandas=False)}))
    texts = df.select("v", X.render_cell(F.col("v"), T.DoubleType()).alias("t"))
    assert "Python" not in texts._jdf.queryExecution().executedPlan().toString()
    got = texts.toArrow().to_pydict()
    assert [(v, t) for v, t in zip(got["v"], got["t"], strict=True) if t != (None if v is None else repr(v))] == []
