"""Column functions on the text of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, as a digit, as a number and as a date.
WHITE_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_D = r"\p{Nd}"
_DIGITS = rf"{_D}+(?:_{_D}+)*"
NUMBER = rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
DATE = rf"^(?:{_D}{{1,2}}[-/]{_D}{{1,2}}[-/]{_D}{{2,4}}|{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}})$"
LETTER = "[a-zA-Z]"

#: A cell of more characters is a title or a description rather than a name.
LONG = 40


def normalize_cell(cell: Column) -> Column:
    """Outer white space off, inner runs to one space; null to the empty text."""
    spaced = F.regexp_replace(cell, f"[{WHITE_SPACE}]+", " ")
    return F.coalesce(F.regexp_replace(spaced, "^ | $", ""), F.lit(""))


def normalize_header_name(name: Column) -> Column:
    return normalize_cell(name)


def is_blank(cell: Column) -> Column:
    return normalize_cell(cell) == ""


def has_alphabet(text: Column) -> Column:
    """Holds an ASCII letter."""
    return text.rlike(LETTER)


def is_number_like(text: Column) -> Column:
    return text.rlike(NUMBER)


def is_date_like(text: Column) -> Column:
    """Has the shape of a date; whether such a day exists is not asked."""
    return text.rlike(DATE)


def is_very_long(text: Column, longest: int = LONG) -> Column:
    return F.char_length(text) > longest


def folded(text: Column) -> Column:
    """For comparing names without regard to case."""
    return F.lower(text)


def excel_column_name(number: Column) -> Column:
    """The letters of a spreadsheet column: 1 is A, 27 is AA, 703 is AAA, up to 16384 (XFD)."""
    n = number.cast("int")

    def letter(value: Column) -> Column:
        return F.char(F.lit(65) + value)

    third = F.when(n > 702, letter(F.floor((n - 703) / 676).cast("int"))).otherwise("")
    second = F.when(n > 26, letter(F.pmod(F.floor((n - 27) / 26).cast("int"), F.lit(26)))).otherwise("")
    return F.concat(third, second, letter((n - 1) % 26))


#: The JVM's own text of doubles is not always the shortest one; the JSON library that Spark brings writes that.
_WRITER = "com.fasterxml.jackson.core.io.NumberOutput"


def double_text(value: Column) -> Column:
    """The shortest text that reads as the same double, with an exponent from 1e16 and below 1e-4 only."""
    whole = F.reflect(F.lit(_WRITER), F.lit("toString"), value, F.lit(True))

    def formed(t: Column) -> Column:
        exponent = F.substring_index(t, "E", -1).cast("int")
        written = F.regexp_replace(F.substring_index(t, "E", 1), r"^-|\.0$|\.", "")
        # the writer puts two digits where one reads as the same, among the least doubles
        one = F.round(F.try_to_number(F.substr(written, F.lit(1), F.lit(2)), F.lit("99")) / 10).cast("int")
        reads = (F.abs(value) < 1e-321) & (F.length(written) == 2) & (F.concat(one.cast("string"), F.lit("E"), exponent.cast("string")).try_cast("double") == F.abs(value))
        digits = F.when(reads & (one == 10), "1").when(reads, one.cast("string")).otherwise(written)
        power = F.when(reads & (one == 10), exponent + 1).otherwise(exponent)
        size = F.length(digits)
        plain = F.when(size > power + 1, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0")))
        fraction = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        scientific = F.concat(F.substring(digits, 1, 1), fraction, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
        form = F.when(power.between(7, 15), plain).when(power == -4, F.concat(F.lit("0.000"), digits)).otherwise(scientific)
        return F.when(~t.contains("E"), t).otherwise(F.concat(F.when(t.startswith("-"), "-").otherwise(""), form))

    text = F.get(F.transform(F.array(whole), formed), F.lit(0))  # written once, read often
    infinite = F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(F.isnan(value), "nan").when(infinite.isNotNull(), infinite).when(value.isNotNull(), text)


def render_cell(value: Column, kind: T.DataType) -> Column:
    """The text of a typed value: True and False for booleans, fractions of seconds only where there are some, doubles in shortest form."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return double_text(value.cast("double"))
    return value.cast("string")
