"""Rows of SQL dumps and lists of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A value: text in single quotes, where a backslash or a second quote keeps one, or a plain word.
_VALUE = r"'(?:[^'\\]|\\.|'')*+'|[^',()]++"
_TUPLE = rf"\((?:{_VALUE}|,)*+\)"
# What a letter after a backslash stands for.
_ESCAPES = {"n": "\n", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a", "r": ""}


def dump_rows(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """table, fields of the rows that a dump inserts; text loses its quotes and carriage returns, NULL is null.

    One statement is one line; any other line has no rows. Files may be compressed.
    The reader's lines must have the dump's encoding, which is one byte a character.
    """
    # ``text`` reads UTF-8 alone; one-byte text comes by the CSV reader with no separator that occurs
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").option("escape", "\x02").option("lineSep", "\n").schema("value string").csv(path)
    table = F.regexp_extract("value", r"^INSERT INTO [`\"]?([^`\" ]+)[`\"]? VALUES ", 1)
    rows = lines.select(table.alias("table"), F.regexp_replace("value", r"^INSERT INTO [^ ]+ VALUES ", "").alias("rest")).where("table <> ''")
    each = rows.select("table", F.explode(F.regexp_extract_all("rest", F.lit(_TUPLE), 0)).alias("row"))
    values = F.regexp_extract_all(F.expr("substring(row, 2, length(row) - 2)"), F.lit(rf"(?:{_VALUE})"), 0)
    return each.select("table", F.transform(values, _value).alias("fields"))


def _value(text):
    inner = F.regexp_replace(text, r"^'|'$", "")
    # a doubled backslash is set aside first, so that its second half escapes nothing
    inner = F.replace(F.replace(inner, F.lit("''"), F.lit("'")), F.lit("\\\\"), F.lit("\x02"))
    for letter, meant in _ESCAPES.items():
        inner = F.replace(inner, F.lit("\\" + letter), F.lit(meant))
    inner = F.replace(F.replace(inner, F.lit("\\"), F.lit("")), F.lit("\x02"), F.lit("\\"))
    inner = F.replace(inner, F.lit("\r"), F.lit(""))
    return F.when(text.startswith("'"), inner).when(text != "NULL", F.replace(text, F.lit("\r"), F.lit("")))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """term: lines of two characters and more, with a blank after them, so that no term is found inside of a word's start."""
    return spark.read.text(path).where(F.length("value") > 1).select(F.concat("value", F.lit(" ")).alias("term"))
