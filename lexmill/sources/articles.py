"""Articles kept in several files, of which the n-th records belong together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_records(spark: SparkSession, folder: str, extension: str, separator: str = "\n") -> DataFrame:
    """article, place, record: the records of all files with an extension, numbered from 0 in each; the article is the file's name without it.

    A file is read whole by one task, as an article fits one; an empty last record is none.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{extension}").select(F.input_file_name().alias("path"), "value")
    name = F.regexp_extract("path", rf"([^/]*)\.{extension}$", 1)
    records = F.split("value", separator, -1)
    whole = F.when(F.element_at(records, -1) == "", F.slice(records, 1, F.size(records) - 1)).otherwise(records)
    return files.select(name.alias("article"), F.posexplode(whole).alias("place", "record"))


def zipped(spark: SparkSession, folder: str, extensions: list[str], separator: str = "\n") -> DataFrame:
    """article, place and one column an extension: the n-th records of an article's files side by side; null where a file is missing or shorter."""
    each = [numbered_records(spark, folder, x, separator).withColumnRenamed("record", x) for x in extensions]
    return reduce(lambda a, b: a.join(b, ["article", "place"], "full"), each)


def complete(rows: DataFrame, extensions: list[str]) -> DataFrame:
    """Articles in which all files have all records."""
    short = rows.where(reduce(lambda a, b: a | b, [F.col(x).isNull() for x in extensions])).select("article").distinct()
    return rows.join(short, "article", "left_anti")
