"""Writers: tab-separated rows, JSON records, graph text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", False).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Parquet takes the place of binary stores."""
    rows.write.parquet(path)


def role_map_line(lemma: Column, sense: Column, roles: Column) -> Column:
    """``lemma<TAB>sense<TAB>key:value ...`` with keys in order."""
    entries = F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat_ws("\t", lemma, sense, F.array_join(entries, " "))


def dot_lines(edges: DataFrame, by: list[str], src: str, dst: str, label: str) -> DataFrame:
    """A DOT graph for each group."""
    line = F.concat(F.lit('"'), F.col(src), F.lit('" -> "'), F.col(dst), F.lit('" [label="'), F.col(label), F.lit('"];'))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return edges.groupBy(*by).agg(F.concat(F.lit("digraph G {\n"), body, F.lit("\n}")).alias("dot"))
