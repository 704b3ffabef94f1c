"""Joins with the head-match, rank-aligned and last-wins rules of keyed lists and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """A map from pairs: of equal keys the one inserted last."""
    return rows.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def multimap(rows: DataFrame, key: str, value: str, ordinal: str, newest_first: bool = True) -> DataFrame:
    """key and the list of its values."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))), asc=not newest_first)
    return rows.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias(f"{value}s"))


def head_match_join(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Outer join of the left keys, one row a key: the first left row with the first right row, if there is one."""
    return first_of(left, [key], left_order).join(first_of(right, [key], right_order), key, "left")


def left_outer_groups(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each left row with the ordered list of its right values, empty if there are none."""
    lists = right.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))
    return left.join(lists, key, "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def rank_aligned_pairs(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Full outer join that pairs the first row of a key with the first, the second with the second, and so on."""
    ranked = [r.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*o))) for r, o in ((left, left_order), (right, right_order))]
    return ranked[0].join(ranked[1], [key, "rank"], "full")


def two_hop(names: DataFrame, ids: DataFrame, aliases: DataFrame, name: str, item: str) -> DataFrame:
    """name -> item -> what ``aliases`` has of the item; null where a hop is missing."""
    return names.join(ids, name, "left").join(aliases, item, "left")


def by_priority(rows: DataFrame, key: str, value: str, priorities: DataFrame) -> DataFrame:
    """Of each key's values the one of the highest priority (least ``prio``)."""
    return rows.join(priorities, value).groupBy(key).agg(F.min_by(value, "prio").alias(value))
