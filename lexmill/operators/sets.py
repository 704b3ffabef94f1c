"""Set operators that keep repeated rows, and tagged unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the right side whose key is on the left, repeated ones too."""
    return right.join(left.select(key), key, "left_semi")


def bag_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All left rows, then the right rows whose key is not on the left."""
    return left.unionByName(right.join(left.select(key), key, "left_anti"))


def fold_bags(bags: list[DataFrame], key: str, union: bool) -> DataFrame:
    """``bag_union`` or ``bag_intersection`` over several bags, from the left."""
    out = bags[0]
    for bag in bags[1:]:
        out = bag_union(out, bag, key) if union else bag_intersection(out, bag, key)
    return out


def tag_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides with ``side`` L or R; ``b`` orders them."""
    return left.withColumn("side", F.lit("L")).unionByName(right.withColumn("side", F.lit("R")))


def side(merged: DataFrame, which: str) -> DataFrame:
    """One side of a tagged union."""
    return merged.where(F.col("side") == which).drop("side")
