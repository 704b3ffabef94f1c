"""Operators on ordered rows: runs, running totals, ordinals, carry-forward.

Every operator takes the columns that set a sequence apart (``by``) and those
that order it (``order``); a window per sequence is the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], value: str, drop: str | None = None) -> DataFrame:
    """Runs of equal ``value``: by, b, e (half-open ordinals from 0) and value; runs of ``drop`` are left out."""
    whole = Window.partitionBy(*by).orderBy(*order)
    own = Window.partitionBy(*by, value).orderBy(*order)
    placed = rows.withColumn("__i", F.row_number().over(whole) - 1).withColumn("__run", F.col("__i") - F.row_number().over(own))
    runs = placed.groupBy(*by, value, "__run").agg(F.min("__i").cast("long").alias("b"), (F.max("__i") + 1).cast("long").alias("e"))
    runs = runs.drop("__run")
    return runs if drop is None else runs.where(F.col(value) != drop)


def joined_runs(rows: DataFrame, by: list[str], order: list[str], value: str, word: str, drop: str | None = None) -> DataFrame:
    """Runs of equal ``value`` with their words joined by one space."""
    whole = Window.partitionBy(*by).orderBy(*order)
    own = Window.partitionBy(*by, value).orderBy(*order)
    placed = rows.withColumn("__i", F.row_number().over(whole) - 1).withColumn("__run", F.col("__i") - F.row_number().over(own))
    if drop is not None:
        placed = placed.where(F.col(value) != drop)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(word).alias("w")))), lambda x: x["w"]), " ")
    return placed.groupBy(*by, value, "__run").agg(F.min("__i").cast("long").alias("b"), texts.alias("words")).drop("__run")


def histogram_cut(rows: DataFrame, by: list[str], order: list[Column], count: str, share: float) -> DataFrame:
    """The leading rows of each group until their counts reach ``share`` of the total, with the row that crosses it."""
    group = Window.partitionBy(*by)
    so_far = F.sum(count).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("__before", so_far - F.col(count)).withColumn("__total", F.sum(count).over(group))
    return kept.where(F.col("__before") < F.lit(share) * F.col("__total")).drop("__before", "__total")


def contiguous_segments(rows: DataFrame, by: list[str], b: str, e: str) -> DataFrame:
    """Merged runs of closed ranges that follow each other without a gap, and whether the group's ranges overlap anywhere."""
    group = Window.partitionBy(*by).orderBy(b, e)
    before = F.lag(e).over(group)
    placed = rows.withColumn("__clash", F.coalesce(before >= F.col(b), F.lit(False))).withColumn("__new", F.when(before + 1 == F.col(b), 0).otherwise(1))
    placed = placed.withColumn("__run", F.sum("__new").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("__any", F.max("__clash").over(Window.partitionBy(*by)))
    return placed.groupBy(*by, "__run").agg(F.min(b).alias("b"), F.max(e).alias("e"), F.count(F.lit(1)).alias("parts"), F.max("__any").alias("overlaps")).drop("__run")


def adjust_index(rows: DataFrame, by: list[str], order: list[str], excluded: Column) -> DataFrame:
    """idx (ordinal from 0), excluded, and adjusted: idx less the excluded rows before it, null for an excluded row."""
    group = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumn("idx", (F.row_number().over(group) - 1).cast("long")).withColumn("excluded", excluded)
    before = F.sum(F.col("excluded").cast("long")).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("adjusted", F.when(~F.col("excluded"), F.col("idx") - before))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each null of ``columns`` becomes the last value before it in its sequence."""
    group = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(group) for c in columns})


def gap_text(tokens: DataFrame, by: list[str], b: str, e: str, word: str) -> DataFrame:
    """A text from its tokens, with as many spaces between two as their character offsets leave."""
    group = Window.partitionBy(*by).orderBy(b)
    gap = F.greatest(F.lit(0), F.col(b) - F.lag(e, 1).over(group))
    parts = tokens.withColumn("__part", F.concat(F.repeat(F.lit(" "), F.coalesce(gap, F.lit(0)).cast("int")), F.col(word)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(b).alias("b"), F.col("__part").alias("p")))), lambda x: x["p"])
    return parts.groupBy(*by).agg(F.array_join(ordered, "").alias("text"))


def shifted_spans(tokens: DataFrame, by: list[str], order: list[str], b: str, e: str, growth: Column) -> DataFrame:
    """Spans moved by the summed growth of the tokens before them; each ends later by its own growth."""
    group = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = tokens.withColumn("__own", growth).withColumn("__all", F.sum("__own").over(group))
    return moved.withColumn("new_b", F.col(b) + F.col("__all") - F.col("__own")).withColumn("new_e", F.col(e) + F.col("__all")).drop("__own", "__all")


def neighbours_in_order(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """previous and next value of each row of a sequence."""
    group = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(group)).withColumn("next", F.lead(value).over(group))
