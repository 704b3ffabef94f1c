"""Ranges of keys from sampled splitters, and running values over groups of any size.

A key is a struct column, compared field by field (null first). Rows are drawn
for a sample with a chance in proportion to their weight, by a hash of the key:
a task that runs again draws the same rows. Boundaries are quantiles of the
sample, so ranges have about equal weight; what lies in one range is exact all
the same, as every use counts the ranges afterwards. The sample and the list of
boundaries have about ``EACH`` and one keys a range, whatever the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, discard

#: Sampled keys for each range.
EACH = 16
#: Rows of a range that one task sorts with ease, and ranges that are made at least.
ROWS_EACH, LEAST_RANGES = 500_000, 1024


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table with a column ``_row``: another number for each row, also for repeated ones."""
    return checkpointed(df.withColumn("_row", F.monotonically_increasing_id()), name)


def count_for(rows: int, least: int = LEAST_RANGES) -> int:
    """Ranges for so many rows."""
    return max(least, -(-rows // ROWS_EACH))


def splitters(df: DataFrame, key: Column, weight: Column, drawn: float, each: int = EACH) -> DataFrame:
    """boundary: the first key of each range but the first. ``drawn``: sampled rows wanted for a unit of weight, ``each``: for a range.

    A row is drawn with the chance weight * drawn, up to 1, and counts for what is over 1.
    """
    sample = df.select(key.alias("_key"), (weight * F.lit(drawn)).cast("double").alias("_p"))
    sample = sample.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 31)) < F.col("_p") * (1 << 31))
    upto = F.sum(F.greatest("_p", F.lit(1.0))).over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))
    cells = sample.select("_key", F.floor(F.coalesce(upto, F.lit(0.0)) / each).alias("_cell"))
    return cells.groupBy("_cell").agg(F.min("_key").alias("boundary")).where("_cell > 0").select("boundary")


def position(bounds: Column, n: int, key: Column) -> Column:
    """How many of ``n`` ascending values are not above the key, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def range_of(key: Column, boundaries: DataFrame) -> Column:
    """The number of boundaries up to the key. The boundaries, some a range, become one constant of the plan."""
    listed = boundaries.agg(F.array_sort(F.collect_set("boundary")).alias("listed"))
    text, n = listed.select(F.to_json("listed"), F.size("listed")).first()
    return position(F.from_json(F.lit(text), listed.schema["listed"].dataType), n, key)


def ranged(df: DataFrame, key: Column, weight: Column | None = None, each: int = EACH, least: int = LEAST_RANGES) -> DataFrame:
    """``df`` with a column ``_range``, ascending with the keys. ``df`` is read again and again: give a table.

    A range that got more than twice its share, its heaviest row apart, is
    subdivided by another sample, drawn twice as densely each time, until there is none.
    """
    weight = F.lit(1) if weight is None else weight
    rows, total = df.agg(F.count(F.lit(1)), F.sum(weight)).first()
    share = max(total or 1, 1) / count_for(rows, least)
    boundaries = checkpointed(splitters(df, key, weight, each / share, each).coalesce(1), "boundaries")
    density = 1
    while True:
        out = df.withColumn("_range", range_of(key, boundaries))
        shares = out.groupBy("_range").agg(F.sum(weight).alias("all"), F.max(weight).alias("most"))
        over = [r[0] for r in shares.where(F.col("all") - F.col("most") > 2 * share).select("_range").limit(4096).collect()]
        if not over:
            return out
        density *= 2
        dense = splitters(out.where(F.col("_range").isin(over)), key, weight, density * each / share, each)
        last, boundaries = boundaries, checkpointed(boundaries.unionByName(dense).distinct().coalesce(1), "boundaries")
        discard(last)


#: How a running value is made from values and put together from two: (aggregate, two values, nothing yet).
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def running(df: DataFrame, group: list[str], part: str, order: list, values: dict[str, tuple[Column, str]], totals: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each name of ``values``, the value of the group's rows up to and with the row.

    ``part`` orders the pieces of a group that fit a task; ``order`` the rows in a
    piece. Rows are gathered by piece, never by group: what comes before a piece is
    joined from one row a piece. ``totals``: names of sums over the whole group.
    """
    piece, totals = [*group, part], totals or {}
    inside = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    make = {k: KINDS[kind][0] for k, (_, kind) in values.items()}
    rows = df.withColumns({k: make[k](v).over(inside) for k, (v, _) in values.items()})
    sums = [make[k](v).alias(f"_{k}") for k, (v, _) in values.items()] + [F.sum(v).alias(f"_{k}") for k, v in totals.items()]
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(make[k](f"_{k}").over(before), F.lit(KINDS[kind][2])).alias(f"_{k}") for k, (_, kind) in values.items()]
    pieces = df.groupBy(*piece).agg(*sums).select(*[F.col(c).alias(f"_of_{c}") for c in piece], *earlier, *[F.sum(f"_{k}").over(Window.partitionBy(*group)).alias(k) for k in totals])
    both = rows.join(pieces, [F.col(c) == F.col(f"_of_{c}") for c in piece])
    return both.select(*df.columns, *[KINDS[kind][1](F.col(k), F.col(f"_{k}")).alias(k) for k, (_, kind) in values.items()], *totals)
