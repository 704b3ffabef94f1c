"""Spans: half-open ``[b, e)`` columns; closed ranges are ``(b, e - 1)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_position(lb: Column, le: Column, rb: Column, re: Column) -> Column:
    """How the left span lies to the right one; the first case that holds."""
    cases = [
        ("LbeforeR", le <= rb),
        ("RbeforeL", re <= lb),
        ("Coincide", (lb == rb) & (le == re)),
        ("RinL", (lb <= rb) & (re <= le)),
        ("LinR", (rb <= lb) & (le <= re)),
        ("RoverlapL", (rb < lb) & (re < le)),
    ]
    out = F.lit("LoverlapR")
    for name, holds in reversed(cases):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def to_closed(b: Column, e: Column) -> Column:
    return F.struct(b.alias("b"), (e - 1).alias("e"))


def inside(b: Column, e: Column, outer_b: Column, outer_e: Column) -> Column:
    return (b >= outer_b) & (e <= outer_e)


def strictly_inside(b: Column, e: Column, outer_b: Column, outer_e: Column) -> Column:
    return inside(b, e, outer_b, outer_e) & ((b != outer_b) | (e != outer_e))


def is_slice(part: Column, whole: Column) -> Column:
    """Whether an array is a contiguous part of another; an empty one is."""
    size = F.size(part)
    places = F.sequence(F.lit(1), F.greatest(F.size(whole) - size + 1, F.lit(1)))
    return (size == 0) | ((size <= F.size(whole)) & F.exists(places, lambda i: F.slice(whole, i, size) == part))


def is_strict_slice(part: Column, whole: Column) -> Column:
    return (F.size(part) < F.size(whole)) & is_slice(part, whole)


def range_forest(spans: DataFrame, by: list[str]) -> DataFrame:
    """Each distinct span with its parent: the shortest span of its group that strictly holds it, null for a root.

    A group is a sentence or a document; spans meet only within their group.
    """
    own = spans.select(*by, "b", "e").distinct()
    outer = own.select(*by, F.col("b").alias("parent_b"), F.col("e").alias("parent_e"))
    holds = strictly_inside(F.col("b"), F.col("e"), F.col("parent_b"), F.col("parent_e"))
    pairs = own.join(outer, by).where(holds)
    best = pairs.groupBy(*by, "b", "e").agg(F.min(F.struct((F.col("parent_e") - F.col("parent_b")).alias("size"), "parent_b", "parent_e")).alias("p"))
    return own.join(best, [*by, "b", "e"], "left").select(*by, "b", "e", "p.parent_b", "p.parent_e")


def maximal_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Distinct spans that no other of their group strictly holds.

    One pass: by begin, longest first, a span is held by an earlier one if and
    only if an earlier end reaches its own.
    """
    own = spans.select(*by, "b", "e").distinct()
    before = Window.partitionBy(*by).orderBy("b", F.col("e").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__reach", F.max("e").over(before)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("e"))).drop("__reach")


def within(inner: DataFrame, outer: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """Inner spans that some outer span of their group holds."""
    other = outer.select(*by, F.col("b").alias("__b"), F.col("e").alias("__e"))
    test = strictly_inside if strict else inside
    match = [inner[c] == other[c] for c in by]
    for part in (test(inner["b"], inner["e"], other["__b"], other["__e"]),):
        match.append(part)
    return inner.join(other, match, "left_semi")


def token_to_character_spans(spans: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """Spans of token ordinals as character spans, from the first and the last token; tokens: by, idx, cb, ce."""
    first = tokens.select(*by, F.col("idx").alias("b"), "cb")
    last = tokens.select(*by, (F.col("idx") + 1).alias("e"), "ce")
    return spans.join(first, [*by, "b"]).join(last, [*by, "e"])
