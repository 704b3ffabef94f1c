"""Argument patterns: normalisation, merging, the lattice of patterns, statistics.

A pattern is a voice and five slots ``arg0`` to ``arg4`` of relation codes:
``NP``, ``S`` and ``SBAR`` (with ``-SBJ``, ``-1`` or ``-2``), ``PP-<prep>`` (with
``-ing``), ``ADVP``, ``ADJP``; null is an empty slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = [f"arg{i}" for i in range(5)]
GRAMMATICAL = "^(?:NP|S|SBAR)-(SBJ|1|2)$"


def grammatical_slot(code: Column) -> Column:
    """SBJ, 1 or 2; null for a relation without one."""
    return F.nullif(F.regexp_extract(code, GRAMMATICAL, 1), F.lit(""))


def relation(code: Column) -> Column:
    """kind, slot, preposition and gerund of a code."""
    parts = F.split(code, "-")
    kind = F.when(parts[0].isin("NP", "S", "SBAR", "PP", "ADVP", "ADJP"), parts[0]).otherwise(F.lit("X"))
    return F.struct(
        kind.alias("kind"),
        grammatical_slot(code).alias("slot"),
        F.when(kind == "PP", F.get(parts, 1)).alias("preposition"),
        F.when((kind == "PP") & (F.size(parts) > 1), F.coalesce(F.get(parts, 2) == "ing", F.lit(False))).alias("gerund"),
    )


def _has(slot: str) -> Column:
    return F.array_contains(F.array(*[F.coalesce(grammatical_slot(F.col(c)), F.lit("-")) for c in SLOTS]), slot)


def _active(rows: DataFrame) -> DataFrame:
    """Passive slots as active ones: a by-phrase is the subject, the subject the first object, unless there is one."""
    by, subject = F.lit("^PP-by(-ing)?$"), F.when(_has("1"), F.lit("NP")).otherwise(F.lit("NP-1"))
    passive = F.coalesce(F.col("voice") == "Passive", F.lit(False))
    changed = {c: F.when(passive & F.regexp_like(F.col(c), by), F.lit("NP-SBJ")).when(passive & (F.col(c) == "NP-SBJ"), subject).otherwise(F.col(c)) for c in SLOTS}
    return rows.withColumns(changed)


def _placed(rows: DataFrame, kind: str) -> DataFrame:
    """An unmarked relation gets the first free slot: arg0 the subject, arg1 the first or second object."""
    free0 = ~_has("SBJ") & (F.col("arg0") == kind)
    open1 = F.coalesce(F.col("arg1") == kind, F.lit(False)) & ~F.coalesce(free0, F.lit(False))
    arg1 = F.when(open1 & ~_has("1"), f"{kind}-1").when(open1 & ~_has("2"), f"{kind}-2").otherwise(F.col("arg1"))
    return rows.withColumns({"arg0": F.when(free0, f"{kind}-SBJ").otherwise(F.col("arg0")), "arg1": arg1})


def normalise(patterns: DataFrame) -> DataFrame:
    """Patterns without voice, in active form, S as SBAR, with free slots filled."""
    rows = _placed(_active(patterns), "NP")
    rows = rows.withColumns({c: F.regexp_replace(c, "^S(?=-|$)", "SBAR") for c in SLOTS})
    return _placed(rows, "SBAR").drop("voice")


def merge_patterns(patterns: DataFrame, by: list[str], count: str = "n") -> DataFrame:
    """Equal normalised patterns with their counts summed."""
    return normalise(patterns).groupBy(*by, *SLOTS).agg(F.sum(count).alias(count))


def top_patterns(merged: DataFrame, by: list[str], count: str = "n", slots: list[str] | None = None) -> DataFrame:
    """Patterns that no other of their group extends, with the counts of all patterns they extend (an empty slot fits anything)."""
    slots = slots or SLOTS
    sub = merged.select(*by, *[F.col(c).alias(f"s_{c}") for c in slots], F.col(count).alias("s_n"))
    fits = F.lit(True)
    for c in slots:
        fits = fits & (F.col(f"s_{c}").isNull() | (F.col(f"s_{c}") == F.col(c)))
    pairs = merged.join(sub, by).where(fits)
    same = F.lit(True)
    for c in slots:
        same = same & F.col(f"s_{c}").eqNullSafe(F.col(c))
    extended = pairs.where(~same).select(*by, *[F.col(f"s_{c}").alias(c) for c in slots]).distinct()
    sums = pairs.groupBy(*by, *slots).agg(F.sum("s_n").alias(count))
    matches = [sums[c].eqNullSafe(extended[c]) for c in (*by, *slots)]
    condition = matches[0]
    for m in matches[1:]:
        condition = condition & m
    return sums.join(extended, condition, "left_anti")


def upsert(patterns: DataFrame, added: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Patterns with more of them put in: a new one takes the largest count of its group, a known one is raised to it."""
    group = keys[0]
    most = patterns.groupBy(group).agg(F.max(count).alias("__most"))
    new = added.join(most, group).select(*keys, F.col("__most").alias("__new"))
    condition = F.lit(True)
    old = patterns.alias("p")
    for k in keys:
        condition = condition & F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}"))
    both = old.join(new.alias("a"), condition, "full")
    return both.select(*[F.coalesce(f"p.{k}", f"a.{k}").alias(k) for k in keys], F.greatest(F.col(count), F.col("__new")).alias(count))


def lemma_counts(rows: DataFrame, key: str, count: str) -> DataFrame:
    """Counts summed by what stands before the dot; a lemma with a count that is no number has 0."""
    number = F.when(F.col(count).rlike("^[0-9]+$"), F.col(count).cast("long"))
    return rows.groupBy(F.split(key, r"\.")[0].alias("lemma")).agg(F.when(F.bool_or(number.isNull()), F.lit(0)).otherwise(F.sum(number)).alias("n"))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """An ordinal from 1 within each group."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
