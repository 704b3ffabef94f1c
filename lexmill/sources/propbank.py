"""Rows of annotated predicates and their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import leading_number, tokens

# Modifiers and links of argument labels.
MODIFIERS = "ADJ ADV CAU COM DIR DIS DSP EXT GOL LOC MNR MOD NEG PNC PRD PRP PRR REC TMP LVB PRX".split()
LINKS = "PRO PSV SLC PCR".split()
_LABEL = f"^(?:(rel)|ARG([0-9]+)|ARGM-({'|'.join(MODIFIERS)})|LINK-({'|'.join(LINKS)})|(ARGA))"


def argument(word: Column) -> Column:
    """nodes (id, h) and label of ``id:height*id:height-LABEL``; a null label is none that is known."""
    nodes = F.transform(F.split(F.substring_index(word, "-", 1), r"\*"), lambda n: F.struct(leading_number(F.get(F.split(n, ":"), 0)).cast("int").alias("id"), leading_number(F.get(F.split(n, ":"), 1)).cast("int").alias("h")))
    tail = F.regexp_extract(word, "^[^-]*-(.*)$", 1)
    part = lambda i: F.nullif(F.regexp_extract(tail, _LABEL, i), F.lit(""))
    label = F.coalesce(part(1), F.concat(F.lit("ARG"), part(2)), F.concat(F.lit("ARGM-"), part(3)), F.concat(F.lit("LINK-"), part(4)), F.when(part(5).isNotNull(), F.lit("ARG0")))
    return F.struct(nodes.alias("nodes"), label.alias("label"))


def instances(rows: DataFrame, value: str = "value", with_file: bool = False, with_type: bool = True) -> DataFrame:
    """tree_id, pred_idx, annotator, type, lemma, sense and args of each row; ``with_file``: a first word names the file."""
    w = F.slice(tokens(F.col(value)), 2, 100_000) if with_file else tokens(F.col(value))
    roleset = F.get(F.col("__w"), 4 if with_type else 3)
    out = rows.withColumn("__w", w)
    kind = F.get("__w", 3) if with_type else F.lit("")
    return out.select(
        *rows.columns,
        leading_number(F.get("__w", 0)).cast("int").alias("tree_id"),
        leading_number(F.get("__w", 1)).cast("int").alias("pred_idx"),
        F.get("__w", 2).alias("annotator"),
        kind.alias("type"),
        F.substring_index(roleset, ".", 1).alias("lemma"),
        F.regexp_extract(roleset, r"^[^.]*\.(.*)$", 1).alias("sense"),
        F.transform(F.slice("__w", 7 if with_type else 6, F.greatest(F.size("__w"), F.lit(1))), argument).alias("args"),
    )


def nominal_instances(rows: DataFrame, value: str = "value") -> DataFrame:
    """tree_file, tree_id, pred_idx, lemma, sense and args."""
    out = rows.withColumn("__w", tokens(F.col(value)))
    return out.select(
        *rows.columns,
        F.get("__w", 0).alias("tree_file"),
        leading_number(F.get("__w", 1)).cast("int").alias("tree_id"),
        leading_number(F.get("__w", 2)).cast("int").alias("pred_idx"),
        F.get("__w", 3).alias("lemma"),
        leading_number(F.get("__w", 4)).cast("int").alias("sense"),
        F.transform(F.slice("__w", 6, F.greatest(F.size("__w"), F.lit(1))), argument).alias("args"),
    )
