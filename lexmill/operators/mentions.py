"""Mentions: merging of recognised names with dictionary hits, resolution, linking, filtering.

A mention is (doc_id, b, e) with a state: ``resolved`` (one item, its class),
``ambiguous`` (several items), ``unresolved_uid`` (a recognised name without an
item) or ``unresolved_class`` (items without a recognised name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tags import has_linkable, may_cite, priorities
from lexmill.operators.joins import by_priority
from lexmill.operators.sentences import stage
from lexmill.operators.spans import is_strict_slice

NAME, HIT = "struct<b: bigint, e: bigint, ne: string>", "struct<b: bigint, e: bigint, uids: array<bigint>>"
KEPT = "struct<b: bigint, e: bigint, ne: string, uids: array<bigint>>"


def _kept(span: Column, ne: Column, uids: Column) -> Column:
    return F.struct(span["b"].alias("b"), span["e"].alias("e"), ne.alias("ne"), uids.alias("uids")).cast(KEPT)


def _sweep(names: Column, hits: Column) -> Column:
    """Where a walk along two ordered lists of spans ends, and what it has kept: i, j, out."""
    none = F.lit(None)

    def past(rows: Column, at: Column, span: Column) -> Column:
        """The first place from ``at`` on whose span begins where another has ended."""
        return F.greatest(at, F.size(F.filter(rows, lambda r: r["b"] < span["e"])))

    def step(now: Column, _: Column) -> Column:
        i, j = now["i"], now["j"]
        left, right = F.get(names, i), F.get(hits, j)
        before, after = left["e"] <= right["b"], right["e"] <= left["b"]
        same = (left["b"] == right["b"]) & (left["e"] == right["e"])
        holds = (left["b"] <= right["b"]) & (right["e"] <= left["e"])
        held = (right["b"] <= left["b"]) & (left["e"] <= right["e"])
        first = left["b"] < right["b"]
        keeps = before | (~after & (same | holds | (~held & first)))
        kept = F.when(keeps, _kept(left, left["ne"], F.when(same & ~before & ~after, right["uids"]))).otherwise(_kept(right, none, right["uids"]))
        wins = holds | (~held & ~first)
        to_i = F.when(before, i + 1).when(after, i).when(same | wins, i + 1).otherwise(past(names, i + 1, right))
        to_j = F.when(before, j).when(after | same, j + 1).when(wins, past(hits, j + 1, left)).otherwise(j + 1)
        ended = (i >= F.size(names)) | (j >= F.size(hits))
        moved = F.struct(to_i.alias("i"), to_j.alias("j"), F.concat(now["out"], F.array(kept)).alias("out"))
        return F.when(ended, now).otherwise(moved)

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.expr(f"cast(array() as array<{KEPT}>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(names) + F.size(hits)), start, step)


def merge(names: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, b, e, ne, uids: equal spans join, an outer span beats an inner one, of two that overlap the earlier stays.

    names: doc_id, b, e, ne; found: doc_id, b, e, uids. What a kept span beats is
    skipped up to the first span that lies wholly after it. The spans of a document
    are two lists of one row; the walk along them is a fold of columns.
    """
    left = names.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("b", "e", "ne").cast(NAME))).alias("names"))
    right = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("b", "e", "uids").cast(HIT))).alias("hits"))
    both = left.join(right, "doc_id", "full")
    listed = both.select("doc_id", F.coalesce("names", F.expr(f"cast(array() as array<{NAME}>)")).alias("names"), F.coalesce("hits", F.expr(f"cast(array() as array<{HIT}>)")).alias("hits"))
    walked = stage(listed, walk=_sweep(F.col("names"), F.col("hits")))
    rest = lambda rows, at: F.slice(rows, at + 1, F.size(rows))
    names_left = F.transform(rest(F.col("names"), F.col("walk.i")), lambda x: _kept(x, x["ne"], F.lit(None)))
    hits_left = F.transform(rest(F.col("hits"), F.col("walk.j")), lambda x: _kept(x, F.lit(None), x["uids"]))
    return walked.select("doc_id", F.inline(F.concat("walk.out", names_left, hits_left)))


def resolve(merged: DataFrame, item_classes: DataFrame) -> DataFrame:
    """Adds state, cls and the candidates left: items whose class the recognised class may mean. item_classes: qid, cls."""
    spark = merged.sparkSession
    first = by_priority(item_classes, "qid", "cls", priorities(spark))
    extended = item_classes.where(F.col("cls").isin("Brand", "Occupation", "HumanRule", "Building")).select("qid").distinct().withColumn("special", F.lit(True))
    named = F.when(F.col("ne") == "Org", "Organization").when(F.col("ne") == "Person", "Person").when(F.col("ne") == "Loc", "Location").otherwise("Other")
    each = merged.select("doc_id", "b", "e", "ne", F.posexplode("uids").alias("ord", "qid")).withColumn("named", named)
    own = each.join(item_classes.distinct().withColumn("has", F.lit(True)).withColumnRenamed("cls", "named"), ["qid", "named"], "left")
    own = own.join(first, "qid", "left").join(extended, "qid", "left")
    tagged = F.when(F.col("ne") == "Other", F.coalesce("special", F.lit(False))).otherwise(F.coalesce("has", F.lit(False)))
    cls = F.when(F.col("ne").isNotNull() & tagged, F.col("named")).otherwise(F.coalesce("cls", F.lit("Other")))
    fits = own.select("doc_id", "b", "e", "ord", "qid", "ne", cls.alias("cls")).where(F.col("ne").isNull() | may_cite(F.col("ne"), F.col("cls")))
    left = fits.groupBy("doc_id", "b", "e").agg(F.sort_array(F.collect_list(F.struct("ord", "qid", "cls")), asc=False).alias("c"))
    out = merged.join(left, ["doc_id", "b", "e"], "left").withColumn("c", F.coalesce("c", F.array().cast(left.schema["c"].dataType)))
    state = (
        F.when(F.col("uids").isNull() | (F.col("ne").isNotNull() & (F.size("c") == 0)), "unresolved_uid")
        .when(F.size("c") == 1, "resolved")
        .when(F.col("ne").isNull(), "unresolved_class")
        .otherwise("ambiguous")
    )
    return out.select("doc_id", "b", "e", "ne", state.alias("state"), F.when(state == "resolved", F.col("c")[0]["cls"]).alias("cls"), F.transform(F.when(F.col("ne").isNull(), F.reverse("c")).otherwise(F.col("c")), lambda x: x["qid"]).alias("uids"))


def link(mentions: DataFrame) -> DataFrame:
    """Adds ref: the ordinal of the earliest resolved mention before it whose words strictly hold the mention's and whose class fits.

    mentions: doc_id, ord, words, state, ne, cls. Strict containment and order
    are transitive, so looking only at the first resolved mentions is exact.
    """
    targets = mentions.where("state = 'resolved'").select("doc_id", F.col("ord").alias("t_ord"), F.col("words").alias("t_words"), F.col("cls").alias("t_cls"))
    sources = mentions.where("state <> 'resolved' or ne is not null")
    fits = (F.col("ord") > F.col("t_ord")) & is_strict_slice(F.col("words"), F.col("t_words")) & (F.col("ne").isNull() | may_cite(F.col("ne"), F.col("t_cls")))
    best = sources.join(targets, "doc_id").where(fits).groupBy("doc_id", "ord").agg(F.min("t_ord").alias("ref"))
    return mentions.join(best, ["doc_id", "ord"], "left")


def with_noun(mentions: DataFrame, tags: Column, b: Column, e: Column) -> DataFrame:
    """Mentions whose span has a linkable tag."""
    return mentions.where(has_linkable(tags, b, e))
