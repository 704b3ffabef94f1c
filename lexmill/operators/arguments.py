"""Argument patterns of annotated verbs: what kind of phrase each argument is, and which place of the clause it has.

An argument is given as in annotated corpora, by a word and how many steps above it
the phrase stands. The kind comes from the phrase and its head word, the place from
the clause of the verb; the codes are those of ``operators.lexicon``, so patterns go
straight into ``lexicon.merge_patterns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tags import ADVERBS, NOUNS, TRACE
from lexmill.operators.lexicon import SLOTS
from lexmill.operators.outlines import filled, worded
from lexmill.operators.sentences import after, at, extended, first_id, found, is_phrase, is_word, nodes_where, parent, stage
from lexmill.plans.shared import written


def _head_preposition(x: Column) -> Column:
    """The first preposition among the children of a phrase."""
    return found("n", lambda y: (y["parent"] == x["id"]) & is_word(y, "IN", "TO"))


def _code(a: Column) -> Column:
    x, prep, adverb, place = a["node"], a["prep"], a["adverb"], a["place"]
    word = F.lower(prep["word"])
    gerund = is_phrase(at(first_id(after(prep))), "S")
    placed = lambda kind: F.concat(F.lit(kind), F.coalesce(F.concat(F.lit("-"), place), F.lit("")))
    return (
        F.when(is_phrase(x, "PP") & prep["id"].isNotNull(), F.concat(F.lit("PP-"), word, F.when(gerund, "-ing").otherwise("")))
        .when(is_phrase(x, "PP"), "PP")
        .when(is_phrase(x, "ADVP") & (adverb["id"].isNotNull() | prep["id"].isNotNull()), F.concat(F.lit("ADVP-"), F.lower(F.coalesce(adverb["word"], prep["word"]))))
        .when(is_phrase(x, "PRT"), F.coalesce(F.concat(F.lit("PP-"), F.lower(adverb["word"])), F.lit("PP")))
        .when(is_phrase(x, "NP", "WHNP") | is_word(x, *NOUNS), placed("NP"))
        .when(is_phrase(x, "S"), placed("S"))
        .when(is_phrase(x, "SBAR"), placed("SBAR"))
        .otherwise(F.concat(F.lit("??("), x["tag"], F.lit(")")))
    )


def argument_codes(rows: DataFrame, arguments: DataFrame) -> DataFrame:
    """sent_id, verb_idx, label, voice, b, e, code. rows: as ``clauses.analysed``; arguments: sent_id, verb_idx, label, idx, h (steps above the word).

    Places count the complements of the verb's clause that are no traces; a verb
    without a clause gives no place and no voice. A trace is judged by its phrase; an
    argument whose phrase is not in the tree is left out.
    """
    return _codes(rows.select("sent_id", "n", "clauses").join(_asked(arguments), "sent_id"))


def _asked(arguments: DataFrame) -> DataFrame:
    return arguments.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("verb_idx", "label", "idx", "h"))).alias("asked"))


def _codes(rows: DataFrame) -> DataFrame:
    """As ``argument_codes``. rows: sent_id, n, clauses, asked."""
    above = lambda a: nodes_where(lambda y: (y["b"] <= a["idx"]) & (y["e"] >= a["idx"]))
    rows = stage(rows, _a1=extended("asked", path=above))
    rows = stage(rows, _a2=extended("_a1", named=lambda a: F.get(a["path"], F.size(a["path"]) - 1 - a["h"]), clause=lambda a: found("clauses", lambda c: at(c["verb"]["id"])["b"] == a["verb_idx"])))
    rows = stage(rows, _a3=F.filter(extended("_a2", node=lambda a: F.when(is_word(a["named"], TRACE), parent(a["named"])).otherwise(a["named"])), lambda a: a["node"]["id"].isNotNull()))

    def place(a: Column) -> Column:
        same = lambda p: (p["b"] == a["node"]["b"]) & (p["e"] == a["node"]["e"])
        spoken = F.filter(a["clause"]["comps"], lambda p: p["kind"] != "trace")
        number = F.array_position(F.transform(spoken, lambda p: F.coalesce(same(p), F.lit(False))), F.lit(True))
        subject = a["clause"]["subject"]
        return F.when((subject["kind"] == "DP") & same(subject), "SBJ").when(number == 1, "1").when(number == 2, "2")

    adverb = lambda a: F.element_at(F.filter("n", lambda y: (y["parent"] == a["node"]["id"]) & is_word(y, *ADVERBS)), -1)
    some = lambda a: F.exists("n", lambda y: (y["parent"] == a["node"]["id"]) & is_word(y, *ADVERBS))
    rows = stage(rows, _a4=extended("_a3", prep=lambda a: _head_preposition(a["node"]), adverb=lambda a: F.when(some(a), adverb(a)), place=place))
    code = lambda a: F.struct(a["verb_idx"].alias("verb_idx"), a["label"].alias("label"), a["clause"]["verb"]["voice"].alias("voice"), a["named"]["b"].alias("b"), a["named"]["e"].alias("e"), _code(a).alias("code"))
    return written(stage(rows, _codes=F.transform("_a4", code)).select("sent_id", F.inline("_codes")), "codes")


def argument_patterns(codes: DataFrame) -> DataFrame:
    """sent_id, verb_idx, voice, arg0 to arg4: one row a verb; of an argument given twice the first by place."""
    first = [F.min(F.when(F.col("label") == s, F.struct("b", "e", "code")))["code"].alias(s) for s in SLOTS]
    return codes.groupBy("sent_id", "verb_idx").agg(F.max("voice").alias("voice"), *first)


def patterns_of_sentences(rows: DataFrame, bound: DataFrame, arguments: DataFrame) -> DataFrame:
    """As ``argument_patterns`` of the codes of all sentences; sentences of one outline with the same arguments are looked at once. rows, bound: as of ``clauses.analysed_outlines``."""
    each = rows.select("sent_id", "outline", F.col("n.word").alias("words")).join(_asked(arguments), "sent_id")
    each = written(each.withColumn("kind", F.sha2(F.to_json(F.struct("outline", "asked")), 256)), "asked")
    kinds = each.select("kind", "outline", "asked").distinct().join(bound.select("outline", worded().alias("n"), "clauses"), "outline")
    codes = _codes(kinds.select(F.col("kind").alias("sent_id"), "n", "clauses", "asked"))
    listed = [F.collect_list(F.when(F.col("label") == s, F.struct("b", "e", "code"))).alias(s) for s in SLOTS]
    found = written(codes.groupBy("sent_id", "verb_idx").agg(F.max("voice").alias("voice"), *listed).withColumnRenamed("sent_id", "kind"), "kinds")
    own = lambda x: x.withField("code", F.when(x["code"].startswith("??("), x["code"]).otherwise(filled(x["code"], change=F.lower)))
    first = [F.array_min(F.transform(s, own))["code"].alias(s) for s in SLOTS]
    return each.select("sent_id", "kind", "words").join(found, "kind").select("sent_id", "verb_idx", "voice", *first)
