"""Meaning graphs as tables, frame scores, senses.

``vertices``: sent_id, id, kind (``predicate``, ``nominal``, ``entity``, ``preposition``), b, e, text, frame.
``links``: sent_id, rel, is_modifier, prep, src, dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import american

# Roles that are subjects whatever the frame; the weight of a matched role.
SUBJECT_ROLES = ("Agent", "Speaker", "Owner", "Cognizer", "Actor", "Author", "Cognizer_agent", "Protagonist", "Cause", "Instance", "Figure")
ROLE_WEIGHT = 100.0


def predicate_counts(vertices: DataFrame) -> DataFrame:
    """sent_id, predicates (verbs and nominals), verbs."""
    kind = F.col("kind")
    return vertices.groupBy("sent_id").agg(F.count_if(kind.isin("predicate", "nominal")).alias("predicates"), F.count_if(kind == "predicate").alias("verbs"))


def directed(links: DataFrame) -> DataFrame:
    """sent_id, src, dst; a modifier's edge runs the other way."""
    turned = F.col("is_modifier")
    return links.select("sent_id", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def forward_links(links: DataFrame) -> DataFrame:
    return links.select("sent_id", F.col("src").alias("id"), F.col("dst").alias("other"))


def backward_links(links: DataFrame) -> DataFrame:
    """Incoming edges of modifiers."""
    return links.where("is_modifier").select("sent_id", F.col("dst").alias("id"), F.col("src").alias("other"))


def label(vertices: DataFrame) -> DataFrame:
    """sent_id, id, label: the frame of a predicate, else the text."""
    return vertices.select("sent_id", "id", F.when(F.col("kind").isin("predicate", "nominal"), F.coalesce("frame", "text")).otherwise(F.col("text")).alias("label"))


def tagged(vertices: DataFrame, tags: DataFrame) -> DataFrame:
    """Vertices with the tags whose span lies in theirs. tags: sent_id, b, e, tag."""
    inside = tags.select("sent_id", F.col("b").alias("tb"), F.col("e").alias("te"), "tag")
    lists = vertices.select("sent_id", "id", "b", "e").join(inside, "sent_id").where("tb >= b and te <= e").groupBy("sent_id", "id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return vertices.join(lists, ["sent_id", "id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def escaped(text: Column) -> Column:
    """``&`` as an entity, for graph text."""
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def numbered_vertices(*kinds: DataFrame) -> DataFrame:
    """Predicates, nominals, entities and prepositions, numbered from 1 within a sentence in this order, then by span; equal entities once."""
    every = kinds[0].withColumn("__k", F.lit(0))
    for i, rows in enumerate(kinds[1:], 1):
        every = every.unionByName(rows.withColumn("__k", F.lit(i)))
    once = every.dropDuplicates(["sent_id", "kind", "b", "e", "text"])
    number = F.row_number().over(Window.partitionBy("sent_id").orderBy("__k", "b", "e", "text"))
    return once.withColumn("id", number).drop("__k")


def is_subject(role: Column, agents: Column) -> Column:
    """A role that is a subject by itself, or that the sense's role map has as arg0 or arg1 (``agents``: those two)."""
    return role.isin(*SUBJECT_ROLES) | F.coalesce(F.array_contains(agents, role), F.lit(False))


def frame_score(matched: Column, count: Column, total: Column) -> Column:
    """How well a frame fits: by the share of its pattern's count and the roles matched; 0 without any count."""
    return F.when(total > 0, matched * count / total * ROLE_WEIGHT + matched * total).otherwise(F.lit(0.0))


def best_pattern(matches: DataFrame, by: list[str]) -> DataFrame:
    """The match with the most roles, then the highest count; of equal ones the first by pattern. None: no row."""
    order = Window.partitionBy(*by).orderBy(F.col("roles").desc(), F.col("n").desc(), "pattern")
    return matches.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def intransitive_or_causative(plain: DataFrame, causative: DataFrame, by: list[str]) -> DataFrame:
    """The reading with more matched roles; equal ones: the intransitive."""
    both = plain.withColumn("reading", F.lit(0)).unionByName(causative.withColumn("reading", F.lit(1)))
    order = Window.partitionBy(*by).orderBy(F.col("roles").desc(), "reading")
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def causative_roles(maps: DataFrame, duals: DataFrame) -> DataFrame:
    """Role maps with the causative frame of each dual (frame, causative, role, prio), the first of equal frames."""
    first = duals.withColumn("__n", F.row_number().over(Window.partitionBy("frame").orderBy("prio"))).where("__n = 1").drop("__n", "prio")
    return maps.join(first, "frame", "left")


def verb_senses(verbs: DataFrame, senses: DataFrame, idioms: DataFrame) -> DataFrame:
    """Senses of each verb: those whose idiom the following lemmas begin with; without any, all its senses without an idiom rule.

    verbs: verb_id, lemma, following (lemmas); senses: lemma, sense; idioms: lemma, sense, idiom (lemmas).
    """
    base = verbs.withColumn("lemma", american(F.col("lemma")))
    starts = F.slice("following", 1, F.size("idiom")) == F.col("idiom")
    hit = base.join(idioms, "lemma").where(starts).select("verb_id", "lemma", "sense", F.col("idiom")).distinct()
    rest = base.join(hit.select("verb_id").distinct(), "verb_id", "left_anti").join(senses, "lemma").select("verb_id", "lemma", "sense", F.array().cast("array<string>").alias("idiom"))
    return hit.unionByName(rest)


def sense_table(senses: DataFrame, counts: DataFrame, frames: DataFrame) -> DataFrame:
    """lemma, sense, definition, n (0 without a count), frame; codes that name no frame are left as ``None``-words."""
    out = senses.join(counts, ["lemma", "sense"], "left").join(frames, ["lemma", "sense"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def preposition_roles(phrases: DataFrame, table: DataFrame) -> DataFrame:
    """Frame and roles of each prepositional phrase. table: prep, frame, role0, role1, prio; the first of equal prepositions."""
    first = table.withColumn("__n", F.row_number().over(Window.partitionBy("prep").orderBy("prio"))).where("__n = 1").drop("__n", "prio")
    return phrases.join(first, "prep", "left")


def nominal_verbs(nouns: DataFrame, derivations: DataFrame) -> DataFrame:
    """noun, verb: verbs from which nouns are derived. derivations: word, pos, to_word, to_pos."""
    links = derivations.where("pos = 'n' and to_pos = 'v'").select(F.col("word").alias("noun"), F.col("to_word").alias("verb"))
    return nouns.join(links, "noun").distinct()


def has_complementizer(complementizer: Column, words: list[str]) -> Column:
    """Whether a clause's complementizer is one of the words; an empty one is none."""
    return F.coalesce(complementizer.isin(words), F.lit(False))


def is_to_infinitive(auxiliaries: Column) -> Column:
    """Whether the first auxiliary (lemmas) is ``to``."""
    return F.coalesce(F.get(auxiliaries, 0) == "to", F.lit(False))


def is_empty_or_that(complementizer: Column) -> Column:
    return F.coalesce(complementizer, F.lit("that")) == "that"


def last_of_group(words: Column) -> Column:
    """The head of a verb group, its last word; null for an empty one."""
    return F.try_element_at(words, F.lit(-1))


def tags_of_sentences(tags: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tags that lie in a sentence, their spans counted from its first token. tags: doc_id, b, e, ...; sentences: doc_id, sent_id, sb, se."""
    held = tags.join(sentences, "doc_id").where("sb <= b and e <= se")
    return held.withColumns({"b": F.col("b") - F.col("sb"), "e": F.col("e") - F.col("sb")}).drop("sb", "se")
