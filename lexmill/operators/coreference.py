"""Pronouns and definite phrases traced to the subject of a clause near them.

clauses: sent_id, clause_id, parent_id, topic_id (of the clause that stands before
as its topic), subject_b, subject_e, subject_class (null: none is known); phrases:
sent_id, phrase_id, clause_id of the clause around it, and the columns named below.
Of the subjects that fit, that of the first place counts. All joins are on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The class that a pronoun's antecedent must have, and the one phrase that is traced.
ANTECEDENTS = {"He": "Person", "She": "Person", "It": "Org"}
COMPANY = "company"


def _subjects(phrases: DataFrame, clauses: DataFrame, places: list[Column], wanted: Column) -> DataFrame:
    """sent_id, phrase_id, b, e of the first place (a clause id, or null) whose clause has a subject of the wanted class."""
    around = phrases.withColumn("__class", wanted).join(clauses.select("sent_id", "clause_id", "parent_id", "topic_id"), ["sent_id", "clause_id"])
    each = around.select("sent_id", "phrase_id", "__class", F.posexplode(F.array(*places)).alias("place", "clause_id")).where("clause_id is not null")
    subjects = clauses.select("sent_id", "clause_id", "subject_b", "subject_e", F.col("subject_class").alias("__class"))
    found = each.join(subjects, ["sent_id", "clause_id", "__class"])
    return found.groupBy("sent_id", "phrase_id").agg(F.min_by(F.struct("subject_b", "subject_e"), "place").alias("s")).select("sent_id", "phrase_id", F.col("s.subject_b").alias("b"), F.col("s.subject_e").alias("e"))


def pronouns(phrases: DataFrame, clauses: DataFrame) -> DataFrame:
    """phrases: person, genitive. A genitive looks at its own clause first; then come the parent and the topic."""
    own = F.when(F.col("genitive"), F.col("clause_id"))
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for pair in ANTECEDENTS.items() for x in pair]), F.col("person"))
    return _subjects(phrases, clauses, [own, F.col("parent_id"), F.col("topic_id")], wanted)


def definites(phrases: DataFrame, clauses: DataFrame) -> DataFrame:
    """phrases: article, noun (words). ``the company`` is the organisation that is the subject of the parent or of the topic."""
    asked = phrases.where((F.col("article") == "Definite") & (F.col("noun") == F.array(F.lit(COMPANY))))
    return _subjects(asked, clauses, [F.col("parent_id"), F.col("topic_id")], F.lit("Org"))


def definite_genitives(phrases: DataFrame, clauses: DataFrame) -> DataFrame:
    """phrases: owner, the text before a genitive clitic (null: none). ``the company`` is the organisation that is the subject of its own clause."""
    return _subjects(phrases.where(F.col("owner") == f"the {COMPANY}"), clauses, [F.col("clause_id")], F.lit("Org"))
