"""Column functions for the labels of annotated corpora: look-ups in fixed lists, and labels taken apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pronouns by person, articles by definiteness.
PERSONS = {
    "I": "I me my mine",
    "You": "you your yours",
    "He": "he him his",
    "She": "she her hers",
    "It": "it its",
    "They": "they them their theirs",
}
ARTICLES = {"Definite": "the", "Indefinite": "a an"}

# Modifiers and links of argument labels.
MODIFIERS = "ADJ ADV CAU COM DIR DIS DSP EXT GOL LOC MNR MOD NEG PNC PRD PRP PRR REC TMP LVB PRX"
LINKS = "PRO PSV SLC PCR"

# One-letter word classes, word classes of synsets, and how much a frame needs an element.
WORD_CLASSES = {"n": "noun", "v": "verb", "a": "adjective", "r": "adverb"}
SYNSET_CLASSES = WORD_CLASSES | {"s": "adjective satellite"}
CORE_TYPES = {"Core": "Core", "Peripheral": "Peripheral", "Extra-Thematic": "ExtraThematic", "Core-Unexpressed": "CoreUnexpressed"}

# Dependency relations.
RELATIONS = (
    "acl advcl advmod amod appos aux auxpass case cc ccomp clf compound conj cop csubj csubjpass dep det discourse dislocated dobj expl fixed flat goeswith "
    "iobj list mark mwe neg nmod nsubj nsubjpass nummod obj obl orphan parataxis punct reparandum root vocative xcomp"
)


def looked_up(value: Column, table: Mapping[str, str]) -> Column:
    """The entry of ``value`` in a fixed table; null for all others."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, value)


def _by_word(groups: Mapping[str, str]) -> dict[str, str]:
    return {word: name for name, words in groups.items() for word in words.split()}


def pronoun_person(word: Column) -> Column:
    """Person of a pronoun, as it is written; null for other words."""
    return looked_up(word, _by_word(PERSONS))


def article(word: Column) -> Column:
    return looked_up(word, _by_word(ARTICLES))


def word_class(letter: Column) -> Column:
    return looked_up(letter, WORD_CLASSES)


def synset_class(letter: Column) -> Column:
    return looked_up(letter, SYNSET_CLASSES)


def core_type(value: Column) -> Column:
    return looked_up(value, CORE_TYPES)


def boolean(value: Column) -> Column:
    """``true`` and ``false``; null for all else."""
    return F.when(value.isin("true", "false"), value == "true")


def roleset(value: Column) -> Column:
    """``lemma.sense``: up to the first stop, then up to a blank; null without a stop."""
    form = r"^([^.]*)\.([^ ]*)"
    return F.when(F.contains(value, F.lit(".")), F.struct(F.regexp_extract(value, form, 1).alias("lemma"), F.regexp_extract(value, form, 2).alias("sense")))


def argument_label(value: Column) -> Column:
    """kind and value of ``rel``, ``ARG<n>``, ``ARGM-<modifier>``, ``LINK-<link>`` and ``ARGA`` (argument 0); null for others. What follows is not looked at."""
    number, modifier, link = (F.regexp_extract(value, form, 1) for form in (r"^ARG([0-9]+)", f"^ARGM-({MODIFIERS.replace(' ', '|')})", f"^LINK-({LINKS.replace(' ', '|')})"))

    def found(kind: str, own: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), own.alias("value"))

    rules = F.when(value.startswith("rel"), found("relation", F.lit(None).cast("string"))).when(number != "", found("argument", F.regexp_replace(number, "^0+(?=[0-9])", "")))
    return rules.when(modifier != "", found("modifier", modifier)).when(link != "", found("link", link)).when(value.startswith("ARGA"), found("argument", F.lit("0")))


def label_text(label: Column) -> Column:
    """An ``argument_label`` as text."""
    kind, value = label["kind"], label["value"]
    return F.when(kind == "relation", F.lit("rel")).when(kind == "argument", F.concat(F.lit("ARG"), value)).when(kind == "modifier", F.concat(F.lit("ARGM-"), value)).when(kind == "link", F.concat(F.lit("LINK-"), value))


def span_text(text: Column, b: Column, e: Column) -> Column:
    """Characters ``b`` to ``e``, both counted from 1 and included."""
    return F.substring(text, b, e - b + 1)


def is_time_at(b: Column, e: Column, mark: Column, first: Column, last: Column) -> Column:
    """Whether a tagged span ``[b, e)`` is a time and covers exactly the words ``first`` to ``last``."""
    return (mark == "MarkTime") & (b == first) & (e - 1 == last)


def dependency_relation(value: Column) -> Column:
    """A relation of the fixed list; null for any other, subtypes included."""
    return F.when(value.isin(*RELATIONS.split()), value)
