"""Tag sets, classes and their compatibility, and column predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Part-of-speech tags by what they are.
VERBS = ("VB", "VBZ", "VBP", "VBD", "VBN", "VBG")
NOUNS = ("NN", "NNS", "NNP", "NNPS", "PRP", "WP")
MAYBE_NOUNS = ("CD", "FW", "SYM")
ADJECTIVES = ("JJ", "JJR", "JJS")
ADVERBS = ("RB", "RBR", "RBS", "RP", "WRB")
WH_WORDS = ("WDT", "WP", "WP$", "WRB")
WH_PHRASES = ("WHADJP", "WHADVP", "WHNP", "WHPP")
TRACE = "-NONE-"

# Classes of items, the first being the first choice, with their ids.
ITEM_CLASSES = (
    ("Other", 35120),
    ("Organization", 43229),
    ("Person", 215627),
    ("Location", 1496967),
    ("Brand", 431289),
    ("Occupation", 12737077),
    ("HumanRule", 1151067),
    ("Building", 41176),
)
#: Class of a recognised name -> the one class of items it may mean; a class that is not here means none.
MAY_MEAN = {"Org": "Organization", "Person": "Person", "Loc": "Location", "Date": "HumanRule", "Time": "HumanRule", "Money": "HumanRule"}
#: These may mean items of any class.
ANY_CLASS = ("Other", "Misc")
NAME_CLASSES = {
    "PERSON": "Person",
    "ORGANIZATION": "Org",
    "LOCATION": "Loc",
    "MISC": "Misc",
    "TIME": "Time",
    "DATE": "Date",
    "MONEY": "Money",
    "PERCENT": "Percent",
    "NUMBER": "MiscNum",
    "ORDINAL": "MiscNum",
    "DURATION": "MiscNum",
    "O": "Other",
    "SET": "Misc",
}


def is_verb(tag: Column) -> Column:
    return tag.isin(*VERBS)


def is_noun(tag: Column) -> Column:
    """True, false, or null where it is unclear."""
    return F.when(tag.isin(*MAYBE_NOUNS), F.lit(None).cast("boolean")).otherwise(tag.isin(*NOUNS))


def is_adjective(tag: Column) -> Column:
    return tag.isin(*ADJECTIVES)


def is_adverb(tag: Column) -> Column:
    return tag.isin(*ADVERBS)


def is_wh_word(tag: Column) -> Column:
    return tag.isin(*WH_WORDS)


def is_wh_phrase(tag: Column) -> Column:
    return tag.isin(*WH_PHRASES)


def is_trace(tag: Column) -> Column:
    return tag == TRACE


def is_linkable(tag: Column) -> Column:
    """A clear noun that is no personal pronoun."""
    return F.coalesce(is_noun(tag), F.lit(False)) & (tag != "PRP")


def has_linkable(tags: Column, b: Column, e: Column) -> Column:
    """Whether the span ``[b, e)`` of an array of tags has a linkable one."""
    return F.exists(F.slice(tags, b + 1, e - b), is_linkable)


def name_class(tag: Column) -> Column:
    """Class of a recogniser's tag; null for an unknown one."""
    return _lookup(tag, NAME_CLASSES)


def _lookup(column: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def may_cite(name: Column, item: Column) -> Column:
    """Whether a name of this class may mean an item of that class."""
    return name.isin(*ANY_CLASS) | F.coalesce(_lookup(name, MAY_MEAN) == item, F.lit(False))


def priorities(spark: SparkSession) -> DataFrame:
    """cls, prio: the classes in order of choice."""
    return spark.createDataFrame([(c, i) for i, (c, _) in enumerate(ITEM_CLASSES)], "cls string, prio int")
