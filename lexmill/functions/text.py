"""Column functions for text, ids and tags. White space is ``[ \\t\\n\\r]``; nothing depends on a locale."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r]+"
#: Bytes of terms that are looked for in one pass over the texts.
TERM_BYTES = 32_000_000


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def item_id(text: Column, letter: str = "Q", any_case: bool = False) -> Column:
    """The number of an id like ``Q42``; null if the text is not one."""
    first = f"[{letter.upper()}{letter.lower()}]" if any_case else letter
    found = F.regexp_extract(text, f"^{first}([0-9]+)$", 1)
    return F.when(found != "", found.cast("long"))


def leading_number(text: Column) -> Column:
    """Leading decimal digits as a number, whatever follows; null without one."""
    found = F.regexp_extract(text, "^([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def hexadecimal(text: Column) -> Column:
    """Leading hexadecimal digits as a number; null without one."""
    found = F.regexp_extract(text, "^([0-9a-fA-F]+)", 1)
    return F.when(found != "", F.conv(found, 16, 10).cast("long"))


def null_word(text: Column) -> Column:
    """The word ``null`` as null."""
    return F.nullif(text, F.lit("null"))


def plain_tag(tag: Column) -> Column:
    """A tag without its function marks: what stands before ``-`` or ``=``; tags that begin with ``-`` stay whole."""
    return F.when(tag.startswith("-"), tag).otherwise(F.regexp_extract(tag, "^([^-=]*)", 1))


def link_ids(tag: Column) -> Column:
    """The trailing numeric parts of a tag like ``NP-SBJ-1-2``."""
    tail = F.regexp_extract(tag, r"((?:-[0-9]+)*)$", 1)
    return F.transform(F.array_remove(F.split(tail, "-", -1), ""), lambda x: x.cast("int"))


def token_and_tag(token: Column) -> Column:
    """``word/TAG``, split at the last slash."""
    return F.struct(F.regexp_extract(token, "(?s)^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(token, "(?s)^(.*)/([^/]*)$", 2).alias("tag"))


def wordnet_id(text: Column) -> Column:
    """``synset-<name>-<pos>-<n>``, taken apart from the right."""
    form = "^synset-(.+)-([a-z]+)-([0-9]+)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("name"), F.regexp_extract(text, form, 2).alias("pos"), F.regexp_extract(text, form, 3).cast("int").alias("n")))


def name_with_number(text: Column) -> Column:
    """``name_<id>``, taken apart from the right."""
    form = "^(.*)_([0-9]+)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("name"), F.regexp_extract(text, form, 2).alias("id")))


def american(verb: Column) -> Column:
    """-ise becomes -ize in verbs of more than five letters."""
    return F.when((F.length(verb) > 5) & verb.endswith("ise"), F.concat(F.substring(verb, 1, F.length(verb) - 3), F.lit("ize"))).otherwise(verb)


def padded(text: Column, width: int = 4) -> Column:
    return F.rpad(text, width, " ")


def dated(text: Column) -> Column:
    """``MM/dd/yyyy HH:mm:ss zone weekday`` as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, " [A-Za-z]{3}$", ""), F.lit("MM/dd/yyyy HH:mm:ss z"))


def sense_number(lemma: Column, number: Column) -> Column:
    """Sense numbers get the group ``1.``, but for one sense of one verb."""
    return F.when((lemma == "hold") & (number == "5"), F.concat(F.lit("2."), number)).otherwise(F.concat(F.lit("1."), number))


def role_map(fields: Column) -> Column:
    """``key:value`` words as a map."""
    return F.map_from_entries(F.transform(fields, lambda w: F.struct(F.split(w, ":")[0], F.split(w, ":")[1])))


def link_targets(html: Column) -> Column:
    """The targets of all ``href="..."``."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def contains_term(text: Column, term: Column) -> Column:
    return F.contains(text, term)


def containing(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key, term: every text with every one of the terms (column ``term``) that it contains.

    The terms become an automaton, so a text is read once, however many there
    are. Their size is checked: beyond ``TERM_BYTES`` they are dealt by hash, and
    each share takes another pass.
    """
    import ahocorasick

    known = terms.where(F.length("term") > 0).select("term").distinct()
    size = known.agg(F.sum(F.octet_length("term")).alias("n")).first()["n"] or 0
    schema = docs.select(F.col(f"`{key}`")).schema.add("term", "string")
    passes = int(size) // TERM_BYTES + 1
    found = None
    for share in range(passes):
        own = [r["term"] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == share).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def look(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for term in shared.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                at, hits = [], []
                for i, value in enumerate(batch.column(1)):
                    for term in sorted({t for _, t in automaton.iter(value.as_py() or "")}) if shared.value else ():
                        at.append(i)
                        hits.append(term)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=[key, "term"])

        part = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(look, schema)
        found = part if found is None else found.unionByName(part)
    return found
