"""Text of trees, patterns, senses and verbs as column expressions. Pads never cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Short names of tense, aspect and voice.
TENSES = {"Present": "Pres", "Past": "Past"}
ASPECTS = {"Simple": "Smpl", "Progressive": "Prog", "Perfect": "Perf", "PerfectProgressive": "PfPr"}
VOICES = {"Active": "Actv", "Passive": "Pass"}
# Marks whose leaf shows the tag for a word, by the blanks between the two.
MARKS = {".": 5, ",": 5, "!": 5, "?": 5, "``": 3, "''": 3}

_RULE = "=" * 76


def before(text: Column, width: int) -> Column:
    """Blanks before a text, up to the width."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0))), text)


def after(text: Column, width: int) -> Column:
    """Blanks after a text, up to the width."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0))))


def _or(text: Column, missing: str) -> Column:
    return F.coalesce(text.cast("string"), F.lit(missing))


def _short(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def relation_text(relation: Column) -> Column:
    """The code of a ``lexicon.relation``; an unknown one is ``??(X)``."""
    kind, slot, word = relation["kind"], relation["slot"], relation["preposition"]
    phrase = F.concat(F.lit("PP"), F.coalesce(F.concat(F.lit("-"), word, F.when(relation["gerund"], "-ing").otherwise("")), F.lit("")))
    own = F.concat(kind, F.coalesce(F.concat(F.lit("-"), slot), F.lit("")))
    return F.when(kind == "PP", phrase).when(kind == "X", F.lit("??(X)")).otherwise(own)


def pattern_text(name: Column, voice: Column, slots: list[Column]) -> Column:
    """A pattern in fixed columns; a missing voice is ``unidentified``, an empty slot blank."""
    shown = [F.concat(F.lit(f"{'' if i else ' '}{'   ' if i else ''}arg{i}: "), before(_or(s, ""), 10)) for i, s in enumerate(slots)]
    return F.concat(before(name, 5), F.lit(":"), before(_or(voice, "unidentified"), 15), *shown)


def counted_pattern(name: Column, voice: Column, slots: list[Column], n: Column) -> Column:
    return F.concat(pattern_text(name, voice, slots), F.lit("     #count: "), after(n.cast("string"), 5))


def pattern_row(sense: Column, number: Column, voice: Column, slots: list[Column], n: Column) -> Column:
    """Sense, number, voice, slots and count with tabs between; what is missing is ``null``."""
    return F.concat_ws("\t", sense, number, *[_or(c, "null") for c in (voice, *slots)], n.cast("string"))


def sense_header(sense: Column, number: Column, n: Column, definition: Column, of_instances: bool = False) -> Column:
    """Sense, number of instances and definition between two rules; ``of_instances``: padded as above a list of instances."""
    name, count = F.concat(sense, F.lit("."), number), after(n.cast("string"), 6)
    shown = F.concat(after(name, 20), F.lit(" : "), count) if of_instances else F.concat(before(name, 10), F.lit(" : "), count)
    return F.concat(F.lit(f"\n{_RULE}\n"), shown, F.lit(" :  "), _or(definition, ""), F.lit(f"\n{_RULE}\n"))


def verb_text(index: Column, lemma: Column, tense: Column, aspect: Column, voice: Column, auxiliaries: Column, negation: Column, words: Column) -> Column:
    """A verb's properties in fixed columns. auxiliaries (lemmas) and words are arrays."""
    state = F.concat_ws(".", _short(tense, TENSES), _short(aspect, ASPECTS), _short(voice, VOICES))
    parts = [after(index.cast("string"), 3), F.lit(" "), before(lemma, 15), F.lit(" : "), before(state, 19), F.lit(" aux: "), before(F.array_join(auxiliaries, " "), 7)]
    return F.concat(*parts, F.lit(" neg: "), before(_or(negation, ""), 5), F.lit(" | "), F.array_join(words, " "))


def lemma_list(words: Column) -> Column:
    """A sentence's lemmas (array) as JSON pairs of index and lemma."""
    pair = lambda w, i: F.concat(F.lit("["), i.cast("string"), F.lit(","), F.regexp_replace(F.to_json(F.array(w)), r"^\[", ""))
    return F.concat(F.lit("["), F.array_join(F.transform(words, pair), ","), F.lit("]"))


def tree_text(nodes: DataFrame) -> DataFrame:
    """sent_id, text: each tree in brackets, one node a line, two blanks a level; tags take four characters."""
    tag, word = F.rpad("tag", 4, " "), F.col("word")
    mark = F.lit(None).cast("string")
    for name, blanks in MARKS.items():
        mark = F.when(F.col("tag") == name, F.lit(name + " " * blanks + name)).otherwise(mark)
    body = F.when(F.col("is_leaf"), F.concat(F.coalesce(mark, F.concat(tag, F.lit(" "), word)), F.lit(")"))).otherwise(F.concat(tag, F.lit(" ")))
    apart = F.when((F.col("ord") > 0) & F.col("parent_id").isNotNull(), " ").otherwise("")
    shown = F.concat(apart, F.lit("\n"), F.repeat(F.lit(" "), 2 * F.col("depth")), F.lit("("), body)
    line = F.struct("node_id", shown.alias("t"), F.when(~F.col("is_leaf"), F.col("last_id")).alias("end"))
    trees = nodes.groupBy("sent_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    # A phrase is closed after its last node; brackets are counted in the tree's own row.
    trees = trees.withColumn("ends", F.transform("l", lambda x: x["end"]))
    closed = lambda x: F.repeat(F.lit(")"), F.size(F.filter("ends", lambda y: y == x["node_id"])))
    return trees.select("sent_id", F.array_join(F.transform("l", lambda x: F.concat(x["t"], closed(x))), "").alias("text"))


def numbered_tokens(nodes: DataFrame, first: int = 0) -> DataFrame:
    """sent_id, text: ``word-number`` of each leaf, with tabs between."""
    place = F.row_number().over(Window.partitionBy("sent_id").orderBy("b")) + (first - 1)
    leaves = nodes.where("is_leaf").select("sent_id", F.struct("b", F.concat_ws("-", "word", place).alias("t")).alias("l"))
    return leaves.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\t").alias("text"))
