"""Lines of dictionary files with counted sections, as column expressions; lines that don't parse give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import hexadecimal, leading_number


def is_comment(line: Column) -> Column:
    return (F.length(line) <= 2) | line.startswith("  ")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+", -1), "")


def _counted(n: Column, make: object) -> Column:
    """make(0), ..., make(n - 1); empty for 0 and null."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.transform(F.slice(F.array(F.lit(0)), 1, 0), make))


def data_items(rows: DataFrame, value: str = "value", verbs: bool = False) -> DataFrame:
    """Adds offset, lex_file, kind, words (word, lex_id), ptrs (sym, offset, pos, src, tgt), frames (frame, word) and gloss."""
    out = rows.withColumn("__w", _words(F.col(value)))
    w = F.col("__w")
    count = leading_number(F.get(w, 3)).cast("int")
    out = out.withColumn("__c", F.coalesce(count, F.lit(0))).withColumn("__p", 4 + 2 * F.col("__c"))
    out = out.withColumn("__np", F.coalesce(leading_number(F.get(w, F.col("__p"))).cast("int"), F.lit(0))).withColumn("__f", F.col("__p") + 1 + 4 * F.col("__np"))
    frames = F.coalesce(leading_number(F.get(w, F.col("__f"))).cast("int"), F.lit(0)) if verbs else F.lit(0)
    out = out.withColumn("__nf", frames).withColumn("__g", F.col("__f") + (1 if verbs else 0) + 3 * F.col("__nf"))

    def pointer(i: Column) -> Column:
        at = F.col("__p") + 1 + 4 * i
        both = F.get(w, at + 3)
        return F.struct(
            F.get(w, at).alias("sym"), leading_number(F.get(w, at + 1)).alias("offset"), F.substring(F.get(w, at + 2), 1, 1).alias("pos"), hexadecimal(F.substring(both, 1, 2)).cast("int").alias("src"), hexadecimal(F.substring(both, 3, 2)).cast("int").alias("tgt")
        )

    made = {
        "offset": leading_number(F.get(w, 0)),
        "lex_file": leading_number(F.get(w, 1)).cast("int"),
        "kind": F.substring(F.get(w, 2), 1, 1),
        "words": _counted(F.col("__c"), lambda i: F.struct(F.get(w, 4 + 2 * i).alias("word"), F.substring(F.get(w, 5 + 2 * i), 1, 1).alias("lex_id"))),
        "ptrs": _counted(F.col("__np"), pointer),
        "frames": _counted(F.col("__nf"), lambda i: F.struct(leading_number(F.get(w, F.col("__f") + 2 + 3 * i)).cast("int").alias("frame"), leading_number(F.get(w, F.col("__f") + 3 + 3 * i)).cast("int").alias("word"))),
        "gloss": F.array_join(F.slice(w, F.col("__g") + 2, F.size(w)), " "),
    }
    whole = count.isNotNull() & made["offset"].isNotNull()
    return out.withColumns({k: F.when(whole, v) for k, v in made.items()}).drop("__w", "__c", "__p", "__np", "__f", "__nf", "__g")


def index_items(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds lemma, pos, symbols, tagged and offsets (in order of the senses)."""
    w = F.col("__w")
    n = F.coalesce(leading_number(F.get(w, 3)).cast("int"), F.lit(0))
    return rows.withColumn("__w", _words(F.col(value))).withColumns(
        {
            "lemma": F.get(w, 0),
            "pos": F.substring(F.get(w, 1), 1, 1),
            "symbols": F.slice(w, 5, n),
            "tagged": leading_number(F.get(w, 5 + n)).cast("int"),
            "offsets": F.transform(F.slice(w, 7 + n, F.greatest(F.size(w), F.lit(1))), leading_number),
        }
    ).drop("__w")


def senses(index: DataFrame, synsets: DataFrame) -> DataFrame:
    """lemma, pos, sense_no and the synset of each sense."""
    each = index.select("lemma", "pos", F.posexplode("offsets").alias("n", "offset")).withColumn("sense_no", F.col("n") + 1).drop("n")
    return each.join(synsets, ["pos", "offset"])


def derivations(synsets: DataFrame) -> DataFrame:
    """word, offset, pos, to_word, to_offset, to_pos: derivationally related words (symbol ``+``), by the words' ordinals."""
    each = synsets.select("pos", "offset", "words", F.explode("ptrs").alias("p")).where("p.sym = '+'")
    source = each.select("pos", "offset", F.get("words", F.col("p.src") - 1)["word"].alias("word"), F.col("p.pos").alias("to_pos"), F.col("p.offset").alias("to_offset"), F.col("p.tgt").alias("tgt"))
    target = synsets.select(F.col("pos").alias("to_pos"), F.col("offset").alias("to_offset"), F.col("words").alias("to_words"))
    return source.join(target, ["to_pos", "to_offset"]).select("word", "offset", "pos", F.get("to_words", F.col("tgt") - 1)["word"].alias("to_word"), "to_offset", "to_pos").distinct()


def hypernyms(synsets: DataFrame) -> DataFrame:
    """src, dst: offsets of a synset and of each direct hypernym."""
    return synsets.select(F.col("offset").alias("src"), F.explode("ptrs").alias("p")).where("p.sym = '@'").select("src", F.col("p.offset").alias("dst"))
