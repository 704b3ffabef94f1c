"""Joins of lexical resources: predicates and their rolesets, lexical units and frames, senses and their annotated instances, items and their synsets or titles.

Later rows of a map replace earlier ones of the same key; ``seq`` says which is later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import joins


def _nth(by: str, *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


# Predicates and rolesets.


def predicates(rows: DataFrame) -> DataFrame:
    """lemma, rolesets: of equal lemmas the last one. rows: seq, lemma, rolesets (array of id, name)."""
    return joins.last_wins(rows, "lemma", "rolesets", "seq")


def rolesets(table: DataFrame) -> DataFrame:
    """id, name, lemma of all rolesets; of equal ids the last by lemma and place."""
    each = table.select("lemma", F.posexplode("rolesets").alias("place", "r")).select("lemma", "place", "r.id", "r.name")
    return each.groupBy("id").agg(F.max_by(F.struct("name", "lemma"), F.struct("lemma", "place")).alias("r")).select("id", "r.name", "r.lemma")


def rolesets_of(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Each asked lemma with id and name of its rolesets, in their order (place); no row for an unknown lemma."""
    return asked.join(table, "lemma").select(*asked.columns, F.posexplode("rolesets").alias("place", "r")).select(*asked.columns, "place", "r.id", "r.name")


def roleset_names(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Each asked lemma and sense with the name of the lemma's first roleset ``lemma.sense``; null without one."""
    wanted = F.concat_ws(".", "lemma", "sense")
    own = F.filter("rolesets", lambda r: r["id"] == wanted)
    return asked.join(table, "lemma", "left").select(*asked.columns, F.get(own, 0)["name"].alias("name"))


def first_role_map(asked: DataFrame, maps: DataFrame) -> DataFrame:
    """Each asked lemma and sense with the roles of the first map (least seq) of that sense. maps: seq, lemma, sense, roles."""
    first = maps.groupBy("lemma", "sense").agg(F.min_by("roles", "seq").alias("roles"))
    return asked.join(first, ["lemma", "sense"], "left")


# Units, classes and frames.


def frames_of_units(names: DataFrame, units: DataFrame) -> DataFrame:
    """name, place, frame: the frames of the units of each name, the newest unit first; an id that is given again takes its last frame.

    names: name; units: seq, id, name, frame (may be null: left out).
    """
    last = joins.last_wins(units, "id", "frame", "seq")
    named = units.join(names.distinct(), "name").select("seq", "id", "name").join(last, "id").where("frame is not null")
    return named.select("name", (_nth("name", F.col("seq").desc()) - 1).alias("place"), "frame")


def class_frames(rows: DataFrame) -> DataFrame:
    """member, class, frames, the newest first. rows: seq, member, class, frame."""
    pairs = F.sort_array(F.collect_list(F.struct("seq", "frame")), asc=False)
    return rows.groupBy("member", "class").agg(F.transform(pairs, lambda x: x["frame"]).alias("frames"))


def elements_by_need(frames: DataFrame, need: str = "Core-Unexpressed") -> DataFrame:
    """name, n: how often a frame element of this core type occurs. frames: FE as ``tabular.frames`` has it."""
    each = frames.select(F.explode("FE").alias("e")).where(F.col("e._coreType") == need)
    return each.groupBy(F.col("e._name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def count_of_type(frames: DataFrame, kind: str = "Non-Lexical Frame", types: str = "types") -> DataFrame:
    """frames, of_type: the number of frames, and of those that have the semantic type."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.array_contains(types, kind)).alias("of_type"))


def phrase_types(units: DataFrame) -> DataFrame:
    """phrase: the distinct phrase types in the patterns (arrays of units with ``PT``) of all realisations (arrays of patterns)."""
    patterns = units.select(F.explode("realisations").alias("r")).select(F.explode("r").alias("p"))
    return patterns.select(F.explode("p").alias("u")).select(F.col("u.PT").alias("phrase")).distinct()


# Senses.


def sense_definitions(asked: DataFrame, inventories: DataFrame, instances: DataFrame) -> DataFrame:
    """Each asked lemma and number with its definition (null without one) and its number of instances.

    inventories: seq, lemma, number, name (the first of equal ones counts); instances: lemma, number.
    """
    names = inventories.groupBy("lemma", "number").agg(F.min_by("name", "seq").alias("definition"))
    counts = instances.groupBy("lemma", "number").agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(names, ["lemma", "number"], "left").join(counts, ["lemma", "number"], "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mapped_senses(mapping: DataFrame, patterns: DataFrame, inventories: DataFrame, frames: DataFrame, known: DataFrame) -> DataFrame:
    """map_id, lemma, sense, frame, rolesets, pattern: senses that have a pattern, an entry in the inventory and a frame.

    mapping: map_id, lemma, sense (``group.number``), frame; patterns: seq, lemma,
    sense, pattern (the first counts); inventories: seq, lemma (``lemma-v``), group,
    number, name, ids (roleset ids with commas between; the first entry counts whose
    group begins with the same letter); frames: frame; known: id of rolesets, of
    which ``rolesets`` keeps those that exist, in the order of ``ids``.
    """
    first = patterns.groupBy("lemma", "sense").agg(F.min_by("pattern", "seq").alias("pattern"))
    entries = inventories.select("lemma", F.substring("group", 1, 1).alias("letter"), "number", "seq", F.struct("name", "ids").alias("entry"))
    entries = entries.groupBy("lemma", "letter", "number").agg(F.min_by("entry", "seq").alias("entry"))
    base = mapping.join(first, ["lemma", "sense"]).join(frames.select("frame").distinct(), "frame")
    base = base.withColumns({"__lemma": F.concat("lemma", F.lit("-v")), "letter": F.substring("sense", 1, 1), "number": F.expr("substring(sense, 3)")})
    base = base.join(entries.withColumnRenamed("lemma", "__lemma"), ["__lemma", "letter", "number"])
    ids = base.select("map_id", F.posexplode(F.split("entry.ids", ",")).alias("place", "id")).join(known.select("id").distinct(), "id")
    listed = ids.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("rolesets"))
    out = base.join(listed, "map_id", "left").withColumn("rolesets", F.coalesce("rolesets", F.array().cast("array<string>")))
    return out.select("map_id", "lemma", "sense", F.col("entry.name").alias("name"), "frame", "rolesets", "pattern")


def annotated_senses(nodes: DataFrame, senses: DataFrame, instances: DataFrame) -> DataFrame:
    """sent_id, token, sense, instance: the first sense of each token with the first instance of its predicate, or null.

    nodes: trees with traces; senses: sent_id, token (traces not counted), sense, seq;
    instances: sent_id, idx of the predicate's leaf (traces counted), instance, seq.
    """
    order = Window.partitionBy("sent_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum((F.col("tag") == "-NONE-").cast("int")).over(order), F.lit(0))
    places = nodes.where("is_leaf").select("sent_id", F.col("b").alias("idx"), (F.col("b") - gone).cast("int").alias("token"))
    placed = instances.join(places, ["sent_id", "idx"]).groupBy("sent_id", "token").agg(F.min_by("instance", "seq").alias("instance"))
    return senses.groupBy("sent_id", "token").agg(F.min_by("sense", "seq").alias("sense")).join(placed, ["sent_id", "token"], "left")


def complete_articles(trees: DataFrame, instances: DataFrame, senses: DataFrame) -> DataFrame:
    """The articles (base names of files) that have trees, instances and senses."""
    names = [rows.select("article").distinct() for rows in (trees, instances, senses)]
    return names[0].join(names[1], "article", "left_semi").join(names[2], "article", "left_semi")


# Items.


def synsets_of(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items with their synsets, the newest first, or a reason: their own, or that there is no key.

    items: qid, reason (of a missing qid); mapping: seq, qid, synset.
    """
    found = items.join(joins.multimap(mapping, "qid", "synset", "seq"), "qid", "left")
    return found.withColumn("reason", F.when(F.col("qid").isNull(), F.col("reason")).when(F.col("synsets").isNull(), F.lit("No key.")))


def titles_of(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    """mention_id, place, title of the candidates that have a title. mentions: mention_id, candidates; titles: seq, qid, title (the last counts)."""
    each = mentions.select("mention_id", F.posexplode("candidates").alias("place", "qid"))
    return each.join(joins.last_wins(titles, "qid", "title", "seq"), "qid").select("mention_id", "place", "title")


def most_aliased(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention_id, qid: of each mention's candidates the one of most aliases, of equal ones the first; none where no candidate has any."""
    counts = aliases.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    each = mentions.select("mention_id", F.posexplode("candidates").alias("place", "qid")).join(counts, "qid")
    return each.groupBy("mention_id").agg(F.max_by("qid", F.struct("n", -F.col("place"))).alias("qid"))


def plain_name(name: Column) -> Column:
    """A name without full stops and commas, for a second try."""
    return F.translate(name, ".,", "")


def shortest_match(found: DataFrame, by: str) -> DataFrame:
    """Of each name's matches of two words and more the shortest, of equal ones the last. found: ``by``, b, e and other columns."""
    rank = Window.partitionBy(by).orderBy(F.col("e") - F.col("b"), F.col("b").desc())
    return found.where("e - b > 1").withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")
