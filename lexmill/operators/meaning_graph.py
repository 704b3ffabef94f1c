"""The meaning graph of parsed sentences: predicates and entities as vertices, roles as edges.

Vertices come from frames, from the phrases that have roles in them, from what
stands inside of these phrases (appositions, ``of`` phrases, owners, modifiers)
and from words that link clauses. Each vertex has a name: what it is and its
range; the same name from two tables is one vertex, and edges meet vertices by
name in joins. Ids number the names of a sentence in a fixed order, so they are
the same in each run.

Tables: frames: as ``frames.match_frames`` gives them; linked: as
``frames.linked_clauses``; clauses: as ``clauses.clause_tree``; phrases: sent_id, b, e, head_b, head_e, text and inner (array of
relation, marker, kind, b, e, head_b, head_e, text) of the noun phrases of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.clauses import _entry, _phrase, clause_heads
from lexmill.operators.noun_phrases import head_range, head_text
from lexmill.operators.outlines import filled
from lexmill.operators.sentences import found, stage, text_of
from lexmill.plans.shared import written

INNER = "array<struct<relation: string, marker: string, kind: string, b: int, e: int, head_b: int, head_e: int, text: string>>"

# What a phrase inside of another is to it: relation -> frame, role of the outer phrase, role of the inner one.
INSIDE = {
    "apposition": ("Instance", "Instance", "Type"),
    "of": ("Partitive", "Subset", "Group"),
    "purpose": ("Purpose", "Means", "Goal"),
    "owner": ("Possession", "Possession", "Owner"),
    "time": ("Time_vector", "Event", "Landmark_event"),
}


def phrases(rows: DataFrame) -> DataFrame:
    """Noun phrases of the trees of ``clauses.analysed`` with what stands inside of them."""
    rows = rows.select("sent_id", "n", "dps", "pps", "tree", clause_heads().alias("heads"), F.explode(F.filter("tree", lambda x: x["kind"] == "DP")).alias("x"))
    rows = stage(rows, d=F.get("dps", F.col("x.at")))
    d = F.col("d")
    tail_at = lambda b, e: found("pps", lambda p: (p["b"] == b) & (p["e"] == e))
    held = lambda p: _phrase(F.struct(p["noun"].alias("id")))
    adjuncts = F.transform(F.filter(d["adjuncts"], lambda a: a["kind"] == "PP"), lambda a: F.struct(tail_at(a["b"], a["e"]).alias("p")))
    rows = stage(rows, adj=adjuncts, comp=F.when(d["comp"]["kind"] == "PP", tail_at(d["comp"]["b"], d["comp"]["e"])), goal=F.when(d["comp"]["kind"] == "CP", found("heads", lambda y: (y["b"] == d["comp"]["b"]) & (y["e"] == d["comp"]["e"]) & y["infinitive"])))
    rows = stage(rows, inside=F.filter(F.transform("adj", lambda a: F.struct(a["p"].alias("p"), held(a["p"]).alias("d"))), lambda a: a["d"]["id"].isNotNull() & (_entry(a["d"]["b"], a["d"]["e"])["kind"] == "DP")), of=F.when(F.col("comp.prep") == "of", held(F.col("comp"))))
    none = F.lit(None).cast("string")

    def row(relation: Column | str, marker: Column, kind: str, b: Column, e: Column, head: tuple[Column, Column], text: Column) -> Column:
        relation = F.lit(relation) if isinstance(relation, str) else relation
        return F.struct(relation.alias("relation"), marker.alias("marker"), F.lit(kind).alias("kind"), b.alias("b"), e.alias("e"), head[0].alias("head_b"), head[1].alias("head_e"), text.alias("text"))

    appos, gen = found(d["specs"], lambda s: s["kind"] == "Appos"), found(d["specs"], lambda s: s["kind"] == "Gen")
    of, goal = F.col("of"), F.col("goal")
    plain = lambda s: (s["b"], s["e"])
    listed = F.array_compact(
        F.concat(
            F.array(
                F.when(appos["b"].isNotNull(), row("apposition", none, "entity", *plain(appos), plain(appos), text_of(*plain(appos)))),
                F.when((of["id"].isNotNull()) & (_entry(of["b"], of["e"])["kind"] == "DP"), row("of", F.lit("of"), "entity", of["b"], of["e"], head_range(of), head_text(of))),
                F.when(goal["b"].isNotNull(), row("purpose", none, "clause", *plain(goal), plain(goal), F.lit(""))),
                F.when(d["det"] == "Genitive", row("owner", none, "entity", d["det_b"], d["det_e"], (d["det_b"], d["det_e"]), text_of(d["det_b"], d["det_e"]))),
                F.when(gen["b"].isNotNull(), row("owner", none, "entity", *plain(gen), plain(gen), text_of(*plain(gen)))),
            ),
            F.transform("inside", lambda a: row(F.when(a["p"]["time"], "time").otherwise(a["p"]["prep"]), a["p"]["prep"], "entity", a["d"]["b"], a["d"]["e"], head_range(a["d"]), head_text(a["d"]))),
        )
    )
    return rows.select("sent_id", d["b"].alias("b"), d["e"].alias("e"), head_range(d)[0].alias("head_b"), head_range(d)[1].alias("head_e"), head_text(d).alias("text"), listed.cast(INNER).alias("inner"))


def _name(kind: Column | str, b: Column, e: Column) -> Column:
    """What a vertex is, and where: predicates and entities of one range are one vertex ``at``; ``in``: a relation inside of a phrase; ``pro``, ``link``."""
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, b.cast("string"), e.cast("string"))


def _role_parts(frames: DataFrame, clauses: DataFrame, phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """One row a role: sent_id, verb_idx, fb, fe (of the frame's clause), role, prep, kind, trace, i, b, e (of the entity), head and text where it is a noun phrase."""
    own = clauses.select("sent_id", "verb_idx", F.col("b").alias("fb"), F.col("e").alias("fe"), "over_b", "over_e", F.when(F.col("spec") == "WH", F.col("spec_b")).alias("wb"), F.when(F.col("spec") == "WH", F.col("spec_e")).alias("we"))
    each = frames.select("sent_id", "verb_idx", F.explode("roles").alias("r")).select("sent_id", "verb_idx", "r.role", "r.kind", "r.trace", "r.b", "r.e", "r.obj_b", "r.obj_e")
    marked = parts.where("kind is not null").groupBy("sent_id", "verb_idx", "kind", "b", "e").agg(F.max("i").alias("i"), F.max("prep").alias("prep"), F.max("word").alias("word"), F.max("free").alias("free"), F.max("text").alias("said"))
    rows = each.join(own, ["sent_id", "verb_idx"]).join(marked, ["sent_id", "verb_idx", "kind", "b", "e"], "left")
    opened = clauses.where("spec = 'WH'").select("sent_id", F.col("b").alias("cb"), F.col("e").alias("ce"), "spec_b", "spec_e", "spec_text")
    is_cp = F.col("kind") == "CP"
    rows = rows.withColumns({"cb": F.when(is_cp, F.col("b")), "ce": F.when(is_cp, F.col("e"))}).join(opened, ["sent_id", "cb", "ce"], "left")
    prep = F.when(is_cp, F.when(F.col("word") != "that", F.col("word"))).when(F.col("kind") == "PP", F.col("prep"))
    is_pp = F.col("kind") == "PP"
    rows = rows.withColumns({"prep": prep, "b": F.when(is_pp, F.col("obj_b")).otherwise(F.coalesce("spec_b", "b")), "e": F.when(is_pp, F.col("obj_e")).otherwise(F.coalesce("spec_e", "e"))})
    nouns = phrases.select("sent_id", "b", "e", "head_b", "head_e", "text").withColumn("known", F.lit(True))
    return rows.join(nouns, ["sent_id", "b", "e"], "left")


def meaning_graph(frames: DataFrame, clauses: DataFrame, phrases: DataFrame, parts: DataFrame, linked: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: sent_id, id, kind, b, e, head_b, head_e, frame, text; edges: sent_id, role, modifier, prep, src, dst).

    relations: prep, frame, role0, role1, prio: what a preposition inside of a phrase
    stands for, besides those of ``INSIDE``.
    """
    vertices, edges = named_graph(frames, clauses, phrases, parts, linked, relations)
    return vertices.withColumn("t", F.array_min("told")).select(*VERTEX), edges


def graph_of_sentences(each: DataFrame, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``meaning_graph``, from the ``named_graph`` of kinds of sentences. each: sent_id, words, kind (see ``clauses.kinds_of_sentences``)."""
    own = lambda t: t.withField("text", F.when(t["kind"] == "entity", filled(t["text"])).otherwise(t["text"]))
    said = each.join(vertices.withColumnRenamed("sent_id", "kind"), "kind").withColumn("t", F.array_min(F.transform("told", own)))
    joined = each.select("sent_id", "kind").join(edges.withColumnRenamed("sent_id", "kind"), "kind")
    return said.select(*VERTEX), joined.select(*edges.columns)


VERTEX = ["sent_id", "id", "t.kind", "b", "e", "t.head_b", "t.head_e", "frame", "t.text"]


def named_graph(frames: DataFrame, clauses: DataFrame, phrases: DataFrame, parts: DataFrame, linked: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: sent_id, name, id, b, e, frame, told (array of text, kind, head_b, head_e: all that the tables say of it, of which the least counts); edges as of ``meaning_graph``), tables."""
    int_none, none = F.lit(None).cast("int"), F.lit(None).cast("string")
    phrases = written(phrases, "phrases")
    roles = written(_role_parts(frames, clauses, phrases, parts), "roles")
    is_entity = (F.col("known") | F.col("kind").isin("AP") | F.col("spec_b").isNotNull() | F.coalesce(F.col("free"), F.lit(False))) & F.col("b").isNotNull()
    within = F.coalesce((F.col("b") == F.col("over_b")) & (F.col("e") == F.col("over_e")), F.lit(False)) | F.coalesce((F.col("b") == F.col("wb")) & (F.col("e") == F.col("we")), F.lit(False))
    put = lambda rows, name, kind, order, b, e, hb, he, frame, text: rows.select("sent_id", name.alias("name"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), b.alias("b"), e.alias("e"), hb.alias("head_b"), he.alias("head_e"), frame.alias("frame"), text.alias("text"))
    b, e = F.col("b"), F.col("e")
    predicates = frames.join(clauses, ["sent_id", "verb_idx"])
    predicates = put(predicates, _name("at", b, e), "predicate", 0, b, e, F.col("verb_idx"), F.col("verb_idx"), F.col("frame"), F.col("lemma"))
    held = roles.where(is_entity).withColumn("text", F.coalesce("text", "spec_text", "said"))
    entity = lambda rows, name, b, e, text: put(rows, name, "entity", 1, b, e, F.coalesce("head_b", b), F.coalesce("head_e", e), none, text)
    entities = entity(held.where(~(within & F.col("known").isNotNull()) & F.coalesce(F.col("trace") != "PRO", F.lit(True))), _name("at", b, e), b, e, F.col("text"))
    silent = put(held.where("trace = 'PRO'"), _name("pro", F.col("i"), int_none), "entity", 2, int_none, int_none, F.coalesce("head_b", b), F.coalesce("head_e", e), none, F.concat(F.lit("PRO_"), F.col("i").cast("string")))
    links = linked.select("sent_id", "marker", "frame", "b0", "e0", "b1", "e1", "role0", "role1")
    link_name = F.concat_ws(":", F.lit("link"), "marker", F.col("b0").cast("string"), F.col("b1").cast("string"))
    linkers = put(links, link_name, "link", 4, int_none, int_none, int_none, int_none, F.col("frame"), F.col("marker"))
    known = relations.withColumn("__n", F.row_number().over(Window.partitionBy("prep").orderBy("prio"))).where("__n = 1").select(F.col("prep").alias("relation"), F.struct(F.col("frame").alias("f"), F.col("role0").alias("a"), F.col("role1").alias("z")).alias("__known"))
    fixed = F.coalesce(*[F.when(F.col("relation") == k, F.struct(F.lit(f).alias("f"), F.lit(x).alias("a"), F.lit(z).alias("z"))) for k, (f, x, z) in INSIDE.items()])
    used = entities.select("sent_id", "b", "e").distinct()
    inner = phrases.join(used, ["sent_id", "b", "e"]).select("sent_id", F.col("b").alias("ob"), F.col("e").alias("oe"), F.inline("inner"))
    inner = written(inner.join(known, "relation", "left").withColumn("rel", F.coalesce(fixed, "__known")).where("rel is not null"), "inner")
    inner_predicates = put(inner, _name("in", b, e), "relation", 3, b, e, int_none, int_none, F.col("rel.f"), F.lit(""))
    inner_entities = entity(inner.where("kind = 'entity'"), _name("at", b, e), b, e, F.col("text"))
    every = predicates.unionByName(entities).unionByName(inner_entities).unionByName(silent).unionByName(inner_predicates).unionByName(linkers)
    first = ("order", "b", "e", "frame")
    listed = every.groupBy("sent_id", "name").agg(F.collect_list(F.struct(F.struct(*first).alias("first"), F.struct("text", "kind", "head_b", "head_e").alias("told"))).alias("x"))
    once = listed.withColumn("first", F.array_min(F.transform("x", lambda x: x["first"])))
    once = once.withColumn("told", F.transform(F.filter("x", lambda x: x["first"].eqNullSafe(F.col("first"))), lambda x: x["told"])).select("sent_id", "name", "first.*", "told")
    vertices = written(once.withColumn("id", F.row_number().over(Window.partitionBy("sent_id").orderBy("order", "b", "e", "name"))), "vertices")

    edge = lambda rows, role, modifier, prep, src, dst: rows.select("sent_id", role.alias("role"), F.lit(modifier).alias("modifier") if isinstance(modifier, bool) else modifier.alias("modifier"), prep.alias("prep"), src.alias("src"), dst.alias("dst"))
    frame_name, here = _name("at", F.col("fb"), F.col("fe")), _name("at", b, e)
    pro, is_pro = _name("pro", F.col("i"), int_none), F.coalesce(F.col("trace") == "PRO", F.lit(False))
    named = (
        edge(roles, F.col("role"), within & ~is_pro, F.col("prep"), frame_name, F.when(is_pro, pro).otherwise(here))
        .unionByName(edge(roles.where(is_pro), F.lit("PRO"), False, none, pro, here))
        .unionByName(edge(inner, F.col("rel.a"), True, none, _name("in", b, e), _name("at", F.col("ob"), F.col("oe"))))
        .unionByName(edge(inner, F.col("rel.z"), False, F.col("marker"), _name("in", b, e), here))
        .unionByName(edge(links, F.col("role0"), True, none, link_name, _name("at", F.col("b0"), F.col("e0"))))
        .unionByName(edge(links, F.col("role1"), False, none, link_name, _name("at", F.col("b1"), F.col("e1"))))
    )
    ids = vertices.select("sent_id", "name", "id")
    edges = named.distinct().join(ids.select("sent_id", F.col("name").alias("src"), F.col("id").alias("__src")), ["sent_id", "src"]).join(ids.select("sent_id", F.col("name").alias("dst"), F.col("id").alias("__dst")), ["sent_id", "dst"])
    edges = edges.select("sent_id", "role", "modifier", "prep", F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    return vertices.select("sent_id", "name", "id", "b", "e", "frame", "told"), written(edges, "edges")
