"""Clauses of parsed sentences: subject, complements, adjuncts, and what silent elements stand for.

Each verb group makes one clause. The clauses and the noun, prepositional and
adjectival phrases they use form a tree by the inclusion of their ranges. In it a
complement that is a clause is found by its range; movement (topic, passive,
question words) and silent subjects get indices, counted in the order of the
tree; a silent subject shares the index of the clause above or below, a relative
clause that of the noun it modifies. An index is resolved by the first phrase of
the tree that carries it.

All rules are projections of a sentence's row (see ``operators.sentences``). They look
at tags, places and a closed list of lemmas, so sentences with one outline (these alike,
whatever the other words) are analysed once, and each gets its own words back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tags import ADJECTIVES, NOUNS
from lexmill.operators.noun_phrases import head_text, noun_phrase_at, split, with_noun_phrases
from lexmill.operators.outlines import HIDDEN, filled, given, given_back, outline, outlined, worded
from lexmill.operators.sentences import after, at, extended, first_child, first_id, found, gathered, is_phrase, is_word, last_id, nodes_where, parent, record, sibling, stage, text_of, with_kids
from lexmill.operators.verbs import with_verbs
from lexmill.plans.shared import discard, written

# Tags of clauses.
CLAUSES = ("S", "SBAR", "SBARQ", "SINV", "SQ")
#: What a verb has beside it. ``kind`` CP, DP, PP, AP or trace; ``open``: a clause that is still to be found by its range; ``i``: the index.
PART = "struct<kind: string, trace: string, b: int, e: int, open: boolean, i: int>"


def _part(kind: str, b: Column | None = None, e: Column | None = None, trace: str | None = None, is_open: bool = False) -> Column:
    none = F.lit(None).cast("int")
    values = (F.lit(kind), F.lit(trace), none if b is None else b, none if e is None else e, F.lit(is_open), none)
    return F.struct(*[v.alias(k) for v, k in zip(values, ("kind", "trace", "b", "e", "open", "i"), strict=True)]).cast(PART)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _phrase(node: Column, dps: str = "dps") -> Column:
    """The split noun phrase of a node."""
    return found(dps, lambda d: d["id"] == node["id"])


def _is_complement(x: Column) -> Column:
    return is_phrase(x, "NP", "PP", "ADJP", "SBAR", "S", "SBARQ", "SQ") | is_word(x, *NOUNS, *ADJECTIVES)


def _as_part(x: Column) -> Column:
    """What a candidate is to its verb."""
    c, d, tail = x["node"], x["d"], x["tail"]
    timed = F.exists("marks", lambda m: (m["kind"] == "Time") & (m["b"] == d["b"]) & (m["e"] == d["e"])) & x["bare"]["id"].isNotNull() & ~is_phrase(parent(x["bare"]), "PP", "ADVP")
    return (
        F.when(x["is_noun"] & timed, _part("PP", d["b"], d["e"]))
        .when(x["is_noun"], _part("DP", d["b"], d["e"]))
        .when(is_phrase(c, "PP") & tail["id"].isNotNull(), _part("PP", c["b"], c["e"]))
        .when(is_phrase(c, "PP"), _part("trace", trace="NULL"))
        .when(is_phrase(c, "ADJP") | is_word(c, *ADJECTIVES), _part("AP", c["b"], c["e"]))
        .otherwise(_part("CP", c["b"], c["e"], is_open=True))
    )


def _seen(c: Column) -> Column:
    """A candidate with its noun phrase or prepositional phrase."""
    return F.struct(c.alias("node"), _phrase(c).alias("d"), found("pps", lambda p: p["id"] == c["id"]).alias("tail"), (is_phrase(c, "NP") | is_word(c, *NOUNS)).alias("is_noun"))


def with_clauses(rows: DataFrame) -> DataFrame:
    """Adds clauses, one a verb group that has one, to rows with verbs, pps and dps."""
    keep = rows.columns
    rows = split(stage(rows, twice=F.col("dps")), "twice")
    rows = stage(rows, _c1=F.transform("verbs", lambda v: F.struct(v.alias("verb"), parent(at(v["words"][0])).alias("vp"), at(F.element_at(v["words"], -1)).alias("head"))))
    rows = stage(rows, _c2=extended("_c1", tp=lambda c: parent(c["vp"])))
    rows = stage(rows, _c3=extended("_c2", top=lambda c: parent(c["tp"]), is_clause=lambda c: is_phrase(c["tp"], *CLAUSES), opener=lambda c: sibling(c["tp"], -1), comma=lambda c: at(first_id(F.filter(after(c["head"]), lambda y: is_word(y, ","))))))
    rows = stage(rows, _c4=F.filter("_c3", lambda c: c["tp"]["id"].isNotNull() & (~c["is_clause"] | c["top"]["id"].isNotNull())))

    def topic(c: Column) -> Column:
        noun = sibling(c["vp"], -1)
        moved = sibling(c["vp"], -3)
        return F.when(is_phrase(c["vp"], "VP") & is_phrase(noun, "NP") & is_word(sibling(c["vp"], -2), ",") & is_phrase(moved, "S", "SBAR"), moved)

    def candidates(c: Column) -> Column:
        fragment = first_child(at(first_id(F.filter(after(c["head"]), lambda y: is_phrase(y, "FRAG")))))
        plain = F.filter(after(c["head"]), lambda y: _is_complement(y) & (c["comma"]["id"].isNull() | (y["id"] < c["comma"]["id"])))
        return F.when(F.coalesce(_is_complement(fragment), F.lit(False)), F.concat(F.array(fragment), plain)).otherwise(plain)

    def subject(c: Column) -> Column:
        near = lambda test: F.filter(nodes_where(lambda y: y["parent"] == c["vp"]["parent"]), lambda y: is_phrase(y, "NP") & test(y))
        later, earlier = first_id(near(lambda y: y["id"] >= c["vp"]["id"])), last_id(near(lambda y: y["id"] <= c["vp"]["id"]))
        return F.when(c["is_clause"], at(F.when(is_phrase(c["tp"], "SINV"), later).otherwise(earlier)))

    rows = stage(rows, _c5=extended("_c4", topic=topic, cands=candidates, subject=subject))
    rows = stage(rows, _c6=extended("_c5", seen=lambda c: F.transform(c["cands"], _seen), noun=lambda c: _phrase(c["subject"], "twice"), word=lambda c: F.get("words", c["opener"]["b"])))
    rows = stage(rows, _c7=extended("_c6", seen=lambda c: F.transform(c["seen"], lambda x: x.withField("bare", noun_phrase_at(x["d"]["b"], x["d"]["e"])))))
    rows = stage(rows, _c8=extended("_c7", parts=lambda c: F.transform(c["seen"], _as_part)))

    def clause(c: Column) -> Column:
        led = c["is_clause"] & is_phrase(c["top"], "ROOT", "SBAR")
        question = is_phrase(c["opener"], "WHNP")
        spec = F.when(~c["is_clause"], "WHPHI").when(led & c["topic"]["id"].isNotNull(), "Topic").when(led & question, "WH")
        whole = F.when(~c["is_clause"], c["vp"]).when(led, c["top"]).otherwise(c["tp"])
        moved, passive = F.array(_part("trace", trace="Moved")), c["verb"]["voice"] == "Passive"
        empty = _none(PART)
        comps = F.concat(F.when(passive, moved).otherwise(empty), c["parts"], F.when(c["topic"]["id"].isNotNull(), moved).otherwise(empty))
        adjuncts = F.when(c["comma"]["id"].isNotNull(), F.transform(F.filter(after(c["comma"]), lambda y: is_phrase(y, "SBAR", "S", "SBARQ", "SQ")), lambda y: _part("CP", y["b"], y["e"], is_open=True))).otherwise(empty)
        wh = F.when(spec == "Topic", c["topic"]).when(spec == "WH", c["opener"])
        fields = {
            "verb": c["verb"], "b": whole["b"], "e": whole["e"], "word": F.when(led & c["topic"]["id"].isNull() & ~question, c["word"]["lemma"]), "spec": spec, "spec_b": wh["b"], "spec_e": wh["e"], "spec_i": F.lit(None).cast("int"),
            "tp_b": F.when(c["is_clause"], c["tp"]["b"]).otherwise(c["vp"]["b"]), "tp_e": F.when(c["is_clause"], c["tp"]["e"]).otherwise(c["vp"]["e"]),
            "subject": F.when(c["noun"]["id"].isNotNull(), _part("DP", c["noun"]["b"], c["noun"]["e"])).otherwise(_part("trace", trace="NULL")), "comps": comps, "adjuncts": adjuncts,
            "nouns": F.array_compact(F.concat(F.transform(c["seen"], lambda x: F.when(x["is_noun"], x["node"]["id"]).when(is_phrase(x["node"], "PP"), x["tail"]["noun"])), F.array(c["subject"]["id"]))), "tails": F.array_compact(F.transform(c["seen"], lambda x: x["tail"]["id"])),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return stage(rows, clauses=F.transform("_c8", clause)).select(*keep, "clauses")


#: A phrase of the tree: its range, kind, what it is a row of (dps, pps or clauses by place), its index and that of its head.
ENTRY = ("b", "e", "kind", "at")


def with_tree(rows: DataFrame) -> DataFrame:
    """Adds tree: the phrases that clauses use and the clauses, one a range, in pre-order, with the range of the root and of the parent."""
    keep = rows.columns
    own = lambda kind, b, e, i: F.struct(b.alias("b"), e.alias("e"), F.lit(kind).alias("kind"), i.cast("int").alias("at"))
    below = F.transform("dps", lambda d: F.struct(d["id"].alias("id"), F.transform(F.filter("pps", lambda p: F.array_contains(d["tails"], p["id"]) & p["noun"].isNotNull()), lambda p: p["noun"]).alias("nouns")))
    rows = stage(rows, _below=below)
    reach = lambda c: F.aggregate("_below", c["nouns"], lambda held, d: F.when(F.array_contains(held, d["id"]), F.concat(held, d["nouns"])).otherwise(held))
    rows = stage(rows, _reach=F.transform("clauses", lambda c, k: F.struct(c.alias("c"), k.alias("k"), reach(c).alias("nouns"))))

    def entries(x: Column) -> Column:
        held = F.filter(F.transform("dps", lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda d: F.array_contains(x["nouns"], d["d"]["id"]))
        tails = F.concat(x["c"]["tails"], F.flatten(F.transform(held, lambda d: d["d"]["tails"])))
        pps = F.filter(F.transform("pps", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda p: F.array_contains(tails, p["p"]["id"]))
        aps = F.filter(x["c"]["comps"], lambda p: p["kind"] == "AP")
        return F.concat(F.array(own("CP", x["c"]["b"], x["c"]["e"], x["k"])), F.transform(held, lambda d: own("DP", d["d"]["b"], d["d"]["e"], d["i"])), F.transform(pps, lambda p: own("PP", p["p"]["b"], p["p"]["e"], p["i"])), F.transform(aps, lambda p: own("AP", p["b"], p["e"], F.lit(None))))

    rows = stage(rows, _entries=F.flatten(F.transform("_reach", entries)))
    last = lambda x, k: ~F.exists(F.slice("_entries", k + 2, F.size("_entries")), lambda y: (y["b"] == x["b"]) & (y["e"] == x["e"]))
    rows = stage(rows, _kept=F.array_sort(F.transform(F.filter("_entries", last), lambda x: F.struct(x["b"].alias("b"), (-x["e"]).alias("minus"), x["kind"].alias("kind"), x["at"].alias("at")))))
    rows = stage(rows, _tree=F.transform("_kept", lambda x: F.struct(x["b"].alias("b"), (-x["minus"]).alias("e"), x["kind"].alias("kind"), x["at"].alias("at"))))
    around = lambda x: F.filter("_tree", lambda y: (y["b"] <= x["b"]) & (y["e"] >= x["e"]) & ((y["b"] < x["b"]) | (y["e"] > x["e"])))
    rows = stage(rows, _around=extended("_tree", around=around))
    rows = stage(rows, tree=F.transform("_around", lambda x: F.struct(*[x[c].alias(c) for c in ENTRY], F.coalesce(F.get(x["around"], 0)["b"], x["b"]).alias("root_b"), F.coalesce(F.get(x["around"], 0)["e"], x["e"]).alias("root_e"), F.element_at(F.when(F.size(x["around"]) > 0, x["around"]), -1).alias("up"))))
    return rows.select(*keep, "tree")


def _entry(b: Column, e: Column, tree: str = "tree") -> Column:
    return found(tree, lambda y: (y["b"] == b) & (y["e"] == e))


def with_bound_clauses(rows: DataFrame) -> DataFrame:
    """Clauses of the tree in its order, with complements found, movement marked and indices bound; adds resolved."""
    keep = rows.columns
    clause_at = lambda b, e: F.get("clauses", F.when(_entry(b, e)["kind"] == "CP", _entry(b, e)["at"]))
    kinds = lambda p: F.when(p["open"], _entry(p["b"], p["e"])["kind"]).otherwise(p["kind"])
    settled = lambda p: F.when(kinds(p).isNull(), _part("trace", trace="NULL")).otherwise(p.withField("kind", kinds(p)).withField("open", F.lit(False)))
    placed = F.transform(F.filter("tree", lambda x: x["kind"] == "CP"), lambda x: F.get("clauses", x["at"]).withField("root_b", x["root_b"]).withField("root_e", x["root_e"]).withField("over_b", x["up"]["b"]).withField("over_e", x["up"]["e"]).withField("up_b", F.when(x["up"]["kind"] == "CP", x["up"]["b"])).withField("up_e", F.when(x["up"]["kind"] == "CP", x["up"]["e"])))
    rows = stage(rows, _b1=placed)
    rows = stage(rows, _b2=extended("_b1", comps=lambda c: F.transform(c["comps"], settled), adjuncts=lambda c: F.filter(F.transform(c["adjuncts"], settled), lambda p: p["kind"] == "CP")))
    headed = lambda p: F.coalesce((p["kind"] == "CP") & (clause_at(p["b"], p["e"])["word"] != "that"), F.lit(False))
    rows = stage(rows, _b3=extended("_b2", comps=lambda c: F.filter(c["comps"], lambda p: ~headed(p)), adjuncts=lambda c: F.concat(c["adjuncts"], F.filter(c["comps"], headed))))

    one = lambda test: F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)
    silent = lambda c: c["subject"]["kind"] == "trace"
    is_wh = lambda c: F.coalesce(c["spec"].isin("WH", "WHPHI"), F.lit(False))
    topical = lambda c: one(c["spec"] == "Topic")
    passive = lambda c: one(c["verb"]["voice"] == "Passive")
    third = lambda c: F.when(silent(c), 1 - passive(c)).otherwise(one(is_wh(c)))
    rows = stage(rows, _b4=extended("_b3", used=lambda c: topical(c) + passive(c) + third(c)))
    count = lambda c, k: F.aggregate(F.slice("_b4", 1, k), F.lit(0), lambda n, y: n + F.when((y["root_b"] == c["root_b"]) & (y["root_e"] == c["root_e"]), y["used"]).otherwise(0))
    rows = stage(rows, _b5=F.transform("_b4", lambda c, k: c.withField("start", count(c, k))))

    def moved(c: Column) -> Column:
        topic_i, passive_i = c["start"], c["start"] + topical(c)
        own_i = F.when(silent(c) & (passive(c) == 1), passive_i).otherwise(passive_i + passive(c))
        comps = F.when(topical(c) == 1, F.transform(c["comps"], lambda p: F.when(p["trace"] == "Moved", p.withField("i", topic_i)).otherwise(p))).otherwise(c["comps"])
        comps = F.when(passive(c) == 1, F.transform(comps, lambda p, k: F.when(k == 0, p.withField("i", passive_i)).otherwise(p))).otherwise(comps)
        comps = F.when(is_wh(c) & ~silent(c), F.concat(F.array(_part("trace", trace="Moved").withField("i", own_i)), comps)).otherwise(comps)
        filled = _part("trace", trace="Moved").withField("i", own_i)
        subject = F.when(silent(c) & is_wh(c), filled).when(silent(c), filled.withField("trace", F.lit("PRO"))).when(passive(c) == 1, c["subject"].withField("i", passive_i)).otherwise(c["subject"])
        return c.withField("comps", comps).withField("subject", subject).withField("spec_i", F.when(topical(c) == 1, topic_i).when(is_wh(c), own_i))

    rows = stage(rows, _b6=F.transform("_b5", moved))
    same = lambda b, e: found("_b6", lambda y: (y["b"] == b) & (y["e"] == e))

    def bound(c: Column) -> Column:
        over = same(c["up_b"], c["up_e"])["subject"]["i"]
        inner = found(c["comps"], lambda p: p["kind"] == "CP")
        below = same(inner["b"], inner["e"])["subject"]
        shared = F.when(c["subject"]["trace"] == "PRO", over).otherwise(F.when(below["trace"] == "PRO", below["i"]))
        return c.withField("subject", c["subject"].withField("i", F.coalesce(shared, c["subject"]["i"])))

    rows = stage(rows, bound=F.transform("_b6", bound))

    def carried(x: Column) -> Column:
        d = F.get("dps", F.when(x["kind"] == "DP", x["at"]))
        relative = F.when(d["comp"]["kind"] == "CP", same(d["comp"]["b"], d["comp"]["e"]))
        head_i = F.when(is_wh(relative), relative["spec_i"])
        c = F.when(x["kind"] == "CP", found("bound", lambda y: (y["b"] == x["b"]) & (y["e"] == x["e"])))
        row = lambda i, free, rank, b, e, hb, he: F.struct(i.alias("i"), F.lit(free).alias("free"), F.lit(rank).alias("rank"), b.alias("b"), e.alias("e"), hb.alias("head_b"), he.alias("head_e"))
        given = F.array(
            F.when(head_i.isNotNull(), row(head_i, 0, 1, d["b"], d["e"], d["head_b"], d["head_e"])),
            F.when((c["subject"]["kind"] == "DP") & c["subject"]["i"].isNotNull(), row(c["subject"]["i"], 0, 1, c["subject"]["b"], c["subject"]["e"], c["subject"]["b"], c["subject"]["e"])),
            F.when(c["spec"] == "Topic", row(c["spec_i"], 0, 0, c["spec_b"], c["spec_e"], c["spec_b"], c["spec_e"])),
            F.when(c["spec"] == "WH", row(c["spec_i"], 1, 0, c["spec_b"], c["spec_e"], c["spec_b"], c["spec_e"])),
        )
        return F.transform(F.array_compact(given), lambda r: F.struct(x["root_b"].alias("root_b"), x["root_e"].alias("root_e"), r.alias("r")))

    rows = stage(rows, _carried=F.flatten(F.transform("tree", carried)))
    tree_of = lambda x: F.struct(x["root_b"], x["root_e"])

    def runs(held: Column, x: Column) -> Column:
        final = F.element_at(F.when(F.size(held) > 0, held), -1)
        joins = (final["r"]["i"] == x["r"]["i"]) & (tree_of(final) == tree_of(x))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(x.withField("r", F.least(final["r"], x["r"]))))).otherwise(F.concat(held, F.array(x)))

    kind = "array<struct<root_b: int, root_e: int, r: struct<i: int, free: int, rank: int, b: int, e: int, head_b: int, head_e: int>>>"
    rows = stage(rows, _runs=F.aggregate("_carried", F.expr(f"cast(array() as {kind})"), runs))
    firsts = F.filter("_runs", lambda x, k: ~F.exists(F.slice("_runs", 1, k), lambda y: (y["r"]["i"] == x["r"]["i"]) & (tree_of(y) == tree_of(x))))
    rows = stage(rows, resolved=firsts)
    return rows.select(*[c for c in keep if c != "clauses"], F.col("bound").alias("clauses"), "resolved")


def analysed_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``sentences`` with all columns of the analysis, as a table.

    Written after each half: Catalyst's time grows with the square of a plan's steps.
    """
    phrases = written(with_noun_phrases(with_verbs(rows)), "phrases")
    parted = written(with_clauses(phrases), "clauses")
    bound = written(with_bound_clauses(with_tree(parted)), "bound")
    discard(phrases, parted)
    return bound


#: What the analysis finds in a sentence.
FOUND = ("verbs", "pps", "dps", "clauses", "tree", "resolved")


def analysed_outlines(nodes: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sent_id, n (as of ``gathered``), marks, outline; outline, n, marks, verbs, pps, dps, clauses, tree, resolved), tables: the sentences, and the analysis of one sentence of each outline, with lemmas hidden."""
    rows = written(gathered(nodes, marks).withColumn("outline", outline()), "sentences")
    first = written(rows.groupBy("outline").agg(F.min("sent_id").alias("__first")), "firsts")  # a table, so that its size is known, and sentences stay where they are if it is small
    chosen = rows.join(first.select("__first"), F.col("sent_id").eqNullSafe(F.col("__first")), "left_semi")
    spread = chosen.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "outline")  # few bytes, long work
    bound = analysed_rows(outlined(with_kids(spread)))
    discard(first)
    return rows, bound


def analysed(nodes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """One row a sentence, as a table: sent_id, n, marks, verbs, pps, dps, clauses, tree, resolved.

    One sentence of each outline is analysed; the others take what was found there.
    """
    rows, bound = analysed_outlines(nodes, marks)
    each = with_kids(rows).join(bound.select("outline", *FOUND), "outline")
    whole = written(given_back(each).select("sent_id", "n", "marks", *FOUND), "analysed")
    discard(rows, bound)
    return whole


def as_sentences(bound: DataFrame) -> DataFrame:
    """Analysed outlines in place of sentences (sent_id: the outline), with words hidden."""
    return bound.select(F.col("outline").alias("sent_id"), worded().alias("n"), "marks", *FOUND)


def each_sentence(rows: DataFrame, found_there: DataFrame, texts: tuple[str, ...] = ("text",), lemmas: tuple[str, ...] = ()) -> DataFrame:
    """What was found in outlines (sent_id: the outline) for each sentence, with its own words in texts and lemmas. rows: as of ``analysed_outlines``."""
    own = rows.select("sent_id", "outline", F.col("n.word").alias("words"), F.col("n.lemma").alias("lemmas"))
    each = own.join(found_there.withColumnRenamed("sent_id", "outline"), "outline")
    put = {**{c: filled(F.col(c)) for c in texts}, **{c: given(F.col(c)) for c in lemmas}}
    return each.select("sent_id", *[put.get(c, F.col(c)).alias(c) for c in found_there.columns if c != "sent_id"])


def kinds_of_sentences(rows: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sent_id, words, kind; rows as of ``analysed``, a table, sent_id: the kind, words hidden).

    Sentences with one outline and the same lemmas of verbs and of words that open clauses
    are of one kind: no more is looked at up to the meaning graph. rows, bound: as of
    ``analysed_outlines``.
    """
    asked = F.filter(F.flatten(F.transform("clauses", lambda c: F.array(c["verb"]["lemma"], c["word"]))), lambda x: x.startswith(HIDDEN))
    found = bound.withColumn("asked", F.array_distinct(F.transform(asked, lambda x: F.substring(x, 2, 10).cast("int"))))
    own = rows.select("sent_id", "outline", F.col("n.word").alias("words"), F.col("n.lemma").alias("lemmas")).join(found.select("outline", "asked"), "outline")
    own = own.withColumn("said", F.transform("asked", lambda i: F.get("lemmas", i)))
    own = own.withColumn("kind", F.sha2(F.to_json(F.struct("outline", "said")), 256))
    kinds = own.select("kind", "outline", "said").distinct().join(found, "outline")
    lemma = lambda x: F.coalesce(F.get("said", F.array_position("asked", x["id"]).cast("int") - 1), x["lemma"])
    kinds = given_back(kinds.withColumn("n", F.transform(worded(), lambda x: x.withField("lemma", lemma(x)))))
    return own.select("sent_id", "words", "kind"), written(kinds.select(F.col("kind").alias("sent_id"), "n", "marks", *FOUND), "kinds")


def referents(rows: DataFrame) -> DataFrame:
    """sent_id, root_b, root_e, i, kind (DP, CP or WH), b, e, text: what each index of a tree stands for."""
    r = F.col("x.r")
    kind = F.when(r["free"] == 1, "WH").when(r["rank"] == 0, "CP").otherwise("DP")
    rows = rows.select("sent_id", "n", F.explode("resolved").alias("x"))
    return written(rows.select("sent_id", "x.root_b", "x.root_e", r["i"].alias("i"), kind.alias("kind"), r["b"].alias("b"), r["e"].alias("e"), text_of(r["head_b"], r["head_e"]).alias("text")), "referents")


def clause_tree(rows: DataFrame) -> DataFrame:
    """One row a clause, in the tree of phrases and clauses.

    sent_id, verb_idx, lemma, voice, neg, b, e, up_b, up_e (the clause right above), over_b,
    over_e (the phrase or clause right above), word (that opens it), spec, spec_i, spec_b,
    spec_e, spec_text (what stands before it: a topic or a question word).
    """
    c = F.col("c")
    rows = rows.select("sent_id", "n", F.explode("clauses").alias("c"))
    text = F.when(c["spec_b"].isNotNull(), text_of(c["spec_b"], c["spec_e"]))
    verb = c["verb"]
    return written(rows.select("sent_id", at(verb["id"])["b"].alias("verb_idx"), verb["lemma"].alias("lemma"), verb["voice"].alias("voice"), verb["neg"].isNotNull().alias("neg"), *[c[k].alias(k) for k in ("b", "e", "up_b", "up_e", "over_b", "over_e", "word", "spec", "spec_i", "spec_b", "spec_e")], text.alias("spec_text")), "clause-tree")


def clause_heads() -> Column:
    """b, e, word, infinitive of each clause of a row."""
    return F.transform("clauses", lambda y: record(b=y["b"], e=y["e"], word=y["word"], infinitive=at(F.get(y["verb"]["aux"], 0))["lemma"] == "to"))


def clause_parts(rows: DataFrame) -> DataFrame:
    """One row for subject, complements and adjuncts of each clause; a trace has range and head of what it stands for.

    sent_id, verb_idx, role, ord, kind, trace, i, b, e, free (a question word that stands
    for nothing else), det, person, text; of a prepositional phrase prep, time,
    gerund and the range inside (obj_b, obj_e); of a clause word (that opens it) and
    infinitive. A table, as all of its columns come from one look at a sentence.
    """
    put = lambda role, parts: F.transform(parts, lambda p, k: F.struct(F.lit(role).alias("role"), k.alias("ord"), p["kind"].alias("own_kind"), p["trace"].alias("trace"), p["i"].alias("i"), p["b"].alias("own_b"), p["e"].alias("own_e")))
    c = F.col("c")
    keep = ["sent_id", "n", "dps", "pps", "tree", "resolved"]
    heads = clause_heads()
    rows = rows.select(*keep, heads.alias("heads"), F.explode("clauses").alias("c"))
    rows = rows.select(*keep, "heads", at(c["verb"]["id"])["b"].alias("verb_idx"), c["root_b"].alias("root_b"), c["root_e"].alias("root_e"), F.inline(F.concat(put("subject", F.array(c["subject"])), put("complement", c["comps"]), put("adjunct", c["adjuncts"]))))
    whose = lambda y: (y["r"]["i"] == F.col("i")) & (y["root_b"] == F.col("root_b")) & (y["root_e"] == F.col("root_e"))
    is_trace = F.col("own_kind") == "trace"
    rows = stage(rows, meant=F.when(is_trace, found("resolved", whose)["r"]))
    m = F.col("meant")
    kind = F.when(~is_trace, F.col("own_kind")).when(m.isNull(), None).when((m["rank"] == 0) & (m["free"] == 0), "CP").otherwise("DP")
    rows = stage(rows, kind=kind, b=F.coalesce("own_b", m["b"]), e=F.coalesce("own_e", m["e"]), free=F.coalesce(m["free"] == 1, F.lit(False)))
    own = _entry(F.col("b"), F.col("e"))
    head = found("heads", lambda y: (y["b"] == F.col("b")) & (y["e"] == F.col("e")))
    is_cp = (F.col("kind") == "CP") & (own["kind"] == "CP")
    rows = stage(rows, noun=F.get("dps", F.when(own["kind"] == "DP", own["at"])), tail=F.get("pps", F.when((own["kind"] == "PP") & (F.col("kind") == "PP"), own["at"])), word=F.when(is_cp, head["word"]), infinitive=F.when(is_cp, F.coalesce(head["infinitive"], F.lit(False))))
    inside = _phrase(F.struct(F.col("tail.noun").alias("id")))
    rows = stage(rows, inside=inside)
    inner = F.when(_entry(F.col("inside.b"), F.col("inside.e"))["kind"] == "DP", F.col("inside"))
    rows = stage(rows, inner=inner)
    tail = F.col("tail")
    text = (
        F.when(F.col("kind").isin("CP", "AP"), text_of(F.col("b"), F.col("e")))
        .when((F.col("kind") == "DP") & F.col("noun").isNotNull(), head_text(F.col("noun")))
        .when((F.col("kind") == "PP") & tail["clause_b"].isNotNull(), text_of(tail["clause_b"], tail["clause_e"]))
        .when((F.col("kind") == "PP") & F.col("inner").isNotNull(), head_text(F.col("inner")))
        .when(F.col("kind").isNotNull(), "")
    )
    noun = lambda field: F.when(F.col("kind") == "DP", F.col(f"noun.{field}")).alias(field)
    tails = [tail["prep"].alias("prep"), tail["time"].alias("time"), F.when(tail["id"].isNotNull(), tail["clause_b"].isNotNull()).alias("gerund"), F.coalesce(tail["clause_b"], F.col("inside.b")).alias("obj_b"), F.coalesce(tail["clause_e"], F.col("inside.e")).alias("obj_e")]
    return written(rows.select("sent_id", "verb_idx", "role", "ord", "kind", "trace", "i", "b", "e", "free", noun("det"), noun("person"), text.alias("text"), *tails, "word", "infinitive"), "clause-parts")


def parts_of_sentences(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """As ``clause_parts`` of ``analysed``, with the parts looked up once an outline. rows, bound: as of ``analysed_outlines``."""
    return each_sentence(rows, clause_parts(as_sentences(bound)), lemmas=("word",))


def referents_of_sentences(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """As ``referents`` of ``analysed``, with texts looked up once an outline. rows, bound: as of ``analysed_outlines``."""
    return each_sentence(rows, referents(as_sentences(bound)))
