"""Noun phrases taken apart: determiner, head, appositions, genitives, prepositional and clausal modifiers.

All noun phrases of a sentence are split at the same time, each step for all of
them: prepositional tails are taken off from the right in one fold over the
phrases that begin where it begins, then a clause or a parenthesis, then a noun
before a name, then the determiner, then the class of the head. What a step needs
of other phrases is looked up by range, so no step waits for another phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tags import NOUNS
from lexmill.operators.sentences import after, at, extended, first_child, first_id, found, has_lemma, is_phrase, is_word, last_child, no_spans, nodes_where, sentences, sibling, span, stage, text_of
from lexmill.plans.shared import written

# Pronouns by person, and articles.
PERSONS = {
    "I": ("I", "me", "my", "mine"),
    "You": ("you", "your", "yours"),
    "He": ("he", "him", "his"),
    "She": ("she", "her", "hers"),
    "It": ("it", "its"),
    "They": ("they", "them", "their", "theirs"),
}
ARTICLES = {"the": "Definite", "a": "Indefinite", "an": "Indefinite"}


SPAN = "struct<kind: string, b: int, e: int>"


def person_of(lemma: Column) -> Column:
    return F.coalesce(*[F.when(lemma.isin(*forms), F.lit(person)) for person, forms in PERSONS.items()])


def article_of(lemma: Column) -> Column:
    return F.coalesce(*[F.when(lemma == word, F.lit(kind)) for word, kind in ARTICLES.items()])


def _entity(test) -> Column:
    """The first mark of a named thing that passes."""
    return found("marks", lambda m: (m["kind"] != "Time") & test(m))


def noun_phrase_at(b: Column, e: Column) -> Column:
    """The outermost noun phrase with exactly this range."""
    return found("nps", lambda y: (y["b"] == b) & (y["e"] == e))


def with_prepositions(rows: DataFrame) -> DataFrame:
    """Adds pps: id, b, e, prep, noun (node of its noun phrase), clause_b, clause_e (of a gerund), time."""

    def tail(x: Column) -> Column:
        prep = at(x["id"] + 1)
        noun = at(first_id(F.filter(after(prep), lambda y: is_phrase(y, "NP"))))
        clause = at(first_id(F.filter(after(prep), lambda y: is_phrase(y, "S"))))
        verbal = first_child(clause)
        gerund = is_phrase(verbal, "VP") & is_word(first_child(verbal), "VBG") & noun["id"].isNull()
        time = F.exists("marks", lambda m: (m["kind"] == "Time") & (m["b"] <= noun["b"]) & (noun["e"] <= m["e"]))
        fits = is_word(prep, "IN", "TO")
        return F.struct(x["id"].alias("id"), x["b"].alias("b"), x["e"].alias("e"), F.when(fits, prep["word"]).alias("prep"), noun["id"].alias("noun"), F.when(gerund, clause["b"]).alias("clause_b"), F.when(gerund, clause["e"]).alias("clause_e"), F.coalesce(time, F.lit(False)).alias("time"))

    tails = F.transform(nodes_where(lambda x: is_phrase(x, "PP") & (x["last"] > x["id"])), tail)
    return stage(rows, pps=F.filter(tails, lambda p: p["prep"].isNotNull() & (p["noun"].isNotNull() | p["clause_b"].isNotNull())))


def _unsplit(x: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    fields = {
        "id": x["id"], "b": x["b"], "e": x["e"], "det": F.lit("NoDet"), "person": none("string"), "det_b": none("int"), "det_e": none("int"),
        "head_b": x["b"], "head_e": x["e"], "head_class": none("string"), "specs": no_spans(), "adjuncts": no_spans(),
        "comp": none(SPAN), "tails": F.expr("cast(array() as array<int>)"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _without_tails(d: Column) -> Column:
    """Takes prepositional and adjectival tails off the head, from the right."""
    kinds = lambda end, live, adjuncts, comp, tails: F.struct(end.alias("end"), live.alias("live"), adjuncts.alias("adjuncts"), comp.alias("comp"), tails.alias("tails"))
    yes, no = F.lit(True), F.lit(False)

    def cut(now: Column, y: Column) -> Column:
        tail, adjective = y["tail"], y["kid"]
        of = tail["prep"] == "of"
        more = F.when(of, now["adjuncts"]).otherwise(F.array_sort(F.array_distinct(F.concat(now["adjuncts"], F.array(span("PP", tail["b"], tail["e"]))))))
        prepositional = kinds(tail["b"] - 1, yes, more, F.when(of, span("PP", tail["b"], tail["e"])).otherwise(now["comp"]), F.concat(now["tails"], F.array(tail["id"])))
        adjectival = kinds(adjective["b"] - 1, yes, F.concat(now["adjuncts"], F.array(span("AP", adjective["b"], adjective["e"]))), now["comp"], now["tails"])
        stopped = kinds(now["end"], no, now["adjuncts"], now["comp"], now["tails"])
        return F.when(~now["live"] | (y["e"] != now["end"]), now).when(tail["id"].isNotNull(), prepositional).when(is_phrase(adjective, "ADJP"), adjectival).otherwise(stopped)

    along = F.filter("nps", lambda y: (y["b"] == d["b"]) & (y["e"] <= d["head_e"]))
    seen = F.transform(along, lambda y: F.struct(y["e"].alias("e"), last_child(y).alias("kid"), found("pps", lambda p: p["id"] == y["kid"]).alias("tail")))
    return F.aggregate(seen, kinds(d["head_e"], d["head_b"].isNotNull(), d["adjuncts"], d["comp"], d["tails"]), cut)


def _parted(d: Column, whole: Column, head_b: Column, head_e: Column, specs: Column, adjuncts: Column, comp: Column) -> Column:
    """A phrase begun anew, with this head."""
    none = lambda kind: F.lit(None).cast(kind)
    values = {
        "id": d["id"], "b": whole["b"], "e": whole["e"], "det": F.lit("NoDet"), "person": none("string"), "det_b": none("int"), "det_e": none("int"),
        "head_b": head_b, "head_e": head_e, "head_class": none("string"), "specs": specs, "adjuncts": adjuncts, "comp": comp.cast(SPAN), "tails": d["tails"],
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _run(x: Column) -> Column:
    """The last of the noun phrases in a row from ``x`` on that something follows; ``x`` if nothing follows it."""
    others = F.filter(after(x), lambda y: ~is_phrase(y, "NP"))
    bound = F.coalesce(first_id(others), F.lit(1 << 30))
    held = F.filter(nodes_where(lambda y: (y["parent"] == x["parent"]) & (y["id"] >= x["id"]) & (y["id"] < bound)), lambda y: y["last"] < at(x["parent"])["last"])
    return F.coalesce(F.element_at(F.when(F.size(held) > 0, held), -1), x)


def _parenthesis(rows: DataFrame) -> DataFrame:
    """Adds to each phrase of _cl: whole, its first child, and what stands in a parenthesis after it (opened, closed)."""
    rows = stage(rows, _p1=extended("_cl", run=lambda d: F.when(is_phrase(d["first"], "NP"), _run(d["first"]))))
    rows = stage(rows, _p2=extended("_p1", comma=lambda d: sibling(d["run"], 1)))
    rows = stage(rows, _p3=extended("_p2", second=lambda d: F.when(is_word(d["comma"], ","), sibling(d["comma"], 1))))
    rows = stage(rows, _p4=extended("_p3", third=lambda d: F.when(has_lemma(d["second"], "or"), sibling(d["second"], 1))))
    over = lambda x: F.when(is_phrase(x, "NP"), _run(x)).when(is_phrase(x, "VP", "S", "SBAR", "PP"), x)
    rows = stage(rows, _p5=extended("_p4", second_end=lambda d: over(d["second"]), third_end=lambda d: over(d["third"])))
    ends = lambda x: sibling(x, 1)["id"].isNull()
    closes = lambda x: is_word(sibling(x, 1), ",") & ends(sibling(x, 1))
    is_s = lambda x: is_phrase(x, "S")

    def inner(d: Column) -> Column:
        two, three = d["second_end"], d["third_end"]
        second = F.struct(d["second"].alias("opened"), two["e"].alias("e"))
        third = F.struct(d["third"].alias("opened"), three["e"].alias("e"))
        return F.when(two["id"].isNotNull() & closes(two), second).when(three["id"].isNotNull() & ~is_s(d["third"]) & closes(three), third).when(two["id"].isNotNull() & ~is_s(d["second"]) & ends(two), second)

    return stage(rows, _par=extended("_p5", inner=inner)).drop("_p1", "_p2", "_p3", "_p4", "_p5")


def _clause_shape(d: Column) -> Column:
    """How a phrase is divided: the head's range, what stands in apposition, and the clause or phrase that modifies it; null where nothing is."""
    whole, first, second, tail = d["whole"], d["first"], d["next"], d["tail"]
    opened, end, run = d["inner"]["opened"], d["inner"]["e"], d["run"]
    named = lambda b, e: F.exists("marks", lambda m: (m["kind"] != "Time") & (m["b"] == b) & (m["e"] == e))
    turned = ~named(first["b"], run["e"]) & named(opened["b"], end)
    none = F.lit(None).cast("int")

    def shape(head_b: Column, head_e: Column, kind: str, b: Column, e: Column) -> Column:
        return F.struct(head_b.alias("head_b"), head_e.alias("head_e"), F.lit(kind).alias("kind"), b.alias("b"), e.alias("e"))

    opens = is_phrase(first, "NP") & second["id"].isNotNull()
    return (
        F.when(whole["id"].isNull(), shape(none, none, "", none, none).cast("struct<head_b: int, head_e: int, kind: string, b: int, e: int>"))
        .when(opens & is_phrase(second, "SBAR", "S", "VP"), shape(first["b"], first["e"], "CP", second["b"], second["e"]))
        .when(opens & is_phrase(opened, "NP") & turned, shape(opened["b"], end, "Appos", first["b"], run["e"]))
        .when(opens & is_phrase(opened, "NP"), shape(first["b"], run["e"], "Appos", opened["b"], end))
        .when(opens & is_phrase(opened, "VP", "SBAR"), shape(first["b"], run["e"], "CP", opened["b"], end))
        .when(opens & is_phrase(opened, "PP") & F.exists("pps", lambda p: p["id"] == opened["id"]), shape(first["b"], run["e"], "PP", opened["b"], opened["e"]))
        .when(is_phrase(tail, "S"), shape(whole["b"], tail["b"] - 1, "CP", tail["b"], tail["e"]))
    )


def _with_clause(x: Column) -> Column:
    d, shape = x["dp"], x["shape"]
    part = span(shape["kind"], shape["b"], shape["e"])
    listed = lambda kind: F.when(shape["kind"] == kind, F.array(part)).otherwise(no_spans())
    parted = _parted(d, x["whole"], shape["head_b"], F.when(shape["kind"] == "CP", shape["b"] - 1).otherwise(shape["head_e"]), listed("Appos"), listed("PP"), F.when(shape["kind"] == "CP", part))
    return F.when(shape["head_b"].isNotNull(), parted).otherwise(d)


def head_range(d: Column) -> tuple[Column, Column]:
    """First and last word of determiner and head; a genitive's clitic is no part of it."""
    own = (d["det"] == "Clitic") | d["det_b"].isNull()
    return F.when(own, d["head_b"]).otherwise(d["det_b"]), F.when(own, d["head_e"]).otherwise(F.coalesce(d["head_e"], d["det_e"]))


def _with_name(rows: DataFrame, name: str) -> DataFrame:
    """A name at the end of the head becomes the head; the nouns before it stand in apposition."""
    leaf = lambda i: F.get("words", i)
    rows = stage(rows, _n1=F.transform(name, lambda d: F.struct(d.alias("dp"), head_range(d)[0].alias("b"), head_range(d)[1].alias("e"))))
    rows = stage(rows, _n2=extended("_n1", whole=lambda x: noun_phrase_at(x["b"], x["e"]), name=lambda x: _entity(lambda m: (m["e"] == x["e"]) & (m["b"] > x["b"]) & leaf(m["b"])["word"].rlike(r"^\p{Lu}"))))
    fits = lambda x: x["whole"]["id"].isNotNull() & is_word(leaf(x["name"]["b"] - 1), *NOUNS)
    parted = lambda x: _parted(x["dp"], x["whole"], x["name"]["b"], x["name"]["e"], F.array(span("Appos", x["b"], x["name"]["b"] - 1)), no_spans(), F.lit(None))
    return stage(rows, _named=F.transform("_n2", lambda x: F.when(fits(x), parted(x)).otherwise(x["dp"])))


def _with_determiner(rows: DataFrame) -> DataFrame:
    """A pronoun alone, a genitive pronoun or an article before the head, or the clitic of a genitive in it."""
    rows = stage(rows, _d1=F.transform("_named", lambda d: F.struct(d.alias("dp"), F.when(d["b"] == d["e"], F.get("words", d["b"])).alias("only"), noun_phrase_at(d["b"], d["e"]).alias("whole"))))
    rows = stage(rows, _d2=extended("_d1", first=lambda x: F.get("words", x["whole"]["b"]), clitic=lambda x: found("words", lambda y: is_word(y, "POS") & y["b"].between(x["dp"]["head_b"], x["dp"]["head_e"]) & y["b"].between(x["whole"]["b"], x["whole"]["e"]))))

    def kind(x: Column) -> Column:
        alone = F.when(is_word(x["only"], "PRP"), person_of(x["only"]["lemma"]))
        genitive = F.when(is_word(x["first"], "PRP$"), person_of(x["first"]["lemma"]))
        article = F.when(is_word(x["first"], "DT"), article_of(x["first"]["lemma"]))
        value = lambda kind, person, i: F.struct(kind.alias("kind"), person.cast("string").alias("person"), i.alias("i"))
        none = F.lit(None)
        return F.when(alone.isNotNull(), value(F.lit("Pronoun"), alone, x["only"]["b"])).when(genitive.isNotNull(), value(F.lit("Genitive"), genitive, x["first"]["b"])).when(article.isNotNull(), value(article, none, x["first"]["b"])).when(x["clitic"]["id"].isNotNull(), value(F.lit("Clitic"), none, x["clitic"]["b"]))

    rows = stage(rows, _d3=extended("_d2", kind=kind))

    def made(x: Column) -> Column:
        d, k, i = x["dp"], x["kind"]["kind"], x["kind"]["i"]
        head_b = F.when(k == "Pronoun", None).when(k == "Clitic", i + 1).when(d["head_b"] == i, i + 1).otherwise(d["head_b"])
        values = {
            "id": d["id"], "b": d["b"], "e": d["e"], "det": k, "person": x["kind"]["person"], "det_b": i, "det_e": i, "head_b": head_b, "head_e": F.when(k != "Pronoun", d["head_e"]), "head_class": d["head_class"],
            "specs": F.when(k == "Clitic", F.concat(F.array(span("Gen", d["head_b"], i - 1)), d["specs"])).otherwise(d["specs"]), "adjuncts": d["adjuncts"], "comp": F.when(k != "Pronoun", d["comp"]), "tails": d["tails"],
        }
        return F.when(k.isNull(), d).otherwise(F.struct(*[v.alias(c) for c, v in values.items()]))

    return stage(rows, _det=F.transform("_d3", made))


def _with_class(d: Column) -> Column:
    name = _entity(lambda m: ((m["b"] == d["head_b"]) & (m["e"] == d["head_e"])) | ((m["b"] == d["b"]) & (m["e"] == d["e"])))
    return d.withField("head_class", F.when(d["head_b"].isNotNull(), F.coalesce(name["kind"], d["head_class"])).otherwise(d["head_class"]))


def split(rows: DataFrame, name: str) -> DataFrame:
    """Splits all phrases of an array of them, once more if they were split before."""
    keep = rows.columns
    rows = stage(rows, _folded=F.transform(name, lambda d: F.struct(d.alias("dp"), _without_tails(d).alias("cut"))))

    def shortened(x: Column) -> Column:
        d, cut = x["dp"], x["cut"]
        return d.withField("head_e", F.when(d["head_b"].isNotNull(), cut["end"]).otherwise(d["head_e"])).withField("adjuncts", cut["adjuncts"]).withField("comp", cut["comp"]).withField("tails", cut["tails"])

    rows = stage(rows, _tail=F.transform("_folded", shortened))
    end = lambda d: F.coalesce(F.array_min(F.transform(F.filter(d["adjuncts"], lambda a: a["kind"] == "PP"), lambda a: a["b"])) - 1, d["e"])
    rows = stage(rows, _ends=F.transform("_tail", lambda d: F.struct(d.alias("dp"), end(d).alias("end"))))
    rows = stage(rows, _whole=F.transform("_ends", lambda x: F.struct(x["dp"].alias("dp"), noun_phrase_at(x["dp"]["b"], x["end"]).alias("whole"))))
    rows = stage(rows, _firstly=extended("_whole", first=lambda x: first_child(x["whole"]), tail=lambda x: last_child(x["whole"])))
    rows = stage(rows, _cl=extended("_firstly", next=lambda x: sibling(x["first"], 1)))
    rows = _parenthesis(rows)
    rows = stage(rows, _shaped=extended("_par", shape=_clause_shape))
    rows = stage(rows, _clause=F.transform("_shaped", _with_clause))
    rows = _with_determiner(_with_name(rows, "_clause"))
    rows = stage(rows, **{f"_{name}": F.transform("_det", _with_class)})
    return rows.select(*[c for c in keep if c != name], F.col(f"_{name}").alias(name))


def with_noun_phrases(rows: DataFrame) -> DataFrame:
    """Adds to rows of ``sentences`` nps and words (nodes), pps and dps: all prepositional phrases, and all noun phrases and nouns, split."""
    rows = stage(rows, nps=nodes_where(lambda x: is_phrase(x, "NP")), words=nodes_where(lambda x: x["leaf"]))
    return split(stage(with_prepositions(rows), dps=F.transform(nodes_where(lambda x: is_phrase(x, "NP") | is_word(x, *NOUNS)), _unsplit)), "dps")


def head_text(d: Column) -> Column:
    """Determiner and head as text; of a genitive the head alone."""
    determiner = F.when((d["det"] != "Clitic") & d["det_b"].isNotNull(), text_of(d["det_b"], d["det_e"]))
    return F.concat_ws(" ", determiner, F.when(d["head_b"].isNotNull(), text_of(d["head_b"], d["head_e"])))


def noun_phrases(nodes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """A row for each noun phrase and noun: sent_id, node_id, b, e, det, person, determiner, head, head_class, specs, complement, adjuncts (texts), text."""
    rows = with_noun_phrases(sentences(nodes, marks)).select("sent_id", "n", F.explode("dps").alias("d"))
    d = F.col("d")
    texts = lambda spans: F.transform(spans, lambda s: text_of(s["b"], s["e"]))
    some = lambda b, e: F.when(b.isNotNull(), text_of(b, e))
    return written(rows.select("sent_id", d["id"].alias("node_id"), d["b"].alias("b"), d["e"].alias("e"), d["det"].alias("det"), d["person"].alias("person"), some(d["det_b"], d["det_e"]).alias("determiner"), some(d["head_b"], d["head_e"]).alias("head"), d["head_class"].alias("head_class"), texts(d["specs"]).alias("specs"), some(d["comp"]["b"], d["comp"]["e"]).alias("complement"), texts(d["adjuncts"]).alias("adjuncts"), head_text(d).alias("text")), "noun-phrases")
