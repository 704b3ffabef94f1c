"""Tense, aspect, voice, auxiliaries and negation of the verbs of parsed sentences.

Grammar is a table: what stands before a verb is written as a chain, for example
``VBN be.VBN have.VBD``, and the first rule whose pattern fits the chain gives
tense, aspect, voice and the number of words. Each verb points to the verb before
it; chains follow these pointers, auxiliaries come from the heads of the verb
phrases above. All of it are column expressions over a sentence's array of nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.sentences import NODES, above, after, at, before, extended, first_child, first_id, has_lemma, is_phrase, is_verb, is_word, last_id, nodes_where, parent, sentences, stage

#: Chain of a verb and the verbs before it, nearest first -> tense, aspect, voice, words. ``?`` takes the tense of the last word: VBD is past.
RULES = (
    (r"^VB[PZ]?( |$)", "Present", "Simple", "Active", 1),
    (r"^VBN$", "Present", "Simple", "Passive", 1),
    (r"^VBG$", "Present", "Progressive", "Active", 1),
    (r"^VBD$", "Past", "Simple", "Active", 1),
    (r"^VBG be\.VBN have\.", "?", "PerfectProgressive", "Active", 3),
    (r"^VBG be\.(?!VBN|VBG)", "?", "Progressive", "Active", 2),
    (r"^VB[ND] have\.", "?", "Perfect", "Active", 2),
    (r"^VB[ND] be\.VBN have\.", "?", "Perfect", "Passive", 3),
    (r"^VB[ND] be\.(?!VBN|VBG)", "?", "Simple", "Passive", 2),
    (r"^VB[ND] be\.VBG be\.VBN have\.", "?", "PerfectProgressive", "Passive", 4),
    (r"^VB[ND] be\.VBG be\.(?!VBN|VBG)", "?", "Progressive", "Passive", 3),
)

# Lemmas that a first pass leaves to later passes, as they may be auxiliaries.
LATER = (("be", "have", "do", "go", "use"), ("be", "have"), ())


def _previous(x: Column) -> Column:
    """The nearest verb before the phrase of a verb, else before the verb phrase around that."""
    phrase = parent(x)
    around = parent(phrase)
    verbs = lambda siblings: last_id(F.filter(siblings, is_verb))
    return F.coalesce(verbs(before(phrase)), F.when(is_phrase(around, "VP"), verbs(before(around))))


def _auxiliary(lemma: Column, first: Column) -> Column:
    """Id of the nearest modal, ``to`` or ``do`` that heads one of the verb phrases right above a verb group."""
    around = above(at(first))
    bound = F.coalesce(last_id(F.filter(around, lambda y: ~is_phrase(y, "VP"))), F.lit(-1))
    heads = F.transform(F.filter(around, lambda y: y["id"] > bound), lambda y: at(y["id"] + 1))
    return last_id(F.filter(heads, lambda c: is_word(c, "MD", "TO") | (has_lemma(c, "do") & (lemma != "do"))))


def _compound(to: Column) -> Column:
    """Ids of the words that make one auxiliary with ``to``: have to, ought to, used to, be going to."""
    own = parent(to)
    clause = parent(own)
    outer = parent(clause)
    head = first_child(outer)
    opener = first_child(parent(outer))
    fits = (own["ord"] == 0) & is_phrase(clause, "S") & (clause["ord"] <= 1) & is_phrase(outer, "VP")
    one = has_lemma(head, "have", "ought") | (has_lemma(head, "use") & is_word(head, "VBD"))
    two = has_lemma(head, "go") & is_word(head, "VBG") & has_lemma(opener, "be")
    return F.when(fits & one, F.array(head["id"])).when(fits & two, F.array(opener["id"], head["id"])).otherwise(_none())


def _negation(x: Column) -> Column:
    """Id of the nearest ``not`` before a word, else after it."""
    none = lambda y: is_word(y, "RB") & has_lemma(y, "not", "n't")
    return F.coalesce(last_id(F.filter(before(x), none)), first_id(F.filter(after(x), none)))


def _none() -> Column:
    return F.expr("cast(array() as array<int>)")


def _rule(code: Column) -> Column:
    value = lambda t, a, v, s: F.struct(F.lit(t).alias("tense"), F.lit(a).alias("aspect"), F.lit(v).alias("voice"), F.lit(s).alias("size"))
    return F.coalesce(*[F.when(code.rlike(pattern), value(*result)) for pattern, *result in RULES])


def _open(later: tuple[str, ...], used: Column) -> Callable[[Column], Column]:
    """Whether a verb is for this pass and no part of a group found before."""
    return lambda v: ~v["lemma"].isin(*later, "") & ~F.array_contains(used, v["id"])


def with_verbs(rows: DataFrame) -> DataFrame:
    """Adds verbs to rows of ``sentences``: id, lemma, tense, aspect, voice, aux, neg, words (node ids), in the order of the passes."""
    keep = rows.columns
    rows = stage(rows, _back=F.transform(NODES, lambda x: F.when(is_verb(x), _previous(x))))
    hop = lambda i: F.get("_back", i)
    code = lambda i: F.concat(at(i)["lemma"], F.lit("."), at(i)["tag"])
    chain = lambda x: F.array(x["id"], hop(x["id"]), hop(hop(x["id"])), hop(hop(hop(x["id"]))))
    rows = stage(rows, _chains=F.transform(nodes_where(is_verb), lambda x: F.struct(x["id"].alias("id"), x["lemma"].alias("lemma"), x["tag"].alias("tag"), chain(x).alias("chain"))))
    words = lambda v: F.concat_ws(" ", v["tag"], *[code(v["chain"][i]) for i in (1, 2, 3)])
    rows = stage(rows, _ruled=F.filter(extended("_chains", rule=lambda v: _rule(words(v))), lambda v: v["rule"].isNotNull()))
    rows = stage(rows, _firsts=extended("_ruled", group=lambda v: F.slice(v["chain"], 1, v["rule"]["size"]), first=lambda v: F.get(v["chain"], v["rule"]["size"] - 1)))
    rows = stage(rows, _heads=extended("_firsts", head=lambda v: _auxiliary(v["lemma"], v["first"])))
    to = lambda v: F.when(is_word(at(v["head"]), "TO"), _compound(at(v["head"])))
    rows = stage(rows, _aux=extended("_heads", aux=lambda v: F.when(v["head"].isNull(), _none()).otherwise(F.concat(F.coalesce(to(v), _none()), F.array(v["head"])))))
    rows = stage(rows, _neg=extended("_aux", neg=lambda v: _negation(at(F.coalesce(F.get(v["aux"], 0), v["first"])))))
    tense = lambda v: F.when(v["rule"]["tense"] != "?", v["rule"]["tense"]).otherwise(F.when(at(v["first"])["tag"] == "VBD", "Past").otherwise("Present"))
    own = lambda v: F.array_sort(F.array_distinct(F.array_compact(F.concat(v["aux"], F.array(v["neg"]), v["group"]))))
    verb = lambda v: F.struct(v["id"].alias("id"), v["lemma"].alias("lemma"), tense(v).alias("tense"), v["rule"]["aspect"].alias("aspect"), v["rule"]["voice"].alias("voice"), v["aux"].alias("aux"), v["neg"].alias("neg"), own(v).alias("words"))
    rows = stage(rows, _all=F.transform("_neg", verb))
    used, passes = _none(), []
    for i, later in enumerate(LATER):
        rows = stage(rows, **{f"_pass{i}": F.filter("_all", _open(later, used))})
        used = F.concat(used, F.flatten(F.transform(f"_pass{i}", lambda v: v["words"])))
        passes.append(f"_pass{i}")
    return stage(rows, verbs=F.concat(*passes)).select(*keep, "verbs")


def verb_properties(nodes: DataFrame) -> DataFrame:
    """A row for each verb of each sentence. nodes: node rows (see ``sources.penn``) with ``lemma``."""
    rows = with_verbs(sentences(nodes)).select("sent_id", "n", F.explode("verbs").alias("v"))
    leaf = lambda i: at(i)["b"]
    return rows.select("sent_id", leaf(F.col("v.id")).alias("verb_idx"), "v.lemma", "v.tense", "v.aspect", "v.voice", F.transform("v.aux", lambda i: at(i)["lemma"]).alias("aux"), at(F.col("v.neg"))["lemma"].alias("neg"), F.transform("v.words", leaf).alias("words"))
