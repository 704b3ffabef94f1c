"""Verbs, noun phrases, clauses and what silent elements stand for: sentences with known analyses."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.operators import arguments, clauses, frames, meaning_graph, noun_phrases, sentences, trees, verbs
from lexmill.operators import outlines as outlines_of
from lexmill.plans import catalog_syntax
from lexmill.sources import penn

CASES = [json.loads(line) for line in (Path(__file__).parent / "parsed_sentences.jsonl").read_text().splitlines()]


def parsed(spark, cases):
    """Node rows with lemmas, and marks, of (sent_id, case)."""
    text = spark.createDataFrame([(i, c["tree"]) for i, c in cases], "sent_id long, value string")
    nodes = penn.trees(text)
    words = {(r["sent_id"], r["b"]): r["word"] for r in nodes.where("is_leaf").collect()}
    given = {(i, int(k)): lemma for i, c in cases for k, lemma in c["lemmas"].items()}
    lemmas = spark.createDataFrame([(i, b, given.get((i, b), word)) for (i, b), word in words.items()], "sent_id long, idx int, lemma string")
    marks = spark.createDataFrame([(i, *m) for i, c in cases for m in c["marks"]], "sent_id long, b int, e int, kind string")
    return trees.with_lemmas(nodes, lemmas), marks


def cases_of(*kinds):
    return [(i, c) for i, c in enumerate(CASES) if c["kind"] in kinds]


def test_verbs_of_known_sentences(spark):
    cases = cases_of("verb")
    found = {(r["sent_id"], r["verb_idx"]): r for r in verbs.verb_properties(parsed(spark, cases)[0]).collect()}
    for i, c in cases:
        got = found[i, c["verb"]]
        assert (got["tense"], got["aspect"], got["voice"], got["aux"], got["neg"]) == (c["tense"], c["aspect"], c["voice"], c["aux"], c["neg"]), c["tree"]
    assert len(cases) == 33


def test_noun_phrases_of_known_sentences(spark):
    cases = cases_of("noun")
    rows = noun_phrases.noun_phrases(*parsed(spark, cases)).collect()
    for i, c in cases:
        got = min((r for r in rows if r["sent_id"] == i), key=lambda r: r["node_id"])
        want = (c["determiner"] or None, c["head"], c["head_class"], c["specs"], c["complement"], c["adjuncts"])
        assert (got["determiner"], got["head"], got["head_class"], got["specs"], got["complement"], got["adjuncts"]) == want, c["tree"]
    assert len(cases) == 17


@pytest.fixture(scope="module")
def analysed(spark):
    odd = ["(ROOT (NP (DT The) (NN end)))", "(ROOT (S (VP (VB go))))", "(X y)"]
    return clauses.analysed(*parsed(spark, cases_of("clause", "trace") + [(901 + i, {"tree": t, "lemmas": {}, "marks": []}) for i, t in enumerate(odd)]))


def test_subjects_complements_and_adjuncts(analysed):
    parts = clauses.clause_parts(analysed).collect()
    topics = {(r["sent_id"], r["verb_idx"]) for r in clauses.clause_tree(analysed).where("spec = 'Topic'").collect()}
    cases = cases_of("clause")
    for i, c in cases:
        own = sorted((r for r in parts if (r["sent_id"], r["verb_idx"]) == (i, c["verb"]) and r["kind"]), key=lambda r: r["ord"])
        texts = {role: [r["text"] for r in own if r["role"] == role] for role in ("subject", "complement", "adjunct")}
        assert texts == {"subject": [c["subject"]] if c["subject"] else [], "complement": c["complements"], "adjunct": c["adjuncts"]}, c["tree"]
        if c["det"]:
            assert [(r["det"], r["person"]) for r in own if r["role"] == "subject"] == [(c["det"], c["person"])], c["tree"]
        assert ((i, c["verb"]) in topics) == c["topic"]
    assert len(cases) == 12


def test_what_silent_elements_stand_for(analysed):
    found = clauses.referents(analysed).collect()
    cases = cases_of("trace")
    for i, c in cases:
        assert sorted([r["i"], r["text"]] for r in found if r["sent_id"] == i) == c["referents"], c["tree"]
    assert len(cases) == 11


def test_sentences_without_verbs_or_clauses(analysed):
    found = [(r["sent_id"], r["verb_idx"], r["lemma"]) for r in clauses.clause_tree(analysed).where("sent_id > 900").collect()]
    assert found == [(902, 0, "go")]
    assert [(r["role"], r["trace"], r["kind"]) for r in clauses.clause_parts(analysed).where("sent_id > 900").collect()] == [("subject", "PRO", None)]


def test_sentences_that_differ_in_other_words_are_analysed_once(spark, monkeypatch):
    cases = [(i, c) for i, c in enumerate(CASES)]
    odd = ["be.VBN have", "\0 1", "", "that", "he", "to"]
    worded = [(1000 + i, {"tree": f"(ROOT (S (NP (NNP N{i})) (VP (VBD met{i}) (NP (DT the) (NN x{i})) (SBAR (NP (DT this) (NN y{i})) (S (NP (PRP it)) (VP (VBD z))))) (. .)))", "lemmas": {}, "marks": []}) for i in range(20)]
    strange = [(2000 + i, worded[i][1] | {"lemmas": {str(k): lemma for k in range(9)}}) for i, lemma in enumerate(odd)]
    nodes, marks = parsed(spark, cases + worded + strange)
    plain = {r["sent_id"]: r for r in clauses.analysed_rows(sentences.sentences(nodes, marks)).select("sent_id", "n", "marks", *clauses.FOUND).collect()}
    seen, analyse = [], clauses.analysed_rows
    monkeypatch.setattr(clauses, "analysed_rows", lambda rows: seen.extend(r["sent_id"] for r in rows.select("sent_id").collect()) or analyse(rows))
    found = {r["sent_id"]: r for r in clauses.analysed(nodes, marks).collect()}
    assert len(plain) == 99 and found == plain
    assert len([i for i in seen if 1000 <= i < 2000]) == 1
    assert [v["lemma"] for v in found[1007]["verbs"]] == ["met7", "z"]


SF = "/root/testdata/sf0.001"


def all_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def worded(spark):
    """Nodes and marks of the known sentences, and of 30 that differ in words: names, a verb, a word that opens a clause, an adverb."""
    tree = "(ROOT (S (NP (NP (NNP N{i})) (, ,) (NP (NP (DT a) (NN f{i})) (PP (IN of) (NP (NNP {n})))) (, ,)) (VP (VBD met{k}) (NP (PRP$ his) (NN x{i})) (ADVP (RB {adverb})) (SBAR (IN {opener}) (S (NP (PRP it)) (VP (TO to) (VP (VB leave)))))) (. .)))"
    more = [(1000 + i, {"tree": tree.format(i=i, k=i % 3, n="ZA"[i % 2] + str(i), adverb=("Up", "there")[i % 2], opener=("after", "that", "as")[i % 3]), "lemmas": {"6": "", "7": ("sell", "go", "\0 7")[i % 3]}, "marks": [[0, 1, "Org"]]}) for i in range(30)]
    return parsed(spark, [(i, c) for i, c in enumerate(CASES)] + more)


@pytest.fixture(scope="module")
def outlines(worded):
    return clauses.analysed_outlines(*worded)


@pytest.fixture(scope="module")
def plain(worded):
    return clauses.analysed(*worded)


def graph_of(spark, rows, make):
    tree, parts, words = clauses.clause_tree(rows), clauses.clause_parts(rows), catalog_syntax.lexicon(spark)
    return make(frames.match_frames(tree, parts, words), tree, meaning_graph.phrases(rows), parts, frames.linked_clauses(tree, parts), words["relations"])


def test_graphs_are_made_once_a_kind_of_sentence(spark, outlines, plain):
    each, kinds = clauses.kinds_of_sentences(*outlines)
    found = meaning_graph.graph_of_sentences(each, *graph_of(spark, kinds, meaning_graph.named_graph))
    assert [all_of(t) for t in found] == [all_of(t) for t in graph_of(spark, plain, meaning_graph.meaning_graph)]
    assert each.where("sent_id >= 1000").select("kind").distinct().count() <= 6
    assert any(r[0] >= 1000 and "N9" in str(r[-1]) for r in all_of(found[0]))


def test_nodes_are_gathered_where_they_are_made(spark):
    plan = sentences.sentences(*catalog_syntax.sentences(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sent_id") == plan.count("REPARTITION_BY_NUM") > 0, plan


def test_sentences_stay_where_they_are_when_one_of_each_outline_is_found(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(clauses, "analysed_rows", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or rows)
    nodes, marks = catalog_syntax.sentences(spark, "/root/testdata/sf0.01")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # more than eight outlines take, less than 1500 sentences
    try:
        rows, chosen = clauses.analysed_outlines(nodes, marks)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "hashpartitioning(sent_id" not in plans[0], plans[0]
    assert (rows.count(), rows.select("outline").distinct().count()) == (1500, 8)


def test_outlines_are_taken_without_last_children(worded):
    rows = sentences.gathered(*worded)
    whole = sentences.with_kids(rows)
    assert all_of(rows.select("sent_id", outlines_of.outline())) == all_of(whole.select("sent_id", outlines_of.outline()))
    plain = outlines_of.outlined(whole).withColumn("outline", outlines_of.outline()).select("outline", F.to_json(F.struct("n", "marks")).alias("p")).distinct()
    assert plain.count() == plain.select("outline").distinct().count() == plain.select("p").distinct().count()


def test_parts_are_looked_up_once_an_outline(outlines, plain):
    found = clauses.clause_parts(clauses.as_sentences(outlines[1]))
    each = clauses.each_sentence(outlines[0], found, lemmas=("word",))
    assert all_of(clauses.parts_of_sentences(*outlines)) == all_of(each) == all_of(clauses.clause_parts(plain))
    assert found.count() < each.count() - 90


def test_referents_are_looked_up_once_an_outline(outlines, plain):
    assert all_of(clauses.referents_of_sentences(*outlines)) == all_of(clauses.referents(plain))


def test_argument_patterns_are_found_once_a_kind_of_sentence(spark, outlines, plain):
    asked = [(i, b, label, idx, h) for i in [*range(len(CASES)), *range(1000, 1030)] for b in (1, 7) for label, idx, h in (("arg0", 0, 1), ("arg0", 0, 2), ("arg1", 10, 1), ("arg2", 4, 1), ("arg3", i % 4, 0), ("arg4", 11, 1))]
    asked = spark.createDataFrame(asked, "sent_id long, verb_idx int, label string, idx int, h int")
    found = all_of(arguments.patterns_of_sentences(*outlines, asked))
    assert found == all_of(arguments.argument_patterns(arguments.argument_codes(plain, asked)))
    assert any("ADVP-up" in r for r in found) and any("ADVP-there" in r for r in found)
