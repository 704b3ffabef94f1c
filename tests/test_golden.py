"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import hashes, tags, text
from lexmill.operators import gazetteer, graph, joins, lexicon, mentions, sequences, sets, spans
from tests.conftest import rows_of


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


GRAPH = [(1, 2), (1, 3), (1, 5), (1, 6), (8, 6), (8, 11), (9, 11), (10, 1), (10, 8), (10, 9), (2, 4), (4, 7)]


def test_reachable_within_two_hops(spark):
    starts = spark.createDataFrame([(10,)], "node long")
    found = rows_of(graph.reachable(edges(spark, GRAPH), starts, 2), "node", "distance")
    assert found == [(1, 1), (2, 2), (3, 2), (5, 2), (6, 2), (8, 1), (9, 1), (10, 0), (11, 2)]


def test_neighbours_both_ways(spark):
    one = spark.createDataFrame([(1,)], "node long")
    assert [r[0] for r in rows_of(graph.neighbours(edges(spark, GRAPH), one), "neighbour")] == [2, 3, 5, 6]
    eleven = spark.createDataFrame([(11,)], "node long")
    assert [r[0] for r in rows_of(graph.neighbours(edges(spark, GRAPH), eleven, backward=True), "neighbour")] == [8, 9]


def test_walks_may_return(spark):
    starts = spark.createDataFrame([(1,)], "node long")
    found = graph.walks(edges(spark, [(1, 2), (2, 1)]), starts, 3)
    assert sorted(r["path"] for r in found.collect()) == [[1], [1, 2], [1, 2, 1], [1, 2, 1, 2]]


def test_ancestors_end_in_cycles(spark):
    links = spark.createDataFrame([(1, 12), (1, 11), (12, 122), (12, 121), (11, 112), (11, 111), (7, 8), (8, 7)], "sub long, super long")
    found = [b for a, b in rows_of(graph.ancestors(links), "sub", "super") if a == 1]
    assert found == [1, 11, 12, 111, 112, 121, 122]
    assert [b for a, b in rows_of(graph.ancestors(links), "sub", "super") if a == 7] == [7, 8]


def test_islands_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    assert rows_of(graph.islands(edges(spark, pairs), nodes), "node", "island") == [(i, find(i)) for i in range(60)]


def test_bags_keep_repeats(spark):
    left = spark.createDataFrame([(v,) for v in (1, 2, 6, 7, 9)], "v int")
    right = spark.createDataFrame([(v,) for v in (1, 6, 9, 7, 11, 11)], "v int")
    assert rows_of(sets.bag_intersection(left, right, "v"), "v") == [(1,), (6,), (7,), (9,)]
    assert rows_of(sets.bag_union(left, right, "v"), "v") == [(v,) for v in (1, 2, 6, 7, 9, 11, 11)]
    assert rows_of(sets.fold_bags([left, right, left], "v", union=False), "v") == [(1,), (6,), (7,), (9,)]


NAMES = ["a", "b", "b c", "b d e", "b d f", "c", "c d e f", "c d e f"]


def test_greedy_matching(spark):
    docs = spark.createDataFrame([(1, "x b c x y z a b d f x c d c d e f b".split())], "doc_id long, words array<string>")
    names = spark.createDataFrame([(n.split(),) for n in NAMES], "name array<string>")
    assert rows_of(gazetteer.annotate(docs, names), "b", "e") == [(1, 3), (6, 7), (7, 10), (13, 17), (17, 18)]


def test_greedy_matching_never_goes_back(spark):
    docs = spark.createDataFrame([(1, "b d x".split()), (2, []), (3, None)], "doc_id long, words array<string>")
    names = spark.createDataFrame([("b".split(),), ("b d e".split(),)], "name array<string>")
    assert gazetteer.annotate(docs, names).collect() == []


def loop(words, names):
    known, at, out = {tuple(n) for n in names}, 0, []
    prefixes = {n[:i] for n in known for i in range(1, len(n) + 1)}
    while at < len(words):
        n = 0
        while at + n < len(words) and tuple(words[at : at + n + 1]) in prefixes:
            n += 1
        if n and tuple(words[at : at + n]) in known:
            out.append((at, at + n))
            at += n
        else:
            at += 1
    return out


def test_greedy_matching_equals_a_loop(spark):
    rng = random.Random(1)
    names = [[rng.choice("abc") for _ in range(rng.randint(1, 4))] for _ in range(12)]
    texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, words array<string>")
    found = gazetteer.annotate(docs, spark.createDataFrame([(n,) for n in names], "name array<string>"))
    wanted = sorted((i, b, e) for i, t in enumerate(texts) for b, e in loop(t, names))
    assert rows_of(found, "doc_id", "b", "e") == wanted


@pytest.mark.parametrize(("span", "how"), [((1, 6), "Coincide"), ((2, 4), "RinL"), ((0, 9), "LinR"), ((6, 8), "LbeforeR"), ((0, 1), "RbeforeL"), ((0, 3), "RoverlapL"), ((4, 8), "LoverlapR")])
def test_relative_position(spark, span, how):
    found = spark.range(1).select(spans.relative_position(F.lit(1), F.lit(6), F.lit(span[0]), F.lit(span[1])))
    assert found.first()[0] == how


def test_forest_and_maximal_spans(spark):
    rows = spark.createDataFrame([(1, 2, 4), (1, 5, 8), (1, 1, 8), (1, 2, 8), (1, 5, 7)], "s int, b int, e int")
    parents = {(r["b"], r["e"]): (r["parent_b"], r["parent_e"]) for r in spans.range_forest(rows, ["s"]).collect()}
    assert parents == {(1, 8): (None, None), (2, 8): (1, 8), (2, 4): (2, 8), (5, 8): (2, 8), (5, 7): (5, 8)}
    assert rows_of(spans.maximal_spans(rows, ["s"]), "b", "e") == [(1, 8)]


def test_slices(spark):
    row = spark.createDataFrame([(["b", "c"], ["a", "b", "c"])], "x array<string>, y array<string>")
    assert row.select(spans.is_slice(F.col("x"), F.col("y")), spans.is_strict_slice(F.col("y"), F.col("y")), spans.is_slice(F.col("y"), F.col("x"))).first()[:] == (True, False, False)


def test_sweep(spark):
    names = [(1, 0, 2, "Person"), (1, 5, 8, "Org"), (1, 10, 12, "Loc"), (2, 3, 5, "Org"), (4, 1, 2, "Loc")]
    found = [(1, 0, 2, [1]), (1, 6, 7, [2]), (1, 11, 14, [3]), (1, 20, 21, [4]), (2, 2, 6, [1]), (3, 2, 6, [1])]
    merged = mentions.merge(spark.createDataFrame(names, "doc_id long, b long, e long, ne string"), spark.createDataFrame(found, "doc_id long, b long, e long, uids array<long>"))
    one = [(1, 0, 2, "Person", [1]), (1, 5, 8, "Org", None), (1, 10, 12, "Loc", None), (1, 20, 21, None, [4])]
    assert sorted(tuple(r) for r in merged.collect()) == [*one, (2, 2, 6, None, [1]), (3, 2, 6, None, [1]), (4, 1, 2, "Loc", None)]


def test_resolution(spark):
    merged = spark.createDataFrame(
        [(1, 0, 1, "Org", [1, 2]), (1, 2, 3, "Org", [2]), (1, 4, 5, "Org", None), (1, 6, 7, None, [2]), (1, 8, 9, None, [1, 2]), (1, 10, 11, "Org", [1, 3])],
        "doc_id long, b long, e long, ne string, uids array<long>",
    )
    classes = spark.createDataFrame([(1, "Organization"), (2, "Person"), (3, "Organization")], "qid long, cls string")
    found = {r["b"]: (r["state"], r["cls"], r["uids"]) for r in mentions.resolve(merged, classes).collect()}
    assert found == {0: ("resolved", "Organization", [1]), 2: ("unresolved_uid", None, []), 4: ("unresolved_uid", None, []), 6: ("resolved", "Person", [2]), 8: ("unresolved_class", None, [1, 2]), 10: ("ambiguous", None, [3, 1])}


def test_links_go_to_the_first_that_fits(spark):
    rows = [(1, 1, ["Oscar", "Munoz"], "resolved", "Person", "Person"), (1, 2, ["United", "Airlines"], "resolved", "Org", "Organization"), (1, 3, ["Munoz"], "unresolved_uid", "Person", None), (1, 4, ["Dao"], "unresolved_uid", "Person", None), (1, 5, ["Airlines"], "unresolved_uid", "Person", None)]
    found = mentions.link(spark.createDataFrame(rows, "doc_id long, ord int, words array<string>, state string, ne string, cls string"))
    assert {r["ord"]: r["ref"] for r in found.collect()} == {1: None, 2: None, 3: 1, 4: None, 5: None}


def test_linkable_spans(spark):
    tagged = spark.createDataFrame([("NNP MD MD NNP NNP".split(), b, e) for b, e in ((0, 1), (1, 4), (1, 3))], "t array<string>, b int, e int")
    assert [r[0] for r in tagged.select(tags.has_linkable(F.col("t"), F.col("b"), F.col("e"))).collect()] == [True, True, False]
    three = spark.createDataFrame([("NN",), ("CD",), ("VB",)], "t string").select(tags.is_noun(F.col("t")))
    assert [r[0] for r in three.collect()] == [True, None, False]


def test_adjusted_index(spark):
    rows = spark.createDataFrame([(1, i, i in (6, 7)) for i in range(10)], "s int, i int, x boolean")
    found = {r["idx"]: r["adjusted"] for r in sequences.adjust_index(rows, ["s"], ["i"], F.col("x")).collect()}
    assert (found[5], found[6], found[8]) == (5, None, 6)


def test_runs_of_names(spark):
    words = "Oscar/PERSON Munoz/PERSON ,/O United/ORGANIZATION Airlines/ORGANIZATION 's/O a/b/PERSON".split()
    rows = spark.createDataFrame(list(enumerate(words)), "i int, t string").select(F.lit(1).alias("s"), "i", text.token_and_tag(F.col("t")).alias("p")).select("s", "i", "p.word", tags.name_class(F.col("p.tag")).alias("ne"))
    found = sequences.joined_runs(rows, ["s"], ["i"], "ne", "word", drop="Other")
    assert rows_of(found, "b", "ne", "words") == [(0, "Person", "Oscar Munoz"), (3, "Org", "United Airlines"), (6, "Person", "a/b")]


def test_cut_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "p string, n int").withColumn("g", F.lit(1))
    assert rows_of(sequences.histogram_cut(rows, ["g"], [F.col("n").desc()], "n", 0.9), "p") == [("a",), ("b",)]
    assert rows_of(sequences.histogram_cut(rows, ["g"], [F.col("n").desc()], "n", 0.91), "p") == [("a",), ("b",), ("c",)]


def test_head_match_takes_one_row_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k int, l string")
    right = spark.createDataFrame([(3, "x"), (3, "y"), (4, "z")], "k int, r string")
    assert rows_of(joins.head_match_join(left, right, "k", ["l"], ["r"]).na.fill("-"), "k", "l", "r") == [(1, "a", "-"), (2, "b", "-"), (3, "c", "x")]


def test_patterns(spark):
    rows = [("s", "Passive", "PP-by", "NP-SBJ", None, 2), ("s", "Active", "NP-SBJ", "NP-1", None, 3), ("s", "Active", "NP-SBJ", None, None, 1), ("s", "Active", "NP", "S", "PP-to-ing", 1)]
    frame = spark.createDataFrame(rows, "sense string, voice string, arg0 string, arg1 string, arg2 string, n int").withColumns({"arg3": F.lit(None).cast("string"), "arg4": F.lit(None).cast("string")})
    merged = lexicon.merge_patterns(frame, ["sense"]).na.fill("-")
    assert rows_of(merged, "arg0", "arg1", "arg2", "n") == [("NP-SBJ", "-", "-", 1), ("NP-SBJ", "NP-1", "-", 5), ("NP-SBJ", "SBAR-1", "PP-to-ing", 1)]
    tops = lexicon.top_patterns(lexicon.merge_patterns(frame, ["sense"]), ["sense"])
    assert rows_of(tops.na.fill("-"), "arg1", "n") == [("NP-1", 6), ("SBAR-1", 2)]


def test_scalars(spark):
    row = spark.range(1).select(
        text.item_id(F.lit("Q42")), text.item_id(F.lit("q42")), text.item_id(F.lit("q42"), any_case=True), text.leading_number(F.lit("12ab")), text.hexadecimal(F.lit("1f")), text.american(F.lit("organise")), text.american(F.lit("rise")),
        text.plain_tag(F.lit("NP-SBJ-1")), text.plain_tag(F.lit("-NONE-")), text.link_ids(F.lit("NP-SBJ-1-2")), text.sense_number(F.lit("hold"), F.lit("5")), text.wordnet_id(F.lit("synset-dirty-case_like-this-one-noun-2")),
    ).first()
    assert row[:11] == (42, None, 42, 12, 31, "organize", "rise", "NP", "-NONE-", [1, 2], "2.5")
    assert row[11].asDict() == {"name": "dirty-case_like-this-one", "pos": "noun", "n": 2}


def test_xxhash(spark):
    rows = spark.createDataFrame([("",), ("Hello World",), (None,)], "v string")
    found = rows.select(hashes.xxh32(F.col("v"), 0), hashes.xxh64(F.col("v"), 0)).collect()
    assert [(r[0], None if r[1] is None else int(r[1])) for r in found] == [(0x02CC5D05, 0xEF46DB3751D8E999), (0xB1FD16EE, 0x6334D20719245BC2), (None, None)]


def test_meaning_graph_tables(spark):
    from lexmill.operators import meaning

    links = spark.createDataFrame([(1, "Agent", False, 1, 2), (1, "mod", True, 3, 2)], "sent_id long, rel string, is_modifier boolean, src int, dst int")
    assert rows_of(meaning.directed(links), "src", "dst") == [(1, 2), (2, 3)]
    vertices = spark.createDataFrame([(1, 1, "predicate", 1, 2, "fined", "Fining"), (1, 2, "entity", 0, 1, "He", None), (1, 3, "nominal", 3, 5, "a & b", None)], "sent_id long, id int, kind string, b int, e int, text string, frame string")
    assert rows_of(meaning.predicate_counts(vertices), "predicates", "verbs") == [(2, 1)]
    assert rows_of(meaning.label(vertices), "id", "label") == [(1, "Fining"), (2, "He"), (3, "a & b")]
    tags_of = spark.createDataFrame([(1, 3, 4, "ORG"), (1, 0, 1, "PERSON"), (1, 2, 4, "x")], "sent_id long, b int, e int, tag string")
    assert rows_of(meaning.tagged(vertices, tags_of), "id", "tags") == [(1, []), (2, ["PERSON"]), (3, ["ORG"])]
    verbs = spark.createDataFrame([(1, "take", ["off", "now"]), (2, "take", ["it"]), (3, "organise", [])], "verb_id int, lemma string, following array<string>")
    senses = spark.createDataFrame([("take", "1.1"), ("take", "1.2"), ("organize", "1.1")], "lemma string, sense string")
    idioms = spark.createDataFrame([("take", "1.2", ["off"])], "lemma string, sense string, idiom array<string>")
    assert rows_of(meaning.verb_senses(verbs, senses, idioms), "verb_id", "sense") == [(1, "1.2"), (2, "1.1"), (2, "1.2"), (3, "1.1")]
    scores = spark.createDataFrame([(2, 3, 4), (1, 0, 0)], "m int, n int, t int").select(meaning.frame_score(F.col("m"), F.col("n"), F.col("t")))
    assert [r[0] for r in scores.collect()] == [158.0, 0.0]
    matches = spark.createDataFrame([(1, "p", 2, 5), (1, "q", 2, 7), (1, "r", 1, 9)], "v int, pattern string, roles int, n int")
    assert rows_of(meaning.best_pattern(matches, ["v"]), "pattern") == [("q",)]

MEETING = [(1, 9), (9, 10), (2, 11), (1, 3), (2, 3), (3, 12), (1, 4), (4, 5), (2, 5), (1, 5), (1, 6), (6, 7), (8, 7), (2, 8), (1, 13), (13, 14), (2, 14), (2, 13)]


@pytest.mark.parametrize(
    ("a", "b", "half", "wanted"),
    [
        (1, 2, 1, [([1, 3], [2, 3]), ([1, 5], [2, 5]), ([1, 13], [2, 13])]),
        (1, 2, 3, [([1, 3], [2, 3]), ([1, 4, 5], [2, 5]), ([1, 5], [2, 5]), ([1, 6, 7], [2, 8, 7]), ([1, 13], [2, 13])]),
        (1, 7, 3, [([1, 6, 7], [7])]),
        (1, 2, 0, []),
    ],
)
def test_meeting_paths(spark, a, b, half, wanted):
    pairs = spark.createDataFrame([(a, b)], "a long, b long")
    assert rows_of(graph.meeting_paths(edges(spark, MEETING), pairs, half), "left", "right") == wanted
