"""Queries of parsed sentences: each customer gives a sentence of one of eight shapes, with its name, segment and nation in it.

The SQL states what is known of each shape and puts the words in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import arguments, clauses, frames, meaning_graph, noun_phrases, verbs
from lexmill.plans.catalog import query, read
from lexmill.plans.shared import written
from lexmill.sources import penn

#: C, G and N are the customer's name, segment and nation.
SHAPES = (
    "(ROOT (S (NP (NNP C)) (VP (VBZ wants) (S (VP (TO to) (VP (VB ship) (NP (DT the) (NN G)) (PP (IN to) (NP (NNP N))))))) (. .)))",
    "(ROOT (S (NP (DT The) (NN G)) (VP (VBD was) (VP (VBN bought) (PP (IN by) (NP (NNP C))))) (. .)))",
    "(ROOT (S (NP (PRP He)) (VP (VBD met) (NP (NP (DT the) (NN buyer)) (SBAR (WHNP (WP who)) (S (VP (VBD left) (NP (NNP N))))))) (. .)))",
    "(ROOT (S (NP (NNP C)) (VP (VBD told) (NP (PRP them)) (SBAR (IN that) (S (NP (PRP it)) (VP (MD would) (RB not) (VP (VB leave) (NP (NNP N))))))) (. .)))",
    "(ROOT (S (S (NP (NNP N)) (VP (VBZ buys) (NP (NN G)))) (, ,) (NP (NNP C)) (VP (VBD said)) (. .)))",
    "(ROOT (S (NP (NNP C)) (VP (VBD sold) (NP (NP (DT a) (NN G)) (VP (VBN made) (PP (IN in) (NP (NNP N)))))) (. .)))",
    "(ROOT (S (NP (NP (NNP C) (POS 's)) (NN agent)) (VP (VBD sold) (NP (NN G)) (PP (IN in) (NP (NNP N))) (SBAR (IN as) (S (NP (NNS prices)) (VP (VBD rose))))) (. .)))",
    "(ROOT (S (NP (NP (NNP C)) (, ,) (NP (NP (DT a) (NN firm)) (PP (IN of) (NP (NNP N)))) (, ,)) (VP (VBZ has) (VP (VBN bought) (NP (NN G)) (NP-TMP (DT this) (NN week)))) (. .)))",
)
LEMMAS = {"wants": "want", "was": "be", "bought": "buy", "met": "meet", "left": "leave", "told": "tell", "them": "they", "buys": "buy", "said": "say", "sold": "sell", "made": "make", "prices": "price", "rose": "rise", "has": "have", "He": "he", "The": "the"}
#: Sentences of a task.
SENTENCES = 20_000
#: shape, first word, end, kind.
MARKS = ((0, 0, 1, "Org"), (1, 5, 6, "Org"), (7, 0, 1, "Org"), (7, 10, 12, "Time"))


def sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node rows with lemmas, and marks."""
    said = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pieces = max(spark.sparkContext.defaultParallelism, read(spark, sf_dir, "customer").count() // SENTENCES)
    said = said.select(F.col("c_custkey").alias("sent_id"), (F.col("c_custkey") % len(SHAPES)).cast("int").alias("shape"), F.col("c_name").alias("C"), F.col("c_mktsegment").alias("G"), F.translate("n_name", " ", "_").alias("N")).repartition(pieces, "sent_id")  # nodes are gathered where they are made, so they are not shuffled
    rows = [(k, n["node_id"], n["last_id"], n["parent_id"], n["ord"], n["depth"], n["tag"], n["word"], LEMMAS.get(n["word"], n["word"]), n["b"], n["e"], n["is_leaf"]) for k, shape in enumerate(SHAPES) for n in penn.parse(shape)]
    shapes = spark.createDataFrame(rows, "shape int, node_id int, last_id int, parent_id int, ord int, depth int, tag string, word string, lemma string, b int, e int, is_leaf boolean")
    put = lambda c: F.when(F.col(c) == "C", F.col("C")).when(F.col(c) == "G", F.col("G")).when(F.col(c) == "N", F.col("N")).otherwise(F.col(c))
    nodes = said.join(F.broadcast(shapes), "shape").select("sent_id", "node_id", "last_id", "parent_id", "ord", "depth", "tag", put("word").alias("word"), put("lemma").alias("lemma"), "b", "e", "is_leaf")
    marks = said.join(F.broadcast(spark.createDataFrame(MARKS, "shape int, b int, e int, kind string")), "shape").select("sent_id", "b", "e", "kind")
    return nodes, marks


def analysed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.analysed(*sentences(spark, sf_dir))


def analysed_outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return clauses.analysed_outlines(*sentences(spark, sf_dir))


_SAID = """WITH said AS (SELECT c_custkey AS sent_id, c_custkey % 8 AS shape, c_name, c_mktsegment, replace(n_name, ' ', '_') AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
"""


def _put(column: str) -> str:
    return f"replace(replace(replace({column}, '<C>', c_name), '<G>', c_mktsegment), '<N>', n_name)"


@query(_SAID + """known(shape, verb_idx, lemma, tense, aspect, voice, aux, neg, words) AS (VALUES
  (0, 1, 'want', 'Present', 'Simple', 'Active', '', NULL, [1]), (0, 3, 'ship', 'Present', 'Simple', 'Active', 'to', NULL, [2, 3]),
  (1, 3, 'buy', 'Past', 'Simple', 'Passive', '', NULL, [2, 3]),
  (2, 1, 'meet', 'Past', 'Simple', 'Active', '', NULL, [1]), (2, 5, 'leave', 'Past', 'Simple', 'Active', '', NULL, [5]),
  (3, 1, 'tell', 'Past', 'Simple', 'Active', '', NULL, [1]), (3, 7, 'leave', 'Present', 'Simple', 'Active', 'would', 'not', [5, 6, 7]),
  (4, 1, 'buy', 'Present', 'Simple', 'Active', '', NULL, [1]), (4, 5, 'say', 'Past', 'Simple', 'Active', '', NULL, [5]),
  (5, 1, 'sell', 'Past', 'Simple', 'Active', '', NULL, [1]), (5, 4, 'make', 'Present', 'Simple', 'Passive', '', NULL, [4]),
  (6, 3, 'sell', 'Past', 'Simple', 'Active', '', NULL, [3]), (6, 9, 'rise', 'Past', 'Simple', 'Active', '', NULL, [9]),
  (7, 8, 'buy', 'Present', 'Perfect', 'Active', '', NULL, [7, 8]))
SELECT sent_id, verb_idx, lemma, tense, aspect, voice, aux, neg, array_to_string(words, ' ') AS words FROM said JOIN known USING (shape)""")
def verb_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verbs.verb_properties(sentences(spark, sf_dir)[0])
    return found.select("sent_id", "verb_idx", "lemma", "tense", "aspect", "voice", F.array_join("aux", " ").alias("aux"), "neg", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("words"))


@query(_SAID + f"""known(shape, node_id, b, e, det, person, determiner, head, head_class, specs, complement) AS (VALUES
  (0, 2, 0, 0, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL), (0, 3, 0, 0, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL), (0, 11, 4, 5, 'Definite', NULL, 'the', '<G>', NULL, '', NULL), (0, 13, 5, 5, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (0, 16, 7, 7, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (0, 17, 7, 7, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL),
  (1, 2, 0, 1, 'Definite', NULL, 'The', '<G>', NULL, '', NULL), (1, 4, 1, 1, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (1, 11, 5, 5, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL), (1, 12, 5, 5, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL),
  (2, 2, 0, 0, 'Pronoun', 'He', 'He', NULL, NULL, '', NULL), (2, 3, 0, 0, 'Pronoun', 'He', 'He', NULL, NULL, '', NULL), (2, 6, 2, 6, 'Definite', NULL, 'the', 'buyer', NULL, '', 'who left <N>'), (2, 7, 2, 3, 'Definite', NULL, 'the', 'buyer', NULL, '', NULL), (2, 9, 3, 3, 'NoDet', NULL, NULL, 'buyer', NULL, '', NULL), (2, 12, 4, 4, 'NoDet', NULL, NULL, 'who', NULL, '', NULL), (2, 16, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (2, 17, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL),
  (3, 2, 0, 0, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (3, 3, 0, 0, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (3, 6, 2, 2, 'Pronoun', 'They', 'them', NULL, NULL, '', NULL), (3, 7, 2, 2, 'Pronoun', 'They', 'them', NULL, NULL, '', NULL), (3, 11, 4, 4, 'Pronoun', 'It', 'it', NULL, NULL, '', NULL), (3, 12, 4, 4, 'Pronoun', 'It', 'it', NULL, NULL, '', NULL), (3, 18, 8, 8, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (3, 19, 8, 8, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL),
  (4, 3, 0, 0, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (4, 4, 0, 0, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (4, 7, 2, 2, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (4, 8, 2, 2, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (4, 10, 4, 4, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (4, 11, 4, 4, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL),
  (5, 2, 0, 0, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (5, 3, 0, 0, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (5, 6, 2, 6, 'Indefinite', NULL, 'a', '<G>', NULL, '', 'made in <N>'), (5, 7, 2, 3, 'Indefinite', NULL, 'a', '<G>', NULL, '', NULL), (5, 9, 3, 3, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (5, 14, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (5, 15, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL),
  (6, 2, 0, 2, 'Clitic', NULL, '''s', 'agent', NULL, '<C>', NULL), (6, 3, 0, 1, 'Clitic', NULL, '''s', '', NULL, '<C>', NULL), (6, 4, 0, 0, 'NoDet', NULL, NULL, '<C>', NULL, '', NULL), (6, 6, 2, 2, 'NoDet', NULL, NULL, 'agent', NULL, '', NULL), (6, 9, 4, 4, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (6, 10, 4, 4, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (6, 13, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (6, 14, 6, 6, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (6, 18, 8, 8, 'NoDet', NULL, NULL, 'prices', NULL, '', NULL), (6, 19, 8, 8, 'NoDet', NULL, NULL, 'prices', NULL, '', NULL),
  (7, 2, 0, 6, 'NoDet', NULL, NULL, '<C>', 'Org', 'a firm of <N>', NULL), (7, 3, 0, 0, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL), (7, 4, 0, 0, 'NoDet', NULL, NULL, '<C>', 'Org', '', NULL), (7, 6, 2, 5, 'Indefinite', NULL, 'a', 'firm', NULL, '', 'of <N>'), (7, 7, 2, 3, 'Indefinite', NULL, 'a', 'firm', NULL, '', NULL), (7, 9, 3, 3, 'NoDet', NULL, NULL, 'firm', NULL, '', NULL), (7, 12, 5, 5, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (7, 13, 5, 5, 'NoDet', NULL, NULL, '<N>', NULL, '', NULL), (7, 19, 9, 9, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (7, 20, 9, 9, 'NoDet', NULL, NULL, '<G>', NULL, '', NULL), (7, 21, 10, 11, 'NoDet', NULL, NULL, 'this week', NULL, '', NULL), (7, 23, 11, 11, 'NoDet', NULL, NULL, 'week', NULL, '', NULL))
SELECT sent_id, node_id, b, e, det, person, {_put('determiner')} AS determiner, {_put('head')} AS head, head_class, {_put('specs')} AS specs, {_put('complement')} AS complement FROM said JOIN known USING (shape)""")
def noun_phrase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = noun_phrases.noun_phrases(*sentences(spark, sf_dir))
    return found.select("sent_id", "node_id", "b", "e", "det", "person", "determiner", "head", "head_class", F.array_join("specs", "|").alias("specs"), "complement")


@query(_SAID + f"""known(shape, verb_idx, lemma, b, e, up_b, up_e, word, spec, spec_i, spec_text) AS (VALUES
  (0, 1, 'want', 0, 8, NULL, NULL, NULL, NULL, NULL, NULL), (0, 3, 'ship', 2, 7, 0, 8, NULL, NULL, NULL, NULL),
  (1, 3, 'buy', 0, 6, NULL, NULL, NULL, NULL, NULL, NULL),
  (2, 1, 'meet', 0, 7, NULL, NULL, NULL, NULL, NULL, NULL), (2, 5, 'leave', 4, 6, NULL, NULL, NULL, 'WH', 0, 'who'),
  (3, 1, 'tell', 0, 9, NULL, NULL, NULL, NULL, NULL, NULL), (3, 7, 'leave', 3, 8, 0, 9, 'that', NULL, NULL, NULL),
  (4, 1, 'buy', 0, 2, 0, 6, NULL, NULL, NULL, NULL), (4, 5, 'say', 0, 6, NULL, NULL, NULL, 'Topic', 0, '<N> buys <G>'),
  (5, 1, 'sell', 0, 7, NULL, NULL, NULL, NULL, NULL, NULL), (5, 4, 'make', 4, 6, NULL, NULL, NULL, 'WHPHI', 0, NULL),
  (6, 3, 'sell', 0, 10, NULL, NULL, NULL, NULL, NULL, NULL), (6, 9, 'rise', 7, 9, 0, 10, 'as', NULL, NULL, NULL),
  (7, 8, 'buy', 0, 12, NULL, NULL, NULL, NULL, NULL, NULL))
SELECT sent_id, verb_idx, lemma, b, e, up_b, up_e, word, spec, spec_i, {_put('spec_text')} AS spec_text FROM said JOIN known USING (shape)""")
def clause_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clauses.clause_tree(analysed_sentences(spark, sf_dir))
    return found.select("sent_id", "verb_idx", "lemma", "b", "e", "up_b", "up_e", "word", "spec", "spec_i", "spec_text")


@query(_SAID + f"""known(shape, verb_idx, role, ord, kind, trace, i, b, e, text) AS (VALUES
  (0, 1, 'complement', 0, 'CP', NULL, NULL, 2, 7, 'to ship the <G> to <N>'), (0, 1, 'subject', 0, 'DP', NULL, 0, 0, 0, '<C>'), (0, 3, 'complement', 0, 'DP', NULL, NULL, 4, 5, 'the <G>'), (0, 3, 'complement', 1, 'PP', NULL, NULL, 6, 7, '<N>'), (0, 3, 'subject', 0, 'DP', 'PRO', 0, 0, 0, '<C>'),
  (1, 3, 'complement', 0, 'DP', 'Moved', 0, 0, 1, 'The <G>'), (1, 3, 'complement', 1, 'PP', NULL, NULL, 4, 5, '<C>'), (1, 3, 'subject', 0, 'DP', NULL, 0, 0, 1, 'The <G>'),
  (2, 1, 'complement', 0, 'DP', NULL, NULL, 2, 6, 'the buyer'), (2, 1, 'subject', 0, 'DP', NULL, NULL, 0, 0, 'He'), (2, 5, 'complement', 0, 'DP', NULL, NULL, 6, 6, '<N>'), (2, 5, 'subject', 0, 'DP', 'Moved', 0, 2, 6, 'the buyer'),
  (3, 1, 'complement', 0, 'DP', NULL, NULL, 2, 2, 'them'), (3, 1, 'complement', 1, 'CP', NULL, NULL, 3, 8, 'that it would not leave <N>'), (3, 1, 'subject', 0, 'DP', NULL, NULL, 0, 0, '<C>'), (3, 7, 'complement', 0, 'DP', NULL, NULL, 8, 8, '<N>'), (3, 7, 'subject', 0, 'DP', NULL, NULL, 4, 4, 'it'),
  (4, 1, 'complement', 0, 'DP', NULL, NULL, 2, 2, '<G>'), (4, 1, 'subject', 0, 'DP', NULL, NULL, 0, 0, '<N>'), (4, 5, 'complement', 0, 'CP', 'Moved', 0, 0, 2, '<N> buys <G>'), (4, 5, 'subject', 0, 'DP', NULL, NULL, 4, 4, '<C>'),
  (5, 1, 'complement', 0, 'DP', NULL, NULL, 2, 6, 'a <G>'), (5, 1, 'subject', 0, 'DP', NULL, NULL, 0, 0, '<C>'), (5, 4, 'complement', 0, 'DP', 'Moved', 0, 2, 6, 'a <G>'), (5, 4, 'complement', 1, 'PP', NULL, NULL, 5, 6, '<N>'), (5, 4, 'subject', 0, 'DP', 'Moved', 0, 2, 6, 'a <G>'),
  (6, 3, 'adjunct', 0, 'CP', NULL, NULL, 7, 9, 'as prices rose'), (6, 3, 'complement', 0, 'DP', NULL, NULL, 4, 4, '<G>'), (6, 3, 'complement', 1, 'PP', NULL, NULL, 5, 6, '<N>'), (6, 3, 'subject', 0, 'DP', NULL, NULL, 0, 2, 'agent'), (6, 9, 'subject', 0, 'DP', NULL, NULL, 8, 8, 'prices'),
  (7, 8, 'complement', 0, 'DP', NULL, NULL, 9, 9, '<G>'), (7, 8, 'complement', 1, 'PP', NULL, NULL, 10, 11, ''), (7, 8, 'subject', 0, 'DP', NULL, NULL, 0, 6, '<C>'))
SELECT sent_id, verb_idx, role, ord, kind, trace, i, b, e, {_put('text')} AS text FROM said JOIN known USING (shape)""")
def clause_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.parts_of_sentences(*analysed_outlines(spark, sf_dir)).select("sent_id", "verb_idx", "role", "ord", "kind", "trace", "i", "b", "e", "text")


@query(_SAID + f"""known(shape, root_b, root_e, i, kind, b, e, text) AS (VALUES
  (0, 0, 8, 0, 'DP', 0, 0, '<C>'),
  (1, 0, 6, 0, 'DP', 0, 1, 'The <G>'),
  (2, 0, 7, 0, 'DP', 2, 6, 'buyer'),
  (4, 0, 6, 0, 'CP', 0, 2, '<N> buys <G>'),
  (5, 0, 7, 0, 'DP', 2, 6, '<G>'))
SELECT sent_id, root_b, root_e, i, kind, b, e, {_put('text')} AS text FROM said JOIN known USING (shape)""")
def clause_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.referents_of_sentences(*analysed_outlines(spark, sf_dir))


# Frames and meaning graphs of these sentences, by a small lexicon: lemma, frame, its roles in order, the codes of their slots.
LEXICON = (
    ("want", "Desiring", ("Experiencer", "Event"), ("NP-SBJ", "SBAR-1")),
    ("ship", "Sending", ("Sender", "Theme", "Recipient"), ("NP-SBJ", "NP-1", "PP-to")),
    ("buy", "Commerce_buy", ("Buyer", "Goods"), ("NP-SBJ", "NP-1")),
    ("meet", "Make_acquaintance", ("Individual_1", "Individual_2"), ("NP-SBJ", "NP-1")),
    ("leave", "Departing", ("Theme", "Source"), ("NP-SBJ", "NP-1")),
    ("tell", "Telling", ("Speaker", "Addressee", "Message"), ("NP-SBJ", "NP-1", "SBAR-2")),
    ("say", "Statement", ("Speaker", "Message"), ("NP-SBJ", "SBAR-1")),
    ("sell", "Commerce_sell", ("Seller", "Goods"), ("NP-SBJ", "NP-1")),
    ("make", "Manufacturing", ("Producer", "Product"), ("NP-SBJ", "NP-1")),
    ("rise", "Motion_directional", ("Theme",), ("NP-SBJ",)),
)


def lexicon(spark: SparkSession) -> dict[str, DataFrame]:
    senses = [(lemma, "1", frame, "single", 1) for lemma, frame, _, _ in LEXICON]
    roles = [(lemma, "1", f"arg{i}", role) for lemma, _, named, _ in LEXICON for i, role in enumerate(named)]
    patterns = [(lemma, "1", "p", 1, *codes, *[None] * (5 - len(codes))) for lemma, _, _, codes in LEXICON]
    return {
        "senses": spark.createDataFrame(senses, "lemma string, sense string, frame string, cause string, n long"),
        "roles": spark.createDataFrame(roles, "lemma string, sense string, arg string, role string"),
        "patterns": spark.createDataFrame(patterns, "lemma string, sense string, pattern string, n long, arg0 string, arg1 string, arg2 string, arg3 string, arg4 string"),
        "duals": spark.createDataFrame([], "frame string, causative string, agent string"),
        "dual_roles": spark.createDataFrame([], "frame string, role string, new_role string"),
        "relations": spark.createDataFrame([("in", "Locative_relation", "Figure", "Ground", 0)], "prep string, frame string, role0 string, role1 string, prio int"),
        "elements": spark.createDataFrame([("Commerce_sell", "Place"), ("Manufacturing", "Place")], "frame string, element string"),
        "preposition_roles": spark.createDataFrame([("in", 0, "Time"), ("in", 1, "Place")], "prep string, place int, role string"),
    }


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    each, kinds = clauses.kinds_of_sentences(*analysed_outlines(spark, sf_dir))
    tree, parts, words = clauses.clause_tree(kinds), clauses.clause_parts(kinds), lexicon(spark)
    matched = written(frames.match_frames(tree, parts, words), "frames")
    graph = meaning_graph.named_graph(matched, tree, meaning_graph.phrases(kinds), parts, frames.linked_clauses(tree, parts), words["relations"])
    return meaning_graph.graph_of_sentences(each, *graph)


@query(_SAID + f"""known(shape, id, kind, b, e, head_b, head_e, frame, text) AS (VALUES
  (0, 1, 'predicate', 0, 8, 1, 1, 'Desiring', 'want'), (0, 2, 'predicate', 2, 7, 3, 3, 'Sending', 'ship'), (0, 3, 'entity', 0, 0, 0, 0, NULL, '<C>'), (0, 4, 'entity', 4, 5, 4, 5, NULL, 'the <G>'), (0, 5, 'entity', 7, 7, 7, 7, NULL, '<N>'), (0, 6, 'entity', NULL, NULL, 0, 0, NULL, 'PRO_0'),
  (1, 1, 'predicate', 0, 6, 3, 3, 'Commerce_buy', 'buy'), (1, 2, 'entity', 0, 1, 0, 1, NULL, 'The <G>'), (1, 3, 'entity', 5, 5, 5, 5, NULL, '<C>'),
  (2, 1, 'predicate', 0, 7, 1, 1, 'Make_acquaintance', 'meet'), (2, 2, 'predicate', 4, 6, 5, 5, 'Departing', 'leave'), (2, 3, 'entity', 0, 0, 0, 0, NULL, 'He'), (2, 4, 'entity', 2, 6, 2, 3, NULL, 'the buyer'), (2, 5, 'entity', 6, 6, 6, 6, NULL, '<N>'),
  (3, 1, 'predicate', 0, 9, 1, 1, 'Telling', 'tell'), (3, 2, 'predicate', 3, 8, 7, 7, 'Departing', 'leave'), (3, 3, 'entity', 0, 0, 0, 0, NULL, '<C>'), (3, 4, 'entity', 2, 2, 2, 2, NULL, 'them'), (3, 5, 'entity', 4, 4, 4, 4, NULL, 'it'), (3, 6, 'entity', 8, 8, 8, 8, NULL, '<N>'),
  (4, 1, 'predicate', 0, 2, 1, 1, 'Commerce_buy', 'buy'), (4, 2, 'predicate', 0, 6, 5, 5, 'Statement', 'say'), (4, 3, 'entity', 0, 0, 0, 0, NULL, '<N>'), (4, 4, 'entity', 2, 2, 2, 2, NULL, '<G>'), (4, 5, 'entity', 4, 4, 4, 4, NULL, '<C>'),
  (5, 1, 'predicate', 0, 7, 1, 1, 'Commerce_sell', 'sell'), (5, 2, 'predicate', 4, 6, 4, 4, 'Manufacturing', 'make'), (5, 3, 'entity', 0, 0, 0, 0, NULL, '<C>'), (5, 4, 'entity', 2, 6, 2, 3, NULL, 'a <G>'), (5, 5, 'entity', 6, 6, 6, 6, NULL, '<N>'),
  (6, 1, 'predicate', 0, 10, 3, 3, 'Commerce_sell', 'sell'), (6, 2, 'predicate', 7, 9, 9, 9, 'Motion_directional', 'rise'), (6, 3, 'entity', 0, 0, 0, 0, NULL, '<C>'), (6, 4, 'entity', 0, 2, 2, 2, NULL, 'agent'), (6, 5, 'entity', 4, 4, 4, 4, NULL, '<G>'), (6, 6, 'entity', 6, 6, 6, 6, NULL, '<N>'), (6, 7, 'entity', 8, 8, 8, 8, NULL, 'prices'), (6, 8, 'relation', 0, 0, NULL, NULL, 'Possession', ''),
  (7, 1, 'predicate', 0, 12, 8, 8, 'Commerce_buy', 'buy'), (7, 2, 'entity', 0, 6, 0, 0, NULL, '<C>'), (7, 3, 'entity', 2, 5, 2, 5, NULL, 'a firm of <N>'), (7, 4, 'entity', 9, 9, 9, 9, NULL, '<G>'), (7, 5, 'relation', 2, 5, NULL, NULL, 'Instance', ''))
SELECT sent_id, id, kind, b, e, head_b, head_e, frame, {_put('text')} AS text FROM said JOIN known USING (shape)""")
def meaning_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[0]


@query(_SAID + """known(shape, role, modifier, prep, src, dst) AS (VALUES
  (0, 'Event', false, NULL, 1, 2), (0, 'Experiencer', false, NULL, 1, 3), (0, 'Recipient', false, 'to', 2, 5), (0, 'Sender', false, NULL, 2, 6), (0, 'Theme', false, NULL, 2, 4), (0, 'PRO', false, NULL, 6, 3),
  (1, 'Buyer', false, 'by', 1, 3), (1, 'Goods', false, NULL, 1, 2),
  (2, 'Individual_1', false, NULL, 1, 3), (2, 'Individual_2', false, NULL, 1, 4), (2, 'Source', false, NULL, 2, 5), (2, 'Theme', true, NULL, 2, 4),
  (3, 'Addressee', false, NULL, 1, 4), (3, 'Message', false, NULL, 1, 2), (3, 'Speaker', false, NULL, 1, 3), (3, 'Source', false, NULL, 2, 6), (3, 'Theme', false, NULL, 2, 5),
  (4, 'Buyer', false, NULL, 1, 3), (4, 'Goods', false, NULL, 1, 4), (4, 'Message', false, NULL, 2, 1), (4, 'Speaker', false, NULL, 2, 5),
  (5, 'Goods', false, NULL, 1, 4), (5, 'Seller', false, NULL, 1, 3), (5, 'Place', false, 'in', 2, 5), (5, 'Product', true, NULL, 2, 4),
  (6, 'Explanation', false, 'as', 1, 2), (6, 'Goods', false, NULL, 1, 5), (6, 'Place', false, 'in', 1, 6), (6, 'Seller', false, NULL, 1, 4), (6, 'Theme', false, NULL, 2, 7), (6, 'Owner', false, NULL, 8, 3), (6, 'Possession', true, NULL, 8, 4),
  (7, 'Buyer', false, NULL, 1, 2), (7, 'Goods', false, NULL, 1, 4), (7, 'Instance', true, NULL, 5, 2), (7, 'Type', false, NULL, 5, 3))
SELECT sent_id, role, modifier, prep, src, dst FROM said JOIN known USING (shape)""")
def meaning_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables(spark, sf_dir)[1]


#: shape, verb, label, word, steps above it: as annotated corpora give arguments.
ARGUMENTS = (
    (0, 1, "arg0", 0, 1), (0, 1, "arg1", 2, 2), (0, 3, "arg0", 0, 1), (0, 3, "arg1", 4, 1), (0, 3, "arg2", 6, 1),
    (1, 3, "arg1", 0, 1), (1, 3, "arg0", 4, 1), (2, 1, "arg0", 0, 0), (2, 1, "arg1", 2, 2), (2, 5, "arg1", 6, 1), (3, 1, "arg0", 0, 1), (3, 1, "arg2", 2, 1), (3, 1, "arg1", 3, 1),
    (4, 5, "arg0", 4, 1), (4, 5, "arg1", 0, 2), (5, 4, "arg2", 5, 1), (6, 3, "arg0", 2, 1), (6, 3, "arg1", 4, 1), (6, 3, "arg3", 7, 1), (7, 8, "arg0", 0, 2), (7, 8, "arg1", 9, 1), (7, 8, "arg4", 99, 1), (7, 8, "arg3", 0, 9),
)


@query(_SAID + """known(shape, verb_idx, voice, arg0, arg1, arg2, arg3, arg4) AS (VALUES
  (0, 1, 'Active', 'NP-SBJ', 'S-1', NULL, NULL, NULL), (0, 3, 'Active', 'NP', 'NP-1', 'PP-to', NULL, NULL), (1, 3, 'Passive', 'PP-by', 'NP-SBJ', NULL, NULL, NULL),
  (2, 1, 'Active', 'NP-SBJ', 'NP-1', NULL, NULL, NULL), (2, 5, 'Active', NULL, 'NP-1', NULL, NULL, NULL), (3, 1, 'Active', 'NP-SBJ', 'SBAR-2', 'NP-1', NULL, NULL),
  (4, 5, 'Active', 'NP-SBJ', 'S', NULL, NULL, NULL), (5, 4, 'Passive', NULL, NULL, 'PP-in', NULL, NULL), (6, 3, 'Active', 'NP-SBJ', 'NP-1', NULL, 'SBAR', NULL), (7, 8, 'Active', 'NP-SBJ', 'NP-1', NULL, NULL, NULL))
SELECT sent_id, verb_idx, voice, arg0, arg1, arg2, arg3, arg4 FROM said JOIN known USING (shape)""")
def argument_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, marks = sentences(spark, sf_dir)
    shapes = F.broadcast(spark.createDataFrame(ARGUMENTS, "shape int, verb_idx int, label string, idx int, h int"))
    asked = nodes.where("parent_id is null").select("sent_id", (F.col("sent_id") % len(SHAPES)).cast("int").alias("shape")).join(shapes, "shape").drop("shape")
    return arguments.patterns_of_sentences(*clauses.analysed_outlines(nodes, marks), asked)
