"""Text of trees, patterns and verbs."""

from pyspark.sql import functions as F

from lexmill.functions import render
from lexmill.operators import lexicon
from lexmill.sources import penn


def test_tree_text(spark):
    rows = spark.createDataFrame([(1, "(S (NP-SBJ (PRP It)) (VP (VBZ ends) (. .)))")], "sent_id long, value string")
    nodes = penn.trees(rows)
    text = "\n(S    \n  (NP-S \n    (PRP  It)) \n  (VP   \n    (VBZ  ends) \n    (.     .)))"
    assert [r["text"] for r in render.tree_text(nodes).collect()] == [text]
    assert [r["text"] for r in render.numbered_tokens(nodes).collect()] == ["It-0\tends-1\t.-2"]


def test_pads_never_cut(spark):
    row = spark.range(1).select(render.pattern_text(F.lit("longer"), F.lit(None).cast("string"), [F.lit("PP-according-to")] + [F.lit(None).cast("string")] * 4).alias("t")).first()
    assert row["t"] == "longer:   unidentified arg0: PP-according-to" + "".join(f"   arg{i}: {'':10}" for i in range(1, 5))


def test_relations_round_trip(spark):
    codes = ["NP", "NP-SBJ", "S-2", "SBAR-1", "PP", "PP-of", "PP-by-ing", "ADJP", "FRAG"]
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in rows.select(render.relation_text(lexicon.relation(F.col("c")))).collect()] == [*codes[:-1], "??(X)"]


def test_lemma_list(spark):
    rows = spark.createDataFrame([(["be", 'a"b'],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(render.lemma_list(F.col("w"))).collect()] == ['[[0,"be"],[1,"a\\"b"]]', "[]"]
