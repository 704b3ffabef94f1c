"""Readers of dumps and the second try of names."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import labels
from lexmill.operators import coreference, gazetteer, resources
from lexmill.plans import catalog_resources
from lexmill.sources import dumps, rdf
from tests.conftest import SF


def test_dump_rows(spark, tmp_path):
    text = "-- MySQL dump\nCREATE TABLE `page` (\nINSERT INTO `page` VALUES (1,0,'It\\'s (a), \"b\"',NULL,0.5),(2,-1,'café \\\\ x\\ny''z','',3);\r\n\nINSERT INTO `redirect` VALUES (7,'NULL');\n"
    (tmp_path / "d.sql").write_bytes(text.encode("latin-1"))
    found = sorted((r["table"], r["fields"]) for r in dumps.dump_rows(spark, str(tmp_path / "d.sql")).collect())
    assert found == [("page", ["1", "0", "It's (a), \"b\"", None, "0.5"]), ("page", ["2", "-1", "café \\ x\ny'z", "", "3"]), ("redirect", ["7", "NULL"])]


def test_dump_without_rows(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- nothing\n")
    assert dumps.dump_rows(spark, str(tmp_path / "d.sql")).collect() == []


def test_terms(spark, tmp_path):
    (tmp_path / "t").write_text("A\n\nbond yield\nETF\n")
    assert sorted(r["term"] for r in dumps.terms(spark, str(tmp_path / "t")).collect()) == ["ETF ", "bond yield "]


def test_second_try_of_a_name(spark):
    names = spark.createDataFrame([(["Big", "Old", "Co"],), (["New", "Inc"],), (["Low", "Ltd"],), (["Acme"],)], "name array<string>")
    asked = spark.createDataFrame([(1, "Big Old, Co. New, Inc. Low Ltd."), (2, "Acme, only"), (3, "")], "doc_id int, name string")
    found = gazetteer.annotate(asked.select("doc_id", F.split(resources.plain_name(F.col("name")), " ").alias("words")), names)
    assert [(r["doc_id"], r["b"], r["e"], r["name"]) for r in resources.shortest_match(found, "doc_id").collect()] == [(1, 5, 7, ["Low", "Ltd"])]


def test_mapped_sense_without_known_rolesets(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = resources.mapped_senses(
        frame([(1, "run", "1.2", "Motion"), (2, "run", "2.2", "Motion"), (3, "run", "1.2", "Gone")], "map_id int, lemma string, sense string, frame string"),
        frame([(1, "run", "1.2", "a"), (0, "run", "1.2", "b"), (2, "run", "2.2", "c")], "seq int, lemma string, sense string, pattern string"),
        frame([(1, "run-v", "1", "2", "go fast", "run.01,run.02")], "seq int, lemma string, group string, number string, name string, ids string"),
        frame([("Motion",)], "frame string"),
        frame([("run.03",)], "id string"),
    )
    assert [tuple(r) for r in found.collect()] == [(1, "run", "1.2", "go fast", "Motion", [], "b")]


def test_dependency_relation_is_exact(spark):
    rows = spark.createDataFrame([("nsubj",), ("nsubj:pass",), (None,)], "v string")
    assert [r[0] for r in rows.select(labels.dependency_relation(F.col("v"))).collect()] == ["nsubj", None, None]


def test_view_of_an_unknown_name(spark):
    found = rdf.triples(spark.createDataFrame([("<wordnet_a>\trdfs:subClassOf\t<wordnet_b>",), ("<wordnet_a>\t<subClassOf>\t<wordnet_c>",)], "value string"))
    assert [tuple(r) for r in rdf.view(found, "taxonomy").collect()] == [("a", "b")]
    with pytest.raises(ValueError, match="unknown view"):
        rdf.view(found, "other")


def test_pronoun_without_clauses_near_it(spark):
    clauses = spark.createDataFrame([(1, 1, None, None, 0, 1, "Person"), (1, 2, 1, None, 3, 4, None)], "sent_id int, clause_id int, parent_id int, topic_id int, subject_b int, subject_e int, subject_class string")
    phrases = spark.createDataFrame([(1, 1, 2, "He", False), (1, 2, 2, "It", False), (1, 3, 1, "She", False), (1, 4, 1, "She", True), (1, 5, 9, "He", True)], "sent_id int, phrase_id int, clause_id int, person string, genitive boolean")
    assert sorted(tuple(r) for r in coreference.pronouns(phrases, clauses).collect()) == [(1, 1, 0, 1), (1, 4, 0, 1)]


def test_predicates_are_grouped_where_their_lines_are(spark):
    for make in (catalog_resources.predicate_rolesets, catalog_resources.roleset_table):
        plan = make(spark, SF)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(lemma" in line and "REPARTITION_BY_NUM" in line]
        own = [line for line in plan.splitlines() if "Exchange hashpartitioning(lemma" in line and ("seq" in line or "o_orderkey" in line)]
        assert len(dealt) == 1 and not own, plan


def test_parts_of_lines_grow_in_number(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(catalog_resources, "LINES", lines // 200)
    plan = catalog_resources.predicate_rolesets(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 3 and all(f", {lines // (lines // 200)})" in line or f", {lines // (lines // 200)}," in line for line in dealt), plan
