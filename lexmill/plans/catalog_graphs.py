"""Queries of dependency trees, walks from many starts, and choices by shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import dependencies, graph
from lexmill.plans.catalog import query, read

_DEPENDENCIES = """WITH RECURSIVE ranked AS (SELECT c_nationkey AS tree, c_mktsegment AS label, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::BIGINT AS child FROM customer),
edge AS (SELECT tree, child, label, CASE WHEN child % 3 = 0 THEN child // 2 ELSE child - 1 END AS parent FROM ranked WHERE child > 0),
reached AS (SELECT DISTINCT tree, 0::BIGINT AS node, 0::BIGINT AS parent, NULL::VARCHAR AS label, []::BIGINT[] AS path, 0 AS depth FROM edge
  UNION ALL SELECT r.tree, e.child, e.parent, e.label, list_append(path, e.child), depth + 1 FROM reached r JOIN edge e ON e.tree = r.tree AND e.parent = r.node),
placed AS (SELECT *, (row_number() OVER (PARTITION BY tree ORDER BY path) - 1)::INTEGER AS node_id, (row_number() OVER (PARTITION BY tree, parent, depth ORDER BY node) - 1)::INTEGER AS ord FROM reached),
sizes AS (SELECT a.tree, a.node, count(*) AS n FROM placed a JOIN placed b ON a.tree = b.tree AND list_slice(b.path, 1, a.depth) = a.path GROUP BY ALL)
"""


@query(_DEPENDENCIES + """SELECT p.tree, 0::BIGINT AS root, p.node, parent, label, node_id, (node_id + n - 1)::INTEGER AS last_id, ord, depth FROM placed p JOIN sizes USING (tree, node) WHERE depth > 0""")
def dependency_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long") - 1
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tree"), F.col("c_mktsegment").alias("label"), child.alias("child")).where("child > 0")
    parent = F.when(F.col("child") % 3 == 0, F.floor(F.col("child") / 2)).otherwise(F.col("child") - 1)
    return dependencies.dependency_trees(rows.withColumn("parent", parent))


ROUNDS = 6


def _walk_sql() -> str:
    rounds = [
        f"""moved{k} AS (SELECT start, dst AS node, 0.85 * sum(rank / ways) AS rank FROM rank{k - 1} JOIN way USING (node) GROUP BY ALL), kept{k} AS (SELECT start, sum(rank) AS kept FROM moved{k} GROUP BY start),
rank{k} AS (SELECT start, node, sum(rank) AS rank FROM (SELECT * FROM moved{k} UNION ALL SELECT start, node, seed * (1 - coalesce(kept, 0)) FROM seeds LEFT JOIN kept{k} USING (start)) GROUP BY ALL),"""
        for k in range(1, ROUNDS + 1)
    ]
    return (
        """WITH edge AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49),
way AS (SELECT src AS node, dst, count(*) OVER (PARTITION BY src) AS ways FROM edge),
start AS (SELECT r_name AS start, n_nationkey AS node, length(n_name)::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey),
seeds AS (SELECT start, node, weight / sum(weight) OVER (PARTITION BY start) AS seed FROM start), rank0 AS (SELECT start, node, seed AS rank FROM seeds),
"""
        + "\n".join(rounds)
        + f" last AS (SELECT 1) SELECT start, node, round(rank, 9) AS rank FROM rank{ROUNDS}"
    )


@query(_walk_sql())
def walk_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = read(spark, sf_dir, "lineitem").where("l_quantity > 49").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = sold.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = both.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    starts = nations.select(F.col("r_name").alias("start"), F.col("n_nationkey").alias("node"), F.length("n_name").cast("double").alias("weight"))
    return graph.walk_ranks(edges, starts, ROUNDS).withColumn("rank", F.round("rank", 9))


@query("""WITH edge AS (SELECT DISTINCT l_suppkey AS src, 100000 + l_partkey % 60 AS dst FROM lineitem WHERE l_quantity > 40),
mention AS (SELECT l_orderkey AS doc_id, l_linenumber AS mention, l_suppkey AS item, l_linenumber = 1 AS resolved FROM lineitem
  UNION SELECT l_orderkey, l_linenumber, l_suppkey % 97 + 1, false FROM lineitem WHERE l_linenumber > 1),
near AS (SELECT src AS node, dst AS shared FROM edge UNION SELECT DISTINCT item, item FROM mention),
known AS (SELECT DISTINCT doc_id, item AS ref FROM mention WHERE resolved), asked AS (SELECT DISTINCT doc_id, mention, item AS candidate FROM mention WHERE NOT resolved),
scored AS (SELECT doc_id, mention, ref, candidate, count(*) AS score FROM known JOIN asked USING (doc_id) JOIN near a ON a.node = ref JOIN near b ON b.node = candidate AND b.shared = a.shared WHERE a.shared <> ref OR a.shared <> candidate GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mention ORDER BY score DESC, ref DESC, candidate DESC) AS k FROM scored)
SELECT doc_id, mention, candidate AS chosen, score FROM best WHERE k = 1 AND score > 3 AND candidate % 7 <> mention""")
def choice_by_shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    edges = lines.where("l_quantity > 40").select(F.col("l_suppkey").alias("src"), (100000 + F.col("l_partkey") % 60).alias("dst"))
    own = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mention"), F.col("l_suppkey").alias("item"), (F.col("l_linenumber") == 1).alias("resolved"))
    other = lines.where("l_linenumber > 1").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mention"), (F.col("l_suppkey") % 97 + 1).alias("item"), F.lit(False).alias("resolved"))
    mentions = own.unionByName(other)
    allowed = mentions.where("item % 7 <> mention").select("mention", "item").distinct()
    return graph.shared_neighbour_choice(edges, mentions, allowed)
