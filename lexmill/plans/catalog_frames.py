"""Queries of frame matching: an order is a clause, its lines are the parts; each nation gives a sense with four patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import frames
from lexmill.plans.catalog import query, read

_TABLES = """WITH line AS (SELECT l_orderkey AS sent_id, l_partkey AS p, l_suppkey AS s, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS i FROM lineitem),
clause AS (SELECT o_orderkey AS sent_id, 0 AS verb_idx, 'v' || o_custkey % 5 AS lemma, CASE WHEN o_orderkey % 3 = 0 THEN 'Passive' ELSE 'Active' END AS voice FROM orders),
part_of AS (SELECT sent_id, 0 AS verb_idx, i AS ord, CASE WHEN i = 0 THEN 'subject' ELSE 'complement' END AS role, CASE WHEN i = 0 THEN 'DP' ELSE list_value('DP', 'PP', 'CP', 'PP', 'AP')[1 + p % 5] END AS kind, 10 * i AS b, 10 * i + 5 AS e,
  list_value('by', 'in', 'to')[1 + s % 3] AS prep, s % 7 = 0 AS time, p % 4 = 0 AS gerund, list_value('that', 'as', NULL)[1 + s % 3] AS word, p % 2 = 0 AS infinitive FROM line),
part_row AS (SELECT sent_id, verb_idx, ord, role, kind, b, e, CASE WHEN kind = 'PP' THEN prep END AS prep, CASE WHEN kind = 'PP' THEN time END AS time, CASE WHEN kind = 'PP' THEN gerund END AS gerund,
  CASE WHEN kind = 'PP' THEN b + 1 END AS obj_b, CASE WHEN kind = 'PP' THEN e END AS obj_e, CASE WHEN kind = 'CP' THEN word END AS word, CASE WHEN kind = 'CP' THEN infinitive END AS infinitive FROM part_of),
sense AS (SELECT 'v' || n_nationkey % 5 AS lemma, 's' || n_nationkey AS sense, 'F' || n_regionkey AS frame, CASE WHEN n_nationkey % 4 = 0 THEN 'dual' ELSE 'single' END AS cause, (1 + n_nationkey % 7)::BIGINT AS n FROM nation),
role_of AS (SELECT lemma, sense, 'arg' || a AS arg, CASE a WHEN 0 THEN 'Agent' WHEN 1 THEN 'Theme' WHEN 2 THEN 'Goal' ELSE 'Time' END AS role FROM sense, (SELECT unnest(range(4)) AS a)),
pattern AS (SELECT 'v' || s_nation % 5 AS lemma, 's' || s_nation AS sense, 'p' || s_key AS pattern, (1 + s_key % 11)::BIGINT AS n, CASE WHEN s_key % 3 > 0 THEN 'NP-SBJ' END AS arg0,
  list_value('NP-1', 'SBAR-1', 'PP-in', NULL)[1 + s_key % 4] AS arg1, list_value('NP-2', 'PP-to', 'PP-by-ing', 'NP-1', 'SBAR-2')[1 + s_key % 5] AS arg2, CASE WHEN s_key % 2 = 0 THEN 'PP-to-ing' END AS arg3, NULL AS arg4 FROM (SELECT n_nationkey AS s_nation, 4 * n_nationkey + unnest(range(1, 5)) AS s_key FROM nation)),
"""


def _kind(of: Column, *values: str | None) -> Column:
    return F.get(F.array(*map(F.lit, values)), of)


def clauses_and_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    clauses = orders.select(F.col("o_orderkey").alias("sent_id"), F.lit(0).alias("verb_idx"), F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("lemma"), F.when(F.col("o_orderkey") % 3 == 0, "Passive").otherwise("Active").alias("voice"), F.lit(0).alias("b"), F.lit(99).alias("e"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    i, p, s = F.col("i"), F.col("l_partkey"), F.col("l_suppkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.row_number().over(order) - 1).alias("i"))
    lines = lines.withColumn("kind", F.when(i == 0, "DP").otherwise(_kind(p % 5, "DP", "PP", "CP", "PP", "AP")))
    tail, clause = F.col("kind") == "PP", F.col("kind") == "CP"
    return clauses, lines.select(
        F.col("l_orderkey").alias("sent_id"), F.lit(0).alias("verb_idx"), i.alias("ord"), F.when(i == 0, "subject").otherwise("complement").alias("role"), "kind", F.lit(None).cast("string").alias("trace"), (10 * i).alias("b"), (10 * i + 5).alias("e"),
        F.when(tail, _kind(s % 3, "by", "in", "to")).alias("prep"), F.when(tail, s % 7 == 0).alias("time"), F.when(tail, p % 4 == 0).alias("gerund"), F.when(tail, 10 * i + 1).alias("obj_b"), F.when(tail, 10 * i + 5).alias("obj_e"),
        F.when(clause, _kind(s % 3, "that", "as", None)).alias("word"), F.when(clause, p % 2 == 0).alias("infinitive"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k, s = F.col("n_nationkey"), F.col("s")
    nations = read(spark, sf_dir, "nation")
    each = nations.select("n_nationkey", F.explode(F.sequence(4 * k + 1, 4 * k + 4)).alias("s"))
    name = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
    senses = nations.select(name("v", k % 5).alias("lemma"), name("s", k).alias("sense"), name("F", F.col("n_regionkey")).alias("frame"), F.when(k % 4 == 0, "dual").otherwise("single").alias("cause"), (1 + k % 7).cast("long").alias("n"))
    named = F.array(*[F.struct(F.lit(f"arg{i}").alias("arg"), F.lit(r).alias("role")) for i, r in enumerate(("Agent", "Theme", "Goal", "Time"))])
    patterns = each.select(
        name("v", k % 5).alias("lemma"), name("s", k).alias("sense"), name("p", s).alias("pattern"), (1 + s % 11).cast("long").alias("n"), F.when(s % 3 > 0, "NP-SBJ").alias("arg0"), _kind(s % 4, "NP-1", "SBAR-1", "PP-in", None).alias("arg1"),
        _kind(s % 5, "NP-2", "PP-to", "PP-by-ing", "NP-1", "SBAR-2").alias("arg2"), F.when(s % 2 == 0, "PP-to-ing").alias("arg3"), F.lit(None).cast("string").alias("arg4"),
    )
    regions = read(spark, sf_dir, "region")
    frame = name("F", F.col("r_regionkey"))
    return {
        "senses": senses,
        "roles": senses.select("lemma", "sense", F.inline(named)),
        "patterns": patterns,
        "duals": regions.where("r_regionkey % 2 = 0").select(frame.alias("frame"), F.concat(F.lit("C"), frame).alias("causative"), F.lit("Causer").alias("agent")),
        "dual_roles": regions.select(frame.alias("frame"), F.lit("Goal").alias("role"), F.lit("Time").alias("new_role")),
        "durations": spark.createDataFrame([("in",)], "prep string"),
    }


#: Each pattern of each sense and reading with its roles: those of slots first, then time, then prepositions that are not used yet.
_MATCH = _TABLES + """
first_slot AS (SELECT lemma, sense, pattern, place, arg, code FROM (SELECT *, row_number() OVER (PARTITION BY lemma, sense, pattern, coalesce(nullif(regexp_extract(code, '^(?:NP|S|SBAR)-(SBJ|1|2)$', 1), ''), arg) ORDER BY place) AS k
  FROM (SELECT lemma, sense, pattern, unnest([0, 1, 2, 3, 4]) AS place, unnest(['arg0', 'arg1', 'arg2', 'arg3', 'arg4']) AS arg, unnest([arg0, arg1, arg2, arg3, arg4]) AS code FROM pattern) WHERE code IS NOT NULL) WHERE k = 1),
twin AS (SELECT lemma, sense, 'C' || frame AS frame, n FROM sense WHERE cause = 'dual' AND replace(frame, 'F', '')::INTEGER % 2 = 0),
reading AS (SELECT lemma, sense, 0 AS reading, frame, n FROM sense UNION ALL SELECT lemma, sense, 1, frame, n FROM twin),
meant AS (SELECT lemma, sense, 0 AS reading, arg, role FROM role_of
  UNION ALL SELECT lemma, sense, 1, arg, CASE role WHEN 'Goal' THEN 'Time' WHEN 'Agent' THEN 'Causer' ELSE role END FROM role_of JOIN twin USING (lemma, sense)),
comp AS (SELECT * FROM part_row WHERE role = 'complement'),
offer AS (SELECT sent_id, 0 AS step, 0 AS spot, 'NP-SBJ' AS code, kind, b, e, obj_b, obj_e FROM part_row JOIN clause USING (sent_id) WHERE role = 'subject' AND voice = 'Active'
  UNION ALL SELECT sent_id, 0, 0, 'NP-SBJ', kind, b, e, obj_b, obj_e FROM (SELECT c.*, row_number() OVER (PARTITION BY sent_id ORDER BY ord) AS k FROM comp c JOIN clause USING (sent_id) WHERE voice = 'Passive' AND prep = 'by' AND NOT time) WHERE k = 1
  UNION ALL SELECT sent_id, 1, k, CASE WHEN kind = 'DP' THEN 'NP-' ELSE 'SBAR-' END || k, kind, b, e, obj_b, obj_e FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ord) AS k FROM comp WHERE kind IN ('CP', 'DP')) WHERE k <= 2 AND (kind = 'DP' OR coalesce(word, 'that') = 'that')
  UNION ALL SELECT sent_id, 2, 0, 'NP-1', kind, b, e, obj_b, obj_e FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ord) AS k FROM comp) WHERE k = 1 AND kind = 'AP'
  UNION ALL SELECT sent_id, 4, 0, 'PP-' || prep || CASE WHEN gerund THEN '-ing' ELSE '' END, kind, b, e, obj_b, obj_e FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, prep, gerund ORDER BY ord) AS k FROM comp WHERE prep IS NOT NULL) WHERE k = 1),
clock AS (SELECT sent_id, CASE WHEN prep = 'in' THEN 'Duration' ELSE 'Time' END AS role, b, e, obj_b FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ord) AS k FROM comp WHERE time AND NOT gerund) WHERE k = 1),
tried AS (SELECT c.sent_id, lemma, sense, reading, frame, r.n, pattern, p.n AS pattern_n FROM clause c JOIN reading r USING (lemma) JOIN pattern p USING (lemma, sense)),
hit AS (SELECT sent_id, lemma, sense, reading, pattern, step, CASE WHEN step = 4 THEN place ELSE spot END AS spot, m.role, kind, b, e, obj_b FROM clause JOIN offer USING (sent_id) JOIN first_slot s USING (lemma, code) JOIN meant m USING (lemma, sense, arg)),
core AS (SELECT * FROM hit WHERE step < 4),
clocked AS (SELECT t.sent_id, lemma, sense, reading, pattern, 3 AS step, 0 AS spot, k.role, 'PP' AS kind, b, e, obj_b FROM tried t JOIN clock k USING (sent_id)
  WHERE NOT EXISTS (SELECT 1 FROM core h WHERE h.sent_id = t.sent_id AND h.sense = t.sense AND h.reading = t.reading AND h.pattern = t.pattern AND (h.role IN ('Time', 'Duration') OR (h.kind = 'PP' AND h.obj_b = k.obj_b)))),
early AS (SELECT * FROM core UNION ALL SELECT * FROM clocked),
every AS (SELECT * FROM early UNION ALL SELECT * FROM hit h WHERE step = 4 AND NOT EXISTS (SELECT 1 FROM early x WHERE x.sent_id = h.sent_id AND x.sense = h.sense AND x.reading = h.reading AND x.pattern = h.pattern AND x.b = h.b AND x.e = h.e)),
told AS (SELECT sent_id, lemma, sense, reading, pattern, count(*) AS roles, string_agg(role || ':' || b, ' ' ORDER BY step, spot) AS text FROM every GROUP BY ALL),
scored AS (SELECT t.*, coalesce(roles, 0) AS roles, coalesce(text, '') AS text FROM tried t LEFT JOIN told USING (sent_id, lemma, sense, reading, pattern)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, sense, reading ORDER BY roles DESC, pattern_n DESC, pattern) AS k FROM scored) WHERE k = 1),
"""


@query(_MATCH + """last AS (SELECT 1) SELECT sent_id, sense, reading, frame, pattern, text FROM best""")
def frame_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, parts = clauses_and_parts(spark, sf_dir)
    words = lexicon(spark, sf_dir)
    best = frames.match_patterns(clauses, parts, *[words[k] for k in ("senses", "roles", "patterns", "duals", "dual_roles", "durations")])
    return best.select("sent_id", "sense", "reading", "frame", "pattern", _told())


def _told() -> Column:
    return F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit(":"), r["b"].cast("string"))), " ").alias("text")


@query(_MATCH + """plain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, sense ORDER BY roles DESC, reading) AS j FROM best) WHERE j = 1),
weighed AS (SELECT *, sum(n) OVER (PARTITION BY sent_id) AS total FROM plain),
ranked AS (SELECT *, roles * n / total::DOUBLE * 100 + roles * total AS score FROM weighed)
SELECT sent_id, sense, reading, frame, pattern, text, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, sense) AS i FROM ranked) WHERE i = 1""")
def frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, parts = clauses_and_parts(spark, sf_dir)
    words = lexicon(spark, sf_dir)
    best = frames.match_senses(clauses, parts, *[words[k] for k in ("senses", "roles", "patterns", "duals", "dual_roles", "durations")])
    return best.select("sent_id", "sense", "reading", "frame", "pattern", _told(), F.round("score", 6).alias("score"))


@query(_TABLES + """inner_clause AS (SELECT *, row_number() OVER (PARTITION BY sent_id, word ORDER BY ord) AS k FROM part_row WHERE kind = 'CP' AND role <> 'subject'),
rule(word, marker, frame, role0, role1) AS (VALUES ('as', 'if', 'Conditional_occurrence', 'Consequence', 'Profiled_possibility'), ('that', 'after', 'Time_vector', 'Event', 'Landmark_event'))
SELECT sent_id, marker, frame, role0, 0 AS b0, 99 AS e0, role1, b AS b1, e AS e1 FROM inner_clause JOIN rule USING (word) WHERE k = 1""")
def linked_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, parts = clauses_and_parts(spark, sf_dir)
    worded = parts.withColumn("word", F.when(F.col("word") == "as", "if").when(F.col("word") == "that", "after").otherwise(F.col("word")))
    return frames.linked_clauses(clauses, worded).drop("verb_idx")
