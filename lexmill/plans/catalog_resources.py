"""Queries of lexical resources, rendered text, coreference and named views, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import labels, render
from lexmill.functions.text import tokens as words_of
from lexmill.operators import coreference, lexicon, meaning, resources, trees
from lexmill.plans.catalog import query, read
from lexmill.plans.catalog_more import _LINES, _nodes
from lexmill.sources import rdf

# Predicates: a customer is a lemma, each of the customer's orders an entry, its lines the rolesets.

_LAST = "last AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1), own AS (SELECT DISTINCT o_custkey, l_linenumber, l_partkey FROM last JOIN lineitem ON l_orderkey = o)"


#: Lines of a task.
LINES = 250_000


def _pieces(spark: SparkSession, sf_dir: str) -> int:
    """Parts to deal lines in: they grow in number, not in size."""
    return max(16 * spark.sparkContext.defaultParallelism, read(spark, sf_dir, "lineitem").count() // LINES)


def _lines_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir)
    lines, orders = read(spark, sf_dir, "lineitem").repartition(pieces, "l_orderkey"), read(spark, sf_dir, "orders").repartition(pieces, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("lemma", F.concat(F.lit("c"), F.col("o_custkey")))


def _predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    roleset = F.struct("l_linenumber", "l_partkey", F.concat_ws(".", "lemma", "l_linenumber").alias("id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("name"))
    lines = _lines_of_customers(spark, sf_dir).select("lemma", "o_orderkey", "l_linenumber", "l_partkey")
    lines = lines.repartition(_pieces(spark, sf_dir), "lemma")  # entries and lemmas are grouped, and sorted for that, where their lines are: no more shuffles, small sorts
    rows = lines.groupBy("lemma", F.col("o_orderkey").alias("seq")).agg(F.array_sort(F.collect_set(roleset)).alias("r"))
    return resources.predicates(rows.select("seq", "lemma", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("rolesets")))


@query(f"WITH {_LAST} SELECT 'c' || o_custkey AS lemma, (row_number() OVER (PARTITION BY o_custkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS place, 'c' || o_custkey || '.' || l_linenumber AS id, 'p' || l_partkey AS name FROM own")
def predicate_rolesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("lemma")).distinct()
    return resources.rolesets_of(asked, _predicates(spark, sf_dir))


@query(f"WITH {_LAST} SELECT 'c' || o_custkey || '.' || l_linenumber AS id, 'p' || arg_max(l_partkey, l_partkey) AS name, 'c' || o_custkey AS lemma FROM own GROUP BY o_custkey, l_linenumber")
def roleset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.rolesets(_predicates(spark, sf_dir))


@query(f"WITH {_LAST}, asked AS (SELECT DISTINCT o_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey), first AS (SELECT o_custkey, l_linenumber, min(l_partkey) AS p FROM own GROUP BY ALL) SELECT 'c' || o_custkey AS lemma, l_linenumber::VARCHAR AS sense, 'p' || p AS name FROM asked LEFT JOIN first USING (o_custkey, l_linenumber)")
def roleset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _lines_of_customers(spark, sf_dir).select("lemma", F.col("l_linenumber").cast("string").alias("sense")).distinct()
    return resources.roleset_names(asked, _predicates(spark, sf_dir))


@query("WITH map AS (SELECT s_nationkey, s_suppkey % 5 AS sense, arg_min(s_name, s_suppkey) AS roles FROM supplier GROUP BY ALL) SELECT c_custkey, roles FROM customer LEFT JOIN map ON s_nationkey = c_nationkey AND sense = c_custkey % 7")
def role_map_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("lemma"), (F.col("c_custkey") % 7).alias("sense"))
    maps = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("lemma"), (F.col("s_suppkey") % 5).alias("sense"), F.col("s_name").alias("roles"))
    return resources.first_role_map(asked, maps).select("c_custkey", "roles")


# Units: a part is one; part numbers share ids, and one size in seven has no frame.


@query("""WITH unit AS (SELECT p_partkey AS seq, p_partkey % 97 AS id, p_name AS name, CASE WHEN p_size % 7 <> 0 THEN p_type END AS frame FROM part), last AS (SELECT id, arg_max_null(frame, seq) AS frame FROM unit GROUP BY id)
SELECT name, (row_number() OVER (PARTITION BY name ORDER BY seq DESC) - 1)::INTEGER AS place, last.frame AS frame FROM unit JOIN last USING (id) WHERE last.frame IS NOT NULL""")
def unit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    units = parts.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 97).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("frame"))
    return resources.frames_of_units(units.select("name"), units)


@query("SELECT p_name AS member, p_brand AS class, array_to_string(list(p_type ORDER BY p_partkey DESC), ' ') AS frames FROM part GROUP BY ALL")
def class_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("member"), F.col("p_brand").alias("class"), F.col("p_type").alias("frame"))
    return resources.class_frames(rows).withColumn("frames", F.array_join("frames", " "))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a frame, its lines the elements, their states the types."""
    element = F.struct(F.concat(F.lit("s"), F.col("l_suppkey")).alias("_name"), F.when(F.col("l_returnflag") == "A", "Core-Unexpressed").otherwise("Core").alias("_coreType"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(element).alias("FE"), F.collect_set("l_linestatus").alias("types"))


@query("SELECT 's' || l_suppkey AS name, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def unexpressed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.elements_by_need(_frames(spark, sf_dir))


@query("SELECT count(DISTINCT l_orderkey) AS frames, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS of_type FROM lineitem")
def frames_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.count_of_type(_frames(spark, sf_dir), "O")


@query("SELECT DISTINCT l_returnflag || l_linenumber AS phrase FROM lineitem")
def phrase_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.struct(F.concat("l_returnflag", "l_linenumber").alias("PT"))
    patterns = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(unit).alias("p"))
    return resources.phrase_types(patterns.groupBy("l_orderkey").agg(F.array(F.collect_list("p")).alias("realisations")))


# Senses.


@query("""WITH name AS (SELECT s_nationkey AS lemma, s_suppkey % 10 AS number, arg_min(s_name, s_suppkey) AS definition FROM supplier GROUP BY ALL), used AS (SELECT l_suppkey % 25 AS lemma, l_linenumber AS number, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT lemma::BIGINT AS lemma, number::BIGINT AS number, definition, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_nationkey AS lemma, c_custkey % 12 AS number FROM customer) LEFT JOIN name USING (lemma, number) LEFT JOIN used USING (lemma, number)""")
def sense_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def senses(table: str, lemma: str, number: str, *more: str) -> DataFrame:
        return read(spark, sf_dir, table).selectExpr(f"CAST({lemma} AS BIGINT) AS lemma", f"CAST({number} AS BIGINT) AS number", *more)

    asked = senses("customer", "c_nationkey", "c_custkey % 12").distinct()
    return resources.sense_definitions(asked, senses("supplier", "s_nationkey", "s_suppkey % 10", "s_suppkey AS seq", "s_name AS name"), senses("lineitem", "l_suppkey % 25", "l_linenumber"))


@query("""WITH map AS (SELECT p_partkey AS map_id, p_brand AS lemma, (p_size % 3 + 1) || '.' || (p_size % 5) AS sense, p_type AS frame FROM part),
pattern AS (SELECT 'Brand#' || l_suppkey % 25 AS lemma, (l_linenumber % 3 + 1) || '.' || l_suppkey % 5 AS sense, min(l_orderkey * 10000 + l_suppkey) AS pattern FROM lineitem GROUP BY ALL),
entry AS (SELECT 'Brand#' || s_nationkey AS lemma, (s_suppkey % 3 + 1)::VARCHAR AS letter, (s_suppkey % 5)::VARCHAR AS number, arg_min(s_suppkey, s_suppkey) AS s, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY ALL)
SELECT map_id, map.lemma, sense, name, frame, array_to_string(CASE WHEN s + 1 IN (SELECT s_suppkey FROM supplier) THEN ['s' || s, 's' || (s + 1)] ELSE ['s' || s] END, ' ') AS rolesets, pattern FROM map JOIN pattern USING (lemma, sense) JOIN entry ON entry.lemma = map.lemma AND letter = sense[1] AND number = sense[3:]""")
def mapped_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    mapping = parts.selectExpr("p_partkey AS map_id", "p_brand AS lemma", "concat(p_size % 3 + 1, '.', p_size % 5) AS sense", "p_type AS frame")
    patterns = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10000 + l_suppkey AS seq", "concat('Brand#', l_suppkey % 25) AS lemma", "concat(l_linenumber % 3 + 1, '.', l_suppkey % 5) AS sense").withColumn("pattern", F.col("seq"))
    inventories = suppliers.selectExpr("s_suppkey AS seq", "concat('Brand#', s_nationkey, '-v') AS lemma", "concat(s_suppkey % 3 + 1, 'x') AS group", "CAST(s_suppkey % 5 AS STRING) AS number", "s_name AS name", "concat('s', s_suppkey, ',zz,s', s_suppkey + 1) AS ids")
    found = resources.mapped_senses(mapping, patterns, inventories, parts.select(F.col("p_type").alias("frame")), suppliers.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")))
    return found.withColumn("rolesets", F.array_join("rolesets", " "))


@query(_LINES + """, leaf AS (SELECT sent_id, b AS idx, b - (count(*) FILTER (tag = '-NONE-') OVER (PARTITION BY sent_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + (tag = '-NONE-')::INT AS token FROM node WHERE is_leaf),
placed AS (SELECT sent_id, token, min('s' || s || 'i' || i) AS instance FROM leaf JOIN line USING (sent_id) WHERE i = idx GROUP BY ALL)
SELECT sent_id, token::INTEGER AS token, min(sense) AS sense, any_value(instance) AS instance FROM (SELECT sent_id, i AS token, 'p' || p AS sense FROM line) LEFT JOIN placed USING (sent_id, token) GROUP BY sent_id, token""")
def annotated_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").withColumn("i", F.expr("CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT)"))
    senses = lines.selectExpr("l_orderkey AS sent_id", "i AS token", "concat('p', l_partkey) AS sense").withColumn("seq", F.col("sense"))
    instances = lines.selectExpr("l_orderkey AS sent_id", "i AS idx", "concat('s', l_suppkey, 'i', i) AS instance").withColumn("seq", F.col("instance"))
    return resources.annotated_senses(nodes, senses, instances)


@query("SELECT o_orderkey::VARCHAR AS article FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey IN (SELECT event_id FROM events)")
def complete_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [read(spark, sf_dir, t).select(F.col(c).cast("string").alias("article")) for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id"))]
    return resources.complete_articles(*names)


# Items: an order's candidates are the suppliers of its lines.


@query("""WITH item AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS qid, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS reason FROM orders), map AS (SELECT c_custkey // 3 * 2 AS qid, array_to_string(list(c_mktsegment ORDER BY c_custkey DESC), ' ') AS synsets FROM customer GROUP BY 1)
SELECT o_orderkey, synsets, CASE WHEN qid IS NULL THEN reason WHEN synsets IS NULL THEN 'No key.' END AS reason FROM item LEFT JOIN map USING (qid)""")
def item_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS qid", "CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS reason")
    mapping = read(spark, sf_dir, "customer").selectExpr("c_custkey AS seq", "c_custkey DIV 3 * 2 AS qid", "c_mktsegment AS synset")
    return resources.synsets_of(items, mapping).select("o_orderkey", F.array_join("synsets", " ").alias("synsets"), "reason")


_CANDIDATES = "WITH each AS (SELECT l_orderkey AS mention_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS place, l_suppkey AS qid FROM lineitem)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mention_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    return rows.select("mention_id", F.transform("r", lambda x: x["l_suppkey"]).alias("candidates"))


@query(_CANDIDATES + ", title AS (SELECT s_suppkey // 3 * 2 AS qid, arg_max(s_name, s_suppkey) AS title FROM supplier GROUP BY 1) SELECT mention_id, place, title FROM each JOIN title USING (qid)")
def candidate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS seq", "s_suppkey DIV 3 * 2 AS qid", "s_name AS title")
    return resources.titles_of(_candidates(spark, sf_dir), titles)


@query(_CANDIDATES + """, n AS (SELECT c_custkey // 2 % 37 * 3 AS qid, count(*) AS n FROM customer GROUP BY 1), ranked AS (SELECT mention_id, qid, row_number() OVER (PARTITION BY mention_id ORDER BY n DESC, place) AS r FROM each JOIN n USING (qid))
SELECT mention_id, qid FROM ranked WHERE r = 1""")
def most_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = read(spark, sf_dir, "customer").selectExpr("c_custkey DIV 2 % 37 * 3 AS qid", "c_name AS alias")
    return resources.most_aliased(_candidates(spark, sf_dir), aliases)


@query("WITH span AS (SELECT user_id, event_id, (event_id % 50)::BIGINT AS b, event_id % 50 + event_id % 7 AS e FROM events) SELECT user_id, b, e, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e - b, b DESC) AS r, rank() OVER (PARTITION BY user_id ORDER BY e - b, b DESC) AS k FROM span WHERE e - b > 1) WHERE k = 1 GROUP BY user_id, b, e")
def shortest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id % 50 AS b", "event_id % 50 + event_id % 7 AS e")
    spans = spans.groupBy("user_id", "b", "e").agg(F.max("event_id").alias("event_id"))
    return resources.shortest_match(spans, "user_id")


@query("SELECT conv_id, turn, CASE WHEN word IN ('acl', 'case', 'dep', 'det', 'list', 'root', 'obj') THEN word END AS relation FROM (SELECT conv_id, turn, ['acl', 'case', 'dep', 'det:x', 'list', 'Root', 'root', 'obj'][(turn % 8 + 1)] AS word FROM conversations)")
def dependency_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in "acl case dep det:x list Root root obj".split()])
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", labels.dependency_relation(F.element_at(words, (F.col("turn") % 8 + 1).cast("int"))).alias("relation"))


# Text.


@query(_LINES + """, closed AS (SELECT sent_id, last_id AS node_id, count(*) AS closed FROM node WHERE NOT is_leaf GROUP BY ALL)
SELECT sent_id, string_agg(CASE WHEN ord > 0 THEN ' ' ELSE '' END || chr(10) || repeat(' ', 2 * depth) || '(' || left(rpad(tag, 4, ' '), 4) || ' ' || CASE WHEN is_leaf THEN word || ')' ELSE '' END || repeat(')', coalesce(closed, 0)), '' ORDER BY node_id) AS text FROM node LEFT JOIN closed USING (sent_id, node_id) GROUP BY sent_id""")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tree_text(_nodes(spark, sf_dir))


@query(_LINES + "SELECT sent_id, string_agg(word || '-' || (b + 1), chr(9) ORDER BY b) AS text FROM node WHERE is_leaf GROUP BY sent_id")
def numbered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.numbered_tokens(_nodes(spark, sf_dir), 1)


_CODES = ["NP-SBJ", "S-1", "PP-of-ing", "ADVP", "", "SBAR", "PP-in", "ADJP"]


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a pattern: slots by supplier, part and line, voice by the return flag."""
    code = lambda n: F.nullif(F.element_at(F.array(*[F.lit(c) for c in _CODES]), (n % 8 + 1).cast("int")), F.lit(""))
    rows = read(spark, sf_dir, "lineitem").withColumn("voice", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return rows.withColumns({f"arg{i}": code(n) for i, n in enumerate((F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey") + 3, F.col("l_partkey") + 5))})


_SLOTS = ["arg0", "arg1", "arg2", "arg3", "arg4"]
_PATTERNS = "WITH pattern AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS voice, " + ", ".join(f"nullif({_CODES}[{n} % 8 + 1], '') AS {s}" for s, n in zip(_SLOTS, ("l_suppkey", "l_partkey", "l_linenumber", "(l_suppkey + 3)", "(l_partkey + 5)"), strict=True)) + " FROM lineitem)"


@query(_PATTERNS + " SELECT lpad('voice', 5, ' ') || ':' || lpad(coalesce(voice, 'unidentified'), 15, ' ') || ' arg0: ' || " + " || '   arg%s: ' || ".join(f"lpad(coalesce({s}, ''), 10, ' ')" for s in _SLOTS) % (1, 2, 3, 4) + " || '     #count: ' || rpad(count(*)::VARCHAR, 5, ' ') AS text FROM pattern GROUP BY voice, arg0, arg1, arg2, arg3, arg4")
def counted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _patterns(spark, sf_dir).groupBy("voice", *_SLOTS).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(render.counted_pattern(F.lit("voice"), F.col("voice"), [F.col(s) for s in _SLOTS], F.col("n")).alias("text"))


@query(_PATTERNS + " SELECT concat_ws(chr(9), 's' || l_suppkey, l_linenumber, coalesce(voice, 'null'), " + ", ".join(f"coalesce({s}, 'null')" for s in _SLOTS) + ", count(*)) AS text FROM pattern GROUP BY l_suppkey, l_linenumber, voice, arg0, arg1, arg2, arg3, arg4")
def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _patterns(spark, sf_dir).groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("sense"), F.col("l_linenumber").cast("string").alias("number"), "voice", *_SLOTS).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(render.pattern_row(F.col("sense"), F.col("number"), F.col("voice"), [F.col(s) for s in _SLOTS], F.col("n")).alias("text"))


@query(_PATTERNS + " SELECT DISTINCT arg0 AS code, arg0 AS text FROM pattern")
def relation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _patterns(spark, sf_dir).select(F.col("arg0").alias("code")).distinct()
    return codes.select("code", F.when(F.col("code").isNotNull(), render.relation_text(lexicon.relation(F.col("code")))).alias("text"))


@query(f"SELECT c_custkey, chr(10) || '{'=' * 76}' || chr(10) || lpad(c_mktsegment || '.' || c_custkey, greatest(10, len(c_mktsegment || '.' || c_custkey))::INTEGER, ' ') || ' : ' || rpad(count(o_orderkey)::VARCHAR, 6, ' ') || ' :  ' || c_name || chr(10) || '{'=' * 76}' || chr(10) AS text FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_name")
def sense_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = read(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", render.sense_header(F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.coalesce("n", F.lit(0)), F.col("c_name")).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, rpad(l_linenumber::VARCHAR, 3, ' ') || ' ' || lpad('w' || l_partkey, 15, ' ') || ' : ' || lpad(CASE WHEN l_linestatus = 'O' THEN 'Pres' ELSE 'Past' END || '.' || ['Smpl', 'Prog', 'Perf', 'PfPr'][l_suppkey % 4 + 1] || '.' || CASE WHEN l_returnflag = 'A' THEN 'Pass' ELSE 'Actv' END, 19, ' ')
  || ' aux: ' || lpad(CASE WHEN l_suppkey % 3 = 0 THEN 'have to' ELSE '' END, 7, ' ') || ' neg: ' || lpad(CASE WHEN l_partkey % 2 = 0 THEN 'not' ELSE '' END, 5, ' ') || ' | ' || 'w' || l_partkey AS text FROM lineitem""")
def verb_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat(F.lit("w"), F.col("l_partkey"))
    aspect = F.element_at(F.array(*[F.lit(a) for a in render.ASPECTS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    tense, voice = F.when(F.col("l_linestatus") == "O", "Present").otherwise("Past"), F.when(F.col("l_returnflag") == "A", "Passive").otherwise("Active")
    auxiliaries = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("have"), F.lit("to"))).otherwise(F.array().cast("array<string>"))
    text = render.verb_text(F.col("l_linenumber"), word, tense, aspect, voice, auxiliaries, F.when(F.col("l_partkey") % 2 == 0, "not"), F.array(word))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))


@query("""WITH word AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM conversations)
SELECT conv_id, turn, '[' || array_to_string(list_transform(words, lambda w, i: '[' || (i - 1) || ',' || to_json(w) || ']'), ',') || ']' AS text FROM word""")
def lemma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", render.lemma_list(words_of(F.coalesce("text", F.lit("")))).alias("text"))


# Coreference: a customer's orders are clauses, the order before is the parent, the one after the topic; line items are phrases.

_CLAUSES = """WITH clause AS (SELECT o_custkey AS sent_id, o_orderkey AS clause_id, lag(o_orderkey) OVER w AS parent_id, lead(o_orderkey) OVER w AS topic_id, o_orderkey % 50 AS b, CASE o_orderstatus WHEN 'O' THEN 'Person' WHEN 'F' THEN 'Org' END AS cls FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
phrase AS (SELECT DISTINCT sent_id, clause_id, clause_id * 10 + l_linenumber AS phrase_id, l_linenumber AS n, parent_id, topic_id FROM lineitem JOIN clause ON clause_id = l_orderkey),
placed AS (SELECT p.*, o.cls AS oc, o.b AS ob, u.cls AS uc, u.b AS ub, t.cls AS tc, t.b AS tb FROM phrase p JOIN clause o USING (clause_id) LEFT JOIN clause u ON u.clause_id = p.parent_id LEFT JOIN clause t ON t.clause_id = p.topic_id)
"""


def _clauses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
    subject = "CASE o_orderstatus WHEN 'O' THEN 'Person' WHEN 'F' THEN 'Org' END AS subject_class"
    clauses = read(spark, sf_dir, "orders").selectExpr("o_custkey AS sent_id", "o_orderkey AS clause_id", f"lag(o_orderkey) {near} AS parent_id", f"lead(o_orderkey) {near} AS topic_id", "o_orderkey % 50 AS subject_b", "o_orderkey % 50 + 2 AS subject_e", subject)
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS clause_id", "l_linenumber AS n").distinct()
    return clauses, lines.join(clauses.select("sent_id", "clause_id"), "clause_id").withColumn("phrase_id", F.col("clause_id") * 10 + F.col("n"))


@query(_CLAUSES + """, asked AS (SELECT *, ['Person', 'Org', 'Person', NULL][n % 4 + 1] AS want FROM placed)
SELECT * FROM (SELECT sent_id, phrase_id, CASE WHEN n % 3 = 0 AND oc = want THEN ob WHEN uc = want THEN ub WHEN tc = want THEN tb END AS b FROM asked) WHERE b IS NOT NULL""")
def pronoun_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, phrases = _clauses(spark, sf_dir)
    persons = F.array(*[F.lit(p) for p in ("He", "It", "She", "They")])
    phrases = phrases.withColumns({"person": F.element_at(persons, F.col("n") % 4 + 1), "genitive": F.col("n") % 3 == 0})
    return coreference.pronouns(phrases, clauses).select("sent_id", "phrase_id", "b")


@query(_CLAUSES + "SELECT * FROM (SELECT sent_id, phrase_id, CASE WHEN uc = 'Org' THEN ub WHEN tc = 'Org' THEN tb END AS b FROM placed WHERE n % 3 = 1 AND n % 2 = 0) WHERE b IS NOT NULL")
def definite_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, phrases = _clauses(spark, sf_dir)
    noun = F.when(F.col("n") % 2 == 0, F.array(F.lit("company"))).otherwise(F.array(F.lit("big"), F.lit("company")))
    phrases = phrases.withColumns({"article": F.when(F.col("n") % 3 == 1, "Definite").otherwise("Indefinite"), "noun": noun})
    return coreference.definites(phrases, clauses).select("sent_id", "phrase_id", "b")


@query(_CLAUSES + "SELECT sent_id, phrase_id, ob AS b FROM placed WHERE n % 2 = 0 AND oc = 'Org'")
def genitive_antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, phrases = _clauses(spark, sf_dir)
    phrases = phrases.withColumn("owner", F.when(F.col("n") % 2 == 0, "the company"))
    return coreference.definite_genitives(phrases, clauses).select("sent_id", "phrase_id", "b")


@query(_LINES + """, other AS (SELECT sent_id, node_id, list(CASE WHEN tag = 'VP' AND parent_id IS NOT NULL THEN node_id END) OVER (PARTITION BY sent_id, parent_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM node)
SELECT sent_id, node_id, array_to_string(list_filter(coalesce(s, []), lambda x: x IS NOT NULL), ' ') AS siblings, list_filter(s, lambda x: x IS NOT NULL)[1] AS nearest FROM other""")
def siblings_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.with_siblings_like(_nodes(spark, sf_dir).select("sent_id", "node_id", "parent_id", "ord", "tag"), F.col("tag") == "VP")
    return found.select("sent_id", "node_id", F.array_join(F.col("siblings").cast("array<string>"), " ").alias("siblings"), "nearest")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, c IS NOT NULL AND c IN ('that', 'whether') AS named, l_suppkey % 2 = 0 AS infinitive, c IS NULL OR c = 'that' AS plain, CASE WHEN l_suppkey % 2 = 0 THEN 'to' ELSE 'have' END AS head
FROM (SELECT *, ['that', 'whether', 'if', NULL][l_partkey % 4 + 1] AS c FROM lineitem)""")
def clause_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.nullif(F.element_at(F.array(*[F.lit(w) for w in ("that", "whether", "if", "")]), (F.col("l_partkey") % 4 + 1).cast("int")), F.lit(""))
    auxiliaries = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("to"))).otherwise(F.array(F.lit("have")))
    kinds = {"named": meaning.has_complementizer(word, ["that", "whether"]), "infinitive": meaning.is_to_infinitive(auxiliaries), "plain": meaning.is_empty_or_that(word), "head": meaning.last_of_group(auxiliaries)}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in kinds.items()])


@query("""WITH triple AS (SELECT ['wordnet', 'wikicat', 'title'][l_suppkey % 3 + 1] AS sk, CASE l_suppkey % 3 WHEN 2 THEN 'S' ELSE 's' END || l_suppkey AS s, l_partkey % 3 = 0 AS sub, CASE WHEN l_partkey % 2 = 0 THEN 'wordnet' ELSE 'title' END AS ok, CASE WHEN l_partkey % 2 = 0 THEN 'p' ELSE 'P' END || l_partkey AS o FROM lineitem)
SELECT name, s, o FROM triple JOIN (VALUES ('typedCat', 'wikicat', 'wordnet', false), ('interlink', 'title', 'title', false), ('synset', 'title', 'wordnet', false), ('taxonomy', 'wordnet', 'wordnet', true)) v(name, a, b, needs) ON sk = a AND ok = b AND (sub OR NOT needs)""")
def triple_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = "CASE l_suppkey % 3 WHEN 0 THEN concat('<wordnet_s', l_suppkey, '>') WHEN 1 THEN concat('<wikicat_s', l_suppkey, '>') ELSE concat('<S', l_suppkey, '>') END"
    verb = "CASE l_partkey % 3 WHEN 0 THEN 'rdfs:subClassOf' WHEN 1 THEN '<subClassOf>' ELSE 'rdf:type' END"
    found = rdf.triples(read(spark, sf_dir, "lineitem").selectExpr(f"concat_ws('\t', {subject}, {verb}, CASE WHEN l_partkey % 2 = 0 THEN concat('<wordnet_p', l_partkey, '>') ELSE concat('<P', l_partkey, '>') END) AS value"))
    return rdf.views(found)


@query("""SELECT conv_id, sent_id, b - sb AS b, e - sb AS e, k FROM (SELECT conv_id, turn % 3 * 10 AS b, turn % 3 * 10 + turn % 13 AS e, turn AS k FROM conversations) JOIN (SELECT conv_id, turn AS sent_id, turn * 10 AS sb, turn * 10 + 10 AS se FROM conversations) USING (conv_id) WHERE sb <= b AND e <= se""")
def tags_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    tags = turns.selectExpr("conv_id AS doc_id", "turn % 3 * 10 AS b", "turn % 3 * 10 + turn % 13 AS e", "turn AS k")
    found = meaning.tags_of_sentences(tags, turns.selectExpr("conv_id AS doc_id", "turn AS sent_id", "turn * 10 AS sb", "turn * 10 + 10 AS se"))
    return found.withColumnRenamed("doc_id", "conv_id")
