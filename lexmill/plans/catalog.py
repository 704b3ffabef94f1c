"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import tags, text
from lexmill.operators import gazetteer, graph, joins, lexicon, mentions, sequences, sets, spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Matching of a dictionary: the first one and the first three words of each benchmark text are its names.

_NAMES = r"""
word AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM documents),
bench AS (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM benchmark),
name AS (SELECT DISTINCT name FROM (SELECT words[1:1] AS name FROM bench UNION ALL SELECT words[1:3] FROM bench) WHERE len(name) > 0),
prefix AS (SELECT DISTINCT name[1:n] AS prefix FROM (SELECT name, unnest(range(1, len(name) + 1)) AS n FROM name)),
place AS (SELECT doc_id, words, unnest(range(0, len(words))) AS b FROM word),
walk AS (SELECT doc_id, b, max(len(p.prefix)) AS n, arg_max(p.prefix, len(p.prefix)) AS name FROM place JOIN prefix p
  ON p.prefix[1] = words[b + 1] AND p.prefix = words[b + 1 : b + len(p.prefix)] GROUP BY doc_id, b),
hit AS (SELECT walk.* FROM walk JOIN name USING (name)),
"""
_TAKEN = """
following AS (SELECT h.doc_id, h.b, h.b + h.n AS e, h.name, f.b AS next FROM hit h ASOF LEFT JOIN hit f ON h.doc_id = f.doc_id AND f.b >= h.b + h.n),
taken AS (SELECT f.* FROM following f JOIN (SELECT doc_id, min(b) AS b FROM hit GROUP BY doc_id) USING (doc_id, b)
  UNION ALL SELECT f.* FROM taken t JOIN following f ON f.doc_id = t.doc_id AND f.b = t.next),
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select(text.tokens(F.col("text")).alias("w"))
    return words.select(F.slice("w", 1, 1).alias("name")).unionByName(words.select(F.slice("w", 1, 3).alias("name"))).where(F.size("name") > 0).distinct()


@query(f"WITH RECURSIVE {_NAMES} {_TAKEN} done AS (SELECT 1) SELECT doc_id, b::BIGINT AS b, e::BIGINT AS e, array_to_string(name, ' ') AS name FROM taken")
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gazetteer.annotate(_documents(spark, sf_dir), _names(spark, sf_dir))
    return found.select("doc_id", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"), F.array_join("name", " ").alias("name"))


@query(f"WITH {_NAMES} done AS (SELECT 1) SELECT doc_id, b::BIGINT AS b, n::INTEGER AS n, array_to_string(name, ' ') AS name FROM hit")
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.hits(_documents(spark, sf_dir), _names(spark, sf_dir)).select("doc_id", "b", F.col("n").cast("int").alias("n"), F.array_join("name", " ").alias("name"))


def _numbered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions made of the matches: hits of one word are of an unknown class, the others are resolved; class by the length of the name."""
    found = gazetteer.annotate(_documents(spark, sf_dir), _names(spark, sf_dir))
    long = F.size("name") > 1
    cls = F.when(F.length(F.element_at("name", 1)) % 2 == 0, "Person").otherwise("Organization")
    ne = F.when(F.length(F.element_at("name", 1)) % 2 == 0, "Person").otherwise("Org")
    rows = found.select("doc_id", F.col("b").alias("ord"), F.col("name").alias("words"), F.when(long, "resolved").otherwise("ambiguous").alias("state"), F.when(~long, ne).alias("ne"), F.when(long, cls).alias("cls"))
    return rows


@query(
    f"WITH RECURSIVE {_NAMES} {_TAKEN}"
    """
m AS (SELECT doc_id, b AS ord, name, len(name) > 1 AS long, length(name[1]) % 2 AS odd FROM taken),
ref AS (SELECT s.doc_id, s.ord, min(t.ord) AS ref FROM m s JOIN m t ON s.doc_id = t.doc_id AND t.long AND NOT s.long AND t.ord < s.ord AND s.odd = t.odd AND list_contains(t.name, s.name[1]) GROUP BY ALL)
SELECT doc_id, ord::BIGINT AS ord, array_to_string(name, ' ') AS words, ref::BIGINT AS ref FROM m LEFT JOIN ref USING (doc_id, ord)"""
)
def mention_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The mentions are used on both sides: they are written once.
    from lexmill.plans.shared import written

    linked = mentions.link(written(_numbered_hits(spark, sf_dir), "mentions"))
    return linked.select("doc_id", "ord", F.array_join("words", " ").alias("words"), "ref")


# Words and characters.


@query(r"SELECT token, count(*) AS n FROM (SELECT lower(unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))) AS token FROM documents) GROUP BY token")
def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.explode("words").alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, i::INTEGER AS ord, l[i] AS target FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l, unnest(range(1, len(l) + 1)) AS i FROM pages)""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.posexplode(text.link_targets(F.col("html"))).alias("ord", "target"))
    return pages.withColumn("ord", F.col("ord") + 1)


@query("SELECT c_custkey AS id, regexp_extract(c_name, '#0*([0-9]+)$', 1)::BIGINT AS number, regexp_extract(c_name, '^([A-Za-z]+)', 1) AS kind FROM customer UNION ALL SELECT s_suppkey, regexp_extract(s_name, '#0*([0-9]+)$', 1)::BIGINT, regexp_extract(s_name, '^([A-Za-z]+)', 1) FROM supplier")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(table: str, key: str, name: str) -> DataFrame:
        return read(spark, sf_dir, table).select(F.col(key).alias("id"), text.leading_number(F.substring_index(name, "#", -1)).alias("number"), F.regexp_extract(name, "^([A-Za-z]+)", 1).alias("kind"))

    return parsed("customer", "c_custkey", "c_name").unionByName(parsed("supplier", "s_suppkey", "s_name"))


@query("SELECT vec_id, len(embedding)::INTEGER AS size, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("size"), F.round(text.vector_norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%m/%d/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S') AS parsed FROM orders")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss 'UTC' EEE")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.dated(said).cast("timestamp_ntz").alias("parsed"))


@query(r"""WITH term AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r]+')[1:2]) || ' ' AS t FROM benchmark) WHERE length(t) > 2)
SELECT doc_id, t AS term FROM documents JOIN term ON contains(text, t)""")
def term_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.split("text", text.BLANKS, -1), 1, 2)).alias("w"))
    terms = words.where(F.length("w") > 1).select(F.concat("w", F.lit(" ")).alias("term")).distinct()
    return text.containing(read(spark, sf_dir, "documents"), terms, "doc_id", "text")


# Sequences.


@query("""WITH p AS (SELECT user_id, event_type, row_number() OVER w - 1 AS i, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_type, min(i)::BIGINT AS b, (max(i) + 1)::BIGINT AS e FROM p WHERE event_type <> 'view' GROUP BY user_id, event_type, run""")
def ner_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.islands(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", drop="view")


@query("""WITH p AS (SELECT *, row_number() OVER w - 1 AS i, row_number() OVER w - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, role, min(i)::BIGINT AS b, string_agg(text, ' ' ORDER BY i) AS words FROM p WHERE role <> 'system' GROUP BY conv_id, role, run""")
def merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.joined_runs(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "text", drop="system")


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY p_type ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY p_type) AS total FROM c)
SELECT p_type, p_brand, n FROM s WHERE before < 0.9 * total""")
def histogram_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return sequences.histogram_cut(counts, ["p_type"], [F.col("n").desc(), F.col("p_brand")], "n", 0.9)


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS b, l_linenumber AS e FROM lineitem),
p AS (SELECT *, lag(e) OVER w AS was FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY b, e)),
n AS (SELECT *, sum(CASE WHEN was + 1 = b THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run, max(coalesce(was >= b, false)) OVER (PARTITION BY l_orderkey) AS clash FROM p)
SELECT l_orderkey, min(b) AS b, max(e) AS e, count(*) AS parts, any_value(clash) AS "overlaps" FROM n GROUP BY l_orderkey, run""")
def contiguous_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("l_linenumber").alias("e")).distinct()
    return sequences.contiguous_segments(lines, ["l_orderkey"], "b", "e")


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER w - 1 AS idx, event_type = 'error' AS excluded, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, idx::BIGINT AS idx, excluded, CASE WHEN NOT excluded THEN idx - before END::BIGINT AS adjusted FROM p""")
def adjust_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return sequences.adjust_index(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "idx", "excluded", "adjusted")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS subject, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS verb FROM events)
SELECT user_id, event_id, last_value(subject IGNORE NULLS) OVER w AS subject, last_value(verb IGNORE NULLS) OVER w AS verb FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(kind.isin("signup", "purchase"), kind).alias("subject"), F.when(kind.isin("error", "click"), kind).alias("verb"))
    return sequences.carry_forward(rows, ["user_id"], ["ts", "event_id"], ["subject", "verb"]).drop("ts")


_TURNS = r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS words FROM conversations),
w AS (SELECT conv_id, turn, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM t),
s AS (SELECT *, coalesce(sum(length(word) + 1 + i % 3) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),"""


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, with character offsets that leave one to three blanks between them."""
    from pyspark.sql import Window

    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.tokens(F.col("text"))).alias("i", "word"))
    before = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("b", F.coalesce(F.sum(F.length("word") + 1 + F.col("i") % 3).over(before), F.lit(0)))
    return placed.withColumn("e", F.col("b") + F.length("word"))


@query(_TURNS + " g AS (SELECT *, b - lag(b + length(word)) OVER (PARTITION BY conv_id, turn ORDER BY b) AS gap FROM s) SELECT conv_id, turn, string_agg(repeat(' ', coalesce(gap, 0)::BIGINT) || word, '' ORDER BY b) AS text FROM g GROUP BY ALL")
def gap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.gap_text(_turn_tokens(spark, sf_dir), ["conv_id", "turn"], "b", "e", "word")


@query(_TURNS + """ g AS (SELECT *, CASE WHEN word LIKE '%.' THEN 6 WHEN word LIKE '%,' THEN 2 ELSE 0 END AS own FROM s),
a AS (SELECT *, sum(own) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS al FROM g)
SELECT conv_id, turn, i::INTEGER AS i, (b + al - own)::BIGINT AS new_b, (b + length(word) + al)::BIGINT AS new_e FROM a""")
def span_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = F.when(F.col("word").endswith("."), 6).when(F.col("word").endswith(","), 2).otherwise(0)
    return sequences.shifted_spans(_turn_tokens(spark, sf_dir), ["conv_id", "turn"], ["i"], "b", "e", growth).select("conv_id", "turn", "i", "new_b", "new_e")


@query("SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.neighbours_in_order(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").drop("role")


# Spans: runs of purchases and errors against hours of a user's events.

_SPANS = """WITH p AS (SELECT user_id, event_type, row_number() OVER w - 1 AS i, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT DISTINCT user_id, (min(i) - min(i) % 3)::BIGINT AS b, (max(i) + 1 + max(i) % 4)::BIGINT AS e FROM p WHERE event_type IN ('error', 'purchase') GROUP BY user_id, event_type, run),
l AS (SELECT user_id, min(i)::BIGINT AS b, (max(i) + 1)::BIGINT AS e FROM p WHERE event_type = 'view' GROUP BY user_id, event_type, run)
"""


def _wide_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequences.islands(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").where(F.col("event_type").isin("error", "purchase"))
    return runs.select("user_id", (F.col("b") - F.col("b") % 3).alias("b"), (F.col("e") + (F.col("e") - 1) % 4).alias("e")).distinct()


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.islands(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("event_type = 'view'").select("user_id", "b", "e")


@query(_SPANS + """SELECT user_id, pos, count(*) AS n FROM (SELECT l.user_id, CASE WHEN l.e <= s.b THEN 'LbeforeR' WHEN s.e <= l.b THEN 'RbeforeL' WHEN l.b = s.b AND l.e = s.e THEN 'Coincide' WHEN l.b <= s.b AND s.e <= l.e THEN 'RinL'
WHEN s.b <= l.b AND l.e <= s.e THEN 'LinR' WHEN s.b < l.b AND s.e < l.e THEN 'RoverlapL' ELSE 'LoverlapR' END AS pos FROM l JOIN s USING (user_id)) GROUP BY ALL""")
def relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _views(spark, sf_dir), _wide_spans(spark, sf_dir).select("user_id", F.col("b").alias("rb"), F.col("e").alias("re"))
    return left.join(right, "user_id").groupBy("user_id", spans.relative_position(F.col("b"), F.col("e"), F.col("rb"), F.col("re")).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@query(_SPANS + "SELECT user_id, b, e FROM l WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = l.user_id AND l.b >= s.b AND l.e <= s.e AND (l.b <> s.b OR l.e <> s.e))")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.within(_views(spark, sf_dir), _wide_spans(spark, sf_dir), ["user_id"], strict=True)


@query(_SPANS + ", o AS (SELECT c.user_id, c.b, c.e, arg_min({'b': p.b, 'e': p.e}, (p.e - p.b) * 1000000 + p.b) AS x FROM s c JOIN s p ON p.user_id = c.user_id AND c.b >= p.b AND c.e <= p.e AND (c.b <> p.b OR c.e <> p.e) GROUP BY ALL) SELECT user_id, b, e, x.b AS parent_b, x.e AS parent_e FROM s LEFT JOIN o USING (user_id, b, e)")
def range_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.range_forest(_wide_spans(spark, sf_dir), ["user_id"])


@query(_SPANS + "SELECT user_id, b, e FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.user_id = s.user_id AND s.b >= p.b AND s.e <= p.e AND (s.b <> p.b OR s.e <> p.e))")
def maximal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.maximal_spans(_wide_spans(spark, sf_dir), ["user_id"])


@query(_TURNS + " p AS (SELECT conv_id, turn, i, word, b, b + length(word) AS ce FROM s) SELECT f.conv_id, f.turn, f.i::INTEGER AS b, (f.i + 3)::INTEGER AS e, f.b::BIGINT AS cb, l.ce::BIGINT AS ce FROM p f JOIN p l ON l.conv_id = f.conv_id AND l.turn = f.turn AND l.i = f.i + 2")
def token_char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _turn_tokens(spark, sf_dir).select("conv_id", "turn", F.col("i").alias("idx"), F.col("b").alias("cb"), F.col("e").alias("ce"))
    asked = tokens.select("conv_id", "turn", F.col("idx").alias("b"), (F.col("idx") + 3).alias("e"))
    return spans.token_to_character_spans(asked, tokens, ["conv_id", "turn"])


# Joins, lists and bags.


@query("SELECT o_orderkey, o_totalprice, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) ON l_orderkey = o_orderkey")
def head_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    return joins.head_match_join(orders, lines, "k", ["o_totalprice"], ["l_linenumber", "l_partkey", "l_suppkey"]).select(F.col("k").alias("o_orderkey"), "o_totalprice", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, coalesce(array_to_string(items, ','), '') AS items FROM orders LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def left_outer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    return joins.left_outer_groups(orders, lines, "k", "l_partkey", "l_linenumber").select(F.col("k").alias("o_orderkey"), F.array_join("items", ",").alias("items"))


@query("""WITH ids AS (SELECT p_name, max(p_partkey) AS item FROM part GROUP BY 1), al AS (SELECT p_partkey AS item, p_brand AS alias FROM part)
SELECT p_partkey, item, alias FROM part LEFT JOIN ids USING (p_name) LEFT JOIN al USING (item)""")
def alias_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    ids = joins.last_wins(part.select("p_name", F.col("p_partkey").alias("item"), F.col("p_partkey").alias("ord")), "p_name", "item", "ord")
    aliases = part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("alias"))
    return joins.two_hop(part.select("p_partkey", "p_name"), ids, aliases, "p_name", "item").select("p_partkey", "item", "alias")


@query("SELECT p_name, array_to_string(list(p_partkey ORDER BY p_partkey DESC), ',') AS ids FROM part GROUP BY 1")
def alias_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    return joins.multimap(part, "p_name", "id", "ord").select("p_name", F.array_join("ids", ",").alias("ids"))


@query("""WITH p(cls, prio) AS (VALUES ('MACHINERY', 0), ('BUILDING', 1), ('AUTOMOBILE', 2), ('HOUSEHOLD', 3), ('FURNITURE', 4))
SELECT c_nationkey * 10000 + floor(c_acctbal / 10)::BIGINT AS k, arg_min(cls, prio) AS cls FROM customer JOIN p ON cls = c_mktsegment GROUP BY 1""")
def class_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([(c, i) for i, c in enumerate(("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"))], "cls string, prio int")
    key = (F.col("c_nationkey") * 10000 + F.floor(F.col("c_acctbal") / 10)).cast("long").alias("k")
    return joins.by_priority(read(spark, sf_dir, "customer").select(key, F.col("c_mktsegment").alias("cls")), "k", "cls", order)


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey AS pa, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT l_orderkey AS k, l_partkey AS pb, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'R')
SELECT k, rank::INTEGER AS rank, pa, pb FROM a FULL JOIN r USING (k, rank)""")
def rank_aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    left, right = (lines.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias(n), F.col("l_linenumber").alias(f"{n}_line")) for f, n in (("A", "pa"), ("R", "pb")))
    return joins.rank_aligned_pairs(left, right, "k", ["pa", "pa_line"], ["pb", "pb_line"]).select("k", "rank", "pa", "pb")


@query("SELECT l_orderkey AS k, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bag_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return sets.bag_intersection(left, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), "k")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return sets.bag_union(left, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT user_id, event_id AS b, 'L' AS side FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 'R' FROM events WHERE event_type = 'error'")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("b"), "event_type")
    return sets.tag_merge(events.where("event_type = 'click'").drop("event_type"), events.where("event_type = 'error'").drop("event_type"))


# Graphs: customers buy from suppliers; nations sell to nations; documents form a binary tree.

_TRADE = """WITH trade AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
"""
_TRADE_RECURSIVE = _TRADE.replace("WITH trade", "WITH RECURSIVE trade", 1)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, suppliers, lines = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "lineitem"))
    bought = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    from lexmill.plans.shared import written

    return written(bought.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct(), "trade")


@query("SELECT DISTINCT o_custkey AS node, l_suppkey AS neighbour FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.neighbours(edges)


@query(_TRADE_RECURSIVE + """, w AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS distance FROM nation UNION SELECT start, dst, distance + 1 FROM w JOIN trade ON src = node WHERE distance < 3)
SELECT start, node, min(distance)::INTEGER AS distance FROM w GROUP BY ALL""")
def khop_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.reachable(_trade(spark, sf_dir), starts, 3)


@query(_TRADE_RECURSIVE + """, w AS (SELECT n_nationkey AS start, [n_nationkey] AS path FROM nation UNION ALL SELECT start, list_append(path, dst) FROM w JOIN trade ON src = path[-1] WHERE len(path) < 3)
SELECT start, array_to_string(path, '>') AS path FROM w""")
def all_paths_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.walks(_trade(spark, sf_dir), starts, 2).select("start", F.array_join("path", ">").alias("path"))


@query(_TRADE + """, near AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation UNION SELECT src, dst FROM trade),
pair AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey + 1 IN (SELECT n_nationkey FROM nation))
SELECT a, b, count(*) AS n FROM pair JOIN near x ON x.start = a JOIN near y ON y.start = b AND x.node = y.node GROUP BY ALL""")
def meeting_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.meeting_nodes(_trade(spark, sf_dir), _next_nations(spark, sf_dir), 1).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _next_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with the next one by number."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    return nations.join(nations.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")


@query(_TRADE + """, pair AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey + 1 IN (SELECT n_nationkey FROM nation)),
l AS (SELECT a, b, dst AS e FROM pair JOIN trade ON src = a), r AS (SELECT a, b, dst AS e FROM pair JOIN trade ON src = b),
met AS (SELECT a, b, a || '>' || l.e AS "left", b || '>' || l.e AS "right" FROM l JOIN r USING (a, b, e) UNION ALL SELECT a, b, a::VARCHAR, b || '>' || e FROM r WHERE e = a UNION ALL SELECT a, b, a || '>' || e, b::VARCHAR FROM l WHERE e = b)
SELECT * FROM met""")
def meeting_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = graph.meeting_paths(_trade(spark, sf_dir), _next_nations(spark, sf_dir), 1)
    return met.select("a", "b", F.array_join("left", ">").alias("left"), F.array_join("right", ">").alias("right"))


@query(_TRADE_RECURSIVE + """, w AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS distance FROM nation UNION SELECT start, src, distance + 1 FROM w JOIN trade ON dst = node WHERE distance < 2)
SELECT start, node, min(distance)::INTEGER AS distance FROM w GROUP BY ALL""")
def reachable_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.reachable(_trade(spark, sf_dir), starts, 2, backward=True)


@query(_TRADE + "SELECT dst AS node, src AS neighbour FROM trade")
def nodes_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_trade(spark, sf_dir), backward=True)


@query("""WITH l AS (SELECT user_id, floor(event_id / 7)::BIGINT AS f, event_id % 5 AS e FROM events WHERE event_type = 'click'), r AS (SELECT user_id, floor(event_id / 3)::BIGINT AS f, event_id % 5 AS e FROM events WHERE event_type = 'error'),
lr AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY f) AS n FROM l), rr AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY f) AS n FROM r)
SELECT user_id, lr.f || '>' || e AS "left", rr.f || '>' || e AS "right" FROM lr JOIN rr USING (user_id, e, n)""")
def path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    def paths(kind: str, step: int) -> DataFrame:
        rows = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
        return rows.select("user_id", F.array(F.floor(F.col("event_id") / step).cast("long"), (F.col("event_id") % 5).cast("long")).alias("path"))

    met = graph.path_overlap(paths("click", 7), paths("error", 3), ["user_id"])
    return met.select("user_id", F.array_join("left", ">").alias("left"), F.array_join("right", ">").alias("right"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS ref, l_partkey AS candidate, (l_quantity * 10)::BIGINT AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, ref DESC, candidate DESC) AS n FROM s) SELECT o_custkey, score, ref, candidate FROM r WHERE n = 1 AND score > 450""")
def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    scored = scored.select("o_custkey", (F.col("l_quantity") * 10).cast("long").alias("score"), F.col("o_orderkey").alias("ref"), F.col("l_partkey").alias("candidate"))
    return graph.most_similar(scored, ["o_custkey"], 450)


def _two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trade(spark, sf_dir)
    return graph.walks(edges, edges.select(F.col("src").alias("node")).distinct(), 2).where(F.size("path") == 3)


@query(_TRADE + """
SELECT x.dst AS node, count(*) AS n FROM trade x JOIN trade y ON x.dst = y.src GROUP BY 1""")
def interior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.interior_counts(_two_hops(spark, sf_dir))


@query(_TRADE + """
SELECT x.dst AS node, count(*) AS n FROM trade x JOIN trade y ON x.dst = y.src GROUP BY 1 ORDER BY n DESC, node LIMIT 10""")
def hub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_nodes(_two_hops(spark, sf_dir), 10)


@query(_TRADE + ", hub AS (SELECT dst FROM trade GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5) SELECT src, dst FROM trade WHERE dst NOT IN (SELECT dst FROM hub)")
def without_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trade(spark, sf_dir)
    hubs = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node").limit(5)
    return graph.without_hubs(edges, hubs).select("src", "dst")


@query("""WITH RECURSIVE a AS (SELECT doc_id AS sub, doc_id AS super FROM documents WHERE doc_id > 0 UNION SELECT 0, 0 UNION SELECT sub, super // 2 FROM a WHERE super > 0) SELECT sub, super FROM a""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(read(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("sub"), F.floor(F.col("doc_id") / 2).alias("super")))


@query("""WITH RECURSIVE a AS (SELECT doc_id AS node, doc_id AS here FROM documents UNION SELECT node, here - 7 FROM a WHERE here % 50 >= 7) SELECT node, min(here) AS island FROM a GROUP BY ALL""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    edges = docs.where("node % 50 >= 7").select(F.col("node").alias("src"), (F.col("node") - 7).alias("dst"))
    return graph.islands(edges, docs)


# Patterns and counts.

_PATTERNS = """WITH raw AS (SELECT l_returnflag AS sense, CASE l_linestatus WHEN 'O' THEN 'Passive' ELSE 'Active' END AS voice,
CASE l_linenumber % 4 WHEN 0 THEN 'NP-SBJ' WHEN 1 THEN 'PP-by' WHEN 2 THEN 'NP' END AS arg0, CASE l_suppkey % 4 WHEN 0 THEN 'NP-SBJ' WHEN 1 THEN 'NP' WHEN 2 THEN 'S' ELSE 'SBAR-1' END AS arg1,
CASE l_partkey % 3 WHEN 0 THEN 'PP-with' WHEN 1 THEN 'NP-2' END AS arg2, 1 AS n FROM lineitem),
flag AS (SELECT *, voice = 'Passive' AS p, list_contains([arg0, arg1, arg2], 'SBAR-1') OR list_contains([arg0, arg1, arg2], 'NP-1') AS has1 FROM raw),
c(x) AS (SELECT 1),
active AS (SELECT sense, n, CASE WHEN p AND arg0 = 'PP-by' THEN 'NP-SBJ' WHEN p AND arg0 = 'NP-SBJ' THEN CASE WHEN has1 THEN 'NP' ELSE 'NP-1' END ELSE arg0 END AS a0,
CASE WHEN p AND arg1 = 'NP-SBJ' THEN CASE WHEN has1 THEN 'NP' ELSE 'NP-1' END ELSE arg1 END AS a1, arg2 AS a2 FROM flag),
g AS (SELECT *, list_transform([a0, a1, a2], lambda x: regexp_extract(coalesce(x, ''), '^(NP|S|SBAR)-(SBJ|1|2)$', 2)) AS gs FROM active),
np AS (SELECT sense, n, CASE WHEN NOT list_contains(gs, 'SBJ') AND a0 = 'NP' THEN 'NP-SBJ' ELSE a0 END AS a0,
CASE WHEN NOT list_contains(gs, 'SBJ') AND coalesce(a0, '') = 'NP' THEN a1 WHEN a1 = 'NP' AND NOT list_contains(gs, '1') THEN 'NP-1' WHEN a1 = 'NP' AND NOT list_contains(gs, '2') THEN 'NP-2' ELSE a1 END AS a1, a2 FROM g),
s AS (SELECT sense, n, a0, CASE WHEN a1 = 'S' THEN 'SBAR' ELSE a1 END AS a1, a2 FROM np),
g2 AS (SELECT *, list_transform([a0, a1, a2], lambda x: regexp_extract(coalesce(x, ''), '^(NP|S|SBAR)-(SBJ|1|2)$', 2)) AS gs FROM s),
done AS (SELECT sense, n, a0 AS arg0, CASE WHEN a1 = 'SBAR' AND NOT list_contains(gs, '1') THEN 'SBAR-1' WHEN a1 = 'SBAR' AND NOT list_contains(gs, '2') THEN 'SBAR-2' ELSE a1 END AS arg1, a2 AS arg2 FROM g2),
merged AS (SELECT sense, arg0, arg1, arg2, sum(n)::BIGINT AS n FROM done GROUP BY ALL)
"""


def _merged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, sup, part = F.col("l_linenumber") % 4, F.col("l_suppkey") % 4, F.col("l_partkey") % 3
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sense"),
        F.when(F.col("l_linestatus") == "O", "Passive").otherwise("Active").alias("voice"),
        F.when(line == 0, "NP-SBJ").when(line == 1, "PP-by").when(line == 2, "NP").alias("arg0"),
        F.when(sup == 0, "NP-SBJ").when(sup == 1, "NP").when(sup == 2, "S").otherwise("SBAR-1").alias("arg1"),
        F.when(part == 0, "PP-with").when(part == 1, "NP-2").alias("arg2"),
        none.alias("arg3"),
        none.alias("arg4"),
        F.lit(1).alias("n"),
    )
    # Counted before it is normalised: the rules then meet each distinct pattern once.
    counted = rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))
    return lexicon.merge_patterns(counted, ["sense"])


@query(_PATTERNS + "SELECT * FROM merged")
def pattern_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_patterns(spark, sf_dir).drop("arg3", "arg4")


@query(_PATTERNS + """SELECT t.sense, t.arg0, t.arg1, t.arg2, sum(u.n)::BIGINT AS n FROM merged t JOIN merged u ON u.sense = t.sense AND (u.arg0 IS NULL OR u.arg0 = t.arg0) AND (u.arg1 IS NULL OR u.arg1 = t.arg1) AND (u.arg2 IS NULL OR u.arg2 = t.arg2)
WHERE NOT EXISTS (SELECT 1 FROM merged w WHERE w.sense = t.sense AND (t.arg0 IS NULL OR w.arg0 = t.arg0) AND (t.arg1 IS NULL OR w.arg1 = t.arg1) AND (t.arg2 IS NULL OR w.arg2 = t.arg2)
AND (w.arg0 IS DISTINCT FROM t.arg0 OR w.arg1 IS DISTINCT FROM t.arg1 OR w.arg2 IS DISTINCT FROM t.arg2)) GROUP BY ALL""")
def pattern_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.top_patterns(_merged_patterns(spark, sf_dir), ["sense"]).drop("arg3", "arg4")


@query("""WITH p AS (SELECT p_type AS sense, p_brand AS pattern, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT sense, max(n) AS most FROM p GROUP BY 1),
a AS (SELECT v.sense, v.pattern, most FROM (VALUES ('ECONOMY', 'Brand#1'), ('ECONOMY', 'Brand#new'), ('nothing', 'Brand#2')) v(sense, pattern) JOIN m USING (sense))
SELECT coalesce(p.sense, a.sense) AS sense, coalesce(p.pattern, a.pattern) AS pattern, greatest(n, most) AS n FROM p FULL JOIN a ON p.sense = a.sense AND p.pattern = a.pattern""")
def pattern_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sense"), F.col("p_brand").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    added = spark.createDataFrame([("ECONOMY", "Brand#1"), ("ECONOMY", "Brand#new"), ("nothing", "Brand#2")], "sense string, pattern string")
    return lexicon.upsert(known, added, ["sense", "pattern"])


@query("""WITH r AS (SELECT p_type || '.' || p_size AS roleset, CASE WHEN p_type = 'SMALL' AND p_size = 7 THEN 'x' ELSE p_size::VARCHAR END AS n FROM part)
SELECT split_part(roleset, '.', 1) AS lemma, CASE WHEN bool_or(NOT regexp_matches(n, '^[0-9]+$')) THEN 0 ELSE sum(TRY_CAST(n AS BIGINT)) END::BIGINT AS n FROM r GROUP BY 1""")
def lemma_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("p_type") == "SMALL") & (F.col("p_size") == 7)
    rows = read(spark, sf_dir, "part").select(F.concat_ws(".", "p_type", "p_size").alias("roleset"), F.when(bad, "x").otherwise(F.col("p_size").cast("string")).alias("count"))
    return lexicon.lemma_counts(rows, "roleset", "count")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey)::INTEGER AS number FROM part")
def numbered_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.numbered(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], ["p_type", "p_partkey"]).drop("p_type")


# Resolution of mentions: customers are items, their segment the class; names are hit by nation.

_CLASSES = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Organization' WHEN 'HOUSEHOLD' THEN 'Person' WHEN 'AUTOMOBILE' THEN 'Brand' ELSE 'Location' END"


@query(f"""WITH item AS (SELECT c_custkey AS qid, {_CLASSES} AS cls, c_nationkey AS nat FROM customer),
m AS (SELECT n_nationkey AS nat, CASE n_regionkey WHEN 0 THEN 'Org' WHEN 1 THEN 'Person' WHEN 2 THEN 'Loc' WHEN 3 THEN 'Percent' ELSE 'Other' END AS ne FROM nation),
fit AS (SELECT m.nat, m.ne, count(qid) FILTER (ne = 'Other' OR (ne = 'Org' AND cls = 'Organization') OR (ne = 'Person' AND cls = 'Person') OR (ne = 'Loc' AND cls = 'Location')) AS n FROM m LEFT JOIN item USING (nat) GROUP BY ALL)
SELECT nat::BIGINT AS doc_id, ne, CASE WHEN n = 0 THEN 'unresolved_uid' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, n::INTEGER AS candidates FROM fit""")
def resolve_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    cls = F.when(segment == "BUILDING", "Building").when(segment == "MACHINERY", "Organization").when(segment == "HOUSEHOLD", "Person").when(segment == "AUTOMOBILE", "Brand").otherwise("Location")
    items = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), cls.alias("cls"), F.col("c_nationkey").alias("nat"))
    region = F.col("n_regionkey")
    ne = F.when(region == 0, "Org").when(region == 1, "Person").when(region == 2, "Loc").when(region == 3, "Percent").otherwise("Other")
    lists = items.groupBy("nat").agg(F.array_sort(F.collect_list("qid")).alias("uids"))
    merged = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nat"), ne.alias("ne")).join(lists, "nat", "left")
    merged = merged.select(F.col("nat").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("e"), "ne", "uids")
    return mentions.resolve(merged, items.select("qid", "cls")).select("doc_id", "ne", "state", F.size("uids").alias("candidates"))


_SWEEP = """, name AS (SELECT user_id, event_type AS ne, min(i)::BIGINT AS b, (max(i) + 1)::BIGINT AS e FROM p WHERE event_type IN ('purchase', 'click') GROUP BY user_id, event_type, run),
hit AS (SELECT user_id, b, e FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.user_id = s.user_id AND s.b >= o.b AND s.e <= o.e AND (s.b <> o.b OR s.e <> o.e))),
names AS (SELECT user_id, list({'b': b, 'e': e, 'ne': ne} ORDER BY b, e, ne) AS a FROM name GROUP BY user_id), hits AS (SELECT user_id, list({'b': b, 'e': e} ORDER BY b, e) AS f FROM hit GROUP BY user_id),
pair AS MATERIALIZED (SELECT user_id, coalesce(a, []) AS a, coalesce(f, []) AS f FROM names FULL JOIN hits USING (user_id)),
walk(user_id, i, j, b, e, ne, uid) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM pair
  UNION ALL SELECT user_id, CASE WHEN how IN ('before', 'same', 'holds', 'right first') THEN i + 1 WHEN how = 'after' THEN i ELSE greatest(i + 1, len(list_filter(a, lambda x: x.b < r.e))) END,
    CASE WHEN how = 'before' THEN j WHEN how IN ('holds', 'right first') THEN greatest(j + 1, len(list_filter(f, lambda x: x.b < l.e))) ELSE j + 1 END,
    CASE WHEN keeps THEN l.b ELSE r.b END, CASE WHEN keeps THEN l.e ELSE r.e END, CASE WHEN keeps THEN l.ne END, CASE WHEN NOT keeps OR how = 'same' THEN r.b END
  FROM (SELECT *, how IN ('before', 'same', 'holds', 'left first') AS keeps FROM (SELECT *, CASE WHEN l.e <= r.b THEN 'before' WHEN r.e <= l.b THEN 'after' WHEN l.b = r.b AND l.e = r.e THEN 'same' WHEN l.b <= r.b AND r.e <= l.e THEN 'holds' WHEN r.b <= l.b AND l.e <= r.e THEN 'held' WHEN l.b < r.b THEN 'left first' ELSE 'right first' END AS how
    FROM (SELECT w.user_id, i, j, a, f, a[i + 1] AS l, f[j + 1] AS r FROM walk w JOIN pair t ON t.user_id = w.user_id WHERE i < len(a) AND j < len(f))))),
ends AS (SELECT w.user_id, max(i) AS i, max(j) AS j FROM walk w GROUP BY w.user_id),
rest AS (SELECT e.user_id, unnest(a[i + 1 :]) AS x, NULL::BIGINT AS uid FROM ends e JOIN pair USING (user_id)),
others AS (SELECT e.user_id, unnest(f[j + 1 :]) AS x FROM ends e JOIN pair USING (user_id))
SELECT user_id AS doc_id, b, e, ne, CASE WHEN uid IS NOT NULL THEN [uid] END AS uids FROM walk WHERE b IS NOT NULL
UNION ALL SELECT user_id, x.b, x.e, x.ne, NULL FROM rest UNION ALL SELECT user_id, x.b, x.e, NULL, [x.b] FROM others"""


@query(_SPANS.replace("WITH ", "WITH RECURSIVE ", 1) + _SWEEP)
def span_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of purchases as recognised names against wide spans as dictionary hits, by user."""
    names = sequences.islands(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("event_type in ('purchase', 'click')")
    found = _wide_spans(spark, sf_dir).select(F.col("user_id").alias("doc_id"), "b", "e", F.array(F.col("b")).alias("uids"))
    # Hits of a dictionary never overlap: the widest stay.
    return mentions.merge(names.select(F.col("user_id").alias("doc_id"), "b", "e", F.col("event_type").alias("ne")), spans.maximal_spans(found, ["doc_id"]).withColumn("uids", F.array("b")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, l_returnflag IN ('A') AS verb, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag = 'N' END AS noun FROM lineitem GROUP BY ALL")
def tag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("l_returnflag") == "A", "VBD").when(F.col("l_returnflag") == "N", "NNP").otherwise("CD")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({"verb": tags.is_verb(tag), "noun": tags.is_noun(tag)})
