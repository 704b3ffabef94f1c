"""Parsed sentences as rows: all nodes of a tree in one array, in pre-order, so a node's id is its place in the array.

Rules over a sentence are column expressions on that array: ancestors are the
nodes whose run of ids holds a node, siblings share its parent. One shuffle brings
a sentence together; every rule after it is a projection without a shuffle.
``stage`` computes columns once: Catalyst would else copy an array's expression
into each lambda that uses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tags import VERBS
from lexmill.functions.text import plain_tag

#: The array of nodes in a row.
NODES = "n"


def gathered(nodes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """sent_id, n, marks: one row a sentence. nodes: node rows (see ``sources.penn``) with ``lemma``; marks: sent_id, b, e (half-open), kind.

    In ``n`` tags of phrases are without function marks, ``e`` is the last word of a
    node, included. ``kind`` is Time or the class of a named thing.
    """
    leaf = F.col("is_leaf")
    tag = F.when(leaf, F.col("tag")).otherwise(plain_tag(F.col("tag")))
    node = F.struct(F.col("node_id").alias("id"), F.col("last_id").alias("last"), F.col("parent_id").alias("parent"), "ord", tag.alias("tag"), leaf.alias("leaf"), "word", F.coalesce("lemma", F.lit("")).alias("lemma"), "b", (F.col("e") - 1).alias("e"))
    whole = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(node)).alias("n"))
    kind = "array<struct<b: int, e: int, kind: string>>"
    if marks is None:
        return whole.withColumn("marks", F.expr(f"cast(array() as {kind})"))
    mark = F.struct(F.col("b").cast("int").alias("b"), (F.col("e") - 1).cast("int").alias("e"), "kind")
    listed = marks.groupBy("sent_id").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    return whole.join(listed, "sent_id", "left").withColumn("marks", F.coalesce("marks", F.expr(f"cast(array() as {kind})")))


def with_kids(rows: DataFrame) -> DataFrame:
    """Adds to each node of ``gathered`` rows ``kid``, its last child."""
    listed = stage(rows.withColumnRenamed("n", "_n"), _ends=F.transform("_n", lambda y: F.when(at(y["parent"], "_n")["last"] == y["last"], y["parent"])))  # of each last child its parent
    whole = stage(listed, n=extended("_n", kid=lambda x: at(F.array_position("_ends", x["id"]).cast("int") - 1, "_n")["id"]))
    return whole.select(*rows.columns)


def sentences(nodes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """As ``gathered``, with each node's last child."""
    return with_kids(gathered(nodes, marks))


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed here and now, once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def at(i: Column, n: Column | str = NODES) -> Column:
    """The node with an id; null for null or an id outside of the tree."""
    return F.get(n, i)


def parent(x: Column) -> Column:
    return at(x["parent"])


def nodes_where(test: Callable[[Column], Column], n: Column | str = NODES) -> Column:
    return F.filter(n, test)


def first_id(nodes: Column) -> Column:
    """The least id of some nodes; null if there are none."""
    return F.array_min(F.transform(nodes, lambda y: y["id"]))


def last_id(nodes: Column) -> Column:
    return F.array_max(F.transform(nodes, lambda y: y["id"]))


def above(x: Column) -> Column:
    """Proper ancestors, from the root down."""
    return nodes_where(lambda y: (y["id"] < x["id"]) & (y["last"] >= x["id"]))


def before(x: Column) -> Column:
    """Earlier siblings, in order."""
    return nodes_where(lambda y: (y["parent"] == x["parent"]) & (y["id"] < x["id"]))


def after(x: Column) -> Column:
    return nodes_where(lambda y: (y["parent"] == x["parent"]) & (y["id"] > x["id"]))


def sibling(x: Column, step: int) -> Column:
    """The sibling so many places on."""
    return F.get(nodes_where(lambda y: (y["parent"] == x["parent"]) & (y["ord"] == x["ord"] + step)), 0)


def first_child(x: Column) -> Column:
    return F.when(x["last"] > x["id"], at(x["id"] + 1))


def last_child(x: Column) -> Column:
    return at(x["kid"])


def is_phrase(x: Column, *tags: str) -> Column:
    return F.coalesce(~x["leaf"] & x["tag"].isin(*tags), F.lit(False))


def is_word(x: Column, *tags: str) -> Column:
    return F.coalesce(x["leaf"] & x["tag"].isin(*tags), F.lit(False))


def has_lemma(x: Column, *lemmas: str) -> Column:
    return F.coalesce(x["leaf"] & x["lemma"].isin(*lemmas), F.lit(False))


def is_verb(x: Column) -> Column:
    return is_word(x, *VERBS)


def found(array: Column | str, test: Callable[[Column], Column]) -> Column:
    """The first element that passes; null if none does."""
    return F.get(F.filter(array, test), 0)


def span(kind: Column | str, b: Column, e: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), b.alias("b"), e.alias("e"))


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<kind: string, b: int, e: int>>)")


def text_of(b: Column, e: Column) -> Column:
    """The words of a range, joined by blanks."""
    held = nodes_where(lambda y: y["leaf"] & (y["b"] >= b) & (y["b"] <= e))
    return F.array_join(F.transform(held, lambda y: y["word"]), " ")


def record(**fields: Column) -> Column:
    """A struct of named values."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def extended(array: Column | str, **fields: Callable[[Column], Column]) -> Column:
    """An array of structs with more fields, each from the struct as it was."""

    def more(x: Column) -> Column:
        out = x
        for name, make in fields.items():
            out = out.withField(name, make(x))
        return out

    return F.transform(array, more)
