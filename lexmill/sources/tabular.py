"""Readers of tab-separated, CSV, JSON and XML dictionaries. Schemas are fixed; rows that don't parse go to ``rejected``, not to an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of text files."""
    return spark.read.text(path)


def columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated columns as strings; a row with another number of columns has nulls from the first missing one."""
    parts = F.split("value", "\t", -1)
    return lines(spark, path).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """qid, name (words) of rows ``Q42<TAB>name``."""
    rows = columns(spark, path, ["item", "name"]).select(text.item_id(F.col("item")).alias("qid"), text.tokens(F.col("name")).alias("name"))
    return rows.where("qid is not null and size(name) > 0")


def rejected_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``aliases`` leaves out."""
    rows = lines(spark, path).withColumn("p", F.split("value", "\t", -1))
    return rows.where(text.item_id(F.get("p", 0)).isNull() | (F.size(text.tokens(F.get("p", 1))) == 0)).select("value")


def typed_items(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """qid, cls: for each class a file of ids, one a line."""
    parts = [lines(spark, p).select(text.item_id(F.trim("value")).alias("qid"), F.lit(c).alias("cls")).where("qid is not null") for c, p in paths.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of rows with exactly two columns."""
    parts = F.split("value", "\t", -1)
    return lines(spark, path).where(F.size(parts) == 2).select(parts[0].alias("src"), parts[1].alias("dst"))


def subclass_relations(spark: SparkSession, path: str) -> DataFrame:
    """sub, super: ids of the first and the third of four columns."""
    rows = columns(spark, path, ["a", "an", "b", "bn"])
    return rows.select(text.item_id(F.col("a")).alias("sub"), text.item_id(F.col("b")).alias("super")).where("sub is not null and super is not null")


def property_names(spark: SparkSession, path: str) -> DataFrame:
    return columns(spark, path, ["p", "name"]).select(text.item_id(F.col("p"), "P").alias("pid"), "name").where("pid is not null")


def page_titles(spark: SparkSession, path: str) -> DataFrame:
    """qid, title."""
    return columns(spark, path, ["q", "title"]).select(text.item_id(F.col("q")).alias("qid"), "title").where("qid is not null")


def synset_mapping(spark: SparkSession, path: str) -> DataFrame:
    """title, page, qid, synset (name, pos, n)."""
    rows = columns(spark, path, ["title", "page", "q", "s"])
    return rows.select("title", text.leading_number(F.col("page")).alias("page"), text.item_id(F.col("q")).alias("qid"), text.wordnet_id(F.col("s")).alias("synset"))


def listed_companies(spark: SparkSession, path: str) -> DataFrame:
    """name, symbol, sector, industry, page, qid of six-column rows."""
    rows = columns(spark, path, ["name", "sector", "industry", "symbol", "page", "q"])
    return rows.select("name", "symbol", "sector", "industry", text.leading_number(F.col("page")).alias("page"), text.item_id(F.col("q")).alias("qid"))


COMPANY = "companyId int, ticker string, name string, alias array<string>, sector string, industry string"


def companies(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of company records."""
    return spark.read.schema(COMPANY).option("multiLine", True).json(path)


def role_maps(spark: SparkSession, path: str) -> DataFrame:
    """lemma, sense, frame, roles of rows ``id lemma sense frame key:value ...``."""
    parts = text.tokens(F.col("value"))
    rows = lines(spark, path).where(F.size(parts) >= 4)
    rest = F.slice(parts, 5, F.size(parts))
    return rows.select(parts[1].alias("lemma"), parts[2].alias("sense"), parts[3].alias("frame"), text.role_map(F.filter(rest, lambda w: F.contains(w, F.lit(":")))).alias("roles"))


def argument_patterns(spark: SparkSession, path: str) -> DataFrame:
    """lemma, sense, voice, arg0 to arg4, n of nine-column rows; the lemma loses its last ``-`` part."""
    parts = text.tokens(F.col("value"))
    rows = lines(spark, path).where(F.size(parts) == 9)
    lemma = F.regexp_replace(parts[0], "-[^-]*$", "")
    slots = [text.null_word(parts[3 + i]).alias(f"arg{i}") for i in range(5)]
    return rows.select(lemma.alias("lemma"), text.sense_number(lemma, parts[1]).alias("sense"), text.null_word(parts[2]).alias("voice"), *slots, text.leading_number(parts[8]).alias("n"))


def idioms(spark: SparkSession, path: str) -> DataFrame:
    """lemma, sense, idioms (distinct word lists) of rows lemma, sense, idiom..."""
    parts = F.split("value", "\t", -1)
    rows = lines(spark, path).where(F.size(parts) >= 2)
    return rows.select(parts[0].alias("lemma"), parts[1].alias("sense"), F.array_distinct(F.transform(F.slice(parts, 3, F.size(parts)), text.tokens)).alias("idioms"))


def sense_instances(spark: SparkSession, path: str) -> DataFrame:
    """tree, sentence, token, sense, number of rows of five or six words (the fifth of six is left out)."""
    parts = text.tokens(F.col("value"))
    rows = lines(spark, path).where(F.size(parts).isin(5, 6))
    return rows.select(parts[0].alias("tree"), text.leading_number(parts[1]).alias("sentence"), text.leading_number(parts[2]).alias("token"), parts[3].alias("sense"), F.element_at(parts, -1).alias("number"))


def sense_counts(spark: SparkSession, path: str) -> DataFrame:
    """lemma, number, n: how often each sense of a verb occurs."""
    rows = sense_instances(spark, path).where(F.col("sense").endswith("-v"))
    return rows.groupBy(F.regexp_replace("sense", "-v$", "").alias("lemma"), "number").agg(F.count(F.lit(1)).alias("n"))


def roleset_counts(spark: SparkSession, path: str) -> DataFrame:
    """roleset, count: the first and the third word of each line."""
    parts = text.tokens(F.col("value"))
    return lines(spark, path).where(F.size(parts) >= 3).select(parts[0].alias("roleset"), parts[2].alias("count"))


FRAME = "_ID long, _name string, definition string, FE array<struct<_ID:long,_name:string,_coreType:string>>, frameRelation array<struct<_type:string,relatedFrame:array<string>>>, lexUnit array<struct<_ID:long,_name:string,_POS:string>>"
LEXICAL_UNIT = "_ID long, _name string, _POS string, _frame string, _frameID long, definition string"
INVENTORY = "_lemma string, sense array<struct<_n:string,_name:string,_group:string,commentary:string>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Records of XML files; a broken one has its text in ``_corrupt_record``."""
    full = f"{schema}, _corrupt_record string"
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).load(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "frame", FRAME)


def lexical_units(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "lexUnit", LEXICAL_UNIT)


def sense_inventories(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "inventory", INVENTORY)


def rolesets(spark: SparkSession, path: str) -> DataFrame:
    """lemma, roleset, name, roles of predicate files; of equal lemmas all are kept."""
    schema = "_lemma string, roleset array<struct<_id:string,_name:string,roles:struct<role:array<struct<_n:string,_descr:string>>>>>"
    rows = _xml(spark, path, "predicate", schema).cache().where("_corrupt_record is null")
    each = rows.select(F.col("_lemma").alias("lemma"), F.explode("roleset").alias("r"))
    return each.select("lemma", F.col("r._id").alias("roleset"), F.col("r._name").alias("name"), F.col("r.roles.role").alias("roles"))


def verb_frames(spark: SparkSession, path: str) -> DataFrame:
    """member, class, frame of the mapping between verb classes and frames."""
    rows = spark.read.format("xml").option("rowTag", "vncls").schema("_class string, _vnmember string, _fnframe string").load(path)
    return rows.select(F.col("_vnmember").alias("member"), F.col("_class").alias("class"), F.col("_fnframe").alias("frame"))
