"""RDF rows and Turtle statements, taken apart by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of objects, in the order in which they are tried, with (language or type, value) groups.
NOUNS: tuple[tuple[str, str, int, int], ...] = (
    ("wordnet", r"^<wordnet_([^>]+)>$", 0, 1),
    ("wikicat", r"^<wikicat_([^>]+)>$", 0, 1),
    ("owl", r"^owl:([^\s]+)$", 0, 1),
    ("class", r"^<yago([^>]+)>$", 0, 1),
    ("alias", r'^"([^"]+)"@eng$', 0, 1),
    ("title", r"^<([^\p{Ll}>][^>]+)>$", 0, 1),
    ("foreign_alias", r'^"([^"]+)"@([^\s]+)$', 2, 1),
    ("typed", r'^"([^"]+)"\^\^([^\s]+)$', 2, 1),
    ("text", r'^"([^"]+)"$', 0, 1),
    ("url", r"^<(http[^>]+)>$", 0, 1),
    ("id", r"^<id_([^>]+)>$", 0, 1),
    ("foreign_title", r"^<([^/>]+)/([^>]+)>$", 1, 2),
    ("noun", r"^<([^>]+)>$", 0, 1),
)
VERBS = (
    ("rdf", r"^rdf:([^\s]+)$", 0, 1),
    ("rdfs", r"^rdfs:([^\s]+)$", 0, 1),
    ("skos", r"^skos:([^\s]+)$", 0, 1),
    ("verb", r"^<([^>]+)>$", 0, 1),
    ("owl", r"^owl:([^\s]+)$", 0, 1),
)
TURTLE = (
    ("alias", r'^"([^"]+)"@en$', 0, 1),
    ("foreign_alias", r'^"([^"]+)"@([^\s]+)$', 2, 1),
    ("typed", r'^"([^"]+)"\^\^([^\s]+)$', 2, 1),
    ("text", r'^"([^"]+)"$', 0, 1),
    ("url", r"^<([^>]+)>$", 0, 1),
    ("name", r"^([^\s:]+):([^\s]+)$", 1, 2),
    ("unknown", r"^([^\s]+)$", 0, 1),
)
TOKEN = r'"[^"]+"(?:@[^\s]+|\^\^[^\s]+)?|<[^>]+>|[^\s<">]+'


def classified(token: Column, kinds: tuple[tuple[str, str, int, int], ...]) -> Column:
    """kind, lang, value of a token by the first kind that fits; null if none does."""
    out = F.lit(None).cast("struct<kind:string,lang:string,value:string>")
    for kind, form, lang, value in reversed(kinds):
        language = F.regexp_extract(token, form, lang) if lang else F.lit(None).cast("string")
        out = F.when(token.rlike(form), F.struct(F.lit(kind).alias("kind"), language.alias("lang"), F.regexp_extract(token, form, value).alias("value"))).otherwise(out)
    return out


def triples(rows: DataFrame, value: str = "value") -> DataFrame:
    """id, subject, verb, object of rows of three or four tokens (the first of four is an id); others have nulls."""
    tokens = rows.withColumn("__t", F.regexp_extract_all(F.col(value), F.lit(TOKEN), F.lit(0)))
    four = (F.size("__t") == 4) & F.get("__t", 0).rlike("^<id_[^>]+>$")
    three = F.size("__t") == 3
    first = F.when(four, 1).when(three, 0)
    # each token is classified inside of a lambda, which is not copied into whatever uses its kind and value
    nouns = F.transform(F.array(F.get("__t", first), F.get("__t", first + 2)), lambda t: classified(t, NOUNS))
    verbs = F.transform(F.array(F.get("__t", first + 1)), lambda t: classified(t, VERBS))
    found = tokens.select(*rows.columns, F.when(four, F.regexp_extract(F.get("__t", 0), "^<id_([^>]+)>$", 1)).alias("id"), nouns.alias("__n"), verbs.alias("__v"))
    whole = ~F.exists("__n", lambda t: t.isNull()) & F.get("__v", 0).isNotNull()
    parts = {"id": F.col("id"), "subject": F.get("__n", 0), "verb": F.get("__v", 0), "object": F.get("__n", 1)}
    return found.select(*rows.columns, *[F.when(whole, c).alias(n) for n, c in parts.items()])


def links_between(found: DataFrame, subject: str, object_: str, verb: str | None = None) -> DataFrame:
    """s, o of triples with these kinds of subject and object, and this verb, if one is named."""
    rows = found.where((F.col("subject.kind") == subject) & (F.col("object.kind") == object_))
    rows = rows if verb is None else rows.where(F.col("verb.value") == verb)
    return rows.select(F.col("subject.value").alias("s"), F.col("object.value").alias("o"))


#: The kinds of subject, object and verb, and the verb, of each view; null is any.
VIEWS = {
    "typedCat": ("wikicat", "wordnet", None, None),
    "interlink": ("title", "title", None, None),
    "synset": ("title", "wordnet", None, None),
    "taxonomy": ("wordnet", "wordnet", "rdfs", "subClassOf"),
}


def view(found: DataFrame, name: str) -> DataFrame:
    """s, o of a named selection of triples. Raises ValueError for an unknown name."""
    if name not in VIEWS:
        raise ValueError(f"unknown view: {name}")
    return views(found, [name]).drop("name")


def views(found: DataFrame, names: list[str] | None = None) -> DataFrame:
    """name, s, o: several views (all, if none are named) in one pass over the triples."""
    fits = []
    for name in names or VIEWS:
        subject, object_, kind, verb = VIEWS[name]
        own = (F.col("subject.kind") == subject) & (F.col("object.kind") == object_)
        fits.append(F.when(own if kind is None else own & (F.col("verb.kind") == kind) & (F.col("verb.value") == verb), F.lit(name)))
    each = found.select(F.explode(F.array_compact(F.array(*fits))).alias("name"), "subject", "object")
    return each.select("name", F.col("subject.value").alias("s"), F.col("object.value").alias("o"))


def turtle_lines(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds terms (tokens before the end), ending (Comma, Semicolon, End) and error (``Blank line.``, ``Wrong end of line.``)."""
    stripped = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    last = F.substring(stripped, -1, 1)
    ending = F.when(last == ",", "Comma").when(last == ";", "Semicolon").when(last == ".", "End")
    error = F.when(stripped == "", "Blank line.").when(ending.isNull(), "Wrong end of line.")
    body = F.substring(stripped, 1, F.length(stripped) - 1)
    terms = F.slice(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), 1, 3)
    return rows.withColumns({"ending": ending, "error": error, "terms": F.when(error.isNull(), terms)})


def turtle_statements(rows: DataFrame, file: str = "file", line: str = "line_no", value: str = "value") -> DataFrame:
    """file, line, s, v, o, error: every line with the subject and verb that it leaves out.

    A line of three terms must follow an end, one of two a semicolon, one of one
    a comma; else it is an error, and the next line starts anew. Lines that don't
    parse leave the state as it is. After a line that ends a statement the state is
    always the same, so statements are independent; each is one fold.
    """
    from pyspark.sql import Window

    parsed = turtle_lines(rows, value)
    before = Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.sum(F.when(F.col("ending") == "End", 1).otherwise(0)).over(before), F.lit(0))
    lists = parsed.withColumn("__block", block).groupBy(file, "__block").agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("n"), "terms", "ending", "error"))).alias("lines"))
    row = "struct<n:bigint,s:string,v:string,o:string,error:string>"
    text = F.lit(None).cast("string")
    start = F.struct(F.lit("End").alias("mode"), text.alias("s"), text.alias("v"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = F.size(x["terms"])
        fits = ((acc["mode"] == "End") & (size == 3)) | ((acc["mode"] == "Semicolon") & (size == 2)) | ((acc["mode"] == "Comma") & (size == 1))
        s = F.when(size == 3, F.get(x["terms"], 0)).otherwise(acc["s"])
        v = F.when(size == 1, acc["v"]).otherwise(F.get(x["terms"], size - 2))
        o = F.get(x["terms"], size - 1)
        bad = x["error"].isNotNull()
        line_error = F.when(bad, x["error"]).when(~fits, "Missing subject or verb.")
        fine = ~bad & fits
        result = F.struct(x["n"].cast("bigint").alias("n"), F.when(fine, s).alias("s"), F.when(fine, v).alias("v"), F.when(fine, o).alias("o"), line_error.alias("error"))
        return F.struct(
            F.when(bad, acc["mode"]).when(fits, x["ending"]).otherwise("End").alias("mode"),
            F.when(bad, acc["s"]).when(fits, s).alias("s"),
            F.when(bad, acc["v"]).when(fits, v).alias("v"),
            F.concat(acc["out"], F.array(result)).alias("out"),
        )

    folded = lists.select(file, F.explode(F.aggregate("lines", start, step, lambda a: a["out"])).alias("r"))
    return folded.select(file, F.col("r.n").alias(line), "r.s", "r.v", "r.o", "r.error")
