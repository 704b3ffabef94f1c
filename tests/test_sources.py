"""Readers and grammars."""

from pyspark.sql import functions as F

from lexmill.operators import trees, verbs
from lexmill.sources import penn, propbank, rdf, sinks, tabular, wordnet
from lexmill.streaming import statements
from tests.conftest import rows_of

TURTLE = """wd:Q2309 p:P414 wds:Q2309-93C .

wds:Q2309-93C a wikibase:Statement,
\t\twikibase:BestRank ;
\twikibase:rank wikibase:NormalRank ;
\tpq:P249 "AVAZ" ;
no end
\tprov:from wdref:2d .
lonely ;
a b "c d e"@en .""".split("\n")
FILLED = [
    (1, "wd:Q2309", "p:P414", "wds:Q2309-93C", None),
    (2, None, None, None, "Blank line."),
    (3, "wds:Q2309-93C", "a", "wikibase:Statement", None),
    (4, "wds:Q2309-93C", "a", "wikibase:BestRank", None),
    (5, "wds:Q2309-93C", "wikibase:rank", "wikibase:NormalRank", None),
    (6, "wds:Q2309-93C", "pq:P249", '"AVAZ"', None),
    (7, None, None, None, "Wrong end of line."),
    (8, "wds:Q2309-93C", "prov:from", "wdref:2d", None),
    (9, None, None, None, "Missing subject or verb."),
    (10, "a", "b", '"c d e"@en', None),
]


def test_turtle_statements(spark):
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(TURTLE, 1)], "file string, line_no long, value string")
    found = rdf.turtle_statements(rows).orderBy("line_no").collect()
    assert [(r["line_no"], r["s"], r["v"], r["o"], r["error"]) for r in found] == FILLED


def test_turtle_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "file string, line_no long, value string"
    for part, (a, b) in enumerate(((0, 4), (4, 10))):
        spark.createDataFrame([("f", i + 1, TURTLE[i]) for i in range(a, b)], schema).coalesce(1).write.json(str(folder / f"{part}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(folder))
    writer = statements.stream_statements(source).writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    writer.awaitTermination(120)
    found = spark.table("filled").orderBy("line_no").collect()
    assert [(r["line_no"], r["s"], r["v"], r["o"], r["error"]) for r in found] == FILLED


def test_rdf_rows(spark):
    cases = [
        ("<id_4gx1l8_1m6>\t<wikicat_Graphics_chips> rdfs:subClassOf <wordnet_bit_109222051>", "4gx1l8_1m6", "wikicat", "rdfs", "wordnet"),
        ("<id_1> <wordnet_organization_108008335>    rdfs:subClassOf    <yagoLegalActor>", "1", "wordnet", "rdfs", "class"),
        ('<id_we31u1>\t<Burnside,_Iowa>\tskos:prefLabel\t"Burnside, Iowa"@eng', "we31u1", "title", "skos", "alias"),
        ("        <fr/Alison_Moir>        <linksTo>       <Donald_Trump>", None, "foreign_title", "verb", "title"),
        ("   <Donald_Trump,_Jr.>     owl:sameAs      <http://dbpedia.org/resource/Donald_Trump,_Jr.>", None, "title", "owl", "url"),
        ("<id_1roo> <id_83enei> <extractionSource> <http://en.wikipedia.org/wiki/x>", "1roo", "id", "verb", "url"),
        ("<id_1gucu9u> <Donald_Trump,_Jr.>     <hasGender>     <male>", "1gucu9u", "title", "verb", "noun"),
        ("rubbish", None, None, None, None),
    ]
    found = rdf.triples(spark.createDataFrame([(c[0],) for c in cases], "value string")).collect()
    kinds = [tuple(None if r[c] is None else r[c]["kind"] for c in ("subject", "verb", "object")) for r in found]
    assert [(r["id"], *k) for r, k in zip(found, kinds, strict=True)] == [c[1:] for c in cases]
    assert found[3]["subject"].asDict() == {"kind": "foreign_title", "lang": "fr", "value": "Alison_Moir"}


def test_data_lines(spark):
    lines = [
        '01427127 35 v 02 take e have 0 001 @ 01426397 v 0000 01 + 09 00 | have sex with; archaic use',
        '00014201 29 v 02 shiver 0 shudder 0 004 @ 00010054 v 0000 + 00348801 n 0202 + 00867983 n 0102 + 14340287 n 0102 02 + 01 00 + 02 00 | shake, as from cold  ',
        "  1 a comment",
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").where(~wordnet.is_comment(F.col("value")))
    one, two = wordnet.data_items(rows, verbs=True).collect()
    assert (one["offset"], one["lex_file"], [tuple(w) for w in one["words"]], [tuple(p) for p in one["ptrs"]], [tuple(f) for f in one["frames"]], one["gloss"]) == (1427127, 35, [("take", "e"), ("have", "0")], [("@", 1426397, "v", 0, 0)], [(9, 0)], "have sex with; archaic use")
    assert [tuple(p)[3:] for p in two["ptrs"]] == [(0, 0), (2, 2), (1, 2), (1, 2)]
    assert [tuple(f) for f in two["frames"]] == [(1, 0), (2, 0)] and two["gloss"] == "shake, as from cold"
    index = wordnet.index_items(spark.createDataFrame([("take v 2 1 @ 2 1 01427127 00014201",)], "value string"))
    assert rows_of(wordnet.senses(index, wordnet.data_items(rows, verbs=True).withColumnRenamed("kind", "pos")), "sense_no", "offset") == [(1, 1427127), (2, 14201)]


def test_argument_rows(spark):
    found = propbank.instances(spark.createDataFrame([("3 5 gold fine-v fine.01 ----- 5:0-rel 0:1*2:0-ARG1 6:1-ARGM-TMP 1:0-ARGA",)], "value string")).first()
    assert (found["tree_id"], found["pred_idx"], found["lemma"], found["sense"]) == (3, 5, "fine", "01")
    assert [([tuple(n) for n in a["nodes"]], a["label"]) for a in found["args"]] == [([(5, 0)], "rel"), ([(0, 1), (2, 0)], "ARG1"), ([(6, 1)], "ARGM-TMP"), ([(1, 0)], "ARG0")]


TREE = "(TOP (S (NP-SBJ-1 (PRP He)) (VP (VBD was) (VP (VBN fined) (NP (-NONE- *-1)) (NP ($ $) (CD 25,000)))) (. .)))"


def nodes_of(spark, *texts):
    return penn.trees(spark.createDataFrame(list(enumerate(texts)), "sent_id long, value string"))


def test_trees(spark):
    nodes = nodes_of(spark, TREE, "(broken", "").cache()
    assert [r["word"] for r in trees.leaves(nodes).orderBy("idx").collect()] == ["He", "was", "fined", "*-1", "$", "25,000", "."]
    assert rows_of(trees.root(nodes), "tag") == [("TOP",)]
    assert rows_of(trees.trace_targets(nodes), "idx", "link", "b", "e") == [(3, 1, 0, 1)]
    assert rows_of(trees.adjusted_leaves(nodes), "idx", "kept", "adjusted") == [(0, True, 0), (1, True, 1), (2, True, 2), (3, False, 3), (4, True, 3), (5, True, 4), (6, True, 5)]
    asked = spark.createDataFrame([(0, 5, 1)], "sent_id long, idx int, h int")
    assert rows_of(trees.climb(nodes, asked), "tag") == [("NP",)]
    path = trees.path_to_leaf(nodes, asked.select("sent_id", "idx")).orderBy("depth")
    assert [r["tag"] for r in path.collect()] == ["TOP", "S", "VP", "VP", "NP", "CD"]
    wide = spark.createDataFrame([(0, 4, 7)], "sent_id long, rb int, re int")
    assert rows_of(trees.maximal_in_range(nodes, wide), "b", "e") == [(4, 6), (6, 7)]
    vp = nodes.where("tag = 'VP'").agg(F.min("node_id").alias("node_id")).withColumn("sent_id", F.lit(0).cast("long"))
    assert rows_of(trees.leaves(trees.remove_subtree(nodes, vp)), "word") == [(".",), ("He",)]
    assert rows_of(penn.rejected(spark.createDataFrame([(1, "(broken"), (2, TREE)], "sent_id long, value string")), "sent_id") == [(1,)]


SENTENCES = [
    ("(ROOT (S (NP (PRP He)) (VP (VBD was) (VP (VBN fined) (NP ($ $) (CD 25,000)))) (. .)))", "he be fine $ 25,000 .", (2, "Past", "Simple", "Passive", [], None)),
    ("(ROOT (S (NP (PRP He)) (VP (MD will) (VP (VB be) (VP (VBN fined) (NP ($ $) (CD 25,000))))) (. .)))", "he will be fine $ 25,000 .", (3, "Present", "Simple", "Passive", ["will"], None)),
    ("(ROOT (S (NP (PRP He)) (VP (VBZ has) (VP (VBN been) (VP (VBN fined) (NP ($ $) (CD 25,000))))) (. .)))", "he have be fine $ 25,000 .", (3, "Present", "Perfect", "Passive", [], None)),
    ("(ROOT (S (NP (DT The) (NN move)) (VP (VBD had) (VP (VBN been) (VP (ADVP (RB widely)) (VBN expected)))) (. .)))", "the move have be widely expect .", (5, "Past", "Perfect", "Passive", [], None)),
    ("(ROOT (S (NP (PRP We)) (VP (VBP are) (RB not) (VP (VBG eating) (NP (NN lunch)) (ADVP (RB right) (RB now)))) (. .)))", "we be not eat lunch right now .", (3, "Present", "Progressive", "Active", [], "not")),
    ("(ROOT (S (NP (PRP We)) (VP (VBP eat) (NP (NN lunch))) (. .)))", "we eat lunch .", (1, "Present", "Simple", "Active", [], None)),
    ("(ROOT (S (NP (PRP I)) (VP (VBP have) (S (VP (TO to) (VP (VB go))))) (. .)))", "I have to go .", (3, "Present", "Simple", "Active", ["have", "to"], None)),
    ("(ROOT (S (NP (PRP I)) (VP (VBP do) (RB n't) (VP (VB know))) (. .)))", "I do n't know .", (3, "Present", "Simple", "Active", ["do"], "n't")),
]


def test_verbs(spark):
    nodes = nodes_of(spark, *[s[0] for s in SENTENCES])
    lemmas = spark.createDataFrame([(i, k, w) for i, s in enumerate(SENTENCES) for k, w in enumerate(s[1].split())], "sent_id long, idx int, lemma string")
    found = {(r["sent_id"], r["verb_idx"]): (r["tense"], r["aspect"], r["voice"], r["aux"], r["neg"]) for r in verbs.verb_properties(trees.with_lemmas(nodes, lemmas)).collect()}
    for i, (_, _, (at, *wanted)) in enumerate(SENTENCES):
        assert found[i, at] == tuple(wanted)
    assert (2, 1) not in found  # auxiliaries of a verb group are no verbs of their own


def test_tabular(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    alias = tabular.aliases(spark, file("a", "Q1\tUnited Airlines\nnonsense\nQ2\tDao\n"))
    assert sorted((r["qid"], r["name"]) for r in alias.collect()) == [(1, ["United", "Airlines"]), (2, ["Dao"])]
    assert rows_of(tabular.rejected_aliases(spark, str(tmp_path / "a")), "value") == [("nonsense",)]
    typed = tabular.typed_items(spark, {"Person": file("p", "Q2\nQ2\n"), "Organization": file("o", "Q1\n")})
    assert rows_of(typed, "qid", "cls") == [(1, "Organization"), (2, "Person")]
    assert rows_of(tabular.edges(spark, file("e", "a\tb\nx\n")), "src", "dst") == [("a", "b")]
    patterns = tabular.argument_patterns(spark, file("t", "take-v 3 Active NP-SBJ NP-1 null null null 12\n")).first()
    assert (patterns["lemma"], patterns["sense"], patterns["arg1"], patterns["arg2"], patterns["n"]) == ("take", "1.3", "NP-1", None, 12)
    roles = tabular.role_maps(spark, file("r", "1 take 1.3 Bringing arg0:Agent arg1:Theme\n"))
    assert roles.first()["roles"] == {"arg0": "Agent", "arg1": "Theme"}
    assert roles.select(sinks.role_map_line(F.col("lemma"), F.col("sense"), F.col("roles"))).first()[0] == "take\t1.3\targ0:Agent arg1:Theme"
    assert rows_of(tabular.sense_counts(spark, file("s", "f 1 2 take-v 3\nf 1 2 x take-v 3\nf 1 2 house-n 1\n")), "lemma", "number", "n") == [("take", "3", 1)]
    company = tabular.companies(spark, file("c", '[{"companyId": 1, "ticker": "A", "name": "B", "alias": ["C"], "sector": "s", "industry": "i"}]')).first()
    assert (company["ticker"], company["alias"]) == ("A", ["C"])
    frames = tabular.frames(spark, file("f.xml", '<frame ID="7" name="Motion"><definition>d</definition><FE ID="1" name="Theme" coreType="Core"/><FE ID="2" name="Path" coreType="Peripheral"/></frame>')).first()
    assert (frames["_name"], [f["_name"] for f in frames["FE"]]) == ("Motion", ["Theme", "Path"])
    rolesets = tabular.rolesets(spark, file("g.xml", '<frameset><predicate lemma="take"><roleset id="take.01" name="acquire"><roles><role n="0" descr="taker"/></roles></roleset></predicate></frameset>'))
    assert rows_of(rolesets, "lemma", "roleset", "name") == [("take", "take.01", "acquire")]
