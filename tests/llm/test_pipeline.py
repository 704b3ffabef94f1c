"""The pipeline keeps what it should and ends in packed sequences."""

import random

import corpus_pipeline
from lexmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_planted_documents(spark, tmp_path):
    rng = random.Random(2)
    syllables = "th on re an ble wh st ti er in".split()
    text = lambda n: "\n".join(" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(12)) for _ in range(n))
    passage = text(6)
    rows = [(i, text(rng.randint(4, 12)), "en", "s") for i in range(150)]
    rows += [(200, rows[0][1], "en", "s"), (201, rows[1][1] + " more", "en", "s"), (202, text(12) + "\n" + passage, "en", "s"), (203, passage + "\n" + text(12), "en", "s"), (204, "$$$ ### " * 40, "en", "s"), (205, None, "en", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == set(range(150)) | {202, 203}
    tokens = {i: sum(r["length"] for r in found if r["doc_id"] == i) for i in (202, 203)}
    assert tokens[203] < tokens[202]


def test_every_contract_has_its_columns(spark):
    first = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op3_lattice_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op8_exact_top_k": ["query_id", "rank", "vec_id", "score"],
        "op9_ngram_jaccard_join": ["doc_id", "class_id", "n_links"],
        "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, columns in first.items():
        assert set(columns) <= set(queries.queries()[name](spark, SF).columns), name
