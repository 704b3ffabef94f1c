"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import components, jaccard_join, language_id, lm_scoring, packing, piece_sampling, quality_classifier, quality_rules, substring_dedup, top_k, url_filter
from lexmill.llm.piece_lattice import Lattice, Vocabulary

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
SYLLABLES = {"en": "th on re an ble wh st ti er in".split(), "fr": "é eau ou è ch ai ier tre que pa".split()}


def prose(n, lang="en", rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


PASSAGE = prose(60)
ROWS = [
    (0, prose(80) + "\n" + PASSAGE, "en", "a"),
    (1, PASSAGE + " " + prose(40), "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, " \t\n ", "fr", None),
    (5, prose(120, "fr"), "fr", "b"),
    (6, "twice upon a time", "en", "b"),
    (7, "word " * 500, "en", "b"),
    (8, prose(3000), "en", "b"),
    (9, "x" * 20_000, None, None),
    (10, "12345 !!! ###", "en", "a"),
    (11, "café ▁ naïve space 中文 \U0001f600 don't. 'S", "fr", "a"),
]
ROWS += [(12, ROWS[5][1], "fr", "b"), (13, ROWS[0][1].replace("\n", " extra ", 1), "en", "a"), (13, ROWS[0][1].replace("\n", " extra ", 1), "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit(7).alias(c) for c in ("score", "kept", "n_words", "label", "rank", "host", "word", "links")]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *clash).repartition(3).cache()


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_id(spark, docs):
    trees = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, trees, keep=["doc_id"]).collect()}
    assert {i: found[i]["lang_pred"] for i in (0, 5, 2, 3, 4, 10)} == {0: "en", 5: "fr", 2: "und", 3: "und", 4: "und", 10: "und"}
    assert found[2]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify(none(spark), trees).collect() == []
    nothing = language_id.train_and_identify(docs, F.lit(False), keep=["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(ROWS)
    assert language_id.keep_documents(docs).columns == docs.columns


def test_code_lengths_are_those_of_plain_ppm():
    samples = [w.encode() for w in prose(200).split()]
    trees = language_id.ContextTrees(samples, np.zeros(len(samples), np.int64), np.ones(len(samples)), ["en"], order=3)
    counts: dict[bytes, Counter] = {}
    for w in samples:
        stream = b" " + w + b" "
        for i in range(1, len(stream)):
            for k in range(min(3, i) + 1):
                counts.setdefault(stream[i - k : i], Counter())[stream[i]] += 1

    def bits(word):
        total, stream = 0.0, b" " + word + b" "
        for i in range(1, len(stream)):
            banned: set = set()
            for k in range(min(3, i), -1, -1):
                seen = counts.get(stream[i - k : i])
                if not seen:
                    continue
                free = {s: n for s, n in seen.items() if s not in banned}
                whole = sum(free.values()) + len(free)
                if stream[i] in free:
                    total -= math.log2(free[stream[i]] / whole)
                    break
                if free:
                    total -= math.log2(len(free) / whole)
                banned |= set(free)
            else:
                total += math.log2(256 - len(banned))
        return total

    asked = [*samples[:20], b"thzzon", b"q", b"eau\xc3\xa9", b"on" * 30]
    assert np.allclose(trees.bits(asked)[:, 0], [bits(w) for w in asked])


def test_packing(spark, docs):
    found = packing.pack_documents(docs, WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    wanted = []
    for i, text, _, _ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted += [(i, n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(r[:5] for r in found) == sorted(wanted)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(w[3] for w in wanted) // 4096)
    assert packing.pack_documents(none(spark), WORD_BPE).collect() == []


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 4, 3, 3, 3, 3, 2, 2])
    bins = packing.local_search(lengths, [[0], [1], [2], [3, 4], [5, 6], [7, 8]], 10)
    assert sorted(i for b in bins for i in b) == list(range(9))
    assert max(lengths[b].sum() for b in bins) <= 10 and len(bins) == 3
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(1, 60, 80)
        start = packing.best_fit(sizes, 100)
        done = packing.local_search(sizes, start, 100)
        assert sorted(i for b in done for i in b) == list(range(80)) and len(done) <= len(start)
        assert max(sizes[b].sum() for b in done) <= 100


def test_lattice_sums_all_segmentations():
    vocabulary = Vocabulary.load(PIECES)
    lattice = Lattice(vocabulary)
    weight = dict(zip(vocabulary.pieces[-256:], vocabulary.logs[-256:], strict=True)) | dict(zip(vocabulary.pieces[:-256], vocabulary.logs[:-256], strict=True))

    def brute(w):
        if not w:
            return 1.0
        return sum(math.exp(weight[w[:i]]) * brute(w[i:]) for i in range(1, len(w) + 1) if w[:i] in weight)

    asked = [b" the", b" thonre", b"a", b" caf\xc3\xa9s", b"\xff\xfe"]
    assert np.allclose(np.exp(lattice.marginals(asked)), [brute(w) for w in asked])
    use = lattice.expected(asked, np.ones(len(asked)))
    assert math.isclose(sum(len(vocabulary.pieces[i]) * u for i, u in enumerate(use)), sum(map(len, asked)), rel_tol=1e-9)


def test_lm_scores(spark, docs):
    learn = F.col("doc_id") % 5 != 1
    found = lm_scoring.train_and_score(docs, PIECES, learn, ["doc_id"]).collect()
    split = [(i, (t or "").encode().lower().split()) for i, t, _, _ in ROWS]
    counts = Counter(w for i, ws in split if i % 5 != 1 for w in ws)
    ends = sum(i % 5 != 1 for i, _ in split)
    tokens, distinct = sum(counts.values()) + ends, len(counts) + 1
    whole = tokens + 0.5 * (distinct + 1)
    wanted = sorted((i, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, tokens, round(sum(math.log10((counts[w] + 0.5) / whole) for w in ws) + math.log10((ends + 0.5) / whole), 6)) for i, ws in split)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
    model = lm_scoring.train(docs.where(learn), PIECES)
    lattice = Lattice(Vocabulary.load(PIECES))
    score = {r["doc_id"]: r["score"] for r in found}
    for i, ws in split:
        paths = np.exp(lattice.marginals([b" " + w for w in ws], model.logs)) if ws else np.zeros(0)
        exact = sum(math.log10(x) for x in (np.array([counts[w] for w in ws]) + model.path_weight * paths) / model.whole if x > 0)
        if i != 9:
            assert math.isclose(score[i], exact + math.log10(model.end_share), rel_tol=1e-9)
    assert math.isfinite(score[9])
    assert lm_scoring.train_and_score(none(spark), PIECES, learn, ["doc_id"]).collect() == []


def test_quality_classifier(spark):
    rng = random.Random(3)
    good = [(i, prose(60, rng=rng), 1) for i in range(0, 400, 2)]
    bad = [(i, " ".join(rng.choice(["SPAM!!", "$$$", "win***"]) for _ in range(60)), 0) for i in range(1, 400, 2)]
    table = spark.createDataFrame(good + bad + [(900, None, 1), (901, "", 0)], "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(0, 1), (5000, 0), (3, None)], "doc_id long, quality int"))
    found = quality_classifier.train_and_score(table.drop("quality"), labels, F.col("doc_id") % 3 != 1, ["doc_id"]).collect()
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in found if r["doc_id"] % 3 == 1 and r["doc_id"] in truth]
    assert len(found) == 402 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    one = quality_classifier.train_and_score(table.drop("quality"), labels.where("quality = 1"), F.lit(True), ["doc_id"]).collect()
    assert {r["predicted"] for r in one} == {1}
    assert quality_classifier.train_and_score(none(spark), labels, F.lit(True), ["doc_id"]).collect() == []


def test_sampled_pieces(spark, docs):
    encoded = piece_sampling.encode(docs, PIECES).cache()
    texts = sorted((r["doc_id"], r["text"]) for r in piece_sampling.decode(encoded, PIECES).collect())
    assert texts == sorted((i, t or "") for i, t, _, _ in ROWS)
    again = piece_sampling.encode(docs.repartition(1), PIECES)
    key = lambda df: sorted((r["doc_id"], r["ids"]) for r in df.collect())
    assert key(again) == key(encoded)
    assert key(piece_sampling.encode(docs, PIECES, seed=1)) != key(encoded)
    assert all(r["lossless"] for r in piece_sampling.encode(docs, PIECES, digest=True).collect())
    assert piece_sampling.encode(none(spark), PIECES).collect() == []


def test_samples_follow_the_lattice():
    sampler = piece_sampling.Sampler(PIECES, sharpness=0.5)
    n = 20_000
    counts = Counter(tuple(ids.tolist()) for ids in sampler.encode([str(i) for i in range(n)], [b"thonre"] * n))
    weight = dict(zip(sampler.vocabulary.ids.tolist(), sampler.logs, strict=True))
    whole = sampler.lattice.marginals([b" thonre"], sampler.logs)[0]
    assert len(counts) > 3
    for ids, times in counts.items():
        chance = math.exp(sum(weight[i] for i in ids) - whole)
        assert abs(times / n - chance) < 5 * math.sqrt(chance / n) + 2e-4


def dedup_brute(rows, window):
    """(id, words, removal flags) with repeats judged by (id, start); equal rows are one document."""
    seen: dict = {}
    for i, text in sorted(set(rows)):
        w = words(text)
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, text or "", s))
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if (i, text or "", s) != min(seen[tuple(w[s : s + window])]):
                gone[s : s + window] = [True] * window
        yield i, w, gone


def test_substring_dedup(spark, docs):
    rows = [(i, t) for i, t, _, _ in ROWS]
    wanted = sorted((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in dedup_brute(rows, 20))
    assert sorted(tuple(r) for r in substring_dedup.digest(docs).collect()) == wanted
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] == ROWS[0][1] and texts[2] is None and texts[12] == "" and PASSAGE not in texts[1]
    assert substring_dedup.digest(none(spark)).collect() == []


def test_substring_dedup_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 40)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = sorted((i, len(w), sum(g)) for i, w, g in dedup_brute(rows, 6))
    assert sorted(tuple(r)[:3] for r in substring_dedup.digest(table, window=6).collect()) == wanted


URLS = ["http://a.org/x", "https://www.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://b.example.com/fr/1", "http://c.com/de/9?x=1", None, "", "no scheme", "http://d.net/en/1?a=1&b=2#t", "http://org", "http://xorg/", "ftp://e.com/", "http://a.org/x"]


def test_url_filter(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("verdict", F.lit("old"))
    found = {r["page_id"]: r for r in url_filter.judge(table).collect()}
    assert len(found) == len(URLS)
    rules = [found[i]["rule"] for i in range(len(URLS))]
    assert rules == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, None, "org/"]
    assert (found[1]["host"], found[1]["path"]) == ("www.example.org", "/es/1") and (found[8]["host"], found[8]["path"]) == ("", "")
    assert [found[i]["verdict"] for i in (0, 1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert all(r["verdict"] in ("allow", "block") for r in found.values())
    assert url_filter.judge(table.where("page_id in (6, 9)")).count() == 2
    assert url_filter.judge(table.where("page_id < 0")).collect() == []


def test_boosted_trees_learn_and_their_column_agrees(spark):
    rows = [(i, f"http://s{i}.example.org/{'es' if i % 2 else 'fr'}/{i}" + "?a=1&b=2&c=3" * (i % 2)) for i in range(400)] + [(1000 + i, f"http://s{i}.example.net/fr/{i}" + "?a=1&b=2&c=3" * (i % 2)) for i in range(50)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    assert len(found) == 50 and all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in found)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(400)]
    vectors += [(400, None), (401, [1.0] * 23 + [None]), (402, [float("nan")] * 24), (403, [float("inf")] + [0.0] * 23), (404, [1.0, 2.0]), (500, vectors[3][1]), (501, vectors[3][1]), (100, vectors[100][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    valid = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in vectors if v is not None and len(v) == 24 and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, own in {i: v for i, v in valid if i % 100 == 0}.items():
        ranked = sorted((-int(own @ v), i) for i, v in valid if i != q)[:10]
        wanted += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in top_k.search(table, F.col("vec_id") % 100 == 0).collect()) == sorted(wanted)
    assert sorted(tuple(r) for r in top_k.search(table, F.col("vec_id") % 100 == 0, block=2).collect()) == sorted(wanted)
    assert top_k.search(table.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert top_k.search(table.where("vec_id < 0"), F.lit(True)).collect() == []


def jaccard_brute(rows):
    def grams(text):
        w = words(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = Counter()
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and sets[a][1] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])]
    for a, _ in pairs:
        links[a] += 1
    for _ in sets:
        for a, b in pairs:
            label[sets[a][0]] = label[sets[b][0]] = min(label[sets[a][0]], label[sets[b][0]])
    return sorted((i, label[i], links[n]) for n, (i, _) in enumerate(sets))


def test_jaccard_join(spark, docs):
    assert sorted(tuple(r) for r in jaccard_join.link(docs).collect()) == jaccard_brute([(i, t) for i, t, _, _ in ROWS])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert jaccard_join.link(none(spark)).collect() == []


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Near copies of one text in groups of many blocks."""
    monkeypatch.setattr(jaccard_join, "NODE_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 8)
    rng = random.Random(4)
    base = prose(150, rng=rng).split()
    rows = []
    for i in range(70):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, prose(50, rng=rng)) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard_join.link(table).collect()) == jaccard_brute(rows)


def test_prefixes_are_as_long_as_recall_allows():
    depth = jaccard_join.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** jaccard_join.TREES >= jaccard_join.RECALL
    assert depth == jaccard_join.DEEPEST or 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES < jaccard_join.RECALL


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 45), (60, 60)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {40: 40, 45: 40, 50: 40}


def test_digests_of_edges_do_not_overflow(spark):
    one_sided = spark.range(10_000).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b")).where(F.xxhash64("a", "b") > 2**62)
    assert components._digest(one_sided)[0] > 2000
    assert components.components(one_sided).where("label <> 0").isEmpty()


def base_statistics(text):
    w = words(text)
    places: dict = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for own in places.values() if len(own) > 1 for i in own for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark, docs):
    found = quality_rules.judge(docs, keep=["doc_id"]).collect()
    assert sorted(tuple(r)[:7] for r in found) == sorted((i, *base_statistics(t)) for i, t, _, _ in ROWS)
    assert all(not r["kept"] for r in found if r["base_failed"])
    assert quality_rules.keep_documents(docs).columns == docs.columns
    assert quality_rules.judge(none(spark)).collect() == []


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    clean = [(i, "\n".join(prose(12, rng=rng) for _ in range(rng.randint(3, 9))), "en", f"s{i % 2}") for i in range(400)]
    junk = [(1000 + i, " ".join(f"{w}$$%%&&" for w in prose(60, rng=rng).split()), "en", "s0") for i in range(20)]
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(found[i] for i, *_ in clean) and not any(found[i] for i, *_ in junk)
