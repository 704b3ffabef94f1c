"""Operators against plain versions of themselves, and measured recall."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import jaccard_join, language_id, packing, quality_classifier, quality_rules, substring_dedup, url_filter
from lexmill.llm.common import Finder, text_slices
from tests.conftest import rows_of
from tests.llm.test_operators import SCHEMA, none, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_finder():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    keys = np.unique(np.append(keys, np.uint64(0)))
    finder = Finder(keys)
    assert (finder.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(np.arange(1, 5000, dtype=np.uint64), keys)
    assert (finder.find(others) == -1).all()
    assert (Finder(keys[:0]).find(others) == -1).all()


def test_text_slices_hold_all_rows():
    import pyarrow as pa

    texts = [None, "", "a" * 50, "é", None] * 300
    found = list(text_slices(pa.array(texts), 200))
    assert [t for _, _, part in found for t in part] == [(t or "").encode() for t in texts]
    assert [a for a, _, _ in found] == [0, *[b for _, b, _ in found[:-1]]] and found[-1][1] == len(texts)
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_merges_are_the_tokenizers():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzßàâäçèéêëîïñóôöùûüÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 48))) for _ in range(2000)] + prose(500).split() + ["a" * n for n in range(1, 48)]
    words = [w for w in words if (found := packing.WordMerges.WORD.fullmatch(w.encode())) and not found.group(2)]
    counts, ids = packing.WordMerges(WORD_BPE).encode([w.encode() for w in words])
    wanted = [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch_fast(words, add_special_tokens=False)]
    assert [len(w) for w in wanted] == counts.tolist() and list(itertools.chain.from_iterable(wanted)) == ids.tolist()


def test_texts_have_the_tokenizers_ids():
    texts = ["It's l'été, don't! (yes)... a1b2 x_y", "ÉCOLE Straße ÷ × ÿ ﬁ", "<|endoftext|> <|startoftext|>x", "a" * 3000, "%%% &&& été*** fin.", "", "é ño 中文字 \U0001f600"]
    own = packing.ChunkTokens(WORD_BPE).encode([t.encode() for t in texts * 2])
    wanted = [Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids for t in texts * 2]
    assert [x.tolist() for x in own] == wanted


def brute_bins(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_packing_of_small_cases_is_near_the_optimum():
    least = got = 0
    for seed in range(40):
        lengths = np.random.default_rng(seed).integers(2, 12, 9)
        own = packing.local_search(lengths, packing.best_fit(lengths, 20), 20)
        best = brute_bins(sorted(lengths.tolist(), reverse=True), 20)
        assert best <= len(own) <= best + 1
        least, got = least + best, got + len(own)
    assert got <= least + 2


def test_a_pair_far_down_a_bin_is_found():
    """Of 42 short documents only 7 and 9 together fit the one place that is left, for 15."""
    lengths = np.array([*[3] * 40, 7, 9, 184, 15])
    assert packing._exchange(lengths, [*range(42)], [[42, 43]], np.array([1])) == (0, [40, 41], 43)
    assert packing._exchange(lengths, [*range(41)], [[42, 43]], np.array([1])) is None


def test_packing_in_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(None if n % 50 == 0 else n // 3, 0, 0, int(rng.integers(1, 900)), n) for n in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    found = packing.pack(table, 1000, 100).collect()
    assert sorted(r["ids_crc32"] for r in found) == list(range(600))
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1000
    assert len(bins) <= 1.03 * sum(r[3] for r in rows) / 1000 + 1


def test_walk_connects_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    size = jaccard_join.TREES * jaccard_join.DEEPEST
    centres = rng.integers(0, 1 << 16, (6, size)).astype("<u2")
    sigs = centres[rng.integers(0, 6, 60)]
    sigs = np.where(rng.random(sigs.shape) < 0.15, rng.integers(0, 1 << 16, sigs.shape), sigs).astype("<u2")
    for own in (np.full(60, -1), rng.integers(0, 2, 60)):
        edges = jaccard_join.walk(sigs[:, : jaccard_join.DEEPEST], sigs, own, 0, 90)
        near = (sigs[:, None] == sigs[None]).sum(axis=2) >= 90
        near &= (own[:, None] < 0) | (own[:, None] != own[None])
        assert all(near[a, b] for a, b in edges)
        assert components_of(60, edges) == components_of(60, np.argwhere(near).tolist())


def components_of(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs with a similarity of 0.80 to 0.85."""
    rng = random.Random(9)
    rows, wanted = [], []
    while len(wanted) < 60:
        base = prose(120, rng=rng).split()
        other = list(base)
        for at in rng.sample(range(10, 110), rng.randint(1, 4)):
            other[at] = f"other{rng.randrange(10**6)}"
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85:
            wanted.append(2 * len(wanted))
            rows += [(wanted[-1], " ".join(base)), (wanted[-1] + 1, " ".join(other))]
    rows += [(None, rows[0][1]), (None, None)]
    found = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    label = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found}
    assert len(found) == len(rows) and label[None] == (None, 0)
    assert sum(label[i + 1] == (i, 1) for i in wanted) >= 0.99 * len(wanted)


def _mcd_brute(x, floors):
    """Least determinant over many random starts."""
    rng, best, h = np.random.default_rng(0), math.inf, math.ceil(0.75 * len(x))
    for _ in range(200):
        own = rng.choice(len(x), 8, replace=False)
        last = math.inf
        while True:
            scatter = quality_rules.CONSISTENCY * np.cov(x[own].T, bias=True) + np.diag(np.square(floors))
            value = np.linalg.slogdet(scatter)[1]
            if value >= last - 1e-9 and len(own) > 8:
                break
            last = value if len(own) > 8 else math.inf
            rest = x - x[own].mean(axis=0)
            own = np.argsort((rest @ np.linalg.inv(scatter) * rest).sum(axis=1), kind="stable")[:h]
        best = min(best, last)
    return best


def test_least_determinant(spark):
    rng = np.random.default_rng(2)
    clean = rng.multivariate_normal([5000, 1700, 0, 0, 0, 300], np.diag([700, 150, 100, 200, 200, 90]) ** 2, 240)
    wrong = rng.multivariate_normal([9000, 3000, 800, 900, 900, 900], np.diag([90] * 6) ** 2, 60)
    x = np.round(np.concatenate([clean, wrong])).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x] + [("h", *map(int, r)) for r in clean], ["__group", *quality_rules.VECTOR]).repartition(3)
    for few in (True, False):
        fits = {r["__group"]: r for r in quality_rules.estimates(rows, few).collect()}
        best = _mcd_brute(x.astype(float), quality_rules.FLOORS)
        assert fits["g"]["logdet"] <= best + 0.05
        assert fits["g"]["__n"] == 300 and fits["h"]["__n"] == 240
    d2 = quality_rules._distance(rows.join(F.broadcast(quality_rules.estimates(rows)), "__group")).where("__group = 'g'")
    scaled = [r["__d2"] * quality_rules.MEDIAN / max(r["__middle"], quality_rules.MEDIAN / 4) for r in d2.orderBy(F.col("x_length")).collect()]
    assert sum(v > quality_rules.CUTOFF for v in scaled) >= 55 and sum(v > quality_rules.CUTOFF for v in scaled[:200]) == 0


def test_repeat_words_in_columns(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(100, None)]
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = (text or "").split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        assert found[i] == len(covered)


def test_predicted_language_is_that_of_the_shortest_code(spark):
    rng = random.Random(6)
    rows = [(i, prose(30, lang, rng), lang, None) for i, lang in enumerate(["en", "fr"] * 20)]
    rows += [(100, "zz zz", None, None), (101, "Word " * 30_000, None, None), (102, "THE ÉCOLE İ", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    trees = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, trees, keep=["doc_id"]).collect()}
    for i, text, _, _ in rows:
        bits = trees.bits([w.lower().encode() for w in text.split()]).sum(axis=0)
        assert found[i]["lang_pred"] == trees.langs[int(np.argmin(bits))]
        assert math.isclose(found[i]["score"], 1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum(), rel_tol=1e-6)
    # A tie goes to the first name; a memory of code lengths that is too small changes nothing.
    assert language_id.identify(spark.createDataFrame([(1, "q", None, None)], SCHEMA), language_id.ContextTrees([], np.zeros(0, np.int64), np.zeros(0), ["b", "c"])).first()["lang_pred"] == "b"
    words = sorted({w.lower().encode() for _, t, _, _ in rows for w in t.split()})
    whole = trees.bits(words)
    small = language_id._Memo(2)
    small.room = lambda n: False
    trees.memo = small
    assert np.array_equal(trees.bits(words), whole)


def test_classifier_by_hand(spark):
    rng = random.Random(2)
    bad = [" ".join(f"{w}$$$" for w in prose(30, rng=rng).split()) for _ in range(60)]
    good = [prose(30, rng=rng) for _ in range(60)]
    rows = [(i, t, 7, 7) for i, t in enumerate([*bad, *good])] + [(200, None, 7, 7), (201, "", 7, 7), (202, "long " * 30_000, 7, 7), (0, bad[0], 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted int").repartition(2)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    found = quality_classifier.score(docs, model, ["doc_id"]).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, _, _ in rows if i == r["doc_id"])
        words = (text or "").encode().split()
        features = np.zeros(quality_classifier.FEATURES)
        if words:
            mean = model.vectors(words).astype(float).mean(axis=0)
            parts = np.split(mean, 2)
            features = np.array([*mean, *[math.log(1e-4 + (p**2).sum()) for p in parts], math.log1p(len(words))])
        hidden = np.tanh(((features - model.mean) / model.scale) @ model.first + model.first_bias)
        wanted = 1 / (1 + math.exp(-np.clip((hidden @ model.second + model.second_bias) / model.temperature, -500, 500)))
        assert math.isclose(r["score"], wanted, rel_tol=1e-3, abs_tol=1e-6) and r["predicted"] == (r["score"] >= 0.5)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] >= 60) for r in found if r["doc_id"] < 120]) > 0.9
    assert quality_classifier.forms([b"Abc", b"ABC!", b"a1$$", b"...", b"A"]).tolist() == [form_by_hand(w) for w in ("Abc", "ABC!", "a1$$", "...", "A")]


def form_by_hand(word):
    letters = word.strip(".,;:!?\"'()")
    kind = 2 if len(letters) > 1 and letters.isupper() else 1 if letters[:1].isupper() else 0
    symbols = min(sum(c in "#*$%&|<>{}[]=_~^\\/@" for c in word), 4)
    return (((kind * 2 + any(c.isdigit() for c in word)) * 2 + (word[-1] in "!?")) * 5 + symbols) * 7 + min(len(word) // 4, 6)


def test_trees_as_columns_are_the_trees(spark):
    rng = random.Random(4)
    urls = [f"http://{rng.choice(['www.', ''])}{rng.choice(['good', 'evil-site-123', 'x'])}.{rng.choice(['com', 'net', 'org'])}/{'a/' * rng.randint(0, 5)}{rng.randint(0, 10**rng.randint(1, 8))}?{'&'.join(['p=1'] * rng.randint(0, 4))}" for _ in range(300)] + ["", "http://h/" + "x" * 50_000]
    rows = spark.createDataFrame([(i, u, "block" if "evil" in u else "allow") for i, u in enumerate(urls)], "page_id long, __url string, __verdict string")
    rows = rows.withColumns({"__host": url_filter.host_of(F.col("__url")), "__path": url_filter.path_of(F.col("__url"))})
    rows = rows.withColumns(url_filter._features(F.col("__url"), F.col("__host"), F.col("__path")))
    model = url_filter.fit(rows)
    scored = model.with_rates(rows).withColumn("s", model.score()).collect()
    for r in scored:
        bins = {n: sum(e < r[n] for e in edges) for n, edges in url_filter.BINS.items()}
        assert math.isclose(r["s"], 1 / (1 + math.exp(-(model.prior + sum(t.of(bins) for t in model.trees)))), rel_tol=1e-9)
    assert np.mean([(r["s"] >= 0.5) == (r["__verdict"] == "block") for r in scored]) > 0.95


def test_second_hash_of_windows(spark, monkeypatch):
    """With a first hash that says nothing, the second still tells windows apart."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(30))) for i in range(12)] + [(None, "x " * 25), (None, "x " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = rows_of(substring_dedup.digest(docs).where("doc_id is not null"), "doc_id", "n_words", "n_removed", "kept_sha256")
    monkeypatch.setattr(substring_dedup, "hash_bytes", lambda n, bits: (8, 8))
    whole = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, c, w, base=substring_dedup._BASE: whole(h, c, w, base) if base != substring_dedup._BASE else (np.zeros(len(whole(h, c, w)[0]), np.uint64), *whole(h, c, w)[1:]))
    found = substring_dedup.repeated_windows(docs)
    assert found.count() > 0
    monkeypatch.undo()
    assert rows_of(substring_dedup.digest(docs).where("doc_id is not null"), "doc_id", "n_words", "n_removed", "kept_sha256") == plain
    assert substring_dedup.digest(none(spark)).count() == 0
