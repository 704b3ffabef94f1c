"""The prefix trie, shards and resampling against plain versions and their SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import oracles, prefix_trie, queries, ranges, resampling, sharding
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, n long, depth string"


def plain_trie(rows, block=20, heads=4):
    """Every node by its prefix, with members, children, leaves and savings counted one by one."""
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            said[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in said.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = turns.get(c - int(math.fmod(c, block)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(convs), len(prefix), parent, len(convs), sum(len(p) == len(prefix) + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns(seed, convs=60, most=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-25, 140), convs):
        for t in range(rng.randrange(1, most)):
            text = rng.choice(["hello there", "a b  c", "", None, "x", f"own {c}"])
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", None, "bot"]), text, 1, "clash"))
    rows += rows[:5]
    rows += [(None, 1, "user", "lost", 1, "clash"), (7, 1, "user", "x", 1, "clash"), (8, 1, "user", "x", 1, "clash")]
    return rows


def found_trie(spark, rows):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_the_plain_one(spark, seed):
    rows = some_turns(seed)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_long_and_of_equal_conversations(spark):
    long = [(20 * (i % 3), t, "user", f"word {t % 7}", 0, "") for i in range(3) for t in range(70)]
    equal = [(1000 + i, t, "user", "the same words", 0, "") for i in range(90) for t in range(2)]
    assert found_trie(spark, long + equal) == plain_trie(long + equal)


def test_trie_of_nothing(spark):
    assert found_trie(spark, []) == [] == found_trie(spark, [(None, 1, "user", "x", 0, "")])


DOCS = "doc_id long, text string, size long, shard string"


def some_docs(seed, n=500):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma9", "é", "..."], k=rng.randrange(0, 60))), 0, "") for i in range(n)]
    rows += [(n + i, "the same text", 0, "") for i in range(n // 2)]
    rows += [(None, None, 0, ""), (None, "null id", 0, ""), (3, None, 0, ""), (3, "x", 0, ""), (3, "x", 0, ""), (4, "z" * 5000, 0, "")]
    return rows


def test_shards_are_even_gapless_and_the_same_for_any_sample(spark):
    rows = some_docs(3)
    sizes = [len((t or "").encode()) + 16 for _, t, *_ in rows]
    want = sorted(((i, s, zlib.crc32((t or "").encode())) for (i, t, *_), s in zip(rows, sizes, strict=True)), key=repr)
    even, seen = sum(sizes) / 8, set()
    for each in (16, 1):
        made = sharding.assign(spark.createDataFrame(rows, DOCS), 8, each=each).collect()
        assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in made), key=repr) == want
        loads, slots = Counter(), defaultdict(list)
        for r in made:
            loads[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(loads) == 8 and all(abs(v - even) <= even / sharding.HEAVY for v in loads.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        seen.add(repr(sorted(((r["id"], r["size"], r["shard"], r["slot"]) for r in made), key=repr)))
    assert len(seen) == 1


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    table = ranges.numbered(rows, "keys")
    share = 4000 / ranges.LEAST_RANGES
    held = ranges.ranged(table, F.struct("k", "_row"), F.col("w"), each=1).groupBy("_range").agg(F.sum("w").alias("n"), F.min("k").alias("a"), F.max("k").alias("z")).orderBy("a").collect()
    assert max(r["n"] for r in held) - 1 <= 2 * share
    assert [r["_range"] for r in held] == sorted(r["_range"] for r in held)
    assert all(x["z"] < y["a"] for x, y in zip(held, held[1:]))


def test_shards_of_nothing_and_of_large_records(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS), 8).count() == 0
    few = spark.createDataFrame([(i, "y" * (1000 * i), 0, "") for i in range(1, 6)], DOCS)
    assert sorted(r["shard"] for r in sharding.assign(few, 8).collect()) == [0, 1, 2, 3, 4]
    one = sharding.assign(few, 1).collect()
    assert sorted(r["slot"] for r in one) == [0, 1, 2, 3, 4] and {r["shard"] for r in one} == {0}


def test_shards_as_files_keep_every_text(spark, tmp_path):
    rows = some_docs(5, 100)
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, *_ in rows)
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0


def plain_draw(docs, target, seed, percent, least, longest=1, buckets=10_000):
    import re

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    scored = []
    for i, text, *_ in docs:
        found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = {id(x): k for k, x in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*x, drawn.get(id(x))) for x in scored), key=repr)


@pytest.mark.parametrize(("longest", "percent", "each"), [(1, 10, 16), (2, 37, 1), (1, 100, 16)])
def test_draw_is_the_plain_one(spark, longest, percent, each):
    docs, target = some_docs(8, 300), ["alpha beta", None, "GAMMA9 é é"]
    gain = resampling.gains(resampling.bucket_counts(spark.createDataFrame(docs, DOCS), "text", longest=longest), resampling.bucket_counts(spark.createDataFrame([(t,) for t in target], "text string"), "text", longest=longest))
    made = resampling.weights(spark.createDataFrame(docs, DOCS), gain, "text", "doc_id", longest)
    scored = ranges.numbered(made.withColumn("score", F.col("weight") + resampling.gumbel(F.col("id"), 5)), "scored")
    ranks = resampling.draw(scored, F.col("n_features") >= 20, percent, each)
    found = [tuple(r) for r in scored.join(ranks, "_row", "left").select("id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(found, key=repr) == plain_draw(docs, target, 5, percent, 20, longest)


def test_draw_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a " * 30, 0, "")], DOCS)
    assert resampling.resample(none, some, 1, 10).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none, 1, 100).collect()] == [1]
    assert [r["rank"] for r in resampling.resample(some, some, 1, 10).collect()] == [None]


def test_tournament_merges_runs_of_any_number():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(20))) for i in range(k)]
        assert list(resampling.Tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_sharding", "op13_importance_resampling"])
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    sql = {"op11_prefix_trie": oracles.OP11, "op12_sharding": oracles.OP12, "op13_importance_resampling": oracles.OP13}[name]
    made = queries.queries()[name](spark, SF)
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(made.columns)
    assert Counter(tuple(r[c] for c in names) for r in made.collect()) == Counter(rel.fetchall())
