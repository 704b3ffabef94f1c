"""Dependency trees by list ranking, walks from many starts, choices by shared neighbours, files side by side."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import render
from lexmill.operators import dependencies, graph, trees
from lexmill.sources import articles


def plain_trees(edges):
    """Nodes below each root in pre-order, without recursion."""
    best = {}
    for tree, parent, child, label in edges:
        best[tree, child] = min(best.get((tree, child), (parent, label)), (parent, label))
    kids = {}
    for (tree, child), (parent, _) in best.items():
        kids.setdefault((tree, parent), []).append(child)
    out = []
    for tree, root in sorted(k for k in kids if k not in best):
        stack, order, depth = [root], [], {root: 0}
        while stack:
            at = stack.pop()
            order.append(at)
            for k in sorted(kids.get((tree, at), []), reverse=True):
                depth[k] = depth[at] + 1
                stack.append(k)
        last = {}
        for i in reversed(range(len(order))):
            below = kids.get((tree, order[i]), [])
            last[order[i]] = max([i, *[last[k] for k in below]])
        for i, x in enumerate(order[1:], 1):
            parent, label = best[tree, x]
            out.append((tree, root, x, parent, label, i, last[x], sorted(kids[tree, parent]).index(x), depth[x]))
    return sorted(out)


def found_trees(spark, edges):
    rows = dependencies.dependency_trees(spark.createDataFrame(edges, "tree long, parent long, child long, label string"))
    return sorted(tuple(r[c] for c in ("tree", "root", "node", "parent", "label", "node_id", "last_id", "ord", "depth")) for r in rows.collect())


def test_trees_of_random_edges_chains_and_cycles(spark):
    rng = random.Random(3)
    edges = [(1, rng.randrange(k), k, f"l{k % 3}") for k in range(1, 60)]
    edges += [(2, k, k + 1, "chain") for k in range(300)]
    edges += [(3, 1, 2, "a"), (3, 2, 3, "a"), (3, 3, 2, "b"), (3, 9, 3, "c"), (3, 5, 6, "d"), (3, 6, 5, "d"), (3, 6, 7, "d")]
    edges += [(4, 0, 1, "x"), (4, 0, 1, "y"), (4, 10, 11, "z"), (5, 1, 1, "loop")]
    assert found_trees(spark, edges) == plain_trees(edges)
    assert found_trees(spark, []) == []


def test_walks_are_a_dense_power_iteration(spark):
    rng = random.Random(6)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    seeds = {"a": {0: 1.0}, "b": {3: 2.0, 5: 1.0}, "nowhere": {99: 1.0}}
    size, step = 100, np.zeros((100, 100))
    for a, b in pairs:
        step[b, a] = 1
    ways = step.sum(0)
    step[:, ways > 0] /= ways[ways > 0]
    starts = spark.createDataFrame([(s, n, w) for s, v in seeds.items() for n, w in v.items()], "start string, node long, weight double")
    found = {(r["start"], r["node"]): r["rank"] for r in graph.walk_ranks(spark.createDataFrame(list(pairs) * 2, "src long, dst long"), starts, 9).collect()}
    for name, v in seeds.items():
        seed = np.zeros(size)
        for n, w in v.items():
            seed[n] = w / sum(v.values())
        now = seed.copy()
        for _ in range(9):
            moved = 0.85 * step @ now
            now = moved + seed * (1 - moved.sum())
        assert all(abs(found.get((name, n), 0) - now[n]) < 1e-12 for n in range(size))
        assert abs(now.sum() - 1) < 1e-12


def test_the_best_connected_candidate_is_chosen(spark):
    links = [(1, x) for x in (50, 51, 52, 53, 54)] + [(2, x) for x in (50, 51, 52, 53)] + [(3, x) for x in (50, 51, 52)] + [(4, x) for x in (50, 51, 52, 53, 1)]
    rows = [(1, "known", 1, True), (1, "two", 2, False), (1, "two", 3, False), (1, "four", 4, False), (1, "four", 2, False), (1, "three", 3, False), (2, "two", 2, False), (1, "barred", 4, False)]
    mentions = spark.createDataFrame(rows, "doc_id long, mention string, item long, resolved boolean")
    allowed = mentions.where("mention <> 'barred'").select("mention", "item")
    found = graph.shared_neighbour_choice(spark.createDataFrame(links, "src long, dst long"), mentions, allowed)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "four", 4, 5), (1, "two", 2, 4)]


def test_choices_by_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_BLOCKS", 3)
    rng = np.random.default_rng(5)
    links = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 30, (260, 2)).tolist()}
    rows = [(int(d), f"m{m}", f"n{i}" if i < 33 else None, m == 0) for d, m, i in np.column_stack([rng.integers(0, 20, 400), rng.integers(0, 4, 400), rng.integers(0, 34, 400)]).tolist()]
    near = {i: {y for x, y in links if x == i} | {i} for _, _, i, _ in rows}
    best = {}
    for d, m, candidate, resolved in rows:
        for ref in {r[2] for r in rows if r[3] and r[0] == d} - {None}:
            if candidate and not resolved:
                score = len(near[ref] & near[candidate]) - (ref == candidate)
                best[d, m] = max(best.get((d, m), (0, "", "")), (score, ref, candidate))
    mentions = spark.createDataFrame(rows, "doc_id long, mention string, item string, resolved boolean")
    found = graph.shared_neighbour_choice(spark.createDataFrame(list(links), "src string, dst string"), mentions, mentions)
    assert "shared#" not in found._jdf.queryExecution().executedPlan().toString()  # no pair meets over each node it shares
    assert sorted(tuple(r) for r in found.collect()) == sorted((d, m, candidate, score) for (d, m), (score, _, candidate) in best.items() if score > 3)


def test_records_of_sibling_files_side_by_side(spark, tmp_path):
    for name, text in {"a.parse": "p0\np1\n", "a.prop": "x0\nx1", "a.lemma": "l0\n\n", "b.parse": "q0", "b.prop": "", "c.lemma": "only"}.items():
        folder = tmp_path / name[0]
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    rows = articles.zipped(spark, str(tmp_path), ["parse", "prop", "lemma"])
    assert sorted(map(tuple, rows.collect()), key=repr) == [("a", 0, "p0", "x0", "l0"), ("a", 1, "p1", "x1", ""), ("b", 0, "q0", None, None), ("c", 0, None, None, "only")]
    assert sorted(r["article"] for r in articles.complete(rows, ["parse", "prop", "lemma"]).collect()) == ["a", "a"]


def test_trees_are_shown_and_counted_without_joins(spark):
    rows = [(s, 0, None, 0, 0, "S", False, None, 2, 4) for s in (1, 2)] + [(1, 1, 0, 0, 1, "NP", False, None, 1, 2), (1, 2, 1, 0, 2, "NN", True, "a", 1, 2), (1, 3, 0, 1, 1, "VP", False, None, 2, 4), (1, 4, 3, 0, 2, "VB", True, "b", 2, 4)]
    nodes = spark.createDataFrame(rows, "sent_id long, node_id int, parent_id int, ord int, depth int, tag string, is_leaf boolean, word string, e int, last_id int")
    text, sizes = render.tree_text(nodes), trees.subtree_sizes(nodes)
    assert {r["sent_id"]: r["text"] for r in text.collect()}[1] == "\n(S    \n  (NP   \n    (NN   a)) \n  (VP   \n    (VB   b)))"
    assert sorted(tuple(r) for r in sizes.collect()) == [(1, 0, 5), (1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 0, 1)]
    assert sorted(map(tuple, trees.subtree_pairs(nodes).where("top = 3").collect())) == [(1, 3, 3), (1, 3, 4)]
    for made in (text, sizes, trees.subtree_pairs(nodes)):
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("backward", [False, True])
def test_siblings_like_are_found_in_the_sentence_row(spark, backward):
    rng = random.Random(5)
    rows = [(s, 0, None, 0, "VP") for s in range(30)] + [(s, i, rng.randrange(i), i, rng.choice(["VP", "NP", None])) for s in range(30) for i in range(1, 12)]
    made = trees.with_siblings_like(spark.createDataFrame(rows, "sent_id long, node_id int, parent_id int, ord int, tag string"), F.col("tag") == "VP", backward)
    assert made.columns == ["sent_id", "node_id", "parent_id", "ord", "tag", "siblings", "nearest"]
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()

    def siblings(row):
        s, i, p, o, _ = row
        found = [n for t, n, q, k, tag in rows if (t, q) == (s, p) and p is not None and tag == "VP" and ((k < o) if backward else (k > o))]
        return sorted(found, reverse=backward)

    want = {r[:2]: siblings(r) for r in rows}
    found = {(r["sent_id"], r["node_id"]): (r["siblings"], r["nearest"]) for r in made.collect()}
    assert found == {k: (v, v[0] if v else None) for k, v in want.items()} and len(found) == len(rows)
