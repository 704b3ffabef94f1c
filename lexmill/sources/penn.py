"""Bracketed trees as rows, one a node: sent_id, node_id (pre-order from 0), parent_id, ord, depth, tag, word, b, e, is_leaf.

``b`` and ``e`` are leaf ordinals, half-open; a subtree is the run of rows whose
``node_id`` lies between a node's own and ``last_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

NODE = "sent_id long, node_id int, last_id int, parent_id int, ord int, depth int, tag string, word string, b int, e int, is_leaf boolean"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
_TOKEN = re.compile(r"[()]|[^\s()]+")


def parse(text: str) -> list[dict]:
    """Nodes of one tree in pre-order. An outer bracket without a tag is the root. Raises ValueError for broken text."""
    nodes: list[dict] = []
    open_nodes: list[int] = []
    leaves = 0
    words = _TOKEN.findall(text)
    at = 0
    while at < len(words):
        word = words[at]
        at += 1
        if word == "(":
            tag = "ROOT"
            if at < len(words) and words[at] not in "()":
                tag, at = words[at], at + 1
            parent = open_nodes[-1] if open_nodes else None
            if parent is None and nodes:
                raise ValueError("more than one tree")
            number = sum(1 for n in nodes if n["parent_id"] == parent) if parent is not None else 0
            nodes.append({"node_id": len(nodes), "parent_id": parent, "ord": number, "depth": len(open_nodes), "tag": tag, "word": None, "b": leaves, "is_leaf": False})
            open_nodes.append(len(nodes) - 1)
        elif word == ")":
            if not open_nodes:
                raise ValueError("a bracket too many")
            done = nodes[open_nodes.pop()]
            done["e"], done["last_id"] = leaves, len(nodes) - 1
        else:
            if not open_nodes or nodes[open_nodes[-1]]["word"] is not None:
                raise ValueError(f"a word out of place: {word}")
            own = nodes[open_nodes[-1]]
            own["word"], own["is_leaf"] = word, True
            leaves += 1
    if open_nodes or not nodes:
        raise ValueError("a bracket too few")
    return nodes


def trees(rows: DataFrame, key: str = "sent_id", value: str = "value") -> DataFrame:
    """Node rows of each tree; texts that don't parse give none (``rejected`` lists them)."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for own, text in zip(batch[key], batch[value], strict=True):
                try:
                    found += [{"sent_id": own, **n} for n in parse(text or "")]
                except ValueError:
                    continue
            frame = pd.DataFrame(found, columns=COLUMNS)
            frame["parent_id"] = frame["parent_id"].astype("Int64")
            yield frame

    return rows.select(key, value).mapInPandas(expand, NODE)


def rejected(rows: DataFrame, key: str = "sent_id", value: str = "value") -> DataFrame:
    """key and reason of the texts that don't parse."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for own, text in zip(batch[key], batch[value], strict=True):
                try:
                    parse(text or "")
                except ValueError as error:
                    bad.append((own, str(error)))
            yield pd.DataFrame(bad, columns=["sent_id", "reason"])

    return rows.select(key, value).mapInPandas(test, "sent_id long, reason string")
