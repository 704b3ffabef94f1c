"""Lines with carried state as a stream: the same rules as ``sources.rdf.turtle_statements``, across micro-batches.

The state of a file is the last terminator with its subject and verb. A batch
brings lines of a file with their numbers; they are taken in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.sources.rdf import turtle_lines

OUT = "file string, line_no long, s string, v string, o string, error string"
STATE = "mode string, s string, v string"
NEEDS = {3: "End", 2: "Semicolon", 1: "Comma"}


def fill(state: tuple[str, str | None, str | None], terms: list[str] | None, ending: str | None, error: str | None) -> tuple[tuple, tuple]:
    """(next state, (s, v, o, error)) of one line."""
    mode, s, v = state
    if error:
        return state, (None, None, None, error)
    terms = list(terms)
    if NEEDS.get(len(terms)) != mode:
        return ("End", None, None), (None, None, None, "Missing subject or verb.")
    if len(terms) == 3:
        s = terms[0]
    if len(terms) > 1:
        v = terms[-2]
    return (ending, s, v), (s, v, terms[-1], None)


def stream_statements(lines: DataFrame) -> DataFrame:
    """file, line_no, s, v, o, error of a stream of (file, line_no, value)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("End", None, None)
        rows = []
        for r in pd.concat(list(batches)).sort_values("line_no").itertuples():
            now, row = fill(now, r.terms, r.ending, r.error)
            rows.append((key[0], r.line_no, *row))
        state.update(now)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    parsed = turtle_lines(lines).select("file", "line_no", "terms", "ending", "error")
    return parsed.groupBy("file").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_triples(lines: DataFrame) -> DataFrame:
    """Lines of three or four tokens need no state: the batch operator runs on the stream as it is."""
    from lexmill.sources.rdf import triples

    return triples(lines)
