"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

from functools import cache

import pytest

from lexmill.plans import catalog, catalog_frames, catalog_graphs, catalog_more, catalog_resources, catalog_syntax  # noqa: F401 - the others add their queries to the first's
from tests.conftest import SF


def plain(value):
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module", autouse=True)
def sentences_analysed_once():
    """The queries of parsed sentences share one analysis here, to save time."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog_syntax, "analysed_sentences", cache(catalog_syntax.analysed_sentences))
        patch.setattr(catalog_syntax, "graph_tables", cache(catalog_syntax.graph_tables))
        yield


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in (x.asDict(True) for x in found.collect()))
    if name not in catalog.SQL:
        assert rows
        return
    wanted = duck.sql(catalog.SQL[name])
    names = list(wanted.columns)
    assert columns == sorted(names)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in wanted.fetchall())
