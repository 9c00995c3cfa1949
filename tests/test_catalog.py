"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

import os

import pytest

from differential import connect, rows
from lexigraph.plans import catalog, flagship

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(connect(FOLDER).execute(catalog.ORACLES[name]).df())


def test_flagship(spark):
    out = flagship.question_context(spark, FOLDER).toPandas()
    assert list(out.columns) == ["item_id", "chunk_id", "doc_id", "chunk_index", "score", "position"]
    for _, rows_ in out.groupby("item_id"):
        assert sorted(rows_["position"]) == list(range(1, len(rows_) + 1)) and len(rows_) <= 15


def test_graph_extraction_gleans(spark, monkeypatch):
    def provider(prompts):
        return ['("entity"<|>Found<|>Person<|>a)' + ('##("entity"<|>Gleaned<|>Person<|>b)' if p.startswith("CONTINUE") else "") for p in prompts]

    monkeypatch.setattr(catalog, "_echo", provider)
    got = {r["title"].lower(): r["units"] for r in catalog.graph_extraction(spark, FOLDER).collect()}
    assert set(got) == {"found", "gleaned"} and got["found"] == got["gleaned"] == catalog.chunk_rows(spark, FOLDER).filter("chunk_text IS NOT NULL").count()
