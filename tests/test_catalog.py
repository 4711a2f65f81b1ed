"""A few queries of the catalog against DuckDB on the smallest tables."""

import json
import os

import duckdb
import pytest

from quarrystone import catalog
from quarrystone.operators import rules
from quarrystone.sources.store import Store

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["cobol_calls", "jcl_dds", "graph_edges", "findings_all", "index_diff", "rules_custom_pack", "emit_mermaid_lines", "llm_findings_sanitize", "doc_overview_counts", "findings_replace", "embeddings_upsert", "emit_dot_document", "emit_mermaid_document", "emit_graphml_document", "diff_listing", "cosine_similarity", "search_related"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    cur = con.execute(catalog.ORACLE_SQL[name])
    order = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in order]
    expected = sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(str(r[c]) for c in order) for r in catalog.QUERIES[name](spark, DATA).collect())
    assert got == expected


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("artifacts") is None and store.versions("artifacts") == []
    rows = lambda *r: spark.createDataFrame(r, "rel_path string, sha256 string")
    store.merge("artifacts", rows(("a", "1"), ("b", "1")))
    got = store.merge("artifacts", rows(("b", "2"), ("b", "3"), ("c", "1")))
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "3"), ("c", "1")]
    store.replace("artifacts", rows(("z", "9")))
    # A version that was not written whole doesn't count.
    (tmp_path / "artifacts" / "00000009").mkdir()
    assert [tuple(r) for r in store.read("artifacts").collect()] == [("z", "9")] and store.versions("artifacts") == [1, 2]
    store.record("begin", config="x")
    store.record("end", n=3)
    assert [r.event for r in store.events().collect()] == ["begin", "end"]


def test_pack_rules_are_checked():
    assert rules.checked({"id": 7, "pattern": "x", "severity": "HIGH"})["severity"] == "high"
    for bad in ({"id": "A"}, {"id": "A", "pattern": "("}, {"id": "A", "pattern": "x", "severity": "dire"}):
        with pytest.raises(ValueError):
            rules.checked(bad)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_whole_documents(spark):
    whole = lambda name: "\n".join(r.row for r in catalog.QUERIES[name](spark, DATA).collect())
    n = catalog.QUERIES["findings_all"](spark, DATA).count()
    assert json.loads(whole("emit_json_document"))["summary"]["total"] == n
    assert len(json.loads(whole("emit_sarif_document"))["runs"][0]["results"]) == n
    assert f"- **Total findings:** {n}" in whole("doc_overview")


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert catalog.flagship(spark, DATA).count() > 0
