"""Whole report files, the configuration, adapters and the parser's fallback on small sources."""

import json
import xml.etree.ElementTree as ET

import pytest
from test_estate import estate  # noqa: F401

from quarrystone.operators import adapters, documents, fallback, findings, pages, retrieval
from quarrystone.operators.gateway import Gateway, HostNotAllowed
from quarrystone.sources import config


def text(document):
    return "\n".join(r.row for r in document.collect()) + "\n"


def test_graph_documents(spark, estate, tmp_path):  # noqa: F811
    g = estate.graph
    n_nodes, n_edges = g.nodes.count(), g.edges.count()
    dot = text(documents.dot(g)).splitlines()
    assert dot[0] == "digraph quarrystone {" and dot[-1] == "}" and len(dot) == n_nodes + n_edges + 4
    assert sum(" -> " in line for line in dot) == n_edges and all(" -> " not in line for line in dot[: 3 + n_nodes])
    mermaid = text(documents.mermaid(g)).splitlines()
    assert mermaid[0] == "graph LR" and len(mermaid) == 1 + n_nodes + n_edges
    documents.written(documents.graphml(g), str(tmp_path / "g"))
    whole = "\n".join(r.value for f in sorted((tmp_path / "g").glob("part-*")) for r in spark.read.text(str(f)).collect())
    tree = ET.fromstring(whole.encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(tree.findall(f".//{ns}node")) == n_nodes
    assert [e.get("id") for e in tree.findall(f".//{ns}edge")] == [f"e{i}" for i in range(n_edges)]
    names = {n.get("id") for n in tree.findall(f".//{ns}node")}
    assert all({e.get("source"), e.get("target")} <= names for e in tree.findall(f".//{ns}edge"))


def test_findings_documents(estate):  # noqa: F811
    found = estate.findings
    n = found.count()
    report = json.loads(text(documents.json(found)))
    assert len(report["findings"]) == report["summary"]["total"] == n > 1
    places = [(f["rel_path"], f["line"]) for f in report["findings"]]
    assert places == sorted(places)
    sarif = json.loads(text(documents.sarif(found)))["runs"][0]
    rules = [r["id"] for r in sarif["tool"]["driver"]["rules"]]
    assert len(sarif["results"]) == n and rules == sorted({r["ruleId"] for r in sarif["results"]})
    page = text(documents.html(found))
    assert page.count("<tr>") == n and f"<h1>{n} findings</h1>" in page
    none = found.limit(0)
    assert json.loads(text(documents.json(none)))["findings"] == [] and "No findings." in text(documents.html(none))
    assert json.loads(text(documents.sarif(none)))["runs"][0]["results"] == []


def test_overview(estate):  # noqa: F811
    linked = pages.program_pages(estate.cobol, estate.graph).join(estate.cobol.programs.select("rel_path", "is_copybook"), "rel_path")
    linked = linked.selectExpr("name", "if(is_copybook, 'copybook', 'program') AS type", "file_name")
    page = text(documents.overview("demo", estate.graph, estate.findings, linked))
    order = ["# System Documentation: demo", "## Inventory", "- **Program:**", "```mermaid\ngraph LR\n", "## Security summary", "- **Total findings:**", "## Structural observations", "- **Dependency cycles:** 0",
             "- **Unresolved references:**", "  - TAX\n", "## Artifacts", "| --- | --- | --- |", "| PAY | program | [PAY.md](PAY.md) |"]
    at = [page.index(o) for o in order]
    assert at == sorted(at)
    assert "_No documented artifacts._" in text(documents.overview("demo", estate.graph, estate.findings.limit(0), linked.limit(0)))


def test_diff_listing(spark, estate):  # noqa: F811
    got = [r.severity for r in findings.diff_listing(estate.findings, spark.createDataFrame([], "fingerprint string")).collect()]
    ranks = ["info", "low", "medium", "high", "critical"]
    assert got and got == sorted(got, key=ranks.index, reverse=True)


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "audit.yaml"
    write = lambda s: path.write_text(s)
    base = "project: {name: demo}\nlanguages: [cobol, jcl]\n"
    llm = "llm:\n  providers:\n  - {name: a, type: local, model: m}\n  routing: {default: a}\n"
    write(base + llm)
    got = config.load(str(path))
    assert got["air_gapped"] is True and got["analysis"]["compliance"]["rule_packs"] == ["cwe", "owasp"] and got["project"]["root"] == "."
    assert config.routes(got) == {"default": "a", "parse_fallback": "a", "security": "a", "documentation": "a"}
    for bad, said in (
        (base + llm + "colour: red\n", "colour"),
        (base + llm + "version: 2\n", "version"),
        (base.replace("jcl", "rpg") + llm, "languages.1"),
        ("languages: [cobol]\n" + llm, "project"),
        (base + llm.replace("default: a", "default: b"), "routing.default"),
        (base + llm.replace("  routing", "  - {name: a, type: local, model: m}\n  routing"), "duplicate"),
        (base + llm + "findings: {fail_on: dire}\n", "fail_on"),
        (base + llm + "budget: {max_tokens: -1}\n", "max_tokens"),
        (base + llm + "parser: {workers: 0}\n", "workers"),
        (base + llm + "air_gapped: 3\n", "air_gapped"),
        (base, "provider"),
        ("", "empty"),
        ("- a\n", "mapping"),
        ("a: [\n", "YAML"),
    ):
        write(bad)
        with pytest.raises(config.ConfigError, match=said):
            config.load(str(path))
    write(base)
    monkeypatch.delenv(config.KEY_ENV, raising=False)
    (tmp_path / "llm_config.yaml").write_text("url: http://h/v1\nmodel: m\nkey: k\nembedding_model: e\n")
    got = config.load(str(path))
    assert got["llm"]["providers"] == [{"name": "default", "type": "openai_compatible", "model": "m", "base_url": "http://h/v1", "api_key_env": config.KEY_ENV}]
    assert config.os.environ[config.KEY_ENV] == "k" and got["llm"]["embeddings"] == {"provider": "default", "model": "e"}
    with pytest.raises(config.ConfigError, match="not found"):
        config.load(str(tmp_path / "none.yaml"))


def test_adapters_and_gateway(monkeypatch):
    monkeypatch.setenv("A_KEY", "k")
    sent = []

    def transport(url, headers, body):
        sent.append((url, headers, body))
        if url.endswith("/embeddings"):
            return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
        return {"choices": [{"message": {"content": "hi"}}]} if "choices" in url or "chat" in url else {"content": [{"type": "text", "text": "h"}, {"type": "x"}, {"type": "text", "text": "i"}]}

    chat = adapters.provider({"name": "a", "type": "local", "model": "m", "base_url": "http://h/v1/", "api_key_env": "A_KEY"}, transport, ["h"])
    turns = [("system", "s"), ("user", "u")]
    assert chat.complete(turns) == "hi" and sent[-1][:2] == ("http://h/v1/chat/completions", {"Authorization": "Bearer k"})
    assert chat.embed(["x", "y"]) == [[1.0], [2.0]]
    split = adapters.provider({"name": "b", "type": "anthropic", "model": "m", "base_url": "http://h", "api_key_env": "A_KEY"}, transport, ["h"])
    assert split.complete(turns) == "hi" and sent[-1][2]["system"] == "s" and sent[-1][2]["messages"] == [{"role": "user", "content": "u"}] and sent[-1][1]["x-api-key"] == "k"
    with pytest.raises(NotImplementedError):
        split.embed(["x"])
    with pytest.raises(HostNotAllowed):
        adapters.provider({"name": "a", "type": "local", "model": "m", "base_url": "http://else/v1"}, transport, ["h"])
    broken = adapters.provider({"name": "a", "type": "local", "model": "m", "base_url": "http://h"}, lambda *a: {}, ["h"])
    with pytest.raises(adapters.ReplyError):
        broken.complete(turns)
    assert Gateway({"default": str}, embedder=chat.embed).embed(["x", "y"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        Gateway({"default": str}).embed(["x"])


def test_context_gate(spark):
    stored = spark.createDataFrame([("a", [1.0])], "rel_path string, vector array<double>")
    assert retrieval.has_embeddings(stored) and not retrieval.has_embeddings(stored.limit(0)) and not retrieval.has_embeddings(None)
    g = Gateway({"default": str}, embedder=lambda t: [[1.0]])
    assert retrieval.with_context(g, stored) and not retrieval.with_context(g, stored, off=True)
    assert not retrieval.with_context(None, stored) and not retrieval.with_context(Gateway({"default": str}), stored)


def test_fallback(spark):
    files = spark.createDataFrame([("a", "x" * 7000), ("b", "good"), ("c", "copy"), ("d", "down"), ("e", "prose"), ("f", None)], "rel_path string, text string")
    programs = spark.createDataFrame([("a", None, False, 0.3), ("b", "B", False, 0.95), ("c", None, True, 0.3), ("d", None, False, 0.3), ("e", "E", False, 0.4), ("f", None, False, 0.1)], "rel_path string, program_id string, is_copybook boolean, confidence double")

    def ask(prompt):
        if "down" in prompt:
            raise OSError("no route")
        if "prose" in prompt:
            return "no object here"
        return 'sure: ```{"program_id": "pay", "paragraphs": ["a-1", 3], "calls": ["' + str(prompt.count("x") >= 6000 and prompt.count("x" * 6001) == 0).lower() + '"]}```'

    got = {tuple(r) for r in fallback.recovered(files, programs, ask).select("rel_path", "kind", "name", "line", "inferred").collect() if r.kind != "warning"}
    assert got == {("a", "program_id", "PAY", 0, True), ("a", "paragraph", "A-1", 0, True), ("a", "call", "TRUE", 0, True)} | {("f", k, n, 0, True) for k, n in (("program_id", "PAY"), ("paragraph", "A-1"), ("call", "FALSE"))}
    warned = {r.rel_path: r.name for r in fallback.recovered(files, programs, ask).filter("kind = 'warning'").collect()}
    assert set(warned) == {"a", "d", "e", "f"} and "no route" in warned["d"]
    assert fallback.recovered(files, programs, None).count() == 0


def test_backend():
    assert config.backend("regex") == "regex"
    with pytest.warns(UserWarning):
        assert config.backend("antlr") == "regex"
    with pytest.raises(config.ConfigError):
        config.backend("antlr", fallback=False)


def test_artifacts_are_those_of_the_pages(estate):  # noqa: F811
    made = pages.program_pages(estate.cobol, estate.graph).collect()
    want = sorted((r.name, "copybook" if r.page.startswith("# Copybook") else "program", r.file_name) for r in made)
    assert want and sorted(map(tuple, pages.artifacts(estate.cobol).collect())) == want


def test_words_that_guard_patterns(spark):
    from pyspark.sql import functions as F

    from quarrystone.functions.text import group, has

    lines = ["DATA DIVISION.", "data division.", "DATA D\u0130V\u0131S\u0130ON.", "DATA DIVIDE.", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    rx = r"^\s*(DATA)\s+DIVISION\b"
    got = rows.select(*[e for w in ("", "DIVISION") for e in (has(F.col("x"), rx, w), group(F.col("x"), rx, word=w))]).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)
    assert [r[0] for r in got] == [True, True, True, False, False]
