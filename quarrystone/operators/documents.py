"""Whole report files as rows of text in order: written as text (`written`), they are the file.

A body is sorted by ranges and never gathered, so a document may be as long as its estate. Fixed lines are sections
of their own. Rows: section, at (an order within it) and row.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..sources.storage import materialise
from . import emit
from .findings import rank

if TYPE_CHECKING:
    from .graph import Graph

ROW = "section int, at string, row string"


def _lines(like: DataFrame, section: int, *lines: str) -> DataFrame:
    return like.sparkSession.createDataFrame([(section, f"{i:04}", line) for i, line in enumerate(lines)], ROW)


def _body(section: int, rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows (with `row`) as a section ordered by some columns, which are compared as text."""
    return rows.select(F.lit(section).alias("section"), F.concat_ws("\u0001", *order).alias("at"), "row")


def _document(*sections: DataFrame) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out.orderBy("section", "at", "row")


def _listed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows in order, all but the first with a comma before it, and `n`, their order as text; an array's elements."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(parts.select("_at", "row"), "listed")
    first = placed.agg(F.min("_at").alias("m")).first()["m"]
    comma = F.when(F.col("_at") == F.lit(first), "").otherwise(",") if first is not None else F.lit("")
    return placed.select(F.lpad(F.col("_at").cast("string"), 20, "0").alias("n"), F.concat(comma, "row").alias("row"))


def written(document: DataFrame, path: str) -> None:
    """The document as text files whose names keep its order."""
    document.select("row").write.mode("overwrite").text(path)


def _number(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 10, "0")


def _edge_order() -> list[Column | str]:
    return ["src", "dst", "type", "rel_path", _number("line")]


def dot(graph: "Graph") -> DataFrame:
    """The dependency graph in DOT: nodes by key, edges by source, target, type and place."""
    lines = emit.dot_lines(graph.nodes, graph.edges)
    return _document(
        _lines(lines, 0, "digraph quarrystone {", "  rankdir=LR;", '  node [fontname="monospace"];'),
        _body(1, graph.nodes.select("key", emit.dot_node().alias("row")), "key"),
        _body(2, graph.edges.withColumn("row", emit.dot_edge()), *_edge_order()),
        _lines(lines, 3, "}"),
    )


def mermaid(graph: "Graph") -> DataFrame:
    """The dependency graph in Mermaid, ordered as in DOT."""
    return _document(*_mermaid(graph))


def _mermaid(graph: "Graph", first: int = 0) -> list[DataFrame]:
    return [
        _lines(graph.nodes, first, "graph LR"),
        _body(first + 1, graph.nodes.select("key", emit.mermaid_node().alias("row")), "key"),
        _body(first + 2, graph.edges.withColumn("row", emit.mermaid_edge()), *_edge_order()),
    ]


def graphml(graph: "Graph") -> DataFrame:
    """The dependency graph in GraphML; a node and an edge are a line each."""
    edges = emit.graphml_edges(graph.edges)
    return _document(
        _lines(
            edges,
            0,
            '<?xml version="1.0" encoding="UTF-8"?>',
            '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
            '  <key id="type" for="node" attr.name="type" attr.type="string"/>',
            '  <key id="defined" for="node" attr.name="defined" attr.type="boolean"/>',
            '  <key id="rel" for="edge" attr.name="relationship" attr.type="string"/>',
            '  <graph edgedefault="directed">',
        ),
        _body(1, emit.graphml_lines(graph.nodes).withColumn("row", F.concat(F.lit("    "), "row")), "key"),
        _body(2, edges.withColumn("row", F.concat(F.lit("    "), "row")), F.lpad(F.substring("id", 2, 20), 20, "0")),
        _lines(edges, 3, "  </graph>", "</graphml>"),
    )


def json(found: DataFrame) -> DataFrame:
    """The findings' JSON report: summary and findings by path, line and fingerprint; valid also without findings."""
    rows = emit.json_findings(found, "rel_path", "line")
    return _document(
        _lines(found, 0, '{"summary":'),
        _body(1, emit.json_summary(found)),
        _lines(found, 2, ',"findings":['),
        _body(3, _listed(rows, "rel_path", "line", "fingerprint", "row"), "n"),
        _lines(found, 4, "]}"),
    )


def sarif(found: DataFrame) -> DataFrame:
    """The findings in SARIF 2.1.0: one descriptor for each rule, then all results; valid also without findings."""
    given = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rules = emit.sarif_rules(found).select(
        "rule_id",
        F.to_json(F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"), F.struct(given("cwe"), given("owasp")).alias("properties"))).alias("row"),
    )
    head = f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"quarrystone","version":"{__version__}","rules":['
    return _document(
        _lines(found, 0, head),
        _body(1, _listed(rules, "rule_id", "row"), "n"),
        _lines(found, 2, ']}},"results":['),
        _body(3, _listed(emit.sarif_rows(found, "rel_path", "line"), "rel_path", "line", "fingerprint", "row"), "n"),
        _lines(found, 4, "]}]}"),
    )


def html(found: DataFrame) -> DataFrame:
    """A page with all findings, by severity, path and line."""
    total, none = found.count(), '<tr><td colspan="6">No findings.</td></tr>'
    order = [_number("_rank"), "rel_path", _number("line"), "fingerprint"]
    rows = emit.html_rows(found, "rel_path", "line", "fingerprint", (99 - rank()).alias("_rank"))
    return _document(
        _lines(found, 0, f"<!doctype html><title>Findings</title><h1>{total} findings</h1><table>", *([] if total else [none])),
        _body(1, rows, *order),
        _lines(found, 2, "</table>"),
    )


def overview(name: str, graph: "Graph", found: DataFrame, pages: DataFrame) -> DataFrame:
    """The system page in Markdown: inventory, graph, security summary, observations and artifacts.

    pages: name, type and file_name of the artifacts that have one. Names of an observation are items below its
    count, one line each, since their number has no bound.
    """
    counted = emit.overview_counts(graph.nodes, found)
    counts = lambda section, part: _body(section, counted.filter(F.col("part") == part), _number("at"))
    item = F.concat(F.lit("  - "), "name").alias("row")

    def observed(section: int, title: str, names: DataFrame) -> list[DataFrame]:
        """A line with the number of names, and the names."""
        kept = materialise(names.select("name").distinct(), "observed")
        n = kept.agg(F.count(F.lit(1)).cast("string").alias("n"))
        head = F.concat(F.lit(f"- **{title}:** "), F.when(F.col("n") == "0", "none").otherwise(F.col("n")))
        return [_body(section, n.select(head.alias("row"))), _body(section + 1, kept.select("name", item), "name")]

    cycles = materialise(graph.cycles(), "cycles")
    n_cycles = cycles.agg(F.count_distinct("cycle").cast("string").alias("n"))
    linked = F.concat(F.lit("| "), "name", F.lit(" | "), "type", F.lit(" | ["), "file_name", F.lit("]("), "file_name", F.lit(") |"))
    table = ["| Name | Type | Documentation |", "| --- | --- | --- |"] if not pages.isEmpty() else ["_No documented artifacts._"]
    return _document(
        _lines(found, 0, f"# System Documentation: {name}", "", "## Inventory"),
        counts(10, "inventory"),
        _lines(found, 15, "", "## Dependency graph", "```mermaid"),
        *_mermaid(graph, 20),
        _lines(found, 30, "```", "", "## Security summary"),
        counts(31, "security"),
        _lines(found, 35, "", "## Structural observations"),
        _body(40, n_cycles.select(F.concat(F.lit("- **Dependency cycles:** "), "n").alias("row"))),
        _body(41, cycles.select("cycle", "key", F.concat(F.lit("  - "), "cycle", F.lit(": "), "key").alias("row")), "cycle", "key"),
        *observed(42, "Orphan programs (no incoming refs)", graph.orphans),
        *observed(44, "Unused copybooks", graph.unused_copybooks),
        *observed(46, "Unresolved references", graph.external),
        _lines(found, 50, "", "## Artifacts", *table),
        _body(51, pages.withColumn("row", linked), "name", "type", "file_name"),
        _lines(found, 52, ""),
    )
