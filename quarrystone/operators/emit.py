"""Reports as rows of text: DOT, Mermaid, GraphML, JSON, SARIF, Markdown; and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise

SHAPES = {"program": "box", "copybook": "note", "job": "component", "dataset": "cylinder", "table": "cylinder", "external": "box"}
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}

OTHER_SIGNS = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum())


def node_id(key: Column) -> Column:
    # ASCII's other signs by a table, the rest by the classes.
    plain = F.translate(key, OTHER_SIGNS, "_" * len(OTHER_SIGNS))
    beyond = F.octet_length(plain) != F.char_length(plain)
    return F.concat(F.lit("n_"), F.when(beyond, F.regexp_replace(plain, r"(?U)[^\p{IsAlphabetic}\p{IsDigit}]", "_")).otherwise(plain))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def dot_node() -> Column:
    shape = F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    style = F.when(F.col("defined"), "").otherwise(', style=dashed, color="red"')
    return F.concat(F.lit("  "), node_id(F.col("key")), F.lit(' [label="'), F.col("name"), F.lit("\\n("), F.col("type"), F.lit(')", shape='), shape, style, F.lit("];"))


def dot_edge() -> Column:
    dashed = F.when(F.col("type") == "dynamic_call", ", style=dashed").otherwise("")
    return F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" -> "), node_id(F.col("dst")), F.lit(' [label="'), F.col("type"), F.lit('"'), dashed, F.lit("];"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("part"), dot_node().alias("row")).unionByName(edges.select(F.lit("edge").alias("part"), dot_edge().alias("row")))


def mermaid_node() -> Column:
    label = F.concat(F.col("name"), F.lit("<br/>("), F.col("type"), F.lit(")"))
    body = (
        F.when(F.col("type").isin("dataset", "table"), F.concat(F.lit("[("), label, F.lit(")]")))
        .when(F.col("defined"), F.concat(F.lit("["), label, F.lit("]")))
        .otherwise(F.concat(F.lit("("), label, F.lit(")")))
    )
    return F.concat(F.lit("  "), node_id(F.col("key")), body)


def mermaid_edge() -> Column:
    arrow = F.when(F.col("type") == "dynamic_call", " -.->|").otherwise(" -->|")
    return F.concat(F.lit("  "), node_id(F.col("src")), arrow, F.col("type"), F.lit("| "), node_id(F.col("dst")))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("part"), mermaid_node().alias("row")).unionByName(edges.select(F.lit("edge").alias("part"), mermaid_edge().alias("row")))


def graphml_lines(nodes: DataFrame) -> DataFrame:
    row = F.concat(
        F.lit('<node id="'), escaped(F.col("key")), F.lit('"><data key="type">'), F.col("type"), F.lit('</data><data key="defined">'), F.col("defined").cast("string"), F.lit("</data></node>")
    )
    return nodes.select("key", row.alias("row"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """id and row of every edge; ids e0, e1, ... follow the order of source, target, type, path and line."""
    order = ["src", "dst", "type", "rel_path", "line"]
    placed = materialise(edges.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # The number of a part's first row; one row for each part of the sort.
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    name = F.concat(F.lit("e"), (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("string"))
    row = F.concat(
        F.lit('<edge id="'), name, F.lit('" source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"><data key="rel">'), escaped(F.col("type")), F.lit("</data></edge>")
    )
    return numbered.select(name.alias("id"), row.alias("row"))


def whole(found: DataFrame) -> DataFrame:
    """found with the marks that findings have after suppression and mapping: suppressed and controls."""
    for name, value in (("suppressed", F.lit(False)), ("controls", F.array().cast("array<string>"))):
        if name not in found.columns:
            found = found.withColumn(name, value)
    return found


#: The fields of a finding in reports, in order.
FIELDS = "rule_id title severity rel_path line evidence rationale remediation confidence source requires_human_review cwe owasp suppressed controls fingerprint".split()
KEEP = {"ignoreNullFields": "false"}


def json_findings(found: DataFrame, *kept: str) -> DataFrame:
    """Every finding with all its fields as JSON; also the columns `kept`."""
    return whole(found).select(*kept, "fingerprint", F.to_json(F.struct(*FIELDS), KEEP).alias("row"))


def json_summary(found: DataFrame) -> DataFrame:
    """One row: the report's summary as JSON."""
    counts = whole(found).groupBy("severity", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("requires_human_review").alias("review"), F.count_if("suppressed").alias("off")
    )
    by = lambda c: counts.groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = counts.agg(total("n").alias("total"), total("review").alias("requires_human_review"), total("off").alias("suppressed"))
    one = one.crossJoin(by("severity")).crossJoin(by("source"))  # one row each
    return one.select(F.to_json(F.struct("total", "by_severity", "by_source", "requires_human_review", "suppressed")).alias("row"))


def sarif_rows(found: DataFrame, *kept: str) -> DataFrame:
    """Every finding as a SARIF result in JSON, with its properties; suppressed ones carry a suppression. Also the columns `kept`."""
    levels = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    uri = F.struct(F.struct(F.col("rel_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region"))
    parts = [
        F.col("rule_id").alias("ruleId"),
        F.coalesce(F.try_element_at(levels, F.col("severity")), F.lit("warning")).alias("level"),
        F.struct(F.concat("title", F.lit(": "), "rationale").alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias("quarrystone/v1")).alias("partialFingerprints"),
        F.array(F.struct(uri.alias("physicalLocation"))).alias("locations"),
        F.struct("severity", "cwe", "owasp", "confidence", "source", F.col("requires_human_review").alias("requiresHumanReview"), "evidence", "remediation", "controls").alias("properties"),
    ]
    marked = [*parts, F.array(F.struct(F.lit("external").alias("kind"))).alias("suppressions")]
    row = F.when(F.col("suppressed"), F.to_json(F.struct(*marked), KEEP)).otherwise(F.to_json(F.struct(*parts), KEEP))
    return whole(found).select(*kept, "fingerprint", row.alias("row"))


def json_rows(found: DataFrame) -> DataFrame:
    return found.select("fingerprint", F.to_json(F.struct("rule_id", "severity", "rel_path", "line")).alias("row"))


def sarif_results(found: DataFrame) -> DataFrame:
    level = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), F.col("severity")), F.lit("warning"))
    return found.select("fingerprint", F.col("rule_id").alias("ruleId"), level.alias("level"), "rel_path", F.greatest("line", F.lit(1)).alias("startLine"), F.concat("title", F.lit(": "), "rationale").alias("message"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """One descriptor per rule, from its first finding."""
    w = Window.partitionBy("rule_id").orderBy("rel_path", "line", "rule_ord")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("rule_id", F.col("title").alias("name"), "cwe", "owasp")


def html_rows(found: DataFrame, *kept: str | Column) -> DataFrame:
    """Table rows of all findings with all their fields, in order of severity, path and line; may be written as text.

    Cells: severity, rule, CWE and OWASP, place and id, what was found (marks, rationale, fix, evidence, controls), source.
    """
    from .findings import rank

    text = lambda c: F.replace(escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("'"), F.lit("&#x27;"))
    small = lambda *parts: F.concat(F.lit("<br><small>"), *parts, F.lit("</small>"))
    number = F.element_at(F.split(text("cwe"), "-"), -1)
    link = F.concat(F.lit('<a href="https://cwe.mitre.org/data/definitions/'), number, F.lit('.html">'), text("cwe"), F.lit("</a>"))
    mark = lambda c, name, words: F.when(F.col(c), f'<span class="{name}">{words}</span>').otherwise("")
    controls = F.when(F.size("controls") > 0, small(F.lit("<em>Controls:</em> "), text("_controls"))).otherwise("")
    cells = [
        text("severity"),
        text("rule_id"),
        F.concat(F.when(F.col("cwe") != "", link).otherwise(""), F.when(F.col("owasp") != "", F.concat(F.lit("<br>"), text("owasp"))).otherwise("")),
        F.concat(F.lit("<code>"), text("rel_path"), F.lit(":"), text("line"), F.lit("</code>"), small(F.lit("id "), text("fingerprint"))),
        F.concat(
            F.lit("<strong>"), text("title"), F.lit("</strong> "), mark("requires_human_review", "review", "review"), mark("suppressed", "supp", "suppressed"),
            small(text("rationale")), small(F.lit("<em>Fix:</em> "), text("remediation")), small(F.lit("<em>Evidence:</em> <code>"), text("evidence"), F.lit("</code>")), controls,
        ),
        F.concat(text("source"), small(F.lit("conf "), F.format_number("confidence", 2))),
    ]
    start = F.when(F.col("suppressed"), "<tr class=off>").otherwise("<tr>")
    row = F.concat(start, *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    listed = whole(found).withColumn("_controls", F.array_join("controls", ", "))
    if kept:  # the caller orders them
        return listed.select(*kept, row.alias("row"))
    return listed.orderBy(F.desc(rank()), "rel_path", "line", "fingerprint").select(row.alias("row"))


def html_report(found: DataFrame, limit: int = 100_000) -> str:
    """A page of the findings in order of severity, path and line; the caller says how many rows a page may have.

    The page counts all findings and says how many it leaves out; html_rows() has them all.
    """
    total = found.count()
    cells = "".join(r.row for r in html_rows(found).limit(limit).collect())
    rest = f"<p>{total - limit} further findings are not shown</p>" if total > limit else ""
    cells = cells or '<tr><td colspan="6">No findings.</td></tr>'
    return f"<!doctype html><title>Findings</title><h1>{total} findings</h1><table>{cells}</table>{rest}"


def doc_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?U)[^\p{IsAlphabetic}\p{IsDigit}_-]", "_"), F.lit(".md"))


def dependency_lines(calls: DataFrame, copies: DataFrame, sql_tables: DataFrame) -> DataFrame:
    """rel_path, line and Markdown rows of what a program calls, copies and reads or writes, with the place of each."""
    place = F.concat(F.lit(" (`"), F.col("rel_path"), F.lit(":"), F.col("line").cast("string"), F.lit("`)"))
    kind = F.when(F.startswith("mechanism", F.lit("CICS")), F.col("mechanism")).when(F.col("dynamic"), "dynamic CALL").otherwise("CALL")
    row = lambda *parts: F.concat(F.lit("- "), *parts, F.lit("`"), place).alias("row")
    called = calls.select("rel_path", "line", row(kind, F.lit(" → `"), F.col("target")))
    copied = copies.select("rel_path", "line", row(F.lit("COPY → `"), F.col("name")))
    return called.unionByName(copied).unionByName(sql_tables.select("rel_path", "line", row(F.lit("SQL "), F.col("op"), F.lit(" → table `"), F.col("name"))))


def reverse_lines(reverse: DataFrame) -> DataFrame:
    """name and Markdown rows of who calls a program and which jobs run it (reverse: name, callers, jobs, joined by commas)."""
    said = lambda c, words: F.when(F.col(c) != "", F.concat(F.lit(f"- **{words}:** "), F.replace(F.col(c), F.lit(","), F.lit(", "))))
    rows = F.array_compact(F.array(said("callers", "Called by"), said("jobs", "Invoked by job(s)")))
    return reverse.select("name", F.explode(rows).alias("row"))


def business_lines(paragraphs: DataFrame) -> DataFrame:
    """rel_path and the sentence on a program's flow: its first twelve paragraphs in order of their lines."""
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, 12), lambda p: F.concat(F.lit("`"), p["name"], F.lit("`")))
    flow = F.concat(F.lit("Procedure flow (by paragraph): "), F.array_join(names, ", "), F.lit("."))
    return paragraphs.groupBy("rel_path").agg(flow.alias("row"))


#: Node types of an overview's inventory, and severities of its summary, in order.
INVENTORY = ("program", "copybook", "job", "dataset", "external")
LISTED = ("critical", "high", "medium", "low", "info")


def overview_counts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """part, at and row: the inventory and the security summary of a system overview, in their order."""
    listed = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    kinds = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("type").isin(*INVENTORY))
    inventory = kinds.select(F.lit("inventory").alias("part"), listed(INVENTORY, "type").alias("at"), F.concat(F.lit("- **"), F.initcap("type"), F.lit(":** "), F.col("n").cast("string")).alias("row"))
    per = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("requires_human_review").alias("review"))
    severities = per.filter(F.col("severity").isin(*LISTED)).select(F.lit("security").alias("part"), listed(LISTED, "severity").alias("at"), F.concat(F.lit("  - "), "severity", F.lit(": "), F.col("n").cast("string")).alias("row"))
    total = lambda c, words, at: per.agg(F.coalesce(F.sum(c), F.lit(0)).cast("string").alias("n")).select(F.lit("security").alias("part"), F.lit(at).cast("long").alias("at"), F.concat(F.lit(f"- **{words}:** "), "n").alias("row"))
    return inventory.unionByName(total("n", "Total findings", 0)).unionByName(severities).unionByName(total("review", "Require human review", len(LISTED) + 1))


def fallback_purpose(kind: Column, paragraphs: Column, items: Column, calls: Column) -> Column:
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    bits = F.concat_ws(", ", part(paragraphs, " paragraph(s)"), part(items, " data item(s)"), part(calls, " CALL(s)"))
    detail = F.when(bits == "", "no extracted structure").otherwise(bits)
    return F.concat(kind, F.lit(" containing "), detail, F.lit(". (Enable the LLM for a natural-language summary.)"))


def redacted(text: Column) -> Column:
    """text without values that look like secrets (fixed patterns)."""
    gone = "***REDACTED***"
    text = F.regexp_replace(text, r"""(?iU)(api[_-]?key"?\s*[:=]\s*)([^\s,;}"']+)""", "$1" + gone)
    text = F.regexp_replace(text, r"(?iU)(authorization\s*:\s*bearer\s+)(\S+)", "$1" + gone)
    return F.regexp_replace(text, r"(sk-[A-Za-z0-9]{8,})", gone)
