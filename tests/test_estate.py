"""Extraction, rules, graph and index on small inline sources."""

import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import patterns as P
from quarrystone.functions import text as T
from quarrystone.operators import emit, findings, index, pages, retrieval, rules
from quarrystone.operators.classify import classified
from quarrystone.operators.gateway import BudgetSpent, Gateway
from quarrystone.operators.graph import strong_components
from quarrystone.plans.estate import Estate
from quarrystone.sources import files as sources

PAY = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
           COPY EMP.
       01  WS-RATE PIC 9(3)V99.
       PROCEDURE DIVISION.
       MAIN-PARA.
      * CALL 'OLD'
           DISPLAY 'GU CALL TO ROOT' WS-PIN.
           CALL 'TAX' USING WS-RATE.
           PERFORM A-IMS-CALL THRU B.
           EXEC CICS XCTL
             PROGRAM(WS-NEXT)
           END-EXEC.
           EXEC SQL DELETE FROM ACCT.T1 WHERE X = 1 END-EXEC.
           EVALUATE A
             WHEN 1 EVALUATE B WHEN 2 CONTINUE END-EVALUATE
             WHEN OTHER CONTINUE
           END-EVALUATE.
           CALL WS-NEXT.
"""
JOB = "//RUN JOB (A),'X',\n//  PASSWORD=ABC\n//* EXEC PGM=NO\n//S1 EXEC PGM=PAY\n//D1 DD DSN=A.B(MEM),\n//   DISP=(NEW,CATLG)\n// DD DSN=C.D\n//S2 EXEC MYPROC\n//D2 DD DSN=&&TMP\n"
PLI = "RPT:\n  PROC OPTIONS(MAIN);\n  /* CALL NO;\n */ PUT LIST('CALL NO');\n  DCL X CHAR(1);\n  CALL LOAD; CALL PRT;\n  %INCLUDE REC;\nLOAD: PROC;\n"


@pytest.fixture(scope="module")
def estate(spark):
    rows = [("a/PAY.cbl", PAY), ("a/EMP.cpy", "       01  EMP-REC.\n       05  EMP-ID PIC 9(6).\n"), ("j/RUN.jcl", JOB), ("p/RPT.pli", PLI), ("x/none.cbl", "")]
    return Estate(classified(spark.createDataFrame(rows, "rel_path string, text string")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cobol(estate):
    c = estate.cobol
    assert rows(c.calls, "target", "line", "dynamic", "mechanism") == [("TAX", 11, False, "CALL"), ("WS-NEXT", 13, True, "CICS-XCTL"), ("WS-NEXT", 21, True, "CALL")]
    assert rows(c.sql_tables, "name", "op") == [("ACCT.T1", "SELECT")]
    assert rows(c.copies, "name", "line") == [("EMP", 5)]
    # A verb with a period alone on a line counts as a paragraph unless it is one of the listed ones.
    assert rows(c.paragraphs, "name", "line") == [("END-EVALUATE", 20), ("MAIN-PARA", 8)]
    assert rows(c.data_items, "name", "level", "pic") == [("EMP-ID", 5, "9(6)"), ("EMP-REC", 1, None), ("WS-RATE", 1, "9(3)V99")]
    assert {r["rel_path"]: r["confidence"] for r in c.programs.collect()} == {"a/PAY.cbl": 0.95, "a/EMP.cpy": 0.9, "x/none.cbl": 0.3}


def test_jcl(estate):
    j = estate.jcl
    assert rows(j.jobs, "name", "line") == [("RUN", 1)]
    assert sorted((r.name, r.line, r.pgm, r.proc) for r in j.steps.collect()) == [("S1", 4, "PAY", None), ("S2", 8, None, "MYPROC")]
    assert sorted((r.name, r.dsn, r.disp) for r in j.dds.collect()) == [("D1", "A.B", "(NEW,CATLG)"), ("D2", None, None)]


def test_pli(estate):
    p = estate.pli
    assert rows(p.procedures, "name", "line", "is_main") == [("LOAD", 7, False), ("RPT", 1, True)]
    assert rows(p.external_calls, "target") == [("PRT",)]
    assert rows(p.includes, "name") == [("REC",)]


def test_findings_and_graph(estate):
    found = {(r.rule_id, r.rel_path, r.line) for r in estate.findings.collect()}
    assert found == {
        ("LL-SEC-002", "j/RUN.jcl", 2),
        ("LL-SEC-004", "a/PAY.cbl", 10),
        ("LL-SEC-005", "a/PAY.cbl", 13),
        ("LL-SEC-005", "a/PAY.cbl", 21),
        ("LL-SEC-008", "a/PAY.cbl", 18),
    }
    types = {r["key"]: r["type"] for r in estate.graph.nodes.collect()}
    assert types["PAY"] == "program" and types["copy:EMP"] == "copybook" and types["A.B"] == "dataset" and types["TAX"] == "external"
    assert {r["name"] for r in estate.graph.orphans.collect()} == {"RPT", "NONE"}


def test_exec_segments_against_a_state_machine(spark):
    rng = random.Random(4)
    pick = ["EXEC SQL SELECT A FROM T", "EXEC CICS LINK", "END-EXEC.", "MOVE A TO B.", "EXEC SQL X END-EXEC.", "'q' EXEC SQL"]
    texts = [[rng.choice(pick) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    expected = set()
    for i, t in enumerate(texts):
        start = None
        for n, x in enumerate(t, 1):
            if start:
                if "END-EXEC" in x:
                    expected.add((f"{i}.cbl", start))
                    start = None
                continue
            m = re.search(r"EXEC\s+(CICS|SQL)\b", x)
            m = m if m and not x.startswith("END-") and "'" not in x[: m.start()] else None
            if m:
                if "END-EXEC" in x:
                    expected.add((f"{i}.cbl", n))
                else:
                    start = n
    files = spark.createDataFrame([(f"{i}.cbl", "\n".join(" " * 7 + x for x in t)) for i, t in enumerate(texts)], "rel_path string, text string")
    got = {(r.rel_path, r.line) for r in Estate(classified(files)).cobol.exec_blocks.collect()}
    assert got == expected


def test_spans(spark):
    lines = ["CALL 'A' DISPLAY 'CALL B' CALL C", "x 'CALL D", "COPY 'a' CALL \"E\"", ""]
    df = spark.createDataFrame([(x,) for x in lines], "c string").select("c", T.outside(F.col("c"), P.CALL, P.QUOTED).alias("m"))
    assert {r.c: r.m for r in df.collect()} == {lines[0]: ["CALL 'A'", "CALL C"], lines[1]: ["CALL D"], lines[2]: ['CALL "E"'], "": []}


def test_lines_and_globs(spark):
    df = spark.createDataFrame([("a", "x\r\ny z\n"), ("b", ""), ("c", "\n\nq")], "rel_path string, text string")
    assert rows(T.lines(df), "rel_path", "line", "raw") == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, ""), ("c", 2, ""), ("c", 3, "q")]
    assert re.match(T.glob_regex("**/t?st/*.cbl"), "a/b/test/x.cbl") and not re.match(T.glob_regex("*.cbl"), "a/x.cbl")


def test_components_against_reachability(spark):
    rng = random.Random(2)
    edges = {(f"n{rng.randint(0, 11)}", f"n{rng.randint(0, 11)}") for _ in range(16)}
    reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    for _ in range(12):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    expected = {}
    for a in reach:
        mates = {b for b in reach[a] if a in reach[b] and b != a}
        if mates:
            expected[a] = min(mates | {a})
    got = {r.key: r.cycle for r in strong_components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert got == expected


def test_index_and_cache(spark):
    stored = spark.createDataFrame([("a", "1", "active"), ("b", "2", "removed"), ("c", "3", "active"), ("d", "4", "removed")], "rel_path string, sha256 string, status string")
    seen = spark.createDataFrame([("a", "9"), ("b", "2"), ("e", "5")], "rel_path string, sha256 string")
    assert {r.rel_path: r.change for r in index.compared(stored, seen).collect()} == {"a": "updated", "b": "updated", "c": "removed", "d": "gone", "e": "added"}


def test_findings_life(spark, estate):
    found = estate.findings
    old = findings.baseline(found.filter("rule_id != 'LL-SEC-008'"))
    assert [r.rule_id for r in findings.new_since(found, old).collect()] == ["LL-SEC-008"]
    assert findings.resolved_since(found, old).count() == 0
    assert findings.gate(found.withColumn("suppressed", F.lit(False)), "high").first()["failed"]
    reply = spark.createDataFrame([("p", 'x [{"title": "t", "severity": "BAD", "line": "-3", "confidence": "9"}]'), ("q", "none")], "rel_path string, reply string")
    assert [(r.severity, r.line, r.confidence) for r in findings.sanitised(reply).collect()] == [("medium", 0, 1.0)]


def test_sources(tmp_path, spark):
    (tmp_path / ".git").mkdir()
    (tmp_path / "_a").mkdir()
    for p in (".git/x.cbl", "_a/y.cbl", "z.tmp"):
        (tmp_path / p).write_text("A")
    found = sources.discover(spark, str(tmp_path), ["*.tmp"])
    assert [tuple(r) for r in sources.read_bytes(found, str(tmp_path)).collect()] == [("_a/y.cbl", b"A")]
    (tmp_path / "s.json").write_text(json.dumps({"suppressions": [{"fingerprint": "f", "reason": "r"}]}))
    assert [tuple(r) for r in sources.suppressions(spark, str(tmp_path / "s.json")).collect()] == [("f", "r")]
    assert sources.fingerprints(spark, str(tmp_path / "none.json")).count() == 0


def test_gateway_and_retrieval(spark):
    g = Gateway({"default": lambda p: "ok"}, max_tokens=4)
    assert g.complete("t", "abcd") == g.complete("t", "abcd") == "ok" and g.spent == 2
    with pytest.raises(BudgetSpent):
        g.complete("t", "x" * 100)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [1.0, 1.0])], "rel_path string, vector array<double>")
    assert [r.rel_path for r in retrieval.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "d"]
    text = spark.createDataFrame([("api_key=abc Authorization: Bearer zz sk-abcdefgh1",)], "t string").select(emit.redacted(F.col("t"))).first()[0]
    assert "abc" not in text.replace("abcdefgh", "") and "zz" not in text


def test_all_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(301)] + [(301, None), (302, []), (303, [1.0]), (304, [1.0, None, 2.0]), (350, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if a and b and None not in a + b and len(a) == len(b) else 0
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    asked = df.filter("vec_id % 50 = 0")
    expected = {(q, i): cosine(a, b) for q, a in rows if q % 50 == 0 for i, b in rows if i != q}
    got = {(r.query, r.vec_id): r.score for r in retrieval.all_pairs(df, asked, None, "vec_id", "embedding").collect()}
    assert set(got) == set(expected) and all(abs(got[p] - s) < 1e-9 for p, s in expected.items())
    near = retrieval.all_pairs(df, asked, 3, "vec_id", "embedding").collect()
    for q in {q for q, _ in expected}:
        own = sorted((r for r in near if r.query == q), key=lambda r: r.rank)
        best = sorted((s for (a, _), s in expected.items() if a == q), reverse=True)[:3]
        assert [r.rank for r in own] == [1, 2, 3] and all(abs(r.score - s) < 1e-9 for r, s in zip(own, best))
        # Of equal scores the least ids, also where they lie in different blocks.
        ties = sorted((-s, i) for (a, i), s in got.items() if a == q)[:3]
        assert [(-r.score, r.vec_id) for r in own] == ties


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_all_pairs_take_every_50th_row(spark):
    from quarrystone import catalog

    d = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in catalog.vectors(spark, d).collect()}
    got = catalog.QUERIES["search_related"](spark, d).collect()
    assert {r.query for r in got} == {i for i in ids if i % 50 == 0} and len(got) == 3 * len({r.query for r in got})
    assert catalog.QUERIES["cosine_similarity"](spark, d).count() == sum(i % 50 == 0 for i in ids) * (len(ids) - 1)


def test_whole_reports(spark, estate):
    edges = estate.graph.edges.collect()
    got = {r.id: r.row for r in emit.graphml_edges(estate.graph.edges.repartition(3)).collect()}
    order = sorted(edges, key=lambda e: (e.src, e.dst, e.type, e.rel_path, e.line))
    assert edges and got == {f"e{i}": f'<edge id="e{i}" source="{e.src}" target="{e.dst}"><data key="rel">{e.type}</data></edge>' for i, e in enumerate(order)}
    found = findings.with_controls(estate.findings, findings.control_table(spark)).withColumn("suppressed", F.col("rule_id") == "LL-SEC-008")
    rows = {r.fingerprint: r.asDict() for r in found.collect()}
    for r in emit.json_findings(found).collect():
        assert json.loads(r.row) == {c: rows[r.fingerprint][c] for c in emit.FIELDS}
    sarif = {r.fingerprint: json.loads(r.row) for r in emit.sarif_rows(found).collect()}
    assert set(sarif) == set(rows) and any(r["suppressed"] for r in rows.values())
    for f, r in sarif.items():
        own = rows[f]
        assert r.get("suppressions") == ([{"kind": "external"}] if own["suppressed"] else None)
        assert r["properties"] == {k: own["requires_human_review" if k == "requiresHumanReview" else k] for k in r["properties"]} and len(r["properties"]) == 9
        assert r["partialFingerprints"] == {"quarrystone/v1": f} and r["message"]["text"] == f"{own['title']}: {own['rationale']}"
    counts = json.loads(emit.json_summary(found).first().row)
    assert counts["total"] == found.count() == sum(counts["by_severity"].values()) and counts["suppressed"] == found.filter("suppressed").count()


def test_html_counts_all_findings(spark):
    rows = [(s, "R", f"t <{i}> 'x'", "p", i, "CWE-79", None, f"f{i}", i == 1, "why & how", "fix", "e", "rule", 0.5, ["A:1", "B:2"], i == 2) for i, s in enumerate(["low", "high", "low"])]
    kinds = "severity string, rule_id string, title string, rel_path string, line int, cwe string, owasp string, fingerprint string, requires_human_review boolean"
    kinds += ", rationale string, remediation string, evidence string, source string, confidence double, controls array<string>, suppressed boolean"
    found = spark.createDataFrame(rows, kinds)
    page = emit.html_report(found, 2)
    assert "<h1>3 findings</h1>" in page and page.count("<tr") == 2 and "<p>1 further findings are not shown</p>" in page
    assert "t &lt;1&gt; &#x27;x&#x27;" in page and "not shown" not in emit.html_report(found)
    lines = [r.row for r in emit.html_rows(found).collect()]
    assert [x.count("<td>") for x in lines] == [6, 6, 6] and [f"id f{i}<" in x for i, x in zip((1, 0, 2), lines)] == [True] * 3
    assert lines[0] == (
        '<tr><td>high</td><td>R</td><td><a href="https://cwe.mitre.org/data/definitions/79.html">CWE-79</a></td><td><code>p:1</code><br><small>id f1</small></td>'
        '<td><strong>t &lt;1&gt; &#x27;x&#x27;</strong> <span class="review">review</span><br><small>why &amp; how</small><br><small><em>Fix:</em> fix</small>'
        "<br><small><em>Evidence:</em> <code>e</code></small><br><small><em>Controls:</em> A:1, B:2</small></td><td>rule<br><small>conf 0.50</small></td></tr>"
    )
    assert lines[2].startswith("<tr class=off>") and '<span class="supp">suppressed</span>' in lines[2]
    assert "No findings." in emit.html_report(found.limit(0))


def test_custom_rules(spark):
    files = spark.createDataFrame([("a", "cobol", "MOVE 'host.acme' TO X"), ("b", "jcl", "//* host.acme")], "rel_path string, language string, text string")
    got = rules.custom_findings(files, [{"id": "R1", "pattern": r"HOST\.ACME"}]).collect()
    assert [(r.rule_id, r.severity, r.confidence, r.rel_path) for r in got] == [("R1", "medium", 0.8, "a")]


def test_program_pages(estate):
    got = {r.rel_path: r for r in pages.program_pages(estate.cobol, estate.graph).collect()}
    assert set(got) == {"a/PAY.cbl", "a/EMP.cpy", "x/none.cbl"}
    assert (got["a/PAY.cbl"].name, got["a/PAY.cbl"].file_name) == ("PAY", "PAY.md")
    assert got["a/PAY.cbl"].page == """# Program: PAY

*Source:* `a/PAY.cbl`  
*Type:* program · *parse confidence:* 0.95

## Purpose
Program containing 2 paragraph(s), 1 data item(s), 3 CALL(s). (Enable the LLM for a natural-language summary.)

## Dependencies
- CALL → `TAX` (`a/PAY.cbl:11`)
- CICS-XCTL → `WS-NEXT` (`a/PAY.cbl:13`)
- dynamic CALL → `WS-NEXT` (`a/PAY.cbl:21`)
- COPY → `EMP` (`a/PAY.cbl:5`)
- SQL SELECT → table `ACCT.T1` (`a/PAY.cbl:16`)
- **Invoked by job(s):** RUN

## Structure
- **Divisions:** IDENTIFICATION, DATA, PROCEDURE
- **Paragraphs (2):**
  - `MAIN-PARA` (`a/PAY.cbl:8`)
  - `END-EVALUATE` (`a/PAY.cbl:20`)
- **Data items (1):**
  - 01 `WS-RATE` PIC `9(3)V99` (`a/PAY.cbl:6`)

## Business logic
Procedure flow (by paragraph): `MAIN-PARA`, `END-EVALUATE`.

"""
    assert got["a/EMP.cpy"].page.startswith("# Copybook: EMP.cpy\n") and "  - 05 `EMP-ID` PIC `9(6)` (`a/EMP.cpy:2`)\n" in got["a/EMP.cpy"].page
    assert "- _No dependencies detected._\n\n## Structure\n\n## Business logic\n_Not generated (LLM disabled)._\n" in got["x/none.cbl"].page
