"""A file is the unit of work: its facts are made where it is read, and its patterns fit as they do line by line."""

from contextlib import redirect_stdout
from io import StringIO

import pytest

from quarrystone.operators import cobol, documents, jcl
from quarrystone.operators.classify import classified
from quarrystone.operators.cobol import Cobol
from quarrystone.operators.jcl import Jcl
from quarrystone.plans import estate as plans
from quarrystone.plans.estate import Estate


def plan(df):
    said = StringIO()
    with redirect_stdout(said):
        df.explain()
    return said.getvalue()


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("a.cbl", "       PROGRAM-ID. A.\n       PROCEDURE DIVISION.\n       M.\n           EXEC SQL\n           SELECT X FROM T\n           EXEC SQL END-EXEC.\n           CALL 'B'.\n           CALL 'X\".\n           EXEC CICS LINK PROGRAM('C') END-EXEC\n           CALL W.\n           EXEC SQL\n           CALL 'NO'.\n"),
        ("b.cpy", "       01 A.\n"),
        ("a.jcl", "//  DISP=SHR\n//A JOB X\n//D0 DD DSN=LOST\n//S EXEC PGM=A\n//* DD\n//D DD DSN=D.S,\n//   DISP=\n// OLD\n//E FOO\n//B JOB\n//D2 DD\n//T EXEC PGM=B"),
        ("c.jcl", ""),
    ]
    return classified(spark.createDataFrame(rows, "rel_path string, text string"))


@pytest.mark.parametrize("module, make", [(cobol, lambda f: Cobol(f.filter("language = 'cobol'")).placed), (jcl, lambda f: Jcl(f.filter("language = 'jcl'")).statements)])
def test_facts_of_files_shuffle_nothing(files, monkeypatch, module, make):
    seen = []
    monkeypatch.setattr(module, "materialise", lambda df, name: seen.append(df) or df)
    assert make(files).count() and len(seen) == 1
    assert "Exchange" not in plan(seen[0]) and "Window" not in plan(seen[0])


def test_edges_shuffle_nothing(files, monkeypatch):
    from quarrystone.operators import graph

    seen = []
    monkeypatch.setattr(graph, "materialise", lambda df, name: seen.append(df) or df)
    edges = Estate(files.filter("language != 'pli'")).graph.edges
    got = {(r.src, r.dst, r.type, r.line) for r in edges.collect()}
    assert got == {("A", "table:T", "sql", 4), ("A", "B", "call", 7), ("A", "C", "cics", 9), ("A", "W", "dynamic_call", 10),
                   ("job:B", "A", "exec", 4), ("job:B", "D.S", "dd", 6), ("job:B", "B", "exec", 12)}
    cobol_and_jcl = plan(seen[0])
    assert "rel_path" in cobol_and_jcl and cobol_and_jcl.count("SortMergeJoin") + cobol_and_jcl.count("BroadcastHashJoin") <= 6  # those of PL/I


def test_statements_and_steps(files):
    j = Jcl(files.filter("language = 'jcl'"))
    assert {(r.rel_path, r.name, r.line) for r in j.jobs.collect()} == {("a.jcl", "B", 10), ("c.jcl", "C", 0)}
    assert [(r.line, r.name, r.step, r.dsn, r.disp) for r in j.dds.orderBy("line").collect()] == [(6, "D", 1, "D.S", None), (11, "D2", 1, None, None)]
    assert {(r.line, r.name, r.step) for r in j.steps.collect()} == {(4, "S", 1), (12, "T", 2)}


def test_the_overview_is_sorted_once(files):
    e = Estate(files)
    page = documents.overview("demo", e.graph, e.findings, e.cobol.programs.selectExpr("rel_path AS name", "'program' AS type", "rel_path AS file_name"))
    assert plan(page).count("rangepartitioning") == 1


def test_each_language_is_read_by_all_cores(spark, monkeypatch):
    monkeypatch.setattr(plans, "_RENDERED", {})
    rendered = Estate.rendered(spark, "/root/testdata/sf0.001")
    for language in ("cobol", "jcl"):
        used = [r.n for r in rendered.of(language).groupBy(plans.F.spark_partition_id()).agg(plans.F.count(plans.F.lit(1)).alias("n")).collect()]
        assert len(used) >= spark.sparkContext.defaultParallelism and max(used) < sum(used) / 2
