"""Whole Markdown pages: one row per COBOL program or copybook."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import emit

if TYPE_CHECKING:
    from .cobol import Cobol
    from .graph import Graph



def _joined(lines: DataFrame, name: str) -> DataFrame:
    """rel_path and the lines (columns at, line and row) of each file as one array in order; a file's lines bound it."""
    return lines.groupBy("rel_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line", "row"))), lambda x: x["row"]).alias(name))


def _place(line: str = "line") -> Column:
    return F.concat(F.lit(" (`"), F.col("rel_path"), F.lit(":"), F.col(line).cast("string"), F.lit("`)"))


def dependencies(cobol: "Cobol", graph: "Graph", named: DataFrame) -> DataFrame:
    """rel_path and array of what a program depends on and what depends on it; named: rel_path and name."""
    at = F.when(F.startswith("row", F.lit("- COPY")), 2).when(F.startswith("row", F.lit("- SQL")), 3).otherwise(1)
    own = emit.dependency_lines(cobol.calls, cobol.copies, cobol.sql_tables).select("rel_path", at.alias("at"), "line", "row")
    # Of a name's two rows, callers come before jobs.
    back = named.join(emit.reverse_lines(graph.reverse), "name").select(
        "rel_path", F.when(F.contains("row", F.lit("**Called by:**")), 4).otherwise(5).alias("at"), F.lit(0).alias("line"), "row"
    )
    return _joined(own.unionByName(back), "dependencies")


def structure(cobol: "Cobol") -> DataFrame:
    """rel_path and array of divisions, paragraphs and data items."""
    divisions = cobol.divisions.groupBy("rel_path").agg(
        F.concat(F.lit("- **Divisions:** "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda d: d["name"]), ", ")).alias("row")
    )
    heads = [divisions.select("rel_path", F.lit(1).alias("at"), F.lit(0).alias("line"), "row")]
    for at, table, word in ((2, cobol.paragraphs, "Paragraphs"), (4, cobol.data_items, "Data items")):
        head = F.concat(F.lit(f"- **{word} ("), F.count(F.lit(1)).cast("string"), F.lit("):**"))
        heads.append(table.groupBy("rel_path").agg(head.alias("row")).select("rel_path", F.lit(at).alias("at"), F.lit(0).alias("line"), "row"))
    quoted = F.concat(F.lit("`"), F.col("name"), F.lit("`"))
    pic = F.when(F.coalesce("pic", F.lit("")) != "", F.concat(F.lit(" PIC `"), F.col("pic"), F.lit("`"))).otherwise("")
    paragraphs = cobol.paragraphs.select("rel_path", F.lit(3).alias("at"), "line", F.concat(F.lit("  - "), quoted, _place()).alias("row"))
    items = cobol.data_items.select(
        "rel_path", F.lit(5).alias("at"), "line", F.concat(F.lit("  - "), F.lpad(F.col("level").cast("string"), 2, "0"), F.lit(" "), quoted, pic, _place()).alias("row")
    )
    every = paragraphs.unionByName(items)
    for h in heads:
        every = every.unionByName(h)
    return _joined(every, "structure")


def _kind() -> Column:
    return F.when(F.col("is_copybook"), "Copybook").otherwise("Program")


def _named(cobol: "Cobol") -> DataFrame:
    base = F.element_at(F.split("rel_path", "/"), -1)
    return cobol.programs.withColumn("name", F.coalesce("program_id", base))


def artifacts(cobol: "Cobol") -> DataFrame:
    """name, type and file_name of every COBOL file's page, without the page."""
    return _named(cobol).select("name", F.lower(_kind()).alias("type"), emit.doc_name(F.col("name")).alias("file_name"))


def program_pages(cobol: "Cobol", graph: "Graph") -> DataFrame:
    """rel_path, name, file_name and page (Markdown) of every COBOL file; a file without facts has a page that says so.

    Facts are grouped by file and the files' arrays joined by path, so a page is made where its file's facts are.
    """
    programs = _named(cobol)
    calls = cobol.calls.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_calls"))
    met = (
        programs.join(calls, "rel_path", "left")
        .join(dependencies(cobol, graph, programs.select("rel_path", "name")), "rel_path", "left")
        .join(structure(cobol), "rel_path", "left")
        .join(emit.business_lines(cobol.paragraphs).withColumnRenamed("row", "flow"), "rel_path", "left")
    )
    kind = _kind()
    head = F.array(
        F.concat(F.lit("# "), kind, F.lit(": "), F.col("name")),
        F.lit(""),
        F.concat(F.lit("*Source:* `"), F.col("rel_path"), F.lit("`  ")),
        F.concat(F.lit("*Type:* "), F.lower(kind), F.lit(" · *parse confidence:* "), F.format_number("confidence", 2)),
        F.lit(""),
    )
    none = F.array().cast("array<string>")
    bodies = {
        "Purpose": F.array(emit.fallback_purpose(kind, F.col("n_paragraphs"), F.col("n_items"), F.coalesce("n_calls", F.lit(0)))),
        "Dependencies": F.coalesce("dependencies", F.array(F.lit("- _No dependencies detected._"))),
        "Structure": F.coalesce("structure", none),
        "Business logic": F.array(F.coalesce("flow", F.lit("_Not generated (LLM disabled)._"))),
    }
    sections = [F.concat(F.array(F.lit(f"## {title}")), body, F.array(F.lit(""))) for title, body in bodies.items()]
    page = F.concat(F.array_join(F.concat(head, *sections), "\n"), F.lit("\n"))
    return met.select("rel_path", "name", emit.doc_name(F.col("name")).alias("file_name"), page.alias("page"))
