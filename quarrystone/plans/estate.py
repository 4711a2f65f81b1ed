"""An estate's fact tables, graph and findings, built lazily from its files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as life
from ..operators import rules
from ..operators.classify import classified
from ..operators.cobol import Cobol
from ..operators.graph import Graph
from ..operators.jcl import Jcl
from ..operators.pli import Pli
from ..sources import estate as rendering
from ..sources.storage import materialise


_RENDERED: dict[tuple[str, str], "Estate"] = {}


@dataclass
class Estate:
    """files: rel_path, text, language, kind, method."""

    files: DataFrame

    @classmethod
    def rendered(cls, spark: SparkSession, sf_dir: str) -> "Estate":
        """The estate rendered from tables; a session renders each once and keeps its tables in the shared folder."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _RENDERED:
            # A table for each language, so that the readers of one share out its files and no other's.
            cobol, jcl, pli = (materialise(classified(files), "files") for files in rendering.by_language(spark, sf_dir))
            _RENDERED[key] = cls(cobol.unionByName(jcl).unionByName(pli))
        return _RENDERED[key]

    def of(self, language: str) -> DataFrame:
        return self.files.filter(F.col("language") == language)

    @cached_property
    def cobol(self) -> Cobol:
        return Cobol(self.of("cobol"))

    @cached_property
    def jcl(self) -> Jcl:
        return Jcl(self.of("jcl"))

    @cached_property
    def pli(self) -> Pli:
        return Pli(self.of("pli"))

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.cobol, self.jcl, self.pli)

    @cached_property
    def findings(self) -> DataFrame:
        return materialise(life.fingerprinted(rules.findings(self.files, self.cobol.calls)), "findings")

    @cached_property
    def totals(self) -> DataFrame:
        """One row of the counts an analysis reports."""
        c, j, p = self.cobol, self.jcl, self.pli
        one = c.programs.agg(
            F.count_if(~F.col("is_copybook")).alias("programs"),
            F.count_if("is_copybook").alias("copybooks"),
            F.coalesce(F.sum("n_paragraphs"), F.lit(0)).alias("paragraphs"),
            F.coalesce(F.sum("n_items"), F.lit(0)).alias("data_items"),
            F.count_if(F.col("confidence") < 0.5).alias("low_confidence"),
        )
        for name, table in (
            ("calls", c.calls), ("copies", c.copies), ("sql_tables", c.sql_tables), ("jcl_jobs", j.jobs), ("jcl_steps", j.steps),
            ("pli_programs", p.programs), ("pli_procedures", p.procedures),
        ):
            one = one.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row each
        return one
