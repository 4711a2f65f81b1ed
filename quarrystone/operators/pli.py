"""Facts of PL/I sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import all_groups, group, has, lines, member


@dataclass
class Pli:
    """Fact tables of files (rel_path, text)."""

    files: DataFrame

    @cached_property
    def scanned(self) -> DataFrame:
        """rel_path and text without comments and with empty literals."""
        bare = F.regexp_replace("text", r"(?s)/\*.*?\*/", " ")
        return self.files.select("rel_path", F.regexp_replace(bare, P.QUOTED, "''").alias("text"))

    @cached_property
    def procedures(self) -> DataFrame:
        """rel_path, line, name, is_main; a label and its keyword may stand on two lines.

        Each match is rewritten in place, with its line ends behind it, so that a split gives the label's line.
        """
        marked = F.regexp_replace("text", "(?iU)" + P.PLI_PROCEDURE, "\u0001$1\u0002$3\u0003$2")
        rows = self.scanned.select("rel_path", F.posexplode(F.split(marked, "\n", -1)).alias("pos", "row"))
        found = rows.select("rel_path", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("row", F.lit("\u0001([^\u0003]*)\u0003"), F.lit(1))).alias("m"))
        head = F.substring_index("m", "\u0002", 1)
        return found.select("rel_path", "line", F.upper(head).alias("name"), has(F.col("m"), P.PLI_MAIN).alias("is_main"))

    @cached_property
    def rows(self) -> DataFrame:
        return lines(self.scanned)

    @cached_property
    def calls(self) -> DataFrame:
        return self.rows.select("rel_path", "line", F.explode(all_groups(F.col("raw"), P.PLI_CALL)).alias("t")).select("rel_path", "line", F.upper("t").alias("target"))

    @cached_property
    def includes(self) -> DataFrame:
        return self.rows.select("rel_path", "line", F.explode(all_groups(F.col("raw"), P.PLI_INCLUDE)).alias("t")).select("rel_path", "line", F.upper("t").alias("name"))

    @cached_property
    def declares(self) -> DataFrame:
        return self.rows.groupBy("rel_path").agg(F.sum(F.regexp_count("raw", F.lit("(?iU)" + P.PLI_DECLARE))).cast("long").alias("declares"))

    @cached_property
    def programs(self) -> DataFrame:
        """rel_path, name: the first main procedure, else the first, else the member's name."""
        first = self.procedures.groupBy("rel_path").agg(
            F.min_by("name", F.when(F.col("is_main"), F.col("line"))).alias("main"), F.min_by("name", "line").alias("any")
        )
        return self.files.select("rel_path").join(first, "rel_path", "left").select(
            "rel_path", F.coalesce("main", "any", F.nullif(member(F.col("rel_path")), F.lit(""))).alias("name")
        )

    @cached_property
    def external_calls(self) -> DataFrame:
        """Calls whose target is no procedure of the same file."""
        own = self.procedures.select("rel_path", F.col("name").alias("target")).distinct()
        return self.calls.join(own, ["rel_path", "target"], "left_anti")


__all__ = ["Pli", "group"]
