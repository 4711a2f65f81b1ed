"""The dependency multigraph: nodes, edges and structural analyses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import member
from ..sources.storage import materialise
from .cobol import Cobol
from .jcl import Jcl
from .pli import Pli

#: Edges that make a cycle, and those that make a program used.
CYCLE_TYPES = ("call", "copy", "cics")
USE_TYPES = ("call", "exec", "cics")


def cobol_key() -> Column:
    """A COBOL file's key, from what names it."""
    book = member(F.col("rel_path"))
    return F.when(F.col("is_copybook"), F.concat(F.lit("copy:"), book)).otherwise(F.coalesce("program_id", book))


@dataclass
class Graph:
    cobol: Cobol
    jcl: Jcl
    pli: Pli

    @cached_property
    def cobol_names(self) -> DataFrame:
        """rel_path, key, name, type of COBOL files."""
        own = self.cobol.facts.filter("what = 'F'")
        book = member(F.col("rel_path"))
        name = F.when(F.col("is_copybook"), book).otherwise(F.coalesce("program_id", book))
        kind = F.when(F.col("is_copybook"), "copybook").otherwise("program")
        return own.select("rel_path", cobol_key().alias("key"), name.alias("name"), kind.alias("type"))

    @cached_property
    def defined(self) -> DataFrame:
        """key, name, type, defined of all keys that are defined; of a key's definitions, the highest rank gives the type."""
        ranked = lambda rows, rank, kind, key, name="name": rows.select(F.expr(key).alias("key"), F.expr(name).alias("name"), F.lit(kind).alias("type") if kind else "type", F.lit(rank).alias("rank"))
        every = ranked(self.cobol_names, 1, None, "key")
        for rows in (
            ranked(self.pli.programs, 2, "program", "name"),
            ranked(self.jcl.jobs, 3, "job", "concat('job:', name)"),
            # Many steps and blocks name the same data; each once is enough.
            ranked(self.jcl.dds.filter("dsn IS NOT NULL"), 4, "dataset", "dsn", "dsn").distinct(),
            ranked(self.cobol.sql_tables, 3, "table", "concat('table:', name)").distinct(),
        ):
            every = every.unionByName(rows)
        known = every.groupBy("key").agg(F.min_by("name", "rank").alias("name"), F.max_by("type", "rank").alias("type"))
        return materialise(known.withColumn("defined", F.lit(True)), "definitions")

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, type, rel_path, line: a bag."""
        src = cobol_key().alias("src")
        copy = self.cobol.copies_named.select(src, F.concat(F.lit("copy:"), "name").alias("dst"), F.lit("copy").alias("type"), "rel_path", "line")
        kind = F.when(F.startswith("mechanism", F.lit("CICS")), "cics").when(F.col("dynamic"), "dynamic_call").otherwise("call")
        calls = self.cobol.calls_named.unionByName(self.cobol.cics_named)
        call = calls.select(src, F.col("target").alias("dst"), kind.alias("type"), "rel_path", "line")
        sql = self.cobol.sql_named.select(src, F.concat(F.lit("table:"), "name").alias("dst"), F.lit("sql").alias("type"), "rel_path", "line")
        pli = self.pli.programs.select("rel_path", F.col("name").alias("src"))
        pcall = self.pli.external_calls.join(pli, "rel_path").select("src", F.col("target").alias("dst"), F.lit("call").alias("type"), "rel_path", "line")
        pcopy = self.pli.includes.join(pli, "rel_path").select("src", F.concat(F.lit("copy:"), "name").alias("dst"), F.lit("copy").alias("type"), "rel_path", "line")
        job = F.concat(F.lit("job:"), "job").alias("src")
        link = self.jcl.linked.select(job, F.col("target").alias("dst"), F.col("link").alias("type"), "rel_path", "line")
        made = copy
        for more in (call, sql, pcall, pcopy, link):
            made = made.unionByName(more)
        return materialise(made, "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        """key, name, type, defined."""
        return self.defined.unionByName(self.external)

    @cached_property
    def external(self) -> DataFrame:
        """Targets that nothing defines; their name is what follows the key's first colon."""
        missing = self.edges.select(F.col("dst").alias("key")).distinct().join(self.defined.select("key"), "key", "left_anti")
        named = missing.select("key", F.regexp_replace("key", "^[^:]*:", "").alias("name"), F.lit("external").alias("type"), F.lit(False).alias("defined"))
        return materialise(named, "external")

    @cached_property
    def in_degree(self) -> DataFrame:
        counts = self.edges.groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return self.nodes.select("key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("in_degree"))

    @cached_property
    def adjacency(self) -> DataFrame:
        """key and its call targets in order, joined by blanks; empty for nodes without."""
        out = self.edges.filter("type = 'call'").groupBy(F.col("src").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("targets"))
        return self.nodes.select("key").join(out, "key", "left").select("key", F.coalesce("targets", F.lit("")).alias("targets"))

    @cached_property
    def self_loops(self) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*CYCLE_TYPES) & (F.col("src") == F.col("dst"))).select(F.col("src").alias("key")).distinct()

    def cycles(self) -> DataFrame:
        """key, cycle: members of strongly connected components of over one node; cycle is the least key in it."""
        return strong_components(self.edges.filter(F.col("type").isin(*CYCLE_TYPES)).select("src", "dst"))

    @cached_property
    def orphans(self) -> DataFrame:
        used = self.edges.filter(F.col("type").isin(*USE_TYPES)).select(F.col("dst").alias("key"))
        return self.nodes.filter("type = 'program' AND defined").join(used, "key", "left_anti").select("name")

    @cached_property
    def unused_copybooks(self) -> DataFrame:
        used = self.edges.filter("type = 'copy'").select(F.col("dst").alias("key"))
        return self.nodes.filter("type = 'copybook' AND defined").join(used, "key", "left_anti").select("name")

    @cached_property
    def reverse(self) -> DataFrame:
        """name, callers and jobs of programs that have any: distinct names in order."""
        src = self.nodes.select(F.col("key").alias("src"), F.col("name").alias("user"))
        dst = self.nodes.select(F.col("key").alias("dst"), "name")
        met = self.edges.filter("type IN ('call', 'exec')").join(src, "src").join(dst, "dst")
        names = lambda t: F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("user")))), ",")
        return met.groupBy("name").agg(names("call").alias("callers"), names("exec").alias("jobs"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that touch a node no cycle can go through; each round drops what has no way in or no way on."""
    n = edges.count()
    while n:
        goes_on, comes_in = edges.select(F.col("src").alias("dst")), edges.select(F.col("dst").alias("src"))
        edges = materialise(edges.join(goes_on, "dst", "left_semi").join(comes_in, "src", "left_semi").select("src", "dst"), "trimmed")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """key, cycle for every component of over one node.

    After trimming, each node takes the greatest key that reaches it; a node that is its own greatest is a root, and
    its component is what reaches it among the nodes of its colour. Found components leave, and the rest goes on.
    Every step is a join on shared tables; nothing comes to the driver but counts.
    """
    edges = trimmed(materialise(edges.filter("src != dst").distinct(), "edges"))
    found = None
    while not edges.isEmpty():
        colour = materialise(edges.select(F.col("src").alias("key"), F.col("src").alias("c")).distinct(), "colours")
        while True:
            reach = edges.join(colour, edges["src"] == colour["key"]).groupBy("dst").agg(F.max("c").alias("up"))
            step = colour.join(reach, colour["key"] == reach["dst"], "left").select("key", F.greatest("c", "up").alias("c"), (F.col("up") > F.col("c")).alias("moved"))
            step = materialise(step, "colours")
            done = step.filter("moved").isEmpty()
            colour = step.select("key", "c")
            if done:
                break
        own = colour.select(F.col("key").alias("src"), F.col("c").alias("cs"))
        other = colour.select(F.col("key").alias("dst"), F.col("c").alias("cd"))
        inner = materialise(edges.join(own, "src").join(other, "dst").filter("cs = cd").select("src", "dst", "cs"), "inner")
        got = materialise(colour.filter("key = c").select("key", "c"), "component")
        n = got.count()
        while True:
            back = inner.join(got.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"), F.col("cs").alias("c"))
            got = materialise(got.unionByName(back).distinct(), "component")
            more = got.count()
            if more == n:
                break
            n = more
        found = got if found is None else found.unionByName(got)
        gone = got.select("key")
        rest = edges.join(gone, edges["src"] == gone["key"], "left_anti")
        rest = rest.join(gone, rest["dst"] == gone["key"], "left_anti")
        edges = trimmed(materialise(rest, "edges"))
    if found is None:
        return edges.select(F.col("src").alias("key"), F.col("dst").alias("cycle")).limit(0)
    named = found.groupBy("c").agg(F.min("key").alias("cycle"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(named, "c").select("key", "cycle")
