"""Facts of COBOL sources, by column expressions and windows over a file's lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import all_groups, group, has, holds, lines, outside, rstrip, split_lines, with_lines
from ..sources.storage import materialise


def so_far(to: int = 0) -> WindowSpec:
    """A file's lines up to this one, or up to the one before."""
    return Window.partitionBy("rel_path").orderBy("line").rowsBetween(Window.unboundedPreceding, to)


def _fixed(each: Column) -> tuple[Column, Column]:
    """The first 60 lines that aren't blank, and whether they (as column `full`) are in fixed format."""
    full = F.slice(F.filter(each, lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]")), 1, 60)
    head = lambda x: F.substring(x, 1, 6)
    fits = F.filter("full", lambda x: (F.length(x) >= 7) & ((head(x) == " " * 6) | head(x).rlike(r"(?U)^(?:[\s\x1c-\x1f]+|[\s\x1c-\x1f]*\d+[\s\x1c-\x1f]*)$")))
    return full, F.when(F.size("full") == 0, True).otherwise(F.size(fits) / F.size("full") >= 0.7)


def fixed_format(files: DataFrame) -> DataFrame:
    """files with `fixed`: of the first 60 lines that aren't blank, 70 % have blank or numeric columns 1 to 6."""
    full, fixed = _fixed(split_lines(F.col("text")))
    return files.withColumn("full", full).withColumn("fixed", fixed).drop("full")


def _comment(raw: Column) -> Column:
    return F.when(F.col("fixed"), F.substring(raw, 7, 1).isin("*", "/")).otherwise(raw.rlike(r"(?U)^[\s\x1c-\x1f]*\*"))


def _code(raw: Column) -> Column:
    return rstrip(F.when(F.col("fixed"), F.substring(raw, 8, 65)).otherwise(F.regexp_replace(raw, r"\*>.*$", "")))


def code_lines(files: DataFrame) -> DataFrame:
    """rel_path, kind, line, raw, fixed, code of all lines that hold code."""
    raw = F.col("raw")
    known = fixed_format(files).select("rel_path", "kind", "fixed", "text")
    return lines(known).filter(~_comment(raw)).withColumn("code", _code(raw)).filter(F.col("code") != "")


#: A call of a literal that is all of its line, which therefore holds one call and begins it outside literals.
LONE_CALL = r"""(?i)^ *CALL +(['"])([A-Z0-9$#@_-]+)\1 *\.?$"""


#: The first program id's and every division's line, behind a line end, the line's number and \r, in a text of such lines.
WITHIN = r"[\s&&[^\n\r]]"
NUMBERED_ID = r"(?iU)\n(\d+\r" + P.PROGRAM_ID[1:].replace(r"\s", WITHIN) + ")"
NUMBERED_DIVISION = r"(?iU)\n(\d+\r" + P.DIVISION[1:].replace(r"\s", WITHIN) + ")"


def _after(col: Column, sign: str) -> Column:
    """What follows the first such sign."""
    return F.substring(col, F.locate(sign, col) + 1, F.lit(2**31 - 1))


#: A file and what names it.
NAMED = ("rel_path", "program_id", "is_copybook")


@dataclass
class Cobol:
    """Fact tables of files (rel_path, kind, text)."""

    files: DataFrame

    @cached_property
    def facts(self) -> DataFrame:
        """Code lines outside EXEC blocks with division and class (what: L), closed EXEC blocks (B) and files (F).

        Every row has rel_path and its file's program_id and is_copybook. A file is the unit of work, so nothing is
        shuffled: its lines are joined with signs between them that end lines, which no line holds, and split there.

        Ends of blocks cut a file into segments; in a segment, the first line that starts a block and doesn't end
        one opens it, and all lines from there on belong to it. Only a segment that an end closes has a block; where
        none was opened, a last line that starts and ends one is a block.
        """
        known, each = with_lines(self.files.select("rel_path", "kind", "text"))
        full, fixed = _fixed(each)
        known = known.withColumn("full", full).withColumn("fixed", fixed).drop("full")
        coded = F.transform(each, lambda x, i: F.struct(F.concat((i + 1).cast("string"), F.lit("\r")).alias("at"), F.when(~_comment(x), _code(x)).alias("code")))

        def marked(c: Column) -> Column:
            code = c["code"]
            starts, ends = has(code, P.EXEC), has(code, P.END_EXEC, "END-EXEC")
            sign = F.when(starts & ends, "\x1d").when(starts, "\x1c").otherwise("")
            plain = F.concat(c["at"], code)
            return F.when(holds(code, "EXEC"), F.concat(sign, plain, F.when(ends, "\x0b").otherwise("\n"))).otherwise(F.concat(plain, F.lit("\n")))

        known = known.select("rel_path", "kind", F.filter(coded, lambda c: c["code"] != "").alias("coded"))
        known = known.select("rel_path", "kind", F.split(F.array_join(F.transform("coded", marked), ""), "\x0b").alias("segs"))
        before = F.concat(F.lit("\n"), F.array_join(F.transform("segs", lambda s: F.substring_index(s, "\x1c", 1)), "\n"))
        block = lambda s: F.translate(F.when(F.contains(s, F.lit("\x1c")), _after(s, "\x1c")).when(F.contains(s, F.lit("\x1d")), _after(s, "\x1d")), "\x1c\x1d", "")
        blocks = F.filter(F.transform(F.slice("segs", 1, F.size("segs") - 1), block), lambda b: b.isNotNull())
        known = known.select("rel_path", "kind", before.alias("plain"), blocks.alias("blocks"))
        known = known.select(
            "rel_path", "kind", "blocks",
            F.split(F.nullif(F.regexp_extract("plain", NUMBERED_ID, 1), F.lit("")), "\r").alias("first_pid"),
            F.split(F.regexp_replace("plain", NUMBERED_DIVISION, "\x0b$2\r$1"), "\x0b").alias("groups"),
        )
        name = F.upper(group(F.col("first_pid")[1], P.PROGRAM_ID))
        has_id = F.exists(F.slice("groups", 2, 2**31 - 1), lambda g: F.upper(F.substring_index(g, "\r", 1)).isin("IDENTIFICATION", "ID"))
        copybook = F.when(F.col("kind") == "copybook", True).when(F.col("kind") == "program", False).otherwise(
            F.col("first_pid").isNull() & ~F.coalesce(has_id, F.lit(False))
        )
        known = known.select("rel_path", name.alias("program_id"), copybook.alias("is_copybook"), F.col("first_pid")[0].cast("int").alias("pid_line"), "groups", "blocks")
        part = lambda what, body, div=None: F.struct(F.lit(what).alias("what"), F.lit(None).cast("string").alias("division") if div is None else div.alias("division"), body.alias("body"))
        own = F.transform("groups", lambda g, i: part("L", F.when(i > 0, _after(g, "\r")).otherwise(g), F.when(i > 0, F.upper(F.substring_index(g, "\r", 1)))))
        none = F.array(part("F", F.lit("")))
        every = F.concat(none, F.coalesce(own, F.slice(none, 1, 0)), F.coalesce(F.transform("blocks", lambda b: part("B", b)), F.slice(none, 1, 0)))
        kept = ["rel_path", "program_id", "is_copybook", "pid_line"]
        rows = known.select(*kept, F.explode(every).alias("g")).select(*kept, "g.what", "g.division", "g.body")
        body = F.when(F.col("what") == "L", F.split("body", "\n")).otherwise(F.array("body"))
        rows = rows.select(*kept, "what", "division", F.posexplode(body).alias("pos", "body")).filter(~F.col("what").eqNullSafe("L") | (F.col("body") != "") & ~F.startswith("body", F.lit("\x1d")))
        named = F.when(F.col("division") == "ID", "IDENTIFICATION").otherwise(F.col("division"))
        line = F.substring_index("body", "\r", 1).try_cast("int")
        rows = rows.select(
            *kept, "what", named.alias("division"), F.when(F.col("pos") == 0, named).alias("new_division"), line.alias("line"), _after(F.col("body"), "\r").alias("code")
        )
        code, is_line = F.col("code"), F.col("what") == "L"
        plain = is_line & F.col("new_division").isNull() & ~F.col("line").eqNullSafe(F.col("pid_line"))
        section = F.when(F.col("plain"), F.upper(group(code, P.SECTION, word="SECTION")))
        rows = rows.withColumn("plain", plain).withColumn("section", section)
        rest = F.col("plain") & F.col("section").isNull()
        lettered = F.upper(F.substring(F.ltrim(code), 1, 1)).between("A", "Z")
        item = rest & (F.coalesce("division", F.lit("")) != "PROCEDURE") & ~lettered & has(code, P.DATA_ITEM)
        label = F.endswith(code, F.lit(".")) & ~F.contains(code, F.lit("'")) & ~F.contains(code, F.lit('"'))
        name = F.when(rest & (F.col("division") == "PROCEDURE") & label, F.upper(group(code, P.PARAGRAPH)))
        rows = rows.withColumn("is_item", item).withColumn("_name", name)
        # Every fact table starts here.
        return materialise(rows.withColumn("paragraph", F.when(~F.col("_name").isin(*P.NOT_PARAGRAPHS), F.col("_name"))).drop("_name", "pid_line"), "cobol")

    @cached_property
    def placed(self) -> DataFrame:
        return self.facts.filter("what = 'L'")

    @cached_property
    def blocks(self) -> DataFrame:
        """exec_blocks with what names their file."""
        return self.facts.filter("what = 'B'").select(
            *NAMED, "line", F.upper(group(F.substring_index("code", "\n", 1), P.EXEC)).alias("exec_kind"), F.regexp_replace("code", "\n\\d+\r", " ").alias("block")
        )

    @cached_property
    def exec_blocks(self) -> DataFrame:
        """rel_path, line (of the start), exec_kind, block text."""
        return self.blocks.drop(*NAMED[1:])

    @cached_property
    def cics_calls(self) -> DataFrame:
        return self.cics_named.drop(*NAMED[1:])

    @cached_property
    def cics_named(self) -> DataFrame:
        text = F.col("block")
        literal, variable = group(text, P.CICS_PROGRAM, 1), group(text, P.CICS_PROGRAM, 2)
        return (
            self.blocks.filter(F.col("exec_kind") == "CICS")
            .select(*NAMED, "line", group(text, P.CICS_TRANSFER).alias("verb"), literal.alias("literal"), F.coalesce(literal, variable).alias("target"))
            .filter(F.col("verb").isNotNull() & F.col("target").isNotNull())
            .select(*NAMED, "line", F.upper("target").alias("target"), F.col("literal").isNull().alias("dynamic"), F.concat(F.lit("CICS-"), F.upper("verb")).alias("mechanism"))
        )

    @cached_property
    def sql_tables(self) -> DataFrame:
        return self.sql_named.drop(*NAMED[1:])

    @cached_property
    def sql_named(self) -> DataFrame:
        named = lambda op, rx: F.transform(all_groups(F.col("block"), rx), lambda n: F.struct(F.upper(n).alias("name"), F.lit(op).alias("op")))
        found = F.array_distinct(F.concat(*[named(op, rx) for op, rx in P.SQL_OPERATIONS]))
        return (
            self.blocks.filter(F.col("exec_kind") == "SQL")
            .select(*NAMED, "line", F.explode(found).alias("t"))
            .select(*NAMED, "line", "t.name", "t.op")
            .filter(~F.col("name").isin(*P.SQL_STOP_WORDS))
        )

    @cached_property
    def divisions(self) -> DataFrame:
        return self.placed.filter("new_division IS NOT NULL").groupBy("rel_path", F.col("new_division").alias("name")).agg(F.min("line").alias("line"))

    @cached_property
    def sections(self) -> DataFrame:
        return self.placed.filter("section IS NOT NULL").select("rel_path", "line", F.col("section").alias("name"))

    @cached_property
    def copies(self) -> DataFrame:
        return self.copies_named.drop(*NAMED[1:])

    @cached_property
    def copies_named(self) -> DataFrame:
        found = F.explode(outside(F.col("code"), P.COPY, P.QUOTED)).alias("m")
        rows = self.placed.filter(F.col("plain") & holds(F.col("code"), "COPY"))
        return rows.select(*NAMED, "line", found).select(*NAMED, "line", F.upper(group(F.col("m"), P.COPY)).alias("name"))

    @cached_property
    def plain_calls(self) -> DataFrame:
        return self.calls_named.drop(*NAMED[1:])

    @cached_property
    def calls_named(self) -> DataFrame:
        m, code, lone = F.col("m"), F.col("code"), F.col("lone")
        rows = self.placed.filter(F.col("plain") & holds(code, "CALL")).select(*NAMED, "line", "code", F.regexp_extract("code", LONE_CALL, 2).alias("lone"))
        found = rows.select(*NAMED, "line", "lone", F.explode(F.when(lone != "", F.array(lone)).otherwise(outside(code, P.CALL, P.QUOTED))).alias("m"))
        literal = F.when(lone != "", lone).otherwise(F.coalesce(group(m, P.CALL, 1), group(m, P.CALL, 2)))
        found = found.select(*NAMED, "line", "m", literal.alias("literal"))
        return found.select(
            *NAMED, "line", F.upper(F.coalesce("literal", group(m, P.CALL, 3))).alias("target"), F.col("literal").isNull().alias("dynamic"), F.lit("CALL").alias("mechanism")
        )

    @cached_property
    def calls(self) -> DataFrame:
        return self.plain_calls.unionByName(self.cics_calls)

    @cached_property
    def data_items(self) -> DataFrame:
        code = F.col("code")
        return self.placed.filter("is_item").select(
            "rel_path", "line", group(code, P.DATA_ITEM, 1).cast("int").alias("level"), F.upper(group(code, P.DATA_ITEM, 2)).alias("name"), group(group(code, P.DATA_ITEM, 3), P.PIC).alias("pic")
        )

    @cached_property
    def paragraphs(self) -> DataFrame:
        # A division's start ends the section; the last of both events says where a line stands.
        event = F.when(F.col("new_division").isNotNull(), "").otherwise(F.col("section"))
        inside = F.nullif(F.last(event, True).over(so_far()), F.lit(""))
        told = self.placed.filter("new_division IS NOT NULL OR section IS NOT NULL OR paragraph IS NOT NULL")
        return told.withColumn("in_section", inside).filter("paragraph IS NOT NULL").select("rel_path", "line", F.col("paragraph").alias("name"), F.col("in_section").alias("section"))

    @cached_property
    def programs(self) -> DataFrame:
        """One row per file: program_id, is_copybook, confidence, warning, and counts."""
        told = self.facts.filter("what = 'F' OR is_item OR paragraph IS NOT NULL")
        full = told.groupBy(*NAMED).agg(F.count_if("is_item").alias("n_items"), F.count("paragraph").alias("n_paragraphs"))
        confidence = (
            F.when(F.col("is_copybook"), F.when(F.col("n_items") > 0, 0.9).otherwise(0.5))
            .when(F.col("program_id").isNotNull(), F.when(F.col("n_paragraphs") > 0, 0.95).otherwise(0.8))
            .otherwise(0.3)
        )
        return full.withColumn("confidence", confidence)
