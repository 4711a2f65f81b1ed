"""Facts of JCL members."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import group, member, strip, visible, with_lines
from ..sources.storage import materialise


#: A statement behind a line end, its line's number and \r, in a text of such statements.
STATEMENT = r"(?iU)\n(\d+)\r//(\S+)[\s&&[^\n\r]]+(JOB|EXEC|DD)\b[\s&&[^\n\r]]*([^\n]*)"


@dataclass
class Jcl:
    """Fact tables of files (rel_path, text)."""

    files: DataFrame

    @cached_property
    def parsed(self) -> DataFrame:
        """rel_path, job, step, line, name, verb, rest of all statements; one row without a verb for each member's job.

        A member is the unit of work, so nothing is shuffled: its cards are joined into statements, and those into
        steps, with line ends between them, which no line holds, and split there.
        """
        known, each = with_lines(self.files.select("rel_path", "text"))
        card = lambda x: F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("//*"))
        start = lambda x, at: F.concat(F.lit("\n"), at, F.lit("\r"), x)
        number = lambda i: (i + 1).cast("string")

        def placed(x: Column, at: Column) -> Column:
            tail = F.trim(F.substring(x, 3, 2**31 - 1))
            goes_on = F.substring(x, 3, 1).rlike(r"(?U)^[\s\x1c-\x1f]") | (strip(tail) == "")
            return F.when(~visible(x, 3) & goes_on, F.concat(F.lit(" "), strip(tail))).otherwise(start(x, at))

        joined = F.array_join(F.transform(each, lambda x, i: F.when(card(x), placed(x, number(i)))), "")
        # A first card starts a statement in any case.
        cards = F.filter(F.transform(each, lambda x, i: F.struct(number(i).alias("at"), x.alias("x"))), lambda c: card(c["x"]))
        slow = F.array_join(F.transform(cards, lambda c, i: F.when(i == 0, start(c["x"], c["at"])).otherwise(placed(c["x"], c["at"]))), "")
        known = known.select("rel_path", "_parts", joined.alias("joined"))
        whole = F.when(F.startswith("joined", F.lit(" ")), slow).otherwise(F.col("joined"))
        known = known.select("rel_path", F.regexp_replace(whole, STATEMENT, "\n$1\r$2\r$3\r$4").alias("read"))
        last = F.split(F.regexp_extract("read", r"(?is)^.*\n(\d+\r[^\r\n]+)\rJOB\r", 1), "\r")
        known = known.withColumn("last", last)
        name = F.coalesce(F.upper(F.try_element_at("last", F.lit(2))), F.nullif(member(F.col("rel_path")), F.lit("")))
        head = F.concat(F.coalesce(F.nullif(F.try_element_at("last", F.lit(1)), F.lit("")), F.lit("0")), F.lit("\r\r\r"))
        steps = F.split(F.regexp_replace("read", r"(?i)\n(\d+\r[^\r\n]+\rEXEC\r)", "\x0b$1"), "\x0b")
        known = known.select("rel_path", name.alias("job"), head.alias("head"), steps.alias("steps"))
        rows = known.select("rel_path", "job", "head", F.posexplode(F.coalesce("steps", F.array(F.lit("")))).alias("step", "s"))
        rows = rows.select("rel_path", "job", "step", F.explode(F.split(F.when(F.col("step") == 0, F.concat("head", F.col("s"))).otherwise(F.col("s")), "\n")).alias("s"))
        part = F.split("s", "\r")
        made = rows.select("rel_path", "job", F.col("step").cast("long").alias("step"), part.alias("p")).filter(F.size("p") == 4)
        at = lambda i: F.col("p")[i]
        made = made.select("rel_path", "job", "step", at(0).cast("int").alias("line"), F.upper(at(1)).alias("name"), F.nullif(F.upper(at(2)), F.lit("")).alias("verb"), at(3).alias("rest"))
        # Every fact table starts here.
        return materialise(made, "jcl")

    @cached_property
    def statements(self) -> DataFrame:
        """rel_path, line, name, verb, rest: statements with their continuation lines; a first line always starts one."""
        return self.numbered.select("rel_path", "line", "name", "verb", "rest")

    @cached_property
    def jobs(self) -> DataFrame:
        """rel_path, name, line: the last JOB card, else the member's name and line 0."""
        return self.parsed.filter("verb IS NULL").select("rel_path", F.col("job").alias("name"), "line")

    @cached_property
    def numbered(self) -> DataFrame:
        return self.parsed.filter("verb IS NOT NULL")

    @cached_property
    def steps(self) -> DataFrame:
        return self.run.drop("job")

    @cached_property
    def run(self) -> DataFrame:
        """Steps with their job's name."""
        rest = F.col("rest")
        pgm, proc = F.upper(group(rest, P.PGM)), F.upper(group(rest, P.PROC))
        word = strip(F.split(strip(rest), ",", 2)[0])
        positional = F.when(pgm.isNull() & proc.isNull() & (word != "") & ~F.contains(word, F.lit("=")), F.upper(word))
        return self.numbered.filter("verb = 'EXEC'").select("job", "rel_path", "line", "name", "step", pgm.alias("pgm"), F.coalesce(proc, positional).alias("proc"))

    @cached_property
    def dds(self) -> DataFrame:
        return self.data.drop("job")

    @cached_property
    def data(self) -> DataFrame:
        """DD statements of steps with their job's name."""
        rest = F.col("rest")
        return self.numbered.filter("verb = 'DD' AND step > 0").select(
            "job", "rel_path", "line", "name", "step", F.upper(group(rest, P.DSN)).alias("dsn"), group(rest, P.DISP).alias("disp")
        )

    @cached_property
    def links(self) -> DataFrame:
        """rel_path, line, link (exec or dd) and target."""
        return self.linked.drop("job")

    @cached_property
    def linked(self) -> DataFrame:
        """Links with their job's name."""
        programs = self.run.filter("pgm IS NOT NULL").select("job", "rel_path", "line", F.lit("exec").alias("link"), F.col("pgm").alias("target"))
        return programs.unionByName(self.data.filter("dsn IS NOT NULL").select("job", "rel_path", "line", F.lit("dd").alias("link"), F.col("dsn").alias("target")))
