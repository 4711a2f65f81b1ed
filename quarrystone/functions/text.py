"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a text's lines end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANK = r"[\s\x1c-\x1f]"


def holds(col: Column, word: str) -> Column:
    """Whether an upper-case word may be in col; true for texts beyond ASCII, whose cases fold in more ways."""
    return F.contains(F.upper(col), F.lit(word)) | (F.octet_length(col) != F.char_length(col))


def has(col: Column, pattern: str, word: str = "") -> Column:
    """word: what every match holds; where it is missing, the pattern isn't tried."""
    found = col.rlike("(?iU)" + pattern)
    return holds(col, word) & found if word else found


def group(col: Column, pattern: str, n: int = 1, word: str = "") -> Column:
    """Group n of the first match; null where it doesn't match or is empty. word: as in has()."""
    found = F.nullif(F.regexp_extract(col, "(?iU)" + pattern, n), F.lit(""))
    return F.when(holds(col, word), found) if word else found


def all_groups(col: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit("(?iU)" + pattern), F.lit(n))


def visible(col: Column, at: int) -> Column:
    """Whether the character at a place (1: first, -1: last) is of visible ASCII, which no pattern of blanks fits."""
    return F.substring(col, at, 1).between("!", "~")


def strip(col: Column) -> Column:
    return F.when(visible(col, 1) & visible(col, -1), col).otherwise(_strip(col))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def rstrip(col: Column) -> Column:
    return F.when(visible(col, -1), col).otherwise(F.regexp_replace(col, rf"(?U){BLANK}+$", ""))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 text, bad bytes replaced, all line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def with_lines(files: DataFrame) -> tuple[DataFrame, Column]:
    """files without text and with its parts, and the array of a text's lines as an expression of these.

    The split is a column of its own, since an expression is worked out again wherever it is used; the lines aren't a
    column, since exploding one makes Spark look for empty ones beforehand and so work out twice what leads there.
    """
    rest = [c for c in files.columns if c != "text"]
    parts = F.col("_parts")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select(*rest, F.split("text", LINE_END, -1).alias("_parts")), kept


def lines(files: DataFrame) -> DataFrame:
    """One row per line: all columns of files but text, with line (from 1) and raw."""
    rest = [c for c in files.columns if c != "text"]
    split, kept = with_lines(files)
    return split.select(*rest, F.posexplode(kept).alias("pos", "raw")).select(*rest, (F.col("pos") + 1).alias("line"), "raw")


def member(rel_path: Column) -> Column:
    """File name without its last extension, upper-cased."""
    return F.upper(F.regexp_replace(F.regexp_extract(rel_path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def spans(col: Column, pattern: str) -> Column:
    """Matches as (v, at): the match and its start from 0, found by adding up the gaps and matches before it."""
    found = all_groups(col, pattern, 0)
    gaps = F.split(col, "(?iU)" + pattern, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + F.length(v))
    return F.transform(
        found, lambda v, i: F.struct(v.alias("v"), (total(F.slice(gaps, 1, i + 1)) + total(F.slice(found, 1, i))).alias("at"))
    )


def outside(col: Column, pattern: str, literals: str) -> Column:
    """Matches of pattern that don't begin inside a literal."""
    quoted = spans(col, literals)
    kept = F.filter(
        spans(col, pattern),
        lambda m: ~F.exists(quoted, lambda q: (m["at"] >= q["at"]) & (m["at"] < q["at"] + F.length(q["v"]))),
    )
    return F.when(has(col, pattern), F.transform(kept, lambda m: m["v"])).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** any, **/ any folders, * and ? within one name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "_/ " else pattern[i]), i + 1
    return f"(?s)^{out}$"


def excluded(rel_path: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded: a glob fits it, its file name, or one of its folders."""
    name = F.regexp_extract(rel_path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | rel_path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
        if p.endswith("/**"):
            hit = hit | rel_path.rlike(glob_regex(p[:-3])[:-1] + "/")
    return hit
