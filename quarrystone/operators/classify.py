"""Language and kind of files, by extension and by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import EXTENSIONS
from ..functions.text import BLANK, split_lines

#: Bytes of a file that are looked at.
SAMPLE = 8192


def by_extension(rel_path: Column) -> Column:
    """A struct (language, kind) for a known extension, else null."""
    ext = F.lower(F.regexp_extract(rel_path, r"[^/](\.[^./]*)$", 1))
    pairs = [x for e, (lang, kind) in EXTENSIONS.items() for x in (F.lit(e), F.struct(F.lit(lang).alias("language"), F.lit(kind).alias("kind")))]
    return F.try_element_at(F.create_map(*pairs), ext)


def by_content(sample: Column) -> Column:
    """A struct (language, kind) for what a text sample shows, else null; the first test that fits wins."""
    rows = split_lines(sample)
    head = F.upper(F.array_join(F.slice(rows, 1, 200), "\n"))
    whole = F.upper(sample)
    full = F.slice(F.filter(rows, lambda x: x.rlike(rf"(?U)[^\s\x1c-\x1f]")), 1, 50)
    has_any = lambda text, *words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    jcl = F.exists(full, lambda x: F.startswith(x, F.lit("//"))) & has_any(head, " JOB", " EXEC", " DD ", "EXEC PGM")
    cobol = has_any(whole, "IDENTIFICATION DIVISION", "PROGRAM-ID")
    pli = has_any(whole, "PROCEDURE OPTIONS", "PROC OPTIONS") | F.contains(F.replace(whole, F.lit(" "), F.lit("")), F.lit("OPTIONS(MAIN)"))
    found = lambda lang, kind: F.struct(F.lit(lang).alias("language"), F.lit(kind).alias("kind"))
    return F.when(jcl, found("jcl", "job")).when(cobol, found("cobol", "program")).when(pli, found("pli", "program"))


def classified(files: DataFrame) -> DataFrame:
    """files (rel_path, text) with language, kind and method: extension, content or unknown."""
    sample = F.substring("text", 1, SAMPLE)
    binary = F.contains(sample, F.lit("\0"))
    ext, content = by_extension(F.col("rel_path")), F.when(~binary, by_content(sample))
    return files.withColumn("_e", ext).withColumn("_c", F.when(F.col("_e").isNull(), content)).select(
        *files.columns,
        F.coalesce("_e.language", "_c.language").alias("language"),
        F.coalesce("_e.kind", "_c.kind", F.lit("unknown")).alias("kind"),
        F.when(F.col("_e").isNotNull(), "extension").when(F.col("_c").isNotNull(), "content").otherwise("unknown").alias("method"),
    )


__all__ = ["BLANK", "SAMPLE", "by_content", "by_extension", "classified"]
