"""The life of findings: fingerprints, controls, suppressions, baselines, gates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import FRAMEWORKS, SEVERITIES


def rank(column: str = "severity"):
    """A severity's rank; 0 for an unknown one."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column)) - 1, F.lit(0)).cast("int")


def fingerprinted(found: DataFrame) -> DataFrame:
    """found with a fingerprint that doesn't depend on the line."""
    parts = F.concat_ws("|", "rule_id", "rel_path", F.coalesce("cwe", F.lit("")), "title", "evidence")
    return found.withColumn("fingerprint", F.substring(F.sha1(parts), 1, 16))


def control_table(spark: SparkSession, frameworks: dict[str, dict[str, list[str]]] = FRAMEWORKS) -> DataFrame:
    """cwe, control of some frameworks; as large as their specification, so it may be broadcast."""
    rows = [(cwe, f"{name}:{c}") for name, cwes in frameworks.items() for cwe, controls in cwes.items() for c in controls]
    return spark.createDataFrame(rows, "cwe string, control string")


def with_controls(found: DataFrame, controls: DataFrame) -> DataFrame:
    """found with its controls, distinct and in order."""
    per_cwe = controls.groupBy(F.col("cwe").alias("_cwe")).agg(F.array_sort(F.collect_set("control")).alias("controls"))
    met = found.join(F.broadcast(per_cwe), F.upper(F.col("cwe")) == F.col("_cwe"), "left").drop("_cwe")
    return met.withColumn("controls", F.coalesce("controls", F.array().cast("array<string>")))


def suppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """found (with fingerprint) with the mark suppressed."""
    known = suppressions.select(F.col("fingerprint").alias("_fp")).distinct().withColumn("_s", F.lit(True))
    return found.join(known, found["fingerprint"] == known["_fp"], "left").withColumn("suppressed", F.coalesce("_s", F.lit(False))).drop("_fp", "_s")


def add_suppressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists; what is known already keeps its reason."""
    w = Window.partitionBy("fingerprint").orderBy("_o", "reason")
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_o", "_r")


def baseline(found: DataFrame) -> DataFrame:
    return found.select("fingerprint").distinct()


def new_since(found: DataFrame, old: DataFrame) -> DataFrame:
    """One finding per fingerprint that the baseline lacks: the last one."""
    w = Window.partitionBy("fingerprint").orderBy(F.desc("rel_path"), F.desc("line"), F.desc("rule_ord"))
    return found.join(old.select("fingerprint"), "fingerprint", "left_anti").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def diff_listing(found: DataFrame, old: DataFrame) -> DataFrame:
    """What is new since a baseline, gravest first: severity, place, title and fingerprint."""
    return new_since(found, old).orderBy(F.desc(rank()), "rel_path", "line", "fingerprint").select("severity", "rel_path", "line", "title", "fingerprint")


def resolved_since(found: DataFrame, old: DataFrame) -> DataFrame:
    return old.select("fingerprint").distinct().join(found.select("fingerprint"), "fingerprint", "left_anti")


def gate(found: DataFrame, fail_on: str) -> DataFrame:
    """n findings that aren't suppressed and reach a severity, and whether they fail the gate."""
    least = SEVERITIES.index(fail_on) if fail_on in SEVERITIES else 0
    return found.filter(~F.col("suppressed") & (rank() >= least)).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("failed"))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("requires_human_review")).alias("review"),
        F.count_if(F.col("suppressed")).alias("suppressed"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )


def control_counts(found: DataFrame) -> DataFrame:
    """control, n over findings that aren't suppressed; those without a control count as `unmapped`."""
    names = F.when(F.size("controls") == 0, F.array(F.lit("unmapped"))).otherwise(F.col("controls"))
    return found.filter(~F.col("suppressed")).select(F.explode(names).alias("control")).groupBy("control").agg(F.count(F.lit(1)).alias("n"))


def sanitised(replies: DataFrame) -> DataFrame:
    """Advisory findings of model replies (rel_path, reply): the JSON array in each, with every value brought into range.

    Items without a title are no findings.
    """
    fields = "title string, severity string, line string, confidence string, rationale string, remediation string, cwe string, owasp string"
    array = F.regexp_extract("reply", r"(?s)\[.*\]", 0)
    rows = replies.select("rel_path", F.explode(F.from_json(array, f"array<struct<{fields}>>")).alias("f")).filter("f.title IS NOT NULL")
    conf = F.coalesce(F.col("f.confidence").try_cast("double"), F.lit(0.5))
    severity = F.lower(F.col("f.severity"))
    short = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 1000)
    return rows.select(
        F.lit("LLM-ADVISORY").alias("rule_id"),
        F.substring("f.title", 1, 200).alias("title"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"),
        F.nullif(F.col("f.cwe"), F.lit("")).alias("cwe"),
        F.nullif(F.col("f.owasp"), F.lit("")).alias("owasp"),
        "rel_path",
        F.when(F.col("f.line").rlike(r"^\d+$"), F.col("f.line").try_cast("int")).otherwise(0).alias("line"),
        F.lit("(LLM-identified; verify against source)").alias("evidence"),
        short("f.rationale").alias("rationale"),
        short("f.remediation").alias("remediation"),
        F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.lit("llm").alias("source"),
        F.lit(True).alias("requires_human_review"),
    )
