"""Findings of line rules, block rules and fact rules, in one pass over the lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import has, lines, strip

INFO = {r[0]: r for r in P.RULES}
ORDER = {r[0]: i for i, r in enumerate(P.RULES, 1)}


#: What the lines that a rule looks at hold: one of these words or a number with a dot before and one behind.
WORDS = ("PASS", "PWD", "SECRET", "API", "EXECUTE", "PREPARE", "DISPLAY", "TRACE", "EXHIBIT", "PUT")
DOTTED = r"[0-9]\.[0-9]"


def may_hold(col: Column, *words: str) -> Column:
    """Whether one of some upper-case words may be in col; true for texts beyond ASCII, as in holds()."""
    found = F.octet_length(col) != F.char_length(col)
    for w in words:
        found = found | F.contains(F.upper(col), F.lit(w))
    return found


def code_lines(files: DataFrame, looked_at: Column | None = None) -> DataFrame:
    """rel_path, language, line, raw, bare: lines without comments; bare has empty literals.

    looked_at: a test of `raw` that picks lines before anything is made of them.
    """
    raw, lang = F.col("raw"), F.col("language")
    rows = lines(files.select("rel_path", "language", "text"))
    if looked_at is not None:
        rows = rows.filter(looked_at)
    rows = rows.filter(
        ~((lang == "cobol") & F.substring(raw, 7, 1).isin("*", "/")) & ~((lang == "jcl") & F.startswith(raw, F.lit("//*")))
    )
    rows = rows.withColumn("raw", F.when(lang == "pli", F.regexp_replace(raw, r"/\*.*?\*/", " ")).otherwise(raw))
    return rows.withColumn("bare", F.regexp_replace("raw", P.QUOTED, "''"))


def is_ipv4(line: Column) -> Column:
    """Whether a line holds four numbers with dots between, none over 255."""
    found = F.regexp_extract_all(line, F.lit("(?iU)" + P.IPV4), F.lit(0))
    return F.exists(found, lambda x: F.forall(F.split(x, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255))


def line_tests() -> dict[str, Column]:
    lang, raw, bare = F.col("language"), F.col("raw"), F.col("bare")
    return {
        "LL-SEC-001": lang.isin("cobol", "pli") & has(bare, P.SECRET) & raw.rlike(P.QUOTED),
        "LL-SEC-002": (lang == "jcl") & has(raw, P.JCL_PASSWORD),
        "LL-SEC-003": (lang == "cobol") & has(raw, P.DYNAMIC_SQL),
        "LL-SEC-004": (lang == "cobol") & has(bare, P.DISPLAY) & has(bare, P.SENSITIVE),
        "LL-SEC-006": is_ipv4(raw),
        "LL-SEC-007": (lang == "cobol") & has(bare, P.DEBUG),
        "LL-SEC-009": (lang == "pli") & has(bare, P.PLI_OUTPUT) & has(bare, P.SENSITIVE),
    }


def described(found: DataFrame) -> DataFrame:
    """Findings (rule_id, rel_path, line, evidence, and title, severity, confidence where they differ) with all columns."""
    value = lambda i: F.try_element_at(F.create_map(*[x for r in P.RULES if r[i] is not None for x in (F.lit(r[0]), F.lit(r[i]))]), F.col("rule_id"))
    text = lambda i: F.try_element_at(F.create_map(*[x for k, v in P.RULE_TEXTS.items() for x in (F.lit(k), F.lit(v[i]))]), F.coalesce("variant", "rule_id"))
    order = F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])
    return found.select(
        "rule_id",
        F.coalesce("title", value(1)).alias("title"),
        F.coalesce("severity", value(2)).alias("severity"),
        value(3).alias("cwe"),
        value(4).alias("owasp"),
        "rel_path",
        "line",
        "evidence",
        F.coalesce("confidence", value(5)).alias("confidence"),
        text(0).alias("rationale"),
        text(1).alias("remediation"),
        F.lit("rule").alias("source"),
        F.lit(False).alias("requires_human_review"),
        order[F.col("rule_id")].alias("rule_ord"),
    )


NOTHING = {"title": "string", "severity": "string", "confidence": "double", "variant": "string"}


def bare_finding(rows: DataFrame, evidence: Column) -> DataFrame:
    return rows.select("rule_id", "rel_path", "line", evidence.alias("evidence"), *[F.lit(None).cast(t).alias(c) for c, t in NOTHING.items()])


def line_findings(files: DataFrame) -> DataFrame:
    """All line rules in one projection: each line's hits are an array that is exploded."""
    hits = F.filter(F.array(*[F.when(test, F.lit(rule)) for rule, test in line_tests().items()]), lambda x: x.isNotNull())
    # Rules on languages other than these look for passwords and addresses only.
    text, raw = F.col("text"), F.col("raw")
    some = files.filter(F.col("language").isin("cobol", "pli") | may_hold(text, "PASS", "PWD") | text.rlike(DOTTED))
    rows = code_lines(some, may_hold(raw, *WORDS) | raw.rlike(DOTTED)).withColumn("rule_id", F.explode(hits))
    return bare_finding(rows, F.substring(strip(F.col("raw")), 1, 200))


def evaluate_findings(files: DataFrame) -> DataFrame:
    """EVALUATE blocks that end without a WHEN OTHER.

    A line's events are its openings, its WHEN OTHER, its ends, in this order. The running depth, kept from falling
    below zero, gives each event its level; within a level an opening begins a group, and the group with an end
    and without a WHEN OTHER is a finding.
    """
    rows = code_lines(files.filter("language = 'cobol'"), may_hold(F.col("raw"), "EVALUATE", "OTHER"))
    times = lambda rx: F.regexp_count("bare", F.lit("(?iU)" + rx))
    events = F.concat(
        F.array_repeat(F.lit("O"), times(P.EVALUATE)),
        F.array_repeat(F.lit("W"), F.when(has(F.col("bare"), P.WHEN_OTHER), 1).otherwise(0)),
        F.array_repeat(F.lit("C"), times(P.END_EVALUATE)),
    )
    seq = rows.select("rel_path", "line", F.posexplode(events).alias("pos", "e"))
    w = Window.partitionBy("rel_path").orderBy("line", "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("e") == "O", 1).when(F.col("e") == "C", -1).otherwise(0)
    seq = seq.withColumn("raw_depth", F.sum(move).over(upto))
    seq = seq.withColumn("depth", F.col("raw_depth") - F.least(F.lit(0), F.min("raw_depth").over(upto)))
    seq = seq.withColumn("level", F.when(F.col("e") == "C", F.coalesce(F.lag("depth").over(w), F.lit(0))).otherwise(F.col("depth"))).filter("level > 0")
    lw = Window.partitionBy("rel_path", "level").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, 0)
    seq = seq.withColumn("grp", F.sum(F.when(F.col("e") == "O", 1).otherwise(0)).over(lw))
    blocks = seq.groupBy("rel_path", "level", "grp").agg(
        F.min(F.when(F.col("e") == "O", F.col("line"))).alias("line"), F.max(F.col("e") == "C").alias("closed"), F.max(F.col("e") == "W").alias("other")
    )
    bad = blocks.filter("closed AND NOT other AND line IS NOT NULL").withColumn("rule_id", F.lit("LL-SEC-008"))
    return bare_finding(bad, F.lit("EVALUATE ... END-EVALUATE with no WHEN OTHER branch"))


def dynamic_findings(calls: DataFrame) -> DataFrame:
    """Calls (rel_path, line, target, dynamic, mechanism) whose target is known at run time only."""
    cics = F.startswith("mechanism", F.lit("CICS"))
    return calls.filter("dynamic").select(
        F.lit("LL-SEC-005").alias("rule_id"),
        "rel_path",
        "line",
        F.when(cics, F.concat(F.col("mechanism"), F.lit(" PROGRAM("), F.col("target"), F.lit(") (resolved at runtime)")))
        .otherwise(F.concat(F.lit("CALL "), F.col("target"), F.lit(" (target resolved at runtime)")))
        .alias("evidence"),
        F.when(cics, F.concat(F.lit("Dynamic CICS program transfer ("), F.col("mechanism"), F.lit(")"))).alias("title"),
        F.when(cics, "low").alias("severity"),
        F.when(cics, 0.4).alias("confidence"),
        F.when(cics, "CICS").alias("variant"),
    )


def findings(files: DataFrame, calls: DataFrame) -> DataFrame:
    """All findings of the built-in rules over files (rel_path, language, text)."""
    return described(line_findings(files).unionByName(evaluate_findings(files)).unionByName(dynamic_findings(calls)))


def checked(rule: dict) -> dict:
    """A pack's rule with all its fields; an id, a pattern that compiles and a known severity are needed."""
    if "id" not in rule or "pattern" not in rule:
        raise ValueError(f"a rule needs id and pattern: {rule}")
    try:
        re.compile(rule["pattern"], re.I)
    except re.error as e:
        raise ValueError(f"rule {rule['id']}: {e}") from e
    severity = str(rule.get("severity", "medium")).lower()
    if severity not in P.SEVERITIES:
        raise ValueError(f"rule {rule['id']}: severity must be one of {P.SEVERITIES}")
    text = lambda name: str(rule[name]) if rule.get(name) else None
    return {
        "id": str(rule["id"]), "pattern": rule["pattern"], "title": str(rule.get("title", rule["id"])), "severity": severity, "cwe": text("cwe"), "owasp": text("owasp"),
        "languages": sorted({str(x).lower() for x in rule.get("languages") or []}), "rationale": text("rationale") or "", "remediation": text("remediation") or "",
        "confidence": float(rule.get("confidence", 0.8)),
    }


def custom_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of a pack's rules, with all columns: patterns on code lines, literals kept; no languages means all."""
    own = [checked(r) for r in rules]
    fields = ("title", "severity", "cwe", "owasp", "confidence", "rationale", "remediation")
    tests = []
    for i, r in enumerate(own, len(ORDER) + 1):
        hit = has(F.col("raw"), r["pattern"])
        if r["languages"]:
            hit = hit & F.col("language").isin(*r["languages"])
        kind = lambda c: "double" if c == "confidence" else "string"
        tests.append(F.when(hit, F.struct(F.lit(r["id"]).alias("rule_id"), *[F.lit(r[c]).cast(kind(c)).alias(c) for c in fields], F.lit(i).alias("rule_ord"))))
    hits = F.filter(F.array(*tests), lambda x: x.isNotNull())
    rows = code_lines(files).select("rel_path", "line", F.substring(strip(F.col("raw")), 1, 200).alias("evidence"), F.explode(hits).alias("h"))
    return rows.select(
        "h.rule_id", "h.title", "h.severity", "h.cwe", "h.owasp", "rel_path", "line", "evidence", "h.confidence", "h.rationale", "h.remediation",
        F.lit("rule").alias("source"), F.lit(False).alias("requires_human_review"), "h.rule_ord",
    )


#: Names under which the built-in rules go.
BUILT_IN = ("cwe", "owasp")


def run_packs(files: DataFrame, calls: DataFrame, packs: list[str], registry: dict[str, list[dict]] | None = None) -> DataFrame:
    """Findings of the packs named, each rule once; unknown names have no rules. registry: further packs by name."""
    out = None
    if any(p in BUILT_IN and p not in (registry or {}) for p in packs):
        out = findings(files, calls)
    own: list[dict] = []
    for p in packs:
        own += [r for r in (registry or {}).get(p, []) if r not in own]
    if own:
        more = custom_findings(files, own)
        out = more if out is None else out.unionByName(more)
    return findings(files, calls).limit(0) if out is None else out
