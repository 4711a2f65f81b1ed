"""The queries over the driver's tables, by name, and the SQL that each is held against.

Estate queries go tables -> rendered text -> extraction; their SQL states the facts from the tables alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import cobol, emit, findings, gateway, index, pages, retrieval, rules
from .operators import documents as reports
from .operators.classify import classified
from .plans.estate import Estate
from .sources.storage import shared_dir
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Facts of the rendered estate, stated from the tables.
FACTS = r"""
WITH part_k AS (SELECT p_partkey AS k, 'P' || p_partkey AS pname, 'cobol/P' || p_partkey || '.cbl' AS path FROM part),
ring AS (
  SELECT k, path, pname, (k - 1) - (k - 1) % 7 + ((k - 1) % 7 + 1) % 7 + 1 AS follower,
         ((k - 1) // 7) % 2 = 0 AND (k - 1) - (k - 1) % 7 + 7 <= (SELECT max(p_partkey) FROM part) AS is_ring FROM part_k
),
supp AS (
  SELECT l_partkey AS k, l_suppkey AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
),
plain_calls AS (
  SELECT path AS rel_path, 13 AS line, 'WS-PGM-NAME' AS target, true AS dynamic, 'CALL' AS mechanism, pname FROM part_k WHERE k % 3 = 0
  UNION ALL SELECT path, 24, CASE WHEN is_ring THEN 'P' || follower ELSE 'S' || (k % 5 + 1) END, false, 'CALL', pname FROM ring
  UNION ALL SELECT path, 25, pname, false, 'CALL', pname FROM part_k WHERE k % 17 = 0
  UNION ALL SELECT path, 26 + rn, 'S' || s, false, 'CALL', pname FROM supp JOIN part_k USING (k)
),
cics_calls AS (
  SELECT path AS rel_path, 14 AS line, 'S' || (k % 10 + 1) AS target, false AS dynamic, 'CICS-LINK' AS mechanism, pname FROM part_k WHERE k % 4 = 0
  UNION ALL SELECT path, 14, 'WS-PGM-NAME', true, 'CICS-XCTL', pname FROM part_k WHERE k % 4 = 1
),
calls AS (SELECT * FROM plain_calls UNION ALL SELECT * FROM cics_calls),
sql_tables AS (
  SELECT path AS rel_path, 14 AS line, 'T' || (k % 13) AS name, CASE WHEN k % 4 = 2 THEN 'SELECT' ELSE 'INSERT' END AS op, pname FROM part_k WHERE k % 4 IN (2, 3)
  UNION ALL SELECT path, 14, 'U' || (k % 3), 'JOIN', pname FROM part_k WHERE k % 4 = 2
  UNION ALL SELECT path, 14, 'V' || (k % 2), 'SELECT', pname FROM part_k WHERE k % 4 = 3
),
leaf AS (SELECT s_suppkey AS n, 'S' || s_suppkey AS pname, 'cobol/S' || s_suppkey || '.cbl' AS path FROM supplier WHERE s_suppkey % 10 <> 0),
book AS (
  SELECT 'N' || n_nationkey AS name, 'cobol/N' || n_nationkey || '.cpy' AS path FROM nation
  UNION ALL SELECT 'Z' || r_regionkey, 'cobol/Z' || r_regionkey || '.cpy' FROM region
),
step AS (
  SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS k, o_custkey AS c, 'jcl/O' || l_orderkey || '.jcl' AS path,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey
),
inner_n AS (
  SELECT n_regionkey AS r, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation
),
edges AS MATERIALIZED (
  SELECT pname AS src, 'copy:N' || (k % 25) AS dst, 'copy' AS type, path AS rel_path, 6 AS line FROM part_k
  UNION ALL SELECT pname, target, CASE WHEN mechanism <> 'CALL' THEN 'cics' WHEN dynamic THEN 'dynamic_call' ELSE 'call' END, rel_path, line FROM calls
  UNION ALL SELECT pname, 'table:' || name, 'sql', rel_path, line FROM sql_tables
  UNION ALL SELECT 'job:J' || o, 'P' || k, 'exec', path, 3 + 3 * r FROM step
  UNION ALL SELECT 'job:J' || o, 'CUST.C' || c, 'dd', path, 4 + 3 * r FROM step
  UNION ALL SELECT 'R' || r_regionkey, 'copy:NINC' || r_regionkey, 'copy', 'pli/R' || r_regionkey || '.pli', 4 FROM region
  UNION ALL SELECT 'R' || r, 'N_' || n, 'call', 'pli/R' || r || '.pli', 8 + rn FROM inner_n
),
defined AS MATERIALIZED (
  SELECT pname AS key, pname AS name, 'program' AS type FROM part_k UNION ALL SELECT pname, pname, 'program' FROM leaf
  UNION ALL SELECT 'copy:' || name, name, 'copybook' FROM book UNION ALL SELECT 'job:J' || o_orderkey, 'J' || o_orderkey, 'job' FROM orders
  UNION ALL SELECT DISTINCT 'CUST.C' || c, 'CUST.C' || c, 'dataset' FROM step
  UNION ALL SELECT DISTINCT 'table:' || name, name, 'table' FROM sql_tables UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 'program' FROM region
),
external AS MATERIALIZED (
  SELECT DISTINCT dst AS key, regexp_replace(dst, '^[^:]*:', '') AS name, 'external' AS type FROM edges WHERE dst NOT IN (SELECT key FROM defined)
),
nodes AS MATERIALIZED (SELECT *, true AS defined FROM defined UNION ALL SELECT *, false FROM external),
found AS (
  SELECT 'LL-SEC-001' AS rule_id, 'Hard-coded credential or secret' AS title, 'high' AS severity, 'CWE-798' AS cwe, path AS rel_path, 11 AS line,
         'MOVE ''hunter2'' TO WS-PASSWORD.' AS evidence FROM part_k WHERE k % 7 = 0
  UNION ALL SELECT 'LL-SEC-002', 'Hard-coded password in JCL', 'high', 'CWE-798', 'jcl/O' || o_orderkey || '.jcl', 1,
         '//J' || o_orderkey || ' JOB (ACCT),CLASS=A,PASSWORD=PW' || (o_orderkey % 7) FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT 'LL-SEC-003', 'Possible SQL injection via dynamic SQL', 'high', 'CWE-89', path, 17, 'EXEC SQL EXECUTE IMMEDIATE :STMT END-EXEC.' FROM part_k WHERE k % 6 = 0
  UNION ALL SELECT 'LL-SEC-004', 'Sensitive data written to log/output', 'medium', 'CWE-532', path, 12, 'DISPLAY WS-CARD-NO.' FROM part_k WHERE k % 5 = 0
  UNION ALL SELECT 'LL-SEC-005', 'Dynamic program CALL', 'medium', 'CWE-94', path, 13, 'CALL WS-PGM-NAME (target resolved at runtime)' FROM part_k WHERE k % 3 = 0
  UNION ALL SELECT 'LL-SEC-005', 'Dynamic CICS program transfer (CICS-XCTL)', 'low', 'CWE-94', path, 14, 'CICS-XCTL PROGRAM(WS-PGM-NAME) (resolved at runtime)' FROM part_k WHERE k % 4 = 1
  UNION ALL SELECT 'LL-SEC-006', 'Hard-coded IP address', 'low', 'CWE-1051', path, 22, 'MOVE ''10.0.' || (k % 300) || '.7'' TO WS-HOST.' FROM part_k WHERE k % 11 = 0 AND k % 300 <= 255
  UNION ALL SELECT 'LL-SEC-007', 'Active debug code left in source', 'low', 'CWE-489', path, 23, 'READY TRACE.' FROM part_k WHERE k % 9 = 0
  UNION ALL SELECT 'LL-SEC-008', 'EVALUATE without WHEN OTHER (missing default case)', 'medium', 'CWE-478', path, 18, 'EVALUATE ... END-EVALUATE with no WHEN OTHER branch' FROM part_k WHERE k % 2 = 1
  UNION ALL SELECT 'LL-SEC-009', 'Sensitive data written to output', 'medium', 'CWE-532', 'pli/R' || r_regionkey || '.pli', 6, 'PUT LIST(CARD_NO);' FROM region WHERE r_regionkey % 2 = 0
),
fp AS (
  SELECT *, substr(sha1(rule_id || '|' || rel_path || '|' || coalesce(cwe, '') || '|' || title || '|' || evidence), 1, 16) AS fingerprint FROM found
),
controls(cwe, control) AS (
  VALUES ('CWE-798', 'PCI-DSS:8.6.2'), ('CWE-259', 'PCI-DSS:8.6.2'), ('CWE-89', 'PCI-DSS:6.2.4'), ('CWE-532', 'PCI-DSS:3.3.1'), ('CWE-532', 'PCI-DSS:10.2.1'),
         ('CWE-94', 'PCI-DSS:6.2.4'), ('CWE-798', 'NIST-800-53:IA-5'), ('CWE-259', 'NIST-800-53:IA-5'), ('CWE-89', 'NIST-800-53:SI-10'),
         ('CWE-94', 'NIST-800-53:SI-10'), ('CWE-532', 'NIST-800-53:AU-9'), ('CWE-532', 'NIST-800-53:SI-11'), ('CWE-489', 'NIST-800-53:SA-15'),
         ('CWE-478', 'NIST-800-53:SI-10'), ('CWE-1051', 'NIST-800-53:CM-6')
)
"""


def query(name: str, sql: str | None = None, facts: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (FACTS + sql) if facts else sql
        return f

    return add


def from_estate(name: str, make: Callable[[Estate], DataFrame], sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: make(Estate.rendered(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: rel_path, language, kind, text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("lang").alias("language"), F.lit("text").alias("kind"), "text"
    )


DOCS = """WITH d AS (SELECT 'doc/' || doc_id AS rel_path, lang AS language, text, doc_id FROM documents),
l AS (
  SELECT rel_path, language, u.line, u.raw FROM (SELECT rel_path, language, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END AS t FROM d WHERE text <> ''),
  LATERAL (SELECT unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS line) u
)
"""
IP_SQL = r"regexp_matches(raw, '\b(?:(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])\.){3}(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])\b')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the built-in line rules over free text, by severity."""
    found = rules.described(rules.line_findings(documents(spark, sf_dir)))
    return findings.fingerprinted(found).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("n_fingerprints"))


# --- sources and lines -----------------------------------------------------------------------------
query(
    "lines_explode", DOCS + "SELECT rel_path, count(*) AS n_lines, sum(length(raw))::BIGINT AS n_chars, max(line)::BIGINT AS last_line FROM l GROUP BY rel_path", False
)(lambda s, d: T.lines(documents(s, d)).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"), F.max("line").cast("long").alias("last_line")))
query(
    "filter_exclude_glob",
    "SELECT rel_path FROM (SELECT 'cobol/P' || p_partkey || '.cbl' AS rel_path FROM part UNION ALL SELECT 'cobol/S' || s_suppkey || '.cbl' FROM supplier WHERE s_suppkey % 10 <> 0)"
    " WHERE NOT regexp_matches(rel_path, '^cobol/P[0-9]*7\\.cbl$') AND NOT starts_with(rel_path, 'cobol/S1')",
    False,
)(lambda s, d: Estate.rendered(s, d).files.filter("kind = 'program' AND language = 'cobol'").select("rel_path").filter(~T.excluded(F.col("rel_path"), ["P*7.cbl", "**/S1*.cbl"])))
query("scan_active_by_language", "SELECT rel_path, language FROM (SELECT 'doc/' || doc_id AS rel_path, lang AS language, doc_id FROM documents) WHERE doc_id % 7 <> 0 AND language = 'de'", False)(
    lambda s, d: documents(s, d).withColumn("status", F.when(F.substring("rel_path", 5, 20).cast("long") % 7 == 0, "removed").otherwise("active")).filter("status = 'active' AND language = 'de'").select("rel_path", "language")
)
query("hash_content", "SELECT 'doc/' || doc_id AS rel_path, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents", False)(
    lambda s, d: documents(s, d).select("rel_path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
)

# --- classification --------------------------------------------------------------------------------
from_estate(
    "classify_extension", lambda e: e.files.groupBy("language", "kind", "method").agg(F.count(F.lit(1)).alias("n")),
    """SELECT 'cobol' AS language, 'program' AS kind, 'extension' AS method, (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) AS n
    UNION ALL SELECT 'cobol', 'copybook', 'extension', count(*) FROM book UNION ALL SELECT 'jcl', 'job', 'extension', count(*) FROM orders
    UNION ALL SELECT 'pli', 'program', 'extension', count(*) FROM region""",
)


def unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate without file extensions, and with its documents."""
    files = Estate.rendered(spark, sf_dir).files.select(F.regexp_replace("rel_path", r"\.[a-z]+$", "").alias("rel_path"), "text")
    return classified(files.unionByName(documents(spark, sf_dir).select("rel_path", "text")))


query(
    "classify_content",
    FACTS + """SELECT 'cobol' AS language, 'program' AS kind, 'content' AS method, (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) AS n
    UNION ALL SELECT 'jcl', 'job', 'content', count(*) FROM orders UNION ALL SELECT 'pli', 'program', 'content', count(*) FROM region
    UNION ALL SELECT NULL, 'unknown', 'unknown', (SELECT count(*) FROM documents) + (SELECT count(*) FROM book)""",
    False,
)(lambda s, d: unnamed(s, d).groupBy("language", "kind", "method").agg(F.count(F.lit(1)).alias("n")))
from_estate(
    "counts_by_language", lambda e: e.files.groupBy("language").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'cobol' AS language, (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) + (SELECT count(*) FROM book) AS n UNION ALL SELECT 'jcl', count(*) FROM orders UNION ALL SELECT 'pli', count(*) FROM region",
)

# --- COBOL -----------------------------------------------------------------------------------------
from_estate("cobol_fixed_detect", lambda e: cobol.fixed_format(e.of("cobol")).select("rel_path", "fixed"),
    "SELECT path AS rel_path, true AS fixed FROM part_k UNION ALL SELECT path, n % 2 = 0 FROM leaf UNION ALL SELECT path, true FROM book")
from_estate("cobol_code_lines", lambda e: cobol.code_lines(e.of("cobol")).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"), F.max("line").cast("long").alias("last_line")),
    """SELECT path AS rel_path, 25 + count(s) AS n, 26 + count(s) AS last_line FROM part_k LEFT JOIN supp USING (k) GROUP BY path
    UNION ALL SELECT path, 5, 5 FROM leaf UNION ALL SELECT path, 2, 2 FROM book""")  # fmt: skip
from_estate("cobol_exec_blocks", lambda e: e.cobol.exec_blocks,
    """SELECT path AS rel_path, 14 AS line, CASE WHEN k % 4 < 2 THEN 'CICS' ELSE 'SQL' END AS exec_kind,
      '    EXEC ' || CASE k % 4 WHEN 0 THEN 'CICS LINK' WHEN 1 THEN 'CICS XCTL' ELSE 'SQL' END || '       ' ||
      CASE k % 4 WHEN 0 THEN 'PROGRAM(''S' || (k % 10 + 1) || ''')' WHEN 1 THEN 'PROGRAM(WS-PGM-NAME)' WHEN 2 THEN 'SELECT A FROM T' || (k % 13) || ' JOIN U' || (k % 3)
        ELSE 'INSERT INTO T' || (k % 13) || ' SELECT B FROM V' || (k % 2) END || '     END-EXEC.' AS block FROM part_k
    UNION ALL SELECT path, 17, 'SQL', '    EXEC SQL EXECUTE IMMEDIATE :STMT END-EXEC.' FROM part_k WHERE k % 6 = 0""")  # fmt: skip
from_estate("cobol_cics_calls", lambda e: e.cobol.cics_calls, "SELECT rel_path, line, target, dynamic, mechanism FROM cics_calls")
from_estate("cobol_sql_tables", lambda e: e.cobol.sql_tables, "SELECT rel_path, line, name, op FROM sql_tables")
from_estate("cobol_divisions", lambda e: e.cobol.divisions,
    """SELECT path AS rel_path, unnest(['IDENTIFICATION', 'DATA', 'PROCEDURE']) AS name, unnest([1, 4, 9]) AS line FROM part_k
    UNION ALL SELECT path, unnest(['IDENTIFICATION', 'PROCEDURE']), unnest([1, 3]) FROM leaf""")  # fmt: skip
from_estate("cobol_program_id", lambda e: e.cobol.programs.filter("program_id IS NOT NULL").select("rel_path", "program_id"),
    "SELECT path AS rel_path, pname AS program_id FROM part_k UNION ALL SELECT path, pname FROM leaf")
from_estate("cobol_copies", lambda e: e.cobol.copies, "SELECT path AS rel_path, 6 AS line, 'N' || (k % 25) AS name FROM part_k")
from_estate("cobol_calls", lambda e: e.cobol.plain_calls, "SELECT rel_path, line, target, dynamic, mechanism FROM plain_calls")
from_estate("cobol_sections", lambda e: e.cobol.sections, "SELECT path AS rel_path, 5 AS line, 'WORKING-STORAGE' AS name FROM part_k")
from_estate("cobol_data_items", lambda e: e.cobol.data_items,
    """SELECT path AS rel_path, 7 AS line, 1 AS level, 'WS-TOTAL' AS name, '9(7)V99' AS pic FROM part_k UNION ALL SELECT path, 8, 5, 'WS-PGM-NAME', 'X(8)' FROM part_k
    UNION ALL SELECT path, 1, 1, name || '-REC', NULL FROM book UNION ALL SELECT path, 2, 5, name || '-ID', '9(6)' FROM book""")  # fmt: skip
from_estate("cobol_paragraphs", lambda e: e.cobol.paragraphs,
    """SELECT path AS rel_path, unnest([10, 26]) AS line, unnest(['MAIN-PARA', 'CALL-PARA']) AS name, NULL::VARCHAR AS section FROM part_k
    UNION ALL SELECT path, 4, 'LEAF-PARA', NULL FROM leaf""")  # fmt: skip
from_estate("cobol_is_copybook", lambda e: e.cobol.programs.groupBy("is_copybook").agg(F.count(F.lit(1)).alias("n")),
    "SELECT false AS is_copybook, (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) AS n UNION ALL SELECT true, count(*) FROM book")
from_estate("cobol_confidence", lambda e: e.cobol.programs.select("rel_path", "confidence"),
    "SELECT path AS rel_path, 0.95::DOUBLE AS confidence FROM part_k UNION ALL SELECT path, 0.95 FROM leaf UNION ALL SELECT path, 0.9 FROM book")
query("json_extract_object", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events", False)(
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
    .withColumn("o", F.regexp_extract(F.concat(F.lit("reply: "), "props", F.lit(" end.")), r"(?s)\{.*\}", 0))
    .select("event_id", F.get_json_object("o", "$.k").alias("k"), F.get_json_object("o", "$").isNotNull().alias("valid"))
)

# --- JCL -------------------------------------------------------------------------------------------
from_estate("jcl_statements", lambda e: e.jcl.statements,
    """SELECT 'jcl/O' || o_orderkey || '.jcl' AS rel_path, 1::BIGINT AS line, 'J' || o_orderkey AS name, 'JOB' AS verb,
      '(ACCT),CLASS=A' || CASE WHEN o_orderkey % 20 = 0 THEN ',PASSWORD=PW' || (o_orderkey % 7) ELSE '' END AS rest FROM orders
    UNION ALL SELECT path, 3 + 3 * r, 'S' || i, 'EXEC', 'PGM=P' || k FROM step UNION ALL SELECT path, 4 + 3 * r, 'D' || i, 'DD', 'DSN=CUST.C' || c || ', DISP=SHR' FROM step""")  # fmt: skip
from_estate("jcl_jobs", lambda e: e.jcl.jobs, "SELECT 'jcl/O' || o_orderkey || '.jcl' AS rel_path, 'J' || o_orderkey AS name, 1 AS line FROM orders")
from_estate("jcl_steps", lambda e: e.jcl.steps.drop("step"), "SELECT path AS rel_path, 3 + 3 * r AS line, 'S' || i AS name, 'P' || k AS pgm, NULL::VARCHAR AS proc FROM step")
from_estate("jcl_dds", lambda e: e.jcl.dds, "SELECT path AS rel_path, 4 + 3 * r AS line, 'D' || i AS name, r + 1 AS step, 'CUST.C' || c AS dsn, 'SHR' AS disp FROM step")
from_estate("jcl_links", lambda e: e.jcl.links,
    "SELECT path AS rel_path, 3 + 3 * r AS line, 'exec' AS link, 'P' || k AS target FROM step UNION ALL SELECT path, 4 + 3 * r, 'dd', 'CUST.C' || c FROM step")

# --- PL/I ------------------------------------------------------------------------------------------
from_estate("pli_scan_text", lambda e: e.pli.scanned.select("rel_path", F.contains("text", F.lit("GHOST")).alias("ghost"), F.contains("text", F.lit("NOBODY")).alias("nobody")),
    "SELECT 'pli/R' || r_regionkey || '.pli' AS rel_path, false AS ghost, false AS nobody FROM region")
from_estate("pli_procedures", lambda e: e.pli.procedures,
    """SELECT 'pli/R' || r_regionkey || '.pli' AS rel_path, 1 AS line, 'R' || r_regionkey AS name, true AS is_main FROM region
    UNION ALL SELECT 'pli/R' || r_regionkey || '.pli', 7, 'INNER' || r_regionkey, false FROM region""")  # fmt: skip
from_estate("pli_calls", lambda e: e.pli.calls,
    "SELECT 'pli/R' || r || '.pli' AS rel_path, 8 + rn AS line, 'N_' || n AS target FROM inner_n UNION ALL SELECT 'pli/R' || r_regionkey || '.pli', 5, 'INNER' || r_regionkey FROM region")
from_estate("pli_declares", lambda e: e.pli.declares, "SELECT 'pli/R' || r_regionkey || '.pli' AS rel_path, 1::BIGINT AS declares FROM region")
from_estate("pli_program_name", lambda e: e.pli.programs, "SELECT 'pli/R' || r_regionkey || '.pli' AS rel_path, 'R' || r_regionkey AS name FROM region")

# --- graph -----------------------------------------------------------------------------------------
from_estate("graph_nodes", lambda e: e.graph.nodes, "SELECT key, name, type, defined FROM nodes")
from_estate("graph_edges", lambda e: e.graph.edges, "SELECT src, dst, type, rel_path, line FROM edges")
from_estate("graph_pli_external_calls", lambda e: e.pli.external_calls, "SELECT 'pli/R' || r || '.pli' AS rel_path, 8 + rn AS line, 'N_' || n AS target FROM inner_n")
from_estate("graph_external_nodes", lambda e: e.graph.external.select("key", "name"), "SELECT key, name FROM external")
from_estate("graph_adjacency", lambda e: e.graph.adjacency,
    """SELECT key, coalesce(string_agg(dst, ' ' ORDER BY dst), '') AS targets FROM nodes LEFT JOIN (SELECT src, dst FROM edges WHERE type = 'call') ON src = key GROUP BY key""")  # fmt: skip
from_estate("graph_in_degree", lambda e: e.graph.in_degree, "SELECT key, count(dst) AS in_degree FROM nodes LEFT JOIN edges ON dst = key GROUP BY key")
from_estate("graph_cycles", lambda e: e.graph.cycles(),
    "SELECT pname AS key, min(pname) OVER (PARTITION BY (k - 1) // 7) AS cycle FROM ring WHERE is_ring AND k > 0")
from_estate("graph_self_loops", lambda e: e.graph.self_loops, "SELECT pname AS key FROM part_k WHERE k % 17 = 0")
from_estate("graph_orphans", lambda e: e.graph.orphans,
    "SELECT name FROM nodes WHERE type = 'program' AND defined AND key NOT IN (SELECT dst FROM edges WHERE type IN ('call', 'exec', 'cics'))")
from_estate("graph_unused_copybooks", lambda e: e.graph.unused_copybooks,
    "SELECT name FROM book WHERE 'copy:' || name NOT IN (SELECT dst FROM edges WHERE type = 'copy')")
from_estate("graph_unresolved", lambda e: e.graph.external.select("name"), "SELECT name FROM external")
from_estate("graph_reverse_deps", lambda e: e.graph.reverse,
    """SELECT d.name, coalesce(string_agg(DISTINCT s.name, ',' ORDER BY s.name) FILTER (e.type = 'call'), '') AS callers,
      coalesce(string_agg(DISTINCT s.name, ',' ORDER BY s.name) FILTER (e.type = 'exec'), '') AS jobs
    FROM edges e JOIN nodes s ON s.key = e.src JOIN nodes d ON d.key = e.dst WHERE e.type IN ('call', 'exec') GROUP BY d.name""")  # fmt: skip
from_estate("graph_node_counts", lambda e: e.graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT type, count(*) AS n FROM nodes GROUP BY type")
from_estate("graph_totals", lambda e: e.graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(e.graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))),
    "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")

# --- rules -----------------------------------------------------------------------------------------
from_estate("rule_code_lines", lambda e: rules.code_lines(e.of("cobol")).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n")),
    "SELECT path AS rel_path, 25 + count(s) AS n FROM part_k LEFT JOIN supp USING (k) GROUP BY path UNION ALL SELECT path, 5 FROM leaf UNION ALL SELECT path, 2 FROM book")
for _name, _id in (
    ("rule_secret", "LL-SEC-001"), ("rule_jcl_password", "LL-SEC-002"), ("rule_dynamic_sql", "LL-SEC-003"),
    ("rule_sensitive_display", "LL-SEC-004"), ("rule_ipv4", "LL-SEC-006"), ("rule_debug", "LL-SEC-007"), ("rule_pli_output", "LL-SEC-009"),
):
    from_estate(_name, lambda e, i=_id: rules.line_findings(e.files).filter(F.col("rule_id") == i).select("rel_path", "line", "evidence"),
        f"SELECT rel_path, line, evidence FROM found WHERE rule_id = '{_id}'")
from_estate("rule_dynamic_call", lambda e: rules.described(rules.dynamic_findings(e.cobol.calls)).select("rel_path", "line", "title", "severity", "evidence"),
    "SELECT rel_path, line, title, severity, evidence FROM found WHERE rule_id = 'LL-SEC-005'")
from_estate("rule_evaluate_default", lambda e: rules.evaluate_findings(e.files).select("rel_path", "line", "evidence"),
    "SELECT rel_path, line, evidence FROM found WHERE rule_id = 'LL-SEC-008'")
from_estate("rules_all_packs", lambda e: e.findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), "SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id")
from_estate("findings_all", lambda e: e.findings.select("rule_id", "title", "severity", "cwe", "rel_path", "line", "evidence", findings.rank().alias("rank")),
    "SELECT *, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM found")
PACK = [
    {"id": "OWN-001", "title": "Long number", "severity": "low", "pattern": r"\b[0-9]{16}\b", "cwe": "CWE-359"},
    {"id": "OWN-002", "pattern": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "languages": ["en"]},
]
query(
    "rules_custom_pack",
    DOCS + r"""SELECT 'OWN-001' AS rule_id, 'low' AS severity, 0.8::DOUBLE AS confidence, rel_path, line FROM l WHERE regexp_matches(raw, '(^|[^0-9A-Za-z_\x{80}-\x{10FFFF}])[0-9]{16}($|[^0-9A-Za-z_\x{80}-\x{10FFFF}])')
    UNION ALL SELECT 'OWN-002', 'medium', 0.8, rel_path, line FROM l WHERE language = 'en' AND regexp_matches(raw, '(?i)[a-z0-9._]+@[a-z0-9.]+\.[a-z]+')""",
    False,
)(lambda s, d: rules.custom_findings(documents(s, d), PACK).select("rule_id", "severity", "confidence", "rel_path", "line"))
query("documents_ipv4", DOCS + f"SELECT rel_path, line FROM l WHERE {IP_SQL}", False)(
    lambda s, d: rules.line_findings(documents(s, d)).filter("rule_id = 'LL-SEC-006'").select("rel_path", "line")
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per order with one finding whose values go out of range by the key, and an item without a title."""
    o = F.col("o_orderkey")
    sev = F.element_at(F.array(*[F.lit(x) for x in ("high", "LOW", "dire")]), (o % 3 + 1).cast("int"))
    item = F.format_string('Here: [{"title": "T%d", "severity": "%s", "line": "%s", "confidence": "%s", "cwe": "CWE-79", "owasp": null, "rationale": "why"}, {"severity": "high"}] done', o, sev, F.when(o % 2 == 0, o.cast("string")).otherwise("x"), F.when(o % 5 == 0, "7").when(o % 5 == 1, "-1").when(o % 5 == 2, "0.25").otherwise("?"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o/"), o.cast("string")).alias("rel_path"), item.alias("reply"))


query(
    "llm_findings_sanitize",
    """SELECT 'LLM-ADVISORY' AS rule_id, 'CWE-79' AS cwe, NULL::VARCHAR AS owasp, '(LLM-identified; verify against source)' AS evidence, 'why' AS rationale, '' AS remediation, 'llm' AS source, 'o/' || o_orderkey AS rel_path, 'T' || o_orderkey AS title, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS line, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence,
      true AS requires_human_review FROM orders""",
    False,
)(lambda s, d: findings.sanitised(replies(s, d)))

# --- findings' life --------------------------------------------------------------------------------
from_estate("finding_fingerprint", lambda e: e.findings.select("rule_id", "rel_path", "line", "fingerprint"), "SELECT rule_id, rel_path, line, fingerprint FROM fp")
controlled = lambda e: findings.with_controls(e.findings, findings.control_table(e.files.sparkSession))
from_estate("compliance_map", lambda e: controlled(e).select("fingerprint", "line", F.array_join("controls", ",").alias("controls")),
    "SELECT fingerprint, line, coalesce((SELECT string_agg(DISTINCT control, ',' ORDER BY control) FROM controls c WHERE c.cwe = fp.cwe), '') AS controls FROM fp")
from_estate("compliance_custom",
    lambda e: findings.with_controls(e.findings, findings.control_table(e.files.sparkSession, {"OWN": {"CWE-798": ["A.1", "A.2"]}})).groupBy(F.array_join("controls", ",").alias("controls")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN cwe = 'CWE-798' THEN 'OWN:A.1,OWN:A.2' ELSE '' END AS controls, count(*) AS n FROM fp GROUP BY 1")


def hushed(e: Estate) -> DataFrame:
    """Findings with those suppressed whose fingerprint begins with 0."""
    known = e.findings.filter(F.startswith("fingerprint", F.lit("0"))).select("fingerprint", F.lit("known").alias("reason"))
    return findings.suppressed(e.findings, known)


from_estate("findings_suppressed", lambda e: hushed(e).groupBy("suppressed").agg(F.count(F.lit(1)).alias("n")),
    "SELECT starts_with(fingerprint, '0') AS suppressed, count(*) AS n FROM fp GROUP BY 1")
from_estate("suppress_upsert",
    lambda e: findings.add_suppressions(
        e.findings.filter(F.startswith("fingerprint", F.lit("0"))).select("fingerprint", F.lit("old").alias("reason")).distinct(),
        e.findings.filter(F.substring("fingerprint", 1, 1).isin("0", "1")).select("fingerprint", F.lit("new").alias("reason")),
    ),
    "SELECT DISTINCT fingerprint, CASE WHEN starts_with(fingerprint, '0') THEN 'old' ELSE 'new' END AS reason FROM fp WHERE fingerprint[1] IN ('0', '1')")
from_estate("baseline_snapshot", lambda e: findings.baseline(e.findings), "SELECT DISTINCT fingerprint FROM fp")
old_baseline = lambda e: findings.baseline(e.findings.filter("rule_id != 'LL-SEC-008'")).unionByName(e.files.sparkSession.sql("SELECT 'ffff000011112222' AS fingerprint"))
from_estate("diff_new", lambda e: findings.new_since(e.findings, old_baseline(e)).select("fingerprint", "rule_id"),
    "SELECT DISTINCT fingerprint, rule_id FROM fp WHERE rule_id = 'LL-SEC-008'")
from_estate("diff_listing", lambda e: findings.diff_listing(e.findings, old_baseline(e)).select("fingerprint", "severity", "title"),
    "SELECT DISTINCT fingerprint, severity, title FROM fp WHERE rule_id = 'LL-SEC-008'")
from_estate("diff_resolved", lambda e: findings.resolved_since(e.findings, old_baseline(e)), "SELECT 'ffff000011112222' AS fingerprint")
from_estate("gate_fail_on", lambda e: findings.gate(hushed(e), "medium"),
    "SELECT count(*) AS n, count(*) > 0 AS failed FROM fp WHERE severity IN ('high', 'medium') AND NOT starts_with(fingerprint, '0')")
from_estate("findings_summary", lambda e: findings.summary(hushed(e)),
    "SELECT count(*) AS total, 0::BIGINT AS review, count(*) FILTER (starts_with(fingerprint, '0')) AS suppressed, count(*) FILTER (severity = 'high') AS high FROM fp")
from_estate("findings_by_severity", lambda e: e.findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "SELECT severity, count(*) AS n FROM fp GROUP BY 1")
from_estate("findings_by_source", lambda e: e.findings.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT 'rule' AS source, count(*) AS n FROM fp")
from_estate("compliance_counts", lambda e: findings.control_counts(findings.with_controls(hushed(e), findings.control_table(e.files.sparkSession))),
    "SELECT coalesce(control, 'unmapped') AS control, count(*) AS n FROM fp LEFT JOIN controls USING (cwe) WHERE NOT starts_with(fingerprint, '0') GROUP BY 1")
from_estate("findings_list", lambda e: e.findings.select("fingerprint", "rule_id", "title", "severity", "rel_path", "line"), "SELECT fingerprint, rule_id, title, severity, rel_path, line FROM fp")

OWN_PACK = {"own": [{"id": "OWN-009", "title": "Known password", "severity": "HIGH", "pattern": "hunter2", "languages": ["COBOL"], "owasp": "A07", "rationale": "leaked"}]}
from_estate("rules_pack_selection",
    lambda e: rules.run_packs(e.files, e.cobol.calls, ["owasp", "own", "cwe", "none"], OWN_PACK).groupBy("rule_id", "severity", "source").agg(F.count(F.lit(1)).alias("n")),
    "SELECT rule_id, severity, 'rule' AS source, count(*) AS n FROM found GROUP BY 1, 2 UNION ALL SELECT 'OWN-009', 'high', 'rule', count(*) FROM part_k WHERE k % 7 = 0")


def stored(spark: SparkSession) -> Store:
    """A fresh store in the shared folder."""
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def replaced(e: Estate) -> DataFrame:
    """Findings stored twice; the second run's alone are left."""
    store = stored(e.files.sparkSession)
    store.replace("findings", e.findings.select("fingerprint", "rule_id", "rel_path", "line"))
    return store.replace("findings", e.findings.filter("severity = 'high'").select("fingerprint", "rule_id", "rel_path", "line"))


from_estate("findings_replace", replaced, "SELECT fingerprint, rule_id, rel_path, line FROM fp WHERE severity = 'high'")

# --- index -----------------------------------------------------------------------------------------
INDEX = """WITH s AS (SELECT 'doc/' || doc_id AS rel_path, sha256(text) AS old, CASE WHEN doc_id % 13 = 0 THEN 'removed' ELSE 'active' END AS was FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT 'doc/' || doc_id AS rel_path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS new FROM documents WHERE doc_id % 11 <> 0),
x AS (SELECT rel_path, coalesce(new, old) AS sha256, CASE WHEN new IS NULL THEN 'removed' ELSE 'active' END AS status,
  CASE WHEN new IS NULL THEN CASE WHEN was = 'active' THEN 'removed' ELSE 'gone' END WHEN old IS NULL THEN 'added' WHEN was = 'active' AND old = new THEN 'unchanged' ELSE 'updated' END AS change
  FROM s FULL JOIN n USING (rel_path))
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and what a second walk sees."""
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(i, "text", F.concat(F.lit("doc/"), i.cast("string")).alias("rel_path"))
    stored = docs.filter(i % 7 != 0).select("rel_path", F.sha2("text", 256).alias("sha256"), F.when(i % 13 == 0, "removed").otherwise("active").alias("status"))
    seen = docs.filter(i % 11 != 0).select("rel_path", F.sha2(F.when(i % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return stored, seen


query("index_diff", INDEX + "SELECT rel_path, sha256, status, change FROM x", False)(lambda s, d: index.compared(*snapshots(s, d)))
query("index_upsert", INDEX + "SELECT rel_path, sha256, status FROM x", False)(lambda s, d: index.upserted(*snapshots(s, d)))
query("index_stats", INDEX + "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'removed') AS removed FROM x", False)(
    lambda s, d: index.stats(*snapshots(s, d))
)
query(
    "index_languages",
    FACTS + "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM book) AS skipped_unknown, (SELECT count(*) FROM region) AS skipped_disabled, (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) + (SELECT count(*) FROM orders) AS indexed",
    False,
)(lambda s, d: index.skipped(unnamed(s, d), ["cobol", "jcl"]))


def vectors_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all paths, then again those of every third with another text."""
    i, store = F.col("vec_id"), stored(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("v/"), i.cast("string")).alias("rel_path"), F.sha2(i.cast("string"), 256).alias("sha256"), F.col("embedding").alias("vector"), i)
    store.merge("embeddings", rows.drop("vec_id"))
    again = rows.filter(i % 3 == 0).select("rel_path", F.sha2(F.concat(i.cast("string"), F.lit("!")), 256).alias("sha256"), "vector")
    return store.merge("embeddings", again).select("rel_path", "sha256", F.size("vector").cast("long").alias("n"))


query("embeddings_upsert", "SELECT 'v/' || vec_id AS rel_path, sha256(vec_id || CASE WHEN vec_id % 3 = 0 THEN '!' ELSE '' END) AS sha256, len(embedding) AS n FROM embeddings", False)(vectors_upserted)


def parses_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses of documents put by their key, twice; equal texts share one."""
    keyed = documents(spark, sf_dir).select(index.parse_key(F.col("text"), "regex", F.col("kind")).alias("key"), F.length("text").cast("string").alias("data"))
    store = stored(spark)
    store.merge("parse_cache", keyed)
    return store.merge("parse_cache", keyed.filter("length(data) < 3"))


query("parse_cache_put", "SELECT DISTINCT '1:regex:text:' || sha256(text) AS key, length(text)::VARCHAR AS data FROM documents", False)(parses_put)
query("parse_cache_key", "SELECT 'doc/' || doc_id AS rel_path, '1:regex:text:' || sha256(text) AS key FROM documents", False)(
    lambda s, d: documents(s, d).select("rel_path", index.parse_key(F.col("text"), "regex", F.col("kind")).alias("key"))
)
query(
    "parse_cache_stats",
    """WITH k AS (SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 4 = 0)
    SELECT count(*) FILTER (c.key IS NULL) AS misses, sum(n - CASE WHEN c.key IS NULL THEN 1 ELSE 0 END)::BIGINT AS hits FROM k LEFT JOIN c USING (key)""",
    False,
)(
    lambda s, d: index.parse_cache(
        documents(s, d), documents(s, d).filter(F.substring("rel_path", 5, 20).cast("long") % 4 == 0).select(index.parse_key(F.col("text"), "regex", F.col("kind")).alias("key"))
    )
)
query("embed_incremental", "SELECT 'doc/' || doc_id AS rel_path, length(substr(text, 1, 4000))::BIGINT AS n FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0", False)(
    lambda s, d: index.to_embed(
        documents(s, d).select("rel_path", "text"),
        documents(s, d)
        .filter(F.substring("rel_path", 5, 20).cast("long") % 3 == 0)
        .select("rel_path", F.sha2(F.when(F.substring("rel_path", 5, 20).cast("long") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256).alias("sha256")),
    ).select("rel_path", F.length("snippet").cast("long").alias("n"))
)

# --- retrieval -------------------------------------------------------------------------------------
#: Searches take every row whose id is divisible by 50 as a query.
VECTORS = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query, v AS qv FROM e WHERE vec_id % 50 = 0)\n"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


query("search_topk", VECTORS + "SELECT vec_id, round(list_cosine_similarity(qv, v), 6) AS score FROM q, e WHERE query = 0 ORDER BY list_cosine_similarity(qv, v) DESC, vec_id LIMIT 5", False)(
    lambda s, d: retrieval.top_k(vectors(s, d), vectors(s, d).filter("vec_id = 0").first()["embedding"], 5, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))
)


def every_50th(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    return retrieval.all_pairs(vectors(spark, sf_dir), vectors(spark, sf_dir).filter("vec_id % 50 = 0"), k, "vec_id", "embedding")


query("cosine_similarity", VECTORS + "SELECT query, vec_id, round(list_cosine_similarity(qv, v), 6) AS score FROM q, e WHERE query <> vec_id", False)(
    lambda s, d: every_50th(s, d).select("query", "vec_id", F.round("score", 6).alias("score"))
)
query(
    "search_related",
    VECTORS + "SELECT query, vec_id, rank FROM (SELECT query, vec_id, (row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(qv, v) DESC, vec_id))::INT AS rank FROM q, e WHERE query <> vec_id) WHERE rank <= 3",
    False,
)(lambda s, d: every_50th(s, d, 3).select("query", "vec_id", "rank"))

# --- reports ---------------------------------------------------------------------------------------
ID_SQL = "'n_' || regexp_replace({}, '[^A-Za-z0-9]', '_', 'g')"
NODE, SRC, DST = ID_SQL.format("key"), ID_SQL.format("src"), ID_SQL.format("dst")
from_estate("emit_ids", lambda e: e.graph.nodes.select("key", emit.node_id(F.col("key")).alias("id")), f"SELECT key, {NODE} AS id FROM nodes")
from_estate("emit_dot_lines", lambda e: emit.dot_lines(e.graph.nodes, e.graph.edges),
    f"""SELECT 'node' AS part, '  ' || {NODE} || ' [label="' || name || '\\n(' || type || ')", shape=' || CASE type WHEN 'copybook' THEN 'note' WHEN 'job' THEN 'component' WHEN 'dataset' THEN 'cylinder'
      WHEN 'table' THEN 'cylinder' ELSE 'box' END || CASE WHEN defined THEN '' ELSE ', style=dashed, color="red"' END || '];' AS row FROM nodes
    UNION ALL SELECT 'edge', '  ' || {SRC} || ' -> ' || {DST} || ' [label="' || type || '"' || CASE WHEN type = 'dynamic_call' THEN ', style=dashed' ELSE '' END || '];' FROM edges""")  # fmt: skip
from_estate("emit_mermaid_lines", lambda e: emit.mermaid_lines(e.graph.nodes, e.graph.edges),
    f"""SELECT 'node' AS part, '  ' || {NODE} || CASE WHEN type IN ('dataset', 'table') THEN '[(' WHEN defined THEN '[' ELSE '(' END || name || '<br/>(' || type || ')' ||
      CASE WHEN type IN ('dataset', 'table') THEN ')]' WHEN defined THEN ']' ELSE ')' END AS row FROM nodes
    UNION ALL SELECT 'edge', '  ' || {SRC} || CASE WHEN type = 'dynamic_call' THEN ' -.->|' ELSE ' -->|' END || type || '| ' || {DST} FROM edges""")  # fmt: skip
from_estate("emit_graphml_lines", lambda e: emit.graphml_lines(e.graph.nodes),
    """SELECT key, '<node id="' || key || '"><data key="type">' || type || '</data><data key="defined">' || CASE WHEN defined THEN 'true' ELSE 'false' END || '</data></node>' AS row FROM nodes""")  # fmt: skip
from_estate("emit_json_rows", lambda e: emit.json_rows(e.findings),
    """SELECT fingerprint, '{"rule_id":"' || rule_id || '","severity":"' || severity || '","rel_path":"' || rel_path || '","line":' || line || '}' AS row FROM fp""")  # fmt: skip
from_estate("emit_sarif_results", lambda e: emit.sarif_results(e.findings).drop("message"),
    "SELECT fingerprint, rule_id AS ruleId, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, rel_path, line AS startLine FROM fp")
from_estate("emit_graphml_edges", lambda e: emit.graphml_edges(e.graph.edges),
    """SELECT 'e' || i AS id, '<edge id="e' || i || '" source="' || src || '" target="' || dst || '"><data key="rel">' || type || '</data></edge>' AS row
    FROM (SELECT *, row_number() OVER (ORDER BY src, dst, type, rel_path, line) - 1 AS i FROM edges)""")  # fmt: skip


def document_sql(lines: list[str], *parts: str) -> str:
    """Rows of a whole document: its fixed lines, and those that the queries of its parts have."""
    own = [f"SELECT row FROM ({ORACLE_SQL[p].removeprefix(FACTS)})" for p in parts]
    return " UNION ALL ".join(["SELECT unnest([" + ", ".join(f"'{line}'" for line in lines) + "]) AS row", *own])


from_estate("emit_dot_document", lambda e: reports.dot(e.graph).select("row"),
    document_sql(["digraph quarrystone {", "  rankdir=LR;", '  node [fontname="monospace"];', "}"], "emit_dot_lines"))
from_estate("emit_mermaid_document", lambda e: reports.mermaid(e.graph).select("row"), document_sql(["graph LR"], "emit_mermaid_lines"))
from_estate("emit_graphml_document", lambda e: reports.graphml(e.graph).select(F.trim("row").alias("row")),
    document_sql(
        ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="type" for="node" attr.name="type" attr.type="string"/>',
         '<key id="defined" for="node" attr.name="defined" attr.type="boolean"/>', '<key id="rel" for="edge" attr.name="relationship" attr.type="string"/>', '<graph edgedefault="directed">', "</graph>", "</graphml>"],
        "emit_graphml_lines", "emit_graphml_edges",
    ))
query("emit_json_document")(lambda s, d: reports.json(Estate.rendered(s, d).findings).select("row"))
query("emit_sarif_document")(lambda s, d: reports.sarif(Estate.rendered(s, d).findings).select("row"))
query("emit_html_rows")(lambda s, d: emit.html_rows(Estate.rendered(s, d).findings))
query("emit_json_findings")(lambda s, d: emit.json_findings(Estate.rendered(s, d).findings))
query("emit_sarif_rows")(lambda s, d: emit.sarif_rows(Estate.rendered(s, d).findings))
from_estate("emit_sarif_rules", lambda e: emit.sarif_rules(e.findings).select("rule_id", "name", "cwe"),
    "SELECT rule_id, title AS name, cwe FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY rel_path, line) AS r FROM fp) WHERE r = 1")
from_estate("doc_dependency_lines", lambda e: emit.dependency_lines(e.cobol.calls, e.cobol.copies, e.cobol.sql_tables),
    """SELECT rel_path, line, '- ' || CASE WHEN mechanism <> 'CALL' THEN mechanism WHEN dynamic THEN 'dynamic CALL' ELSE 'CALL' END || ' → `' || target || '` (`' || rel_path || ':' || line || '`)' AS row FROM calls
    UNION ALL SELECT path, 6, '- COPY → `N' || (k % 25) || '` (`' || path || ':6`)' FROM part_k
    UNION ALL SELECT rel_path, line, '- SQL ' || op || ' → table `' || name || '` (`' || rel_path || ':' || line || '`)' FROM sql_tables""")  # fmt: skip
from_estate("doc_reverse_lines", lambda e: emit.reverse_lines(e.graph.reverse),
    """SELECT d.name, CASE e.type WHEN 'call' THEN '- **Called by:** ' ELSE '- **Invoked by job(s):** ' END || string_agg(DISTINCT s.name, ', ' ORDER BY s.name) AS row
    FROM edges e JOIN nodes s ON s.key = e.src JOIN nodes d ON d.key = e.dst WHERE e.type IN ('call', 'exec') GROUP BY d.name, e.type""")  # fmt: skip
from_estate("doc_business_logic", lambda e: emit.business_lines(e.cobol.paragraphs),
    """SELECT path AS rel_path, 'Procedure flow (by paragraph): `MAIN-PARA`, `CALL-PARA`.' AS row FROM part_k UNION ALL SELECT path, 'Procedure flow (by paragraph): `LEAF-PARA`.' FROM leaf""")  # fmt: skip
from_estate("doc_overview_counts", lambda e: emit.overview_counts(e.graph.nodes, e.findings),
    """SELECT 'inventory' AS part, list_position(['program', 'copybook', 'job', 'dataset', 'external'], type)::BIGINT AS at, '- **' || upper(type[1]) || type[2:] || ':** ' || count(*) AS row FROM nodes WHERE type <> 'table' GROUP BY type
    UNION ALL SELECT 'security', 0, '- **Total findings:** ' || count(*) FROM found
    UNION ALL SELECT 'security', list_position(['critical', 'high', 'medium', 'low', 'info'], severity)::BIGINT, '  - ' || severity || ': ' || count(*) FROM found GROUP BY severity
    UNION ALL SELECT 'security', 6, '- **Require human review:** 0'""")  # fmt: skip
query("doc_overview")(
    lambda s, d: reports.overview(
        "estate",
        Estate.rendered(s, d).graph,
        Estate.rendered(s, d).findings,
        pages.artifacts(Estate.rendered(s, d).cobol),
    ).select("row")
)
query("doc_program_pages")(lambda s, d: pages.program_pages(Estate.rendered(s, d).cobol, Estate.rendered(s, d).graph))
from_estate("doc_fallback_purpose",
    lambda e: e.cobol.programs.join(e.cobol.calls.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_calls")), "rel_path", "left").select(
        "rel_path", emit.fallback_purpose(F.when(F.col("is_copybook"), "Copybook").otherwise("Program"), F.col("n_paragraphs"), F.col("n_items"), F.coalesce("n_calls", F.lit(0))).alias("purpose")
    ),
    """SELECT path AS rel_path, 'Program containing 2 paragraph(s), 2 data item(s), ' || (SELECT count(*) FROM calls WHERE rel_path = path) || ' CALL(s). (Enable the LLM for a natural-language summary.)' AS purpose FROM part_k
    UNION ALL SELECT path, 'Program containing 1 paragraph(s). (Enable the LLM for a natural-language summary.)' FROM leaf
    UNION ALL SELECT path, 'Copybook containing 2 data item(s). (Enable the LLM for a natural-language summary.)' FROM book""")  # fmt: skip
from_estate("analyze_totals", lambda e: e.totals,
    """SELECT (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) AS programs, (SELECT count(*) FROM book) AS copybooks, 2 * (SELECT count(*) FROM part_k) + (SELECT count(*) FROM leaf) AS paragraphs,
      2 * (SELECT count(*) FROM part_k) + 2 * (SELECT count(*) FROM book) AS data_items, 0::BIGINT AS low_confidence, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM part_k) AS copies,
      (SELECT count(*) FROM sql_tables) AS sql_tables, (SELECT count(*) FROM orders) AS jcl_jobs, (SELECT count(*) FROM step) AS jcl_steps, (SELECT count(*) FROM region) AS pli_programs, 2 * (SELECT count(*) FROM region) AS pli_procedures""")  # fmt: skip
query(
    "redact_secrets",
    r"""SELECT event_id, regexp_replace(regexp_replace('api_key=' || event_type || '; Authorization: Bearer ' || user_id || ' sk-abcdefgh' || event_id,
      '(?i)(api[_-]?key"?\s*[:=]\s*)([^\s,;}"'']+)', '\1***REDACTED***', 'g'), '(?i)(authorization\s*:\s*bearer\s+)(\S+)', '\1***REDACTED***', 'g')
      .regexp_replace('(sk-[A-Za-z0-9]{8,})', '***REDACTED***', 'g') AS text FROM events""",
    False,
)(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        emit.redacted(F.concat(F.lit("api_key="), "event_type", F.lit("; Authorization: Bearer "), F.col("user_id").cast("string"), F.lit(" sk-abcdefgh"), F.col("event_id").cast("string"))).alias("text"),
    )
)

# --- gateway ---------------------------------------------------------------------------------------
query(
    "airgap_filter",
    "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) IN ('blog.therea.example.net', 'ththed.example.org') AS allowed FROM pages",
    False,
)(lambda s, d: gateway.allowed(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), ["blog.therea.example.net", "ththed.example.org"]).drop("url"))
query(
    "token_budget_prefix",
    """SELECT conv_id, turn, tokens, spent FROM (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens,
      (sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS spent FROM conversations) WHERE spent <= 400""",
    False,
)(lambda s, d: gateway.within_budget(s.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text", 400).select("conv_id", "turn", "tokens", "spent"))
