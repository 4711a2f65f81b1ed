"""Patterns, word lists and mappings that results depend on.

Every pattern is read with Java's (?iU), which folds case and classes as Unicode does.
"""

from __future__ import annotations

# --- fixed values: COBOL -------------------------------------------------------------------------
QUOTED = r"""'[^']*'|"[^"]*\""""
NAME = "[A-Z0-9][A-Z0-9-]*"
DIVISION = r"^\s*(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"
PROGRAM_ID = rf"^\s*PROGRAM-ID\b\.?\s*({NAME})"
SECTION = rf"^\s*({NAME})\s+SECTION\s*\."
PARAGRAPH = rf"^\s*({NAME})\s*\.\s*$"
COPY = rf"(?<![A-Z0-9-])COPY\s+({NAME})"
CALL = rf"""(?<![A-Z0-9-])CALL\s+(?:'([^']+)'|"([^"]+)"|({NAME}))"""
DATA_ITEM = rf"^\s*(\d{{1,2}})\s+(FILLER|{NAME})\b(.*)$"
PIC = r"\bPIC(?:TURE)?\s+(?:IS\s+)?([^\s.]+)"
NOT_PARAGRAPHS = ("STOP", "EXIT", "CONTINUE", "GOBACK", "END-IF", "END-PERFORM")
EXEC = r"^[^']*?(?<![A-Z0-9-])EXEC\s+(CICS|SQL)\b"
END_EXEC = r"\bEND-EXEC\b"
CICS_TRANSFER = r"\b(LINK|XCTL)\b"
CICS_PROGRAM = r"PROGRAM\s*\(\s*(?:'([^']+)'|([A-Z0-9$#@][A-Z0-9$#@-]*))"
SQL_NAME = r"([A-Z0-9_][A-Z0-9_.$#@-]*)"
SQL_OPERATIONS = (
    ("INSERT", rf"\bINSERT\s+INTO\s+{SQL_NAME}"),
    ("UPDATE", rf"\bUPDATE\s+{SQL_NAME}"),
    ("JOIN", rf"\bJOIN\s+{SQL_NAME}"),
    ("SELECT", rf"\bFROM\s+{SQL_NAME}"),
)
SQL_STOP_WORDS = ("WHERE", "SET", "VALUES", "ORDER", "GROUP", "FETCH", "FOR")

# --- fixed values: JCL ---------------------------------------------------------------------------
STATEMENT = r"^//(\S+)\s+(JOB|EXEC|DD)\b\s*(.*)$"
PGM = r"\bPGM=([A-Z0-9#@$]+)"
PROC = r"\bPROC=([A-Z0-9#@$]+)"
DSN = r"\bDSN(?:AME)?=([A-Z0-9.$#@-]+)"
DISP = r"\bDISP=(\([^)]*\)|[A-Z]+)"

# --- fixed values: PL/I --------------------------------------------------------------------------
PLI_PROCEDURE = r"\b([A-Z_][A-Z0-9_]*)(\s*:\s*)((?:PROC|PROCEDURE)\b.*)"
PLI_MAIN = r"OPTIONS\s*\(\s*MAIN\s*\)"
PLI_CALL = r"(?<![A-Z0-9_])CALL\s+([A-Z_][A-Z0-9_]*)"
PLI_INCLUDE = r"%INCLUDE\s+\(?\s*([A-Z_][A-Z0-9_]*)"
PLI_DECLARE = r"\b(?:DECLARE|DCL)\b"

# --- fixed values: rules -------------------------------------------------------------------------
SECRET = r"(?<![A-Z])(PASSWORD|PASSWD|PASS-WORD|PWD|SECRET|API-?KEY|PASSPHRASE)(?![A-Z])"
JCL_PASSWORD = r"\b(PASSWORD|PASS|PWD)\s*=\s*[^,\s]+"
DYNAMIC_SQL = r"\b(EXECUTE\s+IMMEDIATE|PREPARE)\b"
SENSITIVE = r"\b[\w-]*(PASSWORD|PASSWD|PWD|SSN|SOC-SEC|CARD|PIN|ACCT-NO|ACCOUNT-NO)[\w-]*\b"
DISPLAY = r"\bDISPLAY\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DEBUG = r"\b(READY\s+TRACE|RESET\s+TRACE|EXHIBIT)\b"
EVALUATE = r"(?<![A-Z0-9-])EVALUATE\b"
END_EVALUATE = r"\bEND-EVALUATE\b"
WHEN_OTHER = r"\bWHEN\s+OTHER\b"
PLI_OUTPUT = r"\bPUT\s+(LIST|EDIT|DATA|STRING)\b"

#: Severities in rising order; a severity's place is its rank.
SEVERITIES = ("info", "low", "medium", "high", "critical")

#: rule_id, title, severity, cwe, owasp and confidence, in the order rules run. The texts of results are fixed too.
RULES = (
    ("LL-SEC-001", "Hard-coded credential or secret", "high", "CWE-798", "A07:2021", 0.85),
    ("LL-SEC-002", "Hard-coded password in JCL", "high", "CWE-798", "A07:2021", 0.9),
    ("LL-SEC-003", "Possible SQL injection via dynamic SQL", "high", "CWE-89", "A03:2021", 0.6),
    ("LL-SEC-004", "Sensitive data written to log/output", "medium", "CWE-532", "A09:2021", 0.7),
    ("LL-SEC-005", "Dynamic program CALL", "medium", "CWE-94", "A03:2021", 0.6),
    ("LL-SEC-006", "Hard-coded IP address", "low", "CWE-1051", None, 0.8),
    ("LL-SEC-007", "Active debug code left in source", "low", "CWE-489", None, 0.85),
    ("LL-SEC-008", "EVALUATE without WHEN OTHER (missing default case)", "medium", "CWE-478", None, 0.7),
    ("LL-SEC-009", "Sensitive data written to output", "medium", "CWE-532", "A09:2021", 0.7),
)

#: Rationale and remediation by rule; CICS is the dynamic CICS transfer of LL-SEC-005.
RULE_TEXTS = {
    "LL-SEC-001": (
        "A secret-bearing field is assigned a literal value in source.",
        "Move secrets to an external secret store / parameter; never embed in source.",
    ),
    "LL-SEC-002": (
        "A PASSWORD= parameter exposes credentials in cleartext JCL.",
        "Use a security product (e.g. RACF) and remove embedded passwords.",
    ),
    "LL-SEC-003": (
        "Dynamically built/executed SQL can be injectable if it incorporates untrusted input.",
        "Use static SQL with host variables / parameter markers instead of dynamic statements.",
    ),
    "LL-SEC-004": (
        "A DISPLAY statement references a sensitive field, risking exposure in logs/SYSOUT.",
        "Mask or remove sensitive values before DISPLAY; avoid logging secrets/PII.",
    ),
    "LL-SEC-005": (
        "A dynamically resolved CALL target can divert control flow if the variable is influenced by input.",
        "Validate/whitelist the program name, or use static CALLs where possible.",
    ),
    "CICS": (
        "A CICS transfer whose program name is resolved at runtime; confirm the name cannot be influenced by untrusted input.",
        "Ensure the program name is set from trusted, validated values.",
    ),
    "LL-SEC-006": (
        "A hard-coded network address reduces portability and can leak environment topology.",
        "Externalize endpoints into configuration.",
    ),
    "LL-SEC-007": (
        "Debugging statements (READY TRACE / EXHIBIT) left in production can leak data and affect behavior.",
        "Remove debugging code before deploying to production.",
    ),
    "LL-SEC-008": (
        "Unhandled values fall through silently, which can mask errors or produce incorrect results.",
        "Add a WHEN OTHER branch to handle unexpected values explicitly.",
    ),
    "LL-SEC-009": (
        "A PUT statement writes a sensitive field, risking exposure in logs/output.",
        "Mask or remove sensitive values before writing them out.",
    ),
}

#: Controls by framework and weakness (indicative).
FRAMEWORKS = {
    "PCI-DSS": {
        "CWE-798": ["8.6.2"],
        "CWE-259": ["8.6.2"],
        "CWE-89": ["6.2.4"],
        "CWE-532": ["3.3.1", "10.2.1"],
        "CWE-94": ["6.2.4"],
    },
    "NIST-800-53": {
        "CWE-798": ["IA-5"],
        "CWE-259": ["IA-5"],
        "CWE-89": ["SI-10"],
        "CWE-94": ["SI-10"],
        "CWE-532": ["AU-9", "SI-11"],
        "CWE-489": ["SA-15"],
        "CWE-478": ["SI-10"],
        "CWE-1051": ["CM-6"],
    },
}

#: Languages and kinds by file extension.
EXTENSIONS = {
    ".cbl": ("cobol", "program"),
    ".cob": ("cobol", "program"),
    ".cobol": ("cobol", "program"),
    ".cpy": ("cobol", "copybook"),
    ".copy": ("cobol", "copybook"),
    ".jcl": ("jcl", "job"),
    ".job": ("jcl", "job"),
    ".jcs": ("jcl", "job"),
    ".pli": ("pli", "program"),
    ".pl1": ("pli", "program"),
    ".inc": ("pli", "include"),
}
