"""Structure that a model recovers from programs which the parser understood badly."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "rel_path string, kind string, name string, line int, inferred boolean"
#: What is asked; the reply's fields are fixed values.
PROMPT = "The structure of this COBOL source could not be parsed. Reply with a JSON object alone: program_id (text or null), paragraphs (list of names), calls (list of names).\n\n"


def first_object(reply: str) -> dict:
    """The JSON object from the first opening to the last closing brace."""
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the reply")
    return json.loads(reply[start : end + 1])


def _facts(path: str, known: bool, data: dict) -> list[tuple]:
    names = lambda key: [v for v in data.get(key) or [] if isinstance(v, str)]
    own = [("program_id", data["program_id"])] if not known and isinstance(data.get("program_id"), str) else []
    found = own + [("paragraph", n) for n in names("paragraphs")] + [("call", n) for n in names("calls")]
    return [(path, kind, name.upper(), 0, True) for kind, name in found]


def recovered(files: DataFrame, programs: DataFrame, ask: Callable[[str], str] | None, least: float = 0.5, characters: int = 6000) -> DataFrame:
    """Facts (program_id, paragraph, call) of programs of low confidence, all inferred and at line 0; and warnings.

    ask runs on the executors, once for each such program, with its first `characters`; copybooks are never asked
    about. A call that fails gives a warning and no facts. Without ask there are no rows.
    """
    if ask is None:
        return files.sparkSession.createDataFrame([], SCHEMA)
    low = programs.filter((F.col("confidence") < least) & ~F.col("is_copybook")).select("rel_path", F.col("program_id").isNotNull().alias("known"))
    asked = files.join(low, "rel_path").select("rel_path", "known", F.substring(F.coalesce("text", F.lit("")), 1, characters).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, known, text in zip(pdf["rel_path"], pdf["known"], pdf["text"]):
                try:
                    facts = _facts(path, known, first_object(ask(PROMPT + text)))
                except Exception as e:  # whatever a caller's transport raises must not end the job
                    facts, said = [], f"fallback failed: {e}"
                else:
                    said = "structure partly recovered by a model (inferred)" if facts else None
                out += facts + ([(path, "warning", said, 0, True)] if said else [])
            yield pd.DataFrame(out, columns=["rel_path", "kind", "name", "line", "inferred"])

    return asked.mapInPandas(run, SCHEMA)
