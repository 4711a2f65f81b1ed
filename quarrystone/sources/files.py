"""Sources: file trees, rule packs, frameworks, baselines and suppressions."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import excluded

#: Folders that are never entered.
PRUNED = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".quarrystone")


def discover(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """rel_path of all files under root, by a listing that doesn't follow links to folders."""
    found = []
    for top, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in PRUNED)
        found += [(os.path.relpath(os.path.join(top, n), root),) for n in sorted(names)]
    paths = spark.createDataFrame(found, "rel_path string")
    return paths.filter(~excluded(paths["rel_path"], exclude)) if exclude else paths


def read_bytes(paths: DataFrame, root: str) -> DataFrame:
    """rel_path and content; files are read by the executors, unreadable ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rel in pdf["rel_path"]:
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        out.append((rel, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["rel_path", "content"])

    return paths.select("rel_path").mapInPandas(run, "rel_path string, content binary")


def rule_packs(paths: list[str]) -> list[dict]:
    """Rules of YAML packs; a later pack of the same name replaces an earlier one."""
    packs: dict[str, list[dict]] = {}
    for p in paths:
        spec = yaml.safe_load(Path(p).read_text())
        if not isinstance(spec, dict) or "name" not in spec or "rules" not in spec:
            raise ValueError(f"{p}: a pack needs name and rules")
        packs[spec["name"]] = spec["rules"]
    return [r for rules in packs.values() for r in rules]


def framework(path: str) -> dict[str, dict[str, list[str]]]:
    """One framework of a YAML file, as name -> weakness -> controls."""
    spec = yaml.safe_load(Path(path).read_text())
    return {spec["name"]: {k.upper(): list(v) for k, v in spec.get("mapping", spec.get("map", {})).items()}}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """A baseline's fingerprints; none where the file is missing."""
    found = json.loads(Path(path).read_text())["fingerprints"] if os.path.exists(path) else []
    return spark.createDataFrame([(f,) for f in found], "fingerprint string")


def suppressions(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint and reason; none where the file is missing."""
    found = json.loads(Path(path).read_text())["suppressions"] if os.path.exists(path) else []
    return spark.createDataFrame([(s["fingerprint"], s.get("reason")) for s in found], "fingerprint string, reason string")
