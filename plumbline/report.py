"""Sinks of ranked findings: text, JSON lines and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most findings that a document rendered on the driver holds; beyond it, write JSON lines.
MOST_RENDERED = 100_000
_LEVEL = {"High": "error", "Medium": "warning", "Low": "note"}


def summary(found: DataFrame) -> DataFrame:
    """Findings and modules of each family, rule and confidence."""
    return found.groupBy(F.substring_index("rule_id", "/", 1).alias("family"), "rule_id", "confidence").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("module_id").alias("n_modules"))


def write_json(found: DataFrame, path: str) -> None:
    """One JSON object a line, written by the executors."""
    found.withColumn("version", F.lit(1)).write.mode("errorifexists").json(path)


def _rows(found: DataFrame) -> list:
    rows = found.limit(MOST_RENDERED + 1).collect()
    if len(rows) > MOST_RENDERED:
        raise ValueError(f"more than {MOST_RENDERED} findings; use write_json")
    return rows


def to_text(found: DataFrame) -> str:
    """Findings grouped by rule, in their order."""
    out, last = [], None
    for r in _rows(found):
        if r.rule_id != last:
            out.append(f"\n{r.rule_id} ({r.confidence})" if out else f"{r.rule_id} ({r.confidence})")
            last = r.rule_id
        out.append(f"  module {r.module_id} {r.line}:{r.col} {r.detail}".rstrip())
    return "\n".join(out)


def to_sarif(found: DataFrame) -> str:
    """A SARIF 2.1.0 document."""
    rows = _rows(found)
    rules = sorted({r.rule_id for r in rows})
    index = {x: i for i, x in enumerate(rules)}
    results = [
        {"ruleId": r.rule_id, "ruleIndex": index[r.rule_id], "level": _LEVEL.get(r.confidence, "note"), "message": {"text": r.detail or r.rule_id}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"module/{r.module_id}"}, "region": {"startLine": max(1, r.line), "startColumn": max(1, r.col)}}}]}
        for r in rows
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "plumbline", "rules": [{"id": x} for x in rules]}}, "results": results}]}, sort_keys=True)
