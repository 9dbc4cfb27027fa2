"""Output of external tools and agents as findings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.logic import longest_prefix
from siltstone.rules.findings import COLUMNS, CONFIDENCES, SEVERITIES, TYPES

#: A linter's record; other keys are not read.
LINT = "array<struct<Rule:struct<Id:string,ShortDescription:string>,Level:string,Message:string,Filename:string,Location:struct<Start:struct<LineNumber:bigint,ColumnNumber:bigint>,Path:array<string>>>>"
_AGENT = "array<struct<Resource:string,Normalized_Category:string,FindingType:string,Severity:string,Confidence:string,Source:string,Finding:string,Evidence:array<struct<Detail:string,Excerpt:string>>>>"


def lint_findings(output: DataFrame) -> DataFrame:
    """(template_id, rule_id, level, message, line, resource) of a table (template_id, exit_code, stdout).

    Exit codes are bit masks; only the bits 2, 4 and 8 tell of findings, and a run with others gives none.
    """
    ok = output.where(F.col("exit_code").bitwiseAND(~14) == 0)
    rows = ok.select("template_id", F.explode(F.from_json("stdout", LINT)).alias("r"))
    path = F.col("r.Location.Path")
    resource = F.when(F.get(path, F.lit(0)) == "Resources", F.get(path, F.lit(1)))
    return rows.select("template_id", F.col("r.Rule.Id").alias("rule_id"), F.col("r.Level").alias("level"), F.col("r.Message").alias("message"), F.col("r.Location.Start.LineNumber").alias("line"), resource.alias("resource"))


def classified(rows: DataFrame, levels: DataFrame, prefixes: DataFrame, overrides: DataFrame, fallback: str = "Informational") -> DataFrame:
    """lint_findings() rows as findings: a rule's override over its longest prefix over its level.

    levels: (level, severity, type); prefixes: (prefix, category, security boolean, blocking boolean); overrides:
    (rule_id, category, severity, type). A security prefix makes the type Security; an error that blocks deployment is
    CRITICAL; an unknown level counts as the fallback one.
    """
    known = levels.select("level", F.col("severity").alias("l_sev"), F.col("type").alias("l_type"))
    other = known.where(F.col("level") == fallback).select(F.col("l_sev").alias("f_sev"), F.col("l_type").alias("f_type"), F.lit(1).alias("one"))
    own = overrides.select("rule_id", F.col("category").alias("o_cat"), F.col("severity").alias("o_sev"), F.col("type").alias("o_type"))
    out = rows.join(known, "level", "left").withColumn("one", F.when(F.col("l_sev").isNull() & F.col("l_type").isNull(), 1)).join(other, "one", "left")
    out = out.withColumns({"l_sev": F.coalesce("l_sev", "f_sev"), "l_type": F.coalesce("l_type", "f_type"), "level": F.when(F.col("one").isNull(), F.col("level")).otherwise(fallback)}).join(own, "rule_id", "left")
    out = longest_prefix(out, "rule_id", prefixes, "prefix")
    blocks = (F.col("level") == "Error") & F.coalesce("blocking", F.lit(False))
    kind = F.coalesce("o_type", F.when(F.col("security"), "Security"), "l_type", F.lit("Informational"))
    severity = F.coalesce("o_sev", F.when(blocks, "CRITICAL"), "l_sev", F.lit("INFO"))
    return out.select("template_id", "resource", F.coalesce("o_cat", "category", F.lit("Other")).alias("category"), kind.alias("type"), severity.alias("severity"), F.lit("Confirmed").alias("confidence"), F.lit("cfn-lint").alias("source"), "rule_id", F.col("message").alias("finding"))


def _objects(text: str) -> list:
    """The values of concatenated JSON texts, or of one array."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out
        value, at = decoder.raw_decode(text, at)
        out += value if isinstance(value, list) else [value]


def _clauses(node, rule: str, depth: int = 0) -> Iterator[tuple[str, str, str]]:  # noqa: ANN001
    """(rule, place, message) of the checks in a failed rule, however nested."""
    if depth > 64 or not isinstance(node, (dict, list)):
        return
    for x in node if isinstance(node, list) else [node]:
        if not isinstance(x, dict):
            continue
        for key, value in x.items():
            if key in ("Unary", "Binary") and isinstance(value, dict):
                check = value.get("check") or {}
                where = next((c for c in (check.get(k) for k in ("Resolved", "UnResolved", "UnResolvedContext")) if c), {})
                found = where if isinstance(where, str) else json.dumps(where)
                start = found.find("/Resources/")
                place = found[start + 1 :].split('"')[0] if start >= 0 else ""
                yield rule, place, ((value.get("messages") or {}).get("custom_message") or "").strip()
            elif isinstance(value, (dict, list)):
                yield from _clauses(value, value.get("name", rule) if isinstance(value, dict) and key == "Rule" else rule, depth + 1)


def guard_findings(output: DataFrame) -> DataFrame:
    """(template_id, state, rule_id, resource, message) of a table (template_id, timed_out, exit_code, stdout).

    state: "timeout", "pass" (exit 0), "violations" (a row a failed clause) or "error" (unreadable output).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.timed_out:
                    rows.append((r.template_id, "timeout", None, None, None))
                elif r.exit_code == 0:
                    rows.append((r.template_id, "pass", None, None, None))
                else:
                    try:
                        found = [c for o in _objects(r.stdout or "") for c in _clauses(o.get("not_compliant", []), o.get("name", ""))]
                        rows += [(r.template_id, "violations", rule, (place.split("/") + [""] * 2)[1] or None, said) for rule, place, said in found]
                    except (ValueError, AttributeError, RecursionError):
                        rows.append((r.template_id, "error", None, None, None))
            yield pd.DataFrame(rows, columns=["template_id", "state", "rule_id", "resource", "message"])

    return output.select("template_id", "timed_out", "exit_code", "stdout").mapInPandas(run, "template_id string, state string, rule_id string, resource string, message string")


def agent_findings(output: DataFrame, categories: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Findings, and rejected rows with their reasons, of a table (template_id, text): a JSON array or {"findings": [...]}.

    A confirmed finding is taken as likely, an unknown category as Other; the source must be Agent Review and every piece
    of evidence needs an excerpt. An object that tells a schema_version other than 1.x is rejected whole, as a row without a
    finding.
    """
    text = F.col("text")
    envelope = F.from_json(text, f"schema_version string, findings {_AGENT}")
    listed = F.ltrim(text).startswith("[")
    known = F.coalesce(listed, F.lit(True)) | F.coalesce(envelope["schema_version"].rlike(r"^1\.[0-9]+(\.[0-9]+)?$"), F.lit(True))
    rows = F.when(listed, F.from_json(text, _AGENT)).otherwise(envelope["findings"])
    refused = output.where(text.isNotNull() & ~known).select("template_id", F.lit(None).cast("string").alias("Finding"), F.array(F.lit("schema_version")).alias("reasons"))
    each = output.where(known).select("template_id", F.explode(rows).alias("f")).select("template_id", "f.*")
    each = each.withColumns({"Normalized_Category": F.when(F.col("Normalized_Category").isin(*categories), F.col("Normalized_Category")).otherwise("Other"), "Confidence": F.when(F.col("Confidence") == "Confirmed", "Likely").otherwise(F.col("Confidence"))})
    checks = {
        "source": F.col("Source") != "Agent Review",
        "severity": ~F.col("Severity").isin(*SEVERITIES),
        "type": ~F.col("FindingType").isin(*TYPES),
        "confidence": ~F.col("Confidence").isin(*CONFIDENCES),
        "finding": F.trim("Finding") == "",
        "excerpt": (F.size("Evidence") < 1) | F.exists("Evidence", lambda e: F.coalesce(F.trim(e["Excerpt"]) == "", F.lit(True))),
    }
    each = each.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()])))
    good = each.where(F.size("reasons") == 0).select("template_id", F.col("Resource").alias("resource"), F.col("Normalized_Category").alias("category"), F.col("FindingType").alias("type"), F.col("Severity").alias("severity"), F.col("Confidence").alias("confidence"), F.col("Source").alias("source"), F.lit(None).cast("string").alias("rule_id"), F.col("Finding").alias("finding"))
    return good.select(*COLUMNS), each.where(F.size("reasons") > 0).select("template_id", "Finding", "reasons").unionByName(refused)


def unknown_keys(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed: from_json would drop them in silence."""
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))

