"""The finding record: closed values, ranks, validation, merge, order, report and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import merge

# Closed sets in order of rank, least first; of sources in order of precedence, first first.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("Contextual", "Likely", "Confirmed")
TYPES = ("Informational", "BestPractice", "Validity", "Security")
SOURCES = ("cfn-lint", "cfn-guard", "IAM Review", "Network Review", "Secret Review", "Quality Review", "Agent Review")
COLUMNS = ("template_id", "resource", "category", "type", "severity", "confidence", "source", "rule_id", "finding")


def rank(column: str, names: tuple[str, ...]) -> Column:
    """The place of a value in a closed set, or -1."""
    return F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int") - 1


def violations() -> Column:
    """What is wrong with a finding, as an array of names."""
    checks = {
        "severity": rank("severity", SEVERITIES) < 0,
        "confidence": rank("confidence", CONFIDENCES) < 0,
        "type": rank("type", TYPES) < 0,
        "source": rank("source", SOURCES) < 0,
        "finding": F.coalesce(F.trim("finding") == "", F.lit(True)),
        "agent_confirmed": (F.col("source") == "Agent Review") & (F.col("confidence") == "Confirmed"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]))


def merged(findings: DataFrame) -> DataFrame:
    """One row a template, resource and category; rows without a resource, or of category Other, stay as they are.

    Type and severity are the largest, confidence too but at most Likely where the agent had a part; wording comes from the
    first by source and text; sources and rule ids are collected in order.
    """
    ranked = findings.withColumns({"_s": rank("severity", SEVERITIES), "_c": rank("confidence", CONFIDENCES), "_t": rank("type", TYPES), "_src": rank("source", SOURCES)})
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    order = F.struct("_src", "finding", "rule_id", "severity", "confidence", "type")
    agent = F.max((F.col("source") == "Agent Review").cast("int")) == 1
    conf = F.when(agent & (F.count("*") > 1), F.least(F.max("_c"), F.lit(1))).otherwise(F.max("_c"))
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("_src")), lambda i: name(SOURCES, i)), ",")
    rules = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_src", "rule_id"))), lambda x: x["rule_id"]), ",")
    many = {"type": name(TYPES, F.max("_t")), "severity": name(SEVERITIES, F.max("_s")), "confidence": name(CONFIDENCES, conf), "source": sources, "rule_id": rules, "finding": F.min_by("finding", order)}
    single = {k: F.col(k) for k in ("type", "severity", "confidence", "source", "rule_id", "finding")}
    return merge.dedup_merge(ranked, ["template_id", "resource", "category"], F.col("resource").isNotNull() & (F.col("category") != "Other"), many, single)


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with ids 1..n within each template, worst first."""
    order = [F.desc(rank("severity", SEVERITIES)), F.coalesce("resource", F.lit("")), "category", "finding", "rule_id", "source"]
    return merge.numbered(findings, ["template_id"], order)


def report(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """(template_id, report): a JSON text a template with its findings in order, their counts, and its error if any."""
    row = F.struct("id", *COLUMNS[1:])
    lists = findings.groupBy("template_id").agg(F.array_sort(F.collect_list(row)).alias("findings"))
    both = lists.join(errors, "template_id", "full")
    n = F.size("findings")

    def having(severity: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda x: x["severity"] == severity)), F.lit(0))

    counts = F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*map(having, SEVERITIES)))
    body = F.struct("findings", "error", counts.alias("by_severity"), (F.coalesce(n, F.lit(0)) <= 0).alias("passed_all_checks"))
    return both.select("template_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def summaries(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """A row a template: its findings in all, by severity and by type (zeros told), whether it passes, and the exit status
    of a run that gates on HIGH. Templates without findings, or that could not be read, count too; reports.exit_status() tells
    how a run ends that gates on nothing."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES] + [F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in TYPES]
    by = findings.groupBy("template_id").agg(F.count("*").alias("total"), *counts)
    names = by.columns[1:]
    all_ = templates.select(F.col("template_id")).distinct().join(by, "template_id", "left").select("template_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return all_.withColumns({"passed": F.col("total") == 0, "exit_status": F.when(F.col("n_high") + F.col("n_critical") > 0, 1).otherwise(0)})


#: Level and score of each severity in SARIF.
SARIF = {"CRITICAL": ("error", "9.5"), "HIGH": ("error", "8.0"), "MEDIUM": ("warning", "5.5"), "LOW": ("note", "3.0"), "INFO": ("note", "0.0")}


def sarif(rows: list[dict]) -> str:
    """SARIF 2.1.0 of one template's findings, keys sorted, rules in order of first use."""
    rules: dict[str, dict] = {}
    results = []
    for r in rows:
        rule = (r["rule_id"] or r["source"]).split(",")[0]
        level, score = SARIF[r["severity"]]
        rules.setdefault(rule, {"id": rule, "properties": {"security-severity": score}})
        results.append({"ruleId": rule, "level": level, "message": {"text": r["finding"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["template_id"]}}}]})
    body = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "siltstone", "rules": list(rules.values())}}, "results": results}]}
    return json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
