"""Tools' and agents' output, and two reports compared, over records made from the tables' keys; DuckDB SQL that works from the keys."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import delta, matching
from siltstone.sources import tool_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


_RULE_IDS = ("E3012", "W2001", "I3011", "E1010", "W1011", "E0000", "X9", "W30")
_LEVELS = ("Error", "Warning", "Informational", "Odd")
_CODES = (0, 2, 4, 6, 14, 1, 16, 3)
_LEVEL_ROWS = [("Error", "HIGH", "Validity"), ("Warning", "MEDIUM", "BestPractice"), ("Informational", "INFO", "Informational")]
_PREFIX_ROWS = [("E", "Validity", False, False), ("E3", "Properties", False, True), ("W", "Practice", False, False), ("W1", "Secrets", True, False), ("E301", "Types", True, True)]
_OVERRIDE_ROWS = [("W30", "Own", "LOW", "Security"), ("I3011", "Retention", "CRITICAL", "BestPractice")]


def _nth(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _rows(rows: list[tuple]) -> str:
    word = lambda v: str(v).lower() if isinstance(v, bool) else "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(word, r)) + ")" for r in rows)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("template_id"))


@sql(
    f"""WITH k AS (SELECT c_custkey AS k, unnest([0, 1]) AS i FROM customer), r AS (SELECT 'c' || k AS template_id, {list(_RULE_IDS)}[(k + 3 * i) % 8 + 1] AS rule_id, {list(_LEVELS)}[(k // 8 + i) % 4 + 1] AS level,
      CASE WHEN (k + i) % 3 <> 0 THEN 'R' || (k % 5) END AS resource FROM k WHERE {list(_CODES)}[k % 8 + 1] & ~14 = 0),
     l AS (SELECT * FROM ({_rows(_LEVEL_ROWS)}) v(level, sev, kind)), o AS (SELECT * FROM ({_rows(_OVERRIDE_ROWS)}) v(rule_id, cat, sev, kind)),
     p AS (SELECT rule_id, arg_max((prefix, cat, sec, blk), length(prefix)) AS p FROM (SELECT DISTINCT rule_id FROM r) JOIN ({_rows(_PREFIX_ROWS)}) v(prefix, cat, sec, blk) ON starts_with(rule_id, prefix) GROUP BY rule_id)
    SELECT template_id, resource, rule_id, coalesce(o.cat, p.p[2], 'Other') AS category, coalesce(o.kind, CASE WHEN p.p[3] THEN 'Security' END, l.kind, f.kind) AS type, coalesce(o.sev, CASE WHEN r.level = 'Error' AND p.p[4] THEN 'CRITICAL' END, l.sev, f.sev) AS severity
    FROM r LEFT JOIN l USING (level) LEFT JOIN o USING (rule_id) LEFT JOIN p USING (rule_id) CROSS JOIN (SELECT * FROM l WHERE level = 'Informational') f"""
)
def linter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linter's output as findings: exit codes, overrides over prefixes over levels, resources of paths."""
    k = F.col("k")
    record = lambda i: F.struct(
        F.struct(_nth(_RULE_IDS, (k + 3 * i) % 8).alias("Id")).alias("Rule"),
        _nth(_LEVELS, (F.floor(k / 8) + i) % 4).alias("Level"),
        F.lit("m").alias("Message"),
        F.struct(F.when((k + i) % 3 != 0, F.array(F.lit("Resources"), F.concat(F.lit("R"), (k % 5).cast("string")))).otherwise(F.array(F.lit("Outputs"), F.lit("R"))).alias("Path")).alias("Location"),
    )
    output = _keys(spark, sf_dir).select("template_id", _nth(_CODES, k % 8).alias("exit_code"), F.to_json(F.array(record(0), record(1))).alias("stdout"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    levels = frame(_LEVEL_ROWS, "level string, severity string, type string")
    prefixes = frame(_PREFIX_ROWS, "prefix string, category string, security boolean, blocking boolean")
    overrides = frame(_OVERRIDE_ROWS, "rule_id string, category string, severity string, type string")
    found = tool_output.classified(tool_output.lint_findings(output), levels, prefixes, overrides)
    return found.select("template_id", "resource", "rule_id", "category", "type", "severity")


def _guard_text(broken: bool, *rules: tuple[str, str, str]) -> str:
    check = lambda place, said: {"Clause": {"Unary": {"check": {"UnResolved": {"value": {"traversed_to": {"path": place}}}}, "messages": {"custom_message": said}}}}
    objects = [{"name": "f", "status": "FAIL", "not_compliant": [{"Rule": {"name": rule, "checks": [{"Block": {"checks": [check(place, said)]}}]}}], "compliant": []} for rule, place, said in rules]
    return "\n".join(json.dumps(o) for o in objects) + ("{" if broken else "")


#: Timed out or not, exit code, output, and the findings in it: (rule, resource, message).
_GUARD = [
    (True, 0, "", []),
    (False, 0, "anything", []),
    (False, 19, _guard_text(False, ("a_rule", "/Resources/Q/Properties/X", " said \n")), [("a_rule", "Q", "said")]),
    (False, 19, _guard_text(False, ("a_rule", "/Resources/Q", "x"), ("b_rule", "/Outputs/O", "")), [("a_rule", "Q", "x"), ("b_rule", None, "")]),
    (False, 5, _guard_text(True, ("a_rule", "/Resources/Q", "x")), None),
    (False, 5, "no json", None),
    (False, 19, "[" + _guard_text(False, ("c_rule", "/Resources/W/Type", "y")) + "]", [("c_rule", "W", "y")]),
]
_GUARD_TOLD = [
    (i, "timeout" if timed else "pass" if code == 0 else "error" if found is None else "violations", *f)
    for i, (timed, code, _, found) in enumerate(_GUARD)
    for f in (found or [(None, None, None)])
]


@sql(f"SELECT 'c' || c_custkey AS template_id, state, rule_id, resource, message FROM customer JOIN ({_rows(_GUARD_TOLD)}) v(i, state, rule_id, resource, message) ON c_custkey % {len(_GUARD)} = i")
def checker_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy checker's output: time-outs, passes, concatenated records with nested clauses, unreadable texts."""
    known = F.broadcast(spark.createDataFrame([(i, *g[:3]) for i, g in enumerate(_GUARD)], "i int, timed_out boolean, exit_code int, stdout string"))
    output = _keys(spark, sf_dir).withColumn("i", (F.col("k") % len(_GUARD)).cast("int")).join(known, "i")
    return tool_output.guard_findings(output)


def _agent(**more: object) -> dict:
    return {"Resource": "R", "Normalized_Category": "IAM", "FindingType": "Security", "Severity": "HIGH", "Confidence": "Likely", "Source": "Agent Review", "Finding": "f", "Evidence": [{"Detail": "d", "Excerpt": "e"}]} | more


#: An agent's finding, and what it is taken as: (category, confidence), or the reasons for which it is rejected.
_AGENT = [
    (_agent(), ("IAM", "Likely"), None),
    (_agent(Confidence="Confirmed"), ("IAM", "Likely"), None),
    (_agent(Normalized_Category="Unheard", Confidence="Contextual"), ("Other", "Contextual"), None),
    (_agent(Source="cfn-lint"), None, "source"),
    (_agent(Severity="BAD", FindingType="x"), None, "severity,type"),
    (_agent(Finding="  ", Evidence=[]), None, "finding,excerpt"),
    (_agent(Evidence=[{"Detail": "d", "Excerpt": " "}, {"Detail": "d", "Excerpt": "e"}]), None, "excerpt"),
    (_agent(Confidence="Sure"), None, "confidence"),
]
_AGENT_TOLD = [(i, *(taken or (None, None)), reasons) for i, (_, taken, reasons) in enumerate(_AGENT)]


@sql(f"SELECT 'c' || c_custkey AS template_id, category, confidence, reasons FROM customer JOIN ({_rows(_AGENT_TOLD)}) v(i, category, confidence, reasons) ON i IN (c_custkey % {len(_AGENT)}, (c_custkey + 3) % {len(_AGENT)})")
def agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's findings as they are taken, or the reasons for which they are not."""
    k = F.col("k")
    texts = F.array(*[F.lit(json.dumps(a)) for a, *_ in _AGENT])
    one, two = (F.get(texts, ((k + d) % len(_AGENT)).cast("int")) for d in (0, 3))
    both = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    text = F.when(k % 2 == 0, both).otherwise(F.concat(F.lit('{"schema_version": "1.0", "findings": '), both, F.lit("}")))
    good, bad = tool_output.agent_findings(_keys(spark, sf_dir).select("template_id", text.alias("text")), ("IAM", "Encryption"))
    none = F.lit(None).cast("string")
    return good.select("template_id", "category", "confidence", none.alias("reasons")).unionByName(bad.select("template_id", none.alias("category"), none.alias("confidence"), F.array_join("reasons", ",").alias("reasons")))


#: Side, source, whether its tool is there, its version, whether it is enabled, whether it failed.
_TOOLS = [
    ("base", "R", True, "1", True, False), ("head", "R", True, "1", True, False), ("base", "A", True, "1", True, False), ("head", "A", True, "2", True, False),
    ("base", "N", True, "1", True, False),
]
_WHY = [("R", 0, 0), ("A", 1, 1), ("N", 1, 0)]
_FINDINGS = """SELECT l_orderkey AS template_id, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 END AS resource, CASE WHEN l_partkey % 4 = 0 THEN 'Other' ELSE 'IAM' END AS category, l_returnflag AS source,
  CAST(l_quantity AS BIGINT) % 3 AS finding, CASE WHEN l_linenumber % 2 = 0 THEN 'head' ELSE 'base' END AS side FROM lineitem"""


@sql(
    f"""WITH s AS ({_FINDINGS}), g AS (SELECT *, resource IS NOT NULL AND category <> 'Other' AS elig, count(*) FILTER (side = 'base') OVER w AS b, count(*) FILTER (side = 'head') OVER w AS h,
      count(*) FILTER (side = 'base') OVER v AS pb, count(*) FILTER (side = 'head') OVER v AS ph FROM s WINDOW w AS (PARTITION BY template_id, resource, category, source), v AS (PARTITION BY template_id, resource, category, source, finding)),
    d AS (SELECT *, CASE WHEN elig AND b = 1 AND h = 1 THEN 'identity' WHEN pb = 1 AND ph = 1 THEN 'fingerprint' END AS st FROM g),
    e AS (SELECT *, bool_or(side = 'base' AND st IS NULL) OVER w AS lb, bool_or(side = 'head' AND st IS NULL) OVER w AS lh FROM d WINDOW w AS (PARTITION BY template_id, resource, category, source)),
    f AS (SELECT *, coalesce(st, CASE WHEN lb AND lh THEN 'undetermined' WHEN CASE side WHEN 'base' THEN pb ELSE ph END > 1 THEN 'duplicate' ELSE 'only' END) AS stage FROM e),
    y AS (SELECT f.*, template_id % 5 = 0 AS unseen, concat_ws(',', CASE stage WHEN 'undetermined' THEN 'identity_undetermined' WHEN 'duplicate' THEN 'duplicate_fingerprint' END, CASE WHEN bad = 1 OR template_id % 5 = 0 THEN 'source_not_comparable' END, CASE WHEN differs = 1 THEN 'tool_version_mismatch' END,
      CASE WHEN template_id % 5 = 0 THEN 'template_not_reviewed' END, CASE WHEN template_id % 7 = 0 AND resource = 2 THEN 'possible_logical_id_rename' END) AS why FROM f JOIN ({_rows(_WHY)}) t(source, bad, differs) USING (source) WHERE st IS NULL OR side = 'head')
    SELECT template_id, resource, category, source, finding, CASE WHEN st IS NOT NULL THEN 'matched' WHEN stage = 'only' THEN side || '_only' ELSE 'unmatched' END AS observation,
      CASE WHEN st IS NOT NULL THEN 'Unchanged' WHEN why <> '' THEN 'Ambiguous' WHEN side = 'head' THEN 'New' ELSE 'Resolved' END AS classification, CASE WHEN st IS NOT NULL THEN '' ELSE why END AS reasons FROM y"""
)
def report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two reports: what is new, resolved, unchanged or cannot be told, and why."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("template_id"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3).alias("resource"), F.when(F.col("l_partkey") % 4 == 0, "Other").otherwise("IAM").alias("category"), F.col("l_returnflag").alias("source"),
        (F.col("l_quantity").cast("bigint") % 3).alias("finding"), "l_linenumber",
    )
    tools = spark.createDataFrame(_TOOLS, "side string, source string, available boolean, version string, enabled boolean, failed boolean")
    orders = lines.select("template_id").distinct()
    files = orders.select(F.lit("base").alias("side"), "template_id").unionByName(orders.where("template_id % 5 != 0").select(F.lit("head").alias("side"), "template_id"))
    renamed = orders.where("template_id % 7 = 0").select("template_id", F.lit(2).cast("bigint").alias("resource"))
    found = delta.entries(lines.where("l_linenumber % 2 = 1").drop("l_linenumber"), lines.where("l_linenumber % 2 = 0").drop("l_linenumber"), tools, files=files, renamed=renamed)
    return found.withColumn("reasons", F.array_join("reasons", ","))


_CASES = """SELECT l_orderkey % 20 AS case_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 5 END AS resource, l_returnflag AS type, l_partkey % 6 AS category, l_quantity > 45 AS deterministic, l_linenumber % 3 = 0 AS wanted FROM lineitem"""


def _verdict_sql(by: str) -> str:
    return f"""WITH r AS ({_CASES}), k AS (SELECT case_id, resource, type, category, count(*) FILTER (wanted) AS e, count(*) FILTER (wanted AND deterministic) AS d, count(*) FILTER (NOT wanted) AS a FROM r GROUP BY ALL),
      s AS (SELECT {by}, sum(e)::BIGINT AS expected, sum(least(e, a))::BIGINT AS matched, sum(d)::BIGINT AS deterministic, sum(least(d, a))::BIGINT AS detected FROM k GROUP BY ALL)
      SELECT *, CASE WHEN deterministic = 0 THEN 'INFO' WHEN deterministic = detected THEN 'PASS' ELSE 'FAIL' END AS status FROM s"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (c("l_orderkey") % 20).alias("case_id"), F.when(c("l_suppkey") % 5 != 0, c("l_suppkey") % 5).alias("resource"), c("l_returnflag").alias("type"), (c("l_partkey") % 6).alias("category"), (c("l_quantity") > 45).alias("deterministic"),
        (c("l_linenumber") % 3 == 0).alias("wanted"),
    )
    return rows.where("wanted").drop("wanted"), rows.where("not wanted").drop("wanted", "deterministic")


@sql(_verdict_sql("case_id"))
def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each case over its expectations."""
    return matching.verdicts(*_cases(spark, sf_dir), ["case_id"])


@sql(_verdict_sql("category"))
def category_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each category over the pooled cases."""
    return matching.verdicts(*_cases(spark, sf_dir), ["category"])


@sql("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN 'true' ELSE 'false' END AS remedied FROM customer")
def remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether suggestions hold the remedies that are wanted."""
    k = F.col("k")
    suggested = F.when(k % 4 != 0, F.when(k % 5 == 0, F.lit("something else")).otherwise(F.concat(F.lit("  Please ADD "), k.cast("string"), F.lit(" now "))))
    pairs = _keys(spark, sf_dir).select("k", F.when(k % 3 != 0, F.concat(F.lit(" add "), k.cast("string"))).alias("wanted"), suggested.alias("suggested"))
    return matching.remedied(pairs).select("k", F.coalesce(F.col("remedied").cast("string"), F.lit("N/A")).alias("remedied"))
