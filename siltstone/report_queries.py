"""Whole reports of the tables' orders: checked, written, spoilt and read back; each with SQL that works from the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import canonical, excerpts, records
from siltstone.plans.deal import dealt
from siltstone.plans.settle import settled
from siltstone.rules import reports
from siltstone.rules.findings import SEVERITIES, SOURCES, TYPES
from siltstone.review import Review
from siltstone.sources import templates
from siltstone.sources.reports import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ADVICE = 'Mend it.\nThen "review" it\tagain \\ é.'


def findings_of_orders(orders: DataFrame) -> DataFrame:
    """A finding of each order, its report that of the customer. Cheap ones have two sources, which category Other forbids."""
    digit = F.substring("o_orderpriority", 1, 1)
    pick = lambda column, pairs: F.coalesce(*[F.when(column == k, v) for k, v in pairs])
    price, month = F.floor("o_totalprice").cast("bigint"), F.month("o_orderdate").cast("string")
    two = F.col("o_totalprice") < 3000
    source = F.when(two, F.array(F.lit("IAM Review"), F.lit("Agent Review"))).otherwise(F.array(F.lit("cfn-guard")))
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    evidence = F.transform(source, lambda s: F.struct(s.alias("Source"), F.concat(F.lit("Order "), key.cast("string"), F.lit(" – é")).alias("Detail"), F.when(s == "cfn-guard", F.concat(F.lit("RULE_"), digit)).alias("RuleId"), day.alias("Excerpt")))
    steps = reports.template_path(F.array(F.lit("Resources"), F.coalesce(F.when(month != "12", month), F.lit("Outputs")), price.cast("string"), F.lit("a/b")))
    place = F.struct(F.concat(F.lit(".\\t//"), F.col("o_custkey").cast("string"), F.lit(".yaml")).alias("File"), (key + 1).alias("Line"), F.lit(None).cast("bigint").alias("Column"), steps.alias("TemplatePath"))
    return orders.select(
        F.col("o_custkey").alias("report_id"),
        pick(F.col("o_orderstatus"), (("F", "Encryption"), ("O", "Logging"), ("P", "Other"))).alias("Normalized_Category"),
        pick(F.col("o_orderstatus"), (("F", "Security"), ("O", "BestPractice"), ("P", "Informational"))).alias("FindingType"),
        pick(digit, zip("12345", reversed(SEVERITIES), strict=True)).alias("Severity"),
        F.when(F.col("o_totalprice") >= 150000, "Confirmed").otherwise("Likely").alias("Confidence"),
        source.alias("Source"),
        F.when(month != "12", F.concat(F.lit("Month"), month)).alias("Resource"),
        place.alias("Location"),
        F.concat(F.lit('Order "'), "o_orderpriority", F.lit('"')).alias("Finding"),
        F.concat(F.lit("price "), price.cast("string")).alias("WhyItMatters"),
        evidence.alias("Evidence"),
        F.lit(_ADVICE).alias("Recommendation"),
        F.lit(None).cast("string").alias("SuggestedRemediation"),
    )


def built_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a customer, with its text: files and tools by the nation, an error where the balance is below zero."""
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    file = F.concat(F.lit("t/"), k.cast("string"), F.lit(".yaml"))
    made = F.col("c_nationkey") % 4 == 0
    meta = customers.select(
        k.alias("report_id"), F.array(F.lit("z\\last.yaml"), file, F.lit("z/last.yaml")).alias("files"), F.array(F.lit("Agent Review"), F.lit("cfn-guard"), F.lit("IAM Review"), F.lit("cfn-guard")).alias("sources_enabled"),
        made.alias("cdk_detected"), F.when(made, "ran").otherwise("not_applicable").alias("cdk_synthesis"), F.when(made, F.array(file)).otherwise(F.array().cast("array<string>")).alias("synthesized"),
    )
    none = F.lit(None).cast("string")
    errors = customers.where("c_acctbal < 0").select(
        k.alias("report_id"), F.lit(0).alias("seq"), F.lit("tool_timeout").alias("error_class"), F.lit("cfn-guard").alias("source"), none.alias("tool"), F.lit(6).cast("bigint").alias("exit_code"), F.col("c_mktsegment").alias("message"),
        none.alias("required_min_version"), none.alias("detected_version"), none.alias("remediation"), F.array(F.lit("a"), F.lit("b")).alias("stderr_head"),
    )
    names = F.when(F.col("c_nationkey") == 7, F.array(F.lit("cfn-lint"), F.lit("cfn-lint"))).otherwise(F.array(F.lit("cfn-lint"), F.lit("cfn-guard")))
    tools = customers.select(k.alias("report_id"), F.explode(names).alias("name"), (F.col("c_nationkey") > 2).alias("available"), F.when(F.col("c_nationkey") > 2, "1.2").alias("version"))
    return settled(reports.dumped(reports.built(meta, findings_of_orders(orders), errors, tools)))


def _json(shape: object, indent: int | None, level: int = 0) -> str:
    """An SQL expression of the JSON text of a shape: objects, lists of shapes, texts of SQL expressions that are JSON; a tuple
    (text, empty) is an SQL expression of joined items, or null."""
    inner, outer, colon = ("", "", ":") if indent is None else ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level, ": ")
    if isinstance(shape, str):
        return shape
    if isinstance(shape, tuple):
        return f"coalesce('[{inner}' || {shape[0]} || '{outer}]', '[]')"
    if isinstance(shape, dict):
        parts = [f"'\"{k}\"{colon}' || " + _json(v, indent, level + 1) for k, v in sorted(shape.items())]
        return f"('{{{inner}' || " + f" || ',{inner}' || ".join(parts) + f" || '{outer}}}')"
    return f"('[{inner}' || " + f" || ',{inner}' || ".join(_json(v, indent, level + 1) for v in shape) + f" || '{outer}]')"


def _word(expression: str) -> str:
    return f"coalesce(to_json({expression})::VARCHAR, 'null')"


def _number(expression: str) -> str:
    return f"coalesce(({expression})::VARCHAR, 'null')"


def _finding(indent: int | None, level: int, with_id: bool) -> str:
    evidence = lambda s: _json({"Source": f"'\"' || {s} || '\"'", "Detail": "'\"Order ' || o_orderkey || ' – é\"'", "RuleId": f"CASE WHEN {s} = 'cfn-guard' THEN '\"RULE_' || o_orderpriority[1] || '\"' ELSE 'null' END", "Excerpt": "'\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"'"}, indent, level + 2)
    inner = "," if indent is None else ",\n" + " " * indent * (level + 2)
    joined = lambda item: (f"(SELECT string_agg({item('s')}, '{inner}' ORDER BY i) FROM (SELECT unnest(sources) AS s, generate_subscripts(sources, 1) AS i))", "")
    shape = {
        "Normalized_Category": _word("category"), "FindingType": _word("kind"), "Severity": _word("severity"), "Confidence": _word("confidence"), "Source": joined(lambda s: f"'\"' || {s} || '\"'"), "Resource": _word("resource"),
        "Location": {"File": "'\"t/' || o_custkey || '.yaml\"'", "Line": _number("o_orderkey + 1"), "Column": "'null'", "TemplatePath": ["'\"Resources\"'", "CASE WHEN month(o_orderdate) = 12 THEN '\"Outputs\"' ELSE '\"' || month(o_orderdate) || '\"' END", _number("price"), "'\"a/b\"'"]},
        "Finding": _word("wording"), "WhyItMatters": "'\"price ' || price || '\"'", "Evidence": joined(evidence), "Recommendation": "'" + canonical_text(_ADVICE) + "'", "SuggestedRemediation": "'null'",
    }
    return _json(shape | ({"ID": _number("id")} if with_id else {}), indent, level)


def canonical_text(value: str) -> str:
    """The JSON of a text as an SQL literal holds it."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        value = value.replace(char, escape)
    return f'"{value}"'


def _case(expression: str, pairs) -> str:  # noqa: ANN001
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


def _counts(names, test) -> dict:  # noqa: ANN001
    return {n: f"(SELECT count(*)::VARCHAR FROM found f WHERE f.o_custkey = c.c_custkey AND {test(n)})" for n in names}


_REPORTS = f"""
found0 AS (
  SELECT *, {_case("o_orderstatus", (("F", "Encryption"), ("O", "Logging"), ("P", "Other")))} AS category, {_case("o_orderstatus", (("F", "Security"), ("O", "BestPractice"), ("P", "Informational")))} AS kind,
    {_case("o_orderpriority[1]", zip("12345", reversed(SEVERITIES), strict=True))} AS severity, CASE WHEN o_totalprice >= 150000 THEN 'Confirmed' ELSE 'Likely' END AS confidence,
    CASE WHEN o_totalprice < 3000 THEN ['IAM Review', 'Agent Review'] ELSE ['cfn-guard'] END AS sources, CASE WHEN month(o_orderdate) <> 12 THEN 'Month' || month(o_orderdate) END AS resource,
    'Order "' || o_orderpriority || '"' AS wording, floor(o_totalprice)::BIGINT AS price FROM orders),
found AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority[1], coalesce(resource, ''), category, wording, {_finding(None, 0, False)}) AS id FROM found0),
first_bad AS (SELECT o_custkey, true AS bad FROM found WHERE category = 'Other' AND len(sources) > 1 GROUP BY o_custkey),
lists AS (SELECT o_custkey, string_agg({_finding(2, 2, True)}, ',\n    ' ORDER BY id) AS body, count(*) AS n FROM found GROUP BY o_custkey),
texts AS (SELECT c_custkey AS report_id, CASE WHEN bad THEN 'Normalized_Category' WHEN c_nationkey = 7 THEN 'tools' END AS refused, c.c_nationkey, coalesce(l.n, 0) AS n, {_json({
    "schema_version": "'\"1.0.0\"'",
    "target": {"files": ["'\"t/' || c_custkey || '.yaml\"'", "'\"z/last.yaml\"'"], "cdk": {"detected": "CASE WHEN c_nationkey % 4 = 0 THEN 'true' ELSE 'false' END", "synthesis": "CASE WHEN c_nationkey % 4 = 0 THEN '\"ran\"' ELSE '\"not_applicable\"' END", "synthesized_templates": ("CASE WHEN c_nationkey % 4 = 0 THEN '\"t/' || c_custkey || '.yaml\"' END", "")}},
    "sources_enabled": ["'\"cfn-guard\"'", "'\"IAM Review\"'", "'\"Agent Review\"'"],
    "tools": [{"name": f"'\"{n}\"'", "available": "CASE WHEN c_nationkey > 2 THEN 'true' ELSE 'false' END", "version": "CASE WHEN c_nationkey > 2 THEN '\"1.2\"' ELSE 'null' END"} for n in ("cfn-guard", "cfn-lint")],
    "findings": ("l.body", ""),
    "errors": ("CASE WHEN c_acctbal < 0 THEN " + _json({"error_class": "'\"tool_timeout\"'", "source": "'\"cfn-guard\"'", "tool": "'null'", "exit_code": "'6'", "message": _word("c_mktsegment"), "required_min_version": "'null'", "detected_version": "'null'", "remediation": "'null'", "stderr_head": ["'\"a\"'", "'\"b\"'"]}, 2, 2) + " END", ""),
    "summary": {"total": _number("coalesce(l.n, 0)"), "by_finding_type": _counts(TYPES, lambda n: f"kind = '{n}'"), "by_severity": _counts(SEVERITIES, lambda n: f"severity = '{n}'"), "by_source": _counts(SOURCES, lambda n: f"list_contains(sources, '{n}')"),
        "by_template_group": {"standalone": "CASE WHEN c_nationkey % 4 = 0 THEN '0' ELSE coalesce(l.n, 0)::VARCHAR END", "synthesized": "CASE WHEN c_nationkey % 4 = 0 THEN coalesce(l.n, 0)::VARCHAR ELSE '0' END"}, "passed_all_checks": "CASE WHEN l.n IS NULL THEN 'true' ELSE 'false' END"},
}, 2)} || chr(10) AS text
  FROM customer c LEFT JOIN lists l ON l.o_custkey = c.c_custkey LEFT JOIN first_bad b ON b.o_custkey = c.c_custkey)"""  # fmt: skip


@sql(f"WITH {_REPORTS} SELECT report_id, refused, CASE WHEN refused IS NULL THEN sha256(text) END AS digest, CASE WHEN refused IS NULL THEN strlen(text) END AS n_bytes FROM texts")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's report as canonical text: its digest and length, or why it is refused."""
    return built_of_orders(spark, sf_dir).select("report_id", "refused", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes"))


_MOST = 12_000
_LONG = _json({"error_class": f"'\"{reports.TOO_LONG}\"'", "source": "'null'", "tool": "'null'", "exit_code": "'null'", "message": f"'\"the report is longer than {_MOST} bytes\"'", "required_min_version": "'null'", "detected_version": "'null'", "remediation": "'null'", "stderr_head": "'[]'"}, 2, 2)


@sql(
    f"""WITH {_REPORTS},
sized AS (SELECT *, CASE WHEN refused IS NOT NULL THEN 'refused' WHEN strlen(text) > {_MOST} THEN 'minimal' ELSE 'whole' END AS state FROM texts),
cut AS (SELECT report_id, state, text[:strpos(text, '"errors": [') - 1] AS before, text[strpos(text, '"errors": ['):strpos(text, '"findings": [') - 1] AS errors, text[strpos(text, '  "schema_version"'):] AS after, text FROM sized)
SELECT report_id, state, CASE state WHEN 'whole' THEN sha256(text) WHEN 'minimal' THEN
  sha256(before || CASE WHEN starts_with(errors, '"errors": []') THEN '"errors": [' || chr(10) || '    ' || {_LONG} || chr(10) || '  ],' || chr(10) || '  ' ELSE replace(errors, chr(10) || '  ],', ',' || chr(10) || '    ' || {_LONG} || chr(10) || '  ],') END || '"findings": [],' || chr(10) || after) END AS digest FROM cut"""
)
def report_texts_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's report within a bound: whole, or without its findings where it would be longer."""
    found = reports.within(built_of_orders(spark, sf_dir).drop("text"), _MOST)
    return found.select("report_id", "state", F.sha2("text", 256).alias("digest"))


def spoilt(text: Column, how: Column) -> Column:
    """The bytes of a report's text, spoilt in one of eight ways, or not."""
    twice = F.replace(text, F.lit('"schema_version": "1.0.0"'), F.lit('"schema_version": "1.0.0",\n  "schema_version": "1.0.0"'))
    ways = [
        twice, F.regexp_replace(text, '"total": [0-9]+', '"total": NaN'), F.concat(text, F.lit("x")), None, F.replace(text, F.lit('"Severity": "HIGH"'), F.lit('"Severity": "SEVERE"')), F.regexp_replace(text, '"total": [0-9]+', '"total": 999'),
        F.replace(text, F.lit('"files"'), F.lit('"filez"')), F.replace(text, F.lit('"ID": 1,'), F.lit('"ID": 2,')),
    ]
    broken = F.concat(text.cast("binary"), F.lit(bytearray(b"\xff")))
    return F.coalesce(*[F.when(how == i, w.cast("binary") if w is not None else broken) for i, w in enumerate(ways)], text.cast("binary"))


@sql(
    f"""WITH {_REPORTS},
apart AS (SELECT DISTINCT o_custkey FROM (SELECT o_custkey FROM found WHERE resource IS NOT NULL AND category <> 'Other' GROUP BY o_custkey, resource, category HAVING count(*) > 1)),
facts AS (SELECT t.*, c_nationkey % 10 AS how, a.o_custkey IS NOT NULL AS apart, contains(text, '"Severity": "HIGH"') AS high FROM texts t LEFT JOIN apart a ON a.o_custkey = report_id WHERE refused IS NULL)
SELECT report_id,
  CASE WHEN how = 0 THEN 'duplicate_key' WHEN how IN (1, 2, 3) THEN 'parse_failure' WHEN how = 6 OR how = 4 AND high THEN 'schema_violation' END AS failure,
  CASE WHEN how = 2 THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS line, CASE WHEN how = 2 THEN 1 END AS "column",
  CASE WHEN how = 6 THEN 'target.files' WHEN how = 4 AND high THEN 'findings.Severity' END AS field,
  CASE WHEN how IN (0, 1, 2, 3, 6) OR how = 4 AND high THEN NULL ELSE array_to_string(list_filter([CASE WHEN how = 5 OR how = 7 AND n > 0 THEN 'rebuild_mismatch' END, CASE WHEN apart THEN 'dedup_invariant_violated' END], lambda x: x IS NOT NULL), ',') END AS integrity
FROM facts"""
)
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's report spoilt by its nation's number, read strictly and built again."""
    made = built_of_orders(spark, sf_dir).where("refused is null").select("report_id", "text")
    nations = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"), (F.col("c_nationkey") % 10).alias("how"))
    raw = made.join(nations, "report_id").select("report_id", spoilt(F.col("text"), F.col("how")).alias("raw"))
    return reports.checked(settled(read(raw))).drop("sha256")


@sql(
    """SELECT c_custkey AS review_id, CASE WHEN bool_or(o_orderstatus = 'O') AND c_acctbal > 2000 THEN 0 ELSE coalesce(arg_min(CASE WHEN o_totalprice < 200000 THEN o_orderpriority[1]::INT + 2 END, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')), 0) END AS exit_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"""
)
def review_exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each customer's run ends: orders are its failures, but for dear ones, in the order of their dates."""
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    done = orders.groupBy(F.col("o_custkey").alias("review_id")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("reviewed"))
    reviews = customers.select(F.col("c_custkey").alias("review_id"), (F.col("c_acctbal") > 2000).alias("succeeded")).join(done, "review_id", "left")
    code = F.when(F.col("o_totalprice") < 200000, F.substring("o_orderpriority", 1, 1).cast("int") + 2).otherwise(0)
    return reports.exit_status(reviews, orders.select(F.col("o_custkey").alias("review_id"), F.struct("o_orderdate", "o_orderkey").alias("seq"), code.alias("code")))


_BAD = {
    "ID": "o_orderkey < 5", "Normalized_Category": "false", "FindingType": "o_orderstatus = 'P'", "Severity": "o_orderpriority LIKE '4%'", "Source": "o_custkey % 7 = 0", "Resource": "month(o_orderdate) = 2", "Location.File": "o_totalprice > 280000",
    "Location.Line": "o_custkey = 0", "WhyItMatters": "o_totalprice < 20000", "Evidence[1].Detail": "o_custkey % 5 = 1",
}


@sql(
    "SELECT o_orderkey AS finding_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {bad} THEN '{field}' END" for field, bad in _BAD.items())
    + """, CASE WHEN o_totalprice >= 150000 AND o_custkey % 7 <> 0 AND o_custkey % 3 = 0 THEN 'Confidence' END, CASE WHEN o_totalprice < 150000 AND o_custkey % 4 = 0 THEN 'Evidence' END,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AND o_custkey % 2 = 0 THEN 'Severity' END, CASE WHEN o_orderstatus = 'O' AND (o_custkey % 7 = 0 OR o_custkey % 3 = 0) THEN 'Normalized_Category' END], lambda x: x IS NOT NULL), ',') AS fields FROM orders"""
)
def finding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the findings of orders, field by field."""
    c, k, month = F.col, F.col("o_custkey"), F.month("o_orderdate")
    digit = F.substring("o_orderpriority", 1, 1)
    severity = F.coalesce(*[F.when(digit == d, s) for d, s in zip("1235", ("CRITICAL", "HIGH", "MEDIUM", "INFO"), strict=True)], F.lit("LOWEST"))
    both = F.array(F.lit("IAM Review"), F.lit("Agent Review"))
    source = F.when(k % 7 == 0, F.reverse(F.array(F.lit("cfn-lint"), F.lit("cfn-guard")))).when(k % 3 == 0, both).otherwise(F.array(F.lit("cfn-lint")))
    entry = lambda detail: F.struct(F.lit("cfn-lint").alias("Source"), detail.alias("Detail"), F.when(k % 2 == 1, "W1").alias("RuleId"), F.when(k % 4 != 0, "read").alias("Excerpt"))
    rows = _table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("finding_id"), (c("o_orderkey") - 4).alias("ID"), F.when(c("o_orderstatus") == "O", "Other").otherwise("Logging").alias("Normalized_Category"),
        F.coalesce(*[F.when(c("o_orderstatus") == s, t) for s, t in (("F", "Validity"), ("O", "Security"))], F.lit("None")).alias("FindingType"), severity.alias("Severity"), F.when(c("o_totalprice") >= 150000, "Confirmed").otherwise("Likely").alias("Confidence"),
        source.alias("Source"), F.when(month == 2, " ").when(month != 3, "R").alias("Resource"),
        F.struct(F.when(c("o_totalprice") > 280000, "C:\\x").otherwise("x").alias("File"), k.cast("bigint").alias("Line"), F.lit(None).cast("bigint").alias("Column")).alias("Location"), F.lit("text").alias("Finding"), F.when(c("o_totalprice") >= 20000, "why").alias("WhyItMatters"),
        F.array(entry(F.lit("d")), entry(F.when(k % 5 != 1, "d"))).alias("Evidence"), F.lit("do").alias("Recommendation"), F.lit(None).cast("string").alias("SuggestedRemediation"),
    )
    return rows.select("finding_id", F.array_join(reports.violations(), ",").alias("fields"))


@sql(
    """WITH silent AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS name FROM customer WHERE c_acctbal < 0),
rows AS (SELECT o_orderkey, c_nationkey AS n, c_mktsegment AS s, o_orderpriority[1] AS p FROM orders JOIN customer ON c_custkey = o_custkey),
told AS (SELECT o_orderkey, p, CASE WHEN p = '1' THEN 'a credential-detection rule (W1011, W2501) reported this location' WHEN p IN ('2', '3') AND EXISTS (SELECT 1 FROM silent WHERE silent.n = rows.n AND name = s) THEN 'the location references a Parameter declared NoEcho: true' END AS why FROM rows)
SELECT o_orderkey AS id, CASE WHEN why IS NULL OR p = '5' THEN 'seen' ELSE 'seen The Excerpt for this evidence was redacted before reporting because ' || why || '; the Template text at this location is not reproduced.' END AS detail FROM told"""
)
def redaction_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of evidence, with a notice where the excerpt is withheld."""
    customers = _table(spark, sf_dir, "customer")
    template = F.col("c_nationkey").cast("string").alias("template_id")
    rows = _table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    p, s = F.substring("o_orderpriority", 1, 1), F.col("c_mktsegment")
    excerpt = F.when(p.isin("1", "2"), F.concat(F.lit("!Ref "), s)).when(p == "3", F.concat(F.lit("${"), s, F.lit("}"))).when(p == "4", F.concat(F.lit("Un"), s, F.lit("_x")))
    evidence = rows.select(template, F.col("o_orderkey").alias("id"), F.when(p == "1", "W2501").otherwise("E1").alias("rule_id"), F.lit("Resources/A").alias("place"), excerpt.alias("excerpt"), F.lit("seen").alias("detail"))
    return records.redacted(evidence, customers.where("c_acctbal < 0").select(template, s.alias("name")).distinct()).select("id", "detail")


@sql(
    """SELECT p_partkey AS k, sha256('{"a":[' || p_partkey || ',-' || p_size || '],"b":{"Brand#é":"' || p_name || '","x":null},"c":true,"z":[]}') AS digest,
  CASE WHEN p_partkey % 3 = 0 THEN '.e[]: path of a machine,.pid: key of a run' ELSE CASE WHEN p_size > 10 THEN '.pid: key of a run' ELSE '' END END AS unfit FROM part"""
)
def nested_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of nested records, and why others must not be kept."""
    c, k = F.col, F.col("p_partkey")
    both = F.create_map(F.lit("x"), F.lit(None).cast("string"), F.lit("Brand#é"), c("p_name"))
    record = F.struct(F.array().cast("array<int>").alias("z"), F.lit(True).alias("c"), both.alias("b"), F.array(k, -c("p_size").cast("bigint")).alias("a"))
    odd = F.struct(F.array(F.when(k % 3 == 0, "/home/x").otherwise("a/b")).alias("e"), F.when((c("p_size") > 10) | (k % 3 == 0), 7).alias("pid"))
    rows = _table(spark, sf_dir, "part").select(k.alias("k"), record.alias("record"), odd.alias("odd"))
    return rows.select("k", F.sha2(canonical.of(rows, "record"), 256).alias("digest"), F.array_join(F.array_sort(canonical.unfit(c("odd"), rows.schema["odd"].dataType)), ",").alias("unfit"))


_RANKED = lambda names, value: f"list_position([{', '.join(repr(n) for n in names)}], {value})"


@sql(
    f"""WITH {_REPORTS.split("found AS (")[0].rstrip().rstrip(",")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, resource, category ORDER BY {_RANKED(SOURCES, "sources[1]")}, wording, {_finding(None, 0, False)}) AS place,
  {_RANKED(SEVERITIES, "severity")} AS s, {_RANKED(("Contextual", "Likely", "Confirmed"), "confidence")} AS c FROM found0 WHERE resource IS NOT NULL AND category <> 'Other'),
said AS (SELECT o_custkey, resource, category, string_agg(o_orderkey::VARCHAR || who, ',' ORDER BY {_RANKED(SOURCES, "who")}, place) AS evidence, string_agg(DISTINCT who, ',' ORDER BY who) AS who
  FROM (SELECT *, unnest(sources) AS who FROM ranked) GROUP BY ALL),
groups AS (SELECT o_custkey, resource, category, max(s) AS s, CASE WHEN count(*) > 1 AND bool_or(list_contains(sources, 'Agent Review')) THEN least(max(c), 2) ELSE max(c) END AS c, arg_min(wording, place) AS wording, arg_min(o_orderkey, place) + 1 AS line FROM ranked GROUP BY ALL)
SELECT o_custkey AS report_id, resource, category, CASE s {' '.join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(SEVERITIES))} END AS severity, CASE c WHEN 2 THEN 'Likely' ELSE 'Confirmed' END AS confidence, wording, line, evidence, who AS sources
FROM groups JOIN said USING (o_custkey, resource, category)
UNION ALL SELECT o_custkey, resource, category, severity, confidence, wording, o_orderkey + 1, (SELECT string_agg(o_orderkey::VARCHAR || w, ',' ORDER BY i) FROM (SELECT unnest(sources) AS w, generate_subscripts(sources, 1) AS i)), array_to_string(list_sort(sources), ',') FROM found0 WHERE resource IS NULL OR category = 'Other'"""
)
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of orders merged within each report, resource and category."""
    rows = reports.merged(reports.ordered(findings_of_orders(_table(spark, sf_dir, "orders"))).drop("ID"))
    number = lambda e: F.regexp_extract(e["Detail"], "[0-9]+", 0)
    said = F.array_join(F.transform("Evidence", lambda e: F.concat(number(e), e["Source"])), ",")
    return rows.select("report_id", F.col("Resource").alias("resource"), F.col("Normalized_Category").alias("category"), F.col("Severity").alias("severity"), F.col("Confidence").alias("confidence"), F.col("Finding").alias("wording"), F.col("Location.Line").alias("line"), said.alias("evidence"), F.array_join(F.array_sort("Source"), ",").alias("sources"))


#: Parts of which a task makes documents.
TASK_PARTS = 10_000


def shared_documents(parts: DataFrame) -> DataFrame:
    """A YAML document a part: p_size lists each of which holds the one before twice, by aliases; a part whose key 9 divides has
    an alias to what holds it. Every seventh part has lists nested as deep as its key by 600, in JSON."""
    k, n = F.col("p_partkey"), F.col("p_size")
    name = lambda i: F.concat(F.lit("a"), i.cast("string"))
    lines = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(name(i), F.lit(": &"), name(i), F.when(i == 1, F.lit(" [x, y]")).otherwise(F.concat(F.lit(" [*"), name(i - 1), F.lit(", *"), name(i - 1), F.lit("]")))))
    body = F.concat(F.array_join(lines, "\n"), F.when(k % 9 == 0, "\nloop: &loop {x: [*loop]}").otherwise(""))
    deep = F.concat(F.repeat(F.lit("["), (k % 600).cast("int")), F.lit('"]"'), F.repeat(F.lit("]"), (k % 600).cast("int")))
    return parts.select(k.cast("string").alias("template_id"), F.when((k % 7 == 0) & (k % 600 > 0), deep).otherwise(body).alias("text"))


@sql(
    """WITH d AS (SELECT *, p_partkey % 7 = 0 AND p_partkey % 600 > 0 AS json, p_partkey % 600 AS deep, (1::HUGEINT << (p_size + 2)) - 3 - p_size AS n FROM part)
SELECT p_partkey::VARCHAR AS template_id, CASE WHEN json THEN CASE WHEN deep >= 64 THEN 'nested too deeply' END WHEN p_partkey % 9 = 0 THEN 'an alias refers to what holds it' WHEN n > 3000000 THEN 'too many nodes' END AS failure,
  (CASE WHEN json THEN CASE WHEN deep > 512 THEN 0 ELSE deep + 1 END WHEN p_partkey % 9 = 0 THEN 0 ELSE least(n, 3000001) END)::BIGINT AS n_nodes,
  (CASE WHEN json THEN CASE WHEN deep > 512 THEN 0 ELSE least(deep + 1, 65) END WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size + 2 END)::INTEGER AS depth FROM d"""
)
def template_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large documents are with their aliases written out, up to 2 ** 52 nodes, without writing them out."""
    parts = dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), TASK_PARTS, "p_partkey")  # before texts are made of them
    return templates.structures(shared_documents(parts))


@sql(
    """SELECT p_partkey::VARCHAR AS review_id, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size > 25 THEN 8 ELSE 0 END WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 8 ELSE CASE WHEN p_size % 2 = 0 THEN 0 ELSE 4 END END AS exit_status FROM part"""
)
def template_exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs over documents of parts end: with resources, none, or what can't be read."""
    k, n = F.col("p_partkey"), F.col("p_size")
    texts = [
        F.concat(F.lit("Resources:\n"), F.when(n > 25, "  {}").otherwise(F.concat(F.lit("  R: {Type: '"), "p_brand", F.lit("'}")))), F.lit('{"Resources": {"A": 1,}}'), F.lit("- Resources: {A: {}}"), F.lit('{"Resources": []}'),
        F.concat(F.lit('{"Resources": {"A": '), F.when(n % 2 == 0, "{}").otherwise("{"), F.lit("}}")),
    ]
    text = F.coalesce(*[F.when(k % 5 == i, t) for i, t in enumerate(texts)])
    return Review(_table(spark, sf_dir, "part").select(k.cast("string").alias("template_id"), text.alias("text")), ()).exit_status()


_DEEP = 12
#: Orders of which a task makes documents and parses them.
TASK_ORDERS = 25_000


@sql(
    f"""WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
p AS (SELECT c_custkey AS id, repeat(c_mktsegment, 5 + c_custkey % 40) AS t FROM customer WHERE c_custkey IN (SELECT id FROM o))
SELECT id::VARCHAR AS template_id, 'L' AS place, 'list' AS vtype, NULL AS sval FROM p UNION ALL SELECT id::VARCHAR, 'L/' || (i - 1), 'int', k::VARCHAR FROM o WHERE i <= 10
UNION ALL SELECT DISTINCT id::VARCHAR, 'L/10', 'str', '... [omitted: ' || (n - 10) || CASE WHEN n = 11 THEN ' item' ELSE ' items' END || ' more]' FROM o WHERE n > 10
UNION ALL SELECT id::VARCHAR, 'M', 'map', NULL FROM p UNION ALL SELECT id::VARCHAR, 'M/k' || k, 'list', NULL FROM o WHERE i <= 20 UNION ALL SELECT id::VARCHAR, 'M/k' || k || '/0', 'int', i::VARCHAR FROM o WHERE i <= 20
UNION ALL SELECT DISTINCT id::VARCHAR, 'M/__omitted__', 'str', '[omitted: ' || (n - 20) || CASE WHEN n = 21 THEN ' key' ELSE ' keys' END || ' more]' FROM o WHERE n > 20
UNION ALL SELECT id::VARCHAR, 'T', 'str', CASE WHEN length(t) > 200 THEN t[1:200] || '... [truncated]' ELSE t END FROM p
UNION ALL SELECT id::VARCHAR, 'D' || repeat('/0', d), CASE WHEN d < 10 THEN 'list' ELSE 'str' END, CASE WHEN d = 10 THEN '[omitted: sequence with 1 item]' END FROM p, (SELECT unnest(range(11)) AS d)"""
)
def bounded_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of documents of customers' orders: a list and a mapping of them, a long text, and lists in lists."""
    orders = dealt(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), TASK_ORDERS, "o_custkey")  # before texts are made of them
    ranked = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    rows = ranked.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    entries = F.array_join(F.transform("keys", lambda x, i: F.concat(F.lit('"k'), x.cast("string"), F.lit('": ['), (i + 1).cast("string"), F.lit("]"))), ", ")
    text = F.expr("repeat(c_mktsegment, cast(5 + c_custkey % 40 as int))")
    body = F.concat(F.lit('{"Resources": {"R": {"Properties": {"L": ['), F.array_join(F.transform("keys", lambda x: x.cast("string")), ", "), F.lit('], "M": {'), entries, F.lit('}, "T": "'), text, F.lit('", "D": ' + "[" * _DEEP + '"x"' + "]" * _DEEP + "}}}}"))
    table = templates.nodes(rows.select(F.col("c_custkey").cast("string").alias("template_id"), body.alias("text")), places=True, dealt=True)
    found = excerpts.bounded(table, 4)
    return found.select("template_id", F.array_join(F.slice("path", 4, 100), "/").alias("place"), "vtype", "sval")
