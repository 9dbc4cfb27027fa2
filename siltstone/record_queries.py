"""Records of reviews and profile rules over rows made from the tables' keys; DuckDB SQL that works from the keys."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import records
from siltstone.plans.settle import settled
from siltstone.rules import profiles
from siltstone.sources.templates import Relations, nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))


def _rows(rows: list[tuple]) -> str:
    word = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(word, r)) + ")" for r in rows)


#: A path, what it becomes, and why it is refused; N stands for the key.
_PATHS = [
    ("a/b/N.yaml", "a/b/N.yaml", None), ("./a//b/./N", "a/b/N", None), ("a\\N\\c", "a/N/c", None), ("/a/N", None, "absolute"), ("C:\\N", None, "absolute"), ("", None, "empty"), ("././", None, "empty"), (None, None, "empty"), ("a/../N", None, "climbs"),
    ("..", None, "climbs"), ("a/..b/N", "a/..b/N", None), ("N/", "N", None), ("\\N", None, "absolute"),
]


@sql(f"SELECT c_custkey AS k, replace(path, 'N', c_custkey::VARCHAR) AS path, refused FROM customer JOIN ({_rows([(i, p, r) for i, (_, p, r) in enumerate(_PATHS)])}) v(i, path, refused) ON c_custkey % {len(_PATHS)} = i")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as reports tell them, or why not."""
    known = F.broadcast(spark.createDataFrame([(i, p) for i, (p, *_) in enumerate(_PATHS)], "i int, raw string"))
    rows = _keys(spark, sf_dir).withColumn("i", (F.col("k") % len(_PATHS)).cast("int")).join(known, "i")
    return rows.select("k", records.output_path(F.replace("raw", F.lit("N"), F.col("k").cast("string"))).alias("p")).select("k", "p.path", "p.refused")


#: Rule, place and excerpt of evidence, with what it is withheld for where the parameters Db and Token must not be shown.
_EVIDENCE = [
    ("W1011", "Resources/A", "text N", "credential_rule"), ("W2501", "Parameters/Db", None, "credential_rule"), ("E1", "Parameters/Db/Default", "v N", "no_echo_parameter"), ("E1", "Parameters/Dbx", "v N", "none"), ("E1", "Resources/A", "!Ref Db", "no_echo_parameter"),
    ("E1", "Resources/A", "MyDb and Db_2 N", "none"), (None, "Resources/A", "${Token}", "no_echo_parameter"), (None, None, "a Token-N", "no_echo_parameter"), (None, "Resources/Db", "x", "none"), ("E1", "Parameters/Token", None, "no_echo_parameter"),
]


@sql(f"SELECT c_custkey AS k, trigger, CASE WHEN excerpt IS NULL THEN NULL WHEN trigger <> 'none' THEN '[REDACTED]' ELSE replace(excerpt, 'N', c_custkey::VARCHAR) END AS excerpt FROM customer JOIN ({_rows([(i, e, t) for i, (_, _, e, t) in enumerate(_EVIDENCE)])}) v(i, excerpt, trigger) ON c_custkey % {len(_EVIDENCE)} = i")
def evidence_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of evidence withheld where a credential rule or a silent parameter asks for it."""
    known = F.broadcast(spark.createDataFrame([(i, *e[:3]) for i, e in enumerate(_EVIDENCE)], "i int, rule_id string, place string, raw string"))
    rows = _keys(spark, sf_dir).withColumn("i", (F.col("k") % len(_EVIDENCE)).cast("int")).join(known, "i")
    template = F.concat(F.lit("t"), (F.col("k") % 50).cast("string")).alias("template_id")
    evidence = rows.select(template, F.col("k").alias("id"), "rule_id", "place", F.replace("raw", F.lit("N"), F.col("k").cast("string")).alias("excerpt"))
    silent = rows.select(template, F.explode(F.array(F.lit("Db"), F.lit("Token"))).alias("name")).distinct()
    return records.redacted(evidence, silent).select(F.col("id").alias("k"), "trigger", "excerpt")


@sql("""SELECT c_custkey AS k, sha256('{"a":"' || c_custkey || '","b":null,"c":"' || c_mktsegment || '","zz":"x\\"y"}') AS digest FROM customer""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of canonical texts."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    fields = F.create_map(F.lit("zz"), F.lit('x"y'), F.lit("c"), F.col("c_mktsegment"), F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.col("c_custkey").cast("string"))
    return rows.select(F.col("c_custkey").alias("k"), records.digest(fields).alias("digest"))


#: Tools of a pair of reports (side, name, available, version), whether there is an error, and whether summaries compare.
_PAIRS = [
    ([("base", "a", True, "1"), ("head", "a", True, "1")], False, True), ([("base", "a", True, "1"), ("head", "a", True, "2")], False, False), ([("base", "a", True, None), ("head", "a", True, None)], False, True),
    ([("base", "a", True, "1"), ("head", "b", True, "1")], False, False), ([("base", "a", False, "1"), ("head", "a", True, "1")], False, False), ([("base", "a", True, "1"), ("head", "a", True, "1")], True, False), ([], True, False),
]


@sql(f"SELECT c_custkey AS pair, comparable FROM customer JOIN ({_rows([(i, c) for i, (_, _, c) in enumerate(_PAIRS)])}) v(i, comparable) ON c_custkey % {len(_PAIRS)} = i")
def summaries_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two reports' summaries may be compared."""
    keys = _keys(spark, sf_dir).select(F.col("k").alias("pair"), (F.col("k") % len(_PAIRS)).cast("int").alias("i"))
    tools = F.broadcast(spark.createDataFrame([(i, *t) for i, (ts, _, _) in enumerate(_PAIRS) for t in ts], "i int, side string, name string, available boolean, version string"))
    return records.summaries_comparable(keys.join(tools, "i"), keys.where(F.col("i").isin([i for i, p in enumerate(_PAIRS) if p[1]])))


@sql(
    """SELECT c_custkey AS pair, CASE WHEN c_custkey % 7 = 0 THEN 'not_applicable' WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 1 OR c_custkey % 11 = 0 THEN 'inconsistent' ELSE 'consistent_by_name_only' END AS correspondence FROM customer"""
)
def report_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether reports belong to the templates that they are compared with."""
    k = F.col("k")
    rows = _keys(spark, sf_dir)
    pairs = rows.select(k.alias("pair"), (k % 7 != 0).alias("declared"), (k % 5 != 0).alias("readable"), F.lit("./a.yaml").alias("base_file"), F.when(k % 11 == 0, "/a.yaml").otherwise("a.yaml").alias("head_file"))
    side = F.explode(F.array(F.lit("base"), F.lit("head"))).alias("side")
    targets = rows.select(k.alias("pair"), side, F.when(k % 3 == 0, "b.yaml").otherwise("a.yaml").alias("file"))
    named = rows.select(k.alias("pair"), side, F.lit("a.yaml").alias("file"), F.explode(F.array(F.lit("A"), F.lit(None).cast("string"), F.when(k % 4 == 1, "Gone").otherwise("B"))).alias("resource"))
    resources = rows.select(k.alias("pair"), F.lit("base").alias("side"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("resource")).unionByName(rows.select(k.alias("pair"), F.lit("head").alias("side"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("resource")))
    return records.corresponding(pairs, targets, named, resources)


@sql("SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'SOURCE_MISSING' WHEN c_custkey % 3 = 0 THEN 'APPEARED_AFTER_MAPPING' WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE 'MATCH' END AS status FROM customer")
def recorded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded files against what is there."""
    k = F.col("k")
    rows, path = _keys(spark, sf_dir), F.concat(F.lit("f"), F.col("k").cast("string")).alias("path")
    recorded = rows.select(path, F.when(k % 3 != 0, F.sha2(k.cast("string"), 256)).alias("digest"))
    return records.file_states(recorded, rows.where(k % 4 != 0).select(path, F.sha2(F.when(k % 5 == 0, F.lit("other")).otherwise(k.cast("string")), 256).alias("digest")))


def _table(**properties: object) -> dict:
    return {"Type": "AWS::DynamoDB::Table", "Properties": properties}


def _role(*statements: dict) -> dict:
    return {"Type": "AWS::IAM::Role", "Properties": {"Policies": [{"PolicyDocument": {"Statement": list(statements)}}]}}


_OK = {"Sid": "Keep", "Effect": "Allow", "Action": "s3:GetObject"}
#: A target resource, or none, and whether each profile rule passes: billing mode, not over-broad, required statement.
_TARGETS = [
    (_table(BillingMode="PAY_PER_REQUEST"), True, False, False), (_table(BillingMode="PAY_PER_REQUEST", ProvisionedThroughput={"A": 1}), False, False, False), (_table(ProvisionedThroughput={"A": 1}), True, False, False), (_table(), False, False, False),
    (_table(BillingMode="PROVISIONED", ProvisionedThroughput={"A": 1}), True, False, False), (_table(BillingMode="FREE", ProvisionedThroughput={"A": 1}), False, False, False), (None, False, False, False), (_role(_OK), False, True, True), (_role(_OK | {"Action": ["a:b", "s3:*"]}), False, False, True),
    (_role(_OK | {"Effect": "Deny", "Action": "*"}), False, True, False), (_role({"Effect": "Allow", "NotAction": "x:y"}, _OK), False, False, True), (_role(_OK | {"Sid": "Other", "Action": "s3:Get*"}), False, True, False), ({"Type": "AWS::IAM::Role", "Properties": {}}, False, True, False),
]


@sql(f"SELECT 'c' || c_custkey AS template_id, billing_mode_consistent, no_overbroad_allow_statement, required_statement_present FROM customer JOIN ({_rows([(i, *t[1:]) for i, t in enumerate(_TARGETS)])}) v(i, billing_mode_consistent, no_overbroad_allow_statement, required_statement_present) ON c_custkey % {len(_TARGETS)} = i")
def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of remediation profiles over a target of each template."""
    texts = [(i, json.dumps({"Resources": {"Other": {"Type": "AWS::SNS::Topic"}} | ({"Target": t[0]} if t[0] else {})})) for i, t in enumerate(_TARGETS)]
    known = F.broadcast(spark.createDataFrame(texts, "i int, text string"))
    rows = _keys(spark, sf_dir).withColumn("i", (F.col("k") % len(_TARGETS)).cast("int")).join(known, "i").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("template_id"), "text")
    relations = Relations(settled(nodes(rows)))
    targets = rows.select("template_id", F.lit("Target").alias("logical_id"))
    both = profiles.billing_mode(relations, targets).join(profiles.inline_statements(relations, targets, "Keep"), ["template_id", "logical_id"])
    return both.select("template_id", F.col("passes").alias("billing_mode_consistent"), F.col("not_overbroad").alias("no_overbroad_allow_statement"), F.col("required").alias("required_statement_present"))
