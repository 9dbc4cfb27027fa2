"""Rules of remediation profiles over one target resource of each template: an absent target fails, it is not skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.templates import Relations

# The modes of billing.
MODES = ("PAY_PER_REQUEST", "PROVISIONED")


def _nodes(relations: Relations, targets: DataFrame, columns: list[Column], keep: Column) -> DataFrame:
    """What is told of resources, a row a node that is kept, with one row more for each target (template_id, logical_id), of which
    `target` is true: so grouped by resource that no side has to be joined, and a task holds no more than it parsed."""
    told = relations.props.where(keep).select("template_id", "logical_id", *columns)
    rows = told.unionByName(targets.select("template_id", "logical_id", F.lit(True).alias("target")), allowMissingColumns=True)
    return rows.repartition(relations.tasks, "template_id", "logical_id")


def _is(kind: str) -> Column:
    """Whether a node tells that its resource is of a type."""
    return F.coalesce((F.col("prop") == "Type") & (F.col("sval") == f"AWS::{kind}"), F.lit(False))


def billing_mode(relations: Relations, targets: DataFrame) -> DataFrame:
    """(template_id, logical_id, passes): a table whose mode is valid, with a throughput exactly if it is provisioned, as it is by default."""
    columns = [c.alias(n) for n, c in {
        "kind": _is("DynamoDB::Table"), "mode": F.when(F.col("prop") == "Properties/BillingMode", F.struct("vtype", "sval")),
        "throughput": F.col("prop") == "Properties/ProvisionedThroughput", "struct": (F.col("prop") == "Properties") & (F.col("vtype") == "map"),
    }.items()]
    rows = _nodes(relations, targets, columns, F.col("prop").isin("Type", "Properties", "Properties/BillingMode", "Properties/ProvisionedThroughput"))
    own = rows.groupBy("template_id", "logical_id").agg(F.max("mode").alias("mode"), *[F.bool_or(n).alias(n) for n in ("kind", "throughput", "struct", "target")]).where("target")
    told = lambda name: F.coalesce(name, F.lit(False))
    on_demand = F.coalesce(F.col("mode.sval") == MODES[0], F.lit(False))
    valid = F.col("mode").isNull() | F.coalesce(F.col("mode.sval").isin(*MODES) & (F.col("mode.vtype") == "str"), F.lit(False))
    passes = told("kind") & told("struct") & valid & (on_demand != told("throughput"))
    return own.select("template_id", "logical_id", passes.alias("passes"))


def inline_statements(relations: Relations, targets: DataFrame, sid: str) -> DataFrame:
    """(template_id, logical_id, not_overbroad, required): of a role's inline statements, whether none that allows says NotAction,
    * or all actions of a service, and whether one of the given Sid allows."""
    part = lambda n: F.regexp_extract("place", r"^(Properties/Policies/[0-9]+/PolicyDocument/Statement/[0-9]+)/(Effect|Action|NotAction|Sid)(?:/[0-9]+)?$", n)
    columns = [_is("IAM::Role").alias("kind"), part(1).alias("stmt"), part(2).alias("key"), "sval"]
    said = _nodes(relations, targets, columns, (F.col("prop") == "Type") | F.col("prop").startswith("Properties/Policies/*/PolicyDocument/Statement/*/"))
    says = lambda key, test: F.bool_or((F.col("key") == key) & F.coalesce(test, F.lit(False)))
    value, stated = F.col("sval"), F.coalesce(F.col("stmt") != "", F.lit(False))
    stmts = said.groupBy("template_id", "logical_id", "stmt").agg(
        says("Effect", value == "Allow").alias("allows"), F.bool_or(F.col("key") == "NotAction").alias("inverse"),
        says("Action", (value == "*") | value.rlike(r"^[A-Za-z0-9-]+:\*\z")).alias("broad"), says("Sid", value == sid).alias("named"), F.bool_or("kind").alias("kind"), F.bool_or("target").alias("target"),
    )
    allowed = stated & F.col("allows")
    by = stmts.groupBy("template_id", "logical_id").agg(F.bool_or(allowed & (F.col("inverse") | F.col("broad"))).alias("over"), F.bool_or(allowed & F.col("named")).alias("has"), F.bool_or("kind").alias("kind"), F.bool_or("target").alias("target"))
    role = F.coalesce("kind", F.lit(False))
    return by.where("target").select("template_id", "logical_id", (role & ~F.coalesce("over", F.lit(False))).alias("not_overbroad"), (role & F.coalesce("has", F.lit(False))).alias("required"))
