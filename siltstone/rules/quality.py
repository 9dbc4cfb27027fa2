"""Rules over parameters, conditions and dependencies of a template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graphs
from siltstone.plans.settle import settled
from siltstone.rules.network import row
from siltstone.sources.templates import Relations

# Shapes of condition names, first match first, and the environment they speak of.
_ENVIRONMENTS = ((r"(?i)is[_-]?prod(uction)?\b", "prod"), (r"(?i)is[_-]?stag(ing|e)?\b", "stag"), (r"(?i)is[_-]?dev(elopment)?\b", "dev"), (r"(?i)is[_-]?test\b", "test"))


def _found(df: DataFrame, rule: str, severity: str, text: str, kind: str = "BestPractice", resource: str = "name") -> DataFrame:
    return df.select(*row(rule, severity, "Other", kind, "Quality Review", F.concat("name", F.lit(text)), resource))


def findings(relations: Relations) -> DataFrame:
    """Names that contradict conditions, unused parameters and conditions, cycles, allowed values of mixed types."""
    nodes = relations.nodes
    key = F.element_at("path", -1)
    tokens = F.regexp_extract_all("sval", F.lit(r"\$\{([A-Za-z0-9:._-]+)\}"), F.lit(1))
    names = F.when((key == "Ref") | (key == "0") & F.col("shape").endswith("Fn::GetAtt/*"), F.array("sval"))
    names = names.when(F.col("shape").endswith("Fn::Sub") | F.col("shape").endswith("Fn::Sub/*"), F.transform(tokens, lambda t: F.substring_index(t, ".", 1)))
    used_in = nodes.where((F.col("vtype") == "str") & F.get("path", F.lit(0)).isin("Resources", "Conditions", "Outputs"))
    used = used_in.select("template_id", F.explode(names).alias("name")).distinct()
    told = settled(nodes.where((F.size("path") <= 4) & F.get("path", F.lit(0)).isin("Parameters", "Conditions")))  # little of a template, read four times
    section = lambda name: told.where((F.size("path") == 2) & (F.get("path", F.lit(0)) == name)).select("template_id", F.get("path", F.lit(1)).alias("name"))
    unused = section("Parameters").join(used, ["template_id", "name"], "left_anti")

    conditions = section("Conditions")
    within = "get(path, 0) in ('Conditions', 'Outputs') or get(path, 0) = 'Resources' and get(path, 2) = 'Properties'"
    by_resource = (F.size("path") == 3) & F.expr("get(path, 0) = 'Resources' and get(path, 2) = 'Condition'")
    by_if = (key == "0") & F.col("shape").endswith("Fn::If/*")
    by_key = (key == "Condition") & (F.size("path") > 2)
    named = nodes.where((F.col("vtype") == "str") & (by_resource | (by_if | by_key) & F.expr(within))).select("template_id", F.col("sval").alias("name")).distinct()
    idle = conditions.join(named, ["template_id", "name"], "left_anti")

    literal = told.where("get(path, 0) = 'Conditions' and size(path) = 4 and get(path, 2) = 'Fn::Equals'").groupBy("template_id", F.get("path", F.lit(1)).alias("name")).agg(F.count("*").alias("n"), F.min(F.when(F.col("vtype") == "str", F.struct("ord", "sval")))["sval"].alias("literal"))
    wanted = F.when(F.lit(False), "")
    for pattern, env in _ENVIRONMENTS:
        wanted = wanted.when(F.col("name").rlike(pattern), env)
    said = F.lower("literal")
    other = F.exists(F.array(*[F.lit(e) for _, e in _ENVIRONMENTS]), lambda e: (e != F.col("wanted")) & F.contains(said, e))
    wrong = literal.where("n = 2 and literal is not null").withColumn("wanted", wanted).where(F.col("wanted").isNotNull() & ~F.contains(said, F.col("wanted")) & other)

    rings = graphs.first_cycles(relations.edges(with_order=True), relations.resources.select("template_id", F.col("logical_id").alias("node"), "ord"))
    rings = rings.select("template_id", F.get("cycle", F.lit(0)).alias("resource"), F.array_join("cycle", " -> ").alias("name"))

    values = told.where("get(path, 0) = 'Parameters' and size(path) = 4 and get(path, 2) = 'AllowedValues'").groupBy("template_id", F.get("path", F.lit(1)).alias("name"))
    mixed = values.agg(F.bool_or(F.col("vtype") == "str").alias("a"), F.bool_or(F.col("vtype") != "str").alias("b")).where("a and b")
    parts = [
        _found(wrong, "condition_name_logic_mismatch", "MEDIUM", ": the condition's name and what it compares speak of different environments"),
        _found(unused, "unused_parameter", "LOW", ": the parameter is not used"),
        _found(idle, "unused_condition", "LOW", ": the condition is not used"),
        _found(rings, "circular_dependency", "HIGH", ": the resources depend on each other", "Validity", "resource"),
        _found(mixed, "allowed_values_mixed_types", "LOW", ": the allowed values mix text and other types"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
