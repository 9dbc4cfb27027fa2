"""Facts of templates: references with where they stand, parameters and who uses them, availability, what policies say, how rules went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.rules import iam, properties
from siltstone.sources.templates import Relations

# Names of properties that speak of availability, and what a value that is not shown is replaced by.
AVAILABILITY = (
    "AvailabilityZone",
    "AvailabilityZoneCount",
    "AvailabilityZones",
    "DBSubnetGroupName",
    "MultiAZ",
    "SubnetGroupName",
    "SubnetId",
    "SubnetIds",
    "SubnetMappings",
    "Subnets",
    "VPCZoneIdentifier",
)
HIDDEN = "[REDACTED]"
_TOKEN = r"\$\{([A-Za-z0-9:._-]+)\}"


def _halves(name: Column) -> tuple[Column, Column]:
    """A name before its first dot, and what comes after, null if nothing does."""
    return F.substring_index(name, ".", 1), F.nullif(F.regexp_extract(name, r"^[^.]*\.(.*)$", 1), F.lit(""))


def references(relations: Relations) -> DataFrame:
    """Distinct (template_id, src, dst, kind, attribute, place) of what resources say of other names, anywhere in them.

    place is where the function stands. Names in a substitution that its own variables shadow are left out.
    """
    nodes = relations.nodes.where("get(path, 0) = 'Resources' and size(path) > 2").withColumn("src", F.get("path", F.lit(1)))
    key, above = F.try_element_at("path", F.lit(-1)), F.try_element_at("path", F.lit(-2))
    text = F.col("vtype") == "str"
    cut = lambda n: F.array_join(F.slice("path", 1, F.size("path") - n), "/")
    own = ["template_id", "src"]
    ref = nodes.where((key == "Ref") & text).select(*own, F.col("sval").alias("dst"), F.lit("Ref").alias("kind"), F.lit(None).cast("string").alias("attribute"), cut(1).alias("place"))
    target, attribute = _halves(F.col("sval"))
    short = nodes.where((key == "Fn::GetAtt") & text).select(*own, target.alias("dst"), F.lit("Fn::GetAtt").alias("kind"), attribute.alias("attribute"), cut(1).alias("place"))
    parts = nodes.where((above == "Fn::GetAtt") & text).groupBy(*own, F.slice("path", 1, F.size("path") - 2).alias("at")).agg(F.array_sort(F.collect_list(F.struct("ord", key.alias("i"), "sval"))).alias("parts"))
    parts = parts.where("parts[0].i = '0'")
    long = parts.select(*own, F.col("parts")[0]["sval"].alias("dst"), F.lit("Fn::GetAtt").alias("kind"), F.nullif(F.array_join(F.transform(F.slice("parts", 2, 100), lambda x: x["sval"]), "."), F.lit("")).alias("attribute"), F.array_join("at", "/").alias("place"))
    plain = nodes.where((key == "Fn::Sub") & text).select(*own, F.slice("path", 1, F.size("path") - 1).alias("at"), "sval")
    first = nodes.where((above == "Fn::Sub") & (key == "0") & text).select(*own, F.slice("path", 1, F.size("path") - 2).alias("at"), "sval")
    shadow = nodes.where((F.try_element_at("path", F.lit(-3)) == "Fn::Sub") & (above == "1")).groupBy(*own, F.slice("path", 1, F.size("path") - 3).alias("at")).agg(F.collect_set(key).alias("shadowed"))
    names = plain.unionByName(first).join(shadow, [*own, "at"], "left").select(*own, "at", "shadowed", F.explode(F.regexp_extract_all("sval", F.lit(_TOKEN), F.lit(1))).alias("name"))
    target, attribute = _halves(F.col("name"))
    names = names.withColumns({"dst": target, "attribute": attribute})
    names = names.where(~F.coalesce(F.array_contains("shadowed", F.col("name")) | F.array_contains("shadowed", F.col("dst")), F.lit(False)))
    sub = names.select(*own, "dst", F.lit("Fn::Sub").alias("kind"), "attribute", F.array_join("at", "/").alias("place"))
    return ref.unionByName(short).unionByName(long).unionByName(sub).distinct()


def resource_references(relations: Relations) -> DataFrame:
    """The references between resources of a template."""
    known = relations.resources.select("template_id", F.col("logical_id").alias("dst"))
    return references(relations).where("src != dst").join(known, ["template_id", "dst"], "left_semi").select("template_id", "src", "dst", "kind", "attribute", "place")


def parameters(relations: Relations) -> DataFrame:
    """(template_id, name, type, no_echo, default_value, referenced_by): the default of one that must not be shown is hidden."""
    body = relations.nodes.where("get(path, 0) = 'Parameters' and size(path) = 3")
    value = lambda k: F.max(F.when(F.get("path", F.lit(2)) == k, F.col("sval")))
    silent = F.bool_or((F.get("path", F.lit(2)) == "NoEcho") & F.col("vtype").isin("bool", "str") & (F.lower(F.trim("sval")) == "true"))
    held = body.groupBy("template_id", F.get("path", F.lit(1)).alias("name")).agg(value("Type").alias("type"), F.coalesce(silent, F.lit(False)).alias("no_echo"), value("Default").alias("default"))
    used = references(relations).groupBy("template_id", F.col("dst").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("referenced_by"))
    shown = F.when(F.col("no_echo") & F.col("default").isNotNull(), HIDDEN).otherwise(F.col("default"))
    return held.join(used, ["template_id", "name"], "left").select("template_id", "name", "type", "no_echo", shown.alias("default_value"), F.coalesce("referenced_by", F.lit("")).alias("referenced_by"))


def availability(relations: Relations) -> DataFrame:
    """(template_id, resource, place): where resources speak of zones and subnets."""
    own = relations.nodes.where("get(path, 0) = 'Resources' and size(path) > 2").where(F.try_element_at("path", F.lit(-1)).isin(*AVAILABILITY))
    return own.select("template_id", F.get("path", F.lit(1)).alias("resource"), F.array_join("path", "/").alias("place"))


def policy_statistics(relations: Relations) -> DataFrame:
    """(template_id, documents, statements, allowing): how many policies and statements each template with any has."""
    found = iam.statements(relations)
    return found.groupBy("template_id").agg(F.count_distinct("logical_id", "doc").alias("documents"), F.count("*").alias("statements"), F.count_if(F.col("effect") == "allow").alias("allowing"))


def rule_statistics(relations: Relations) -> DataFrame:
    """(template_id, evaluated, failing, not_applicable): of all property rules, how many had a resource to test, failed, or had none."""
    table = relations.nodes.sparkSession.createDataFrame([(r, t) for _, r, t, *_ in properties.clauses()] + [("vpc_flow_logs", "AWS::EC2::VPC"), ("iam_policy_no_star_star", "AWS::IAM::Policy"), ("iam_policy_no_star_star", "AWS::IAM::ManagedPolicy")], "rule_id string, type string")
    rules = len({r for _, r, *_ in properties.clauses()}) + 2
    due = relations.resources.join(F.broadcast(table.distinct()), "type").groupBy("template_id").agg(F.count_distinct("rule_id").alias("evaluated"))
    bad = properties.findings(relations).groupBy("template_id").agg(F.count_distinct("rule_id").alias("failing"))
    out = relations.nodes.select("template_id").distinct().join(due, "template_id", "left").join(bad, "template_id", "left")
    evaluated = F.coalesce("evaluated", F.lit(0))
    return out.select("template_id", evaluated.alias("evaluated"), F.coalesce("failing", F.lit(0)).alias("failing"), (rules - evaluated).alias("not_applicable"))
