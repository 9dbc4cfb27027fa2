"""What differs between two versions of templates, in the units that a reader thinks in."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

# Sections that are compared entry by entry, attributes of a resource that are compared node by node, sections
# whose changes work elsewhere, functions that look outside, the mark of a dynamic reference, and what limits a comparison.
ENTRY_SECTIONS = ("Resources", "Parameters", "Conditions", "Outputs", "Mappings")
ATTRIBUTES = ("Properties", "DependsOn", "Condition", "DeletionPolicy", "UpdateReplacePolicy", "UpdatePolicy", "CreationPolicy", "Metadata")
INDIRECT_SECTIONS = ("Parameters", "Mappings", "Conditions")
EXTERNAL = ("Fn::ImportValue", "Fn::GetAZs")
DYNAMIC = "{{resolve:"
QUALIFIERS = ("expression_unevaluated", "conditional", "dynamic_reference_unresolved", "external_value", "pre_transform")
#: Changes of a template from which its comparison counts as failed.
MOST = 200_000
_NODE = ("template_id", "path", "vtype", "sval")


def _key(i: int) -> Column:
    return F.get("path", F.lit(i))


def _above(path: Column, least: int) -> Column:
    """The paths above one, from `least` steps on."""
    return F.when(F.size(path) > least, F.transform(F.sequence(F.lit(least), F.size(path) - 1), lambda n: F.slice(path, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def compared(base: DataFrame, head: DataFrame) -> DataFrame:
    """(template_id, path, b, h, bt, ht, bv, hv): the nodes of both versions by path; those that cannot be compared, and all
    below them, left out (see uncompared)."""
    return _compared(base, head, settled(uncompared(base, head)))


def _compared(base: DataFrame, head: DataFrame, odd: DataFrame) -> DataFrame:
    rows = base.select(*_NODE, F.lit(False).alias("new")).unionByName(head.select(*_NODE, F.lit(True).alias("new"))).where("vtype != 'error'")
    rows = rows.repartition(base.rdd.getNumPartitions() + head.rdd.getNumPartitions(), "template_id")  # and there all that follows stays
    of = lambda new, value: F.max(F.when(F.col("new") == new, value))
    sides = [(of(new, F.lit(True)).alias(s), of(new, F.col("vtype")).alias(f"{s}t"), of(new, F.col("sval")).alias(f"{s}v")) for new, s in ((False, "b"), (True, "h"))]
    both = rows.groupBy("template_id", "path").agg(*[column for pair in zip(*sides, strict=True) for column in pair])
    if not odd.take(1):
        return both
    odd = odd.select("template_id", "path")
    held = both.join(odd.select("template_id").distinct(), "template_id", "left_semi")  # only these templates' nodes are looked through
    below = held.select("template_id", "path", F.explode(F.concat(_above(F.col("path"), 0), F.array("path"))).alias("up")).join(odd.withColumnRenamed("path", "up"), ["template_id", "up"], "left_semi").select("template_id", "path").distinct()
    return both.join(below, ["template_id", "path"], "left_anti")


def _one_sided(base: DataFrame, head: DataFrame, odd: DataFrame) -> DataFrame:
    """(template_id, change, type): resources that can't be compared and stand in one version only, as if they were removed or added;
    the type is null where it is not told by one text."""
    names = odd.where((F.size("path") == 2) & (_key(0) == "Resources")).select("template_id", F.col("path").alias("owner")).distinct()

    def side(df: DataFrame, change: str) -> DataFrame:
        own = df.where((F.size("path").isin(2, 3)) & (_key(0) == "Resources")).withColumn("owner", F.slice("path", 1, 2)).join(names, ["template_id", "owner"], "left_semi")
        kinds = F.collect_set(F.when((F.size("path") == 3) & (_key(2) == "Type") & ~F.col("dup_key"), F.when(F.col("vtype") == "str", F.col("sval")))).alias("kinds")
        return own.groupBy("template_id", "owner").agg(kinds, F.bool_or((F.size("path") == 2) & F.col("dup_key")).alias("again")).select("template_id", "owner", F.lit(change).alias("change"), F.when((F.size("kinds") == 1) & ~F.col("again"), F.col("kinds")[0]).alias("type"))

    both = side(base, "removed").unionByName(side(head, "added"))
    alone = both.groupBy("template_id", "owner").agg(F.count_distinct("change").alias("n")).where("n = 1").select("template_id", "owner")
    return both.join(alone, ["template_id", "owner"], "left_semi").select("template_id", "change", "type")


def uncompared(base: DataFrame, head: DataFrame) -> DataFrame:
    """(template_id, path, reason): the topmost nodes of either version under a repeated key, or with a time stamp."""
    odd = base.unionByName(head).where("dup_key or vtype = 'timestamp'")
    odd = odd.groupBy("template_id", "path").agg(F.when(F.bool_or("dup_key"), "duplicate_key").otherwise("yaml_timestamp").alias("reason"))
    below = odd.select("template_id", "path", F.explode(_above(F.col("path"), 1)).alias("up")).join(odd.select("template_id", F.col("path").alias("up")), ["template_id", "up"], "left_semi")
    return odd.join(below.select("template_id", "path").distinct(), ["template_id", "path"], "left_anti")


def _marked(both: DataFrame) -> DataFrame:
    """Nodes that tell of expressions, dynamic references or the outside, with the flags."""
    last = F.try_element_at("path", F.lit(-1))
    # a key is an expression's only below an entry's name: sections and names are no functions
    function = (F.size("path") > 2) & ((last == "Ref") | last.startswith("Fn::"))
    pseudo = (last == "Ref") & (F.coalesce(F.col("bv").startswith("AWS::"), F.lit(False)) | F.coalesce(F.col("hv").startswith("AWS::"), F.lit(False)))
    dynamic = F.coalesce(F.contains("bv", F.lit(DYNAMIC)), F.lit(False)) | F.coalesce(F.contains("hv", F.lit(DYNAMIC)), F.lit(False))
    flags = {"expression": function, "dynamic_reference": dynamic, "external": function & (last.isin(*EXTERNAL) | pseudo)}
    return both.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).where(" or ".join(flags)).select("template_id", "path", *flags)


def limitations(base: DataFrame, head: DataFrame) -> DataFrame:
    """(template_id, limitation) of what either version holds that a comparison does not follow."""
    nodes = base.unionByName(head).where("vtype != 'error'")
    last, text = F.try_element_at("path", F.lit(-1)), F.col("vtype") == "str"
    kinds = {
        "transform_not_expanded": (F.size("path") >= 1) & (_key(0) == "Transform") | (last == "Fn::Transform") | text & (F.col("sval") == "AWS::Include"),
        "nested_stack_not_compared": (last == "Type") & text & (F.col("sval") == "AWS::CloudFormation::Stack"),
        "dynamic_reference_unresolved": text & F.contains("sval", F.lit(DYNAMIC)),
    }
    held = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in kinds.items()]))
    return nodes.where(reduce(or_, kinds.values())).select("template_id", F.explode(held).alias("limitation")).distinct()


def changes(base: DataFrame, head: DataFrame, most: int = MOST, limits: DataFrame | None = None) -> DataFrame:
    """(template_id, section, path, change, type_changed, qualifiers, hint, failed) of two node tables.

    Entries are compared node by node; a section that has no entries, and an attribute of a resource that is not known, is
    one unit; so is a resource whose type changes. Of what is added, removed or modified only the topmost is told.
    Qualifiers tell of what stands in a unit or around it; a hint tells of a resource removed and one added of one type, or of any
    type where the other one can't be compared and has no type that is known. A template of more than `most` changes has failed. Node tables have the columns of sources.templates.nodes and
    should be settled: their nodes are compared in as many tasks as they have. limits are limitations() of both, if at hand.
    """
    odd = settled(uncompared(base, head))
    both = settled(_compared(base, head, odd))
    # what is told of entries by themselves, their type and their condition: read once
    resource, at = _key(0) == "Resources", F.size("path")
    heads = both.where(resource & (at == 2) | _key(0).isin("Resources", "Outputs") & (at == 3) & _key(2).isin("Type", "Condition")).withColumn("owner", F.slice("path", 1, 2))
    kind = resource & (at == 3) & (_key(2) == "Type")
    heads = settled(heads.groupBy("template_id", "owner").agg(
        F.bool_or(resource & (at == 2) & (F.col("bt") == "map") & (F.col("ht") == "map")).alias("held"),
        F.max(F.when(kind, F.struct("bv", "hv", "bt", "ht"))).alias("kind"),
        F.bool_or((at == 3) & (_key(2) == "Condition")).alias("gated"),
    ))
    turned = heads.where(F.col("held") & ~(F.col("kind.bv").eqNullSafe(F.col("kind.hv")) & F.col("kind.bt").eqNullSafe(F.col("kind.ht")))).select("template_id", "owner", F.lit(True).alias("turned"))

    differs = F.col("b").isNull() | F.col("h").isNull() | ~(F.col("bt").eqNullSafe(F.col("ht")) & F.col("bv").eqNullSafe(F.col("hv")))
    found = both.where(differs).withColumn("owner", F.slice("path", 1, 2)).join(turned, ["template_id", "owner"], "left")
    whole = ~_key(0).isin(*ENTRY_SECTIONS)
    opaque = (_key(0) == "Resources") & (F.size("path") > 2) & ~_key(2).isin("Type", *ATTRIBUTES)
    unit = F.when(whole, F.slice("path", 1, 1)).when(F.col("turned"), F.col("owner")).when(opaque, F.slice("path", 1, 3)).otherwise(F.col("path"))
    units = found.select("template_id", unit.alias("path"), F.coalesce("turned", F.lit(False)).alias("type_changed")).distinct()
    units = units.join(both.select("template_id", "path", "b", "h"), ["template_id", "path"])
    units = settled(units.withColumn("change", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("modified")).drop("b", "h"))
    below = units.select("template_id", "path", F.explode(_above(F.col("path"), 0)).alias("up")).join(units.select("template_id", F.col("path").alias("up")), ["template_id", "up"], "left_semi")
    units = settled(units.join(below.select("template_id", "path").distinct(), ["template_id", "path"], "left_anti"))

    marks = _marked(both)
    names = ("expression", "dynamic_reference", "external")
    inside = marks.withColumn("path", F.explode(F.concat(_above(F.col("path"), 1), F.array("path")))).groupBy("template_id", "path").agg(*[F.bool_or(n).alias(n) for n in names])
    conditional = heads.where("gated").select("template_id", "owner", "gated")
    around = F.slice("path", 3, F.greatest(F.size("path") - 2, F.lit(0)))
    transforms = (limitations(base, head) if limits is None else limits).where("limitation = 'transform_not_expanded'").select("template_id", F.lit(True).alias("pre_transform"))
    out = units.join(inside, ["template_id", "path"], "left").withColumn("owner", F.slice("path", 1, 2)).join(conditional, ["template_id", "owner"], "left").join(transforms, "template_id", "left")
    entry = _key(0).isin(*ENTRY_SECTIONS)
    flags = {
        "expression_unevaluated": F.col("expression") | entry & F.exists(around, lambda k: (k == "Ref") | k.startswith("Fn::")),
        "conditional": F.col("gated") | entry & F.array_contains(around, "Fn::If"),
        "dynamic_reference_unresolved": F.col("dynamic_reference"),
        "external_value": F.col("external") | entry & F.exists(around, lambda k: k.isin(*EXTERNAL)),
        "pre_transform": F.col("pre_transform"),
    }
    qualifiers = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(flags[q], F.lit(False)), q) for q in QUALIFIERS])), ",")
    out = settled(out.select("template_id", _key(0).alias("section"), "path", "change", "type_changed", qualifiers.alias("qualifiers")))

    ends = out.where((F.col("section") == "Resources") & (F.size("path") == 2) & (F.col("change") != "modified"))
    kinds = heads.where("kind is not null").select("template_id", F.col("owner").alias("path"), F.coalesce("kind.bv", "kind.hv").alias("type"))
    ends = ends.join(kinds, ["template_id", "path"], "left").select("template_id", "path", "change", "type")
    alone = _one_sided(base, head, odd) if odd.where((F.size("path") == 2) & (_key(0) == "Resources")).take(1) else ends.select("template_id", "change", "type").where("false")
    across = F.when(F.col("change") == "added", "removed").otherwise("added").alias("change")
    other = ends.select("template_id", "change", "type").unionByName(alone).select("template_id", "type", across).distinct()
    hinted = ends.join(other, ["template_id", "type", "change"], "left_semi").select("template_id", "path").unionByName(ends.join(alone.where("type is null").select("template_id", across), ["template_id", "change"], "left_semi").select("template_id", "path"))
    hinted = hinted.select("template_id", "path", F.lit("possible_logical_id_rename").alias("hint")).distinct()
    counts = out.groupBy("template_id").agg(F.count("*").alias("n"))
    return out.join(hinted, ["template_id", "path"], "left").join(counts, "template_id").select(*out.columns, "hint", (F.col("n") > most).alias("failed"))


def summary(found: DataFrame, limits: DataFrame, templates: DataFrame) -> DataFrame:
    """A row a template: its changes in all and by kind, zeros told, and what limits the comparison, in order."""
    kinds = ("added", "removed", "modified")
    counts = found.groupBy("template_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds], F.bool_or(F.col("section").isin(*INDIRECT_SECTIONS)).alias("indirect"))
    held = limits.groupBy("template_id").agg(F.collect_set("limitation").alias("held"))
    out = templates.select("template_id").distinct().join(counts, "template_id", "left").join(held, "template_id", "left")
    every = F.concat(F.coalesce("held", F.array().cast("array<string>")), F.when(F.col("indirect"), F.array(F.lit("indirect_effects_not_evaluated"))).otherwise(F.array().cast("array<string>")))
    return out.select("template_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *(f"n_{k}" for k in kinds))], F.array_join(F.array_sort(every), ",").alias("limitations"))


def boundary(found: DataFrame, base: DataFrame, head: DataFrame, limits: DataFrame, odd: DataFrame, contracts: DataFrame, edits: DataFrame) -> DataFrame:
    """(template_id, code, path): where changes leave what a contract allows.

    found, limits and odd are changes(), limitations() and uncompared() of base and head; contracts: template_id, resource,
    type; edits: template_id, property, operations (an array of add, remove, replace).
    """
    target = F.col("resource")
    rows = found.join(contracts, "template_id")
    steps = F.size("path")
    inside = (F.col("section") == "Resources") & (steps >= 2) & (_key(1) == target)
    both = base.select("template_id", "path", F.lit("b").alias("side")).unionByName(head.select("template_id", "path", F.lit("h").alias("side")))
    held = both.where((F.size("path") == 4) & (_key(0) == "Resources") & (_key(2) == "Properties")).groupBy("template_id", F.col("path").alias("at")).agg(F.collect_set("side").alias("sides"))
    gated = both.where((F.size("path") > 4) & (F.try_element_at("path", F.lit(-1)) == "Fn::If")).select("template_id", F.slice("path", 1, 4).alias("at"), F.lit(True).alias("gated")).distinct()
    rows = rows.withColumns({"at": F.slice("path", 1, 4), "property": F.when((steps >= 4) & (_key(2) == "Properties"), _key(3))})
    rows = rows.join(edits, ["template_id", "property"], "left").join(held, ["template_id", "at"], "left").join(gated, ["template_id", "at"], "left")
    operation = F.when(F.size("sides") == 2, "replace").when(F.array_contains("sides", "h"), "add").otherwise("remove")
    unsupported = F.exists(F.split("qualifiers", ","), lambda q: q.isin("conditional", "dynamic_reference_unresolved", "external_value", "pre_transform")) | F.coalesce("gated", F.lit(False))
    whole = (F.col("section") == "Resources") & (steps == 2)
    code = (
        F.when(whole & F.col("type_changed"), "resource_type_changed").when(whole & (F.col("change") == "added"), "resource_added").when(whole & (F.col("change") == "removed"), "resource_removed")
        .when(whole & inside, "parent_replaced").when(whole | ~inside, "template_change_outside_scope").when((steps == 3) & (_key(2) == "Properties"), "parent_replaced")
        .when(F.col("operations").isNull(), "template_change_outside_scope").when(~F.array_contains("operations", operation), "operation_not_allowed").when(unsupported, "unsupported_construct")
    )
    at = F.when(code.isin("operation_not_allowed", "unsupported_construct"), F.col("at")).otherwise(F.col("path"))
    out = rows.select("template_id", code.alias("code"), F.array_join(at, "/").alias("path")).where("code is not null")
    out = out.unionByName(odd.join(contracts, "template_id").select("template_id", F.lit("comparison_incomplete").alias("code"), F.array_join("path", "/").alias("path")))
    out = out.unionByName(limits.where("limitation = 'transform_not_expanded'").join(contracts, "template_id").select("template_id", F.lit("unsupported_construct").alias("code"), F.lit("").alias("path")))
    there = base.where((F.size("path") == 3) & (_key(0) == "Resources") & (_key(2) == "Type")).select("template_id", _key(1).alias("resource"), F.col("sval").alias("type"))
    gone = contracts.join(there, ["template_id", "resource", "type"], "left_anti")
    return out.unionByName(gone.select("template_id", F.lit("target_resource_missing").alias("code"), F.concat(F.lit("Resources/"), target).alias("path"))).distinct()
