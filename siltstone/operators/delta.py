"""What became of findings between two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.matching import delta

# Reasons for which an entry cannot be told, in the order in which they are told; for which it is not confirmed.
REASONS = (
    "identity_undetermined",
    "duplicate_fingerprint",
    "source_not_comparable",
    "tool_version_mismatch",
    "template_not_reviewed",
    "non_deterministic_source",
    "possible_logical_id_rename",
    "report_integrity_failed",
    "template_report_mismatch",
)
UNDECLARED = "input_declaration_absent"
AGENT = "Agent Review"


def fingerprint(columns: list[str]) -> Column:
    """A digest of columns, nulls told apart from text."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]), 256)


def comparable(tools: DataFrame) -> DataFrame:
    """(source, reasons): why findings of a source can't be compared.

    tools: (side, source, available, version, enabled, failed) for base and head; a side without a row is not enabled.
    """
    pick = lambda name: [F.max(F.when(F.col("side") == s, F.col(name))).alias(f"{name}_{s}") for s in ("base", "head")]
    both = tools.groupBy("source").agg(*[c for n in ("available", "version", "enabled", "failed") for c in pick(n)])
    side = lambda name, default: (F.coalesce(f"{name}_base", F.lit(default)), F.coalesce(f"{name}_head", F.lit(default)))
    available, enabled, failed = side("available", False), side("enabled", False), side("failed", False)
    differs = available[0] & available[1] & ~F.col("version_base").eqNullSafe(F.col("version_head"))
    bad = ~(available[0] & available[1]) | ~(enabled[0] & enabled[1]) | failed[0] | failed[1] | differs
    return both.select("source", F.array_compact(F.array(F.when(bad, "source_not_comparable"), F.when(differs, "tool_version_mismatch"))).alias("reasons"))


def entries(base: DataFrame, head: DataFrame, tools: DataFrame, declared: Column | None = None, files: DataFrame | None = None, renamed: DataFrame | None = None, sound: bool = True, matching: bool = True) -> DataFrame:
    """Each finding of two reports once, as its pair or alone: observation, classification and reasons.

    Findings: template_id, resource, category, source, finding. Any reason makes an entry alone Ambiguous; else one that is
    not declared comparable is Unconfirmed; else it is New or Resolved; pairs are Unchanged. Nulls in the key are equal; a
    finding without a resource, or of category Other, is only matched by its fingerprint. files: (side, template_id) that
    each report reviewed, all if not given; renamed: (template_id, resource) that may have another name on the other side;
    sound: whether both reports agree with themselves; matching: whether they belong to their templates.
    """
    key = ["template_id", "resource", "category", "source"]
    known = lambda df: df.select(*key, "finding")
    rows = delta(known(base), known(head), key, "finding", F.col("resource").isNotNull() & (F.col("category") != "Other"))
    rows = rows.join(comparable(tools), "source", "left")
    none = F.lit(False)
    if files is not None:
        both = files.groupBy("template_id").agg((F.count_distinct("side") == 2).alias("_reviewed"))
        rows = rows.join(both, "template_id", "left")
        unseen = ~F.coalesce("_reviewed", none)
    else:
        unseen = none
    if renamed is not None:
        rows = rows.join(renamed.select("template_id", "resource", F.lit(True).alias("_renamed")).distinct(), ["template_id", "resource"], "left")
        named = F.coalesce("_renamed", none)
    else:
        named = none
    own = {
        "identity_undetermined": F.col("stage") == "undetermined",
        "duplicate_fingerprint": F.col("stage") == "duplicate",
        "source_not_comparable": F.col("reasons").isNull() | unseen,
        "template_not_reviewed": unseen,
        "non_deterministic_source": F.col("source") == AGENT,
        "possible_logical_id_rename": named,
        "report_integrity_failed": F.lit(not sound),
        "template_report_mismatch": F.lit(not matching),
    }
    of_tool = lambda r: F.coalesce(F.array_contains("reasons", r), none)
    why = F.array_compact(F.array(*[F.when(own.get(r, none) | of_tool(r), r) for r in REASONS]))  # each is asked for once, in order
    alone = ~F.col("stage").isin("identity", "fingerprint")
    observation = F.when(~alone, "matched").when(F.col("stage") == "only", F.concat("side", F.lit("_only"))).otherwise("unmatched")
    sure = F.lit(True) if declared is None else declared
    rows = rows.withColumn("why", why).withColumn("observation", observation).where(alone | (F.col("side") == "head"))
    found = F.when(~alone, "Unchanged").when(F.size("why") > 0, "Ambiguous").when(~sure, "Unconfirmed").when(F.col("side") == "head", "New").otherwise("Resolved")
    reasons = F.when(~alone, F.array().cast("array<string>")).when((F.size("why") == 0) & ~sure, F.array(F.lit(UNDECLARED))).otherwise(F.col("why"))
    return rows.select(*key, "finding", "observation", found.alias("classification"), reasons.alias("reasons"))


def counters(found: DataFrame) -> DataFrame:
    """(observation, classification, n) of entries, zeros told."""
    told = found.groupBy("observation", "classification").agg(F.count("*").alias("n"))
    spark = found.sparkSession
    every = spark.createDataFrame([("matched", "Unchanged")] + [(o, c) for o in ("base_only", "head_only", "unmatched") for c in ("Ambiguous", "Unconfirmed", "New", "Resolved")], "observation string, classification string")
    return every.join(told, ["observation", "classification"], "left").select("observation", "classification", F.coalesce("n", F.lit(0)).alias("n"))
