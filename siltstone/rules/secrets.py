"""Secrets in plain text: in environments, user data and parameter defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import PLACEHOLDER, entropy, secret_shapes
from siltstone.operators.merge import numbered
from siltstone.rules.network import row
from siltstone.sources.templates import Relations

#: Bits a character from which a value under a telling name is no word.
LEAST_ENTROPY = 3.5


def findings(relations: Relations) -> DataFrame:
    """Values that have the shape of a secret, or are of high entropy under a telling name; placeholders left out."""
    environment = relations.props.where("prop rlike '^Properties/Environment/Variables/[^/]+$' or prop rlike '^Properties/UserData(/|$)'").select("template_id", "logical_id", F.col("place").alias("name"), "sval", F.lit("plaintext_secret").alias("what"))
    defaults = relations.nodes.where("get(path, 0) = 'Parameters' and size(path) = 3 and get(path, 2) = 'Default'").select("template_id", F.get("path", F.lit(1)).alias("logical_id"), F.get("path", F.lit(1)).alias("name"), "sval", F.lit("parameter_default_secret").alias("what"))
    all_ = numbered(environment.unionByName(defaults).where("sval is not null"), ["template_id"], ["logical_id", "name", "sval"], "n")
    all_ = all_.withColumns({"key": F.concat_ws("/", "template_id", F.col("n").cast("string")), "shape": secret_shapes(F.col("sval"))})
    telling = all_.where(F.lower("name").rlike("password|passwd|secret|token|api_?key") & (F.length("sval") >= 12) & ~F.contains("sval", F.lit(" ")))
    bits = entropy(telling, "key", "sval").where(F.col("entropy") >= LEAST_ENTROPY).select("key", F.lit(True).alias("odd"))
    hit = all_.join(bits, "key", "left").where(((F.col("shape") != "") | F.coalesce("odd", F.lit(False))) & ~F.col("sval").rlike(PLACEHOLDER))
    text = F.concat("name", F.lit(": holds what looks like a secret ("), F.when(F.col("shape") != "", F.col("shape")).otherwise("high entropy"), F.lit(")"))
    return hit.select(*row("plaintext_secret", "HIGH", "DataProtection", "Security", "Secret Review", text)).withColumn("rule_id", F.lit("plaintext_secret"))
