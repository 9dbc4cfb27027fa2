"""Columns over text: secrets, redaction, tokens, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

# Shapes of secrets, and values that are no secrets.
SECRET_SHAPES = {
    "access_key_id": r"(^|[^A-Za-z0-9])AKIA[A-Z0-9]{16}($|[^A-Za-z0-9])",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "provider_token": r"(ghp|gho|github_pat|xox[bap]|glpat)[_-][A-Za-z0-9_-]{16,}",
    "assigned_secret": r"(password|passwd|secret|token|api_key|apikey)[\"']? ?[=:] ?[\"'][^\"']{12,}[\"']",
}
PLACEHOLDER = r"(EXAMPLE|example|changeme|CHANGEME|your-|YOUR-|\{\{|\$\{)"


def secret_shapes(text: Column) -> Column:
    """Names of the shapes that the text has, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in SECRET_SHAPES.items()])), ",")


def redacted(text: Column) -> Column:
    """The text with access keys, assigned secrets and addresses blanked."""
    out = F.regexp_replace(text, r"AKIA[A-Z0-9]{16}", "[REDACTED]")
    out = F.regexp_replace(out, r"(token|password|secret) ?= ?\"[^\"]*\"", "[REDACTED]")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[REDACTED]")


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """Bits a character of each row's value."""
    counts = df.select(key, F.length(value).alias("_n"), F.explode(F.split(value, "")).alias("_c")).where("_c != ''").groupBy(key, "_n", "_c").agg(F.count("*").alias("_k"))
    p = F.col("_k") / F.col("_n")
    return counts.groupBy(key).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


def token_table(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in binary order as id-000001 and so on, wider if there are more.

    Numbers come from counts of range partitions, so that no task orders all values.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    values = values.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    values = settled(values)
    total = values.count()
    sizes = values.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_k") + 1
    return values.join(before, "_p").select(column, F.concat(F.lit("id-"), F.lpad(number.cast("string"), max(6, len(str(total))), "0")).alias("token"))


def pseudonym(value: Column, prefix: str = "u:", size: int = 12) -> Column:
    """A prefix and the first hexadecimal digits of a value's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value.cast("string"), 256), 1, size))


def links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def sub_tokens(text: Column) -> Column:
    """Names in ${...} before the first dot; ${!...} is literal."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\$\{([A-Za-z0-9:._-]+)\}"), F.lit(1)), lambda x: F.substring_index(x, ".", 1))
