"""Three-valued verdicts, division, prefixes, wildcards and predicates over properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_valued(df: DataFrame, item: str, group: str, all_required: Column, hit: Column, blocked: Column) -> DataFrame:
    """MATCH, UNRESOLVABLE or NO_MATCH for each item from its candidates' groups.

    A group decides if a candidate hits, or all do where all are required; a group that does not decide blocks if a
    value is unknown and it could have decided.
    """
    groups = df.groupBy(item, group).agg(F.bool_and(all_required).alias("_all"), F.count_if(hit).alias("_hits"), F.count("*").alias("_n"), F.bool_or(blocked).alias("_blocked"))
    decides = F.when(F.col("_all"), (F.col("_hits") == F.col("_n")) & (F.col("_hits") > 0)).otherwise(F.col("_hits") > 0)
    blocks = F.when(F.col("_all"), (F.col("_hits") > 0) & (F.col("_hits") < F.col("_n")) & F.col("_blocked")).otherwise((F.col("_hits") == 0) & F.col("_blocked"))
    verdict = F.when(F.bool_or("_decides"), "MATCH").when(F.bool_or("_blocks"), "UNRESOLVABLE").otherwise("NO_MATCH")
    return groups.withColumns({"_decides": decides, "_blocks": blocks}).groupBy(item).agg(verdict.alias("verdict"))


def composed(status: Column) -> Column:
    """Aggregate: FAILED if any is, PASS if all are, else NOT_PROVEN."""
    return F.when(F.bool_or(F.coalesce(status == "FAILED", F.lit(False))), "FAILED").when(F.bool_and(F.coalesce(status == "PASS", F.lit(False))), "PASS").otherwise("NOT_PROVEN")


def having_all(df: DataFrame, keys: list[str], value: str, wanted: list) -> DataFrame:
    """The keys that have every wanted value."""
    return df.where(F.col(value).isin(wanted)).groupBy(*keys).agg(F.count_distinct(value).alias("_n")).where(F.col("_n") == len(set(wanted))).drop("_n")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """df joined with the row of the longest prefix of its column (left join).

    Each value meets its own prefixes of the lengths that occur, by equality, not each value each prefix.
    """
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]  # a rule table's few lengths
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    cuts = F.filter(F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in sorted(lengths)]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    met = values.withColumn(prefix, F.explode(cuts)).join(prefixes, prefix)
    rest = [c for c in met.columns if c != column]
    best = met.groupBy(column).agg(F.max_by(F.struct(*rest), F.length(prefix)).alias("_best")).select(column, "_best.*")
    return df.join(best, column, "left")


def wildcard(pattern: Column, escape_end: bool = True) -> Column:
    """A pattern of * and ? as a regular expression over the whole lower-cased value."""
    escaped = F.regexp_replace(F.lower(pattern), r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^(?s)"), F.regexp_replace(F.regexp_replace(escaped, r"\?", "."), r"\*", ".*"), F.lit(r"\z" if escape_end else "$"))


def grants(values: DataFrame, value: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(value, pattern) pairs that match without regard to case.

    A distinct value meets the patterns whose text before the first wildcard it begins with, by equality of such beginnings.
    """
    shaped = patterns.select(pattern).distinct().withColumns({"_re": wildcard(F.col(pattern)), "_begin": F.lower(F.regexp_extract(pattern, r"^[^*?]*", 0))})
    lengths = sorted(r[0] for r in shaped.select(F.length("_begin")).distinct().collect())  # as many as a pattern has characters, at most
    begins = F.filter(F.array(*[F.when(F.length(value) >= n, F.substring(F.lower(value), 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    met = values.select(value).distinct().withColumn("_begin", F.explode(begins)).join(shaped, "_begin")
    return met.where(F.rlike(F.lower(value), F.col("_re"))).select(value, pattern)


#: What a property must be, by name: each gives true where the value (text, null if absent) fails.
FAILS = {
    "exists": lambda v, _: v.isNull(),
    "true": lambda v, _: F.coalesce(F.lower(v) != "true", F.lit(True)),
    "not_true_if_present": lambda v, _: v.isNotNull() & (F.lower(v) != "false"),
    "equals": lambda v, w: F.coalesce(v != w, F.lit(True)),
    "in": lambda v, w: F.coalesce(~v.isin(*w.split("|")), F.lit(True)),
    "at_least": lambda v, w: F.coalesce(v.try_cast("double") < float(w), F.lit(True)),
    "at_least_if_present": lambda v, w: v.isNotNull() & F.coalesce(v.try_cast("double") < float(w), F.lit(True)),
}
