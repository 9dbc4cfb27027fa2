"""Matching of two sets of rows: one to one, by identity and fingerprint, field by field, with multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """Full outer match, the k-th left row of a key with the k-th right one; null keys match as equal.

    Adds matched, only_left and only_right. Other column names must differ.
    """
    sides = []
    for df, order, mark in ((left, left_order, "_l"), (right, right_order, "_r")):
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        sides.append(df.withColumn("_n", n).withColumn(mark, F.lit(True)).withColumnsRenamed({k: f"{k}{mark}" for k in keys}).withColumnRenamed("_n", f"_n{mark}"))
    on = F.col("_n_l") == F.col("_n_r")
    for k in keys:
        on = on & F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_r"))
    both = sides[0].join(sides[1], on, "full")
    both = both.withColumns({k: F.coalesce(f"{k}_l", f"{k}_r") for k in keys})
    both = both.withColumns({"matched": F.col("_l").isNotNull() & F.col("_r").isNotNull(), "only_left": F.col("_r").isNull(), "only_right": F.col("_l").isNull()})
    return both.drop("_l", "_r", "_n_l", "_n_r", *[f"{k}{m}" for k in keys for m in ("_l", "_r")])


def delta(base: DataFrame, head: DataFrame, key: list[str], fingerprint: str, eligible: Column) -> DataFrame:
    """(side, stage, key, fingerprint) of each row of two snapshots.

    Rows have key, fingerprint and whatever eligible reads. Stage "identity": an eligible key with one row on each side;
    "fingerprint": equal fingerprints of a key that occur once on each side; the rest is "undetermined" where both sides
    have rest of a key, "duplicate" where the fingerprint repeats on its side, else "only". Nulls in keys are equal.
    """
    rows = base.withColumn("side", F.lit("base")).unionByName(head.withColumn("side", F.lit("head")))
    by_key, by_print = Window.partitionBy(*key), Window.partitionBy(*key, fingerprint)
    count = lambda side, w: F.sum((F.col("side") == side).cast("int")).over(w)
    rows = rows.withColumns({"_b": count("base", by_key), "_h": count("head", by_key), "_pb": count("base", by_print), "_ph": count("head", by_print)})
    identity = F.coalesce(eligible, F.lit(False)) & (F.col("_b") == 1) & (F.col("_h") == 1)
    rows = rows.withColumn("_stage", F.when(identity, "identity").when((F.col("_pb") == 1) & (F.col("_ph") == 1), "fingerprint"))
    left = lambda side: F.max(((F.col("side") == side) & F.col("_stage").isNull()).cast("int")).over(by_key)
    rows = rows.withColumns({"_lb": left("base"), "_lh": left("head")})
    own = F.when(F.col("side") == "base", F.col("_pb")).otherwise(F.col("_ph"))
    rest = F.when((F.col("_lb") == 1) & (F.col("_lh") == 1), "undetermined").when(own > 1, "duplicate").otherwise("only")
    return rows.withColumn("stage", F.coalesce("_stage", rest)).drop("_b", "_h", "_pb", "_ph", "_lb", "_lh", "_stage")


def changed_fields(fields: list[tuple[str, Column, Column]]) -> Column:
    """The names of the fields whose two values differ, in the given order, nulls being equal."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), name) for name, a, b in fields]))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left without those of right, with multiplicity."""
    return left.exceptAll(right)


def metrics(matched: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """Counts and one-decimal percentages of a one_to_one() result; "N/A" where there is nothing to divide by."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out = matched.groupBy(*keys).agg(n(F.col("matched")).alias("tp"), n(F.col("only_left")).alias("fn"), n(F.col("only_right")).alias("fp"), n(F.col("matched") & same).alias("same"))
    return out.select(*keys, "tp", "fn", "fp", percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), percent(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), percent(F.col("same"), F.col("tp")).alias("accuracy"))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal, halves to even, or "N/A"."""
    return F.when(whole == 0, "N/A").otherwise(F.format_string("%.1f", F.bround(part / whole * F.lit(100.0), 1)))


# Exit codes of a run in which an expectation was missed, and of one in which a case could not be measured.
MISSED, UNMEASURED = 9, 10
_KEY = ["case_id", "resource", "type", "category"]


def of_source(findings: DataFrame, source: str) -> DataFrame:
    """The findings that a source had a part in; findings have an array of sources."""
    return findings.where(F.array_contains("sources", source))


def verdicts(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """(by, expected, matched, deterministic, detected, status) of pooled cases, by case_id, by category, or both.

    expected: case_id, resource, type, category, deterministic; actual: case_id, resource, type, category. Cases stay apart.
    Those that must be detected are matched again alone, so that no other expectation takes their finding: PASS if all are
    detected, FAIL if one is missed, INFO where there are none.
    """
    def matched(rows: DataFrame, name: str) -> DataFrame:
        both = one_to_one(rows.withColumn("_e", F.monotonically_increasing_id()), actual.select(*_KEY).withColumn("_a", F.monotonically_increasing_id()), _KEY, ["_e"], ["_a"])
        return both.groupBy(*by).agg(F.count("_e").alias(name), F.count_if("matched").alias(f"{name}_met"))

    every, sure = matched(expected.select(*_KEY), "expected"), matched(expected.where("deterministic").select(*_KEY), "sure")
    on = [every[k].eqNullSafe(sure[k]) for k in by]
    both = every.join(sure, on, "left").select(*[every[k] for k in by], "expected", F.col("expected_met").alias("matched"), F.coalesce("sure", F.lit(0)).alias("deterministic"), F.coalesce("sure_met", F.lit(0)).alias("detected"))
    return both.withColumn("status", F.when(F.col("deterministic") == 0, "INFO").when(F.col("deterministic") == F.col("detected"), "PASS").otherwise("FAIL"))


def exit_code(found: DataFrame, errors: int = 0) -> int:
    """MISSED if a verdict is FAIL, else UNMEASURED if a case could not be measured, else 0."""
    return MISSED if found.where("status = 'FAIL'").take(1) else UNMEASURED if errors else 0


def remedied(pairs: DataFrame) -> DataFrame:
    """pairs (wanted, suggested) with remedied: whether the suggestion holds what is wanted, without regard to case; null wanted counts for nothing."""
    return pairs.withColumn("remedied", F.when(F.col("wanted").isNotNull(), F.coalesce(F.contains(F.lower(F.trim("suggested")), F.lower(F.trim("wanted"))), F.lit(False))))
