"""Integrity of captured evidence, reviews and gates: closed checks with one verdict each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.matching import changed_fields


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(store, name, fault) of entries (store, name, sha256, size) against files (store, name, content).

    fault: "missing", "unlisted", "hash" or "length"; sound entries give no row.
    """
    have = files.select("store", "name", F.sha2("content", 256).alias("real"), F.octet_length("content").alias("bytes"))
    both = manifest.withColumn("listed", F.lit(True)).join(have.withColumn("found", F.lit(True)), ["store", "name"], "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("bytes") != F.col("size"), "length").when(F.col("real") != F.col("sha256"), "hash")
    return both.select("store", "name", fault.alias("fault")).where("fault is not null")


def revision_chain(revisions: DataFrame) -> DataFrame:
    """(store, revision, status) of revisions (store, revision, id, previous_id, manifest_sha256, previous_manifest_sha256).

    VALID if its number follows, its links name the one before, and that one is valid too; else INVALID.
    """
    w = Window.partitionBy("store").orderBy("revision")
    first = F.row_number().over(w) == 1
    linked = F.when(first, (F.col("revision") == 1) & F.col("previous_id").isNull()).otherwise((F.col("revision") - F.lag("revision").over(w) == 1) & F.col("previous_id").eqNullSafe(F.lag("id").over(w)) & F.col("previous_manifest_sha256").eqNullSafe(F.lag("manifest_sha256").over(w)))
    rows = revisions.withColumn("_linked", F.coalesce(linked, F.lit(False)))
    good = F.min(F.col("_linked").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return rows.select("store", "revision", F.when(good, "VALID").otherwise("INVALID").alias("status"))


def envelope_status() -> Column:
    """COMPLETE only for a raw, clean, errorless, complete answer of status 200."""
    ok = (F.col("source_type") == "RAW") & (F.col("security_scan_status") == "CLEAN") & (F.size("capture_errors") == 0) & (F.col("http_status") == 200) & F.col("pagination_complete")
    return F.when(F.coalesce(ok, F.lit(False)), "COMPLETE").otherwise("INCOMPLETE")


def reviewer_states(reviews: DataFrame) -> DataFrame:
    """(user_id, state) of reviews (id, state, user_id, submitted_at, commit_id): the latest decision of each reviewer.

    Copies of an id stop all ("duplicate" if equal, else "conflict"). A dismissal after the decision, two decisions of one
    moment that differ, or ids that run against time make it "none".
    """
    same = reviews.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in reviews.columns]), 256)).alias("d")).where("n > 1")
    stopped = same.agg(F.when(F.max("d") > 1, "conflict").when(F.count("*") > 0, "duplicate").alias("stop"))
    rows = reviews.where(F.col("user_id").isNotNull() & F.col("submitted_at").isNotNull())
    at = F.struct("submitted_at", "id")
    w = Window.partitionBy("user_id").orderBy("submitted_at", "id")
    rows = rows.withColumns({"_odd": F.coalesce(F.lead("id").over(w) < F.col("id"), F.lit(False)), "_decides": F.col("state").isin("APPROVED", "CHANGES_REQUESTED")})
    last = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("_decides"), at)).alias("last"),
        F.max_by("state", F.when(F.col("_decides"), at)).alias("state"),
        F.max(F.when(F.col("state") == "DISMISSED", at)).alias("dismissed"),
        F.bool_or("_odd").alias("odd"),
    )
    ties = rows.where("_decides").groupBy("user_id", "submitted_at").agg(F.count_distinct("state").alias("k")).where("k > 1").select("user_id", F.lit(True).alias("tied")).distinct()
    out = last.join(ties, "user_id", "left").crossJoin(F.broadcast(stopped))  # one row
    none = F.col("last").isNull() | F.col("odd") | F.coalesce("tied", F.lit(False)) | F.coalesce(F.col("dismissed") > F.col("last"), F.lit(False))
    return out.select("user_id", F.coalesce("stop", F.when(none, "none"), "state").alias("state"))


def chain_status(links: DataFrame, reasons: DataFrame, expected: list[str]) -> DataFrame:
    """(chain, status): the worst of the links' reasons; links that are missing, and unknown codes, count as incomplete.

    links: (chain, link, code) with a null code for a sound link; reasons: (code, status).
    """
    ranks = {"COMPLETE": 0, "NOT_PROVEN": 1, "INCOMPLETE": 2, "BROKEN": 3}
    wanted = links.select("chain").distinct().withColumn("link", F.explode(F.array(*map(F.lit, expected))))
    known = wanted.join(links.withColumn("seen", F.lit(True)), ["chain", "link"], "left").join(reasons, "code", "left")
    status = F.when(F.col("seen").isNull(), "INCOMPLETE").when(F.col("code").isNull(), "COMPLETE").otherwise(F.coalesce("status", F.lit("INCOMPLETE")))
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    worst = known.select("chain", rank[status].alias("r")).groupBy("chain").agg(F.max("r").alias("r"))
    return worst.select("chain", F.element_at(F.array(*map(F.lit, ranks)), F.col("r") + 1).alias("status"))


def tree_compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, change) of two file trees (path, mode, oid): added, removed, or the fields that differ."""
    a, b = (x.select("path", F.col("mode").alias(f"m{i}"), F.col("oid").alias(f"o{i}"), F.lit(True).alias(f"h{i}")) for i, x in ((0, base), (1, head)))
    both = a.join(b, "path", "full")
    fields = F.array_join(changed_fields([("mode", F.col("m0"), F.col("m1")), ("content", F.col("o0"), F.col("o1"))]), ",")
    return both.select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise(fields).alias("change")).where("change != ''")


def decision(codes: DataFrame, priorities: DataFrame) -> DataFrame:
    """(task, decision): ERROR over BLOCKED over UNVERIFIED over VERIFIED by a task's codes; priorities: (code, decision)."""
    order = F.array(*map(F.lit, ("ERROR", "BLOCKED", "UNVERIFIED", "VERIFIED")))
    rank = F.array_position(order, F.coalesce("decision", F.lit("ERROR")))
    best = codes.join(priorities, "code", "left").groupBy("task").agg(F.min(rank).alias("r"))
    return best.select("task", F.element_at(order, F.col("r").cast("int")).alias("decision"))


def blob_id(content: Column) -> Column:
    """The git id of a file's bytes."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(b"\0"), content))
