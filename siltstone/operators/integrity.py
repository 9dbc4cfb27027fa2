"""Integrity of evidence stores: the chain of revisions with its quarantines, and the checks of the evidence that is named.

A revision is valid by its own state and by that of the one before, and may put that one into quarantine; so states follow
from a fold in order of revisions. What a revision does to a state is one of three maps, which compose: it sets the state, keeps
it, or turns it round. A run of them is a value, if any of them sets, and a parity; runs of blocks are put together without
their rows, so that a store of any length is split over tasks and only its blocks meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

#: Revision numbers of a block.
BLOCK = 1024
#: Blocks whose rows are sent to every executor; more are joined by shuffle.
SENT = 100_000

# Checks in order, and which of them are told of whole stores and of evidence.
CHECKS = ("V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "W1", "W2", "W3", "W4", "W5")
OF_STORES = ("V1", "V2", "V3", "V4", "W1", "W3", "W5")
OF_EVIDENCE = ("V5", "V6", "V7", "W2", "W4")
STATUSES = ("NOT_APPLICABLE", "PASS", "NOT_PROVEN", "FAILED")
SOURCE_TYPES = ("API", "LOCAL", "HUMAN")


def _met(rows: DataFrame, blocks: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(blocks) if few else blocks, ["store", "block"], "left")


def chained(revisions: DataFrame) -> DataFrame:
    """(store, revision, status, chain) of revisions (store, revision, revision_id, sealed, clean, state_sha256, manifest_sha256,
    previous_id, previous_manifest_sha256, quarantines, quarantine_state, strays).

    clean: nothing is wrong with the revision itself; quarantines: it has a record that names the revision before it, of the state
    quarantine_state; strays: it has records that name others. A revision is VALID if it is clean and sealed, its links name
    the one before and that one is VALID; INCOMPLETE if it is not sealed; else INVALID. One that is not valid is QUARANTINED
    if the next one's record and links are of its present state, which frees that one of the link. Records of valid revisions,
    of other states and strays make their own revision INVALID. chain tells what is wrong with the place in the chain, joined
    by commas. The first revision names none before. Null flags are false; (store, revision) is unique; an empty table has no rows.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = revisions.select("store", "revision", "revision_id", *[flag(c).alias(c) for c in ("sealed", "clean", "quarantines", "strays")], "state_sha256", "manifest_sha256", "previous_id", "previous_manifest_sha256", "quarantine_state", F.floor(F.col("revision") / BLOCK).cast("bigint").alias("block"))
    rows = settled(rows)
    inside = Window.partitionBy("store", "block").orderBy("revision")
    over = Window.partitionBy("store").orderBy("block")
    known = F.struct("revision", "revision_id", "state_sha256", "manifest_sha256")

    ends = rows.groupBy("store", "block").agg(F.max_by(known, "revision").alias("end"))  # a row a block
    ends = settled(ends.withColumn("ended", F.lag("end").over(over)).drop("end"))
    few = ends.count() <= SENT
    rows = _met(rows, ends, few).withColumn("before", F.coalesce(F.lag(known).over(inside), "ended")).drop("ended")
    first = F.col("before").isNull()
    named = F.col("previous_id").eqNullSafe(F.col("before.revision_id"))
    linked = named & (F.col("previous_manifest_sha256") == F.col("before.manifest_sha256"))
    bound = flag("quarantines") & named & (F.col("quarantine_state") == F.col("before.state_sha256")) & (F.col("previous_manifest_sha256") == F.col("before.state_sha256"))
    rows = rows.withColumns({"linked": F.coalesce(linked, F.lit(False)), "bound": F.coalesce(bound & ~first, F.lit(False)), "first": first})
    good = F.col("sealed") & F.col("clean") & ~F.col("strays")
    alone = good & F.col("previous_id").isNull() & F.col("previous_manifest_sha256").isNull() & ~F.col("quarantines")
    sets = F.when(F.col("first"), alone.cast("int")).when(~good | F.col("quarantines") & ~F.col("bound") | ~F.col("quarantines") & ~F.col("linked"), 0)  # null: keeps or turns
    turns = F.when(sets.isNull() & F.col("quarantines"), 1).otherwise(0)
    rows = settled(rows.withColumns({"sets": sets, "turns": turns}))

    # state after a row: what was set last, turned as often as rows since then turn it
    since = lambda value, window: F.sum(value).over(window)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"total": since("turns", running), "at": F.last(F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").alias("sets"), since("turns", running).alias("total"))), ignorenulls=True).over(running)})
    last = F.max_by(F.struct("total", "at"), "revision").alias("last")
    maps = rows.groupBy("store", "block").agg(last).select("store", "block", F.col("last.at.sets").alias("sets"), (F.col("last.total") - F.coalesce("last.at.total", F.lit(0))).alias("turns"))
    runs = over.rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("total", F.sum("turns").over(runs))
    set_at = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", (F.col("total") - F.col("turns")).alias("total"))), ignorenulls=True).over(runs)
    maps = maps.withColumn("state", F.pmod(set_at["sets"] + F.col("total") - set_at["total"], F.lit(2)))
    # where a block sets, its turns are counted from there on: those before it are not in set_at, so total - set_at.total is right
    entering = settled(maps.select("store", "block", F.lag("state").over(over).alias("entering")))
    state = F.when(F.col("at").isNotNull(), F.pmod(F.col("at.sets") + F.col("total") - F.col("at.total"), F.lit(2))).otherwise(F.pmod(F.col("entering") + F.col("total"), F.lit(2)))
    rows = _met(rows, entering, few).withColumn("valid", state == 1)
    rows = rows.withColumn("was", F.coalesce(F.lag("valid").over(inside), F.col("entering") == 1))
    frees = F.col("bound") & ~F.coalesce("was", F.lit(False)) & ~F.col("first")
    why = F.array_compact(
        F.array(
            F.when(F.col("first") & (F.col("previous_id").isNotNull() | F.col("previous_manifest_sha256").isNotNull()), "first_revision_names_previous"),
            F.when(~F.col("first") & ~F.coalesce(F.col("previous_id") == F.col("before.revision_id"), F.lit(False)) & ~frees, "previous_revision_mismatch"),
            F.when(~F.col("first") & ~F.coalesce(F.col("previous_manifest_sha256") == F.col("before.manifest_sha256"), F.lit(False)) & ~frees, "previous_manifest_sha256_mismatch"),
            F.when(~F.col("first") & ~F.coalesce("was", F.lit(False)) & ~frees, "previous_revision_not_valid"),
            F.when(F.col("strays") | F.col("first") & F.col("quarantines"), "quarantine_not_of_previous"),
            F.when(~F.col("first") & F.col("quarantines") & F.col("was"), "quarantine_of_valid_revision"),
            F.when(~F.col("first") & F.col("quarantines") & ~F.coalesce("was", F.lit(False)) & ~F.col("bound"), "quarantine_state_mismatch"),
        )
    )
    rows = settled(rows.select("store", "revision", "sealed", "valid", frees.alias("frees"), F.col("before.revision").alias("freed"), F.array_join(why, ",").alias("chain")))
    freed = rows.where("frees").select("store", F.col("freed").alias("revision"), F.lit(True).alias("quarantined"))
    status = F.when(F.col("valid"), "VALID").when(F.col("quarantined"), "QUARANTINED").when(~F.col("sealed"), "INCOMPLETE").otherwise("INVALID")
    return rows.join(freed, ["store", "revision"], "left").select("store", "revision", status.alias("status"), "chain")


def validated(requests: DataFrame, statuses: DataFrame, findings: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(request_id, check_id, status, reasons) for every request and each of the CHECKS, and a last row OVERALL.

    requests: request_id, store, evidence_id, source_type, subject_commit, require_complete, a row an id that is named, null where
    none is; statuses: store, revision, status; findings: store, revision (null: the store's own), check_id, code; envelopes:
    store, revision, evidence_id, source_type, capture_id, page_index, has_next, pagination_complete, http_status, body (json,
    text, broken, absent), body_recorded, completeness, subject_commit, scanned (a clean scan is told), storable (the scan of
    what is stored is clean). Findings of revisions in quarantine don't count; evidence there is unusable. Evidence is checked only
    where the store has no findings and its revisions are valid or in quarantine. FAILED comes before NOT_PROVEN before PASS.
    """
    asked = settled(requests)
    each = asked.groupBy("request_id").agg(*[F.first(c).alias(c) for c in ("store", "source_type", "subject_commit", "require_complete")], F.count("evidence_id").alias("n"), F.count_distinct("evidence_id").alias("distinct"))
    counted = findings.join(statuses.where("status = 'QUARANTINED'").select("store", "revision"), ["store", "revision"], "left_anti").select("store", "check_id", "code").distinct()
    found = settled(counted)
    unsound = statuses.where("status not in ('VALID', 'QUARANTINED')").select("store").unionByName(found.select("store")).distinct().withColumn("unsound", F.lit(True))
    each = settled(each.join(unsound, "store", "left").withColumn("sound", F.col("unsound").isNull()).drop("unsound"))
    named = asked.select("request_id", "store", "evidence_id").where("evidence_id is not null").distinct()
    own = envelopes.withColumnRenamed("source_type", "kind").withColumnRenamed("subject_commit", "commit")
    placed = named.join(own.drop("page_index", "has_next").join(statuses.select("store", "revision", "status"), ["store", "revision"]), ["store", "evidence_id"], "left")
    placed = settled(placed.join(each.select("request_id", "source_type", "subject_commit", "require_complete", "sound"), "request_id"))
    located = placed.where("status is not null and status != 'QUARANTINED'")

    def told(df: DataFrame, check: str, status: str, reason: Column | str) -> DataFrame:
        return df.select("request_id", F.lit(check).alias("check_id"), F.lit(STATUSES.index(status)).alias("rank"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    at_store = each.select("request_id", "store").join(found, "store")
    parts = [at_store.where(F.col("check_id").isin(*OF_STORES, "V8")).select("request_id", "check_id", F.lit(3).alias("rank"), F.col("code").alias("reason"))]
    parts += [told(each.where("n = 0"), "W1", "NOT_PROVEN", "no_evidence_named"), told(each.where("n > distinct"), "W1", "NOT_PROVEN", "evidence_named_twice"), told(placed.where("status is null"), "W1", "NOT_PROVEN", "named_evidence_missing")]
    parts.append(told(placed.where("status = 'QUARANTINED'"), "V8", "FAILED", "quarantined_evidence_named"))
    parts += [told(each.where("not sound"), c, "NOT_PROVEN", "store_integrity_not_verified") for c in OF_EVIDENCE]
    good = located.where("sound")
    usable = settled(good.select("request_id").distinct())
    parts += [told(each.where("sound").join(usable, "request_id", "left_anti"), c, "NOT_PROVEN", "no_usable_evidence") for c in OF_EVIDENCE]

    api = good.where("kind = 'API'")
    parts.append(told(api.where("not coalesce(pagination_complete, false)"), "V5", "NOT_PROVEN", "pagination_incomplete"))
    pages = own.join(statuses.where("status = 'VALID'").select("store", "revision"), ["store", "revision"]).select("store", "capture_id", "evidence_id", "page_index", "has_next")
    captures = pages.groupBy("store", "capture_id").agg(F.count("*").alias("pages"), F.count_distinct("page_index").alias("places"), F.min("page_index").alias("low"), F.max("page_index").alias("high"), F.max_by("has_next", "page_index").alias("more"))
    held = api.groupBy("request_id", "store", "capture_id").agg(F.count_distinct("evidence_id").alias("held")).join(captures, ["store", "capture_id"])
    parts += [told(held.where("held < pages"), "V5", "NOT_PROVEN", "capture_pages_not_all_named"), told(held.where("places < pages or low <> 1 or high <> pages"), "V5", "NOT_PROVEN", "capture_page_missing"), told(held.where("more"), "V5", "NOT_PROVEN", "last_page_has_next")]

    answered = api.where("http_status = 200")
    parts += [told(api.where("not coalesce(http_status = 200, false)"), "V6", "NOT_PROVEN", "http_status_not_200"), told(answered.where("body = 'absent'"), "V6", "NOT_PROVEN", "raw_unavailable")]
    parts += [told(answered.where("body = 'broken' and not body_recorded"), "V6", "FAILED", "body_not_json_but_not_recorded"), told(answered.where("body = 'broken' and body_recorded"), "V6", "NOT_PROVEN", "body_not_json")]
    known = F.col("source_type").isin(*SOURCE_TYPES)
    parts.append(told(good.where(~known), "V7", "NOT_PROVEN", "requirement_unknown_source_type"))
    parts.append(told(good.where(known & (F.col("kind") != F.col("source_type"))), "V7", "NOT_PROVEN", F.concat(F.lit("source_type_not_"), F.lower("source_type"))))
    parts.append(told(good.where(known & F.col("require_complete") & (F.col("completeness") != "COMPLETE")), "V7", "NOT_PROVEN", "evidence_incomplete"))
    parts.append(told(good.where("subject_commit is null"), "W2", "NOT_APPLICABLE", "no_subject_commit_required"))
    wrong = settled(good.where("subject_commit is not null and commit <> subject_commit").select("request_id").distinct())
    parts += [told(wrong, "W2", "FAILED", "subject_commit_mismatch"), told(good.where("subject_commit is not null and commit is null").join(wrong, "request_id", "left_anti"), "W2", "NOT_PROVEN", "subject_commit_not_recorded")]
    stored = good.where("body != 'absent'")
    parts += [told(stored.where("not scanned"), "W4", "FAILED", "raw_stored_without_clean_scan"), told(stored.where("not storable"), "W4", "FAILED", "stored_raw_not_storable")]

    # a row a request holds what is told of it, so that its checks need not be joined or kept before their verdict is known
    reasons = reduce(DataFrame.unionByName, parts).repartition("request_id").groupBy("request_id", "check_id").agg(F.max("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    held = reasons.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("check_id", F.struct("rank", "reasons").alias("told")))).alias("told"), F.max("rank").alias("worst"))
    name = lambda rank: F.element_at(F.array(*map(F.lit, STATUSES)), rank + 1)
    every = each.select("request_id").join(held, "request_id", "left")
    every = every.select("request_id", "told", "worst", F.explode(F.array(*map(F.lit, (*CHECKS, "OVERALL")))).alias("check_id")).withColumn("own", F.try_element_at("told", F.col("check_id")))
    none = F.col("check_id") == "V9"  # has nothing to say of any request; others pass
    rank = F.when(F.col("check_id") == "OVERALL", F.greatest(F.coalesce("worst", F.lit(1)), F.lit(1))).when(none, STATUSES.index("NOT_APPLICABLE")).otherwise(F.coalesce("own.rank", F.lit(1)))
    return every.select("request_id", "check_id", name(rank).alias("status"), F.when(none, "no_sanitized_evidence_type").otherwise(F.coalesce("own.reasons", F.lit(""))).alias("reasons"))
