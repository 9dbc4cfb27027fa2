"""Committed trees against what was approved: ids of directories folded bottom up, files compared, and what was published of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

# Modes of entries.
FILE, LINK, SUBMODULE, TREE = "100644", "120000", "160000", "40000"


def object_id(kind: str, content: Column) -> Column:
    """The id of an object of a repository: SHA-1 of its kind, length and bytes."""
    return F.sha1(F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(bytearray(1)), content))


def tree_ids(files: DataFrame) -> DataFrame:
    """(tree_id, path, oid) of every directory of files (tree_id, path, mode, oid), "" being the top.

    Directories are hashed bottom up, a level a round: an entry is its mode, name and id, entries stand in the order of their
    bytes, directories as if their names ended in a slash. A directory's entries are one row, for its id is the hash of them
    together; a level moves each of its entries once. Null paths are left out; without files there are no trees.
    """
    steps = F.split("path", "/")
    level = files.where("path is not null").select("tree_id", steps.alias("steps"), F.col("mode").cast("string").alias("mode"), "oid")
    level = settled(level.withColumn("depth", F.size("steps")))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    folded, done = level.where("false"), []
    for depth in range(deepest, 0, -1):
        here = level.where(F.col("depth") == depth).unionByName(folded)
        name = F.element_at("steps", -1)
        entry = F.concat(F.hex(F.concat(F.col("mode"), F.lit(" "), name).cast("binary")), F.lit("00"), F.col("oid"))
        order = F.hex(F.concat(name, F.when(F.col("mode") == TREE, "/").otherwise("")).cast("binary"))
        up = here.groupBy("tree_id", F.slice("steps", 1, depth - 1).alias("steps")).agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), entry.alias("entry")))).alias("entries"))
        content = F.unhex(F.array_join(F.transform("entries", lambda e: e["entry"]), ""))
        folded = settled(up.select("tree_id", "steps", F.lit(TREE).alias("mode"), object_id("tree", content).alias("oid"), F.lit(depth - 1).alias("depth")))
        done.append(folded)
    rows = reduce(DataFrame.unionByName, done, level.where("false"))
    return rows.select("tree_id", F.array_join("steps", "/").alias("path"), "oid")


def compared(trees: DataFrame, files: DataFrame, approved: DataFrame) -> DataFrame:
    """(tree_id, status, rule, reason, mismatches) of each of trees (tree_id, commit, claimed_commit, source_commit, claimed_source).

    files: tree_id, path, mode, oid, content, too_large, null contents being unreadable unless too large; approved: tree_id, path, content.
    A tree whose commit is null is not read. mismatches are code:path in order, joined by commas. status is MISMATCH if there is any, else
    UNVERIFIABLE if the tree or a file could not be read, else MATCH; the rule FAILED, NOT_PROVEN or PASS, with the first code as
    its reason. Files and approved ones of a path may be missing on either side; paths are unique within a tree.
    """
    mine = files.withColumnRenamed("content", "data").withColumn("there", F.lit(True))
    asked = approved.withColumnRenamed("content", "wanted").withColumn("approved", F.lit(True))
    both = mine.join(asked, ["tree_id", "path"], "full").join(trees.where("commit is not null").select("tree_id"), "tree_id", "left_semi")
    there, wanted = F.coalesce(F.col("there"), F.lit(False)), F.coalesce(F.col("approved"), F.lit(False))
    blank = F.col("data").isNull() & (F.col("mode") != SUBMODULE)
    sized = F.coalesce(F.col("too_large"), F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(there & (F.col("mode") == LINK), "symlink").when(there & (F.col("mode") == SUBMODULE), "gitlink").when(there & (F.col("mode") != FILE), "mode_changed"),
            F.when(there & blank & sized, "blob_too_large"),
            F.when(there & F.col("data").isNotNull() & (F.length("oid") == 40) & (object_id("blob", F.col("data")) != F.col("oid")), "invalid_git_object"),
            F.when(there & ~wanted, "extra_file"),
            F.when(there & wanted & (F.col("data") != F.col("wanted")), "content_mismatch"),
            F.when(~there, "missing_file"),
        )
    )
    told = both.select("tree_id", F.explode(F.transform(codes, lambda c: F.concat(c, F.lit(":"), F.col("path")))).alias("m"))
    commits = F.array_compact(F.array(F.when(~F.col("claimed_commit").eqNullSafe(F.col("commit")), "artifact_commit_mismatch:"), F.when(~F.col("claimed_source").eqNullSafe(F.col("source_commit")), "source_commit_mismatch:")))
    told = told.unionByName(trees.where("commit is not null").select("tree_id", F.explode(commits).alias("m")))
    lists = told.groupBy("tree_id").agg(F.array_sort(F.collect_set("m")).alias("mismatches"))
    unread = both.where(there & blank & ~sized).select("tree_id", F.lit(True).alias("unread")).distinct()
    rows = trees.select("tree_id", "commit").join(lists, "tree_id", "left").join(unread, "tree_id", "left")
    status = F.when(F.col("mismatches").isNotNull(), "MISMATCH").when(F.col("commit").isNull() | F.col("unread"), "UNVERIFIABLE").otherwise("MATCH")
    rule = F.when(status == "MISMATCH", "FAILED").when(status == "MATCH", "PASS").otherwise("NOT_PROVEN")
    reason = F.when(status == "MISMATCH", F.substring_index(F.get("mismatches", F.lit(0)), ":", 1)).when(status == "MATCH", "whole_tree_matches_source").otherwise("artifact_unverifiable")
    return rows.select("tree_id", status.alias("status"), rule.alias("rule"), reason.alias("reason"), F.coalesce(F.array_join("mismatches", ","), F.lit("")).alias("mismatches"))


_CONTENTS = r"^/repos/[A-Za-z0-9-]+/[A-Za-z0-9._-]+/contents/([A-Za-z0-9._/-]+)\?ref=([0-9a-f]{40})$"


def published(answers: DataFrame, trees: DataFrame, files: DataFrame, approved: DataFrame) -> DataFrame:
    """(answer_id, status, reason) of answers (answer_id, tree_id, source_type, completeness, endpoint, raw) that tell what was published.

    trees: tree_id, commit, status of compared(); files and approved as there. An answer counts if it is complete, of the contents
    of the tree's commit and can be decoded; it fails if its bytes don't have the id it tells, or differ from the approved
    file or the committed one. The first reason in this order is told; an answer of an unknown tree proves nothing.
    """
    path, ref = F.regexp_extract("endpoint", _CONTENTS, 1), F.regexp_extract("endpoint", _CONTENTS, 2)
    rows = answers.withColumns({"at": path, "ref": ref}).join(trees.select("tree_id", "commit", F.col("status").alias("tree_status")), "tree_id", "left")
    doc = F.from_json(F.col("raw").cast("string"), "content string, sha string, encoding string, path string")
    rows = rows.withColumn("doc", doc).withColumn("served", F.try_to_binary(F.regexp_replace("doc.content", r"\s", ""), F.lit("base64")))
    own = lambda df, name: df.select("tree_id", F.col("path").alias("at"), F.sha2("content", 256).alias(name))
    rows = rows.join(own(approved, "wanted"), ["tree_id", "at"], "left").join(own(files, "held"), ["tree_id", "at"], "left")
    whole = (F.col("source_type") == "API") & (F.col("completeness") == "COMPLETE")
    of_tree = (F.col("at") != "") & (F.col("tree_status") == "MATCH") & (F.col("ref") == F.col("commit"))
    sound = F.col("served").isNotNull() & F.col("doc.sha").isNotNull() & (F.col("doc.encoding") == "base64") & (F.col("doc.path") == F.col("at"))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    digest = F.sha2("served", 256)
    steps = [
        (no(whole), "NOT_PROVEN", "capture_incomplete"), (no(of_tree), "NOT_PROVEN", "not_a_contents_answer_for_the_artifact"), (F.col("raw").isNull(), "NOT_PROVEN", "raw_unavailable"), (no(sound), "NOT_PROVEN", "contents_answer_not_decodable"),
        (object_id("blob", F.col("served")) != F.col("doc.sha"), "FAILED", "served_bytes_do_not_hash_to_reported_blob"), (no(F.col("wanted") == digest), "FAILED", "served_bytes_differ_from_approved_source"), (no(F.col("held") == digest), "FAILED", "served_bytes_differ_from_committed_blob"),
    ]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))) for test, s, r in steps], F.struct(F.lit("PASS").alias("status"), F.lit("published_matches_source").alias("reason")))
    return rows.withColumn("first", first).select("answer_id", "first.status", "first.reason")
