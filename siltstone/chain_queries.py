"""Chains of provenance made of orders, their customers' reviews and their lines; SQL that works from the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.settle import settled
from siltstone.rules import chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])


#: Columns of a chain, as SQL of an order that both engines take; b and c number its base and configuration.
_CHAINS = {
    "chain_id": "o_orderkey", "repo": "CASE WHEN o_orderkey % 41 <> 0 THEN 'repo' END", "base": "concat('b', o_orderkey % 50)", "head": "concat('h', o_orderkey)", "config": "concat('c', o_orderkey % 20)",
    "contract_path": "concat('p', o_orderkey % 3)", "contract_sha256": "CASE WHEN o_totalprice > 280000 THEN 'other' ELSE concat('k', o_orderkey % 20, '-', o_orderkey % 3) END",
    "report_sha256": "CASE WHEN o_totalprice < 12000 THEN 'other' ELSE concat('r', o_orderkey) END", "payload_sha256": "CASE WHEN month(o_orderdate) = 2 THEN 'other' ELSE concat('y', o_orderkey) END", "has_review": "o_orderstatus <> 'P'",
    "review_sha256": "CASE WHEN day(o_orderdate) = 3 THEN 'other' ELSE concat('v', o_orderkey) END", "has_evidence": "o_orderpriority <> '5-LOW'", "revision": "concat('s', o_custkey)", "manifest_sha256": "CASE WHEN o_orderkey % 43 = 0 THEN 'other' ELSE concat('m', o_custkey) END",
    "repository": "'own'", "evidence_verdict": "CASE WHEN day(o_orderdate) < 6 THEN 'NOT_PROVEN' ELSE 'PASS' END", "evidence_pages": "CASE WHEN day(o_orderdate) < 4 THEN 'NOT_PROVEN' ELSE 'PASS' END",
}
_REPORTS = {
    "chain_id": "o_orderkey", "sha256": "concat('r', o_orderkey)", "state": "CASE WHEN day(o_orderdate) = 9 THEN 'invalid' WHEN day(o_orderdate) = 10 THEN 'metadata' ELSE 'valid' END", "payload_sha256": "concat('y', o_orderkey)",
    "base": "CASE WHEN o_orderkey % 47 = 0 THEN 'b' ELSE concat('b', o_orderkey % 50) END", "head": "concat('h', o_orderkey)", "head_kind": "CASE WHEN o_orderkey % 53 = 0 THEN 'worktree' ELSE 'commit' END", "source": "CASE WHEN o_orderkey % 59 = 0 THEN 'file' ELSE 'git_revision' END",
    "config": "concat('c', o_orderkey % 20)", "contract_path": "concat('p', o_orderkey % 3)", "contract_sha256": "concat('k', o_orderkey % 20, '-', o_orderkey % 3)", "again": "CASE WHEN day(o_orderdate) = 12 THEN 'changed' WHEN day(o_orderdate) <> 13 THEN concat('y', o_orderkey) END",
}
_REVIEWS = {"chain_id": "o_orderkey", "sha256": "concat('v', o_orderkey)", "valid": "day(o_orderdate) <> 15", "has_errors": "day(o_orderdate) = 16", "tools": "day(o_orderdate) <> 17"}
_GATES = "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CASE o_custkey % 5 WHEN 0 THEN 'review_conflict' WHEN 1 THEN 'of_no_catalogue' WHEN 2 THEN 'approval_not_shown' ELSE 'gate_record_missing' END END"


@sql(
    f"""WITH c AS (SELECT o_orderkey AS k, {', '.join(f'{e} AS {c}' for c, e in _CHAINS.items())}, o_orderdate, o_custkey, day(o_orderdate) AS d, day(o_orderdate) NOT IN (8, 9, 10) AS usable FROM orders),
f AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity <> 5 GROUP BY ALL),
x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 7 = 0 AS id_differs, l_orderkey % 61 = 0 AS sha_differs FROM lineitem WHERE l_linenumber < 4),
e AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
codes(k, link, code) AS (
  SELECT k, 'subject', CASE WHEN repo IS NULL THEN 'link_check_error' ELSE 'revision_not_found' END FROM c WHERE repo IS NULL OR k % 13 = 0 OR k % 50 % 17 = 0
  UNION ALL SELECT k, 'subject', 'base_not_ancestor_of_head' FROM c WHERE repo IS NOT NULL AND k % 13 <> 0 AND k % 50 % 17 <> 0 AND k % 11 = 0
  UNION ALL SELECT k, 'subject', 'subject_mismatch' FROM c WHERE repo IS NOT NULL AND k % 13 <> 0 AND k % 50 % 17 <> 0 AND usable AND (k % 47 = 0 OR k % 53 = 0)
  UNION ALL SELECT k, 'contract', CASE WHEN repo IS NULL THEN 'link_check_error' ELSE 'revision_not_found' END FROM c WHERE repo IS NULL OR k % 20 % 9 = 0
  UNION ALL SELECT k, 'contract', 'config_not_ancestor_of_base' FROM c WHERE repo IS NOT NULL AND k % 20 % 9 <> 0 AND (k % 20 + k % 50) % 7 = 0
  UNION ALL SELECT k, 'contract', 'contract_blob_missing' FROM c WHERE repo IS NOT NULL AND k % 20 % 9 <> 0 AND (k % 20 + k % 3) % 11 < 2
  UNION ALL SELECT k, 'contract', 'contract_digest_mismatch' FROM c WHERE repo IS NOT NULL AND k % 20 % 9 <> 0 AND (k % 20 + k % 3) % 11 >= 2 AND contract_sha256 = 'other'
  UNION ALL SELECT k, 'contract', 'contract_mismatch_with_report' FROM c WHERE repo IS NOT NULL AND k % 20 % 9 <> 0 AND (k % 20 + k % 3) % 11 >= 2 AND usable AND k % 59 = 0
  UNION ALL SELECT k, 'verification', CASE d WHEN 8 THEN 'verification_artifact_missing' WHEN 9 THEN 'report_invalid' ELSE 'metadata_digest_mismatch' END FROM c WHERE NOT usable
  UNION ALL SELECT k, 'verification', 'verification_digest_mismatch' FROM c WHERE d <> 8 AND report_sha256 = 'other'
  UNION ALL SELECT k, 'verification', 'payload_digest_mismatch' FROM c WHERE usable AND (payload_sha256 = 'other' OR repo IS NOT NULL AND d = 12)
  UNION ALL SELECT k, 'verification', 'report_subject_mismatch' FROM c WHERE usable AND k % 47 = 0
  UNION ALL SELECT k, 'verification', 'recompute_unavailable' FROM c WHERE usable AND (repo IS NULL OR d = 13)
  UNION ALL SELECT k, 'review', 'review_artifact_missing' FROM c WHERE has_review AND d = 14
  UNION ALL SELECT k, 'review', 'review_digest_mismatch' FROM c WHERE has_review AND review_sha256 = 'other'
  UNION ALL SELECT k, 'review', CASE d WHEN 15 THEN 'review_report_invalid' WHEN 16 THEN 'review_report_has_errors' ELSE 'review_tool_unavailable' END FROM c WHERE has_review AND d IN (15, 16, 17)
  UNION ALL SELECT k, 'review', CASE WHEN coalesce(n, 0) <> 1 THEN 'finding_missing' ELSE unnest(list_filter([CASE WHEN sha_differs THEN 'finding_digest_mismatch' END, CASE WHEN k % 67 = 0 THEN 'identity_key_mismatch' END], lambda x: x IS NOT NULL)) END
    FROM c JOIN x ON x.l_orderkey = k LEFT JOIN f ON f.l_orderkey = k AND f.l_linenumber = x.l_linenumber WHERE has_review AND d NOT IN (14, 15) AND (coalesce(n, 0) = 1)
  UNION ALL SELECT k, 'review', 'finding_missing' FROM c JOIN x ON x.l_orderkey = k LEFT JOIN f ON f.l_orderkey = k AND f.l_linenumber = x.l_linenumber WHERE has_review AND d NOT IN (14, 15) AND coalesce(n, 0) <> 1
  UNION ALL SELECT k, 'gate', code FROM (SELECT o_orderkey AS k, {_GATES} AS code FROM orders) WHERE code IS NOT NULL
  UNION ALL SELECT k, 'github', CASE WHEN l_linenumber = 6 THEN 'evidence_id_missing' ELSE 'store_manifest_mismatch' END FROM c JOIN e ON l_orderkey = k WHERE has_evidence AND (l_linenumber IN (5, 6) OR k % 43 = 0)
  UNION ALL SELECT k, 'github', 'repository_mismatch' FROM c JOIN e ON l_orderkey = k WHERE has_evidence AND l_linenumber NOT IN (5, 6) AND k % 71 = 0
  UNION ALL SELECT k, 'github', 'capture_incomplete' FROM c WHERE has_evidence AND d < 4
  UNION ALL SELECT k, 'github', 'integrity_not_pass' FROM c WHERE has_evidence AND d IN (4, 5) AND NOT EXISTS (SELECT 1 FROM e WHERE l_orderkey = k AND l_linenumber = 6)),
ranked AS (SELECT k, link, max(CASE WHEN code IN ({', '.join(f"'{c}'" for c in chain.REASONS['BROKEN'])}) THEN 3 WHEN code IN ({', '.join(f"'{c}'" for c in chain.REASONS['NOT_PROVEN'])}) THEN 1 ELSE 2 END) AS r, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM codes GROUP BY ALL),
links AS (SELECT k AS chain_id, l.link, CASE WHEN l.link = 'review' AND NOT has_review OR l.link = 'github' AND NOT has_evidence THEN 'NOT_PRESENT' ELSE ['LINKED', 'NOT_PROVEN', 'INCOMPLETE', 'BROKEN'][coalesce(r, 0) + 1] END AS status, coalesce(codes, '') AS codes
  FROM c CROSS JOIN (SELECT unnest({list(chain.LINKS)}) AS link) l LEFT JOIN ranked USING (k, link))
SELECT * FROM links UNION ALL SELECT chain_id, 'chain', ['COMPLETE', 'NOT_PROVEN', 'INCOMPLETE', 'BROKEN'][max(CASE status WHEN 'LINKED' THEN 1 WHEN 'NOT_PROVEN' THEN 2 WHEN 'BROKEN' THEN 4 ELSE 3 END)], '' FROM links GROUP BY chain_id"""
)
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six links of every order's chain, why they don't hold, and the status of the chain."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    repo = F.lit("repo").alias("repo")
    named = lambda prefix, of, keep: orders.where(keep).select(repo, F.concat(F.lit(prefix), of.cast("string")).alias("commit"))
    commits = named("h", k, k % 13 != 0).unionByName(named("b", k % 50, k % 50 % 17 != 0).distinct()).unionByName(named("c", k % 20, k % 20 % 9 != 0).distinct())
    pair = lambda a, b, keep: orders.where(keep).select(repo, F.concat(*a).alias("ancestor"), F.concat(*b).alias("commit"))
    base, head, config = ((F.lit(p), n.cast("string")) for p, n in (("b", k % 50), ("h", k), ("c", k % 20)))
    ancestry = pair(base, head, k % 11 != 0).unionByName(pair(config, base, (k % 20 + k % 50) % 7 != 0).distinct())
    side = (k % 20 + k % 3) % 11
    blobs = orders.where(side != 0).select(repo, F.concat(*config).alias("commit"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("path"), F.when(side == 1, "120000").otherwise("100644").alias("mode"), F.concat_ws("-", F.concat(F.lit("k"), (k % 20).cast("string")), (k % 3).cast("string")).alias("sha256")).distinct()
    chains = _columns(orders, _CHAINS)
    reports = _columns(orders.where("day(o_orderdate) <> 8"), _REPORTS)
    reviews = _columns(orders.where("day(o_orderdate) <> 14"), _REVIEWS)
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    findings = lines.where("l_quantity <> 5").select(F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("finding_id"), line.alias("sha256"), line.alias("identity"))
    asked = lines.where("l_linenumber < 4").select(F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("finding_id"), F.when(F.col("l_orderkey") % 61 == 0, "x").otherwise(line).alias("sha256"), F.when(F.col("l_orderkey") % 67 == 0, "x").otherwise(line).alias("identity"))
    gates = orders.select(k.alias("chain_id"), F.expr(_GATES).alias("code")).where("code is not null")
    own = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    n, store = F.col("l_linenumber"), F.col("o_custkey").cast("string")
    evidence = own.select(k.alias("chain_id"), n.alias("evidence_id"), F.when(n == 5, "s0-").when(n != 6, F.concat(F.lit("s"), store)).alias("revision"), F.when(n != 6, F.concat(F.lit("m"), store)).alias("manifest_sha256"), F.when(k % 71 == 0, "other").otherwise("own").alias("repository"))
    return chain.judged(chains, chain.history(chains, commits, ancestry, blobs), reports, reviews, findings, asked, gates, evidence)


#: A gate a customer: its orders of status F are reviewers of its candidate, others are records of them.
@sql(
    """WITH c AS (SELECT c_custkey AS id, concat('h', c_custkey) AS head, c_nationkey AS n, c_custkey % 7 AS s, CASE WHEN c_custkey % 11 <> 0 THEN 10 END AS author FROM customer),
revs AS (SELECT o_custkey AS id, o_orderkey AS item, 10 + o_orderkey % 4 AS uid, CASE o_orderpriority[1] WHEN '1' THEN 'changes_requested' WHEN '5' THEN 'none' ELSE 'approved' END AS state, CASE WHEN month(o_orderdate) < 3 THEN NULL WHEN month(o_orderdate) < 6 THEN 'old' ELSE concat('h', o_custkey) END AS commit, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'),
made AS (SELECT * FROM revs r WHERE (SELECT s FROM c WHERE c.id = r.id) < 5),
shown AS (SELECT r.*, s >= 5 AS lost, m.item IS NULL AS unmade FROM revs r JOIN c USING (id) LEFT JOIN made m ON m.id = r.id AND m.item = r.item WHERE r.p > 40000 AND r.p <= 260000),
bad AS (SELECT id, count(*) AS bad, bool_or(item % 2 = 0) AS claims FROM revs WHERE p > 260000 GROUP BY id),
some_ AS (SELECT id FROM shown UNION SELECT id FROM bad UNION SELECT id FROM c WHERE n % 3 = 0),
codes(id, aspect, code) AS (
  SELECT id, 'integrity', 'gate_record_missing' FROM c WHERE id NOT IN (FROM some_)
  UNION ALL SELECT id, 'integrity', 'review_order_ambiguous' FROM c WHERE s = 3 AND id IN (FROM some_)
  UNION ALL SELECT id, 'integrity', 'gate_record_invalid' FROM bad
  UNION ALL SELECT id, 'revision_binding', 'gate_binds_other_commit' FROM c WHERE n % 3 = 0 AND n % 2 = 0
  UNION ALL SELECT id, 'integrity', 'gate_record_mismatch' FROM c WHERE n % 3 = 0 AND n % 2 = 0
  UNION ALL SELECT id, 'integrity', 'gate_source_missing' FROM shown WHERE item % 17 = 0
  UNION ALL SELECT id, 'integrity', CASE WHEN s = 5 THEN 'gate_record_mismatch' ELSE 'gate_source_missing' END FROM shown JOIN c USING (id) WHERE item % 17 <> 0 AND unmade AND s IN (5, 6)
  UNION ALL SELECT id, 'integrity', 'gate_record_mismatch' FROM shown WHERE item % 17 <> 0 AND NOT unmade AND item % 13 = 0
  UNION ALL SELECT id, 'revision_binding', 'approval_revision_misrecorded' FROM shown WHERE item % 17 <> 0 AND NOT unmade AND item % 13 = 0 AND commit IS DISTINCT FROM 'misrecorded'
  UNION ALL SELECT m.id, 'integrity', 'gate_record_missing' FROM (SELECT id, count(*) AS out FROM made m WHERE NOT EXISTS (SELECT 1 FROM shown x WHERE x.id = m.id AND x.item = m.item) GROUP BY id) m LEFT JOIN bad USING (id) WHERE m.id IN (FROM some_) AND out > coalesce(bad, 0)
  UNION ALL SELECT id, unnest(['integrity', 'staleness']), 'approval_self_declared_only' FROM bad WHERE claims AND NOT EXISTS (SELECT 1 FROM shown x WHERE x.id = bad.id AND x.item % 17 <> 0 AND NOT unmade AND x.item % 13 <> 0 AND x.state = 'approved')
  UNION ALL SELECT id, 'integrity', 'approval_self_declared_only' FROM bad WHERE claims
  UNION ALL SELECT id, 'revision_binding', 'gate_record_missing' FROM c WHERE id IN (FROM some_) AND n % 3 <> 0
  UNION ALL SELECT DISTINCT id, 'account_separation', 'changes_requested_outstanding' FROM made WHERE id IN (FROM some_) AND state = 'changes_requested'
  UNION ALL SELECT id, 'account_separation', 'actor_relation_unknown' FROM c WHERE id IN (FROM some_) AND (s = 4 OR author IS NULL AND EXISTS (SELECT 1 FROM made m WHERE m.id = c.id AND state = 'approved'))
  UNION ALL SELECT id, 'account_separation', 'approval_not_shown' FROM c WHERE id IN (FROM some_) AND NOT EXISTS (SELECT 1 FROM made m WHERE m.id = c.id AND state = 'approved')
  UNION ALL SELECT id, 'account_separation', 'separation_of_duty_not_shown' FROM c WHERE id IN (FROM some_) AND author IS NOT NULL AND EXISTS (SELECT 1 FROM made m WHERE m.id = c.id AND state = 'approved') AND NOT EXISTS (SELECT 1 FROM made m WHERE m.id = c.id AND state = 'approved' AND uid <> author)
  UNION ALL SELECT m.id, 'revision_binding', CASE WHEN bool_or(commit IS NULL) THEN 'approval_revision_unverifiable' ELSE 'approval_on_previous_head_only' END FROM made m JOIN c USING (id) WHERE m.id IN (FROM some_) AND state = 'approved' AND uid <> author GROUP BY m.id HAVING NOT bool_or(coalesce(commit = head, false))
  UNION ALL SELECT id, 'staleness', CASE WHEN n = 4 OR n = 5 THEN 'approval_revision_unverifiable' ELSE 'pr_head_mismatch' END FROM c WHERE id IN (FROM some_) AND n BETWEEN 4 AND 7)
SELECT DISTINCT id AS chain_id, aspect, code FROM codes"""
)
def chain_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the gate of a customer's chain doesn't hold, by aspect."""
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    n, k, i, p = F.col("c_nationkey"), F.col("c_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    head = F.concat(F.lit("h"), k.cast("string"))
    chains = customers.select(k.alias("chain_id"), head.alias("head"), F.lit("conf").alias("config"), F.lit("s1").alias("revision"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence_ids"))
    rows = orders.where("o_orderstatus = 'F'").join(customers.select(k.alias("o_custkey"), head.alias("head"), (k % 7).alias("s")), "o_custkey")
    digit, month = F.substring("o_orderpriority", 1, 1), F.month("o_orderdate")
    state = F.when(digit == "1", "changes_requested").when(digit == "5", "none").otherwise("approved")
    commit = F.when(month < 3, None).when(month < 6, "old").otherwise(F.col("head"))
    rows = settled(rows.select(F.col("o_custkey").alias("chain_id"), F.lit("candidate_review").alias("kind"), F.concat(F.lit("reviewer:"), i.cast("string")).alias("item"), i.alias("i"), p.alias("p"), "s", state.alias("decision"), commit.alias("commit")))
    made = rows.where("s < 5").select("chain_id", "kind", "item", "decision", "commit", F.concat(F.lit("d"), F.col("i").cast("string")).alias("digest"))
    contracts = chains.select("chain_id", F.lit("contract_approval").alias("kind"), F.lit("git:conf").alias("item"), F.lit("approved").alias("decision"), F.lit("conf").alias("commit"), F.lit("dc").alias("digest"))
    misled = F.col("i") % 13 == 0
    shown = rows.where("p > 40000 and p <= 260000").select(
        "chain_id", "kind", "item", F.when(misled, "misrecorded").otherwise(F.col("commit")).alias("commit"), F.lit("s1").alias("revision"), F.array(F.when(F.col("i") % 17 == 0, "e9").otherwise("e1")).alias("evidence_ids"),
        F.when(misled, "x").otherwise(F.concat(F.lit("d"), F.col("i").cast("string"))).alias("digest"),
    )
    other = n % 2 == 0
    approvals = customers.where(n % 3 == 0).select(k.alias("chain_id"), F.lit("contract_approval").alias("kind"), F.lit("git:conf").alias("item"), F.when(other, "x").otherwise("conf").alias("commit"), F.lit(None).cast("string").alias("revision"), F.array().cast("array<string>").alias("evidence_ids"), F.when(other, "x").otherwise("dc").alias("digest"))
    unusable = rows.where("p > 260000").select("chain_id", "kind", F.lit("gate_record_invalid").alias("code"), (F.col("i") % 2 == 0).alias("self_declared"))
    s = k % 7
    kinds = lambda has: F.when(has, F.array(F.lit("contract_approval"), F.lit("candidate_review"))).otherwise(F.array(F.lit("contract_approval")))
    sources = customers.select(
        k.alias("chain_id"), F.when(s == 3, F.array(F.lit("review_order_ambiguous"))).otherwise(F.array().cast("array<string>")).alias("codes"), kinds(s != 6).alias("loaded"), kinds(s != 6).alias("complete"), (n != 4).alias("pr_seen"),
        F.when(n.isin(6, 7), "else").when(n != 5, head).alias("pr_head"), F.when(k % 11 != 0, F.lit(10)).alias("pr_author"), (s == 4).alias("unknown_actor"), (s < 5).alias("reviewed"),
    )
    reviewers = rows.select("chain_id", (10 + F.col("i") % 4).alias("user_id"), F.col("decision").alias("state"), "commit")
    return chain.gate(chains, shown.unionByName(approvals), unusable, made.unionByName(contracts), sources, reviewers)
