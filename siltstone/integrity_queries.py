"""Evidence stores made of the tables: customers' orders as revisions, their lines as evidence; each query with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import integrity
from siltstone.plans.settle import settled

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


#: What a revision's columns are, as SQL that both engines take: k is the order's key, p that of the customer's order before it.
_REVISION = {
    "revision_id": "concat('r', k)",
    "sealed": "price > 15000",
    "clean": "price < 250000",
    "state_sha256": "concat('s', k)",
    "manifest_sha256": "CASE WHEN price > 15000 THEN concat('m', k) END",
    "previous_id": "CASE WHEN p IS NULL AND k % 19 = 0 THEN 'r0' WHEN k % 23 = 0 THEN 'rx' WHEN p IS NOT NULL THEN concat('r', p) END",
    "previous_manifest_sha256": "CASE WHEN p IS NULL THEN NULL WHEN k % 29 = 0 THEN 'mx' WHEN k % 3 = 0 THEN concat('s', p) ELSE concat('m', p) END",
    "quarantines": "k % 3 = 0",
    "quarantine_state": "CASE WHEN k % 3 = 0 THEN CASE WHEN k % 31 = 0 THEN 'sx' ELSE concat('s', p) END END",
    "strays": "k % 37 = 0",
}


def revisions_of_orders(orders: DataFrame) -> DataFrame:
    """A revision an order, in the store of its customer."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("revision"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), before.alias("p"))
    return rows.select("store", "revision", *[F.expr(e).alias(c) for c, e in _REVISION.items()])


#: States one after the other, as SQL tells them.
_CHAIN = f"""rows AS (SELECT o_custkey AS store, o_orderkey AS revision, o_orderkey AS k, o_totalprice AS price, lag(o_orderkey) OVER s AS p, row_number() OVER s AS place FROM orders WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
revs AS (SELECT store, revision, place, p, {', '.join(f"{e} AS {c}" for c, e in _REVISION.items())} FROM rows),
seen AS (SELECT a.*, b.revision_id AS bid, b.state_sha256 AS bstate, b.manifest_sha256 AS bman FROM revs a LEFT JOIN revs b ON a.store = b.store AND b.place = a.place - 1),
facts AS (SELECT *, sealed AND clean AND NOT strays AS good, coalesce(previous_id = bid AND previous_manifest_sha256 = bman, false) AS linked,
  coalesce(quarantines AND previous_id = bid AND quarantine_state = bstate AND previous_manifest_sha256 = bstate, false) AS bound FROM seen),
walked(store, place, valid, was) AS (
  SELECT store, place, good AND previous_id IS NULL AND previous_manifest_sha256 IS NULL AND NOT quarantines, false FROM facts WHERE place = 1
  UNION ALL SELECT f.store, f.place, CASE WHEN f.quarantines THEN f.good AND f.bound AND NOT w.valid ELSE f.good AND f.linked AND w.valid END, w.valid FROM walked w JOIN facts f ON f.store = w.store AND f.place = w.place + 1),
states AS (SELECT f.store, f.revision, CASE WHEN w.valid THEN 'VALID' WHEN n.bound THEN 'QUARANTINED' WHEN NOT f.sealed THEN 'INCOMPLETE' ELSE 'INVALID' END AS status,
  array_to_string(list_filter([
    CASE WHEN f.place = 1 AND (f.previous_id IS NOT NULL OR f.previous_manifest_sha256 IS NOT NULL) THEN 'first_revision_names_previous' END,
    CASE WHEN f.place > 1 AND f.previous_id IS DISTINCT FROM f.bid AND NOT (f.bound AND NOT w.was) THEN 'previous_revision_mismatch' END,
    CASE WHEN f.place > 1 AND NOT coalesce(f.previous_manifest_sha256 = f.bman, false) AND NOT (f.bound AND NOT w.was) THEN 'previous_manifest_sha256_mismatch' END,
    CASE WHEN f.place > 1 AND NOT w.was AND NOT f.bound THEN 'previous_revision_not_valid' END,
    CASE WHEN f.strays OR f.place = 1 AND f.quarantines THEN 'quarantine_not_of_previous' END,
    CASE WHEN f.place > 1 AND f.quarantines AND w.was THEN 'quarantine_of_valid_revision' END,
    CASE WHEN f.place > 1 AND f.quarantines AND NOT w.was AND NOT f.bound THEN 'quarantine_state_mismatch' END], lambda x: x IS NOT NULL), ',') AS chain
  FROM facts f JOIN walked w USING (store, place) LEFT JOIN facts n ON n.store = f.store AND n.place = f.place + 1)"""


@sql(f"WITH RECURSIVE {_CHAIN} SELECT * FROM states")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every revision and what is wrong with its place in the chain."""
    return integrity.chained(revisions_of_orders(_table(spark, sf_dir, "orders")))


#: What an envelope's columns are, of a line of an order.
_ENVELOPE = {
    "evidence_id": "concat('e', l_orderkey, '-', l_linenumber)",
    "source_type": "CASE WHEN l_quantity = 7 THEN 'LOCAL' ELSE 'API' END",
    "capture_id": "concat('c', l_orderkey)",
    "page_index": "CASE WHEN l_partkey % 41 = 0 THEN 9 ELSE l_linenumber END",
    "has_next": "l_linenumber < 2",
    "pagination_complete": "l_suppkey % 17 <> 0",
    "http_status": "CASE WHEN l_partkey % 13 = 0 THEN 404 ELSE 200 END",
    "body": "CASE WHEN l_partkey % 11 = 0 THEN 'broken' WHEN l_partkey % 37 = 0 THEN 'absent' ELSE 'json' END",
    "body_recorded": "l_linenumber % 2 = 0",
    "completeness": "CASE WHEN l_partkey % 19 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END",
    "subject_commit": "CASE WHEN l_quantity < 2 THEN NULL WHEN l_quantity > 49 THEN 'other' ELSE 'head' END",
    "scanned": "l_suppkey % 29 <> 3",
    "storable": "l_partkey % 43 <> 5",
}


@sql(
    f"""WITH RECURSIVE {_CHAIN},
lines AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) o_custkey AS store, o_orderkey AS revision, o_totalprice AS price, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity),
env AS (SELECT store, revision, price, l_linenumber AS line, l_returnflag AS flag, {', '.join(f"{e} AS {c}" for c, e in _ENVELOPE.items())} FROM lines),
found AS (SELECT DISTINCT s.store, CASE o_orderpriority[1] WHEN '1' THEN 'V2' WHEN '2' THEN 'W5' ELSE 'V8' END AS check_id, 'of_' || lower(o_orderstatus) AS code FROM orders JOIN states s ON s.revision = o_orderkey WHERE o_totalprice > 290000 AND s.status <> 'QUARANTINED'),
sound AS (SELECT c.store, NOT EXISTS (SELECT 1 FROM found f WHERE f.store = c.store) AND NOT EXISTS (SELECT 1 FROM states s WHERE s.store = c.store AND s.status NOT IN ('VALID', 'QUARANTINED')) AS sound FROM (SELECT DISTINCT o_custkey AS store FROM orders) c),
req AS (SELECT o_orderkey AS request_id, o_custkey AS store, CASE WHEN o_orderkey % 53 = 0 THEN 'FAX' ELSE 'API' END AS source_type, CASE WHEN o_orderkey % 2 = 0 THEN 'head' END AS subject_commit, o_orderkey % 3 > 0 AS require_complete FROM orders),
named AS (SELECT r.request_id, r.store, e.evidence_id FROM req r JOIN env e ON e.revision = r.request_id WHERE e.line <> 5 UNION ALL SELECT request_id, store, 'gone' FROM req WHERE request_id % 47 = 0 UNION ALL SELECT r.request_id, r.store, e.evidence_id FROM req r JOIN env e ON e.revision = r.request_id WHERE e.line = 1 AND r.request_id % 59 = 0),
placed AS (SELECT DISTINCT n.request_id, n.evidence_id, e.* EXCLUDE (evidence_id), s.status, r.source_type AS want, r.subject_commit AS wanted, r.require_complete, d.sound FROM named n JOIN req r USING (request_id) JOIN sound d ON d.store = r.store LEFT JOIN env e ON e.evidence_id = n.evidence_id AND e.store = n.store LEFT JOIN states s ON s.store = e.store AND s.revision = e.revision),
good AS (SELECT * FROM placed WHERE sound AND status IS NOT NULL AND status <> 'QUARANTINED'),
caps AS (SELECT e.store, capture_id, count(*) AS pages, count(DISTINCT page_index) AS places, min(page_index) AS low, max(page_index) AS high, arg_max(has_next, page_index) AS more FROM env e JOIN states s ON s.store = e.store AND s.revision = e.revision AND s.status = 'VALID' GROUP BY ALL),
held AS (SELECT g.request_id, g.capture_id, count(DISTINCT evidence_id) AS held, c.* EXCLUDE (store, capture_id) FROM good g JOIN caps c USING (store, capture_id) WHERE g.source_type = 'API' GROUP BY ALL),
per AS (SELECT request_id, store, sound, (SELECT count(*) FROM named n WHERE n.request_id = r.request_id) AS n, (SELECT count(DISTINCT evidence_id) FROM named n WHERE n.request_id = r.request_id) AS d, EXISTS (SELECT 1 FROM good g WHERE g.request_id = r.request_id) AS usable FROM req r JOIN sound USING (store)),
reasons(request_id, check_id, rank, reason) AS (
  SELECT request_id, check_id, 3, code FROM per JOIN found USING (store)
  UNION ALL SELECT request_id, 'W1', 2, 'no_evidence_named' FROM per WHERE n = 0 UNION ALL SELECT request_id, 'W1', 2, 'evidence_named_twice' FROM per WHERE n > d UNION ALL SELECT request_id, 'W1', 2, 'named_evidence_missing' FROM placed WHERE status IS NULL
  UNION ALL SELECT request_id, 'V8', 3, 'quarantined_evidence_named' FROM placed WHERE status = 'QUARANTINED' UNION ALL SELECT request_id, 'V9', 0, 'no_sanitized_evidence_type' FROM per
  UNION ALL SELECT request_id, c, 2, CASE WHEN sound THEN 'no_usable_evidence' ELSE 'store_integrity_not_verified' END FROM per, (SELECT unnest(['V5', 'V6', 'V7', 'W2', 'W4']) AS c) WHERE NOT usable
  UNION ALL SELECT request_id, 'V5', 2, 'pagination_incomplete' FROM good WHERE source_type = 'API' AND NOT pagination_complete
  UNION ALL SELECT request_id, 'V5', 2, 'capture_pages_not_all_named' FROM held WHERE held < pages UNION ALL SELECT request_id, 'V5', 2, 'capture_page_missing' FROM held WHERE places < pages OR low <> 1 OR high <> pages UNION ALL SELECT request_id, 'V5', 2, 'last_page_has_next' FROM held WHERE more
  UNION ALL SELECT request_id, 'V6', CASE WHEN http_status = 200 AND body = 'broken' AND NOT body_recorded THEN 3 ELSE 2 END, CASE WHEN http_status <> 200 THEN 'http_status_not_200' WHEN body = 'absent' THEN 'raw_unavailable' WHEN body_recorded THEN 'body_not_json' ELSE 'body_not_json_but_not_recorded' END
    FROM good WHERE source_type = 'API' AND (http_status <> 200 OR body <> 'json')
  UNION ALL SELECT request_id, 'V7', 2, 'requirement_unknown_source_type' FROM good WHERE want = 'FAX' UNION ALL SELECT request_id, 'V7', 2, 'source_type_not_api' FROM good WHERE want = 'API' AND source_type <> 'API' UNION ALL SELECT request_id, 'V7', 2, 'evidence_incomplete' FROM good WHERE want = 'API' AND require_complete AND completeness = 'INCOMPLETE'
  UNION ALL SELECT request_id, 'W2', 0, 'no_subject_commit_required' FROM good WHERE wanted IS NULL UNION ALL SELECT request_id, 'W2', 3, 'subject_commit_mismatch' FROM good WHERE wanted = 'head' AND subject_commit = 'other'
  UNION ALL SELECT request_id, 'W2', 2, 'subject_commit_not_recorded' FROM good g WHERE wanted = 'head' AND subject_commit IS NULL AND NOT EXISTS (SELECT 1 FROM good x WHERE x.request_id = g.request_id AND x.subject_commit = 'other')
  UNION ALL SELECT request_id, 'W4', 3, 'raw_stored_without_clean_scan' FROM good WHERE body <> 'absent' AND NOT scanned UNION ALL SELECT request_id, 'W4', 3, 'stored_raw_not_storable' FROM good WHERE body <> 'absent' AND NOT storable),
checks AS (SELECT r.request_id, c.check_id, coalesce(max(x.rank), 1) AS rank, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM req r CROSS JOIN (SELECT unnest({list(integrity.CHECKS)}) AS check_id) c LEFT JOIN reasons x ON x.request_id = r.request_id AND x.check_id = c.check_id GROUP BY r.request_id, c.check_id)
SELECT request_id, check_id, {list(integrity.STATUSES)}[rank + 1] AS status, reasons FROM checks UNION ALL SELECT request_id, 'OVERALL', {list(integrity.STATUSES)}[greatest(max(rank), 1) + 1], '' FROM checks GROUP BY request_id"""
)
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen checks of the evidence that each order's request names, and their verdict."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    statuses = settled(integrity.chained(revisions_of_orders(orders)))
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    one = one.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("store")), "l_orderkey")
    envelopes = settled(one.select("store", F.col("l_orderkey").alias("revision"), "l_linenumber", *[F.expr(e).alias(c) for c, e in _ENVELOPE.items()]))
    digit = F.substring("o_orderpriority", 1, 1)
    findings = orders.where("o_totalprice > 290000").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("revision"), F.when(digit == "1", "V2").when(digit == "2", "W5").otherwise("V8").alias("check_id"), F.concat(F.lit("of_"), F.lower("o_orderstatus")).alias("code"))
    k = F.col("o_orderkey")
    wants = orders.select(k.alias("request_id"), F.col("o_custkey").alias("store"), F.when(k % 53 == 0, "FAX").otherwise("API").alias("source_type"), F.when(k % 2 == 0, "head").alias("subject_commit"), (k % 3 > 0).alias("require_complete"))
    own = envelopes.where("l_linenumber <> 5").select(F.col("revision").alias("request_id"), "evidence_id")
    twice = envelopes.where("l_linenumber = 1 and revision % 59 = 0").select(F.col("revision").alias("request_id"), "evidence_id")
    gone = orders.where("o_orderkey % 47 = 0").select(k.alias("request_id"), F.lit("gone").alias("evidence_id"))
    requests = wants.join(own.unionByName(twice).unionByName(gone), "request_id", "left")
    return integrity.validated(requests, statuses, findings, envelopes.drop("l_linenumber"))
