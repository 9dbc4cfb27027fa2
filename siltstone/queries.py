"""The engine's operators over the driver's tables, each with the SQL of its rows.

A query function is registered by @sql with DuckDB SQL that has the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import graphs, logic, matching, merge, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


_FLAG = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"
_LINES = f"SELECT *, {_FLAG} AS src_rank, CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS sev FROM lineitem"


def _lines(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    q = F.col("l_quantity")
    return t.lineitem.withColumns({"src_rank": rank, "sev": F.when(q >= 40, 3).when(q >= 25, 2).when(q >= 10, 1).otherwise(0)})


@sql(
    f"""WITH f AS ({_LINES}), k AS (SELECT *, l_linestatus = 'F' AS elig FROM f)
    SELECT l_orderkey, max(sev)::BIGINT AS sev, arg_min(l_partkey, (src_rank, l_linenumber, l_partkey, l_suppkey)) AS first_part,
      string_agg(DISTINCT src_rank::VARCHAR, ',' ORDER BY src_rank::VARCHAR) AS sources, count(*) AS n FROM k WHERE elig GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey, sev::BIGINT, l_partkey, src_rank::VARCHAR, 1 FROM k WHERE NOT elig"""
)
def dedup_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of the findings of a key: largest severity, first text, union of sources; the others pass."""
    order = F.struct("src_rank", "l_linenumber", "l_partkey", "l_suppkey")
    merged = {"sev": F.max("sev").cast("bigint"), "first_part": F.min_by("l_partkey", order), "sources": merge.ranked_union("src_rank"), "n": F.count("*")}
    single = {"sev": F.col("sev").cast("bigint"), "first_part": F.col("l_partkey"), "sources": F.col("src_rank").cast("string"), "n": F.lit(1).cast("bigint")}
    return merge.dedup_merge(_lines(Tables(spark, sf_dir)), ["l_orderkey"], F.col("l_linestatus") == "F", merged, single)


@sql(
    """WITH j AS (SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT source, lang, max(quality)::BIGINT AS quality, min(doc_id) AS first_doc, count(*) AS n FROM j WHERE quality IS NOT NULL GROUP BY source, lang
    UNION ALL SELECT source, lang, NULL, doc_id, 1 FROM j WHERE quality IS NULL"""
)
def dedup_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a null key don't merge."""
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    merged = {"quality": F.max("quality").cast("bigint"), "first_doc": F.min("doc_id"), "n": F.count("*")}
    single = {"quality": F.col("quality").cast("bigint"), "first_doc": F.col("doc_id"), "n": F.lit(1).cast("bigint")}
    return merge.dedup_merge(j, ["source", "lang"], F.col("quality").isNotNull(), merged, single)


@sql(
    """SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY
      CASE WHEN o_totalprice >= 300000 THEN 0 WHEN o_totalprice >= 100000 THEN 1 ELSE 2 END, o_orderpriority, o_orderdate, o_orderkey) AS id FROM orders"""
)
def sort_number_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a total order, numbered within their report."""
    p = F.col("o_totalprice")
    rank = F.when(p >= 300000, 0).when(p >= 100000, 1).otherwise(2)
    return merge.numbered(Tables(spark, sf_dir).orders, ["o_orderstatus", "o_custkey"], [rank, "o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_orderstatus", "o_orderkey", "id")


@sql(
    """SELECT n_name, s.st AS status, count(o_orderkey) AS n FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) s(st)
    LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = s.st GROUP BY ALL"""
)
def summary_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by every nation and status, zeros kept."""
    t = Tables(spark, sf_dir)
    dims = t.nation.select("n_nationkey", "n_name").withColumn("status", F.explode(F.array(*map(F.lit, "FOPX"))))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderstatus").alias("status"))
    return merge.zero_filled(rows, dims, ["n_nationkey", "status"]).select("n_name", "status", "n")


@sql("SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def summary_exploded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row counts once for each of its values."""
    return merge.exploded_counts(Tables(spark, sf_dir).part, F.split("p_name", " "), "word")


@sql("SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two levels and their totals."""
    out = Tables(spark, sf_dir).orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


_MATCHED = """l AS (SELECT o_custkey % 500 AS k, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P'),
    e AS (SELECT user_id AS k, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    m AS (SELECT coalesce(l.k, e.k) AS k, l.o_orderkey, e.event_id, l.o_orderpriority, e.event_type, l.k IS NOT NULL AS hl, e.k IS NOT NULL AS hr FROM l FULL JOIN e ON l.k = e.k AND l.r = e.r)"""


def _matched(t: Tables) -> DataFrame:
    left = t.orders.where("o_orderstatus = 'P'").select((F.col("o_custkey") % 500).alias("k"), "o_orderkey", "o_orderpriority")
    right = t.events.select(F.col("user_id").alias("k"), "event_id", "event_type")
    return matching.one_to_one(left, right, ["k"], ["o_orderkey"], ["event_id"])


@sql(f"WITH {_MATCHED} SELECT k, o_orderkey, event_id, hl AND hr AS matched FROM m")
def match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th of a key with the k-th."""
    return _matched(Tables(spark, sf_dir)).select("k", "o_orderkey", "event_id", "matched")


@sql(
    f"""WITH {_MATCHED}, c AS (SELECT k % 10 AS category, count(*) FILTER (hl AND hr) AS tp, count(*) FILTER (NOT hr) AS fn, count(*) FILTER (NOT hl) AS fp,
      count(*) FILTER (hl AND hr AND length(o_orderpriority) = length(event_type)) AS same FROM m GROUP BY 1)
    SELECT category, tp, fn, fp, CASE WHEN tp + fn = 0 THEN 'N/A' ELSE printf('%.1f', tp / (tp + fn) * 100.0::DOUBLE) END AS recall,
      CASE WHEN tp + fp = 0 THEN 'N/A' ELSE printf('%.1f', tp / (tp + fp) * 100.0::DOUBLE) END AS "precision",
      CASE WHEN tp = 0 THEN 'N/A' ELSE printf('%.1f', same / tp * 100.0::DOUBLE) END AS accuracy FROM c"""
)
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and accuracy as text."""
    m = _matched(Tables(spark, sf_dir)).withColumn("category", F.col("k") % 10)
    return matching.metrics(m, ["category"], F.length("o_orderpriority") == F.length("event_type")).select("category", "tp", "fn", "fp", "recall", "precision", "accuracy")


_SNAP = "SELECT o_custkey AS k, o_orderpriority AS fp, o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN 'base' ELSE 'head' END AS side FROM orders"


@sql(
    f"""WITH s AS ({_SNAP}), c AS (SELECT *, count(*) FILTER (side = 'base') OVER (PARTITION BY k) AS b, count(*) FILTER (side = 'head') OVER (PARTITION BY k) AS h,
      count(*) FILTER (side = 'base') OVER (PARTITION BY k, fp) AS pb, count(*) FILTER (side = 'head') OVER (PARTITION BY k, fp) AS ph FROM s),
    d AS (SELECT *, CASE WHEN k % 2 = 0 AND b = 1 AND h = 1 THEN 'identity' WHEN pb = 1 AND ph = 1 THEN 'fingerprint' END AS st FROM c),
    e AS (SELECT *, bool_or(side = 'base' AND st IS NULL) OVER (PARTITION BY k) AS lb, bool_or(side = 'head' AND st IS NULL) OVER (PARTITION BY k) AS lh FROM d)
    SELECT o_orderkey, side, coalesce(st, CASE WHEN lb AND lh THEN 'undetermined' WHEN CASE side WHEN 'base' THEN pb ELSE ph END > 1 THEN 'duplicate' ELSE 'only' END) AS stage FROM e"""
)
def delta_two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of two snapshots of all orders corresponds, by identity, by fingerprint, or not."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("fp"), "o_orderkey", F.year("o_orderdate").alias("y"))
    return matching.delta(o.where("y <= 1997").drop("y"), o.where("y > 1997 or y is null").drop("y"), ["k"], "fp", F.col("k") % 2 == 0).select("o_orderkey", "side", "stage")


@sql("SELECT a.doc_id AS base_doc, b.doc_id AS head_doc FROM (SELECT sha256(text) AS f, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT sha256(text) AS f, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1 HAVING count(*) = 1) b ON a.f = b.f")
def delta_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even and odd number that match by a fingerprint that is unique on either side."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("f"))
    sides = [d.where(F.col("doc_id") % 2 == r).groupBy("f").agg(F.count("*").alias("n"), F.min("doc_id").alias(name)).where("n = 1").drop("n") for r, name in ((0, "base_doc"), (1, "head_doc"))]
    return sides[0].join(sides[1], "f").select("base_doc", "head_doc")


@sql(
    """SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'status' END, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'priority' END,
      CASE WHEN year(a.o_orderdate) <> year(b.o_orderdate) THEN 'year' END) AS changes FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_custkey % 5 = b.o_custkey % 5"""
)
def delta_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the fields in which two rows differ, in fixed order."""
    o = Tables(spark, sf_dir).orders
    a, b = o.alias("a"), o.alias("b")
    both = a.join(b, (F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1) & (F.col("a.o_custkey") % 5 == F.col("b.o_custkey") % 5))
    fields = [("status", F.col("a.o_orderstatus"), F.col("b.o_orderstatus")), ("priority", F.col("a.o_orderpriority"), F.col("b.o_orderpriority")), ("year", F.year("a.o_orderdate"), F.year("b.o_orderdate"))]
    return both.select(F.col("a.o_orderkey").alias("o_orderkey"), F.array_join(matching.changed_fields(fields), ",").alias("changes"))


@sql("SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference with multiplicity."""
    rows = Tables(spark, sf_dir).lineitem
    return matching.multiset_difference(*(rows.where(F.col("l_linestatus") == s).select("l_orderkey", "l_returnflag") for s in "FO"))


@sql(
    """WITH e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS kind FROM events), u AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY ALL)
    SELECT a.event_id, u.n FROM e a JOIN u ON a.user_id = u.user_id AND a.kind IS NOT DISTINCT FROM u.kind"""
)
def nullsafe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join in which null equals null."""
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    u = e.groupBy(F.col("user_id").alias("u"), F.col("kind").alias("k")).agg(F.count("*").alias("n"))
    return e.join(u, (F.col("user_id") == F.col("u")) & F.col("kind").eqNullSafe(F.col("k"))).select("event_id", "n")


_PREFIXES = [("Brand#", "any"), ("Brand#1", "ones"), ("Brand#12", "twelve"), ("Brand#2", "twos"), ("Brand#25", "last"), ("X", "none")]
_PREFIX_VALUES = ", ".join(f"('{p}', '{c}')" for p, c in _PREFIXES)


@sql(f"SELECT p_partkey, arg_max(c, length(p)) AS category FROM part LEFT JOIN (VALUES {_PREFIX_VALUES}) r(p, c) ON starts_with(p_brand, p) GROUP BY p_partkey")
def prefix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the longest prefix."""
    rules = spark.createDataFrame(_PREFIXES, "prefix string, category string")
    return logic.longest_prefix(Tables(spark, sf_dir).part, "p_brand", rules, "prefix").select("p_partkey", "category")


@sql(
    """SELECT p_partkey, coalesce(o.s, d.s, 'INFO') AS severity FROM part LEFT JOIN (VALUES ('Brand#3', 'CRITICAL'), ('Brand#7', 'LOW')) o(b, s) ON p_brand = o.b
    LEFT JOIN (VALUES ('ECONOMY', 'MEDIUM'), ('PROMO', 'HIGH')) d(t, s) ON p_type = d.t"""
)
def override_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's own value over the directory's over the fixed one."""
    own = F.broadcast(spark.createDataFrame([("Brand#3", "CRITICAL"), ("Brand#7", "LOW")], "p_brand string, a string"))
    by_type = F.broadcast(spark.createDataFrame([("ECONOMY", "MEDIUM"), ("PROMO", "HIGH")], "p_type string, b string"))
    return Tables(spark, sf_dir).part.join(own, "p_brand", "left").join(by_type, "p_type", "left").select("p_partkey", F.coalesce("a", "b", F.lit("INFO")).alias("severity"))


@sql(
    r"""SELECT DISTINCT p_name, pat AS pattern FROM part JOIN (VALUES ('*widget', '^(?s).*widget$'), ('RED *', '^(?s)red .*$'), ('b?ue bolt', '^(?s)b.ue bolt$'), ('*.x', '^(?s).*\.x$')) r(pat, re) ON regexp_matches(lower(p_name), re)"""
)
def wildcard_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that patterns with * and ? grant, without regard to case."""
    patterns = spark.createDataFrame([(p,) for p in ("*widget", "RED *", "b?ue bolt", "*.x")], "pattern string")
    return logic.grants(Tables(spark, sf_dir).part, "p_name", patterns, "pattern")


@sql(
    """WITH g AS (SELECT l_orderkey, l_linestatus, bool_and(l_linenumber % 2 = 1) AS ar, count(*) FILTER (l_quantity > 30) AS h, count(*) AS n, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
    d AS (SELECT *, CASE WHEN ar THEN h = n AND h > 0 ELSE h > 0 END AS dec, CASE WHEN ar THEN h > 0 AND h < n AND b ELSE h = 0 AND b END AS blk FROM g)
    SELECT l_orderkey, CASE WHEN bool_or(dec) THEN 'MATCH' WHEN bool_or(blk) THEN 'UNRESOLVABLE' ELSE 'NO_MATCH' END AS verdict FROM d GROUP BY l_orderkey"""
)
def three_valued_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over groups of candidates, some unknown."""
    rows = Tables(spark, sf_dir).lineitem
    return logic.three_valued(rows, "l_orderkey", "l_linestatus", F.col("l_linenumber") % 2 == 1, F.col("l_quantity") > 30, F.col("l_returnflag") == "R")


@sql(
    """WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'NOT_PROVEN' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' ELSE 'PASS' END END AS st FROM orders)
    SELECT o_custkey, CASE WHEN bool_or(st = 'FAILED') THEN 'FAILED' WHEN bool_and(st = 'PASS') THEN 'PASS' ELSE 'NOT_PROVEN' END AS status FROM s GROUP BY o_custkey"""
)
def composed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status of several: failed, passed, or not proven."""
    s, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    st = F.when(s == "F", "PASS").when(s == "O", "NOT_PROVEN").when(urgent, "FAILED").otherwise("PASS")
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(logic.composed(st).alias("status"))


@sql("SELECT user_id FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND value > 60 GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def division_all_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with all of several actions."""
    return logic.having_all(Tables(spark, sf_dir).events.where("value > 60"), ["user_id"], "event_type", ["signup", "purchase", "error"])


@sql("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a counterpart."""
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@sql("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 250000)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a counterpart."""
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders.where("o_orderstatus = 'P' AND o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@sql("SELECT event_id, CASE WHEN json_extract_string(props, '$.z') IS NULL THEN 1 ELSE 0 END::BIGINT AS missing, CASE WHEN coalesce(json_extract_string(props, '$.k') <> '42', true) THEN 1 ELSE 0 END::BIGINT AS not_equal FROM events")
def missing_property_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over properties: an absent one fails."""
    value = lambda path: F.get_json_object("props", path)
    return Tables(spark, sf_dir).events.select("event_id", logic.FAILS["exists"](value("$.z"), "").cast("bigint").alias("missing"), logic.FAILS["equals"](value("$.k"), "42").cast("bigint").alias("not_equal"))


@sql("SELECT event_id FROM events WHERE coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) < 7, true)")
def numeric_threshold_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number is absent or too small."""
    return Tables(spark, sf_dir).events.where(logic.FAILS["at_least"](F.get_json_object("props", "$.k"), "7")).select("event_id")


@sql("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values out of JSON."""
    return Tables(spark, sf_dir).events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@sql("SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey")
def edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between known nodes, without loops."""
    t = Tables(spark, sf_dir)
    rows = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey"))
    return graphs.edges(rows, "s_nationkey", "c_nationkey", t.nation, "n_nationkey")


_EDGES = f"e AS ({SQL['edges_dedup']})"


@sql(f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def reach_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs joined by a path of any edges."""
    return graphs.reach(edges_dedup(spark, sf_dir))


@sql(f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src AS node FROM r WHERE src = dst")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of any edges."""
    return graphs.cycle_nodes(edges_dedup(spark, sf_dir))


@sql(f"WITH {_EDGES} SELECT n_nationkey, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src::VARCHAR) FROM e WHERE dst = n_nationkey), '') AS referrers FROM nation")
def referrers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to each node, by any edge."""
    return graphs.referrers(Tables(spark, sf_dir).nation.select("n_nationkey"), "n_nationkey", edges_dedup(spark, sf_dir))


@sql(
    """WITH b AS (SELECT p_partkey, u.* FROM part, (VALUES ('')) x, LATERAL (VALUES ('', 'map', NULL), ('name', 'str', p_name), ('size', 'int', p_size::VARCHAR)) u(path, vt, sv) WHERE p_partkey % 10 <> 3),
    h AS (SELECT p_partkey, u.* FROM part, LATERAL (VALUES ('', 'map', NULL), ('name', 'str', CASE WHEN p_partkey % 10 = 5 THEN upper(p_name) ELSE p_name END), ('size', CASE WHEN p_partkey % 10 = 6 THEN 'str' ELSE 'int' END, p_size::VARCHAR)) u(path, vt, sv)
      WHERE p_partkey % 10 <> 4 AND NOT (p_partkey % 10 = 7 AND u.path = 'size')),
    c AS (SELECT coalesce(b.p_partkey, h.p_partkey) AS p_partkey, coalesce(b.path, h.path) AS path,
      CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN b.vt IS DISTINCT FROM h.vt OR b.sv IS DISTINCT FROM h.sv THEN 'modified' END AS change
      FROM b FULL JOIN h ON b.p_partkey = h.p_partkey AND b.path = h.path)
    SELECT p_partkey, path, change FROM c WHERE change IS NOT NULL AND (path = '' OR NOT EXISTS (SELECT 1 FROM c d WHERE d.p_partkey = c.p_partkey AND d.path = '' AND d.change IS NOT NULL))"""
)
def tree_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two documents, each told at its topmost node."""
    part, m = Tables(spark, sf_dir).part, F.col("p_partkey") % 10

    def nodes(df: DataFrame, name, kind) -> DataFrame:  # noqa: ANN001
        node = lambda path, vtype, value: F.struct(F.array(*map(F.lit, path)).cast("array<string>").alias("path"), vtype.alias("vtype"), value.cast("string").alias("sval"))
        rows = F.array(node([], F.lit("map"), F.lit(None)), node(["name"], F.lit("str"), name), node(["size"], kind, F.col("p_size")))
        return df.select("p_partkey", F.inline(rows))

    base = nodes(part.where(m != 3), F.col("p_name"), F.lit("int"))
    head = nodes(part.where(m != 4), F.when(m == 5, F.upper("p_name")).otherwise(F.col("p_name")), F.when(m == 6, "str").otherwise("int"))
    head = head.where(~((m == 7) & F.exists("path", lambda x: x == "size")))
    return graphs.tree_diff(base, head, ["p_partkey"]).select("p_partkey", F.array_join("path", "/").alias("path"), "change")


@sql("SELECT p_partkey FROM part a WHERE p_size < 5 AND EXISTS (SELECT 1 FROM part b WHERE b.p_size > 48 AND b.p_type = a.p_type AND b.p_brand = a.p_brand)")
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed rows for which one of the same type was added."""
    part = Tables(spark, sf_dir).part
    return part.where("p_size < 5").join(part.where("p_size > 48").select("p_type", "p_brand"), ["p_type", "p_brand"], "left_semi").select("p_partkey")


@sql("SELECT conv_id, count(*) AS pages, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM conversations GROUP BY conv_id")
def page_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are complete."""
    return sequences.page_sequence(Tables(spark, sf_dir).conversations, "conv_id", "turn")


@sql("SELECT conv_id, turn, sha256(text) AS digest, coalesce(lag(sha256(text)) OVER w, '') AS previous, coalesce(turn - lag(turn) OVER w = 1, true) AS contiguous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of digests."""
    return sequences.chain(Tables(spark, sf_dir).conversations, "conv_id", "turn", F.col("text")).select("conv_id", "turn", "digest", "previous", "contiguous")


@sql(
    """WITH s AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 60 AS b FROM orders)
    SELECT o_orderkey, n AS next_start FROM (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS n FROM s) WHERE n < b"""
)
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that the next one begins within."""
    a = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", a.alias("a"), (a + 1 + F.col("o_orderkey") % 60).alias("b"))
    return sequences.overlaps(o, "o_custkey", "a", "b", "o_orderkey").select("o_orderkey", "next_start")


@sql("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE event_type <> 'view' GROUP BY user_id")
def latest_deciding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event that decides."""
    return sequences.latest(Tables(spark, sf_dir).events, ["user_id"], F.col("event_type") != "view", F.struct("ts", "event_id"), "event_type")


@sql("SELECT user_id, count(*) FILTER (nx < v) AS inversions FROM (SELECT user_id, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY event_id, value) AS nx FROM events) GROUP BY user_id")
def order_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where numbers run against time."""
    return sequences.inversions(Tables(spark, sf_dir).events, "user_id", "event_id", "value")


@sql("SELECT substr(sha256(text), 1, 16) AS key, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT sha256(source || '/' || lang)) = 1 THEN 'duplicate' ELSE 'conflict' END AS state FROM documents GROUP BY 1")
def duplicate_vs_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a key, equal or not."""
    d = Tables(spark, sf_dir).documents.withColumn("key", F.substring(F.sha2("text", 256), 1, 16))
    return sequences.duplicates(d, ["key"], F.concat_ws("/", "source", "lang"))


@sql("SELECT o_custkey, ['COMPLETE', 'NOT_PROVEN', 'INCOMPLETE', 'BROKEN'][1 + max(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END)] AS status FROM orders GROUP BY o_custkey")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of several states."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_totalprice") < 100000, 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return merge.worst(Tables(spark, sf_dir).orders, ["o_custkey"], rank, ["COMPLETE", "NOT_PROVEN", "INCOMPLETE", "BROKEN"])


@sql("SELECT doc_id, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id)::BIGINT AS running, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id) <= 50000 AS within FROM documents")
def running_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total against a cap."""
    docs = Tables(spark, sf_dir).documents.withColumn("key", F.concat_ws("/", "source", "lang"))
    return sequences.running_cap(docs, "key", ["doc_id"], "n_chars", 50000).select("doc_id", "running", "within")


@sql("SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3")
def topk_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each group."""
    return sequences.top(Tables(spark, sf_dir).documents, ["lang", "source"], [F.desc("n_chars"), "doc_id"], 3).select("lang", "source", "doc_id", "rank")


def _cases(text: str) -> str:
    return ", ".join("CASE WHEN regexp_matches({}, '{}') THEN '{}' END".format(text, p.replace("'", "''"), n) for n, p in tx.SECRET_SHAPES.items())


@sql(f"SELECT doc_id, shapes FROM (SELECT doc_id, concat_ws(',', {_cases('text')}) AS shapes FROM documents) WHERE shapes <> ''")
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of secrets in texts."""
    return Tables(spark, sf_dir).documents.select("doc_id", tx.secret_shapes(F.col("text")).alias("shapes")).where("shapes <> ''")


@sql(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[A-Z0-9]{16}', '[REDACTED]', 'g'), '(token|password|secret) ?= ?"[^"]*"', '[REDACTED]', 'g'),
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[REDACTED]', 'g')) AS digest FROM documents"""
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their secrets blanked, as digests."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2(tx.redacted(F.col("text")), 256).alias("digest"))


@sql("SELECT p_name, 'id-' || lpad(row_number() OVER (ORDER BY p_name)::VARCHAR, 6, '0') AS token FROM (SELECT DISTINCT p_name FROM part)")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as numbered tokens in their order."""
    return tx.token_table(Tables(spark, sf_dir).part, "p_name")


@sql("SELECT c_custkey, 'u:' || substr(sha256(c_custkey::VARCHAR), 1, 12) AS pseudonym FROM customer")
def pseudonym_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms by hash."""
    return Tables(spark, sf_dir).customer.select("c_custkey", tx.pseudonym(F.col("c_custkey")).alias("pseudonym"))


@sql("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages."""
    return Tables(spark, sf_dir).pages.select("page_id", F.explode(tx.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@sql(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all('${' || lang || '.name} ' || source || ' ${AWS::Region} ${!lit}', '\$\{([A-Za-z0-9:._-]+)\}', 1), lambda x: string_split(x, '.')[1]), ',') AS tokens FROM documents""")
def sub_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in substitution text."""
    text = F.concat(F.lit("${"), "lang", F.lit(".name} "), "source", F.lit(" ${AWS::Region} ${!lit}"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_join(tx.sub_tokens(text), ",").alias("tokens"))


@sql("SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0)::BIGINT AS cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per key in whole cents, pre-aggregated before the join."""
    t = Tables(spark, sf_dir)
    sums = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), F.coalesce("cents", F.lit(0)).cast("bigint").alias("cents"))
