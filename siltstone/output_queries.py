"""Output of tools and agents written from the tables' rows and read back; the SQL tells from the rows what must come of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import records
from siltstone.sources import listing, tool_output

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


@sql(
    """WITH r AS (SELECT 'c' || c_custkey AS template_id, c_nationkey % 5 AS n, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT template_id, 'violations' AS state, 'rule_' || lower(o_orderpriority[1]) AS rule_id, CASE WHEN o_orderstatus <> 'P' THEN 'O' || o_orderkey END AS resource, 'price ' || floor(o_totalprice)::BIGINT AS message FROM r WHERE n > 2 AND o_orderkey IS NOT NULL
UNION ALL SELECT DISTINCT template_id, CASE n WHEN 0 THEN 'timeout' WHEN 1 THEN 'pass' ELSE 'error' END, NULL, NULL, NULL FROM r WHERE n < 3"""
)
def checker_output_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy checker's output a customer, an object an order one after the other or in an array: broken, timed out or passing in some nations."""
    orders, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = F.concat(F.when(F.col("o_orderstatus") == "P", "/Outputs/O").otherwise("/Resources/O"), k.cast("string"), F.lit("/Properties/X"))
    said = F.concat(F.lit(" price "), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("\n"))
    at = F.struct(F.struct(F.struct(place.alias("path")).alias("traversed_to")).alias("value"))
    check = F.struct(F.struct(F.struct(F.struct(at.alias("UnResolved")).alias("check"), F.struct(said.alias("custom_message")).alias("messages")).alias("Unary")).alias("Clause"))
    rule = F.struct(F.struct(F.concat(F.lit("rule_"), F.substring("o_orderpriority", 1, 1)).alias("name"), F.array(F.struct(F.struct(F.array(check).alias("checks")).alias("Block"))).alias("checks")).alias("Rule"))
    objects = orders.select(F.col("o_custkey").alias("c_custkey"), k, F.to_json(F.struct(F.lit("file").alias("name"), F.array(rule).alias("not_compliant"))).alias("said"))
    lists = objects.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "said"))), lambda x: x["said"]).alias("all"))
    n = F.col("c_nationkey") % 5
    rows = _table(spark, sf_dir, "customer").join(lists, "c_custkey", "left")
    joined = F.coalesce(F.array_join("all", "\n"), F.lit(""))
    text = F.when(n == 2, F.concat(joined, F.lit('{"name"'))).when(n == 3, F.concat(F.lit("["), F.coalesce(F.array_join("all", ","), F.lit("")), F.lit("]"))).otherwise(joined)
    return tool_output.guard_findings(rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("template_id"), (n == 0).alias("timed_out"), F.when(n == 1, 0).otherwise(19).alias("exit_code"), text.alias("stdout")))


_MONTH = "month(o_orderdate)"


@sql(
    f"""WITH r AS (SELECT 'c' || o_custkey AS template_id, c_nationkey AS n, o_orderkey, {_MONTH} AS m, o_orderpriority[1] AS p, o_orderstatus AS s, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT *, array_to_string(list_filter([CASE WHEN m = 1 THEN 'source' END, CASE WHEN p = '5' THEN 'severity' END, CASE WHEN s = 'P' THEN 'type' END, CASE WHEN m = 2 THEN 'confidence' END, CASE WHEN price < 20000 THEN 'finding' END, CASE WHEN m IN (3, 4) OR price > 280000 THEN 'excerpt' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM r WHERE n <> 3)
SELECT template_id, CASE WHEN reasons = '' THEN 'f' || o_orderkey WHEN price >= 20000 THEN 'f' || o_orderkey ELSE ' ' END AS finding, CASE WHEN reasons = '' THEN CASE WHEN s = 'F' THEN 'IAM' ELSE 'Other' END END AS category,
  CASE WHEN reasons = '' THEN CASE WHEN m = 5 THEN 'Contextual' ELSE 'Likely' END END AS confidence, CASE WHEN reasons = '' THEN NULL ELSE reasons END AS reasons FROM j
UNION ALL SELECT DISTINCT template_id, NULL, NULL, NULL, 'schema_version' FROM r WHERE n = 3"""
)
def agent_output_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's output a customer, a finding an order: what is taken and as what, and why the rest is not."""
    m, p, s, price = F.month("o_orderdate"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.col("o_totalprice")
    piece = F.struct(F.lit("d").alias("Detail"), F.when(m == 3, " ").when(m != 4, "e").alias("Excerpt"))
    record = F.struct(
        F.lit("R").alias("Resource"), F.when(s == "F", "IAM").otherwise("Unheard").alias("Normalized_Category"), F.when(s == "P", "None").otherwise("Security").alias("FindingType"), F.when(p == "5", "WORST").otherwise("LOW").alias("Severity"),
        F.when(m == 2, "Sure").when(m == 5, "Contextual").when(m == 6, "Confirmed").otherwise("Likely").alias("Confidence"), F.when(m == 1, "cfn-lint").otherwise("Agent Review").alias("Source"),
        F.when(price < 20000, " ").otherwise(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).alias("Finding"), F.when(price > 280000, F.array().cast("array<struct<Detail:string,Excerpt:string>>")).otherwise(F.array(piece)).alias("Evidence"),
    )
    lists = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_json(F.collect_list(record)).alias("all"))
    n = F.col("c_nationkey")
    version = F.when(n == 3, "2.0").when(n != 9, "1.4")
    whole = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"schema_version": "'), version, F.lit('", ')), F.lit("")), F.lit('"findings": '), F.col("all"), F.lit("}"))
    rows = _table(spark, sf_dir, "customer").join(lists, "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("template_id"), F.when(n % 2 == 0, F.concat(F.lit("  "), F.col("all"))).otherwise(whole).alias("text"))
    good, bad = tool_output.agent_findings(rows, ("IAM", "Encryption"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    return good.select("template_id", "finding", "category", "confidence", none("reasons")).unionByName(bad.select("template_id", F.col("Finding").alias("finding"), none("category"), none("confidence"), F.array_join("reasons", ",").alias("reasons")))


#: A path of a part, as SQL that both engines take.
_PATH = "concat(CASE WHEN p_size % 7 = 0 THEN '/' WHEN p_size % 11 = 0 THEN 'C:' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN './/' WHEN p_size % 3 = 0 THEN '.' ELSE '' END, CASE WHEN p_size = 1 THEN '/' ELSE concat(CASE WHEN p_size % 3 = 0 THEN '/' ELSE '' END, replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE chr(92) END), CASE WHEN p_size % 13 = 0 THEN '/../x' WHEN p_size % 4 = 0 THEN '/..z/' ELSE '' END) END)"


@sql(
    f"""WITH r AS (SELECT p_partkey AS k, replace({_PATH}, chr(92), '/') AS t FROM part), s AS (SELECT k, t, list_filter(string_split(t, '/'), lambda x: x NOT IN ('', '.')) AS steps FROM r),
j AS (SELECT k, steps, CASE WHEN t[1] = '/' OR coalesce(steps[1][-1] = ':', false) OR regexp_matches(coalesce(steps[1], ''), '^.*:$') THEN 'absolute' WHEN len(steps) = 0 THEN 'empty' WHEN list_contains(steps, '..') THEN 'climbs' END AS refused FROM s)
SELECT k, CASE WHEN refused IS NULL THEN array_to_string(steps, '/') END AS path, refused FROM j"""
)
def paths_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the parts' names, as reports tell them, or why not."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), records.output_path(F.expr(_PATH.replace("chr(92)", "char(92)"))).alias("p")).select("k", "p.path", "p.refused")


@sql(
    """WITH t AS (SELECT o_custkey AS pair, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE 'head' END AS side, CASE WHEN o_orderpriority < '3' THEN 'a' ELSE 'b' END AS name, min(o_totalprice) > 3000 AS available, min(month(o_orderdate)) // 7 AS version FROM orders GROUP BY ALL),
n AS (SELECT coalesce(b.pair, h.pair) AS pair, bool_and(coalesce(b.available AND h.available AND b.version = h.version, false)) AS same FROM (SELECT * FROM t WHERE side = 'base') b FULL JOIN (SELECT * FROM t WHERE side = 'head') h ON b.pair = h.pair AND b.name = h.name GROUP BY ALL)
SELECT c_custkey AS pair, coalesce(same, true) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 295000) AS comparable FROM customer LEFT JOIN n ON pair = c_custkey"""
)
def summaries_of_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sides of a customer's orders, as reports of two tools by their priority, have summaries that compare."""
    orders, pair = _table(spark, sf_dir, "orders"), F.col("o_custkey").alias("pair")
    side = F.when(F.col("o_orderstatus") == "F", "base").otherwise("head").alias("side")
    by = orders.groupBy(pair, side, F.when(F.col("o_orderpriority") < "3", "a").otherwise("b").alias("name")).agg((F.min("o_totalprice") > 3000).alias("available"), F.floor(F.min(F.month("o_orderdate")) / 7).cast("string").alias("version"))
    bare = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair")).join(by.select("pair").distinct(), "pair", "left_anti")
    found = records.summaries_comparable(by, orders.where("o_totalprice > 295000").select(pair))
    return found.unionByName(bare.join(found, "pair", "left_anti").select("pair", F.lit(True).alias("comparable")))


#: The path of an order's file, as SQL that both engines take.
_FILE = "concat(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'b/node_modules/' WHEN o_orderkey % 7 = 0 THEN 'b/cdk.out/' ELSE 'b/c/' END WHEN o_orderkey % 3 = 0 THEN 'cdk.out/' WHEN o_orderkey % 11 = 0 THEN 'cdk.out/deep/' ELSE '' END, 'T', o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '.YAML' WHEN '2' THEN '.template' WHEN '3' THEN '.template.json' WHEN '4' THEN '.txt' ELSE '.json' END)"


@sql(
    rf"""WITH f AS (SELECT o_custkey AS review_id, {_FILE} AS path, floor(o_totalprice * 30)::BIGINT AS length FROM orders WHERE o_orderkey % 13 <> 0),
c AS (SELECT *, CASE WHEN regexp_matches(path, '^cdk\.out/[^/]+\.template\.json$') THEN 'synthesized' WHEN regexp_matches(lower(path), '\.(yaml|yml|json|template)$') AND NOT regexp_matches(path, '(^|/)(cdk\.out|node_modules)/') THEN 'standalone' END AS grp FROM f),
t AS (SELECT *, sum(length) OVER (PARTITION BY review_id ORDER BY grp = 'synthesized', path)::BIGINT AS running FROM c WHERE grp IS NOT NULL)
SELECT review_id, path, grp, running, CASE WHEN running > 52428800 THEN CASE WHEN running - length <= 52428800 THEN 'stopped' ELSE 'not_reached' END WHEN length > 5242880 THEN 'too_large' ELSE 'taken' END AS state FROM t"""
)
def listed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a customer's folder, one an order, a review reads, and where it stops."""
    files = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), F.expr(_FILE).alias("path"), F.floor(F.col("o_totalprice") * 30).cast("bigint").alias("length"), (F.col("o_orderkey") % 13 == 0).alias("outside"))
    return listing.candidates(files)
