"""Committed trees made of parts, answers that publish them, and clauses quoted from the documents; each query with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import artifacts, clauses
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


def files_of_parts(parts: DataFrame) -> DataFrame:
    """A file a part, eight to a tree, in folders by type and size; with what was approved of it."""
    k = F.col("p_partkey")
    path = F.concat_ws("/", F.regexp_replace(F.lower("p_type"), "[^a-z]", "-"), F.concat(F.lit("s"), F.col("p_size").cast("string")), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), k.cast("string")))
    content = F.concat("p_name", F.lit("\n"), k.cast("string"), F.lit(" é\n")).cast("binary")
    mode = F.when(k % 97 == 0, artifacts.LINK).when(k % 101 == 0, "100755").when(k % 103 == 0, artifacts.SUBMODULE).otherwise(artifacts.FILE)
    oid = F.when(k % 107 == 0, F.repeat(F.lit("0"), F.lit(40))).otherwise(artifacts.object_id("blob", content))
    told = F.when((k % 71 != 0) & (k % 67 != 0) & (mode != artifacts.SUBMODULE), content)
    wanted = F.when(k % 89 == 0, F.lit("other").cast("binary")).otherwise(content)
    return parts.select(F.floor(k / 8).alias("tree_id"), k.alias("k"), path.alias("path"), mode.alias("mode"), oid.alias("oid"), told.alias("content"), (k % 71 == 0).alias("too_large"), content.alias("whole"), wanted.alias("wanted"))


def _commits(files: DataFrame) -> DataFrame:
    t = F.col("tree_id")
    commit = F.sha1(F.concat(F.lit("commit"), t.cast("string")).cast("binary"))
    return files.select("tree_id").distinct().select("tree_id", F.when(t % 31 != 0, commit).alias("commit"), F.when(t % 29 != 0, commit).otherwise("x").alias("claimed_commit"), F.lit("s").alias("source_commit"), F.when(t % 37 != 0, "s").alias("claimed_source"))


_FILES = """parts AS (SELECT p_partkey AS k, p_partkey // 8 AS tree_id, regexp_replace(lower(p_type), '[^a-z]', '-', 'g') AS a, 's' || p_size AS b, replace(p_name, ' ', '_') || '-' || p_partkey AS c, p_name || chr(10) || p_partkey || ' é' || chr(10) AS whole,
  CASE WHEN p_partkey % 97 = 0 THEN '120000' WHEN p_partkey % 101 = 0 THEN '100755' WHEN p_partkey % 103 = 0 THEN '160000' ELSE '100644' END AS mode FROM part),
files AS (SELECT *, a || '/' || b || '/' || c AS path, sha1('blob ' || strlen(whole) || chr(0) || whole) AS blob, CASE WHEN k % 107 = 0 THEN repeat('0', 40) ELSE sha1('blob ' || strlen(whole) || chr(0) || whole) END AS oid,
  k % 71 <> 0 AND k % 67 <> 0 AND mode <> '160000' AS told, CASE WHEN k % 89 = 0 THEN 'other' ELSE whole END AS wanted FROM parts)"""


def _level(name: str, source: str, keys: str, entry: str, mode: str) -> str:
    slash = "|| '/'" if mode == "'40000'" else ""
    body = f"string_agg(hex(encode({mode} || ' ' || {entry})) || '00' || upper(oid), '' ORDER BY hex(encode({entry} {slash})))"
    return f"{name} AS (SELECT {keys}, sha1(unhex(hex(encode('tree ' || (length(body) // 2))) || '00' || body)) AS oid FROM (SELECT {keys}, {body} AS body FROM {source} GROUP BY {keys}))"


@sql(
    f"""WITH {_FILES}, {_level("d2", "files", "tree_id, a, b", "c", "mode")}, {_level("d1", "d2", "tree_id, a", "b", "'40000'")}, {_level("d0", "d1", "tree_id", "a", "'40000'")}
SELECT tree_id, a || '/' || b AS path, oid FROM d2 UNION ALL SELECT tree_id, a, oid FROM d1 UNION ALL SELECT tree_id, '', oid FROM d0"""
)
def tree_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all directories of the trees."""
    return artifacts.tree_ids(files_of_parts(_table(spark, sf_dir, "part")))


_TREES = f"""{_FILES},
trees AS (SELECT DISTINCT tree_id, CASE WHEN tree_id % 31 <> 0 THEN sha1('commit' || tree_id) END AS commit FROM files),
codes AS (SELECT tree_id, path, unnest([
    CASE WHEN k % 83 = 0 THEN NULL WHEN mode = '120000' THEN 'symlink' WHEN mode = '160000' THEN 'gitlink' WHEN mode <> '100644' THEN 'mode_changed' END, CASE WHEN k % 83 <> 0 AND NOT told AND mode <> '160000' AND k % 71 = 0 THEN 'blob_too_large' END,
    CASE WHEN k % 83 <> 0 AND told AND k % 107 = 0 THEN 'invalid_git_object' END, CASE WHEN k % 83 <> 0 AND k % 79 = 0 THEN 'extra_file' END, CASE WHEN k % 83 <> 0 AND k % 79 <> 0 AND told AND k % 89 = 0 THEN 'content_mismatch' END,
    CASE WHEN k % 83 = 0 AND k % 79 <> 0 THEN 'missing_file' END]) AS code FROM files),
told AS (SELECT tree_id, code || ':' || path AS m FROM codes WHERE code IS NOT NULL UNION ALL SELECT tree_id, 'artifact_commit_mismatch:' FROM trees WHERE tree_id % 29 = 0 UNION ALL SELECT tree_id, 'source_commit_mismatch:' FROM trees WHERE tree_id % 37 = 0),
verdicts AS (SELECT t.tree_id, any_value(t.commit) AS commit, string_agg(m, ',' ORDER BY encode(m)) AS m, bool_or(f.unread) AS unread FROM trees t LEFT JOIN told ON told.tree_id = t.tree_id AND t.commit IS NOT NULL
  LEFT JOIN (SELECT tree_id, bool_or(k % 83 <> 0 AND NOT told AND mode <> '160000' AND k % 71 <> 0) AS unread FROM files GROUP BY tree_id) f ON f.tree_id = t.tree_id GROUP BY t.tree_id),
judged AS (SELECT *, CASE WHEN m IS NOT NULL THEN 'MISMATCH' WHEN commit IS NULL OR unread THEN 'UNVERIFIABLE' ELSE 'MATCH' END AS status FROM verdicts)"""


def _sides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is committed, and what was approved; either may lack files."""
    return files.where("k % 83 <> 0"), files.where("k % 79 <> 0").select("tree_id", "path", F.col("wanted").alias("content"))


@sql(
    f"""WITH {_TREES} SELECT tree_id, status, CASE status WHEN 'MISMATCH' THEN 'FAILED' WHEN 'MATCH' THEN 'PASS' ELSE 'NOT_PROVEN' END AS rule,
  CASE status WHEN 'MISMATCH' THEN split_part(m, ':', 1) WHEN 'MATCH' THEN 'whole_tree_matches_source' ELSE 'artifact_unverifiable' END AS reason, coalesce(m, '') AS mismatches FROM judged"""
)
def tree_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree against what was approved."""
    files = settled(files_of_parts(_table(spark, sf_dir, "part")))
    held, approved = _sides(files)
    return artifacts.compared(_commits(files), held.select("tree_id", "path", "mode", "oid", "content", "too_large"), approved)


@sql(
    f"""WITH {_TREES}
SELECT k AS answer_id,
  CASE WHEN k % 3 = 0 OR k % 5 = 0 OR j.status <> 'MATCH' OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 43 = 0 THEN 'NOT_PROVEN' WHEN k % 19 = 0 OR k % 79 = 0 OR k % 83 = 0 OR k % 23 = 0 THEN 'FAILED' ELSE 'PASS' END AS status,
  CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'capture_incomplete' WHEN j.status <> 'MATCH' OR k % 11 = 0 THEN 'not_a_contents_answer_for_the_artifact' WHEN k % 13 = 0 THEN 'raw_unavailable' WHEN k % 17 = 0 OR k % 43 = 0 THEN 'contents_answer_not_decodable'
    WHEN k % 19 = 0 THEN 'served_bytes_do_not_hash_to_reported_blob' WHEN k % 23 = 0 THEN 'served_bytes_differ_from_approved_source' ELSE 'published_matches_source' END AS reason
FROM files f JOIN judged j USING (tree_id)"""
)
def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers tell of published files, against the committed trees."""
    files = settled(files_of_parts(_table(spark, sf_dir, "part")))
    held, approved = _sides(files)
    trees = _commits(files)
    states = settled(trees.select("tree_id", "commit").join(artifacts.compared(trees, held.select("tree_id", "path", "mode", "oid", "content", "too_large"), approved), "tree_id").select("tree_id", "commit", "status"))
    k = F.col("k")
    served = F.when(k % 23 == 0, F.lit("changed").cast("binary")).otherwise(F.col("whole"))
    sha = F.when(k % 19 == 0, F.repeat(F.lit("1"), F.lit(40))).otherwise(artifacts.object_id("blob", served))
    body = F.to_json(F.struct(F.when(k % 43 == 0, "%%%").otherwise(F.concat(F.base64(served), F.lit("\n"))).alias("content"), sha.alias("sha"), F.when(k % 17 == 0, "none").otherwise("base64").alias("encoding"), F.col("path")))
    ref = F.when(k % 11 == 0, F.repeat(F.lit("a"), F.lit(40))).otherwise(F.sha1(F.concat(F.lit("commit"), F.col("tree_id").cast("string")).cast("binary")))
    endpoint = F.concat(F.lit("/repos/own/repo/contents/"), "path", F.lit("?ref="), ref)
    answers = files.select(k.alias("answer_id"), "tree_id", F.when(k % 3 == 0, "LOCAL").otherwise("API").alias("source_type"), F.when(k % 5 == 0, "INCOMPLETE").otherwise("COMPLETE").alias("completeness"), endpoint.alias("endpoint"), F.when(k % 13 != 0, body.cast("binary")).alias("raw"))
    return artifacts.published(answers, states, held, approved)


_CLAUSES = """texts AS (SELECT doc_id AS source, coalesce(text, '') AS text FROM documents),
quotes AS (SELECT source, i AS clause, q AS quoted FROM (SELECT source, unnest(string_split(text, chr(10))) AS q, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts) WHERE q <> '' UNION ALL SELECT source, 0, text[1:40] FROM texts WHERE length(text) > 40),
found AS (SELECT source, clause, quoted, (length(text) - length(replace(text, quoted, ''))) // length(quoted) AS n, strpos(text, quoted) - 1 AS begin, strpos(text, quoted) - 1 + length(quoted) AS "end" FROM quotes JOIN texts USING (source)),
once AS (SELECT *, lag("end") OVER w AS ended, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM (SELECT source, clause, begin, "end" FROM found WHERE n = 1 UNION ALL SELECT source, 1000000000, length(text), length(text) FROM texts) WINDOW w AS (PARTITION BY source ORDER BY begin, "end", clause)),
gaps AS (SELECT o.source, begin, translate(text[coalesce(furthest, 0) + 1:begin], ' ' || chr(9) || chr(10) || '|-*;,.:', '') AS said FROM once o JOIN texts USING (source) WHERE begin > coalesce(furthest, 0))"""


@sql(
    f"""WITH {_CLAUSES} SELECT t.source AS doc_id, (SELECT count(*) FROM found f WHERE f.source = t.source) AS n_clauses, (SELECT count(*) FROM found f WHERE f.source = t.source AND n = 1) AS n_once,
  (SELECT count(*) FROM once o WHERE o.source = t.source AND clause < 1000000000 AND begin < ended) AS n_overlaps, (SELECT count(*) FROM gaps g WHERE g.source = t.source) AS n_gaps,
  sha256(coalesce((SELECT string_agg(said, ' ' ORDER BY begin) FROM gaps g WHERE g.source = t.source AND said <> ''), '')) AS left_digest FROM texts t"""
)
def clause_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a document stand in it once, which overlap its beginning, and what is left over."""
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = settled(docs.select(F.col("doc_id").alias("source"), text.alias("text")))
    lines = texts.select("source", F.posexplode(F.split("text", "\n")).alias("i", "quoted")).where("quoted <> ''").select("source", (F.col("i") + 1).cast("bigint").alias("clause"), "quoted")
    heads = texts.where(F.length("text") > 40).select("source", F.lit(0).cast("bigint").alias("clause"), F.substring("text", 1, 40).alias("quoted"))
    places = settled(clauses.placed(texts, lines.unionByName(heads)))
    counts = places.groupBy("source").agg(F.count("*").alias("n_clauses"), F.count_if(F.col("n") == 1).alias("n_once"))
    over = clauses.overlaps(places).groupBy("source").agg(F.count("*").alias("n_overlaps"))
    whole = clauses.left_over(texts, places).join(counts, "source", "left").join(over, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select(F.col("source").alias("doc_id"), zero("n_clauses"), zero("n_once"), zero("n_overlaps"), "n_gaps", F.sha2("left", 256).alias("left_digest"))
