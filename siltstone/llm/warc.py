"""Not-modified revisits resolved to what they revisit.

Each revisit is joined, by canonical URL, with the latest full response before it. Its validators must agree with the
response's; then the response's headers are taken with those that a 304 may update. The join is a window over short
stretches of time of a URL, and a second one over the stretches' last responses, so that a URL with very many captures
is spread over as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 response may update, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie")


def canonical(url: Column) -> Column:
    """A URL without scheme, user, leading www., default port, fragment and trailing slash, its host in lower case, its
    parameters sorted; null for null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r"\.?(?::(?:80|443))?$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve(records: DataFrame, stretch: int = 3_600) -> DataFrame:
    """A row a revisit: record_id, url_key, ts, response_id, response_ts, verdict and headers.

    records: record_id, url, ts (whole seconds), kind ("response" or "revisit"), headers (map of lower-case names to
    values), digest. A response counts as full if its status is null or 200; other kinds and rows of null ts or url
    resolve nothing and, as revisits, come out as "no-response". Of responses of one second the largest record_id
    counts; one of the revisit's own second is not before it. verdict: "etag", "last-modified" or "digest" (the strongest
    validator that both have, and it agrees), "unvalidated" (no common one), "mismatch" or "no-response"; headers are
    merged for the first four, else the revisit's own. Repeated rows give a row each.
    """
    cols = records.columns
    status = F.col("status") if "status" in cols else F.lit(None).cast("int")
    base = records.select("record_id", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("bigint").alias("ts"), "kind", "headers", "digest", status.alias("status"))
    full = (F.col("kind") == "response") & (F.col("status").isNull() | (F.col("status") == 200)) & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    wanted = base.where(full | (F.col("kind") == "revisit") & placed)
    what = F.struct("ts", "record_id", "headers", "digest")
    rows = wanted.withColumns({"stretch": F.floor(F.col("ts") / stretch), "full": F.when(full, what), "is_full": full.cast("int")})
    # responses sort after the revisits of their second, so that what stands before a revisit is earlier
    within = Window.partitionBy("url_key", "stretch").orderBy("ts", "is_full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("full", ignorenulls=True).over(within))
    lasts = wanted.where(full).withColumn("stretch", F.floor(F.col("ts") / stretch)).groupBy("url_key", "stretch").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    before = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    need = rows.where((F.col("is_full") == 0) & F.col("near").isNull()).select("url_key", "stretch").distinct()
    steps = need.join(lasts, ["url_key", "stretch"], "full").withColumn("from", F.last("last", ignorenulls=True).over(before)).where(F.col("from").isNotNull())
    far = need.join(steps.select("url_key", "stretch", "from"), ["url_key", "stretch"])
    responses = wanted.where(full).select(F.col("url_key").alias("k"), F.col("ts").alias("t"), F.col("record_id").alias("r"), what.alias("far"))
    found = far.join(responses, (F.col("url_key") == F.col("k")) & (F.col("from.ts") == F.col("t")) & (F.col("from.record_id") == F.col("r"))).groupBy("url_key", "stretch").agg(F.first("far").alias("far"))
    out = rows.where(F.col("is_full") == 0).join(found, ["url_key", "stretch"], "left").withColumn("of", F.coalesce("near", "far"))
    # revisits without a URL or time meet nothing, and are not gathered to find that out
    lost = base.where((F.col("kind") == "revisit") & ~placed).withColumn("of", F.lit(None).cast(out.schema["of"].dataType))
    columns = ["record_id", "url_key", "ts", "headers", "digest", "of"]
    out = out.select(*columns).unionByName(lost.select(*columns))
    mine, theirs = F.col("headers"), F.col("of")["headers"]
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    verdict = F.when(F.col("of").isNull(), "no-response")
    for name, a, b in (("etag", weak(_header(mine, "etag")), weak(_header(theirs, "etag"))), ("last-modified", _header(mine, "last-modified"), _header(theirs, "last-modified")), ("digest", F.col("digest"), F.col("of")["digest"])):
        verdict = verdict.when(a.isNotNull() & b.isNotNull(), F.when(a == b, name).otherwise("mismatch"))
    out = out.withColumn("verdict", verdict.otherwise("unvalidated"))
    updates = F.map_filter(mine, lambda k, v: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.coalesce(F.map_contains_key(updates, k), F.lit(False)))
    merged = F.when(F.col("verdict").isin("no-response", "mismatch"), mine).otherwise(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(updates, F.create_map().cast("map<string,string>"))))
    return out.select("record_id", "url_key", "ts", F.col("of")["record_id"].alias("response_id"), F.col("of")["ts"].alias("response_ts"), "verdict", merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages: each page is a response at second 10 * page_id, and a revisit of its URL, with
    another scheme and a fragment, follows 25 seconds later; by page_id the revisit has the same entity tag, a weak one,
    only the digest, or another tag."""
    id_, n = F.col("page_id"), F.col("page_id") % 4
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.select((id_ * 2).alias("record_id"), "url", (id_ * 10).alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("date"), (id_ * 10).cast("string")).alias("headers"), digest.alias("digest"))
    date = (id_ * 10 + 25).cast("string")
    other = F.when(n == 0, F.create_map(F.lit("etag"), tag, F.lit("date"), date)).when(n == 1, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), date, F.lit("content-length"), F.lit("0")))
    other = other.when(n == 2, F.create_map(F.lit("date"), date)).otherwise(F.create_map(F.lit("etag"), F.lit("other"), F.lit("date"), date))
    url = F.concat(F.regexp_replace("url", r"^https?://", "HTTPS://"), F.lit("#seen"))
    revisit = pages.select((id_ * 2 + 1).alias("record_id"), url.alias("url"), (id_ * 10 + 25).alias("ts"), F.lit("revisit").alias("kind"), other.alias("headers"), digest.alias("digest"))
    return response.unionByName(revisit)


def digest_of(found: DataFrame) -> DataFrame:
    """resolve() rows with the headers as text."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url_key", "ts", "response_id", "response_ts", "verdict", shown.alias("headers"))


#: digest_of(resolve(captures(pages))) in DuckDB's SQL.
SQL = r"""
WITH k AS (SELECT page_id, html, url,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?', '') AS rest FROM pages),
u AS (SELECT page_id, coalesce(html, '') AS html,
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), '\.?(?::(?:80|443))?$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN regexp_extract(rest, '^[^?]*\?(.*)$', 1) <> ''
     THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '')), '&') ELSE '' END AS url_key
  FROM k WHERE url IS NOT NULL),
f AS (SELECT page_id * 2 AS record_id, url_key, page_id * 10 AS ts, substr(md5(html), 1, 16) AS tag, sha1(html) AS digest, strlen(html)::VARCHAR AS size FROM u),
v AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 10 + 25 AS ts, page_id % 4 AS n, substr(md5(html), 1, 16) AS tag, sha1(html) AS digest FROM u),
j AS (SELECT v.*, f.record_id AS response_id, f.ts AS response_ts, f.tag AS ftag, f.digest AS fdigest, f.size AS size,
  row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS r
  FROM v LEFT JOIN f ON f.url_key = v.url_key AND f.ts < v.ts),
w AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no-response' WHEN n IN (0, 1) THEN CASE WHEN tag = ftag THEN 'etag' ELSE 'mismatch' END
  WHEN n = 2 THEN CASE WHEN digest = fdigest THEN 'digest' ELSE 'mismatch' END ELSE 'mismatch' END AS verdict FROM j WHERE r = 1)
SELECT record_id, url_key, ts, response_id, response_ts, verdict,
  CASE WHEN verdict IN ('etag', 'digest')
  THEN 'content-length=' || size || ';content-type=text/html;date=' || ts::VARCHAR || ';etag=' || CASE n WHEN 1 THEN 'W/' || tag ELSE ftag END
  ELSE CASE WHEN n = 1 THEN 'content-length=0;' ELSE '' END || 'date=' || ts::VARCHAR || CASE n WHEN 0 THEN ';etag=' || tag WHEN 1 THEN ';etag=W/' || tag WHEN 2 THEN '' ELSE ';etag=other' END END AS headers
FROM w
"""
