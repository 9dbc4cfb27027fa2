"""Whole reports: findings checked and put in order, the envelope with its counts, its text, and the check of a report read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import canonical, records
from siltstone.plans.deal import tasks
from siltstone.rules.findings import CONFIDENCES, SEVERITIES, SOURCES, TYPES

# Names, closed sets and limits of the report format.
VERSION = "1.0.0"
CATEGORY_OTHER = "Other"
SYNTHESIS = ("not_applicable", "skipped_unconfirmed", "ran")
GROUPS = ("standalone", "synthesized")
ERROR_CLASSES = (
    "invalid_arguments", "input_not_found", "input_too_large", "parse_failure", "tool_unavailable", "tool_version", "tool_execution", "tool_timeout", "path_violation", "no_reviewable_template",
    "schema_violation", "unexpected",
)
MOST_FINDINGS = 10_000

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STEPS = T.ArrayType(_struct(json=_S))
EVIDENCE = T.ArrayType(_struct(Source=_S, Detail=_S, RuleId=_S, Excerpt=_S))
#: A finding without its ID, an error, a tool.
FINDING = _struct(
    Normalized_Category=_S, FindingType=_S, Severity=_S, Confidence=_S, Source=T.ArrayType(_S), Resource=_S, Location=_struct(File=_S, Line=_L, Column=_L, TemplatePath=STEPS), Finding=_S, WhyItMatters=_S, Evidence=EVIDENCE,
    Recommendation=_S, SuggestedRemediation=_S,
)
ERROR = _struct(error_class=_S, source=_S, tool=_S, exit_code=_L, message=_S, required_min_version=_S, detected_version=_S, remediation=_S, stderr_head=T.ArrayType(_S))
TOOL = _struct(name=_S, available=T.BooleanType(), version=_S)
NUMBERED = T.StructType([T.StructField("ID", _L), *FINDING.fields])
FIELDS = FINDING.names


def template_path(steps: Column) -> Column:
    """Steps of a place as report values: texts of digits alone are numbers, but for the second, which names a member of a section."""
    return F.transform(steps, lambda s, i: F.struct(F.when((i != 1) & s.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(s, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(canonical.quoted(s)).alias("json")))


def violations(blocking: tuple[str, ...] = (), categories: tuple[str, ...] | None = None) -> Column:
    """The fields of a finding (columns of FINDING and ID) that break its schema, in the order in which they are checked.

    After the fields: Confirmed findings have no part of an agent (Confidence), others quote what they read (Evidence), a
    critical one of validity names a rule that blocks deployment (Severity; any rule where `blocking` is empty), and category
    Other has one source (Normalized_Category). Categories are of a closed set if it is given.
    """
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    emptied = lambda x: x.isNotNull() & (F.trim(x) == "")
    rank = lambda x: F.array_position(F.array(*map(F.lit, SOURCES)), x)
    source, place, evidence = c("Source"), c("Location"), c("Evidence")
    indexed = lambda array, bad, name: F.transform(F.filter(F.transform(array, lambda x, i: F.struct(bad(x).alias("bad"), i.alias("i"))), lambda x: F.coalesce(x["bad"], F.lit(True))), lambda x: F.format_string(name, x["i"]))
    none = F.array().cast("array<string>")
    one = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(name))).otherwise(none)
    file = place["File"]
    known = c("Normalized_Category").isin(*categories) if categories else F.lit(True)
    rules = F.filter(F.transform(evidence, lambda e: e["RuleId"]), lambda r: r.isNotNull() & (r != ""))
    blocks = F.exists(rules, lambda r: r.isin(*blocking)) if blocking else F.size(rules) > 0
    unknown_sources = indexed(source, lambda s: ~s.isin(*SOURCES), "Source[%d]")
    parts = [
        one(c("ID") < 1, "ID"),
        one(blank(c("Normalized_Category")) | ~known, "Normalized_Category"),
        *[one(~c(name).isin(*allowed), name) for name, allowed in (("FindingType", TYPES), ("Severity", SEVERITIES), ("Confidence", CONFIDENCES))],
        F.when(F.coalesce(F.size(source), F.lit(0)) <= 0, F.array(F.lit("Source"))).when(F.size(unknown_sources) > 0, unknown_sources).otherwise(one((F.size(F.array_distinct(source)) < F.size(source)) | (F.array_sort(F.transform(source, rank)) != F.transform(source, rank)), "Source")),
        one(emptied(c("Resource")), "Resource"),
        one(blank(file) | file.rlike(r"^(?:[/\\]|[A-Za-z]:[\\/])"), "Location.File"),
        one(place["Line"].isNotNull() & (place["Line"] < 1), "Location.Line"),
        one(place["Column"].isNotNull() & (place["Column"] < 1), "Location.Column"),
        *[one(blank(c(name)), name) for name in ("Finding", "WhyItMatters")],
        F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, F.array(F.lit("Evidence"))).otherwise(F.concat(
            indexed(evidence, lambda e: ~e["Source"].isin(*SOURCES), "Evidence[%d].Source"), indexed(evidence, lambda e: blank(e["Detail"]), "Evidence[%d].Detail"),
            indexed(evidence, lambda e: emptied(e["RuleId"]), "Evidence[%d].RuleId"), indexed(evidence, lambda e: emptied(e["Excerpt"]), "Evidence[%d].Excerpt"),
        )),
        one(blank(c("Recommendation")), "Recommendation"),
        one(emptied(c("SuggestedRemediation")), "SuggestedRemediation"),
        one((c("Confidence") == "Confirmed") & F.coalesce(F.array_contains(source, "Agent Review"), F.lit(False)), "Confidence"),
        one((c("Confidence") != "Confirmed") & ~F.coalesce(F.exists(evidence, lambda e: F.coalesce(e["Excerpt"] != "", F.lit(False))), F.lit(False)), "Evidence"),
        one((c("FindingType") == "Validity") & (c("Severity") == "CRITICAL") & ~F.coalesce(blocks, F.lit(False)), "Severity"),
        one((c("Normalized_Category") == CATEGORY_OTHER) & (F.size(source) > 1), "Normalized_Category"),
    ]
    return F.concat(*parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings (report_id and columns of FINDING) with ID 1..n in each report, files as reports tell them.

    The order is by severity, worst first, then resource (none first), category and wording; last comes the canonical text of
    all the rest, so that it is total: rows that tie there are equal.
    """
    place = F.col("Location")
    told = records.output_path(place["File"])["path"]
    rows = findings.withColumn("Location", place.withField("File", F.coalesce(told, place["File"])))
    content = canonical.text(F.struct(*FIELDS), FINDING)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("Severity"))
    within = Window.partitionBy("report_id").orderBy(F.desc(rank), F.coalesce("Resource", F.lit("")), "Normalized_Category", "Finding", content)
    return rows.withColumn("ID", F.row_number().over(within).cast("bigint"))


def merged(findings: DataFrame) -> DataFrame:
    """One finding (report_id and FINDING) a report, file, resource and category; those without resource or of category Other stay.

    Members of a group are ordered by their first source, wording and canonical text. The first one's words stand for all, with the
    place of the first that knows its line and the first remedy; type and severity are the largest, confidence too, but at most
    Likely where an agent had a part; sources are told once, evidence in their order. A finding alone stays as it is. All
    of it is aggregated in parts before it moves, and the result is the same in any order of rows.
    """
    ranks = lambda names, value: F.array_position(F.array(*map(F.lit, names)), value)
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int"))
    source = lambda value: ranks(SOURCES, value)
    eligible = F.col("Resource").isNotNull() & (F.col("Normalized_Category") != CATEGORY_OTHER)
    order = F.struct(source(F.get("Source", F.lit(0))).alias("s"), F.col("Finding").alias("f"), canonical.text(F.struct(*FIELDS), FINDING).alias("c"))
    rows = findings.where(eligible).withColumn("order", order).withColumn("said", F.transform("Evidence", lambda e, i: F.struct(source(e["Source"]).alias("s"), F.col("order").alias("o"), i.alias("i"), e.alias("e"))))
    first = lambda value: F.min_by(value, "order")
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("Source", source)))))
    agent = F.array_contains(sources, len(SOURCES)) & (F.count("*") > 1)
    sure = F.max(ranks(CONFIDENCES, F.col("Confidence")))
    groups = rows.groupBy("report_id", F.col("Location.File").alias("file"), "Resource", "Normalized_Category").agg(
        name(TYPES, F.max(ranks(TYPES, F.col("FindingType")))).alias("FindingType"), name(SEVERITIES, F.max(ranks(SEVERITIES, F.col("Severity")))).alias("Severity"), name(CONFIDENCES, F.when(agent, F.least(sure, F.lit(2))).otherwise(sure)).alias("Confidence"),
        F.transform(sources, lambda i: name(SOURCES, i)).alias("Source"), F.min_by("Location", F.struct(F.col("Location.Line").isNull().alias("n"), "order")).alias("Location"), *[first(c).alias(c) for c in ("Finding", "WhyItMatters", "Recommendation")],
        F.transform(F.array_sort(F.flatten(F.collect_list("said"))), lambda x: x["e"]).alias("Evidence"), F.min_by("SuggestedRemediation", F.struct(F.col("SuggestedRemediation").isNull().alias("n"), "order")).alias("SuggestedRemediation"),
    )
    return groups.select("report_id", *FIELDS).unionByName(findings.where(F.coalesce(~eligible, F.lit(True))).select("report_id", *FIELDS))


#: Findings that a task orders and gathers.
TASK_FINDINGS = 20_000


def _paths(paths: Column) -> Column:
    """Distinct paths as reports tell them, in order; null where one is refused."""
    told = F.transform(paths, lambda p: records.output_path(p)["path"])
    return F.when(~F.exists(told, lambda p: p.isNull()), F.array_sort(F.array_distinct(told)))


def built(meta: DataFrame, findings: DataFrame, errors: DataFrame, tools: DataFrame, blocking: tuple[str, ...] = (), categories: tuple[str, ...] | None = None) -> DataFrame:
    """(report_id, refused, report): each report of meta as its whole record, or the first field for which it is refused.

    meta: report_id, files, sources_enabled, cdk_detected, cdk_synthesis, synthesized; findings: report_id and FINDING; errors:
    report_id, seq and ERROR; tools: report_id, name, available, version. Files and sources are told once, in order; tools by
    name, of which none is listed twice; errors as they came. Reports of more than MOST_FINDINGS findings are refused before any
    of them is gathered, so no row grows without bound. A report without findings passes; of an unknown one nothing is read.
    """
    count = findings.groupBy("report_id").agg(F.count("*").alias("n"))
    n_tasks = tasks(findings, TASK_FINDINGS)
    kept = ordered(findings.repartition(n_tasks, "report_id").join(count.where(F.col("n") <= MOST_FINDINGS).select("report_id"), "report_id", "left_semi"))
    bad = violations(blocking, categories)
    each = kept.select("report_id", F.struct("ID", *FIELDS).alias("finding"), F.get(bad, F.lit(0)).alias("bad"))
    lists = each.groupBy("report_id").agg(F.array_sort(F.collect_list("finding")).alias("findings"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("finding.ID"))).alias("bad"))
    failed = errors.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*ERROR.names).alias("error")))), lambda x: x["error"]).alias("errors"))
    listed = tools.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("name", "available", "version"))).alias("tools"))
    narrow = meta.join(count, "report_id", "left").join(failed, "report_id", "left").join(listed, "report_id", "left")
    all_ = narrow.repartition(n_tasks, "report_id").join(lists, "report_id", "left")  # gathered findings stay where they are
    empty = lambda name, kind: F.coalesce(name, F.array().cast(T.ArrayType(kind))).alias(name)
    all_ = all_.select(
        "report_id", "n", "bad", _paths(F.col("files")).alias("files"), _paths(F.col("synthesized")).alias("synthesized"), "sources_enabled", "cdk_detected", "cdk_synthesis",
        empty("findings", NUMBERED), empty("errors", ERROR), empty("tools", TOOL),
    )
    rows = F.col("findings")
    having = lambda name, test: F.size(F.filter(rows, lambda x: test(x, name))).cast("bigint")
    counted = lambda names, test: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[having(n, test) for n in names]))
    made = lambda x: F.array_contains(F.col("synthesized"), x["Location"]["File"])
    summary = F.struct(
        F.size(rows).cast("bigint").alias("total"),
        counted(TYPES, lambda x, n: x["FindingType"] == n).alias("by_finding_type"),
        counted(SEVERITIES, lambda x, n: x["Severity"] == n).alias("by_severity"),
        counted(SOURCES, lambda x, n: F.array_contains(x["Source"], n)).alias("by_source"),
        counted(GROUPS, lambda x, n: made(x) if n == GROUPS[1] else ~made(x)).alias("by_template_group"),
        (F.size(rows) == 0).alias("passed_all_checks"),
    )
    unknown = F.filter("sources_enabled", lambda s: F.coalesce(~s.isin(*SOURCES), F.lit(True)))
    sources = F.filter(F.array(*map(F.lit, SOURCES)), lambda s: F.array_contains("sources_enabled", s))
    names = F.transform("tools", lambda t: t["name"])
    refused = (
        F.when(F.col("n") > MOST_FINDINGS, "findings").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("files").isNull(), "target.files").when(F.col("synthesized").isNull(), "target.cdk.synthesized_templates")
        .when(~F.coalesce(F.col("cdk_synthesis").isin(*SYNTHESIS), F.lit(False)), "target.cdk.synthesis").when(F.size(unknown) > 0, "sources_enabled").when(F.size(F.array_distinct(names)) < F.size(names), "tools")
    )
    cdk = F.struct(F.coalesce("cdk_detected", F.lit(False)).alias("detected"), F.col("cdk_synthesis").alias("synthesis"), F.col("synthesized").alias("synthesized_templates"))
    report = F.struct(F.lit(VERSION).alias("schema_version"), F.struct("files", cdk.alias("cdk")).alias("target"), sources.alias("sources_enabled"), "tools", "findings", "errors", summary.alias("summary"))
    return all_.select("report_id", refused.alias("refused"), F.when(refused.isNull(), report).alias("report"))


def dumped(reports: DataFrame) -> DataFrame:
    """reports with their text: keys sorted, two blanks an indent, a new line at the end; null for a refused one."""
    whole = F.concat(canonical.of(reports, "report", indent=2), F.lit("\n"))
    return reports.withColumn("text", F.when(F.col("report").isNotNull(), whole))


#: Bytes of a report's text at most.
MOST_BYTES = 128 << 20
TOO_LONG = "output_size_limit_exceeded"


def within(reports: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(report_id, state, text): dumped() reports of at most `most` bytes as they are (whole); of a longer one what it is about, its tools,
    errors and counts, with one more error and no findings (minimal).

    Whether a report is longer is told from its parts' lengths where that suffices, so that it is never rendered; only reports near
    the bound are rendered and then measured. Refused reports have no text and are refused.
    """
    kind = reports.schema["report"].dataType
    rows = reports.withColumn("near", canonical.least_bytes(F.col("report"), kind) < most)
    near = dumped(rows.where("near and report is not null")).withColumn("fits", F.octet_length("text") <= most)
    far = rows.where("not near and report is not null").withColumns({"text": F.lit(None).cast("string"), "fits": F.lit(False)})
    tried = near.unionByName(far)
    values = {"error_class": F.lit(TOO_LONG), "message": F.lit(f"the report is longer than {most} bytes"), "stderr_head": F.array().cast("array<string>")}
    error = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ERROR.fields])
    less = F.col("report").withField("findings", F.array().cast(kind["findings"].dataType)).withField("errors", F.array_append("report.errors", error))
    long = dumped(tried.where("not fits").select("report_id", "refused", less.alias("report")))
    out = tried.where("fits").select("report_id", F.lit("whole").alias("state"), "text").unionByName(long.select("report_id", F.lit("minimal").alias("state"), "text"))
    return out.unionByName(rows.where("report is null").select("report_id", F.lit("refused").alias("state"), F.lit(None).cast("string").alias("text")))


def exit_status(reviews: DataFrame, failures: DataFrame) -> DataFrame:
    """(review_id, exit_status): 0 if any template was reviewed and any source succeeded, else the first failure's code.

    reviews: review_id, reviewed, succeeded; failures: review_id, seq, code. Codes of 0 are no failures; a review without
    any ends with 0.
    """
    first = failures.where(F.col("code") != 0).groupBy("review_id").agg(F.min_by("code", "seq").alias("code"))
    done = F.coalesce(F.col("reviewed") & F.col("succeeded"), F.lit(False))
    return reviews.join(first, "review_id", "left").select("review_id", F.when(done, 0).otherwise(F.coalesce("code", F.lit(0))).cast("int").alias("exit_status"))


def checked(read: DataFrame) -> DataFrame:
    """(report_id, sha256, failure, line, column, field, integrity) of reports as siltstone.sources.reports.read() gives them.

    A report that can be read is built again from its parts. integrity lists rebuild_mismatch where the text of what was
    built differs from the text of what was read, and dedup_invariant_violated where two findings that should have been
    merged (of one file, resource and category, neither without resource nor of category Other) stand beside each other.
    """
    good = read.where("failure is null").select("report_id", "dumped", "body")
    body = lambda name: F.col(f"body.{name}")
    cdk = body("target.cdk")
    meta = good.select("report_id", body("target.files").alias("files"), "body.sources_enabled", cdk["detected"].alias("cdk_detected"), cdk["synthesis"].alias("cdk_synthesis"), cdk["synthesized_templates"].alias("synthesized"))
    findings = good.select("report_id", F.explode(body("findings")).alias("f")).select("report_id", "f.*")
    errors = good.select("report_id", F.posexplode(body("errors")).alias("seq", "e")).select("report_id", "seq", "e.*")
    tools = good.select("report_id", F.explode(body("tools")).alias("t")).select("report_id", "t.*")
    again = dumped(built(meta, findings.drop("ID"), errors, tools)).select("report_id", "text", "refused")
    apart = findings.where(F.col("Resource").isNotNull() & (F.col("Normalized_Category") != CATEGORY_OTHER)).groupBy("report_id", F.col("Location.File").alias("file"), "Resource", "Normalized_Category").count()
    apart = apart.where("count > 1").select("report_id", F.lit(True).alias("apart")).distinct()
    own = violations()
    values = findings.select("report_id", own.alias("bad"), "ID").where(F.size("bad") > 0)
    values = values.groupBy("report_id").agg(F.min(F.struct("ID", F.get("bad", F.lit(0)).alias("bad")))["bad"].alias("bad"))
    found = read.join(again, "report_id", "left").join(apart, "report_id", "left").join(values, "report_id", "left")
    wrong = F.col("failure").isNull() & F.col("bad").isNotNull()
    read_well = F.col("failure").isNull() & F.col("bad").isNull()
    integrity = F.array_compact(F.array(F.when(~F.col("text").eqNullSafe(F.col("dumped")), "rebuild_mismatch"), F.when(F.col("apart"), "dedup_invariant_violated")))
    return found.select(
        "report_id", "sha256", F.when(wrong, "schema_violation").otherwise(F.col("failure")).alias("failure"), "line", "column", F.when(wrong, F.concat(F.lit("findings."), "bad")).otherwise(F.col("field")).alias("field"),
        F.when(read_well, F.array_join(integrity, ",")).alias("integrity"),
    )
