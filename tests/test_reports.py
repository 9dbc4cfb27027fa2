"""Canonical texts, strict reading, validation and merging of whole reports against plain Python."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import report_queries
from siltstone.operators import canonical
from siltstone.rules import reports
from siltstone.sources.reports import misshapen, read

WORDS = ["", "a", 'q"\\', "\n\t\r\b\f", "\x00\x01\x1f", "é中𝄞\x7f\u2028", "</x>", " blank "]
KIND = T.StructType().add("b", T.ArrayType(T.MapType(T.StringType(), T.LongType()))).add("a", T.StructType().add("y", T.StringType()).add("x", T.BooleanType()).add("_", T.ArrayType(T.StringType())))
KIND = KIND.add("Z", T.MapType(T.StringType(), T.StringType())).add("n", T.DecimalType(38, 0)).add("e", T.StructType())


def some(kind, rng):
    if rng.random() < 0.15:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: some(f.dataType, rng) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [some(kind.elementType, rng) for _ in range(rng.randint(0, 3))]
    if isinstance(kind, T.MapType):
        return {rng.choice(WORDS): some(kind.valueType, rng) for _ in range(rng.randint(0, 3))}
    return rng.choice(WORDS) if isinstance(kind, T.StringType) else rng.random() < 0.5 if isinstance(kind, T.BooleanType) else rng.randint(-(2**63), 2**63 - 1)


@pytest.mark.parametrize(("indent", "ascii_only"), [(None, False), (2, False), (None, True), (3, True)])
def test_texts_equal_those_of_the_library(spark, indent, ascii_only):
    rng = random.Random(4)
    rows = [some(KIND, rng) for _ in range(300)]
    held = [(i, r and r | {"n": None if r["n"] is None else Decimal(r["n"])}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(held, T.StructType().add("i", T.IntegerType()).add("v", KIND))
    got = {r.i: r.t for r in df.select("i", canonical.of(df, "v", indent, ascii_only).alias("t")).collect()}
    separators = (",", ":") if indent is None else (",", ": ")
    assert got == {i: json.dumps(r, sort_keys=True, ensure_ascii=ascii_only, indent=indent, separators=separators) for i, r in enumerate(rows)}


def test_fractions_have_no_text(spark):
    for kind in ("double", "float", "decimal(5,2)", "date"):
        df = spark.sql(f"SELECT CAST(NULL AS {kind}) AS v")
        with pytest.raises(ValueError, match="canonical"):
            canonical.of(df, "v")


def test_what_is_unfit_as_evidence(spark):
    df = spark.sql("SELECT named_struct('a', array('x', '~/y', 'C:\\\\z'), 'm', map('pid', '1', 'k', 'file:///x'), 'f', 1.5D, 'hostname', 'h') AS v")
    got = df.select(canonical.unfit(F.col("v"), df.schema["v"].dataType).alias("u")).first().u
    assert sorted(got) == [".a[]: path of a machine", ".f: fraction", ".hostname: key of a run", ".m.*: path of a machine", ".m.pid: key of a run"]


def finding(**more):
    return {
        "ID": 1, "Normalized_Category": "Logging", "FindingType": "Security", "Severity": "HIGH", "Confidence": "Likely", "Source": ["cfn-lint"], "Resource": "R", "Location": {"File": "a.yaml", "Line": 3, "Column": None, "TemplatePath": ["Resources", "1", 0]},
        "Finding": "f", "WhyItMatters": "w", "Evidence": [{"Source": "cfn-lint", "Detail": "d", "RuleId": "W1", "Excerpt": "x"}], "Recommendation": "r", "SuggestedRemediation": None,
    } | more


def report(findings=(), **more):
    count = lambda names, test: {n: sum(test(f, n) for f in findings) for n in names}
    return {
        "schema_version": "1.0.0", "target": {"files": ["a.yaml"], "cdk": {"detected": False, "synthesis": "not_applicable", "synthesized_templates": []}}, "sources_enabled": ["cfn-lint"], "tools": [{"name": "cfn-lint", "available": True, "version": "1"}],
        "findings": list(findings), "errors": [],
        "summary": {"total": len(findings), "passed_all_checks": not findings, "by_finding_type": count(reports.TYPES, lambda f, n: f["FindingType"] == n), "by_severity": count(reports.SEVERITIES, lambda f, n: f["Severity"] == n),
                    "by_source": count(reports.SOURCES, lambda f, n: n in f["Source"]), "by_template_group": {"standalone": len(findings), "synthesized": 0}},
    } | more


def text(value):
    return (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode()


def checked(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "report_id int, raw binary")
    return {r.report_id: r for r in reports.checked(read(df)).collect()}


def test_good_and_spoilt_reports(spark):
    two = [finding(), finding(ID=2, Severity="LOW", Resource="S")]
    spaced = json.dumps(report(two)).encode()
    cases = [
        (text(report()), None, None, ""), (text(report(two)), None, None, ""), (spaced, None, None, ""), (b"", "parse_failure", None, None), (None, "parse_failure", None, None), (b"[]", "schema_violation", "", None), (b'{"a": 1, "a": 1}', "duplicate_key", None, None),
        (b'{"a": 1e999}', "parse_failure", None, None), (b'{"a": -Infinity}', "parse_failure", None, None), (b"[" * 100_000, "parse_failure", None, None), (b"\xff", "parse_failure", None, None), (b'{"a":\n x}', "parse_failure", None, None),
        (text(report(schema_version="2.0.0")), "schema_violation", "schema_version", None), (text(report(extra=1)), "schema_violation", "", None), (text(report([finding(Location={"File": "a"})])), "schema_violation", "findings[0].Location.Line", None),
        (text(report([finding(ID=True)])), "schema_violation", "findings[0].ID", None), (text(report([finding(Severity="BAD")])), "schema_violation", "findings.Severity", None), (text(report(two[::-1])), None, None, "rebuild_mismatch"),
        (text(report([finding(), finding(ID=2, Finding="g")])), None, None, "dedup_invariant_violated"), (text(report([finding(Location={"File": "./a.yaml", "Line": None, "Column": None, "TemplatePath": None})])), None, None, "rebuild_mismatch"),
        (text(report(tools=report()["tools"] * 2)), None, None, "rebuild_mismatch"), (text(report(sources_enabled=["Other"])), None, None, "rebuild_mismatch"),
    ]
    got = checked(spark, [c[0] for c in cases])
    for i, (raw, failure, field, integrity) in enumerate(cases):
        assert (got[i].failure, got[i].field, got[i].integrity) == (failure, field, integrity), raw
    assert (got[11].line, got[11].column) == (2, 2)
    assert read(spark.createDataFrame([], "report_id int, raw binary")).count() == 0


def test_shapes():
    assert misshapen({"a": [1, "x"]}, {"a": ["whole"]}) == "a[1]"
    assert misshapen({"a": [], "b": 1}, {"a": ["whole"]}) == ""
    assert misshapen({}, {"a": "text?"}) == "a"


def test_violations_field_by_field(spark):
    entry = finding()["Evidence"][0]
    cases = [
        ({}, []), ({"ID": 0}, ["ID"]), ({"Normalized_Category": " "}, ["Normalized_Category"]), ({"FindingType": "x"}, ["FindingType"]), ({"Severity": None}, ["Severity"]), ({"Confidence": "x"}, ["Confidence"]), ({"Source": []}, ["Source"]),
        ({"Source": ["cfn-lint", "x"]}, ["Source[1]"]), ({"Source": ["cfn-guard", "cfn-lint"]}, ["Source"]), ({"Source": ["cfn-lint"] * 2}, ["Source"]), ({"Resource": ""}, ["Resource"]), ({"Resource": None}, []),
        ({"Location": {"File": "\\x", "Line": 0, "Column": -1, "TemplatePath": None}}, ["Location.File", "Location.Line", "Location.Column"]), ({"Finding": None, "WhyItMatters": "", "Recommendation": " "}, ["Finding", "WhyItMatters", "Recommendation"]),
        ({"SuggestedRemediation": " "}, ["SuggestedRemediation"]), ({"Evidence": []}, ["Evidence", "Evidence"]), ({"Evidence": [entry, entry | {"Source": "x", "Detail": None, "RuleId": "", "Excerpt": ""}]}, ["Evidence[1].Source", "Evidence[1].Detail", "Evidence[1].RuleId", "Evidence[1].Excerpt"]),
        ({"Confidence": "Confirmed", "Source": ["cfn-lint", "Agent Review"]}, ["Confidence"]), ({"Evidence": [entry | {"Excerpt": None}]}, ["Evidence"]), ({"Evidence": [entry | {"Excerpt": None}], "Confidence": "Confirmed"}, []),
        ({"FindingType": "Validity", "Severity": "CRITICAL"}, []), ({"FindingType": "Validity", "Severity": "CRITICAL", "Evidence": [entry | {"RuleId": None}]}, ["Severity"]), ({"Normalized_Category": "Other", "Source": ["cfn-lint", "cfn-guard"]}, ["Normalized_Category"]),
    ]
    rows = []
    for i, (more, _) in enumerate(cases):
        f = finding(**more)
        place = f["Location"] | {"TemplatePath": None}
        rows.append((i, f | {"Location": place}))
    df = spark.createDataFrame(rows, T.StructType().add("i", T.IntegerType()).add("f", reports.NUMBERED)).select("i", "f.*")
    got = {r.i: r.v for r in df.select("i", reports.violations().alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [bad for _, bad in cases]
    only = df.where("i = 20").select(reports.violations(blocking=("E3012",), categories=("Access",)).alias("v")).first().v
    assert only == ["Normalized_Category", "Severity"]


def test_digits_of_a_place_are_numbers_but_for_the_second(spark):
    df = spark.createDataFrame([(["1", "1", "007", "x", '"'],)], "steps array<string>")
    assert [x.json for x in df.select(reports.template_path(F.col("steps")).alias("p")).first().p] == ["1", '"1"', "7", '"x"', '"\\""']


def test_merging_is_the_same_in_any_order(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        source = rng.choice([["cfn-lint"], ["cfn-guard"], ["Agent Review"], ["IAM Review", "Agent Review"]])
        f = finding(Source=source, Resource=rng.choice(["A", "B", None]), Normalized_Category=rng.choice(["Logging", "Other", "Access"]), Severity=rng.choice(reports.SEVERITIES), Confidence=rng.choice(["Likely", "Contextual"] if "Agent Review" in source else ["Confirmed"]))
        f |= {"Finding": rng.choice("xyz"), "WhyItMatters": str(i), "Location": {"File": "a", "Line": rng.choice([None, i + 1]), "Column": None, "TemplatePath": None}, "Evidence": [{"Source": s, "Detail": f"{i}{s}", "RuleId": None, "Excerpt": "e"} for s in source], "SuggestedRemediation": rng.choice([None, str(i)])}
        f.pop("ID")
        rows.append((1, f))
    schema = T.StructType().add("report_id", T.IntegerType()).add("f", reports.FINDING)

    def merged(part):
        return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in reports.merged(spark.createDataFrame(part, schema).select("report_id", "f.*")).collect())

    got = merged(rows)
    rng.shuffle(rows)
    assert merged(rows) == got
    plain = [json.loads(x) for x in got]
    for key in {(f["Resource"], f["Normalized_Category"]) for _, f in rows}:
        group = [f for _, f in rows if (f["Resource"], f["Normalized_Category"]) == key]
        mine = [f for f in plain if (f["Resource"], f["Normalized_Category"]) == key]
        if key[0] is None or key[1] == "Other":
            assert len(mine) == len(group)
            continue
        (one,) = mine
        ordered = sorted(group, key=lambda f: (reports.SOURCES.index(f["Source"][0]), f["Finding"], json.dumps(f, sort_keys=True, separators=(",", ":"))))
        assert (one["Finding"], one["WhyItMatters"]) == (ordered[0]["Finding"], ordered[0]["WhyItMatters"])
        assert one["Location"]["Line"] == next((f["Location"]["Line"] for f in ordered if f["Location"]["Line"]), None)
        assert one["SuggestedRemediation"] == next((f["SuggestedRemediation"] for f in ordered if f["SuggestedRemediation"]), None)
        assert [e["Detail"] for e in one["Evidence"]] == [e["Detail"] for e in sorted((e for f in ordered for e in f["Evidence"]), key=lambda e: reports.SOURCES.index(e["Source"]))]
        agent = len(group) > 1 and any("Agent Review" in f["Source"] for f in group)
        rank = max(reports.CONFIDENCES.index(f["Confidence"]) for f in group)
        assert one["Confidence"] == reports.CONFIDENCES[min(rank, 1) if agent else rank]


def test_exit_status(spark):
    reviews = spark.createDataFrame([(1, True, True), (2, True, False), (3, None, True), (4, False, False)], "review_id int, reviewed boolean, succeeded boolean")
    failures = spark.createDataFrame([(1, 0, 4), (2, 2, 6), (2, 0, 0), (2, 1, 5), (3, 0, 8)], "review_id int, seq int, code int")
    assert {r.review_id: r.exit_status for r in reports.exit_status(reviews, failures).collect()} == {1: 0, 2: 5, 3: 8, 4: 0}


def test_least_bytes_bound_the_text(spark):
    rng = random.Random(8)
    rows = [some(KIND, rng) for _ in range(60)]
    held = [(i, r and r | {"n": None if r["n"] is None else Decimal(r["n"])}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(held, T.StructType().add("i", T.IntegerType()).add("v", KIND))
    got = df.select("v", canonical.least_bytes(F.col("v"), KIND).alias("least"), F.octet_length(canonical.of(df, "v")).alias("real")).collect()
    escaped = ('"\\', "\\", "\n", "\x00", '"')
    for r in got:
        assert r.least <= r.real
        if not any(c in str(r.v) for c in ("\\", "\x00")) and not any(e in str(r.v) for e in escaped):
            assert r.least == r.real


def test_reports_within_a_bound(spark):
    meta = spark.createDataFrame([(1, ["a"], ["cfn-lint"], False, "ran", []), (2, ["a"], ["cfn-lint"], False, "ran", []), (3, ["/a"], ["cfn-lint"], False, "ran", [])], "report_id int, files array<string>, sources_enabled array<string>, cdk_detected boolean, cdk_synthesis string, synthesized array<string>")
    rows = []
    for i in range(9):
        f = finding(Resource=f"R{i}")
        f.pop("ID")
        f["Location"] = f["Location"] | {"TemplatePath": None}
        rows.append((1 if i < 8 else 2, f))
    findings = spark.createDataFrame(rows, T.StructType().add("report_id", T.IntegerType()).add("f", reports.FINDING)).select("report_id", "f.*")
    errors = spark.createDataFrame([], T.StructType([T.StructField("report_id", T.IntegerType()), T.StructField("seq", T.IntegerType()), *reports.ERROR.fields]))
    tools = spark.createDataFrame([], T.StructType([T.StructField("report_id", T.IntegerType()), *reports.TOOL.fields]))
    made = reports.built(meta, findings, errors, tools)
    whole = {r.report_id: r.text for r in reports.dumped(made).collect()}
    for most, states in ((len(whole[1]) - 1, ["minimal", "whole", "refused"]), (10, ["minimal", "minimal", "refused"])):
        got = reports.within(made, most).orderBy("report_id").collect()
        assert [r.state for r in got] == states
        for r in got:
            if r.state == "whole":
                assert r.text == whole[r.report_id]
            elif r.state == "minimal":
                body = json.loads(r.text)
                assert body["findings"] == []
                assert body["errors"][-1]["error_class"] == reports.TOO_LONG
                assert body["summary"] == json.loads(whole[r.report_id])["summary"]


def test_reports_are_built_by_as_many_tasks_as_findings_need(spark, monkeypatch):
    monkeypatch.setattr(reports, "TASK_FINDINGS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    try:
        made = report_queries.built_of_orders(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert made.rdd.getNumPartitions() == 15  # 1,500 orders


def test_gathered_findings_stay_where_they_were_dealt_though_shuffles_have_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(reports, "TASK_FINDINGS", 100)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = report_queries.built_of_orders(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made.rdd.getNumPartitions() == 15  # 1,500 orders
