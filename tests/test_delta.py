"""Laws of the comparison of two reports."""

from pyspark.sql import functions as F

from siltstone.operators import delta

FINDINGS = "template_id string, resource string, category string, source string, finding string"
TOOLS = "side string, source string, available boolean, version string, enabled boolean, failed boolean"
ROWS = [("t", "A", "IAM", "s", "x"), ("t", "B", "IAM", "s", "y"), ("t", None, "IAM", "s", "z"), ("t", "C", "Other", "s", "q"), ("t", "C", "Other", "s", "q")]


def tools(spark, **head):
    row = {"available": True, "version": "1", "enabled": True, "failed": False}
    return spark.createDataFrame([(side, "s", *(row | (head if side == "head" else {})).values()) for side in ("base", "head")], TOOLS)


def test_a_report_against_itself_has_nothing_new(spark):
    df = spark.createDataFrame(ROWS, FINDINGS)
    got = delta.entries(df, df, tools(spark)).collect()
    assert not {r.classification for r in got} & {"New", "Resolved"}


def test_new_resolved_and_swapped(spark):
    base, head = spark.createDataFrame(ROWS[:2], FINDINGS), spark.createDataFrame([ROWS[0], ROWS[2]], FINDINGS)
    kinds = lambda a, b, t, d=None: sorted((r.finding, r.classification) for r in delta.entries(a, b, t, d).collect())
    assert kinds(base, head, tools(spark)) == [("x", "Unchanged"), ("y", "Resolved"), ("z", "New")]
    assert kinds(head, base, tools(spark)) == [("x", "Unchanged"), ("y", "New"), ("z", "Resolved")]
    assert kinds(base, head, tools(spark), F.lit(False)) == [("x", "Unchanged"), ("y", "Unconfirmed"), ("z", "Unconfirmed")]


def test_an_unavailable_tool_never_makes_new_or_resolved(spark):
    base, head = spark.createDataFrame(ROWS, FINDINGS), spark.createDataFrame(ROWS[:1], FINDINGS)
    for t in (tools(spark, available=False), tools(spark, version="2"), tools(spark, failed=True), tools(spark).limit(0)):
        got = delta.entries(base, head, t).collect()
        assert not {r.classification for r in got} & {"New", "Resolved"}
        assert all(r.reasons for r in got if r.classification == "Ambiguous")


def test_entries_compare_findings_themselves_and_ask_for_each_reason_once(spark):
    rows = spark.createDataFrame([("t", "r", "IAM", "S", "x")], "template_id string, resource string, category string, source string, finding string")
    tools = spark.createDataFrame([("base", "S", True, "1", True, False)], "side string, source string, available boolean, version string, enabled boolean, failed boolean")
    found = delta.entries(rows, rows.where("false"), tools)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "array_contains(why" not in plan and plan.count("identity_undetermined") <= 3
    assert [(r.classification, r.reasons) for r in found.collect()] == [("Ambiguous", ["source_not_comparable"])]
