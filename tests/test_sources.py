"""Tool output, agents' findings, evidence and streams."""

import hashlib
import json

from pyspark.sql import functions as F

from siltstone.operators import evidence
from siltstone.sources import listing, templates, tool_output
from siltstone.streaming import reviews



def test_lint_output_is_classified(spark):
    record = lambda rule, level, path: {"Rule": {"Id": rule, "ShortDescription": "s"}, "Level": level, "Message": "m", "Filename": "f", "Location": {"Start": {"LineNumber": 3, "ColumnNumber": 1}, "Path": path}}
    out = json.dumps([record("E3002", "Error", ["Resources", "B", "Properties"]), record("W3005", "Warning", ["Parameters", "P"]), record("X1", "Odd", None)])
    runs = spark.createDataFrame([("t", 4 + 2, out), ("u", 1, out), ("v", 0, "[]"), ("w", 2, None)], "template_id string, exit_code int, stdout string")
    rows = tool_output.lint_findings(runs)
    levels = spark.createDataFrame([("Error", "HIGH", "Validity"), ("Warning", "MEDIUM", "BestPractice"), ("Informational", "INFO", "Informational")], "level string, severity string, type string")
    prefixes = spark.createDataFrame([("E", "Validity", False, False), ("E3", "Structure", False, True), ("W", "Style", True, False)], "prefix string, category string, security boolean, blocking boolean")
    overrides = spark.createDataFrame([("W3005", "Special", None, None)], "rule_id string, category string, severity string, type string")
    got = {r.rule_id: (r.template_id, r.resource, r.category, r.type, r.severity) for r in tool_output.classified(rows, levels, prefixes, overrides).collect()}
    assert got == {"E3002": ("t", "B", "Structure", "Validity", "CRITICAL"), "W3005": ("t", None, "Special", "Security", "MEDIUM"), "X1": ("t", None, "Other", "Informational", "INFO")}


def test_guard_output(spark):
    fail = {"name": "f", "not_compliant": [{"Rule": {"name": "r1", "checks": [{"Clause": {"Unary": {"check": {"UnResolved": {"value": {"path": "/Resources/B/Properties"}}}, "messages": {"custom_message": " no "}}}}, {"Disjunctions": {"checks": [{"Clause": {"Binary": {"check": {"Resolved": {"from": {"path": "/Resources/C/X"}}}, "messages": {}}}}]}}]}}]}
    runs = [("a", False, 19, json.dumps(fail) + "\n" + json.dumps({"name": "g", "not_compliant": []})), ("b", True, None, None), ("c", False, 0, ""), ("d", False, 5, "{oops")]
    got = sorted(map(tuple, tool_output.guard_findings(spark.createDataFrame(runs, "template_id string, timed_out boolean, exit_code int, stdout string")).fillna("").collect()))
    assert got == [("a", "violations", "r1", "B", "no"), ("a", "violations", "r1", "C", ""), ("b", "timeout", "", "", ""), ("c", "pass", "", "", ""), ("d", "error", "", "", "")]


def test_agent_rows(spark):
    row = {"Resource": "B", "Normalized_Category": "Odd", "FindingType": "Security", "Severity": "HIGH", "Confidence": "Confirmed", "Source": "Agent Review", "Finding": "x", "Evidence": [{"Detail": "d", "Excerpt": "e"}]}
    texts = [("t", json.dumps([row, row | {"Evidence": []}])), ("u", json.dumps({"findings": [row | {"Source": "Network Review"}]})), ("v", "nonsense"), ("w", None)]
    good, bad = tool_output.agent_findings(spark.createDataFrame(texts, "template_id string, text string"), ("IAM",))
    assert [(r.template_id, r.category, r.confidence) for r in good.collect()] == [("t", "Other", "Likely")]
    assert sorted((r.template_id, r.reasons) for r in bad.collect()) == [("t", ["excerpt"]), ("u", ["source"])]
    keys = spark.createDataFrame([('{"a":1,"b":2}',)], "t string").select(tool_output.unknown_keys(F.col("t"), ["a"]).alias("k")).first().k
    assert keys == ["b"]


def test_evidence(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("s", "a", sha(b"1"), 1), ("s", "b", sha(b"2"), 1), ("s", "c", sha(b"3"), 9), ("s", "d", "x", 1)], "store string, name string, sha256 string, size long")
    files = spark.createDataFrame([("s", "a", b"1"), ("s", "c", b"3"), ("s", "d", b"4"), ("s", "e", b"5")], "store string, name string, content binary")
    assert {(r.name, r.fault) for r in evidence.manifest_check(manifest, files).collect()} == {("b", "missing"), ("c", "length"), ("d", "hash"), ("e", "unlisted")}
    chain = spark.createDataFrame([("s", 1, "i1", None, "m1", None), ("s", 2, "i2", "i1", "m2", "m1"), ("s", 3, "i3", "iX", "m3", "m2"), ("s", 4, "i4", "i3", "m4", "m3")], "store string, revision int, id string, previous_id string, manifest_sha256 string, previous_manifest_sha256 string")
    assert [r.status for r in evidence.revision_chain(chain).orderBy("revision").collect()] == ["VALID", "VALID", "INVALID", "INVALID"]
    blob = files.where("name = 'a'").select(evidence.blob_id(F.col("content")).alias("h")).first().h
    assert blob == hashlib.sha1(b"blob 1\x001").hexdigest()


def test_reviews_and_chains(spark):
    rows = [(1, "APPROVED", 1, "01"), (2, "CHANGES_REQUESTED", 1, "02"), (3, "COMMENTED", 1, "03"), (4, "APPROVED", 2, "01"), (5, "DISMISSED", 2, "02"), (9, "APPROVED", 3, "01"), (7, "APPROVED", 3, "02"), (10, "APPROVED", 4, "05"), (11, "CHANGES_REQUESTED", 4, "05")]
    schema = "id long, state string, user_id long, submitted_at string"
    assert {r.user_id: r.state for r in evidence.reviewer_states(spark.createDataFrame(rows, schema)).collect()} == {1: "CHANGES_REQUESTED", 2: "none", 3: "none", 4: "none"}
    assert {r.state for r in evidence.reviewer_states(spark.createDataFrame([*rows, rows[0]], schema)).collect()} == {"duplicate"}
    links = spark.createDataFrame([("c", "l1", None), ("c", "l2", "x"), ("d", "l1", None), ("e", "l1", None), ("e", "l2", None)], "chain string, link string, code string")
    reasons = spark.createDataFrame([("x", "BROKEN")], "code string, status string")
    assert {r.chain: r.status for r in evidence.chain_status(links, reasons, ["l1", "l2"]).collect()} == {"c": "BROKEN", "d": "INCOMPLETE", "e": "COMPLETE"}
    codes = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "?")], "task string, code string")
    prio = spark.createDataFrame([("a", "VERIFIED"), ("b", "BLOCKED")], "code string, decision string")
    assert {r.task: r.decision for r in evidence.decision(codes, prio).collect()} == {"t": "BLOCKED", "u": "ERROR"}
    one, two = (spark.createDataFrame(x, "path string, mode string, oid string") for x in ([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")], [("a", "2", "y"), ("c", "1", "x"), ("d", "1", "x")]))
    assert {(r.path, r.change) for r in evidence.tree_compare(one, two).collect()} == {("a", "mode,content"), ("b", "removed"), ("d", "added")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.yaml").write_text("Resources: {Q: {Type: AWS::SQS::Queue}}")
    stream = reviews.reviewed(reviews.incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ("properties",))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert {r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"sqs_queue_encrypted", "required_tags"}


def test_aliases_are_measured_and_not_written_out(spark):
    lines = ["a0: &a0 [x, y]"] + [f"a{i}: &a{i} [*a{i - 1}, *a{i - 1}]" for i in range(1, 61)]
    cases = [
        ("\n".join(lines), "too many nodes", templates.MAX_NODES + 1, 63), ("\n".join(lines[:4]), None, 1 + 3 + 7 + 15 + 31, 6), ("a: &a {b: [*a]}", "an alias refers to what holds it", 0, 0), ("x", None, 1, 1), ("", "empty document", 0, 0), (None, "empty document", 0, 0),
        ("[" * 64 + "]" * 64, None, 64, 64), ("[" * 65 + "]" * 65, "nested too deeply", 65, 65), ("[" * 600 + "]" * 600, "nested too deeply", 0, 0), ('["[[[["]', None, 2, 2), ("{\n", "unreadable", 0, 0), ("a: [", "unreadable", 0, 0),
    ]
    docs = spark.createDataFrame([(str(i), t) for i, (t, *_) in enumerate(cases)], "template_id string, text string")
    got = {int(r.template_id): r for r in templates.structures(docs).collect()}
    for i, (text, failure, n, depth) in enumerate(cases):
        row = got[i]
        if failure == "unreadable":
            assert row.failure
            continue
        assert (row.failure, row.n_nodes, row.depth) == (failure, n, depth), text
    assert templates.nodes_of("t", cases[0][0])[0][-1] == "too many aliases"
    assert templates.structures(docs.limit(0)).count() == 0


def test_reviewable_documents(spark):
    texts = ["Resources: {A: {Type: x}}", "Resources: {}", "Resources: [a]", "[{Resources: {A: 1}}]", "Parameters: {A: 1}", "{", "Resources: &r {A: 1}\nOther: *r"]
    table = templates.nodes(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "template_id string, text string"))
    assert {int(r.template_id): r.reviewable for r in templates.reviewable(table).collect()} == dict(enumerate([True, False, False, False, False, False, True]))


def test_templates_of_a_folder(spark, tmp_path):
    texts = {"b.yaml": "B", "a/Z.YML": "Z", "a/node_modules/x.json": "no", "cdk.out/s.template.json": "S", "cdk.out/other.json": "no", "cdk.out/in/t.template.json": "no", "a/readme.txt": "no", "c d.template": "C"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.template_id: (r.grp, r.state, r.text) for r in listing.read(spark, str(tmp_path)).collect()}
    assert got == {"b.yaml": ("standalone", "taken", "B"), "a/Z.YML": ("standalone", "taken", "Z"), "c d.template": ("standalone", "taken", "C"), "cdk.out/s.template.json": ("synthesized", "taken", "S")}
    got = {r.template_id: (r.state, r.text) for r in listing.read(spark, str(tmp_path), most=2).collect()}
    assert got == {"a/Z.YML": ("taken", "Z"), "b.yaml": ("taken", "B"), "c d.template": ("stopped", None), "cdk.out/s.template.json": ("not_reached", None)}


def test_listings_without_lengths_and_empty_ones(spark):
    schema = "review_id int, path string, length long, outside boolean"
    rows = [(1, "a.json", None, None), (1, "b.json", 6 << 20, False), (1, "c.json", 1, True), (1, ".git/d.json", 1, False), (2, "x.YAML", 5 << 20, False)]
    got = {(r.review_id, r.path): (r.running, r.state) for r in listing.candidates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "a.json"): (0, "taken"), (1, "b.json"): (6 << 20, "too_large"), (2, "x.YAML"): (5 << 20, "taken")}
    assert listing.candidates(spark.createDataFrame([], schema)).count() == 0


def test_texts_of_one_file_are_parsed_by_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(templates, "TASK_BYTES", 1000)
    one = spark.range(200).selectExpr("cast(id as string) AS template_id", """concat('{"a": ', id, '}') AS text""").coalesce(1)
    table = templates.nodes(one)
    assert table.rdd.getNumPartitions() >= 2 and table.count() == 400 and table.select("template_id").distinct().count() == 200
    assert templates.structures(one).rdd.getNumPartitions() >= 2
    assert templates.nodes(one.where("false")).count() == 0
