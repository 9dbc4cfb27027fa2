"""How often rules read the node table, and how many joins they are made of: what their time and memory grow with."""

import json

from pyspark.sql import functions as F

from siltstone import report_queries
from siltstone.operators import semantic
from siltstone.plans.settle import settled
from siltstone.rules import iam, network, profiles, quality
from siltstone.sources import made, templates
from siltstone.sources.templates import Relations, nodes


def _relations(spark, kind):
    texts = [(str(i), text.replace(made.KEY, str(i))) for i, text in enumerate(made._variants(kind))]
    return Relations(settled(nodes(spark.createDataFrame(texts, "template_id string, text string"))))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _reads(df, *columns):
    """Reads of settled tables that have the columns."""
    return sum("LogicalRDD" in line and all(f"{c}#" in line for c in columns) for line in _plan(df).splitlines())


def test_edges_read_the_nodes_once(spark):
    assert _reads(_relations(spark, "templates").edges(include_sub=True), "path", "dup_key") == 1


def test_a_repeated_key_is_marked_at_its_last_place_in_wide_mappings(spark):
    keys = [f"k{i}" for i in range(20_000)]
    text = "{" + ", ".join(f"{json.dumps(k)}: {i}" for i, k in enumerate([*keys, "k7"])) + "}"
    table = nodes(spark.createDataFrame([("t", text)], "template_id string, text string"))
    assert [(r.path, r.sval) for r in table.where("dup_key").collect()] == [(["k7"], "20000")] and table.count() == 20_001


def test_statements_are_grouped_without_joins_of_their_parts(spark):
    relations = _relations(spark, "policies")
    assert _plan(iam.judged(relations)).count("Join ") <= 2  # sites, and values of parameters
    assert _plan(iam.findings(relations)).count("Join ") == 0


def test_quality_rules_read_the_nodes_three_times_and_what_is_told_of_parameters_apart(spark):
    assert _reads(quality.findings(_relations(spark, "templates")), "path", "dup_key") <= 3 + 4


def test_network_rules_read_the_nodes_for_two_properties_only(spark):
    assert _reads(network.findings(_relations(spark, "templates")), "path", "dup_key") == 2


def _dealt(spark, monkeypatch, kind, n_bytes):
    """A node table of many tasks, however small."""
    monkeypatch.setattr(templates, "TASK_BYTES", n_bytes)
    texts = [(str(i), text.replace(made.KEY, str(i))) for i, text in enumerate(made._variants(kind))]
    return settled(nodes(spark.createDataFrame(texts, "template_id string, text string")))


def test_versions_are_compared_without_a_join_in_as_many_tasks_as_they_have(spark, monkeypatch):
    base, head = (_dealt(spark, monkeypatch, kind, 500) for kind in ("base", "head"))
    tasks = base.rdd.getNumPartitions() + head.rdd.getNumPartitions()
    both = semantic._compared(base, head, base.where("false"))
    assert tasks > 4 and both.rdd.getNumPartitions() == tasks and "Join " not in _plan(both)


def test_documents_of_parts_are_made_after_parts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(report_queries, "TASK_PARTS", 50)
    plan = _plan(report_queries.template_structures(spark, "/root/testdata/sf0.001"))
    made_at, dealt_at = plan.index("transform("), [i for i in range(len(plan)) if plan.startswith("RepartitionByExpression", i)]
    assert len(dealt_at) == 2 and dealt_at[0] < made_at < dealt_at[1]


def test_profile_rules_join_nothing_and_hold_what_a_task_parsed(spark, monkeypatch):
    table = _dealt(spark, monkeypatch, "policies", 2_000)
    relations, targets = Relations(table), table.where("ord = 0").select("template_id", F.lit("It").alias("logical_id"))
    for found in (profiles.billing_mode(relations, targets), profiles.inline_statements(relations, targets, "s")):
        assert relations.tasks > 3 and found.rdd.getNumPartitions() == relations.tasks and "Join " not in _plan(found) and found.count() == targets.count()
