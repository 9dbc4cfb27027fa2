"""Semantic changes on small templates: what cannot be compared, limits, and who is told topmost."""

from siltstone.operators import delta, semantic
from siltstone.sources.templates import nodes


def sides(spark, base, head):
    return tuple(nodes(spark.createDataFrame([("t", x)], "template_id string, text string")) for x in (base, head))


def told(spark, base, head, **more):
    b, h = sides(spark, base, head)
    return sorted(("/".join(r.path), r.change, r.qualifiers) for r in semantic.changes(b, h, **more).collect())


def test_repeated_keys_and_time_stamps_are_not_compared(spark):
    base = "Resources:\n  A: {Type: T, Properties: {X: 1, X: 2, Y: {Z: 1}, W: 2001-01-01 00:00:00}}"
    head = "Resources:\n  A: {Type: T, Properties: {X: 3, Y: {Z: 2}, W: 2002-02-02 00:00:00}}"
    assert told(spark, base, head) == [("Resources/A/Properties/Y/Z", "modified", "")]
    odd = sorted(("/".join(r.path), r.reason) for r in semantic.uncompared(*sides(spark, base, head)).collect())
    assert odd == [("Resources/A/Properties/W", "yaml_timestamp"), ("Resources/A/Properties/X", "duplicate_key")]


def test_equal_templates_differ_in_nothing_whatever_their_form(spark):
    assert told(spark, "Resources: {A: {Type: T, Properties: {X: [1, a]}}}", '{"Resources": {"A": {"Properties": {"X": [1, "a"]}, "Type": "T"}}}') == []


def test_swapping_sides_turns_added_into_removed(spark):
    base, head = "Resources: {A: {Type: T}}\nOutputs: {O: {Value: 1}}", "Resources: {A: {Type: T}, B: {Type: T}}\nOutputs: {O: {Value: 2}}"
    one, two = told(spark, base, head), told(spark, head, base)
    turn = {"added": "removed", "removed": "added", "modified": "modified"}
    assert [(p, turn[c], q) for p, c, q in one] == two and len(one) == 2


def test_too_many_changes_fail(spark):
    b, h = sides(spark, "Resources: {A: {Type: T, Properties: {X: 1, Y: 1}}}", "Resources: {A: {Type: T, Properties: {X: 2, Y: 2}}}")
    assert {r.failed for r in semantic.changes(b, h, most=1).collect()} == {True}
    assert {r.failed for r in semantic.changes(b, h, most=2).collect()} == {False}


def test_counters_tell_zeros(spark):
    rows = spark.createDataFrame([("head_only", "New"), ("head_only", "New"), ("matched", "Unchanged")], "observation string, classification string")
    got = {(r.observation, r.classification): r.n for r in delta.counters(rows).collect()}
    assert got["head_only", "New"] == 2 and got["matched", "Unchanged"] == 1 and sum(got.values()) == 3 and len(got) == 13


def hints(spark, base, head):
    return sorted("/".join(r.path) for r in semantic.changes(*sides(spark, base, head)).where("hint is not null").collect())


def test_ends_that_cannot_be_compared_hint_at_renames(spark):
    known = "Resources:\n  B: {Type: T}\n  C: {Type: U}"
    assert hints(spark, "Resources:\n  A: {Type: T}\n  C: {Type: U}", known) == ["Resources/A", "Resources/B"]
    assert hints(spark, "Resources:\n  A: {Type: V}\n  C: {Type: U}", known) == []
    # a resource that stands twice has no type that is known: it may be any
    assert hints(spark, "Resources:\n  A: {Type: V}\n  A: {Type: W}\n  C: {Type: U}", known) == ["Resources/B"]
    assert hints(spark, "Resources:\n  A: 2001-01-01 00:00:00\n  C: {Type: U}", known) == ["Resources/B"]
    # it is no end where it stands on either side
    assert hints(spark, "Resources:\n  A: {Type: V}\n  A: {Type: W}\n  C: {Type: U}", known + "\n  A: {Type: V}") == []
    # a type that is no text pairs with nothing but what may be any
    assert hints(spark, "Resources:\n  A: {Type: [T]}\n  C: {Type: U}", "Resources:\n  B: {Type: [T]}\n  C: {Type: U}") == []
