"""Laws of the generic operators."""

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import graphs, logic, matching, sequences


def test_matching_conserves_rows(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, l int")
    right = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("c", 4)], "k string, r int")
    rows = matching.one_to_one(left, right, ["k"], ["l"], ["r"]).collect()
    assert sum(r.matched for r in rows) + sum(r.only_left for r in rows) == 4
    assert sum(r.matched for r in rows) + sum(r.only_right for r in rows) == 4
    assert sum(r.matched for r in rows) == 2


def test_a_snapshot_matches_itself(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (None, "z"), (3, "q"), (3, "q")], "k int, fp string")
    stages = {(r.k, r.fp, r.stage) for r in matching.delta(df, df, ["k"], "fp", F.col("k").isNotNull()).collect()}
    assert (1, "x", "identity") in stages and (2, "y", "fingerprint") in stages and (None, "z", "fingerprint") in stages
    assert (3, "q", "undetermined") in stages and not any(s == "only" for *_, s in stages)


def test_percent_rounds_halves_to_even(spark):
    row = spark.range(1).select(matching.percent(F.lit(1), F.lit(16)).alias("a"), matching.percent(F.lit(0), F.lit(0)).alias("b")).first()
    assert (row.a, row.b) == ("6.2", "N/A")


def test_wildcards(spark):
    values = spark.createDataFrame([("iam:PassRole",), ("iam:x\n",), ("s3.get",)], "v string")
    patterns = spark.createDataFrame([("IAM:*",), ("iam:?",), ("s3?get",), ("s3.get",), ("iam",)], "p string")
    assert {(r.v, r.p) for r in logic.grants(values, "v", patterns, "p").collect()} == {("iam:PassRole", "IAM:*"), ("iam:x\n", "IAM:*"), ("s3.get", "s3?get"), ("s3.get", "s3.get")}


def test_three_valued(spark):
    rows = [("a", "g", False, True, False), ("b", "g", False, False, True), ("c", "g", True, True, False), ("c", "g", True, False, True), ("d", "g", True, False, True)]
    df = spark.createDataFrame(rows, "item string, grp string, all boolean, hit boolean, blocked boolean")
    got = {r.item: r.verdict for r in logic.three_valued(df, "item", "grp", F.col("all"), F.col("hit"), F.col("blocked")).collect()}
    assert got == {"a": "MATCH", "b": "UNRESOLVABLE", "c": "UNRESOLVABLE", "d": "NO_MATCH"}


def test_reach_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert graphs.reach(links).count() == 12
    assert {r.node for r in graphs.cycle_nodes(links).collect()} == {1, 2, 3}


def test_sequences(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 2)], "k string, i int")
    assert {r.k: r.complete for r in sequences.page_sequence(pages, "k", "i", 1).collect()} == {"a": True, "b": False, "c": False}
    events = spark.createDataFrame([("u", 1, "x"), ("u", 1, "y"), ("u", 0, "z")], "u string, t int, s string")
    assert sequences.latest(events, ["u"], F.lit(True), F.struct("t", "s"), "s").first().state == "y"


def test_text(spark):
    names = spark.createDataFrame([("b",), ("a",), ("é",), (None,), ("b",)], "n string")
    assert {r.n: r.token for r in tx.token_table(names, "n").collect()} == {"a": "id-000001", "b": "id-000002", "é": "id-000003"}
    assert tx.token_table(names.limit(0), "n").count() == 0
    bits = tx.entropy(spark.createDataFrame([(1, "aaaa"), (2, "abcd")], "k int, v string"), "k", "v")
    assert {r.k: r.entropy for r in bits.collect()} == {1: 0.0, 2: 2.0}


def test_cycle_nodes_against_reachability(spark):
    import random

    rng = random.Random(3)
    for n, m in ((12, 14), (20, 24), (9, 30)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(100 + i, 101 + i) for i in range(6)}
        reached = set(edges)
        while new := {(a, d) for a, b in reached for c, d in edges if b == c} - reached:
            reached |= new
        got = sorted(r.node for r in graphs.cycle_nodes(spark.createDataFrame(sorted(edges), "src long, dst long")).collect())
        assert got == sorted(a for a, b in reached if a == b)
    assert graphs.cycle_nodes(spark.createDataFrame([], "src long, dst long")).count() == 0
