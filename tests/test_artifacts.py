"""Ids of directories against a fold in plain Python, clauses against plain search."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import artifacts, clauses


def object_id(kind, body):
    return hashlib.sha1(b"%b %d\0" % (kind, len(body)) + body).hexdigest()


def folded(files):
    out = {}

    def fold(items, path):
        entries, inner = [], {}
        for steps, mode, oid in items:
            if len(steps) == 1:
                entries.append((steps[0].encode(), steps[0].encode(), mode.encode(), oid))
            else:
                inner.setdefault(steps[0], []).append((steps[1:], mode, oid))
        for name, own in inner.items():
            entries.append((name.encode() + b"/", name.encode(), b"40000", fold(own, [*path, name])))
        oid = object_id(b"tree", b"".join(mode + b" " + name + b"\0" + bytes.fromhex(oid) for _, name, mode, oid in sorted(entries)))
        out["/".join(path)] = oid
        return oid

    fold([(p.split("/"), m, o) for p, m, o in files], [])
    return out


def test_ids_of_directories(spark):
    rng = random.Random(6)
    trees = {}
    for t in range(6):
        names = {"/".join(rng.choice(["a", "a.b", "a-b", "é", "z", "a0"]) + (str(i) if last else "") for last in [False] * rng.randint(0, 4) + [True]) for i in range(rng.randint(1, 40))}
        trees[t] = [(n, rng.choice(["100644", "100755", "120000"]), object_id(b"blob", n.encode())) for n in sorted(names)]
    rows = [(t, *f) for t, files in trees.items() for f in files]
    got = {}
    for r in artifacts.tree_ids(spark.createDataFrame(rows, "tree_id int, path string, mode string, oid string")).collect():
        got.setdefault(r.tree_id, {})[r.path] = r.oid
    assert got == {t: folded(files) for t, files in trees.items()}
    assert artifacts.tree_ids(spark.createDataFrame([], "tree_id int, path string, mode string, oid string")).count() == 0


def test_known_ids(spark):
    assert spark.range(1).select(artifacts.object_id("blob", F.lit(b"")).alias("x")).first().x == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    rows = [(1, "a", "100644", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391")]
    assert artifacts.tree_ids(spark.createDataFrame(rows, "tree_id int, path string, mode string, oid string")).first().oid == "496d6428b9cf92981dc9495211e6e1120fb6f2ba"


def test_trees_and_their_files(spark):
    files, asked = [], []
    blob = lambda b: object_id(b"blob", b)
    for tree in (1, 2, 3):
        files.append((tree, "a", "100644", blob(b"x"), b"x", False))
        asked.append((tree, "a", b"x"))
    files += [(2, "b", "120000", blob(b"y"), b"z", False), (2, "c", "160000", "0" * 40, None, False), (2, "d", "100644", "0" * 40, None, True), (3, "e", "100644", "0" * 40, None, False)]
    asked += [(2, "gone", b""), (3, "e", b"e")]
    trees = [(1, "c1", "c1", "s", "s"), (2, "c2", "c1", "s", "s"), (3, "c3", "c3", "s", "s"), (4, None, None, "s", "s"), (5, "c5", "c5", "s", None)]
    found = artifacts.compared(
        spark.createDataFrame(trees, "tree_id int, commit string, claimed_commit string, source_commit string, claimed_source string"),
        spark.createDataFrame(files, "tree_id int, path string, mode string, oid string, content binary, too_large boolean"),
        spark.createDataFrame(asked, "tree_id int, path string, content binary"),
    )
    got = {r.tree_id: (r.status, r.rule, r.reason, r.mismatches) for r in found.collect()}
    assert got[1] == ("MATCH", "PASS", "whole_tree_matches_source", "")
    assert got[2][3] == "artifact_commit_mismatch:,blob_too_large:d,extra_file:b,extra_file:c,extra_file:d,gitlink:c,invalid_git_object:b,missing_file:gone,symlink:b"
    assert got[3] == ("UNVERIFIABLE", "NOT_PROVEN", "artifact_unverifiable", "")
    assert got[4][:2] == ("UNVERIFIABLE", "NOT_PROVEN")
    assert got[5] == ("MISMATCH", "FAILED", "source_commit_mismatch", "source_commit_mismatch:")


@pytest.mark.parametrize("automaton", [True, False])
def test_clauses_stand_where_a_plain_search_finds_them(spark, monkeypatch, automaton):
    monkeypatch.setattr(clauses, "BLOCK", 5)
    if not automaton:
        monkeypatch.setattr(clauses, "ahocorasick", None)
    elif clauses.ahocorasick is None:
        pytest.skip("no automaton")
    rng = random.Random(9)
    texts = {i: "".join(rng.choice("aab é𝄞.\n") for _ in range(rng.randint(0, 60))) for i in range(30)} | {30: None, 31: "aaa"}
    quotes = []
    for i, text in texts.items():
        for k in range(rng.randint(1, 12)):
            begin = rng.randint(0, len(text or ""))
            quotes.append((i, k, rng.choice([None, "", "aa", (text or "")[begin : begin + rng.randint(1, 9)]])))
    quotes += [(99, 0, "x"), (31, 50, "aa")]
    frames = spark.createDataFrame(list(texts.items()), "source int, text string"), spark.createDataFrame(quotes, "source int, clause int, quoted string")
    places = clauses.placed(*frames)
    got = {(r.source, r.clause): (r.n, r.begin, r.end) for r in places.collect()}
    expected = {}
    for source, clause, quoted in quotes:
        text = (texts.get(source) or "") if source in texts else None
        n = None if text is None else text.count(quoted) if quoted else 0
        begin = text.index(quoted) if n == 1 else None
        expected[source, clause] = (n, begin, begin + len(quoted) if n == 1 else None)
    assert got == expected
    left = {r.source: (r.n_gaps, r.left) for r in clauses.left_over(frames[0], places).collect()}
    crossed = {(r.source, r.clause, r.other) for r in clauses.overlaps(places).collect()}
    for source, text in texts.items():
        spans = sorted((b, e, c) for (s, c), (n, b, e) in expected.items() if s == source and n == 1)
        assert {x for x in crossed if x[0] == source} == {(source, b[2], a[2]) for a, b in zip(spans, spans[1:], strict=False) if b[0] < a[1]}
        covered = [any(b <= i < e for b, e, _ in spans) for i in range(len(text or ""))]
        marked = "".join("\0" if c else ch for ch, c in zip(text or "", covered, strict=True))
        parts = [p for p in marked.split("\0") if p]
        said = ["".join(ch for ch in p if ch not in clauses.SPARED) for p in parts]
        assert left[source] == (len(parts), " ".join(s for s in said if s))


def test_an_answer_of_a_file_on_neither_side_fails_for_its_source(spark):
    c = "a" * 40
    raw = json.dumps({"content": base64.b64encode(b"x").decode(), "sha": object_id(b"blob", b"x"), "encoding": "base64", "path": "p"}).encode()
    answers = spark.createDataFrame([(1, 1, "API", "COMPLETE", f"/repos/o/r/contents/p?ref={c}", raw)], "answer_id int, tree_id int, source_type string, completeness string, endpoint string, raw binary")
    none = spark.createDataFrame([], "tree_id int, path string, content binary")
    out = artifacts.published(answers, spark.createDataFrame([(1, c, "MATCH")], "tree_id int, commit string, status string"), none, none).first()
    assert (out.status, out.reason) == ("FAILED", "served_bytes_differ_from_approved_source")
