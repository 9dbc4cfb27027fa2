"""Hard negatives and near-duplicate vectors against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from siltstone.llm import negatives, pq

SCHEMA = "vec_id long, embedding array<double>, label int, id string, n int, vector string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], schema)


def vectors(n, labels, seed, width=12, groups=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(groups, 1), width))
    x = rng.normal(size=(n, width)) if not groups else centres[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.25
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 12, None), (903, [math.nan] + [1.0] * 11, 1), (904, [math.inf] + [1.0] * 11, 1), (905, [None] + [1.0] * 11, 1),
       (906, [0.0] * 12, 1), (907, [-0.0] * 12, 1), (None, [1.0] * 12, 1), (908, [3.0] * 7, 1), (909, [3.0] * 12, 1), (910, [1.0] * 12, 1)]


def mined_by_pairs(rows, k=5, m=10, low=30, high=90):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    score = lambda a, b: sum(x * y for x, y in zip(whole[a][1], whole[b][1], strict=False))
    out = []
    for a in whole:
        if a % 100:
            continue
        rated = sorted((-score(a, b), b) for b in whole if b != a)
        for s, p in [(-s, b) for s, b in rated if whole[b][0] == whole[a][0]][:k]:
            inside = [(b, -t) for t, b in rated if whole[b][0] != whole[a][0] and low * s <= -100 * t <= high * s][:m]
            out += [(a, p, r, b, s, t) for r, (b, t) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    got = negatives.mined(*negatives.prepared(frame(spark, rows)))
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("groups", [0, 6])
def test_negatives_equal_those_of_all_pairs(spark, monkeypatch, groups):
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "AT_ONCE", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = vectors(800, 4, 5 + groups, groups=groups)
    found = mined(spark, rows)
    assert found
    assert found == mined_by_pairs(rows)


def test_negatives_of_odd_rows_and_ties(spark):
    same = [(i, [0.25, 0.5], i % 3) for i in range(0, 230)]
    near = [(i, [0.2, 0.3 + i / 1e4], i % 3) for i in range(230, 330)]
    rows = same + near + [(i + 1000, v, label) for i, v, label in ODD if i is not None] + [(None, [1.0, 1.0], 1), (400, [1e300, 1.0], 2)]
    expected = mined_by_pairs([r for r in rows if r[0] != 400])
    assert mined(spark, rows) == expected
    assert mined(spark, rows + rows[:5]) == expected  # repeated rows count once
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_negatives_of_large_numbers_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 19), 1 << 19, 4)], int(i % 3)) for i in range(300)]
    assert mined(spark, rows) == mined_by_pairs(rows)


def linked_by_pairs(rows, threshold=0.93):
    good = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in good}
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            new = [j for j in links.get(open_.pop(), []) if j not in seen]
            seen |= set(new)
            open_ += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((k, len(links.get(i, [])), least, least == k))
    return sorted(out, key=str)


def linked(spark, rows, **more):
    return sorted(map(tuple, pq.linked(frame(spark, rows), **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("threshold", [0.93, 0.8])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, threshold):
    for name, value in (("CELL_NODES", 40), ("LISTED", 30), ("PROBING", 50), ("AT_ONCE", 16), ("SAMPLE", 300)):
        monkeypatch.setattr(pq, name, value)
    rows = vectors(500, 3, 8, groups=30) + [(i + 500, v, label) for i, v, label in vectors(100, 3, 9)]
    rows += [(i + 700, v, label) for i, v, label in rows[:60]] + [(i + 800, [2 * x for x in v], label) for i, v, label in rows[:40]] + ODD
    got = linked(spark, rows, threshold=threshold)
    assert sum(r[1] for r in got) > 500
    assert got == linked_by_pairs(rows, threshold)


def test_links_when_all_nodes_travel_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(pq, "SENT", 0)
    rows = vectors(120, 2, 4, groups=8)
    assert linked(spark, rows) == linked_by_pairs(rows)


def test_links_of_copies_ties_and_empty_tables(spark):
    copies = [(i, [0.1, 0.2, 0.3], 7) for i in range(300)] + [(5, [0.1, 0.2, 0.3], 7), (1000, [1e200, 2e200, 3e200], 7), (1001, [1e-200, 2e-200, 3e-200], 7)]
    got = linked(spark, copies)
    assert all(r[2] == 0 for r in got)
    assert {r[1] for r in got} == {len(copies) - 1}
    assert linked(spark, []) == []
    assert linked(spark, [(3, None, 1)]) == [(3, 0, 3, True)]
    edge = [(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1), (3, [0.6, 0.8], 1)]
    assert linked(spark, edge, threshold=0.8) == linked_by_pairs(edge, 0.8)


@pytest.mark.parametrize(("sql", "run", "brute"), [(negatives.SQL, mined, mined_by_pairs), (pq.SQL, linked, linked_by_pairs)])
def test_sql_agrees(sql, run, brute):
    rows = vectors(450, 3, 31, groups=12)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] if run is mined else ["vec_id", "n_links", "component_id", "kept"]
    got = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
