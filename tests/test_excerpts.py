"""Bounded excerpts against the same walk in plain Python."""

import json
import random

from siltstone import report_queries
from siltstone.operators import excerpts
from siltstone.sources.templates import nodes


def some(rng, depth):
    kind = rng.random()
    if depth > 6 or kind < 0.4:
        return rng.choice([None, True, 7, "x" * rng.randint(0, 12), "é𝄞" * 4])
    if kind < 0.7:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 6))]
    return {f"k{rng.randint(0, 99)}": some(rng, depth + 1) for _ in range(rng.randint(0, 6))}


def counted(n, noun):
    return f"{n} {noun if n == 1 else noun + 's'}"


def walked(value, path, deep, text, items, keys, depth, out):
    if isinstance(value, (dict, list)):
        is_map = isinstance(value, dict)
        if deep >= depth:
            out[path] = ("str", f"[omitted: {'mapping' if is_map else 'sequence'} with {counted(len(value), 'key' if is_map else 'item')}]")
            return
        out[path] = ("map" if is_map else "list", None)
        most = keys if is_map else items
        parts = list(value.items()) if is_map else [(str(i), x) for i, x in enumerate(value)]
        for k, v in parts[:most]:
            walked(v, (*path, k), deep + 1, text, items, keys, depth, out)
        if len(parts) > most:
            more = counted(len(parts) - most, "key" if is_map else "item")
            out[(*path, "__omitted__" if is_map else str(items))] = ("str", f"[omitted: {more} more]" if is_map else f"... [omitted: {more} more]")
    elif isinstance(value, str):
        out[path] = ("str", value if len(value) <= text else value[:text] + "... [truncated]")
    else:
        out[path] = ("null", None) if value is None else ("bool", str(value).lower()) if isinstance(value, bool) else ("int", str(value))


def test_excerpts_equal_a_walk(spark):
    rng = random.Random(12)
    docs = {str(i): {"A": some(rng, 0), "B": [some(rng, 0)]} for i in range(60)} | {"deep": {"A": [[[[[[1, {}], []]]]]]}, "empty": {}}
    table = nodes(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "template_id string, text string"))
    for bounds in ({"text": 5, "items": 2, "keys": 3, "depth": 3}, {"text": 8, "items": 4, "keys": 1, "depth": 1}, {}):
        full = {"text": excerpts.TEXT, "items": excerpts.ITEMS, "keys": excerpts.KEYS, "depth": excerpts.DEPTH} | bounds
        got, expected = {}, {}
        for r in excerpts.bounded(table, 1, **bounds).collect():
            got[r.template_id, tuple(r.path)] = (r.vtype, r.sval)
        for i, d in docs.items():
            for k, v in d.items():
                out = {}
                walked(v, (k,), 0, out=out, **full)
                expected |= {(i, p): x for p, x in out.items()}
        assert got == expected
    assert excerpts.bounded(table.where("false"), 1).count() == 0


def test_excerpts_by_places_equal_a_walk_and_move_nothing(spark):
    rng = random.Random(13)
    docs = {str(i): {"A": some(rng, 0), "B": [some(rng, 0)]} for i in range(60)} | {"numbers": {"A": {"0": [[]], "1": {"1": 1, "0": [2]}, "x": [1, [2], 3]}}, "empty": {}}
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [("bad", "{"), ("again", '{"A": {"x": 1, "y": 2, "x": [3, 4, 5], "z": {"y": 1, "y": 2}, "w": 6}}')]
    docs["again"] = {"A": {"y": 2, "x": [3, 4, 5], "z": {"y": 2}, "w": 6}}
    table = nodes(spark.createDataFrame(rows, "template_id string, text string").coalesce(1), places=True, dealt=True)
    for bounds in ({"text": 5, "items": 2, "keys": 3, "depth": 3}, {"text": 8, "items": 4, "keys": 1, "depth": 1}, {"depth": 0}, {}):
        full = {"text": excerpts.TEXT, "items": excerpts.ITEMS, "keys": excerpts.KEYS, "depth": excerpts.DEPTH} | bounds
        made = excerpts.bounded(table, 1, **bounds)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        found = [(r.template_id, tuple(r.path), r.vtype, r.sval) for r in made.collect()]
        expected = []
        for i, d in docs.items():
            for k, v in d.items():
                out = {}
                walked(v, (k,), 0, out=out, **full)
                expected += [(i, p, *x) for p, x in out.items()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_excerpts_of_orders_keep_nothing_on_disk(spark, monkeypatch):
    kept = []
    for module in (excerpts, report_queries):
        monkeypatch.setattr(module, "settled", lambda df: kept.append(df) or df)
    assert report_queries.bounded_excerpts(spark, "/root/testdata/sf0.001").count() > 0
    assert not kept
