"""Revisits and preference pairs: SQL on the tables, and odd inputs."""

import duckdb
import pytest

from siltstone.llm import chat, registry, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(registry.oracle_sql()[name]).fetchdf()
    rows = lambda d: sorted(tuple(str(int(x)) if isinstance(x, float) and x == x else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)


RECORDS = [
    # record_id, url, ts, kind, headers, digest
    (1, "http://www.a.org:80/x/?b=2&a=1#f", 10, "response", {"etag": '"1"', "server": "s", "content-type": "t"}, "d1"),
    (2, "https://A.org/x?a=1&b=2", 500_000, "revisit", {"etag": 'W/"1"', "date": "now", "content-type": "wrong"}, "d1"),
    (3, "https://a.org/x?a=1&b=2", 5, "revisit", {"etag": '"1"'}, "d1"),
    (4, "https://a.org/x?a=1&b=2", 10, "revisit", {"etag": '"1"'}, "d1"),
    (5, "https://a.org/x?a=1&b=2", 600_000, "response", {"etag": '"2"'}, "d2"),
    (6, "https://a.org/x?a=1&b=2", 600_000, "response", {"etag": '"3"'}, "d3"),
    (7, "https://a.org/x?a=1&b=2", 600_001, "revisit", {"etag": '"1"'}, "d1"),
    (8, "https://a.org/x?a=1&b=2", 600_002, "revisit", None, "d3"),
    (9, "https://a.org/x?a=1&b=2", 600_003, "revisit", {}, None),
    (10, None, 600_003, "revisit", {}, None),
    (11, "https://a.org/x?a=1&b=2", None, "revisit", {}, None),
    (2, "https://A.org/x?a=1&b=2", 500_000, "revisit", {"etag": 'W/"1"', "date": "now", "content-type": "wrong"}, "d1"),
]
SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"


@pytest.mark.parametrize("stretch", [86_400, 1, 10**9])
def test_revisits(spark, stretch):
    got = sorted((r.record_id, r.response_id, r.verdict) for r in warc.resolve(spark.createDataFrame(RECORDS, SCHEMA), stretch).collect())
    assert got == [(2, 1, "etag"), (2, 1, "etag"), (3, None, "no-response"), (4, None, "no-response"), (7, 6, "mismatch"), (8, 6, "digest"), (9, 6, "unvalidated"), (10, None, "no-response"), (11, None, "no-response")]


def test_merged_headers(spark):
    rows = warc.resolve(spark.createDataFrame(RECORDS, SCHEMA)).where("record_id = 2").collect()
    assert rows[0].headers == {"etag": 'W/"1"', "server": "s", "content-type": "t", "date": "now"}
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_preferences(spark):
    turns = [("p", 1, "user", "hi"), ("p", 2, "assistant", "yo"), ("q", 1, "user", "hi"), ("q", 2, "assistant", "no"), ("q", 3, None, None)]
    sides = [chat.conversations(spark.createDataFrame([(1, n, r, t) for s, n, r, t in turns if s == side], "id long, turn long, role string, text string"), "id") for side in "pq"]
    r = chat.preferences(*sides).first()
    assert (r.n_prompt_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    for text, spans, said in ((r.chosen, r.chosen_spans, ["yo<|end|>\n"]), (r.rejected, r.rejected_spans, ["no<|end|>\n"])):
        assert [(r.prompt + text)[s.start : s.end] for s in spans] == said
    assert r.rejected.endswith("<|unknown|>\n<|end|>\n")
    same = chat.preferences(sides[0], sides[0]).first()
    assert same.n_prompt_turns == 2 and same.chosen == same.rejected == "" and same.chosen_spans == []
    assert chat.preferences(sides[0].limit(0), sides[1]).count() == 0


def test_pairs_of_a_table(spark):
    rows = [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "assistant", "b"), (4, 0, "assistant", "x"), (5, 0, "user", "y"), (None, 0, "assistant", "z")]
    got = chat.digest(chat.preferences(*chat.answers_swapped(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert sorted((r.conv_id, r.n_prompt_turns, r.chosen) for r in got) == [(2, 2, ""), (3, 1, "")]
