"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from siltstone.llm import variants

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words, times=5):
    forms = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= times * n else None
        forms[w] = (form, n, len(others), words[form] if form else None)

    def root(w):
        while forms[w][0] is not None:
            w = forms[w][0]
        return w

    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in forms.items()}


def rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def counted(texts, every=None, least=6, most=5):
    total = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= most}


def test_forms_equal_those_of_all_pairs(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): 5 ** rng.randint(0, 7) + rng.randint(0, 1) for _ in range(400)}
    words |= {"aaaa": 5, "aaa": 25, "aaaaa": 25, "中文": 7, "中": 40, "𝄞x": 3, "x": 90}
    got = rows(variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words)
    assert set(got) == expected(words)


@pytest.mark.parametrize("every", [None, 3])
def test_words_equal_a_plain_count(spark, every):
    rng = random.Random(3)
    vocabulary = ["Kleine", "kleine", "größer", "ÄRGER", "naïveté", "plain", "a×b÷cdef", "Ωmegaé", "words中words", "straße", "letter", "letters"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    texts += [(None, "letter letter letters"), (7, None), (8, ""), (9, "x" * 300_000 + " letter"), (9, "x" * 300_000 + " letter"), (10, "abcdef" * 5000), (-3, "\x00letter\x00")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], SCHEMA)
    got = {r.word: r.n for r in variants.vocabulary(docs, erase_every=every).collect()}
    assert got == counted(texts, every)


def test_passing_on_before_the_end_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    texts = [(i, "several different wordings appear often hereabouts") for i in range(9)]
    got = variants.vocabulary(spark.createDataFrame([(i, t, "", "") for i, t in texts], SCHEMA))
    assert {r.word: r.n for r in got.collect()} == counted(texts)


def test_chains_end_at_their_root(spark):
    chain = [("x" * k, 5**k) for k in range(1, 14)]
    got = rows(variants.grouped(spark.createDataFrame(chain, "word string, n long")))
    assert {r[2] for r in got} == {"x" * 13}


def test_odd_words(spark):
    odd = [("word", 3), ("word", 2), (None, 4), ("other", None), ("", 9), ("w", 50), ("ward", 25)]
    got = rows(variants.grouped(spark.createDataFrame(odd, "word string, n long")))
    assert set(got) == expected({"word": 5, "": 9, "w": 50, "ward": 25})
    with pytest.raises(ValueError, match="times"):
        variants.grouped(spark.createDataFrame(odd, "word string, n long"), times=1)
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(variants.grouped(variants.vocabulary(empty))) == []


def test_sql_agrees_with_the_plain_count():
    con = duckdb.connect()
    texts = [(i, "größere Wörter stehen hierin " * (1 + i % 3) + "hierein") for i in range(300)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    cur = con.execute(variants.SQL)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert {tuple(r[i] for i in at) for r in cur.fetchall()} == expected(counted(texts, 199))
