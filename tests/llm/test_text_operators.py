"""Licence scan, byte-level BPE, HTML extraction: exact forms and odd inputs."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siltstone.llm import bpe, html, licenses

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n", "a", "a", "ß ÄÖ 中文 🙂", "x" * 5000, "\x1c\x85  \t\n  y"]


def odd_rows(spark):
    rows = [(i // 2, t, "clash", i) for i, t in enumerate(ODD)] + [(None, "null id", "clash", 99)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")


@pytest.fixture(scope="module")
def coder():
    return bpe.load(PATH, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(coder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abthe 𝄞éß中 \n\t1'\x1c\x85.,") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["the" * 3000 + "ab" * 2000, "a" * 20000, "  a   b\n \n c ", "don't we'll I'M"]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids == other.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("pattern", [r"\p{Lu}?\p{Ll}+|\p{N}{1,3}|\s|.", r"( ?\w+)|\s+|[^\w\s]+"])
def test_bpe_equals_the_library_by_other_patterns(coder, pattern):
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["helloWorld fooBar", "and the THEend of it, 12345 times", " a  b\n", ""]
    assert list(bpe.Bpe(coder.ranks, pattern).encode_all(texts)) == [other.encode_ordinary(t) for t in texts]


def test_bpe_forgets_and_passes_rows_on(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    monkeypatch.setattr(bpe, "BLOCK", 60)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(12)) for _ in range(200)]
    small = bpe.Bpe(coder.ranks, public_tokenizers.PATTERN)
    assert list(small.encode_all(texts)) == list(coder.encode_all(texts))
    assert len(small.known) < 60


def test_bpe_long_and_short_ways_agree(coder):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdething\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    pieces = sorted({p for p in pieces if p not in coder.ranks})
    ids, counts = coder.merge_all(pieces)
    assert [coder.merge(p) for p in pieces] == [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert not coder.buckets and not any(coder.leaves)


def test_bpe_table(spark):
    docs = odd_rows(spark)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    for r in got.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bpe.load(PATH, public_tokenizers.PATTERN).decode(r.ids)).hexdigest()
    assert got.count() == docs.count() and got.where("n_tokens = 0").count() == 2
    back = bpe.decode(got, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for t in [*ODD, "null id"])
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_license_places_and_labels(spark):
    texts = {
        1: "x CC-BY y cc by z. General PUBLIC License; all rights reserved",
        2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        3: "the permission was granted to a person, free of mind",
        4: "This work is licensed under the GNU General Public License, version 3.",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (13, 4, 1, 10, "cc-by,gpl,reserved")
    assert got[2].labels == "mit" and got[2].score == 1.0 and got[2].n_base == 0 and got[2].first_word is None
    assert got[3].labels == "" and got[3].score == 0.0
    assert got[4].labels == "gpl,gpl-3.0"


def test_licenses_against_a_search_for_whole_notices():
    rng = random.Random(9)
    index = licenses.Index()
    say = lambda n: [("".join(rng.choice("abcdefg") for _ in range(5))).encode() for _ in range(n)]
    for label, notice, phrases in licenses.TEMPLATES:
        own = licenses.words_of(notice)
        before = say(rng.randint(0, 60))
        for change in ("whole", "put in", "left out"):
            body = list(own)
            inside = {i for p in phrases for n in [licenses.words_of(p)] for k in range(len(own) - len(n) + 1) if own[k : k + len(n)] == n for i in range(k, k + len(n))}
            free = [i for i in range(2, len(own)) if i not in inside and i - 1 not in inside]
            if change != "whole" and (len(own) < 12 or not free):
                continue
            if change == "put in":
                body.insert(free[0], b"zzz")
            elif change == "left out":
                del body[free[0]]
            text = b" ".join([*before, *body, *say(40)]).decode()
            spans = index.scan(text)["spans"]
            found = {x["label"] for x in spans}
            assert label in found
            if change == "whole":
                assert any(x["label"] == label and x["coverage"] == 1.0 and x["start"] == len(before) for x in spans)
            # brute force: notices that stand word for word are all told
            joined = " " + " ".join(w.decode() for w in licenses.words_of(text)) + " "
            assert {t[0] for t in licenses.TEMPLATES if " " + " ".join(w.decode() for w in licenses.words_of(t[1])) + " " in joined} <= found
    assert index.scan(" ".join(w.decode() for w in say(400)))["spans"] == []
    assert [x["label"] for x in index.scan("// SPDX-License-Identifier: BSD-3-Clause")["spans"]] == ["bsd-3-clause"]


def test_license_odd_rows(spark):
    docs = odd_rows(spark)
    got = licenses.summary(licenses.scan(docs))
    assert got.count() == docs.count() and got.where("n_words = 0").count() == 4
    assert licenses.scan(docs.limit(0)).count() == 0


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="site-header">Logo</div>
<div class="post-{n}"><h1>T &amp; x</h1><p>One <a href=x>two</a>
 three<br>four &am<ul><li>a<li>b</ul><div class="comments"><p>Nice!</p></div><form>q</form><p>Last < 5 &nbsp; ok<span class=ad>BUY</span> end<p>More of the same running text, so that this part is the longest.</div>
<aside>s</aside><footer>&copy; f</footer></body></html>"""
TEXT = "T & x\nOne two three four &am\na\nb\nLast < 5 ok end\nMore of the same running text, so that this part is the longest."


def test_html_pages(spark):
    rows = [(i, f"http://WWW.h.org:80/{i}", PAGE.replace("{n}", str(i)), "t", 1) for i in range(4)]
    rows += [(7, None, None, "", 0), (7, "no url", "", "", 0), (None, "http://h.org/", "just text", "", 0), (8, "http://x/", "<p>cut <b", "", 0), (9, "http://y/", "<p>a<script>never closed", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert [r.text for r in got if r.page_id is not None and r.page_id < 4] == [TEXT] * 4
    assert sorted(r.text for r in got if r.page_id == 7) == ["", ""]
    assert {r.page_id: r.text for r in got if r.page_id in (None, 8, 9)} == {None: "just text", 8: "cut", 9: "a"}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


def test_html_votes_by_generalised_path(spark):
    rows = spark.createDataFrame([("http://www.h.org/1", PAGE.replace("{n}", "17")), ("http://h.org/2", PAGE.replace("{n}", "4"))], "url string, html string")
    assert [(r.host, r.paths[0]) for r in html.host_paths(rows).collect()] == [("h.org", "/html/body/div.post-0")]


def test_html_deep_and_odd_markup():
    assert html.Page("<div>" * 3000 + "x").text([]) == "x"
    assert html.Page("<a '>" * 2000 + "x").text([]).endswith("x")
    assert html.Page("a<!-- b").text([]) == "a"


def made_pages(seed):
    """(page_id, url, html, text): pages of several hosts' layouts, with the article that was put in."""
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    paras = lambda k, n: [say(rng.randint(n, 2 * n)) for _ in range(k)]
    tagged = lambda tag, xs: "".join(f"<{tag}>{x}</{tag}>" for x in xs)
    out = []
    for i in range(24):
        nav = "<nav><a href=/>" + say(3) + "</a></nav><div class=cookie-notice>" + say(9) + "</div>"
        side = '<div class="sidebar">' + tagged("p", paras(2, 9)) + "</div>"
        talk = '<div id="comments">' + "".join(f'<article class="comment"><p>{x}</p></article>' for x in paras(rng.randint(0, 12), 30)) + "</div>"
        foot = "<footer>" + say(8) + "</footer>"
        h, lead, body, more = say(4), paras(1, 12), paras(rng.randint(3, 6), 30), paras(3, 8)
        pages = {
            "a.org": (f'{nav}<div class="page has-sidebar"><h1>{h}</h1><div class="lead">{tagged("p", lead)}</div><div class="story">{tagged("p", body)}</div>{side}</div>{talk}{foot}', [h, *lead, *body]),
            "b.org": (f'{nav}<div class="social-science-post"><h1>{h}</h1>{tagged("p", body)}</div><div class="related-posts">{tagged("p", lead)}</div>{talk}{foot}', [h, *body]),
            "c.org": (f'{nav}<div id=wrap><article><h1>{h}</h1>{tagged("p", lead)}<section>{tagged("p", body)}</section><section>{tagged("p", more)}</section></article>{side}</div>{foot}', [h, *lead, *body, *more]),
            "d.org": (f'{nav}<article><h1>{h}</h1>{tagged("p", lead)}<ul>{tagged("li", body)}</ul>{tagged("p", more)}</article>{talk}{foot}', [h, *lead, *body, *more]),
        }
        for host, (html_text, want) in pages.items():
            out.append((len(out), f"https://www.{host}/{i}", f"<!DOCTYPE html><html><head><title>{h}</title></head><body>{html_text}</body></html>", "\n".join(want)))
    return out


def test_main_text_is_the_article_that_was_put_in(spark):
    rows = made_pages(3)
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    wrong = [(url, got[i], want) for i, url, _, want in rows if got[i] != want]
    assert not wrong, (len(wrong), wrong[0])
