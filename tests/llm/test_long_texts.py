"""Texts of 10^5 repeats of what a pattern repeats, coreference of names, and clashing column names."""

import re

import pytest

from siltstone.llm import decontaminate, pii, quality

N = 100_000
LONG = [
    "a@b" + ".c" * N, "1," * N + "1", "1." * N, "a" + " " * N + "b", "a" + "\t\n" * N + "b", " " * N, "Mr " + "X" * N, "Mr X" + "-Y" * N, "Mr " + "X " * N, "1 " * N, "+1 " * N,
    "1.2.3." * N, "4" * N, "4444-" * N, "DE89 " * N, "password: '" + "a" * N + "'", "AKIA" * N, "@" * N, "a@" * N, "(1) " * N, "km " * N, "1km" * N, "Aa " * N, "%€ 1" * N, "'" * N, "\n" * N, "é" * N,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(LONG)], "doc_id long, text string, lang string, source string")


def test_surrogates_of_long_texts(docs):
    got = {r.doc_id: r.text for r in pii.replaced(docs, "key", count_col="n").collect()}
    assert len(got) == len(LONG)
    assert re.fullmatch(r"[a-z]@[a-z](\.[a-z])+\.c", got[0])
    assert len(got[0]) == len(LONG[0])
    assert got[3] == LONG[3]
    assert got[4] == LONG[4]


def test_quality_of_long_texts(docs):
    got = {r.doc_id: r for r in quality.measured(docs).select("doc_id", "n_words", "word_chars", "n_dup_lines").collect()}
    for i, text in enumerate(LONG):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got[i].n_words, got[i].word_chars) == (len(words), sum(map(len, words)))


def test_decontamination_of_long_texts(spark, docs):
    items = spark.createDataFrame([(1, "what is the sum of 12 km and 15 km in meters"), (2, "1,1,1,1"), (3, "1," * 5000 + "1")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(500, "x " * N + "what is the sum of 13 km and 19 km in meters", "en", "web"), (501, "so 1,1,1,1 it is", "en", "web")], docs.schema))
    got = {r.doc_id: r.contaminated for r in decontaminate.judged(more, items).collect()}
    assert len(got) == len(LONG) + 2
    assert got[500]
    assert not got[0]


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Dr Maria Lopez met us. Mrs Maria Lopez spoke. Maria left.", r"Dr ([\w-]+) ([\w-]+) met us\. Mrs \1 \2 spoke\. \1 left\."),
        ("Mr John Smith came. Mr John sat. John left.", r"Mr ([\w-]+) ([\w-]+) came\. Mr \1 sat\. \1 left\."),
        ("Prof Kim Stone spoke, Ms Stone listened, Kim and Stone left.", r"Prof ([\w-]+) ([\w-]+) spoke, Ms \2 listened, \1 and \2 left\."),
    ],
)
def test_one_person_has_one_name(spark, text, form):
    (row,) = pii.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").collect()
    found = re.fullmatch(form, row.text)
    assert found
    assert found[1] != found[2]
    assert not set(found.groups()) & set(re.findall(r"\w+", text))


def test_the_gender_of_any_title_holds_for_all_mentions(spark):
    texts = ["Dr Maria Lopez met us. Mrs Maria Lopez spoke.", "Mr Robin Day, Mrs Robin Day"]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert re.match(r"Dr ([\w-]+)", got[0])[1].split("-")[0] in pii._GIVEN["f"]["Latin"].split()
    assert re.match(r"Mr ([\w-]+)", got[1])[1].split("-")[0] in pii._GIVEN["n"]["Latin"].split()


def test_columns_of_any_name_stay(spark):
    rows = [(i, "some plain words of this text stand here and there again " * 2 + str(i), "en", "web", f"w{i}", f"l{i}", f"s{i}", 7, "row") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string, _lang string, _source string, _salt int, whole string")
    stats = quality.measured(docs)
    got = quality.judged(stats, quality.fitted(stats)).select(docs.columns).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == rows


def test_an_id_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "what is the sum of 12 km and 15 km in meters"), (2, "nothing")], "key long, text string")
    items = spark.createDataFrame([(1, "what is the sum of 12 km and 15 km in meters")], "item_id long, text string")
    assert {r.key: r.contaminated for r in decontaminate.judged(docs, items, "key").collect()} == {1: True, 2: False}
