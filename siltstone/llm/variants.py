"""Spelling variants of words by pairless wildcard groups.

1. Words are counted by document in Python, which passes on sums; the counts of a word meet in Spark.
2. Words that differ in one replaced letter share the wildcard group (position, prefix, suffix), kept as the position and
   what is left of the word without that letter. A group needs its size and its two most frequent words alone: each word of
   it has size - 1 neighbours there, the best of which is the first word, or the second one for the first.
3. A word without one letter joins the vocabulary: under position 0 the word itself heads the group of those that become it
   by a deletion. It counts them and takes the best; each of them counts it.
4. Rows of a group are read in order by a window that Spark may spill; no pair of a group is made. A group has one word a
   letter at most, or one a place and letter, so none is hot however frequent its words are.
5. A word's form is five times as frequent at least, so that chains are short; they are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import settled

#: Letters of a word at least, occurrences at least, and how many times as frequent as a word its form is.
LEAST_CHARS, LEAST_N, TIMES = 6, 5, 5
#: Different words that a task holds before it passes their sums on.
HELD = 200_000

#: Runs of bytes that hold all runs of letters, and runs of letters: a-z and U+00C0 to U+00FF.
_WIDE, _LETTERS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs(text: bytes) -> Counter[bytes]:
    """The maximal runs of letters of a UTF-8 text, A-Z as a-z, with their number."""
    found = Counter(_WIDE.findall(text.lower()))
    for run in [r for r in found if not r.isascii()]:
        n = found.pop(run)
        for part in _LETTERS.findall(run):
            found[part] += n
    return found


def erased(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    chars = run.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, erase_every: int | None = None) -> DataFrame:
    """(word, n): the words of all texts that have least_chars letters and least_n occurrences at least.

    With erase_every, words are first misspelt by rule, to hold the groups against known variants: where the crc32 of
    `id:run` is a multiple of it, the run loses one letter. Null texts have no words and a null id counts as empty; repeated
    rows count each; texts of any length are taken whole; other columns are not read; an empty table has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(b"%b:" % key.as_py())
                for word, n in runs(text.as_py()).items():
                    if len(word) < least_chars:
                        continue
                    if erase_every and not (h := zlib.crc32(word, start)) % erase_every:
                        word = erased(word, h)
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield passed()
        yield passed()

    as_bytes = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    counted = docs.select(as_bytes(id_col).alias("id"), as_bytes(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    counted = counted.where(F.length("word") >= least_chars)
    return settled(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each of the distinct words (word, n), how many differ by one inserted, deleted or replaced
    code point, and the most frequent of them as (n, word), of equal ones the smallest; null if there is none."""
    at = F.explode(F.sequence(F.lit(1), F.length("word")))
    without = F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)"))
    cut = words.where(F.length("word") > 0).select("word", "n", at.alias("at")).select("at", without.alias("rest"), "word", "n")
    heads = words.select(F.lit(0).alias("at"), F.col("word").alias("rest"), "word", "n", F.lit(True).alias("head"))
    shorter = cut.where((F.col("at") == 1) | (F.expr("substring(word, at, 1) <> substring(word, at - 1, 1)")))  # of a run of one letter each deletion gives the same
    rows = cut.unionByName(shorter.withColumn("at", F.lit(0))).withColumn("head", F.lit(False)).unionByName(heads)

    group = Window.partitionBy("at", "rest")
    ordered = group.orderBy(F.desc("head"), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("head", "n", "word")
    rows = rows.select("at", "head", "word", F.count("*").over(group).alias("size"), F.nth_value(own, 1).over(ordered).alias("first"), F.nth_value(own, 2).over(ordered).alias("second"))
    best = F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first"))
    met = rows.where("size > 1 and (at > 0 or first.head)").select("word", F.when((F.col("at") == 0) & ~F.col("head"), 1).otherwise(F.col("size") - 1).alias("near"), best.alias("best"))
    # the largest n, then the smallest word
    met = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))).alias("best"))
    found = words.select("word").join(met, "word", "left")
    return found.select("word", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form (word, form): every round doubles how far a word has followed its forms."""
    current = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = settled(current.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return current


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the words (word, n).

    n_near counts the words that differ by exactly one inserted, deleted or replaced code point. The form is the most
    frequent of them (of equal ones the smallest), if it is `times` as frequent or more, else null; times is 2 at least, so
    that no word leads back to itself. The root is where the forms end, the word itself if it has none. Rows of one word count
    together, null words and counts are left out, words may have any code points and length; without words there are no rows.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word: times is 2 at least")
    words = settled(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    found = words.join(neighbours(words), "word")
    chosen = F.col("best.n") >= F.lit(times) * F.col("n")
    found = settled(found.select("word", F.when(chosen, F.col("best.word")).alias("form"), "n", "n_near", F.when(chosen, F.col("best.n")).alias("form_n")))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same over the documents: words counted with their erasures, neighbours as pairs, chains followed one by one.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([byte, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY byte) AS t
  FROM range(256) AS bytes(byte)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h FROM counted, steps),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i AS at, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.at = b.at AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
found AS (SELECT w.word, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
followed(word, root) AS (SELECT word, word FROM found UNION ALL SELECT f.word, g.form FROM followed f JOIN found g ON f.root = g.word WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM found f JOIN followed r ON f.word = r.word JOIN found e ON r.root = e.word WHERE e.form IS NULL
"""
