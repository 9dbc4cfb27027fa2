"""Quoted clauses against the texts that they are quoted from: found once, apart from each other, nothing left out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

try:
    import ahocorasick
except ModuleNotFoundError:  # each clause is then looked for by itself
    ahocorasick = None

#: Clauses of a text that one pass looks for; more are dealt to passes of their own.
BLOCK = 4096
#: What a text may have outside of its clauses.
SPARED = " \t\n|-*;,.:"


def _found(text: str, clauses: list[str]) -> list[tuple[int, int]]:
    """(number, first place) of each clause in the text, as often as it stands there without overlapping itself; in one pass."""
    if ahocorasick is None:
        return [(text.count(c) if c else 0, text.find(c) if c else -1) for c in clauses]
    search = ahocorasick.Automaton()
    for i, c in enumerate(clauses):
        if c:
            search.add_word(c, (*search.get(c, ()), i))
    first, ends, n = [-1] * len(clauses), [0] * len(clauses), [0] * len(clauses)
    if len(search):
        search.make_automaton()
        for last, which in search.iter(text):
            begin = last + 1 - len(clauses[which[0]])
            for i in which:
                if begin >= ends[i]:
                    first[i], ends[i], n[i] = first[i] if n[i] else begin, last + 1, n[i] + 1
    return list(zip(n, first, strict=True))


def placed(texts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(source, clause, n, begin, end): how often each clause (source, clause, quoted) stands in the text of its source (source, text),
    and its place in code points if that is once; n is null where there is no such text.

    A clause that is empty or null stands nowhere. Texts of any length are taken whole; the clauses of a text are looked for
    BLOCK at a time, so no task holds all of them.
    """
    counted = clauses.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = clauses.join(counted, "source").withColumn("block", F.pmod(F.xxhash64("clause"), F.col("blocks")))
    lists = rows.groupBy("source", "block").agg(F.collect_list(F.struct("clause", F.coalesce("quoted", F.lit("")).alias("quoted"))).alias("clauses"))
    kind = {c: clauses.schema[c].dataType.simpleString() for c in ("source", "clause")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for source, text, own in zip(*(batch.column(c).to_pylist() for c in ("source", "text", "clauses")), strict=True):
                for c, (n, begin) in zip(own, _found(text or "", [c["quoted"] for c in own]), strict=True):
                    out.append((source, c["clause"], n, begin if n == 1 else None, begin + len(c["quoted"]) if n == 1 else None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [batch.schema.field("source").type, batch.schema.field("clauses").type.value_type.field("clause").type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source", "clause", "n", "begin", "end"])

    found = lists.join(texts.select("source", "text"), "source").select("source", "text", "clauses").mapInArrow(run, f"source {kind['source']}, clause {kind['clause']}, n bigint, begin bigint, end bigint")
    absent = clauses.join(texts.select("source"), "source", "left_anti").select("source", "clause", *[F.lit(None).cast("bigint").alias(c) for c in ("n", "begin", "end")])
    return found.unionByName(absent)


def overlaps(places: DataFrame) -> DataFrame:
    """(source, clause, other): clauses of placed() that begin before the one next before them in their text ends."""
    own = Window.partitionBy("source").orderBy("begin", "end", "clause")
    rows = places.where("n = 1").withColumns({"other": F.lag("clause").over(own), "ended": F.lag("end").over(own)})
    return rows.where("begin < ended").select("source", "clause", "other")


def left_over(texts: DataFrame, places: DataFrame, spared: str = SPARED) -> DataFrame:
    """(source, n_gaps, left): the gaps of each text (source, text) between its placed() clauses, and what stands in them but for the spared
    characters, joined by one blank a gap. Gaps lie apart, so a text has no more of them than characters; they are found by the furthest
    end so far, without marking characters. Null texts are empty."""
    length = F.length(F.coalesce("text", F.lit("")))
    ends = texts.select("source", length.cast("bigint").alias("begin"), length.cast("bigint").alias("end"))
    spans = places.where("n = 1").select("source", "begin", "end").unionByName(ends)
    before = Window.partitionBy("source").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("begin") > F.col("from"))
    gaps = gaps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("from"), F.col("begin").alias("to")))).alias("gaps"))
    rows = texts.select("source", F.coalesce("text", F.lit("")).alias("text")).join(gaps, "source", "left")
    said = F.transform("gaps", lambda g: F.translate(F.substr("text", (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")), spared, ""))
    left = F.array_join(F.filter(said, lambda s: s != ""), " ")
    return rows.select("source", F.coalesce(F.size("gaps"), F.lit(0)).alias("n_gaps"), F.coalesce(left, F.lit("")).alias("left"))
