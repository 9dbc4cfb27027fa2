"""Benchmark decontamination by templates, in DataFrame functions alone.

Numbers, units after numbers, and names become typed placeholders; hashes of windows of the remaining words are joined
with those of the benchmark items. Windows of one distance between their places in text and item make a run; a run counts
if its slots are filled consistently: one value of the item always stands for one value of the text, and the other way
round. A text leaks an item if, within a stretch of four times the item's length, runs that count cover enough of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settled

#: Words of a window; shorter items have one window of their own length. Below FEW words it matches as it stands only.
WINDOW, FEW = 8, 4
#: Share of a window's words that must not be placeholders for it to match by its template; others match as they stand.
LITERAL = 0.5
#: Share of an item's words that must be covered by windows.
COVERAGE = 0.5
#: Windows of the benchmark, at most, that are sent to every executor (about 32 bytes each); more are joined by shuffle.
SENT = 1_000_000
#: Texts, at most, whose keys are sent to every executor to pick them for the slot check; more are joined by shuffle.
PICKED = 2_000_000

# Units that are a slot after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yards kg g mg lb lbs pounds oz tons ton l ml liter liters litre litres gal gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollars dollar usd euros euro eur cents cent percent kmh mph kw kwh w v hz degrees"
).split()
#: Placeholders: number, unit, name; private code points, taken out of texts first.
_SLOTS = ("\ue000", "\ue001", "\ue002")
_JOIN = "\ue003"
#: The type of a text's windows.
ARRAY = "array<struct<hash:bigint,place:int,n:int,exact:boolean>>"
_NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
_UNIT = "\ue000[ -]?(?:(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])|[%°€$£])"
_NAME = r"(?<=[\p{L}\p{N},;:)\"] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "".join(_SLOTS) + _JOIN, "    ")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}\ue000-\ue003]+"), lambda x: x != "")


def template(text: Column) -> Column:
    """The words of a text with placeholders for numbers, units and names, in lower case."""
    clean = _clean(text)
    numbered = F.regexp_replace(F.regexp_replace(clean, _NUMBER, f" {_SLOTS[0]} "), _SLOTS[0] + " ([ -]?)(?=[\\p{L}%°€$£])", _SLOTS[0] + "$1")
    measured = F.regexp_replace(F.regexp_replace(numbered, _UNIT, f" {_SLOTS[0]} {_SLOTS[1]} "), _SLOTS[0], f" {_SLOTS[0]} ")
    out = F.when(clean.rlike(r"\p{N}"), measured).otherwise(clean)
    return _split(F.lower(F.regexp_replace(out, _NAME, _SLOTS[2])))


def surface(text: Column) -> Column:
    """The words that template() has, as they stand in the text, in lower case: its slots' values."""
    whole = F.regexp_replace(_clean(text), r"(?<=\p{N})[.,](?=\p{N})", _JOIN)  # a decimal stays one word
    apart = F.regexp_replace(whole, r"(?<=[^\p{N}\ue003])(?=\p{N})|(?<=\p{N})(?=[^\p{N}\ue003])", " ")
    signs = F.regexp_replace(apart, r"(?<=\p{N} )[ -]?([%°€$£])", " " + _SLOTS[1] + " ")
    return _split(F.lower(signs))


def _windows(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    return F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice(words, k, n)))).when(last == 1, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), use)[0]


def _key(df: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(df[id_col], F.coalesce(df[text_col].cast("string"), F.lit("")))


def _covered(spans: Column) -> Column:
    """How many words windows (at, n), in order, cover."""
    step = lambda acc, x: F.struct((x["at"] + x["n"]).alias("end"), (acc["sum"] + F.least(x["n"], x["at"] + x["n"] - acc["end"])).alias("sum"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), step)["sum"]


def index(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, n, item, at, size, slotted, exact, numbered, coverable): windows of the items.

    The hash is of the template, or for windows of few words that are no placeholders, and of short items, (exact) of the surface.
    An item's first word counts as it stands and, in capitals, as the name that it looks
    like further on in a text. coverable: how many words the windows that match by template cover.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    items = items.withColumn("words", template(F.col("text"))).withColumn("size", F.size("words")).where(F.col("size") > 0)
    items = items.withColumn("n", F.least(F.col("size"), F.lit(window))).withColumn("faces", surface(F.col("text")))
    literals = lambda words: F.size(F.filter(words, lambda x: ~x.isin(*_SLOTS)))
    spans = F.transform(F.sequence(F.lit(0), F.col("size") - F.col("n")), lambda k: F.struct(k.alias("at"), F.col("n").alias("n")))
    items = items.withColumn("coverable", _covered(F.filter(spans, lambda x: (F.col("n") >= FEW) & (literals(F.slice("words", x["at"] + 1, F.col("n"))) >= LITERAL * F.col("n")))))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("n"))))
    own = F.slice("words", F.col("at") + 1, F.col("n"))
    named = (F.col("at") == 0) & F.col("text").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}+(?![\p{L}\p{N}])")
    forms = F.when(named, F.array(own, F.concat(F.array(F.lit(_SLOTS[2])), F.slice("words", 2, F.col("n") - 1)))).otherwise(F.array(own))
    at = at.withColumn("own", F.explode(forms)).withColumn("exact", (F.col("n") < FEW) | (literals(F.col("own")) < LITERAL * F.col("n")))
    slotted = F.exists("words", lambda x: x.isin(*_SLOTS))
    shown = F.when(F.col("exact"), F.xxhash64(F.slice("faces", F.col("at") + 1, F.col("n")))).otherwise(F.xxhash64("own"))
    return at.select(shown.alias("hash"), "n", "item", "at", "size", slotted.alias("slotted"), "exact", F.array_contains("own", _SLOTS[0]).alias("numbered"), "coverable")


def _best(hits: DataFrame) -> DataFrame:
    """(key, item, slotted, coverage): how much of the item the windows within one stretch of the text cover, at most.

    Stretches of four times the item's length begin at every second length. Coverage is of the item by all windows that
    match, or by those that match by template of what such windows can cover.
    """
    begins = F.floor(F.col("place") / (2 * F.col("size")))
    near = hits.withColumn("stretch", F.explode(F.array(begins, begins - 1)))
    spans = F.array_sort(F.collect_set(F.struct("at", "n")))
    formed = F.array_sort(F.collect_set(F.when(~F.col("exact"), F.struct("at", "n"))))
    found = near.groupBy("key", "item", "stretch").agg(spans.alias("spans"), formed.alias("formed"), *[F.max(c).alias(c) for c in ("size", "coverable", "slotted")])
    covered = F.greatest(_covered(F.col("spans")) / F.col("size"), F.when(F.col("coverable") > 0, F.least(F.lit(1.0), _covered(F.col("formed")) / F.col("coverable"))))
    return found.withColumn("coverage", covered).groupBy("key", "item").agg(F.max("slotted").alias("slotted"), F.max("coverage").alias("coverage"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(key, item, coverage) for every text and item that it leaks; key is xxhash64(id, text), null text as empty.

    Texts and items are taken whole, and all items with a word are sought: those of under FEW words, and windows mostly of
    numbers, units and names, where they stand word for word. Texts shorter than every item, empty and null ones leak
    nothing, null and empty items are leaked by none. Repeated rows share their key; ids of texts and items are of any
    type; empty tables give no rows; other columns are not read.
    """
    sought = settled(index(benchmark, item_col, "text", window))
    few = sought.count() <= SENT
    text = docs[text_col].cast("string")
    lengths = sorted((r[0], r[1]) for r in sought.select("exact", "n").distinct().collect())  # at most `window` of either kind
    formed, exact = ([n for e, n in lengths if e == kind] for kind in (False, True))
    # as they stand, texts are read for windows of few words only; with numbers alone sought, only texts with a number
    as_is = F.lit(bool(exact)) if sought.where("exact and not numbered").take(1) else F.lit(bool(exact)) & text.rlike(r"\p{N}")
    words = docs.select(_key(docs, id_col, text_col).alias("key"), template(docs[text_col]).alias("words"), *([F.when(as_is, surface(docs[text_col])).alias("faces")] if exact else []))
    each = lambda c, n, e: F.transform(_windows(F.col(c), n), lambda h, i: F.struct(h.alias("hash"), i.alias("place"), F.lit(n).alias("n"), F.lit(e).alias("exact")))
    made = [each("words", n, False) for n in formed or [window]]
    made += [F.coalesce(each("faces", n, True), F.expr("array()").cast(ARRAY)) for n in exact]
    windows = words.select("key", F.explode(F.concat(*made)).alias("w")).select("key", "w.*")
    own = sought.drop("numbered").distinct()
    hits = windows.join(F.broadcast(own) if few else own, ["hash", "n", "exact"])
    hits = settled(hits.select("key", "item", "place", "at", "n", "size", "slotted", "exact", "coverable").distinct())
    found = settled(_best(hits).where(F.col("coverage") >= coverage))
    plain, slotted = found.where(~F.col("slotted")), found.where("slotted")

    # slots: only texts that match an item with slots are read again
    need = settled(slotted.select("key").distinct())
    need = F.broadcast(need) if need.count() <= PICKED else need
    texts = docs.select(_key(docs, id_col, text_col).alias("key"), docs[text_col].alias("text")).join(need, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = texts.select("key", surface(F.col("text")).alias("theirs"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text")).distinct().select("item", template(F.col("text")).alias("form"), surface(F.col("text")).alias("ours"))
    shift = (F.col("place") - F.col("at")).alias("shift")
    of_slotted = settled(hits.where("slotted").join(slotted.select("key", "item"), ["key", "item"]).select("*", shift))
    run = of_slotted.groupBy("key", "item", "shift").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("n")).alias("to"))
    run = run.join(texts, "key").join(items, "item")
    slots = F.filter(F.transform(F.sequence(F.col("from"), F.col("to") - 1), lambda k: F.when(F.get("form", k).isin(*_SLOTS), F.struct(F.get("ours", k).alias("a"), F.get("theirs", k + F.col("shift")).alias("b")))), lambda x: x.isNotNull())

    def consistent(x: Column) -> Column:
        pairs = F.size(F.array_distinct(x))
        return (pairs == F.size(F.array_distinct(x["a"]))) & (pairs == F.size(F.array_distinct(x["b"])))

    kept = run.where(_bound(slots, consistent)).select("key", "item", "shift").distinct()
    filled = _best(of_slotted.join(kept, ["key", "item", "shift"])).where(F.col("coverage") >= coverage)
    return plain.select("key", "item", "coverage").unionByName(filled.select("key", "item", "coverage"))


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row a row of docs: the id, contaminated, n_items, item_id (of the largest coverage, then the least) and coverage.

    Null and empty texts are clean; repeated rows are judged alike; ids are of any type and may be null; an empty table of
    texts gives no rows, one of items no contaminated ones.
    """
    best = F.min(F.struct((-F.col("coverage")).alias("order"), "item"))
    found = leaks(docs, benchmark, id_col, text_col, item_col).groupBy("key").agg(F.countDistinct("item").alias("n_items"), best.alias("best"))
    rows = docs.select(docs[id_col].alias("id"), _key(docs, id_col, text_col).alias("key")).join(found, "key", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best")["item"].alias("item_id"), (-F.col("best")["order"]).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that leak no item, as they are, null and empty texts among them; columns may have any names."""
    free = next(n for n in ("_leak" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    found = leaks(docs, benchmark, id_col, text_col, item_col).select(F.col("key").alias(free)).distinct()
    return docs.join(found, _key(docs, id_col, text_col) == F.col(free), "left_anti")
