"""Bounded excerpts of nested values: long texts, lists and mappings cut, deep ones told by their shape, with marks of what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.settle import settled

# Bounds, and the marks of what goes beyond them.
TEXT, ITEMS, KEYS, DEPTH = 200, 10, 20, 10
CUT_TEXT = "... [truncated]"
CUT_ITEMS, CUT_KEYS, KEY_OF_CUT = "... [omitted: {} more]", "[omitted: {} more]", "__omitted__"
DEEP = {"map": "[omitted: mapping with {}]", "list": "[omitted: sequence with {}]"}


def _counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def _told(form: str, n: Column, noun: str) -> Column:
    before, after = form.split("{}")
    return F.concat(F.lit(before), _counted(n, noun), F.lit(after))


def bounded(nodes: DataFrame, base: int, text: int = TEXT, items: int = ITEMS, keys: int = KEYS, depth: int = DEPTH) -> DataFrame:
    """(template_id, path, vtype, sval) of the values at the paths of `base` steps in a node table, each as a bounded tree.

    Of a list the first `items` stay, of a mapping the first `keys` in the order of the source, and one more entry tells how many
    more there are; a list or mapping `depth` steps below a value is a text that tells its size; texts are cut. What stands
    below an entry that goes, goes with it. Scalars that are no texts stay as they are; errors and null paths are left out.

    A table with the places of its nodes is taken row by row: nothing is moved or kept. Of one without, places are settled first.
    """
    size = F.size("path")
    within = (F.col("vtype") != "error") & (size >= base)
    kept = (_in_place if "places" in nodes.columns else _by_parents)(nodes.where(within).withColumn("deep", size - base), base, items, keys, depth)
    container = F.col("vtype").isin(*DEEP)
    low = container & (F.col("deep") == depth)
    shape = F.when(F.col("vtype") == "map", _told(DEEP["map"], F.col("n"), "key")).otherwise(_told(DEEP["list"], F.col("n"), "item"))
    short = F.when((F.col("vtype") == "str") & (F.length("sval") > text), F.concat(F.substring("sval", 1, text), F.lit(CUT_TEXT))).otherwise(F.col("sval"))
    over = F.col("n") - F.when(F.col("vtype") == "map", keys).otherwise(items)
    last = F.when(F.col("vtype") == "map", KEY_OF_CUT).otherwise(str(items))
    said = F.when(F.col("vtype") == "map", _told(CUT_KEYS, over, "key")).otherwise(_told(CUT_ITEMS, over, "item"))
    own = F.struct("path", F.when(low, "str").otherwise(F.col("vtype")).alias("vtype"), F.when(low, shape).otherwise(short).alias("sval"))
    mark = F.struct(F.concat("path", F.array(last)).alias("path"), F.lit("str").alias("vtype"), said.alias("sval"))
    return kept.select("template_id", F.inline(F.when(container & ~low & (over > 0), F.array(own, mark)).otherwise(F.array(own))))


def _in_place(rows: DataFrame, base: int, items: int, keys: int, depth: int) -> DataFrame:
    """(template_id, path, vtype, sval, deep, n) of the nodes that stay, by the places of their steps."""
    below = F.slice("places", base + 1, depth)
    stays = (F.coalesce(F.array_max(below), F.lit(-1)) < keys) & (F.coalesce(F.array_min(below), F.lit(0)) >= -items)
    return rows.where((F.col("deep") <= depth) & stays).select("template_id", "path", "vtype", "sval", "deep", F.col("entries").alias("n"))


def _by_parents(rows: DataFrame, base: int, items: int, keys: int, depth: int) -> DataFrame:
    """The same of a table without places: nodes are numbered under their parents, and cuts looked for among the places above a node, by equality."""
    size = F.size("path")
    rows = settled(rows.where(F.col("deep") <= depth + 1).select("template_id", "path", "vtype", "sval", "ord", "deep", F.slice("path", 1, size - 1).alias("parent")))
    inside = Window.partitionBy("template_id", "parent").orderBy("ord")
    ranked = rows.where("deep > 0").withColumn("rank", F.row_number().over(inside))
    counts = ranked.groupBy("template_id", F.col("parent").alias("path")).agg(F.max("rank").alias("n"))
    most = F.when(F.col("kind") == "map", keys).otherwise(items)
    kinds = rows.where("vtype in ('map', 'list')").select("template_id", F.col("path").alias("parent"), F.col("vtype").alias("kind"))
    cut = settled(ranked.where(F.col("rank") > min(items, keys)).join(kinds, ["template_id", "parent"]).where(F.col("rank") > most).select("template_id", F.col("path").alias("up")))
    kept = rows.where(F.col("deep") <= depth)
    if cut.take(1):
        above = F.explode(F.transform(F.sequence(F.lit(base), size), lambda n: F.slice("path", 1, n)))
        gone = kept.where(F.col("deep") > 0).select("template_id", "path", above.alias("up")).join(cut, ["template_id", "up"], "left_semi").select("template_id", "path").distinct()
        kept = kept.join(gone, ["template_id", "path"], "left_anti")
    kept = kept.join(counts, ["template_id", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return kept.select("template_id", "path", "vtype", "sval", "deep", "n")
