"""Which files of a folder a review reads, in which order, and where it stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.sequences import running_cap
from siltstone.sources.templates import MAX_BYTES

#: Bytes of all files that one review reads.
MOST_IN_ALL = 50 << 20

# Suffixes of templates, in any case, folders that are not entered, and the folder of synthesized templates.
SUFFIXES = (".yaml", ".yml", ".json", ".template", ".template.json")
EXCLUDED = ("cdk.out", "node_modules", ".git", ".venv")
SYNTHESIZED = r"^cdk\.out/[^/]+\.template\.json$"


def candidates(files: DataFrame, most: int = MOST_IN_ALL, each: int = MAX_BYTES) -> DataFrame:
    """(review_id, path, grp, running, state) of the templates among files (review_id, path, length, outside), paths being relative.

    Standalone ones come first, then what was synthesized, each in the order of their paths. A file is too_large on its own; the
    review is stopped at the first whose length brings the total of all so far over `most`, and those after it are not_reached; others
    are taken. Files that resolve to a place outside of the folder, or stand in an excluded one, are no candidates.
    Lengths that are null count nothing. Totals are summed in range partitions, so no task holds all files of a review.
    """
    path = F.col("path")
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    suffix = F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    alone = suffix & ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED)))
    group = F.when(path.rlike(SYNTHESIZED), "synthesized").when(alone, "standalone")
    rows = files.where(~F.coalesce(F.col("outside"), F.lit(False))).select("review_id", "path", F.coalesce("length", F.lit(0)).alias("length"), group.alias("grp")).where("grp is not null")
    totals = running_cap(rows.withColumn("late", F.col("grp") == "synthesized"), "review_id", ["late", "path"], "length", most)
    # the total only grows: the first over it is the one that was not over before its own length
    first = ~F.col("within") & (F.col("running") - F.col("length") <= most)
    state = F.when(first, "stopped").when(~F.col("within"), "not_reached").when(F.col("length") > each, "too_large").otherwise("taken")
    return totals.select("review_id", "path", "grp", "running", state.alias("state"))


def read(spark: SparkSession, folder: str, most: int = MOST_IN_ALL) -> DataFrame:
    """(template_id, grp, state, text) of the templates under a folder that any of Spark's stores holds; text only of those that are taken.

    The folder is listed without reading contents, which are then read for the files that are taken.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), "^\\Q" + root + "\\E/", "")
    listed = candidates(files.select(F.lit(folder).alias("review_id"), relative.alias("path"), "length", F.lit(False).alias("outside")), most)
    texts = files.select(relative.alias("path"), F.col("content").cast("string").alias("text")).join(listed.where("state = 'taken'").select("path"), "path", "left_semi")
    return listed.join(texts, "path", "left").select(F.col("path").alias("template_id"), "grp", "state", "text")
