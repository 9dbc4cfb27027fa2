"""Records of reviews: paths, what must not be shown, canonical digests, comparable reports, files that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules that tell of credentials, and what a text that must not be shown is replaced by.
CREDENTIAL_RULES = ("W1011", "W2501")
HIDDEN = "[REDACTED]"
NOTICE = "The Excerpt for this evidence was redacted before reporting because {}; the Template text at this location is not reproduced."
REASONS = {"credential_rule": "a credential-detection rule (W1011, W2501) reported this location", "no_echo_parameter": "the location references a Parameter declared NoEcho: true"}


def output_path(path: Column) -> Column:
    """struct(path, refused): a relative path with single slashes and no empty step, or why it is refused.

    Refused are, in this order, absolute paths and drives, empty ones, and those that climb; null is empty.
    """
    text = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(text, "/"), lambda s: ~s.isin("", "."))
    first = F.coalesce(F.get(steps, F.lit(0)), F.lit(""))
    refused = F.when(text.startswith("/") | first.endswith(":"), "absolute").when(F.size(steps) == 0, "empty").when(F.array_contains(steps, ".."), "climbs")
    return F.struct(F.when(refused.isNull(), F.array_join(steps, "/")).alias("path"), refused.alias("refused"))


def redacted(evidence: DataFrame, silent: DataFrame) -> DataFrame:
    """evidence with trigger and its excerpt replaced where there is one.

    evidence: template_id, id, rule_id, place (slash-joined), excerpt; silent: template_id, name of the parameters that must
    not be shown. A credential rule comes first; else a place within such a parameter, or an excerpt that says its name as
    a whole word, is the parameter's. Null excerpts stay null. Where evidence has a column detail, a notice is added to it once
    if the excerpt is withheld.
    """
    whole = F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), F.col("name"), F.lit(r"\E(?![0-9A-Za-z_])"))
    within = F.startswith(F.concat("place", F.lit("/")), F.concat(F.lit("Parameters/"), F.col("name"), F.lit("/")))
    met = evidence.join(silent.select("template_id", "name").distinct(), "template_id")
    told = met.where(F.coalesce(within, F.lit(False)) | F.coalesce(F.rlike("excerpt", whole), F.lit(False))).select("id", F.lit(True).alias("_told")).distinct()
    trigger = F.when(F.col("rule_id").isin(*CREDENTIAL_RULES), "credential_rule").when(F.col("_told"), "no_echo_parameter").otherwise("none")
    out = evidence.join(told, "id", "left").withColumn("trigger", trigger)
    hides = (F.col("trigger") != "none") & (F.col("excerpt") != "") & (F.col("excerpt") != HIDDEN)
    if "detail" in evidence.columns:
        notice = F.coalesce(*[F.when(F.col("trigger") == t, NOTICE.format(why)) for t, why in REASONS.items()])
        added = F.when(F.coalesce(F.trim("detail"), F.lit("")) == "", notice).when(F.contains("detail", notice), F.col("detail")).otherwise(F.concat("detail", F.lit(" "), notice))
        out = out.withColumn("detail", F.when(hides, added).otherwise(F.col("detail")))
    return out.withColumn("excerpt", F.when(hides, HIDDEN).otherwise(F.col("excerpt"))).drop("_told")


def canonical(fields: Column) -> Column:
    """The canonical JSON text of a map of texts: keys in order, no blanks; null values stay null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})


def digest(fields: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(fields), 256)


def summaries_comparable(tools: DataFrame, errors: DataFrame) -> DataFrame:
    """(pair, comparable): whether the summaries of two reports may be compared.

    tools: pair, side (base or head), name, available, version; errors: pair. Any error, any tool that is not there, and any
    difference in the tools or their versions forbid it; a pair without tools and errors may be compared.
    """
    sides = tools.groupBy("pair", "name").agg(F.bool_and("available").alias("there"), F.count_if(F.col("side") == "base").alias("b"), F.count_if(F.col("side") == "head").alias("h"), *[F.max(F.when(F.col("side") == s, F.col("version"))).alias(s) for s in ("base", "head")])
    same = F.col("there") & (F.col("b") > 0) & (F.col("h") > 0) & F.col("base").eqNullSafe(F.col("head"))
    by = sides.groupBy("pair").agg(F.bool_and(same).alias("same"))
    bad = errors.select("pair", F.lit(True).alias("bad")).distinct()
    return by.join(bad, "pair", "full").select("pair", (F.coalesce("same", F.lit(True)) & F.col("bad").isNull()).alias("comparable"))


def corresponding(pairs: DataFrame, targets: DataFrame, named: DataFrame, resources: DataFrame) -> DataFrame:
    """(pair, correspondence) of templates and reports, by name only.

    pairs: pair, declared, readable, base_file, head_file; targets: pair, side, file of the reports; named: pair, side, file,
    resource of their findings; resources: pair, side, resource of the templates. Without a declared pair "not_applicable",
    with an unreadable template "unknown", with a file that its report did not review, or a finding on it of a resource that
    its template lacks, "inconsistent", else "consistent_by_name_only".
    """
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("base").alias("side"), output_path(F.col("base_file"))["path"].alias("file")), F.struct(F.lit("head").alias("side"), output_path(F.col("head_file"))["path"].alias("file")))).alias("s")).select("pair", "s.*")
    reviewed = sides.join(targets.select("pair", "side", "file", F.lit(True).alias("reviewed")).distinct(), ["pair", "side", "file"], "left")
    strange = named.where(F.col("resource").isNotNull()).join(resources, ["pair", "side", "resource"], "left_anti").select("pair", "side", "file", F.lit(True).alias("strange")).distinct()
    sound = reviewed.join(strange, ["pair", "side", "file"], "left").groupBy("pair").agg(F.bool_and(F.col("reviewed").isNotNull() & F.col("strange").isNull()).alias("sound"))
    told = F.when(~F.col("declared"), "not_applicable").when(~F.col("readable"), "unknown").when(F.col("sound"), "consistent_by_name_only").otherwise("inconsistent")
    return pairs.join(sound, "pair").select("pair", told.alias("correspondence"))


def file_states(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of recorded files (path, digest) against those found: MATCH, CHANGED, SOURCE_MISSING, APPEARED_AFTER_MAPPING."""
    now = found.select("path", F.col("digest").alias("_now"))
    status = F.when(F.col("_now").isNull(), "SOURCE_MISSING").when(F.col("digest").isNull(), "APPEARED_AFTER_MAPPING").when(F.col("_now") == F.col("digest"), "MATCH").otherwise("CHANGED")
    return recorded.join(now, "path", "left").select("path", status.alias("status"))
