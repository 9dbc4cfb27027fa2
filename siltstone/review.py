"""A review of templates, from texts to numbered findings and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graphs import tree_diff
from siltstone.plans.settle import settled
from siltstone.rules import findings, iam, network, properties, quality, reports, secrets
from siltstone.sources.templates import Relations, nodes, reviewable

#: Sources of findings by name; a review takes those it is asked for.
SOURCES = {"properties": properties.findings, "iam": iam.findings, "network": network.findings, "secrets": secrets.findings, "quality": quality.findings}

# Codes that runs end with.
PARSE_FAILURE, NO_REVIEWABLE = 4, 8


class Review:
    """Parses templates (template_id, text) once; what is asked for is computed from the settled node table."""

    def __init__(self, templates: DataFrame, sources: tuple[str, ...] = tuple(SOURCES)):
        self.table = settled(nodes(templates))
        self.relations = Relations(self.table)
        self.sources = sources

    def raw(self) -> DataFrame:
        """All findings of all sources."""
        return reduce(DataFrame.unionByName, (SOURCES[s](self.relations) for s in self.sources))

    def findings(self) -> DataFrame:
        """Findings merged by resource and category, numbered within each template."""
        return findings.numbered(findings.merged(self.raw()))

    def exit_status(self) -> DataFrame:
        """(review_id, exit_status): how a run over each template ends. A document that can't be read fails with PARSE_FAILURE, one
        without resources with NO_REVIEWABLE."""
        found = reviewable(self.table).join(self.relations.errors, "template_id", "left").withColumnRenamed("template_id", "review_id")
        code = F.when(F.col("error").isNotNull(), PARSE_FAILURE).when(~F.col("reviewable"), NO_REVIEWABLE).otherwise(0)
        failures = found.select("review_id", F.lit(0).alias("seq"), code.alias("code"))
        return reports.exit_status(found.select("review_id", F.col("reviewable").alias("reviewed"), F.lit(True).alias("succeeded")), failures)

    def report(self) -> DataFrame:
        """A JSON report a template."""
        return findings.report(self.findings(), self.relations.errors)

    def changes(self, head: Review) -> DataFrame:
        """(template_id, path, change) of the nodes that differ in another review's templates of equal id."""
        return tree_diff(self.table.where("vtype != 'error'"), head.table.where("vtype != 'error'"), ["template_id"])
