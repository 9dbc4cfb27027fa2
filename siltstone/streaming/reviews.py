"""Reviews of templates as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltstone.review import SOURCES, Review


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """(template_id, text) of the files that come into a folder, each once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select(F.col("path").alias("template_id"), F.col("content").cast("string").alias("text"))


def reviewed(templates: DataFrame, out: str, checkpoint: str, sources: tuple[str, ...] = tuple(SOURCES)) -> DataStreamWriter:
    """A writer of findings by batch. Findings are merged within a template, so no state outlives a batch; a batch that runs
    again after a failure overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        Review(batch, sources).findings().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return templates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
