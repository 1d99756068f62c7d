"""Incremental pick-up of new workbooks (an extension: inspections themselves are batch jobs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..options import InspectionOptions
from ..plans.inspection import Inspection, inspect_relations
from ..sources import xlsx


def watch_workbooks(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[Inspection, int], None], options: InspectionOptions | None = None, once: bool = True):
    """Inspect each batch of new files and hand over its relations; files are taken up once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        records = xlsx.parsed(batch, strict=False).persist()
        try:
            handle(inspect_relations(*xlsx.relations(records), options), number)
        finally:
            records.unpersist()

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
