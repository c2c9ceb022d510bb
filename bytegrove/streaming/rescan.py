"""Watching directories of archives: newly arrived ones are listed and parsed as a stream.

The nearest thing to streaming in the model is the question whether anything changed since a scan; as a stream it is the
file source of Structured Streaming, which gives each file once, over the same stages as a batch scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.functions.globs import Filter
from bytegrove.functions.paths import ARCHIVE
from bytegrove.sources.archives import list_entries
from bytegrove.sources.scan import ScanConfig, parse_classes

#: What the binary file source gives.
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_archives(spark: SparkSession, path: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """A stream of (element, length, mtime): archives that appear below a directory, each once; contents aren't read here."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).load(path)
    named = files.select(F.col("path").alias("element"), "length", F.col("modificationTime").alias("mtime"))
    o = config.archives
    return named.where(F.lower("element").rlike(ARCHIVE.pattern)).where(Filter("leaf", o.accept_names, o.reject_names).accepted(F.col("element")))


def rescan(spark: SparkSession, path: str, handle, checkpoint: str, config: ScanConfig = ScanConfig(), **trigger):
    """Starts a query that calls ``handle(parsed, batch_id)`` with the parsed classes of each batch of new archives.

    With a checkpoint folder a restart goes on where it stopped. Parsing is a batch over the files of the micro-batch, so
    a batch that is repeated after a failure gives the same rows: handlers should overwrite by batch id.
    """

    def each(files: DataFrame, batch_id: int) -> None:
        entries = list_entries(files, config.archives).where("error is null and is_classfile")
        handle(parse_classes(entries, config), batch_id)

    trigger = trigger or {"availableNow": True}
    return watch_archives(spark, path, config).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
