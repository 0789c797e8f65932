"""A folder of class files and archives as a stream: what arrives is decoded once and appended to the decoded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelake.sources.classes import archive_entries, decoded

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Decoded rows of files as they arrive. Stateless: every file is worked through in the batch that finds it."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once).load(folder).select("path", "content")
    inside = archive_entries(found).where("status = 'ok' AND path LIKE '%.class'").select("archive", "path", "content")
    plain = found.where(F.col("path").endswith(".class")).select(F.lit("").alias("archive"), "path", "content")
    return decoded(inside.unionByName(plain).where(~F.col("path").rlike(r"(module|package)-info\.class$")))


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append decoded rows to the Parquet table, exactly once per file: the checkpoint knows which files are done. once: stop when all present files are."""
    writer = arriving(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
