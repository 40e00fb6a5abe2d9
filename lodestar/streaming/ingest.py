"""Documents arriving as a stream become an index, a segment a batch, which ``Engine.load`` reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions import text as tx
from lodestar.operators import index as ix
from lodestar.operators.segments import Index
from lodestar.operators.store import Folder


def document_stream(spark: SparkSession, path: str, schema: str | T.StructType, *, files_per_batch: int = 64) -> DataFrame:
    """A stream of the files below ``path``, or of the one file there, which streams name by its folder and a pattern."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if not Folder(spark, path).is_file():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def index_stream(docs: DataFrame, path: str, fields: list[str], *, analyzer: ix.Analyzer = tx.tokens, checkpoint: str | None = None, replace: bool = False) -> StreamingQuery:
    """Each batch becomes a segment of the index at ``path``; a batch that comes twice is loaded once. With ``replace``, a document replaces the one of its id."""
    spark = docs.sparkSession
    Index.create(spark, path, fields, analyzer=analyzer)
    place = checkpoint or f"{path}/_stream"

    def write(batch: DataFrame, number: int) -> None:
        Index.open(batch.sparkSession, path, analyzer=analyzer).load(batch, replace=replace, batch=f"{place}:{number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start()


def arrivals(events: DataFrame, *, time: str = "ts", key: str = "event_type", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out by streaming queries."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
