"""Extension: the idempotent sinks as streams. The batch operators do not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as X
from tessera.sources import sinks


def deduplicated(docs: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """A stream of documents without repeats of a content hash within the watermark."""
    return docs.withColumn("content_hash", X.content_hash(F.col(text_col))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, time_col: str, kind_col: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of a stream by tumbling window; late rows beyond the delay are left out."""
    counted = events.withWatermark(time_col, delay).groupBy(F.window(time_col, window), kind_col).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col(kind_col).alias("kind"), "n")


def append_new_triples(triples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of triples so that each key is stored once, whatever is sent again."""
    return triples.writeStream.foreachBatch(lambda batch, _: sinks.append_triples(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
