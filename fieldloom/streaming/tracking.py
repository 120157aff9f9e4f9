"""Incremental tracking and exchange of objects over streams.

Labelled points arrive in any order within the watermark; states are kept by Spark, keyed by time and label, so that
nothing grows with the stream's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_nodes(stream: DataFrame, time: str, window: str, label: str, point: str, late: str = "1 hour") -> DataFrame:
    """(start, Label, Size): how many points carry a label in each window of event time; rows later than `late` are left out.

    Sizes count each point once within a window (duplicates are dropped as they come).
    """
    timed = stream.withWatermark(time, late).select(F.window(time, window).alias("w"), F.col(label).alias("Label"), F.col(point).alias("_p"))
    once = timed.dropDuplicates(["w", "Label", "_p"])
    return once.groupBy("w", "Label").agg(F.count("*").alias("Size")).select(F.col("w.start").alias("start"), "Label", "Size")


def block_aggregator(stream: DataFrame, block: str, out: str, checkpoint: str, trigger: dict | None = None):
    """Appends each batch of a stream to a table as blocks, by way of parquet; returns the running query."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy(block).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def to_messages(df: DataFrame, kind: str) -> DataFrame:
    """(value): each row as a JSON message of its kind, as a sink of texts takes it."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("row"))).alias("value"))


def from_messages(stream: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one kind among JSON messages (value); messages that aren't JSON are left out."""
    parsed = stream.select(F.from_json("value", f"kind string, row struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>").alias("m"))
    return parsed.where(F.col("m.kind") == kind).select("m.row.*")


def serve(stream: DataFrame, kind: str, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Sends every batch of a stream, as messages, by a function of (messages, batch number); returns the running query."""
    return stream.writeStream.foreachBatch(lambda df, n: send(to_messages(df, kind), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
