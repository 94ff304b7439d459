"""The fact log as a stream: appended events fold into each fact's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "seq long, event string, id string, kind string, ts timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """New files of JSON lines as they are appended."""
    return spark.readStream.schema(schema).json(folder)


def folded(events: DataFrame) -> DataFrame:
    """(id, kind, promoted, revoked): the last promotion and revocation of each fact; update or complete mode."""
    is_ = lambda e: F.when(F.col("event") == e, F.col("seq"))
    return events.groupBy("id").agg(F.max_by("kind", is_("promoted")).alias("kind"), F.max(is_("promoted")).alias("promoted"), F.max(is_("revoked")).alias("revoked"))


def with_status(state: DataFrame) -> DataFrame:
    return state.where("promoted is not null").withColumn("status", F.when(F.col("revoked") > F.col("promoted"), "revoked").when(F.col("kind") == "CHANGE", "proposed").otherwise("current"))


def per_window(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Promotions and revocations per window of event time; later than ``lateness`` they no longer count."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"))


def follow(events: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete"):  # noqa: ANN201
    """Start the fold into an in-memory table ``name``."""
    writer = with_status(folded(events)).writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
