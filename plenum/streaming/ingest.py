"""Meeting files as a stream: each micro-batch replaces the meetings it brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import replace
from ..sources.meetings import MEETING, segments


def stream_meetings(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(MEETING).option("multiLine", True).json(path).where("meeting_id is not null")


def latest_only(batch: DataFrame) -> DataFrame:
    """Of a meeting that comes several times in a batch, the latest scrape."""
    return batch.groupBy("phase", "meeting_id").agg(F.max_by(F.struct("*"), "scraped_at").alias("m")).select("m.*")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = segments) -> StreamingQuery:
    """Processes what is there and stops; run again, it takes only new files. Writing whole meetings makes it idempotent."""

    def write(batch: DataFrame, _: int) -> None:
        replace(build(latest_only(batch)), target, ["phase", "meeting_id"])

    return stream_meetings(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Speeches per hour and kind of a live feed (ts, event_type), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").count()
