"""Scoring of a forecast feed as it arrives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_first
from ..operators.frames import Frame, over_time
from ..sources.tables import adopt
from .ingest import publish_batch

#: Where a row comes from, the first of equals counting: known history, an earlier batch, this batch.
KNOWN, EARLIER, FRESH = 0, 1, 2


def forecast_stream(spark: SparkSession, path: str, schema: T.StructType, options: dict | None = None) -> DataFrame:
    return spark.readStream.schema(schema).options(**(options or {})).parquet(path)


def scored_stream(
    feed: DataFrame, keys: Sequence[str], ts: str, score: Callable[[DataFrame], DataFrame], late: str = "3 days"
) -> DataFrame:
    """Each (keys, ts) once, scored by a stateless function, such as a fitted model's ``transform``.

    The watermark stands on the time of arrival, which no row can be behind, so no forecast hour is too late. It
    lets the state of delivered rows be dropped: a repeat that arrives more than ``late`` after the first counts as new.
    """
    arrived = feed.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", late)
    return arrived.dropDuplicatesWithinWatermark([*keys, ts]).drop("__arrived").transform(score)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything available to Parquet files at ``path`` and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


@dataclass(frozen=True)
class LiveScores:
    """How a feed of hourly rows is scored with features that reach back in time.

    ``columns`` are the values the features are made of. ``frames`` look back only, and are taken over the history, what earlier batches
    brought, and the batch itself; ``finish`` adds what needs no other row, and the score. ``table`` receives the scored rows, with the
    number of their batch.
    """

    keys: Sequence[str]
    ts: str
    columns: Sequence[str]
    frames: Sequence[Frame]
    table: str
    checkpoint: str
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)

    def __post_init__(self):
        if any(f.end > 0 for f in self.frames):
            raise ValueError("frames of a feed cannot look ahead")


BATCH = "scored_batch"


def score_batch(batch: DataFrame, history: DataFrame, live: LiveScores, number: int) -> DataFrame:
    """The batch's new hours with their features.

    Only the stretch of history that the frames can see is read, for the batch's keys alone: one pass over (key, chunk of time) for all frames.
    An hour that the history or an earlier batch holds is not new; of an hour's rows in one batch the smallest counts. Rows
    without a time are left out.
    """
    spark = batch.sparkSession
    columns = [*live.keys, live.ts, *live.columns]
    fresh = batch.select(*columns).filter(F.col(live.ts).isNotNull())
    span = fresh.agg(F.min(live.ts).alias("first"), F.max(live.ts).alias("last")).first()
    reach = F.make_dt_interval(secs=F.lit(max([0, *(-f.start for f in live.frames)])))

    def seen(rows: DataFrame, source: int) -> DataFrame:
        at = F.col(live.ts)
        near = rows.select(*columns).filter((at >= F.lit(span.first) - reach) & (at <= F.lit(span.last)))
        return near.withColumn("__source", F.lit(source))

    rows = fresh.withColumn("__source", F.lit(FRESH))
    if span.first is not None:
        rows = rows.unionByName(seen(history, KNOWN))
        if spark.catalog.tableExists(live.table) or adopt(spark, live.table):
            # an attempt at this batch that was cut short does not count
            spark.catalog.refreshTable(live.table)
            rows = rows.unionByName(seen(spark.read.table(live.table).filter(F.col(BATCH) < number), EARLIER))
        own = fresh.select(*[F.col(k).alias(f"__own_{k}") for k in live.keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__own_{k}")) for k in live.keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        rows = rows.join(own, on, "left_semi")
    once = keep_first(rows, [*live.keys, live.ts], ["__source"])
    framed = over_time(once, list(live.keys), live.ts, list(live.frames))
    return framed.filter(F.col("__source") == FRESH).drop("__source")


def score_with_history(feed: DataFrame, history: DataFrame | Callable[[SparkSession], DataFrame], live: LiveScores) -> int:
    """Score everything that has arrived, and stop; returns the rows scored.

    A function as ``history`` is called for each batch, so that hours that have been observed since count as history. A batch that is
    repeated after a crash replaces its own rows, so every hour is scored once; later hours do not change what was scored.
    """
    counts: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            known = history(spark) if callable(history) else history
            out = live.finish(score_batch(batch, known, live, number)).withColumn(BATCH, F.lit(number).cast("long"))
            if not spark.catalog.tableExists(live.table) and not adopt(spark, live.table):
                spark.createDataFrame([], out.schema).write.format("parquet").saveAsTable(live.table)
            counts.append(publish_batch(out, live.table, live.checkpoint, number))
        finally:
            batch.unpersist()

    feed.writeStream.foreachBatch(add).option("checkpointLocation", live.checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = feed.sparkSession
    if spark.catalog.tableExists(live.table):
        spark.catalog.refreshTable(live.table)
    return sum(counts)
