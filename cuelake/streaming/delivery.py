"""A stream delivered to several subscribers, each batch once to each, with a report for each event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reports that a journal shows.
JOURNAL = 200
LOG = "batch long, subscriber string, failed boolean, error string"


@dataclass
class Subscriber:
    """accepts: a condition on events (null counts as no); handle: gets the accepted events of a batch and its number.

    A batch may come again if the driver died between handling it and noting that, with the same rows and number, so handle should
    replace what it wrote for a number, as table_sink does.
    """

    accepts: Column
    handle: Callable[[DataFrame, int], None]


def table_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to its own part of a folder, in place of what an earlier try left there."""

    def handle(events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return handle


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def deliver_batch(batch: DataFrame, number: int, subscribers: dict[str, Subscriber], event: str, order: str, folder: str) -> None:
    """One batch to the subscribers, one after the other, with notes of it and reports in the folder.

    A subscriber that fails is noted and doesn't stop the others. A batch that comes again, after the driver died, goes only
    to those that have no note of it, or a failure.
    """
    spark, log = batch.sparkSession, f"{folder}/log"
    held = batch.persist()
    try:
        noted = {r["subscriber"] for r in _known(spark, log, LOG).where((F.col("batch") == number) & ~F.col("failed")).collect()}
        failed = {}
        for name, s in subscribers.items():
            if name in noted:
                continue
            try:
                s.handle(held.where(F.coalesce(s.accepts, F.lit(False))), number)
            except Exception as e:  # noqa: BLE001  what one subscriber raises is its report
                failed[name] = str(e)[:4096]
            note = spark.createDataFrame([(number, name, name in failed, failed.get(name))], LOG)
            note.coalesce(1).write.mode("append").parquet(log)
        takes = {n: F.coalesce(s.accepts, F.lit(False)).cast("long") for n, s in subscribers.items()}
        none = F.lit(0).cast("long")
        handled = sum((c for n, c in takes.items() if n not in failed), none)
        lost = sum((c for n, c in takes.items() if n in failed), none)
        newest = held.orderBy(F.desc(order)).limit(JOURNAL)
        told = newest.select(F.col(event).alias("event"), F.col(order).alias("place"), F.lit(len(takes)).cast("long").alias("delivered"), handled.alias("handled"), lost.alias("failed"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{folder}/reports/batch={number}")
    finally:
        held.unpersist()


def deliver(stream: DataFrame, subscribers: dict[str, Subscriber], event: str, order: str, folder: str, available_now: bool = True):
    """Starts delivering the stream, see deliver_batch, and returns the running query; its checkpoint stands in the
    folder too. event: the column that names an event, order: the one by which the newest are told."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: deliver_batch(batch, number, subscribers, event, order, folder))
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def journal(spark: SparkSession, folder: str, kind: str = "long", place: str = "long") -> DataFrame:
    """(event, delivered, handled, ignored, failed): the reports of the newest events, JOURNAL at most.

    kind, place: types of the event's name and of the order.
    """
    rows = _known(spark, f"{folder}/reports", f"event {kind}, place {place}, delivered long, handled long, failed long")
    ignored = (F.col("delivered") - F.col("handled") - F.col("failed")).alias("ignored")
    return rows.orderBy(F.desc("place")).limit(JOURNAL).select("event", "delivered", "handled", ignored, "failed")
