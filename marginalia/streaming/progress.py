"""Streams: reading positions, new books, and logs that are folded when they end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SAVE_EVERY = "5 seconds"


def furthest(events: DataFrame) -> DataFrame:
    """The furthest position of each book, of a stream or not."""
    return events.groupBy("book_id").agg(F.max("position_ms").alias("position_ms"))


def save_positions(events: DataFrame, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps each book's furthest position, saved every five seconds; once: what is there, then end."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{sink}/batch={number}")

    out = furthest(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=SAVE_EVERY)).start()


def positions(spark: SparkSession, sink: str) -> DataFrame:
    """The last saved position of each book."""
    return spark.read.json(sink).groupBy("book_id").agg(F.max_by("position_ms", "batch").alias("position_ms"))


def scan_new(spark: SparkSession, folder: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame], sink: str) -> StreamingQuery:
    """Scans text files that appear in a folder, each once; the rows of a batch are written together."""
    arrivals = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.xxhash64(F.col("_metadata.file_path")).alias("book_id"), F.lit(0).alias("chapter_index"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def folded(log: DataFrame) -> DataFrame:
    """A log of paragraphs (book_id, seq, w: words, p: paragraph), a row as each ended, to one row a book, in order."""
    each = F.array_sort(F.collect_list(F.struct("seq", "w", "p")))
    packed = log.groupBy("book_id").agg(each.alias("e"))
    return packed.select("book_id", F.flatten(F.transform("e", lambda x: x["w"])).alias("timestamps"), F.transform("e", lambda x: x["p"]).alias("paragraphs"))


class Status(StreamingQueryListener):
    """Tells a caller's function of a stream's status, a line an event, as it comes."""

    def __init__(self, tell: Callable[[str], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        self.tell(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        self.tell("waiting")

    def onQueryTerminated(self, event) -> None:
        self.tell(f"failed: {event.exception}" if event.exception else "ended")
