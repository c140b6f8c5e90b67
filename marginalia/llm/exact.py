"""Exact deduplication as a stateful stream.

Each arriving row is reduced to the SHA-256 of its text, its doc_id and a content locator (file and row number). A
streaming aggregation keyed by digest keeps, for ever, the digest, the stable identifier of the row that stays, its
locator and a count; its state is a RocksDB store on the executors' disks with a change log in the shared folder, without
watermark or expiry, so a later run over new files goes on from where the last one ended. Counts are summed before the
shuffle, so a text with a third of all rows is one state update a task.

A digest alone decides nothing: each row that hit an existing key is compared byte by byte with the text its locator
leads to. Groups in which that fails (two texts of one digest) are grouped anew by the whole text.

Defined results: null counts as empty; of equal texts the row with the largest doc_id stays, a null doc_id being
smaller than any; repeated rows (same doc_id and text) are told apart by their locator, so that one of them stays; an
empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.llm.shared import cut, scratch, table, unused

#: Rows whose 8-byte keys or locators may be sent to every executor.
SENT_ROWS = 100_000
#: Copies that are compared with one copy of the kept text in one place.
COPIES = 500
#: Input of one micro-batch.
BATCH = 16 << 30

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor together; without a bound each keeps buffers of its own
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    # each store would set aside 4 MB of disk for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(df: DataFrame, at: str) -> DataFrame:
    """df with `at` (file, row), where each row's content lies; rows of no file are written to the shared folder first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(at)
    try:
        return df.select("*", place)
    except AnalysisException:
        path = scratch(df.sparkSession, "contents")
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path).select("*", place)


def keep(arrivals: DataFrame) -> DataFrame:
    """Rows (id, digest, file, row), of a stream or not, to a row for each digest: `keep`, the row that stays, and n, the rows so far."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))


def start(arrivals: DataFrame, sink: str, state: str) -> StreamingQuery:
    """Runs the stateful deduplication over what has arrived; sink gets, for each batch, the keys that changed.

    state is the stream's checkpoint; called again with it, the stream goes on and counts nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with _set(arrivals.sparkSession, STATE):
        return keep(arrivals).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()


def groups_of(spark: SparkSession, sink: str) -> DataFrame:
    """The latest state of each digest that the stream has written."""
    changes = spark.read.parquet(sink)
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.*")


def _among(df: DataFrame, wanted: DataFrame, on: str, n: int) -> DataFrame:
    """Rows of df whose key is wanted; n is the counted size of wanted, which decides whether it may be sent everywhere."""
    return df.join(F.broadcast(wanted) if n <= SENT_ROWS else wanted, on, "left_semi")


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text", at: str | None = None, digest=sha256, batch: int = BATCH) -> DataFrame:
    """(file, row, id, digest, keep, n) of every row of df; keep: struct of id, file and row of the one that stays.

    at: column with the rows' places, where df has been located already.
    """
    spark = df.sparkSession
    if at is None:
        df, at = located(df.select(id, text), "_at"), "_at"
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(at).alias("at")).select("id", "text", "at.*").withColumn("digest", digest(F.col("text")))
    path = scratch(spark, "arrivals")
    rows.drop("text").write.parquet(f"{path}/rows")
    arrivals = spark.read.parquet(f"{path}/rows")
    if arrivals.isEmpty():
        return arrivals.withColumn("keep", F.struct("id", "file", "row")).withColumn("n", F.lit(0).cast("long"))
    stream = spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", batch).parquet(f"{path}/rows")
    query = start(stream, f"{path}/groups", f"{path}/state")
    query.awaitTermination()
    groups = groups_of(spark, f"{path}/groups")
    found = arrivals.join(groups, "digest")

    repeated = cut(groups.where("n > 1"))
    n = repeated.count()
    if not n:
        return found.select("file", "row", "id", "digest", "keep", "n")
    texts = _among(rows, repeated.select("digest"), "digest", n).join(repeated, "digest")
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    kept = texts.where(stays).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hits = texts.where(~stays).withColumn("part", F.pmod(F.xxhash64("file", "row"), parts).cast("int"))
    differ = cut(hits.join(kept, ["digest", "part"]).where("text <> kept_text").select("digest").distinct())
    m = differ.count()
    if not m:
        return found.select("file", "row", "id", "digest", "keep", "n")
    again = _among(rows, differ, "digest", m)
    by_text = again.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    again = again.join(by_text, ["digest", "text"]).select("file", "row", "id", "digest", "keep", "n")
    return found.join(differ, "digest", "left_anti").select("file", "row", "id", "digest", "keep", "n").unionByName(again)


def op5_stateful_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the row of its text that stays."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of equal texts the document with the largest doc_id stays."""
    at = unused(docs, "_at")["_at"]
    rows = located(docs, at)
    found = deduplicated(rows, at=at)
    leaving = cut(found.where("file <> keep.file or row <> keep.row").select(F.struct("file", "row").alias(at)))
    sent = F.broadcast(leaving) if leaving.count() <= SENT_ROWS else leaving
    return rows.join(sent, at, "left_anti").select(docs.columns)


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
