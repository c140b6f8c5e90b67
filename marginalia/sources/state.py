"""State and result files: preferences, sessions, reviewed rows, timestamps."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import book_stem, file_label

STATE = "preferences map<string,string>, sessions array<struct<bookPath:string,outputPath:string,readingPositionMs:bigint>>"


def load(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame | None:
    """Rows of a JSON file or folder, None where there is none; lines: an object on each line, as save() writes them."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        found = reader.json(path, multiLine=not lines)
        found.schema  # noqa: B018  resolves the path
        return found
    except AnalysisException:
        return None


def save(rows: DataFrame, path: str) -> None:
    """Reviewed rows or state, written whole beside the files before, which go when the new ones are complete."""
    spark = rows.sparkSession
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.write.json(new)
    files.delete(place(path), True)
    if not files.rename(place(new), place(path)):
        raise OSError(f"{new} could not be renamed to {path}")


def result_document(rows: DataFrame) -> DataFrame:
    """Each book's note rows as one JSON array in reading order."""
    cells = [c for c in rows.columns if c != "book_id"]
    packed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("order_key").alias("k"), F.struct(*cells).alias("r")))).alias("x"))
    return packed.select("book_id", F.to_json(F.transform("x", lambda x: x["r"]), {"pretty": "true"}).alias("json"))


def sessions(state: DataFrame) -> DataFrame:
    """Sessions of a state file with their place; the last is the one to restore."""
    return state.select(F.posexplode("sessions").alias("seq", "s")).select("seq", F.col("s.bookPath").alias("book_path"), F.col("s.outputPath").alias("output_path"), F.col("s.readingPositionMs").alias("position_ms"))


def used(rows: DataFrame, book_path: str) -> DataFrame:
    """Sessions in the order they have after a book was used: it moves to the end."""
    order = W.orderBy(F.col("book_path") == book_path, "seq")
    return rows.withColumn("seq", F.row_number().over(order) - 1)


def output_folders(books: DataFrame) -> DataFrame:
    """An output folder for each book; books of one stem get a number after it, in order of their paths."""
    named = books.withColumn("stem", book_stem(F.col("path")))
    n = F.row_number().over(W.partitionBy("stem").orderBy("path"))
    return named.withColumn("folder", F.when(n > 1, F.concat_ws("_", "stem", n.cast("string"))).otherwise(F.col("stem")))


def golden_name(labels: DataFrame, at: datetime) -> DataFrame:
    """File names of new golden files: label, date and time."""
    return labels.withColumn("file", F.concat(file_label(F.col("label")), F.lit(f"_{at:%Y%m%d}_{at:%H%M%S}.json")))
