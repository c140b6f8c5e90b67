"""Golden files: writing, reading, and comparing them with a new scan, chapter by chapter and row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import chapter_key
from marginalia.operators.review import shaped
from marginalia.session import cut

#: Columns that a comparison leaves out (fixed values).
IGNORED = ("id", "confidence_score_base", "chapter_index", "chapter_name", "chapter_group")
SHOWN = 140
NAME = r"^(.+)_(\d{8})_(\d{6})\.json$"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with their chapter and their number in it, by order, label, marker, position, context and definition; nulls first."""
    rows = shaped(rows)
    rows = rows.withColumn("chapter_key", chapter_key(*(F.col(c) for c in ("source", "chapter_group", "chapter_label", "chapter_index", "page_index", "file_name"))))
    order = W.partitionBy("chapter_key").orderBy("order_key", "chapter_label", "marker", "position", "context", "suggested_definition")
    return rows.withColumn("n", F.row_number().over(order))


def canonical(rows: DataFrame) -> DataFrame:
    """(chapter_key, n, cells): what is compared of each row, a map of column to JSON text."""
    kept = sorted(c for c in rows.columns if c not in (*IGNORED, "n", "chapter_key"))
    return rows.select("chapter_key", "n", F.map_from_arrays(F.array(*map(F.lit, kept)), F.array(*(F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}")) for c in kept))).alias("cells"))


def chapter_counts(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """Chapters that are missing, extra or of another number of rows."""
    count = lambda df, name: df.groupBy("chapter_key").agg(F.count("*").alias(name))
    both = count(golden, "golden_rows").join(count(actual, "actual_rows"), "chapter_key", "full_outer")
    status = F.when(F.col("actual_rows").isNull(), "missing").when(F.col("golden_rows").isNull(), "extra").when(F.col("golden_rows") != F.col("actual_rows"), "count").otherwise("same")
    return both.withColumn("status", status)


def differences(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """(chapter_key, n, columns, golden, actual) of rows that differ, in chapters of one number of rows; values cut at 140."""
    a, b = cut(keyed(golden)), cut(keyed(actual))
    alike = chapter_counts(a, b).where("status = 'same'").select("chapter_key")
    left = canonical(a).join(alike, "chapter_key", "left_semi").withColumnRenamed("cells", "g")
    both = left.join(canonical(b).withColumnRenamed("cells", "c"), ["chapter_key", "n"])
    names = F.array_sort(F.array_distinct(F.concat(F.map_keys("g"), F.map_keys("c"))))
    both = both.withColumn("columns", F.filter(names, lambda k: ~F.try_element_at("g", k).eqNullSafe(F.try_element_at("c", k))))
    shown = lambda m: F.transform("columns", lambda k: F.substring(F.coalesce(F.try_element_at(m, k), F.lit("")), 1, SHOWN))
    return both.where(F.size("columns") > 0).select("chapter_key", "n", "columns", shown("g").alias("golden"), shown("c").alias("actual"))


def compare(golden: DataFrame, actual: DataFrame) -> tuple[bool, DataFrame, DataFrame]:
    """Whether the two agree, the chapters that don't, and the rows that don't."""
    counts = chapter_counts(keyed(golden), keyed(actual)).where("status <> 'same'")
    rows = differences(golden, actual)
    return counts.isEmpty() and rows.isEmpty(), counts, rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Rows of golden files: objects with `rows`, or bare arrays."""
    found = spark.read.json(path, multiLine=True)
    if "rows" in found.columns:
        return found.select(F.explode("rows").alias("r")).select("r.*")
    return found


def goldens(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label, date, time) of the golden files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    name = F.substring_index("path", "/", -1)
    return files.where(name.rlike(NAME)).select("path", F.regexp_extract(name, NAME, 1).alias("label"), F.regexp_extract(name, NAME, 2).alias("date"), F.regexp_extract(name, NAME, 3).alias("time"))


def for_books(golden_files: DataFrame, books: DataFrame) -> DataFrame:
    """Each golden file with the book of its label; null where there is none."""
    return golden_files.join(books.select(F.col("label"), F.col("path").alias("book_path")), "label", "left")


def write_golden(rows: DataFrame, options: dict, path: str, enabled: bool = True) -> None:
    """One JSON object with the options and the rows of each book, a file for each; enabled: the switch of regression runs.

    Rows with a book_id are packed by it, so a task holds one book's rows at a time.
    """
    if not enabled:
        return
    keys = ["book_id"] if "book_id" in rows.columns else []
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order_key", F.struct(*rows.columns).alias("r")))).alias("x"))
    options_ = F.struct(*(F.lit(v).alias(k) for k, v in options.items())).alias("scan_options")
    documents = packed.select(*keys, options_, F.transform("x", lambda x: x["r"]).alias("rows"))
    writer = documents.write if not keys else documents.repartition(*keys).write.partitionBy(*keys).option("maxRecordsPerFile", 1)
    writer.mode("overwrite").json(path)
