"""Mini-books with known notes, derived from the documents table by arithmetic.

Lines of 40 characters or more whose index is divisible by 3 are numbered per document (k, to 99) and get an anchor " (k)" unless
(31 * doc_id + k) % 11 = 0. Documents with two or more get a NOTES line and definitions "k. Note <md5>" unless (31 * doc_id + k) % 10 = 0. Twenty
documents are a book; a document is its item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOTES_AT = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_index, text) of every text."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "text"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that carry a note: (doc_id, line_index, text, k, anchored, defined, n)."""
    some = lines(spark, sf_dir).where("length(text) >= 40 and line_index % 3 = 0")
    some = some.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("line_index"))).where("k <= 99")
    some = some.withColumn("anchored", F.expr("(doc_id * 31 + k) % 11 <> 0")).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    return some.withColumn("defined", F.expr("n >= 2 and (doc_id * 31 + k) % 10 <> 0"))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, ord, text): the lines of the mini-books, notes sections last."""
    marks = numbered(spark, sf_dir)
    body = lines(spark, sf_dir).join(marks.select("doc_id", "line_index", "k", "anchored"), ["doc_id", "line_index"], "left")
    body = body.select("doc_id", F.col("line_index").cast("long").alias("ord"), F.when(F.col("anchored"), F.concat("text", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("text")).alias("text"))
    head = marks.where("n >= 2").select("doc_id").distinct().select("doc_id", F.lit(NOTES_AT).cast("long").alias("ord"), F.lit("NOTES").alias("text"))
    notes = marks.where("defined").select("doc_id", (F.lit(NOTES_AT) + F.col("k")).cast("long").alias("ord"), note_line().alias("text"))
    return body.unionByName(head).unionByName(notes).select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), "doc_id", "ord", "text")


def note_text():
    return F.concat(F.lit("Note "), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string"))))


def note_line():
    return F.concat(F.col("k").cast("string"), F.lit(". "), note_text())


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, text) of the mini-books, a row for each item."""
    packed = book_lines(spark, sf_dir).groupBy("book_id", "chapter_index", "doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return packed.select("book_id", "chapter_index", "doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def anchors(spark: SparkSession, sf_dir: str, cycle: int = 0) -> DataFrame:
    """The anchors by arithmetic, in the shape that pairing takes; cycle: markers restart after so many."""
    marks = numbered(spark, sf_dir).where("anchored")
    k = F.col("k") if not cycle else (F.col("k") - 1) % cycle + 1
    return marks.select(
        F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.col("k").alias("anchor_ord"), k.cast("string").alias("marker"),
        F.concat(F.lit("("), k.cast("string"), F.lit(")")).alias("marker_raw"), F.substring("text", 1, 160).alias("context"), (F.col("line_index") * 1000).cast("long").alias("position"),
        F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("frag"), F.lit(None).cast("string").alias("chapter_group"),
    )


def definitions(spark: SparkSession, sf_dir: str, cycle: int = 0) -> DataFrame:
    """The definitions by arithmetic, in the shape that pairing takes."""
    marks = numbered(spark, sf_dir).where("defined")
    k = F.col("k") if not cycle else (F.col("k") - 1) % cycle + 1
    return marks.select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.col("k").alias("def_ord"), k.cast("string").alias("marker"), note_text().alias("text"), (NOTES_AT + F.col("k")).cast("long").alias("char_position"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, label): a heading at every seventh line of a document."""
    return lines(spark, sf_dir).where("line_index % 7 = 0").select("doc_id", F.col("line_index").cast("long").alias("pos"), F.concat(F.lit("CHAPTER "), F.expr("line_index div 7 + 1").cast("string")).alias("label"))


#: The same in DuckDB, to stand before a query as WITH clauses.
SQL = f"""
line AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_index, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS k FROM line WHERE length(text) >= 40 AND line_index % 3 = 0),
numbered AS (SELECT *, (doc_id * 31 + k) % 11 <> 0 AS anchored, n >= 2 AND (doc_id * 31 + k) % 10 <> 0 AS defined FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ranked WHERE k <= 99)),
anchor AS (SELECT doc_id // 20 AS book_id, CAST(doc_id % 20 AS INTEGER) AS chapter_index, k AS anchor_ord, text, CAST(line_index * 1000 AS BIGINT) AS position, doc_id FROM numbered WHERE anchored),
definition AS (SELECT doc_id // 20 AS book_id, CAST(doc_id % 20 AS INTEGER) AS chapter_index, k AS def_ord, 'Note ' || md5(doc_id || '-' || k) AS text, doc_id FROM numbered WHERE defined),
heading AS (SELECT doc_id, CAST(line_index AS BIGINT) AS pos, 'CHAPTER ' || (line_index // 7 + 1) AS label FROM line WHERE line_index % 7 = 0),
book_line AS (
  SELECT l.doc_id, CAST(l.line_index AS BIGINT) AS ord, CASE WHEN n.anchored THEN l.text || ' (' || n.k || ')' ELSE l.text END AS text FROM line l LEFT JOIN numbered n USING (doc_id, line_index)
  UNION ALL SELECT DISTINCT doc_id, {NOTES_AT}, 'NOTES' FROM numbered WHERE n >= 2
  UNION ALL SELECT doc_id, {NOTES_AT} + k, k || '. Note ' || md5(doc_id || '-' || k) FROM numbered WHERE defined)"""
