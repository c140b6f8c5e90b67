"""Definitions of the elements of a page, by the conventions of single producers: positions of files, linked pairs of ids, note classes, numbered paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_marker, safe_text

#: Ids by which converters name places (fixed values): a position in the file, a note and its link, and a note with its text.
FILEPOS, LINKED, TARGET, STRUCTURED = "^filepos[0-9]+$", "^st[0-9]+$", "^rst[0-9]+$", "^_?rfn[0-9]+"
_LEAD = r"^\s*[(\[]?\s*([0-9]{1,3}|[*†‡§]+|[a-zA-Z])\s*[)\]]?\s*[.):\-—]?\s+(.+)$"
_BLOCK = ("p", "div", "li", "dd", "td", "blockquote")
#: Numbered paragraphs count as definitions from so many in an item; text that goes on is at most this long (fixed values).
PARAGRAPHS, RUNS_ON = 5, 80


def _marker(text: Column) -> Column:
    return normalize_marker(F.regexp_extract(text, _LEAD, 1))


def _body(text: Column) -> Column:
    return F.regexp_extract(text, _LEAD, 2)


def by_id(elements: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, def_id, marker, text) of blocks whose id has a form and whose text begins with a marker."""
    text = safe_text(F.col("text"))
    found = elements.where(F.col("id").rlike(pattern) & F.col("tag").isin(*_BLOCK)).withColumn("_t", text)
    return found.select(*keys, F.col("id").alias("def_id"), _marker(F.col("_t")).alias("marker"), _body(F.col("_t")).alias("text"), "node_id").where("marker <> '' and text <> ''")


def filepos_definitions(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions bound to positions of a file: blocks whose id links lead to."""
    linked = elements.where((F.col("tag") == "a") & F.col("href").rlike("#filepos[0-9]+$")).select("book_id", F.substring_index("href", "#", -1).alias("def_id")).distinct()
    return by_id(elements, FILEPOS, keys).join(linked, ["book_id", "def_id"], "left_semi")


def linked_pairs(elements: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Anchors and definitions of converters that name a note's place st<n> and its text rst<n>."""
    number = F.regexp_extract("id", "([0-9]+)$", 1)
    anchors = elements.where(F.col("id").rlike(LINKED)).select(*keys, number.alias("pair"), safe_text(F.col("text")).alias("marker_raw"), F.col("start").alias("position"))
    return anchors, by_id(elements, TARGET, keys).withColumn("pair", F.regexp_extract("def_id", "([0-9]+)$", 1))


def structured_definitions(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions with ids of the structured form, with the blocks after them up to the next one as their continuation."""
    blocks = elements.where(F.col("tag").isin(*_BLOCK)).select(*keys, "node_id", "id", safe_text(F.col("text")).alias("_t")).where("_t <> ''")
    head = F.when(F.col("id").rlike(STRUCTURED) & (_marker(F.col("_t")) != ""), F.col("id"))
    upto = W.partitionBy(*keys).orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    owned = blocks.withColumn("_head", head).withColumn("def_id", F.last("_head", ignorenulls=True).over(upto)).where("def_id is not null")
    parts = F.array_sort(F.collect_list(F.struct("node_id", F.when(F.col("_head").isNotNull(), _body(F.col("_t"))).otherwise(F.col("_t")).alias("t"))))
    return owned.groupBy(*keys, "def_id").agg(F.max(_marker(F.when(F.col("_head").isNotNull(), F.col("_t")))).alias("marker"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def class_definitions(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions of blocks of a note class."""
    found = elements.where(F.col("note_class") & F.col("tag").isin(*_BLOCK)).withColumn("_t", safe_text(F.col("text")))
    return found.select(*keys, F.col("id").alias("def_id"), _marker(F.col("_t")).alias("marker"), _body(F.col("_t")).alias("text"), "node_id").where("marker <> '' and text <> ''")


def paragraph_definitions(elements: DataFrame, keys: list[str], least: int = PARAGRAPHS) -> DataFrame:
    """Paragraphs that begin with a marker, in items with `least` of them; a short unmarked paragraph after one goes on with it."""
    paragraphs = elements.where(F.col("tag") == "p").select(*keys, "node_id", safe_text(F.col("text")).alias("_t")).where("_t <> ''").withColumn("marker", _marker(F.col("_t")))
    order = W.partitionBy(*keys).orderBy("node_id")
    after, after_marker = F.lead("_t").over(order), F.lead("marker").over(order)
    runs_on = (after_marker == "") & (F.length(after) <= RUNS_ON)
    whole = F.concat_ws(" ", _body(F.col("_t")), F.when(runs_on, after))
    found = paragraphs.withColumn("text", whole).where("marker <> ''").withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return found.where(F.col("_n") >= least).select(*keys, "marker", "text", "node_id")


def gap_definitions(elements: DataFrame, missing: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Definitions for fragments (book_id, frag) that links lead to and none has: the numbered block of that id with a body of `least` characters."""
    found = elements.where(F.col("tag").isin(*_BLOCK)).join(missing.withColumnRenamed("frag", "id"), ["book_id", "id"], "left_semi").withColumn("_t", safe_text(F.col("text")))
    numbered = found.select(*keys, F.col("id").alias("def_id"), _marker(F.col("_t")).alias("marker"), _body(F.col("_t")).alias("text"), "node_id")
    return numbered.where(F.col("marker").rlike("^[0-9]{1,3}$") & (F.length("text") >= least))
