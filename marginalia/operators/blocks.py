"""Notes blocks of whole tables of items, one Arrow pass an item."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import blocks as B
from marginalia.functions import notes as N

ITEM = ["book_id", "chapter_index"]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _by_item(items: DataFrame, schema: str, rows_of: Callable[[list[str]], list[tuple]]) -> DataFrame:
    """(ITEM, text) to ITEM and the rows that a function makes of an item's lines."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for book, chapter, text in zip(batch.column("book_id").to_pylist(), batch.column("chapter_index").to_pylist(), batch.column("text"), strict=True):
                lines = [N.clean_line(x) for x in N.preprocess(text.as_py()).split("\n")]
                out += [(book, chapter, *row) for row in rows_of(lines)]
            columns = list(zip(*out, strict=True)) or [[] for _ in range(2 + len(fields))]
            types = [pa.int64(), pa.int32(), *(_TYPES[kind] for _, kind in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*ITEM, *(name for name, _ in fields)])

    return items.select(F.col("book_id").cast("long"), F.col("chapter_index").cast("int"), "text").mapInArrow(run, f"book_id long, chapter_index int, {schema}")


def notes_blocks(items: DataFrame) -> DataFrame:
    """(ITEM, header, start, stop, middle) of every notes block."""
    return _by_item(items, "header int, start int, stop int, middle boolean", lambda lines: [(*b, b.middle(len(lines))) for b in B.notes_blocks(lines)])


def prose_lines(items: DataFrame) -> DataFrame:
    """(ITEM, line_index, text, excluded) of every line."""
    return _by_item(items, "line_index int, text string, excluded boolean", lambda lines: [(k, x, out) for k, (x, out) in enumerate(zip(lines, B.excluded(lines), strict=True))])


def block_definitions(items: DataFrame) -> DataFrame:
    """(ITEM, def_ord, marker, text, line_index, chapter_token) of the definitions of all blocks."""
    return _by_item(items, "def_ord int, marker string, text string, line_index int, chapter_token int", lambda lines: [(k, d.marker, d.text, d.line_index, d.chapter_token) for k, d in enumerate(B.block_definitions(lines))])


def logical_labels(items: DataFrame) -> DataFrame:
    """(ITEM, label, token) of the items that have a heading."""
    return _by_item(items, "label string, token int", lambda lines: [(h.label, h.token)] if (h := B.logical_label(lines)) else [])


def leads(items: DataFrame) -> DataFrame:
    """(ITEM, lead, resumes): the text before an item's first definition or heading, and whether the item goes on with the notes of the one before."""

    def of(lines: list[str]) -> list[tuple]:
        first = next((k for k, x in enumerate(lines) if N.DEFINITION.match(x) or N.is_heading(x) or N.is_header(x)), len(lines))
        goes_on = first < len(lines) and N.DEFINITION.match(lines[first]) is not None and N.continuation_start(lines) is not None
        return [(" ".join(x.strip() for x in lines[:first] if x.strip()), goes_on)]

    return _by_item(items, "lead string, resumes boolean", of)


def relocated(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """anchors (ITEM, marker_raw, context, ...) with raw_position, their place in the text as it was; null where nothing leads to it."""
    both = anchors.join(texts.select(*ITEM, F.col("text").alias("_text")), ITEM)
    kept = [c for c in both.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_text", "marker_raw", "context")), strict=True)
            places = [B.relocated(t or "", m or "", c or "") for t, m, c in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(places, pa.int64())], [*kept, "raw_position"])

    return both.mapInArrow(run, ", ".join([*(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in kept), "raw_position long"]))
