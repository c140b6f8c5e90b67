"""Speech preparation: voice segments, budgets, timings. The synthesiser is a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import notes as N
from marginalia.functions.text import paragraphs, word_count

SAMPLE_RATE = 24_000
GAP_MS = 300


def segments(items: DataFrame, rows: DataFrame | None = None, mode: str = "inline") -> DataFrame:
    """Items (book_id, chapter_index, text) and their note rows to (book_id, chapter_index, seq, voice_type, text)."""
    keys = ["book_id", "chapter_index"]
    fields = ["position", "marker", "marker_raw", "suggested_definition", "user_definition", "user_status"]
    if rows is None:
        packed = items.withColumn("notes", F.array().cast("array<struct<position:bigint,marker:string,marker_raw:string,suggested_definition:string,user_definition:string,user_status:string>>"))
    else:
        for f in fields:
            rows = rows if f in rows.columns else rows.withColumn(f, F.lit(None).cast("string"))
        packed = items.join(rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("notes")), keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for book, chapter, text, own in zip(*(batch.column(c).to_pylist() for c in ("book_id", "chapter_index", "text", "notes")), strict=True):
                out += [(book, chapter, k, voice, part) for k, (voice, part) in enumerate(N.voice_segments(text or "", own or [], mode))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], [*keys, "seq", "voice_type", "text"])

    return packed.select(F.col("book_id").cast("long"), F.col("chapter_index").cast("int"), "text", "notes").mapInArrow(run, "book_id long, chapter_index int, seq int, voice_type string, text string")


def with_voice(rows: DataFrame, voice: str, note_voice: str | None) -> DataFrame:
    return rows.withColumn("voice", F.when(F.col("voice_type") == "footnote", note_voice or voice).otherwise(voice))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Segments up to a number of words in all; the one that crosses it is cut."""
    n = word_count(F.col("text"))
    before = F.coalesce(F.sum("n_words").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("n_words", n).withColumn("before", before).where(F.col("before") < limit)
    cut = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), F.lit(1), (F.lit(limit) - F.col("before")).cast("int")), " ")
    over = F.col("before") + F.col("n_words") > limit
    return kept.withColumn("text", F.when(over, cut).otherwise(F.col("text"))).withColumn("n_words", F.least("n_words", F.lit(limit) - F.col("before"))).drop("before")


def paragraph_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.posexplode(paragraphs(F.col("text"))).alias("seq", "text"))


def timed(rows: DataFrame, keys: list[str], samples: str = "samples", rate: int = SAMPLE_RATE) -> DataFrame:
    """Paragraphs with their number of samples to start_ms and end_ms, by a running sum; rounded once, at the end."""
    order = W.partitionBy(*keys).orderBy("seq")
    upto = F.sum(samples).over(order.rowsBetween(W.unboundedPreceding, 0))
    ms = lambda n: F.round(n * 1000.0 / rate).cast("long")
    return rows.withColumn("start_ms", ms(upto - F.col(samples))).withColumn("end_ms", ms(upto))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(word_count(F.col("text"))).alias("word_count"), (F.sum("samples") / SAMPLE_RATE).alias("duration_s"))


def synthesised(rows: DataFrame, speak: Callable[[str, str], int]) -> DataFrame:
    """Paragraphs with `samples`, what speak(text, voice) returns for each; runs in the tasks, a paragraph at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [speak(t or "", v) for t, v in zip(batch.column("text").to_pylist(), batch.column("voice").to_pylist(), strict=True)]
            yield batch.append_column("samples", pa.array(found, pa.int64()))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, samples long")


def fill_gaps(words: DataFrame, paras: DataFrame, keys: list[str]) -> DataFrame:
    """Where a paragraph's last word ends over 300 ms before it does, the words not spoken yet become one more span."""
    said = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "word", "end_ms"))).alias("w"))
    both = paras.join(said, keys)
    last = F.element_at("w", -1)
    body = F.trim(F.regexp_replace("text", "[*†‡§]+", ""))
    covered = F.rtrim(F.array_join(F.transform("w", lambda x: x["word"]), ""))
    after = F.when(body.startswith(covered), F.substring(body, F.length(covered) + 1, F.length(body))).when(F.instr(body, F.trim(last["word"])) > 0, F.call_function("substring_index", body, F.trim(last["word"]), F.lit(-1)))
    rest = F.trim(after)
    gap = both.where((F.col("end_ms") - last["end_ms"] > GAP_MS) & (F.coalesce(rest, F.lit("")) != ""))
    filled = gap.select(*keys, (last["n"] + 1).alias("n"), F.concat(rest, F.lit(" ")).alias("word"), last["end_ms"].alias("start_ms"), F.col("end_ms").alias("end_ms"))
    return words.select(*keys, "n", "word", "start_ms", "end_ms").unionByName(filled)


def timestamps_json(words: DataFrame, paras: DataFrame, texts: DataFrame) -> DataFrame:
    """One JSON document for each book: its words and paragraphs in order, its text and its stem."""
    pack = lambda df, cols, name: df.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias(name))
    both = texts.join(pack(words, ["word", "start_ms", "end_ms"], "timestamps"), "book_id", "left").join(pack(paras, ["text", "start_ms", "end_ms"], "paragraphs"), "book_id", "left")
    return both.select("book_id", F.to_json(F.struct("timestamps", "paragraphs", F.col("text").alias("full_text"), "book_stem")).alias("json"))


def encoded(rows: DataFrame, voice_samples: Callable[[str, str], bytes], encoder: Callable[[Iterator[bytes]], bytes]) -> DataFrame:
    """(book_id, seq, text, voice) to (book_id, audio): each book's samples streamed, in order, through the caller's encoder while they are made.

    A book is one stream, so it is one task, which holds a piece at a time and what the encoder returns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((r["book_id"], r) for batch in batches for r in batch.to_pylist())
        for book, own in groupby(pieces, key=lambda x: x[0]):
            audio = encoder(voice_samples(r["text"] or "", r["voice"]) for _, r in own)
            yield pa.RecordBatch.from_arrays([pa.array([book], pa.int64()), pa.array([audio], pa.binary())], ["book_id", "audio"])

    ordered = rows.select(F.col("book_id").cast("long"), "seq", "text", "voice").repartition("book_id").sortWithinPartitions("book_id", "seq")
    return ordered.mapInArrow(run, "book_id long, audio binary")
