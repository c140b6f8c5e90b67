"""Substring deduplication by hashed lines and sentences.

A text is cut into units: a unit ends with a line feed or with the marks that end a sentence (and the white space after
them), so units tile the text. Units are normalised (A-Z lower-cased, runs of ASCII white space to one space, trimmed) and the
digests of all of them, however short, are grouped over the whole corpus; the earliest place of a digest stays. What is removed are
runs: maximal stretches of consecutive units of which none stands at its earliest place, where the normalised units
of the run have LEAST_RUN code points or more (about thirty words; a parameter). A sentence that many texts happen to share is
so left alone, and a copied passage goes wherever in a line it begins, but for the parts of sentences at its two ends. Offsets are code points of the
original text and stay with the result.

A row is known by its id (a hash of its text where it has none) and a hash of its place (file and row number), and places are ranked by
these, rows without id last, and then by offset; so rows that share an id, or have none, keep their own spans, and of repeated rows one counts as the first.

Counts and earliest places are summed before the shuffle. Units meet their earliest place by a join in which the digests
with over a thousandth of all units are sent everywhere, so a line of every document fills no task.

Defined results: a null text has no units, and stays null; an empty one stays empty; blank units (white space at a text's beginning) are
no repeats and end a run; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.exact import located
from marginalia.llm.shared import joined_counted, table, unused, written

#: Code points that a run of repeated units has at least, normalised and without the spaces between units.
LEAST_RUN = 200
#: One unit of a text.
UNIT = r"[^\n.!?。！？]*[\n.!?。！？]+[\x20\x09-\x0D]*|[^\n.!?。！？]+"
_UNIT = re.compile(UNIT)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ROW = ("last", "id", "at")
#: The low half of a span, its end.
_STOP = (1 << 32) - 1


def text_units(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(from, to, code points when normalised, digest) of each unit; blank ones have 0 code points."""
    for m in _UNIT.finditer(text):
        norm = b" ".join(m[0].encode("utf-8", "surrogatepass").translate(_LOWER).split())
        yield m.start(), m.end(), len(norm.decode("utf-8", "surrogatepass")), hashlib.md5(norm).digest()


def units(rows: DataFrame) -> DataFrame:
    """(last, id, at, text) to (last, id, at, span, size, d0, d1), a row for each unit that isn't blank: offsets in one long, code points, and the two halves of the digest."""
    fields = [pa.field("last", pa.bool_()), pa.field("id", pa.int64()), pa.field("at", pa.int64()), pa.field("span", pa.int64()), pa.field("size", pa.int32()), pa.field("d0", pa.int64()), pa.field("d1", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, spans, sizes, digests = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                for a, b, size, digest in text_units(text.as_py() or ""):
                    if size:
                        of.append(k)
                        spans.append(a << 32 | b)
                        sizes.append(size)
                        digests.append(digest)
                if len(of) > 50_000 or k == batch.num_rows - 1:
                    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    columns = [batch.column(c).take(pa.array(of, pa.int64())) for c in _ROW] + [pa.array(spans, pa.int64()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                    of, spans, sizes, digests = [], [], [], []

    return rows.select(*_ROW, "text").mapInArrow(run, "last boolean, id long, at long, span long, size int, d0 long, d1 long")


def repeats(rows: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(last, id, at, text) to (last, id, at, start, stop) of each run of repeated units that has least_run code points."""
    found = written(units(rows), "units")
    place = F.struct(*_ROW, "span")
    common = written(found.groupBy("d0", "d1").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    again = joined_counted(found, common, ["d0", "d1"], "n", found.count()).where(place != F.col("first"))
    start, stop = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(_STOP).cast("int")
    again = again.select(*_ROW, start.alias("start"), stop.alias("stop"), "size")
    # the end of a unit, less the length of the repeated ones up to it, is the same all along a run
    upto = F.sum(F.col("stop") - F.col("start")).over(W.partitionBy(*_ROW).orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    runs = again.withColumn("run", F.col("stop") - upto)
    runs = runs.groupBy(*_ROW, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("size").alias("size"))
    return runs.where(F.col("size") >= least_run).select(*_ROW, "start", "stop")


def without(df: DataFrame, text: str, spans: str) -> DataFrame:
    """df with the spans, an array of (start, stop), cut from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            texts = []
            for value, cuts in zip(batch.column(text), batch.column(spans).to_pylist(), strict=True):
                value, at, kept = value.as_py(), 0, []
                for c in cuts if value is not None else ():
                    kept.append(value[at : c["start"]])
                    at = c["stop"]
                texts.append("".join([*kept, value[at:]]) if at else value)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN, spans: str = "removed") -> DataFrame:
    """df with repeated runs cut from its text, and in `spans` what was cut: an array of (start, stop) in the original text."""
    df = df.drop(spans)
    n = unused(df, "_file", "_last", "_id", "_at", "_spans")
    placed = located(df, n["_file"])
    known = F.col(id).cast("long")
    rows = placed.select(
        *df.columns, known.isNull().alias(n["_last"]), F.coalesce(known, F.xxhash64(text)).alias(n["_id"]), F.xxhash64(F.col(n["_file"])["file"], F.col(n["_file"])["row"]).alias(n["_at"])
    )
    key = [n["_last"], n["_id"], n["_at"]]
    narrow = rows.select(*(F.col(n[f"_{c}"]).alias(c) for c in _ROW), F.col(text).alias("text"))
    found = repeats(narrow, least_run).groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(n["_spans"])).withColumnsRenamed({c: n[f"_{c}"] for c in _ROW})
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    both = rows.join(found, key, "left").select(*df.columns, F.coalesce(n["_spans"], nothing).alias(spans))
    return without(both, text, spans)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated runs cut, the number of runs and their original offsets, as text "start-stop,..."."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), listed.alias("removed"), "text")


ORACLE_SQL = rf"""
WITH doc AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units FROM documents WHERE text IS NOT NULL),
part AS (SELECT doc_id, unnest(units) AS unit, unnest(range(len(units))) AS nth FROM doc),
placed AS (SELECT doc_id, nth, CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY nth) AS BIGINT) AS stop, length(unit) AS long,
  array_to_string(regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM part),
marked AS (SELECT doc_id, nth, stop - long AS start, stop, length(norm) AS size, row_number() OVER (PARTITION BY norm ORDER BY doc_id, stop) > 1 AS again FROM placed WHERE norm <> ''),
runs AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM marked WHERE again) GROUP BY doc_id, run HAVING sum(size) >= {LEAST_RUN}),
spans AS (SELECT doc_id, count(*) AS n, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM runs GROUP BY doc_id),
gone AS (SELECT p.doc_id, p.nth FROM placed p JOIN runs r ON p.doc_id = r.doc_id AND p.stop > r.start AND p.stop <= r.stop),
kept AS (SELECT p.doc_id, string_agg(p.unit, '' ORDER BY p.nth) AS text FROM part p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.nth = g.nth WHERE g.nth IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_removed, coalesce(s.removed, '') AS removed, CASE WHEN d.text IS NULL THEN NULL WHEN s.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
