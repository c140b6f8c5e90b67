"""Notes blocks, regions, readers of every format, and what the queries with SQL leave out."""

from __future__ import annotations

import json
import zipfile

import pytest

from marginalia.functions import blocks as B
from marginalia.operators import ai, blocks, golden, regions, speech
from marginalia.operators.epub import scan_files
from marginalia.sources import books, state
from tests.test_books import library

ITEM = "book_id long, chapter_index int"

TEXT = """The Road
He went on.(1) And on.

NOTES
1. First note
that runs on
2. Second note

CHAPTER II
THE OTHER ROAD

More prose, and more of it.(1)

NOTES TO CHAPTER II
1. Other first
2. Other second""".split("\n")


def test_blocks_and_prose():
    found = B.notes_blocks(TEXT)
    assert [(b.header, b.start, b.stop) for b in found] == [(3, 4, 8), (13, 14, 16)]
    assert found[0].middle(len(TEXT)) and not found[1].middle(len(TEXT))
    kept = [x for x in B.prose_view(TEXT) if x]
    assert kept == ["The Road", "He went on.(1) And on.", "CHAPTER II", "THE OTHER ROAD", "More prose, and more of it.(1)"]
    assert [(d.marker, d.text, d.chapter_token) for d in B.block_definitions(TEXT)] == [("1", "First note that runs on", None), ("2", "Second note", None), ("1", "Other first", 2), ("2", "Other second", 2)]
    assert B.notes_blocks([]) == [] and B.prose_view(["only prose"]) == ["only prose"] and B.excluded([]) == []
    assert B.logical_label(TEXT).token == 2 and B.logical_label(["prose"]) is None


@pytest.mark.parametrize(
    ("text", "raw", "context", "at"),
    [
        ("He  went\nto the king(3) and on", "(3)", "went to the king(3) and on", 20),
        ("He went to the king and on", "(3)", "went to the king(3) and on", 19),
        ("Other words (3) here", "(3)", "nothing of it (3)", 12),
        ("The end of it", "*", "The end of it", 13),
        ("Other words", "(3)", "nothing of it (3)", None),
    ],
)
def test_relocation(text, raw, context, at):
    assert B.relocated(text, raw, context) == at


def test_spoken_words():
    assert [B.spoken_word(*x) for x in (("word", " next"), ("word", ", then"), ("star* ", ", then"), ("“", "Word"), ("end", ""))] == ["word ", "word", "star", "“", "end"]


def test_relocated_rows(spark):
    anchors = spark.createDataFrame([(1, 0, "(1)", "went on.(1) And"), (1, 0, "(9)", "nowhere")], f"{ITEM}, marker_raw string, context string")
    texts = spark.createDataFrame([(1, 0, "He went on.(1) And on.")], f"{ITEM}, text string")
    assert {r["marker_raw"]: r["raw_position"] for r in blocks.relocated(anchors, texts).collect()} == {"(1)": 11, "(9)": None}


def test_leads_and_spill_over(spark):
    notes = "the last of the note before\n" + "\n".join(f"{k}. A note that says enough to count as one here" for k in (8, 9))
    items = spark.createDataFrame([(1, 0, "CHAPTER I\n\nProse here."), (1, 1, notes), (1, 2, None)], f"{ITEM}, text string")
    leads = blocks.leads(items)
    assert [(r["lead"], r["resumes"]) for r in leads.orderBy("chapter_index").collect()] == [("", False), ("the last of the note before", True), ("", False)]
    defs = spark.createDataFrame([(1, 0, 0, "6", "Six."), (1, 0, 1, "7", "Seven is")], f"{ITEM}, def_ord int, marker string, text string")
    assert [r["text"] for r in regions.spilled_over(defs, leads).orderBy("def_ord").collect()] == ["Six.", "Seven is the last of the note before"]


def test_rescue_takes_names_first(spark):
    needed = spark.createDataFrame([(1, 0, "G", "3"), (1, 0, "G", "4"), (1, 0, "G", "5")], f"{ITEM}, chapter_group string, marker string")
    text = spark.createDataFrame([(1, 0, "G", 100, "in (3) ways, said Ransom (3) and (4) more")], f"{ITEM}, chapter_group string, pos long, text string")
    found = {r["marker"]: r["position"] for r in regions.rescued_in_regions(needed, text).collect()}
    assert found == {"3": 125, "4": 133}


def test_navigation_document(spark):
    import io

    nav = '<nav epub:type="toc"><ol><li><a href="one.xhtml#a">The <b>Road</b></a></li><li><a href="x/Two.xhtml">Two</a></li></ol></nav><nav epub:type="landmarks"><a href="no.xhtml">No</a></nav>'
    opf = '<package><manifest><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="toc" href="toc.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/><itemref idref="c1"/></spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("c.opf", opf)
        z.writestr("one.xhtml", "<p>One</p>")
        z.writestr("toc.xhtml", nav)
    items, toc = books.open_epub(out.getvalue())
    assert [i["item_id"] for i in items] == ["c1"] and len(books.open_epub(out.getvalue(), once=False)[0]) == 2
    assert [(t["file_base"], t["label"], t["fragment"]) for t in toc] == [("one.xhtml", "The Road", "a"), ("two.xhtml", "Two", None)]


def test_speech_reads_items_as_often_as_the_spine_names_them(spark, tmp_path):
    data = books.contents(spark, books.discover(spark, library(tmp_path / "lib")))
    assert [r["chapter_index"] for r in books.speech_items(data).orderBy("chapter_index").collect()] == [0, 1, 2, 3]


def test_scan_of_every_format(spark, tmp_path):
    rows = scan_files(books.contents(spark, books.discover(spark, library(tmp_path / "lib")))).collect()
    by_source = {s: [r for r in rows if r["source"] == s] for s in ("epub", "text", "pdf")}
    assert {r["marker"] for r in by_source["epub"] if r["marker"]} >= {"1"} and any(r["error"] for r in by_source["epub"])
    assert [r["error"] for r in by_source["pdf"]] == ["PDF support is not installed"]
    assert any(r["file_name"] == "a.txt" for r in by_source["text"]) or by_source["text"] == []


@pytest.mark.parametrize(
    ("given", "whole"),
    [(None, ai.ENDPOINT), (' "" ', ai.ENDPOINT), ("http://h:1/v1/", "http://h:1/v1/chat/completions"), ("https://h", "https://h/v1/chat/completions"), ("http://h/V1/Chat/Completions", "http://h/V1/Chat/Completions"), ("http://h/proxy", "http://h/proxy")],
)
def test_endpoints(given, whole):
    assert ai.endpoint(given) == whole


def test_save_keeps_one_whole_state(spark, tmp_path):
    path = str(tmp_path / "rows")
    for k in (1, 2):
        state.save(spark.createDataFrame([(k,)], "n int"), path)
        assert [r["n"] for r in state.load(spark, path, lines=True).collect()] == [k]
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_goldens_are_a_file_a_book(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "book_id long, order_key long, marker string")
    golden.write_golden(rows, {"marker_profile": "numeric"}, str(tmp_path / "off"), enabled=False)
    golden.write_golden(rows, {"marker_profile": "numeric"}, str(tmp_path / "on"))
    assert not (tmp_path / "off").exists()
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "on").glob("*/*.json")}
    assert {k: [r["marker"] for r in v["rows"]] for k, v in found.items()} == {"book_id=1": ["a", "b"], "book_id=2": ["c"]}
    assert found["book_id=1"]["scan_options"] == {"marker_profile": "numeric"}


def test_audio_is_encoded_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "two", "v"), (1, 1, "one", "v"), (2, 1, None, "w")], "book_id long, seq int, text string, voice string")
    found = {r["book_id"]: bytes(r["audio"]) for r in speech.encoded(rows, lambda t, v: f"{v}:{t};".encode(), b"".join).collect()}
    assert found == {1: b"v:one;v:two;", 2: b"w:;"}


def test_status_of_streams(spark, tmp_path):
    import time

    from marginalia.streaming.progress import Status, save_positions

    said: list[str] = []
    listener = Status(said.append)
    spark.streams.addListener(listener)
    try:
        schema = "book_id long, position_ms long"
        spark.createDataFrame([(1, 5)], schema).write.parquet(f"{tmp_path}/in")
        save_positions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
        for _ in range(50):
            if "ended" in said:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert said[0].startswith("started") and "batch 0: 1 rows" in said and said[-1] == "ended"
