"""Books from files, HTML, pairing, repair, review, golden files, speech, language-model questions and streams."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from marginalia.operators import ai, golden, headings, repair, review, scan, speech
from marginalia.operators.pairing import pair
from marginalia.sources import books, html
from marginalia.streaming import progress

OPF = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c2" href="two.xhtml" media-type="application/xhtml+xml"/><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/>
<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml"/><item id="lost" href="lost.xhtml" media-type="application/xhtml+xml"/><item id="css" href="a.css" media-type="text/css"/></manifest>
<spine><itemref idref="nav"/><itemref idref="c1"/><itemref idref="c2"/><itemref idref="c1"/><itemref idref="css"/><itemref idref="lost"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>The Road</text></navLabel><content src="one.xhtml#a"/></navPoint><navPoint><navLabel><text>Later</text></navLabel><content src="one.xhtml#b"/></navPoint></navMap></ncx>"""
ONE = '<html><body><h1>CHAPTER I</h1><p>He went.<a href="#fn1"><sup>1</sup></a> And on, see note <a href="#fn2">2</a>.</p><p>Stars<a href="two.xhtml#fn9" epub:type="noteref">*</a></p><p class="footnote" id="fn1">The first note.</p></body></html>'


def library(path):
    (path / "sub").mkdir(parents=True)
    (path / "tests").mkdir()
    with zipfile.ZipFile(path / "Book One.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", OPF)
        z.writestr("O/toc.ncx", NCX)
        z.writestr("O/one.xhtml", ONE)
        z.writestr("O/two.xhtml", "<p>Second &amp; last.</p>")
    (path / "sub" / "a.txt").write_bytes("Text.(1)\nNOTES\n1. One\n2. Two \xff".encode("latin-1"))
    (path / "b.html").write_text("<html><body><p>Page</p><p>text</p></body></html>")
    (path / "c.pdf").write_bytes(b"%PDF")
    (path / "broken.epub").write_bytes(b"no zip")
    (path / "tests" / "x.txt").write_text("left out")
    return str(path)


def test_books(spark, tmp_path):
    found = books.discover(spark, library(tmp_path / "lib"))
    assert sorted(r["label"] for r in found.collect()) == ["Book_One", "a", "b", "broken", "c"]
    data = books.contents(spark, found).cache()
    parts = books.epub_parts(data)
    items = {r["chapter_index"]: r for r in books.spine_items(parts).collect()}
    assert [items[k]["item_id"] for k in range(3)] == ["c1", "c2", "lost"] and items[2]["html"] == "" and "He went" in items[0]["html"]
    assert parts.where("kind = 'error'").count() == 1
    toc = books.toc_entries(parts)
    assert [(r["label"], r["fragment"]) for r in toc.orderBy("ord").collect()] == [("The Road", "a"), ("Later", "b")]
    labels = books.toc_labels(toc).first()
    assert labels["label"] == "The Road" and not labels["good"]
    texts = {r["file_name"]: r["text"] for r in books.text_items(data).collect()}
    assert texts["a.txt"].endswith("2. Two ") and texts["b.html"] == "Page\ntext"
    assert books.pdf_items(data).first()["error"] is not None
    whole = books.book_text(spark.createDataFrame([(1, 1, "c d"), (1, 0, "a b")], "book_id long, chapter_index int, text string"), 3).first()
    assert whole["text"] == "a b c" and whole["n_words"] == 3
    nav = spark.createDataFrame([("O/nav.xhtml", "x"), ("a", "\n Contents.\nx"), ("b", "Prose")], "chapter_name string, text string")
    assert [r["chapter_name"] for r in books.without_navigation(nav).collect()] == ["b"]


def test_requests(spark):
    raw = ["/a/b.epub", '{"path": "x", "options": {"markerProfile": "numeric", "allow_ai_pairing": false}}', '{"file_path": "y"}']
    rows = books.requests(spark.createDataFrame([(r,) for r in raw], "request string")).collect()
    assert [tuple(r) for r in rows] == [("/a/b.epub", "auto_heur", True, False), ("x", "numeric", False, False), ("y", "auto_heur", True, False)]


def test_pronunciations(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Eru": "x"}')
    assert books.pronunciations(spark, str(tmp_path / "p.json")) == {"Eru": "x"} and books.pronunciations(spark, str(tmp_path / "none.json")) == {}


def test_html(spark):
    pages = spark.createDataFrame([(1, 0, "one.xhtml", ONE)], "book_id long, chapter_index int, file_key string, html string")
    rows = html.elements(pages).cache()
    keys = ["book_id", "chapter_index"]
    found = {r["marker"]: r for r in html.anchors(rows, keys).collect()}
    assert set(found) == {"1", "*"} and found["1"]["frag"] == "fn1" and found["1"]["has_href"]
    text = html.page_text(pages).first()["text"]
    assert text[found["1"]["position"] :].startswith("1")
    assert [(r["def_id"], r["text"]) for r in html.definitions(rows, keys).collect()] == [("fn1", "The first note.")]
    assert [r["label"] for r in html.headings(rows, keys).collect()] == ["CHAPTER I"]
    assert html.bidirectional(rows).first()["anchors"] == 1
    defs = spark.createDataFrame([(1, "a", "f"), (1, "a", "g"), (1, "b", "f")], "book_id long, def_id string, file_key string")
    assert [r["def_id"] for r in html.colliding_ids(defs).collect()] == ["a"]


ANCHOR = "book_id long, chapter_index int, anchor_ord int, marker string, marker_raw string, context string, position long, href string, frag string, chapter_group string"
LOCAL = "book_id long, chapter_index int, def_ord int, marker string, text string, char_position long"
OTHER = "book_id long, def_ord int, marker string, text string, chapter_group string, origin_index int"


def test_pairing_ladder(spark):
    def a(n, marker, group=None, context="", frag=None, chapter=5, position=10):
        return (1, chapter, n, marker, marker, context, position, None, frag, group)

    anchors = [
        a(1, "1", frag="x"), a(2, "2"), a(3, "3"), a(4, "4"), a(5, "4"), a(6, "5"), a(7, "5"), a(8, "5"), a(9, "5"), a(10, "6"), a(11, "6"), a(12, "7"), a(13, "7"), a(14, "7", position=900),
        a(15, "b"), a(16, "9"), a(17, "10", "PART_ONE"), a(18, "11", "G"), a(19, "12", context="Then Elrond met Gandalf at Rivendell"), a(20, "13"), a(21, "c"),
    ]
    local = [(1, 5, 1, "2", "two", 50), (1, 5, 2, "4", "four", 60), (1, 5, 3, "5", "five", 70), (1, 5, 4, "6", "six a", 80), (1, 5, 5, "6", "six b", 90), (1, 5, 6, "7", "seven a", 100), (1, 5, 7, "7", "seven b", 1000)]
    others = [
        (1, 1, "b", "near", None, 6), (1, 2, "b", "far", None, 9), (1, 3, "9", "nine", None, 2), (1, 4, "10", "ten near", None, 6), (1, 5, "10", "ten far", None, 9), (1, 6, "11", "eleven a", "G", 3), (1, 7, "11", "eleven b", "G", 3),
        (1, 8, "12", "Elrond and Gandalf spoke", None, 1), (1, 9, "12", "nothing of it", None, 9), (1, 10, "13", "x", None, 1), (1, 11, "13", "y", None, 9), (1, 12, "c", "p", None, 1), (1, 13, "c", "q", None, 9),
    ]
    ids = [(1, None, "x", "by id")]
    rows = pair(spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(local, LOCAL), spark.createDataFrame(others, OTHER), spark.createDataFrame(ids, "book_id long, file_key string, def_id string, text string"))
    found = {r["anchor_ord"]: (r["match_method"], r["confidence_score"], r["suggested_definition"]) for r in rows.collect()}
    assert found == {
        1: ("id_link", 0.98, "by id"), 2: ("marker_unique", 0.9, "two"), 3: ("none", 0.0, None), 4: ("marker_repeat_first", 0.85, "four"), 5: ("marker_repeat_reuse", 0.85, "four"),
        6: ("marker_repeat_unpaired", 0.5, None), 7: ("marker_repeat_unpaired", 0.5, None), 8: ("marker_repeat_unpaired", 0.5, None), 9: ("marker_repeat_unpaired", 0.5, None),
        10: ("marker_order", 0.75, "six a"), 11: ("marker_order", 0.75, "six b"), 12: ("marker_order_low", 0.55, "seven a"), 13: ("marker_order_low", 0.55, "seven b"), 14: ("proximity_local", 0.55, "seven b"),
        15: ("global_nearest", 0.65, "near"), 16: ("global_unique", 0.65, "nine"), 17: ("global_nearest_order", 0.66, "ten near"), 18: ("global_same_source_order", 0.6, "eleven a"), 19: ("global_context", 0.62, "Elrond and Gandalf spoke"),
        20: ("none", 0.5, None), 21: ("ai", 0.55, None),
    }
    waiting = rows.where("ai_status = 'pending'").first()
    assert waiting["candidates"] == ["p", "q"] and waiting["order_key"] == 5_000_000_010


def test_language_model(spark):
    rows = spark.createDataFrame([(1, 0, k, "c", "ctx", ["p", "q"], 0.55, "Manual Review Required", "pending", None) for k in range(1, 8)], "book_id long, chapter_index int, id long, marker string, context string, candidates array<string>, confidence_score double, confidence string, ai_status string, suggested_definition string")

    def client(prompt: str, tokens: int) -> str | None:
        if "ID: 7" in prompt:
            return None
        return "ID:1 BEST:C1 CONF:0.80\nnoise\nid: 2 best: none conf: 0.9\nID:3 BEST:C9 CONF:1.0\nID:5 BEST:C0 CONF:0.10"

    found = {r["id"]: (r["ai_status"], r["suggested_definition"], r["confidence_score"], r["confidence"]) for r in ai.disambiguate(rows, client).collect()}
    assert found[1] == ("matched", "q", 0.8, "AI Match (0.80)") and found[2] == ("none", None, 0.5, "Manual Review Required") and found[5] == ("matched", "p", 0.55, "AI Match (0.55)")
    assert found[3][0] == found[4][0] == "unparsed" and found[6][0] == found[7][0] == "unavailable"
    profiles = ai.profiles(spark.createDataFrame([(1, "x"), (2, None)], "book_id long, text string"), lambda p, n: " Numeric indeed")
    assert {r["book_id"]: r["profile"] for r in profiles.collect()} == {1: "numeric", 2: None}
    assert ai.header_line(["a", "NOTES", "1. x"], [1], lambda p, n: "1") == 1 and ai.header_line(["a"], [0], lambda p, n: "NONE") is None


def test_repair(spark):
    rows = spark.createDataFrame([("G", "1", "id_link", 0.98), ("G", "1", "marker_order", 0.75), ("G", "2", "orphan_definition", 0.4), ("G", "2", "marker_unique", 0.9), ("G", "3", "recovered_anchor", 0.65), ("G", "3", "marker_unique", 0.9), ("G", "4", "orphan_definition", 0.4)], "g string, marker string, match_method string, confidence_score double")
    left = repair.without_weak_recovered(repair.without_covered_orphans(repair.prefer_links(rows, ["g"]), ["g"]), ["g"])
    assert sorted((r["marker"], r["match_method"]) for r in left.collect()) == [("1", "id_link"), ("2", "marker_unique"), ("3", "marker_unique"), ("4", "orphan_definition")]
    swap = [(1, c, p, str(k), t, alt, "marker_unique", 0.9, "x") for k in range(5) for c, p, t, alt in (("PART", None, f"child {k}", f"parent {k}"), ("CH", "PART", f"parent {k}", f"child {k}"))]
    swapped = repair.swap_parent_child(spark.createDataFrame(swap, "book_id long, chapter_group string, parent_group string, marker string, suggested_definition string, alt_definition string, match_method string, confidence_score double, confidence string"))
    found = {(r["chapter_group"], r["marker"]): (r["suggested_definition"], r["match_method"]) for r in swapped.collect()}
    assert found["CH", "0"] == ("child 0", "structural_child_swap") and found["PART", "3"] == ("parent 3", "structural_parent_swap")
    old = spark.createDataFrame([(1, 0, "none"), (1, 1, "id_link")], "book_id long, chapter_index int, match_method string")
    new = spark.createDataFrame([(1, 0, "id_link"), (1, 1, "none")], "book_id long, chapter_index int, match_method string")
    assert sorted(tuple(r) for r in repair.replaced_items(old, new).collect()) == [(1, 0, "id_link"), (1, 1, "id_link")]
    assert repair.structured_only(old, F.lit(True), F.lit(False)).count() == 1


def test_headings(spark):
    h = spark.createDataFrame([(1, 0, "CHAPTER I"), (1, 50, "Aside"), (1, 100, "CHAPTER II")], "book_id long, pos long, label string")
    p = spark.createDataFrame([(1, 60, "2"), (1, 40, "1"), (1, 100, "1"), (1, 150, "2")], "book_id long, position long, marker string")
    assert sorted((r["pos"], r["label"]) for r in headings.without_weak(h, p, ["book_id"]).collect()) == [(0, "CHAPTER I"), (100, "CHAPTER II")]
    grouped = headings.grouped(headings.last_heading(p, h, ["book_id"]))
    assert sorted((r["position"], r["chapter_token"]) for r in grouped.collect()) == [(40, 1), (60, None), (100, 2), (150, 2)]
    spans = headings.regions(h, spark.createDataFrame([(1, 200)], "book_id long, length long"), ["book_id"])
    assert sorted((r["pos"], r["stop"]) for r in spans.collect()) == [(0, 50), (50, 100), (100, 200)]
    assert headings.outside(p, spans.where("label = 'Aside'").withColumnRenamed("pos", "start"), ["book_id"]).count() == 3
    carried = headings.carried_labels(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b")], "book_id long, chapter_index int, label string"))
    assert [r["label"] for r in carried.orderBy("chapter_index").collect()] == ["a", "a", "b"]


def notes(spark):
    rows = [(k, "epub", f"G{k // 3}", f"CHAPTER {k // 3 + 1}", k // 3, k * 10, str(k), f"ctx {k}", f"def {k}" if k % 2 else None) for k in range(9)]
    return spark.createDataFrame(rows, "id long, source string, chapter_group string, chapter_label string, chapter_index int, position long, marker string, context string, suggested_definition string").withColumn("order_key", F.col("id")).withColumn("book_id", F.lit(1))


def test_review(spark):
    rows = review.reviewed(notes(spark).unionByName(notes(spark).where("id = 0").withColumn("suggested_definition", F.lit("found"))))
    assert rows.count() == 9 and rows.where("id = 0").first()["suggested_definition"] == "found"
    edits = spark.createDataFrame([(1, 1, "confirm", None), (2, 2, "ignore", None), (2, 3, "ignore", None), (3, 4, "ignore", None), (3, 5, "confirm", None), (4, 6, "rematch", "mine"), (5, 7, "rematch", "x"), (5, 8, "rematch", "")], "id long, seq int, action string, value string")
    edited = {r["id"]: (r["user_status"], r["user_definition"]) for r in review.with_edits(notes(spark), edits).collect()}
    assert edited[1] == ("confirmed", None) and edited[2] == (None, None) and edited[3] == ("confirmed", None) and edited[4] == (None, "mine") and edited[5] == (None, None)
    assert review.confirm_all(notes(spark)).where("user_status = 'confirmed'").count() == 9
    keyed = review.reviewed(notes(spark))
    once = review.toggle_chapter(keyed, "epub:G0", "ignored")
    assert once.where("user_status = 'ignored'").count() == 3 and review.toggle_chapter(once, "epub:G0", "ignored").where("user_status is not null").count() == 0
    assert [r["definitions"] for r in review.definitions_by_marker(keyed).where("marker = '1'").collect()] == [["def 1"]]
    hits = review.occurrences(spark.createDataFrame([(1, "aXbxb"), (2, None), (3, "😀x")], "k int, text string"), "x")
    assert sorted((r["k"], r["offset"]) for r in hits.collect()) == [(1, 1), (1, 3), (3, 1)]
    assert review.next_hit(hits.where("k = 1"), ["k"], 2).first()["offset"] == 3 and review.next_hit(hits.where("k = 1"), ["k"], 4).first()["offset"] == 1
    words = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 150), (1, 2, "c", 400)], "book_id long, seq long, word string, start_ms long")
    paras = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 300)], "book_id long, seq long, start_ms long, end_ms long")
    assert [r["paragraph_seq"] for r in review.words_in_paragraphs(words, paras).orderBy("seq").collect()] == [0, 1, None]
    assert review.span_at(paras, 100).first()["seq"] == 1
    assert review.read_marks(paras, spark.createDataFrame([(1, 120)], "book_id long, position_ms long")).count() == 1
    sessions = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "book_path string, seq int")
    assert [(r["book_path"], r["recency"]) for r in review.last_sessions(sessions).orderBy("recency").collect()] == [("a", 1), ("b", 2)]


def test_golden(spark, tmp_path):
    rows = notes(spark).drop("book_id")
    assert golden.compare(rows, rows)[0]
    changed = rows.withColumn("confidence", F.lit("x")).where("id <> 8")
    same, counts, diff = golden.compare(rows.withColumn("confidence", F.lit("y")), changed)
    assert not same and [r["status"] for r in counts.collect()] == ["count"] and diff.count() == 6 and diff.first()["columns"] == ["confidence"]
    golden.write_golden(rows, {"marker_profile": "numeric"}, str(tmp_path / "g"))
    assert golden.compare(rows, golden.read_golden(spark, str(tmp_path / "g")))[0] or golden.read_golden(spark, str(tmp_path / "g")).count() == 9
    folder = tmp_path / "goldens"
    folder.mkdir()
    (folder / "My_Book_20240102_030405.json").write_text(json.dumps([{"marker": "1"}]))
    (folder / "other.json").write_text("[]")
    files = golden.goldens(spark, str(folder))
    assert [(r["label"], r["date"]) for r in files.collect()] == [("My_Book", "20240102")]
    assert golden.for_books(files, spark.createDataFrame([("My_Book", "/b")], "label string, path string")).first()["book_path"] == "/b"


def test_speech(spark):
    items = spark.createDataFrame([(1, 0, "One two(1) three. Four five.")], "book_id long, chapter_index int, text string")
    rows = spark.createDataFrame([(1, 0, 7, "1", "(1)", "a note")], "book_id long, chapter_index int, position long, marker string, marker_raw string, suggested_definition string")
    parts = speech.with_voice(speech.segments(items, rows), "v", "w")
    assert [(r["voice_type"], r["voice"]) for r in parts.orderBy("seq").collect()] == [("prose", "v"), ("footnote", "w"), ("prose", "v")]
    assert speech.segments(items, None, "as_is").first()["text"] == "One two(1) three. Four five."
    paras = speech.paragraph_rows(items.withColumn("voice", F.lit("v")), ["book_id", "voice"])
    timed = speech.timed(speech.synthesised(paras, lambda text, voice: 2400 * len(text.split())), ["book_id"])
    assert timed.first()["end_ms"] == 500 and speech.totals(timed, ["book_id"]).first()["duration_s"] == 0.5
    words = spark.createDataFrame([(1, 0, "One ", 0, 100)], "book_id long, n int, word string, start_ms long, end_ms long")
    para = spark.createDataFrame([(1, "One two", 900)], "book_id long, text string, end_ms long")
    assert [r["word"] for r in speech.fill_gaps(words, para, ["book_id"]).orderBy("n").collect()] == ["One ", "two "]
    packed = speech.timestamps_json(words.withColumnRenamed("n", "seq"), spark.createDataFrame([(1, 0, "One two", 0, 900)], "book_id long, seq int, text string, start_ms long, end_ms long"), spark.createDataFrame([(1, "One two", "stem")], "book_id long, text string, book_stem string"))
    assert json.loads(packed.first()["json"])["paragraphs"] == [{"text": "One two", "start_ms": 0, "end_ms": 900}]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "book_id long, position_ms long")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("book_id long, position_ms long").json(str(tmp_path / "in"))
    progress.save_positions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r["book_id"]: r["position_ms"] for r in progress.positions(spark, str(tmp_path / "out")).collect()} == {1: 9, 2: 3}
    new = tmp_path / "new"
    new.mkdir()
    (new / "a.txt").write_text("He met Ransom there.(1) Then he left the hall.(2)\nNOTES\n1. One.\n2. Two.")
    progress.scan_new(spark, str(new), str(tmp_path / "cp2"), scan.scan, str(tmp_path / "rows")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted((r["marker"], r["suggested_definition"]) for r in found.collect()) == [("1", "One."), ("2", "Two.")]
    log = spark.createDataFrame([(1, 1, [("b",)], ("B",)), (1, 0, [("a",)], ("A",))], "book_id long, seq int, w array<struct<word:string>>, p struct<text:string>")
    assert [w["word"] for w in progress.folded(log).first()["timestamps"]] == ["a", "b"]


def test_outliers_only_go_down(spark):
    rows = spark.createDataFrame([(1, "text", 0, "I" if k == 7 else str(k), "I" if k == 7 else f"({k})", "marker_unique", 0.9, "High", k) for k in range(12)], "book_id long, source string, chapter_index int, marker string, marker_raw string, match_method string, confidence_score double, confidence string, order_key long")
    found = {r["marker"]: (r["confidence_score"], r["confidence"], r["confidence_flags"]) for r in repair.outlier_penalty(rows).collect()}
    assert found["I"] == (0.55, "Low (Marker Outlier)", ["marker_family_outlier"]) and all(v[0] == 0.9 for k, v in found.items() if k != "I")


def test_chapter_headings():
    from marginalia.functions import chapters

    lines = ["CHAPTER I", "THE LONG ROAD", "", "It was late.", "II. THE SHORT ROAD", "Prose goes on here.", "NOTES", "1. A note", "3. THE THIRD NOTE", "4.", "", "[PART TWO].(1)", "More prose.", "III", "", "Another Title Here", "prose"]
    found = chapters.headings(lines)
    assert [(h.label, h.token) for h in found] == [("CHAPTER I THE LONG ROAD", 1), ("II. THE SHORT ROAD", 2), ("[PART TWO].", None), ("III. Another Title Here", 3)]
    assert all("\n".join(lines)[h.pos :].startswith(h.label.split(" ")[0].split(".")[0]) for h in found)
    assert chapters.file_label("O/chapter_07.xhtml") == ("CHAPTER 7", 7) and chapters.file_label("x.html") is None
    assert chapters.notes_end(["NOTES", "1. a", "THE NEXT PART", "THE LONG ROAD", "prose"], 0) == 2


def test_scan_of_books(spark, tmp_path):
    from marginalia.operators import epub

    data = books.contents(spark, books.discover(spark, library(tmp_path / "lib")))
    found = {r["marker"]: r for r in epub.scan_books(data).collect()}
    assert found["1"]["match_method"] == "id_link" and found["1"]["suggested_definition"] == "The first note." and found["1"]["chapter_group"] == "CHAPTER_I"
    assert found["*"]["match_method"] == "none" and found["1"]["order_key"] < found["*"]["order_key"]


def test_state(spark, tmp_path):
    from datetime import datetime

    from marginalia.sources import state

    assert state.load(spark, str(tmp_path / "none.json"), state.STATE) is None
    (tmp_path / "s.json").write_text(json.dumps({"preferences": {"a": "b"}, "sessions": [{"bookPath": "x", "outputPath": "o", "readingPositionMs": 5}, {"bookPath": "y"}]}))
    rows = state.sessions(state.load(spark, str(tmp_path / "s.json"), state.STATE))
    assert [r["book_path"] for r in rows.orderBy("seq").collect()] == ["x", "y"]
    assert [r["book_path"] for r in state.used(rows, "x").orderBy("seq").collect()] == ["y", "x"]
    folders = state.output_folders(spark.createDataFrame([("/a/The Book.epub",), ("/b/The Book.epub",)], "path string"))
    assert sorted(r["folder"] for r in folders.collect()) == ["The_Book", "The_Book_2"]
    assert state.golden_name(spark.createDataFrame([("My Book",)], "label string"), datetime(2024, 1, 2, 3, 4, 5)).first()["file"] == "My_Book_20240102_030405.json"
    document = json.loads(state.result_document(notes(spark)).first()["json"])
    assert [r["id"] for r in document] == list(range(9))
    state.save(notes(spark), str(tmp_path / "rows"))
    assert state.load(spark, str(tmp_path / "rows"), lines=True).count() == 9
