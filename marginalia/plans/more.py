"""Queries of filters, rescues, labels and HTML conventions, with their SQL. Registered beside those of registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import blocks, regions, repair, review
from marginalia.operators import headings as H
from marginalia.plans import corpus as C
from marginalia.plans.registry import _table, query
from marginalia.sources import html, note_elements

ITEM = ["book_id", "chapter_index"]


def _headings(spark, sf_dir):
    """Headings by item, every seventh line: roman numbers (in even documents), plain numbers, none."""
    kind = F.expr("case when (pos div 7) % 4 = 0 and doc_id % 2 = 0 then 'CHAPTER IV' when (pos div 7) % 4 = 1 then 'CHAPTER 3' else 'Plain words' end")
    return C.headings(spark, sf_dir).select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), "doc_id", (F.col("pos") * 1000).alias("pos"), kind.alias("label"))


_HEAD = """, hd AS (SELECT doc_id // 20 AS book_id, CAST(doc_id % 20 AS INTEGER) AS chapter_index, doc_id, pos * 1000 AS pos,
CASE WHEN (pos // 7) % 4 = 0 AND doc_id % 2 = 0 THEN 'CHAPTER IV' WHEN (pos // 7) % 4 = 1 THEN 'CHAPTER 3' ELSE 'Plain words' END AS label FROM heading)"""


@query(_HEAD + """, m AS (SELECT *, max(pos) FILTER (label = 'CHAPTER IV') OVER w AS last, max(label <> 'Plain words') OVER w AS numbered FROM hd WINDOW w AS (PARTITION BY doc_id))
SELECT book_id, chapter_index, pos, label FROM m WHERE CASE WHEN last IS NOT NULL THEN pos <= last ELSE label <> 'Plain words' OR NOT numbered END""", corpus=True)
def flt_structural_headings(spark, sf_dir):
    return regions.structural_headings(_headings(spark, sf_dir)).select(*ITEM, "pos", "label")


@query("SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker, CAST(a.position // 1000 AS INTEGER) AS line_index FROM anchor a", corpus=True)
def jn_line_of_position(spark, sf_dir):
    anchors = C.anchors(spark, sf_dir).select(*ITEM, "marker", (F.col("position") + 500).alias("position"))
    lines = C.lines(spark, sf_dir).select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), "line_index", (F.col("line_index") * 1000).cast("long").alias("line_start"))
    return regions.lines_of(anchors, lines).select(*ITEM, "marker", "line_index")


@query(_HEAD + """ SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker FROM anchor a WHERE NOT EXISTS (SELECT 1 FROM hd h WHERE h.doc_id = a.doc_id AND h.pos = a.position AND h.label <> 'Plain words')""", corpus=True)
def flt_off_headings(spark, sf_dir):
    heads = _headings(spark, sf_dir).select(*ITEM, F.expr("int(pos div 1000)").alias("line_index"), F.when(F.col("label") == "Plain words", "PART TWO").otherwise(F.col("label")).alias("label"))
    return regions.off_headings(C.anchors(spark, sf_dir).withColumn("line_index", F.expr("int(position div 1000)")), heads).select(*ITEM, "marker")


@query(_HEAD + """, e AS (SELECT doc_id, 9000 AS stop FROM numbered GROUP BY doc_id HAVING doc_id % 3 = 0), n AS (SELECT e.doc_id, e.stop, min(h.pos) AS pos FROM e JOIN hd h ON h.doc_id = e.doc_id AND h.pos > e.stop GROUP BY ALL)
SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker FROM anchor a LEFT JOIN n ON n.doc_id = a.doc_id AND a.position >= n.stop AND a.position < n.pos AND n.pos - n.stop >= 40 WHERE n.doc_id IS NULL OR a.anchor_ord % 4 = 0""", corpus=True)
def flt_outside_gaps(spark, sf_dir):
    anchors = C.anchors(spark, sf_dir).withColumn("href", F.when(F.expr("anchor_ord % 4 = 0"), "#n"))
    ends = C.numbered(spark, sf_dir).where("doc_id % 3 = 0").select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.lit(9000).cast("long").alias("stop")).distinct()
    return regions.outside_gaps(anchors, ends, _headings(spark, sf_dir)).select(*ITEM, "marker")


_GROUPS = "'G' || (a.anchor_ord % 5)"


@query(_HEAD + f""", h AS (SELECT doc_id FROM hd GROUP BY doc_id HAVING count(*) >= 2), g AS (SELECT DISTINCT doc_id, 'G' || (def_ord % 5) AS grp FROM definition WHERE def_ord % 5 < 3)
SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker FROM anchor a LEFT JOIN h USING (doc_id) LEFT JOIN g ON g.doc_id = a.doc_id AND g.grp = {_GROUPS} WHERE a.anchor_ord % 7 = 0 OR h.doc_id IS NULL OR g.doc_id IS NOT NULL""", corpus=True)
def flt_defined_groups(spark, sf_dir):
    group = lambda c: F.concat(F.lit("G"), F.expr(f"{c} % 5").cast("string"))
    anchors = C.anchors(spark, sf_dir).withColumn("chapter_group", group("anchor_ord")).withColumn("href", F.when(F.expr("anchor_ord % 7 = 0"), "#n"))
    defs = C.definitions(spark, sf_dir).where("def_ord % 5 < 3").withColumn("chapter_group", group("def_ord"))
    return regions.in_defined_groups(anchors, defs, _headings(spark, sf_dir)).select(*ITEM, "marker")


@query("""SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker FROM anchor a WHERE NOT EXISTS (SELECT 1 FROM definition d WHERE d.book_id = a.book_id AND d.def_ord = a.anchor_ord
AND starts_with(lower(CASE WHEN a.anchor_ord % 2 = 0 THEN 'Note ' || md5(a.doc_id || '-' || a.anchor_ord) || ' and more' ELSE a.text END), lower(substring(d.text, 1, 40))))""", corpus=True)
def flt_definition_heads(spark, sf_dir):
    own = F.concat(F.lit("Note "), F.md5(F.concat(F.expr("book_id * 20 + chapter_index").cast("string"), F.lit("-"), "marker")), F.lit(" and more"))
    anchors = C.anchors(spark, sf_dir).withColumn("after", F.when(F.expr("anchor_ord % 2 = 0"), own).otherwise(F.col("context")))
    return regions.without_definition_heads(anchors, C.definitions(spark, sf_dir)).select(*ITEM, "marker")


@query("""SELECT conv_id AS book_id, CAST(turn AS INTEGER) AS chapter_index FROM conversations c WHERE NOT (conv_id % 3 = 0 AND turn % 2 = 0)""")
def flt_appendix_tails(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"))
    # every item gets 60 numbers up to 120 and 30 letters; the label is inherited in some, and others have too few letters
    n = F.explode(F.sequence(F.lit(1), F.lit(90))).alias("n")
    defs = rows.select(*ITEM, n).where("n <= 60 or book_id % 3 = 0 or n <= 75").withColumn("marker", F.when(F.col("n") <= 60, (2 * F.col("n")).cast("string")).otherwise("x"))
    return regions.without_appendix_tails(rows, defs.withColumn("inherited", F.expr("chapter_index % 2 = 0"))).select(*ITEM)


@query("""SELECT d.book_id, d.chapter_index, 'G' || (d.def_ord // 20) AS chapter_group, CAST(d.def_ord AS VARCHAR) AS marker, d.text AS suggested_definition FROM definition d LEFT JOIN anchor a ON a.doc_id = d.doc_id AND a.anchor_ord = d.def_ord
JOIN (SELECT doc_id, anchor_ord // 20 AS g, min(anchor_ord) AS least, max(anchor_ord) AS most, count(*) AS n FROM anchor GROUP BY ALL) s ON s.doc_id = d.doc_id AND s.g = d.def_ord // 20
WHERE a.doc_id IS NULL AND d.def_ord BETWEEN 1 AND 9 AND s.n >= 2 AND d.def_ord > s.least AND d.def_ord < s.most""", corpus=True)
def syn_region_orphans(spark, sf_dir):
    group = lambda c: F.concat(F.lit("G"), F.expr(f"{c} div 20").cast("string"))
    found = regions.missing_in_regions(C.anchors(spark, sf_dir).withColumn("chapter_group", group("anchor_ord")), C.definitions(spark, sf_dir).withColumn("chapter_group", group("def_ord")))
    return found.select(*ITEM, "chapter_group", "marker", "suggested_definition")


@query("""SELECT n.doc_id // 20 AS book_id, CAST(n.doc_id % 20 AS INTEGER) AS chapter_index, CAST(n.k AS VARCHAR) AS marker, CAST(100 + length('He met Ransom Smith') + 1 AS BIGINT) AS position FROM numbered n WHERE anchored""", corpus=True)
def anc_region_rescue(spark, sf_dir):
    a = C.anchors(spark, sf_dir).withColumn("chapter_group", F.concat(F.lit("G"), "marker"))
    text = F.concat(F.lit("He met Ransom Smith ("), "marker", F.lit(") there, as ("), "marker", F.lit(") says."))
    found = regions.rescued_in_regions(a.select(*ITEM, "chapter_group", "marker"), a.select(*ITEM, "chapter_group", F.lit(100).cast("long").alias("pos"), text.alias("text")))
    return found.select(*ITEM, "marker", "position")


@query("""SELECT a.book_id, a.chapter_index, count(*) AS n, count(d.text) AS paired FROM anchor a LEFT JOIN definition d ON a.doc_id = d.doc_id AND a.anchor_ord = d.def_ord
WHERE a.doc_id % 2 = 0 OR EXISTS (SELECT 1 FROM definition x WHERE x.doc_id = a.doc_id) GROUP BY ALL""", corpus=True)
def syn_item_rescue(spark, sf_dir):
    from marginalia.operators.pairing import pair

    anchors, defs = C.anchors(spark, sf_dir), C.definitions(spark, sf_dir)
    some = pair(anchors.where("chapter_index % 2 = 0"), defs)
    return regions.rescued_items(some, anchors, defs).groupBy(*ITEM).agg(F.count("*").alias("n"), F.count("suggested_definition").alias("paired"))


_LABELS = "SELECT *, 'L' || ((anchor_ord * 7 + doc_id) % 3) AS label, anchor_ord % 4 = 0 AS inherited FROM anchor"


def _labelled(spark, sf_dir):
    label = F.concat(F.lit("L"), F.expr("(anchor_ord * 7 + book_id * 20 + chapter_index) % 3").cast("string"))
    return C.anchors(spark, sf_dir).withColumn("chapter_label", label).withColumn("inherited", F.expr("anchor_ord % 4 = 0")).withColumn("order_key", F.col("position"))


@query(f""", l AS ({_LABELS}), c AS (SELECT book_id, chapter_index, label, count(*) AS n, min(position) AS seen FROM l GROUP BY ALL)
SELECT book_id, chapter_index, label AS chapter_label, n FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY n DESC, seen, label) AS k FROM c) WHERE k = 1""", corpus=True)
def agg_dominant_label(spark, sf_dir):
    return regions.dominant_labels(_labelled(spark, sf_dir), ITEM)


@query(f""", l AS ({_LABELS}), c AS (SELECT doc_id, label, count(*) AS n, min(position) AS seen FROM l WHERE NOT inherited GROUP BY ALL),
o AS (SELECT doc_id, label AS own FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen, label) AS k FROM c) WHERE k = 1)
SELECT l.book_id, l.chapter_index, CAST(l.anchor_ord AS VARCHAR) AS marker, CASE WHEN l.inherited THEN coalesce(o.own, l.label) ELSE l.label END AS chapter_label FROM l LEFT JOIN o USING (doc_id)""", corpus=True)
def syn_promoted_labels(spark, sf_dir):
    return regions.promoted_labels(_labelled(spark, sf_dir)).select(*ITEM, "marker", "chapter_label")


@query(f""", l AS ({_LABELS}) SELECT book_id, chapter_index, CAST(anchor_ord AS VARCHAR) AS marker, CASE WHEN doc_id % 2 = 1 THEN label WHEN anchor_ord < 10 THEN label || ' - NOTES Section 1' WHEN anchor_ord < 30 THEN label || ' - NOTES Section 2' ELSE label END AS chapter_label FROM l""", corpus=True)
def syn_section_labels(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("def_position", F.col("anchor_ord").cast("long"))
    spans = F.when(F.expr("chapter_index % 2 = 0"), F.expr("array(named_struct('start', 0, 'stop', 10), named_struct('start', 10, 'stop', 30))")).otherwise(F.expr("array(named_struct('start', 0, 'stop', 99))"))
    found = rows.select(*ITEM).distinct().select(*ITEM, F.explode(spans).alias("s")).select(*ITEM, "s.*")
    return regions.section_labels(rows, found).select(*ITEM, "marker", "chapter_label")


@query(""", r AS (SELECT *, 'G' || chapter_index AS grp, CASE WHEN anchor_ord % 6 = 0 THEN '*' ELSE CAST(anchor_ord % 9 AS VARCHAR) END AS m, CASE WHEN anchor_ord % 2 = 0 THEN 'a' ELSE 'b' END AS series FROM anchor),
p AS (SELECT DISTINCT book_id, grp FROM r GROUP BY book_id, grp, m HAVING count(DISTINCT series) = 2), b AS (SELECT book_id, grp FROM r GROUP BY ALL HAVING count(DISTINCT series) = 2)
SELECT b.book_id, b.grp AS chapter_group, p.grp IS NOT NULL AS overlap FROM b LEFT JOIN p ON p.book_id = b.book_id AND p.grp = b.grp""", corpus=True)
def agg_marker_overlap(spark, sf_dir):
    return regions.shared_markers(_series(spark, sf_dir))


def _series(spark, sf_dir):
    rows = C.anchors(spark, sf_dir).withColumn("chapter_group", F.concat(F.lit("G"), F.col("chapter_index").cast("string"))).withColumn("series", F.expr("if(anchor_ord % 2 = 0, 'a', 'b')"))
    return rows.withColumn("marker", F.expr("if(anchor_ord % 6 = 0, '*', string(anchor_ord % 9))")).withColumn("chapter_label", F.lit("Notes"))


@query(""", r AS (SELECT *, CASE WHEN anchor_ord % 6 = 0 THEN '*' ELSE CAST(anchor_ord % 9 AS VARCHAR) END AS m, anchor_ord % 2 AS series FROM anchor), p AS (SELECT DISTINCT doc_id FROM r GROUP BY doc_id, m HAVING count(DISTINCT series) = 2)
SELECT r.book_id, r.chapter_index, CAST(r.anchor_ord AS INTEGER) AS anchor_ord, CASE WHEN p.doc_id IS NULL THEN 'Notes' WHEN m = '*' THEN 'Notes (Author''s Note)' ELSE 'Notes (Editorial Note)' END AS chapter_label FROM r LEFT JOIN p USING (doc_id)""", corpus=True)
def syn_series_suffix(spark, sf_dir):
    rows = _series(spark, sf_dir)
    return regions.series_suffix(rows, regions.shared_markers(rows)).select(*ITEM, "anchor_ord", "chapter_label")


@query("SELECT book_id, CAST((anchor_ord - 1) % 5 AS VARCHAR) AS marker, chapter_index FROM anchor GROUP BY ALL HAVING count(*) = 1", corpus=True)
def agg_unique_markers(spark, sf_dir):
    return regions.unique_markers(C.anchors(spark, sf_dir).withColumn("marker", F.expr("string((anchor_ord - 1) % 5)"))).select("book_id", "marker", "chapter_index")


@query("""SELECT book_id, chapter_index, count(*) FILTER (anchor_ord % 6 <> 0 OR doc_id % 2 = 0) / count(*) AS coverage, count(*) FILTER (anchor_ord % 6 <> 0 OR doc_id % 2 = 0) >= 0.8 * count(*) AS covered FROM anchor GROUP BY ALL""", corpus=True)
def agg_coverage(spark, sf_dir):
    return regions.covered(C.anchors(spark, sf_dir), F.expr("anchor_ord % 6 <> 0 or chapter_index % 2 = 0"), ITEM)


@query(_HEAD + """, f AS (SELECT doc_id, min(pos) AS first FROM hd WHERE label <> 'Plain words' GROUP BY doc_id)
SELECT a.book_id, a.chapter_index, CAST(min(a.anchor_ord) AS INTEGER) AS least FROM anchor a JOIN f ON f.doc_id = a.doc_id AND a.position >= f.first GROUP BY ALL""", corpus=True)
def win_first_number(spark, sf_dir):
    return regions.first_numbers(C.anchors(spark, sf_dir), _headings(spark, sf_dir).where("label <> 'Plain words'"))


@query("""SELECT book_id, chapter_index, CAST(def_ord AS VARCHAR) AS marker, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY def_ord < 10, def_ord) AS INTEGER) AS rank FROM definition""", corpus=True)
def srt_notes_first(spark, sf_dir):
    defs = C.definitions(spark, sf_dir).withColumn("line_index", F.col("def_ord"))
    return regions.in_scan_order(defs, defs.select(*ITEM).distinct().withColumn("start", F.lit(10))).select(*ITEM, "marker", "rank")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 20 < 6")
def lim_profile_sample(spark, sf_dir):
    items = C.documents(spark, sf_dir).where("text is not null").select("doc_id", F.expr("int(doc_id % 20)").alias("chapter_index"))
    return regions.profile_sample(items).select("doc_id")


@query("""SELECT book_id, CAST(def_ord % 10 AS VARCHAR) AS marker, 'T' || (def_ord % 3) AS text, CAST(min(chapter_index) AS INTEGER) AS chapter_index FROM definition GROUP BY book_id, def_ord % 10, def_ord % 3""", corpus=True)
def set_global_definitions(spark, sf_dir):
    defs = C.definitions(spark, sf_dir).withColumn("marker", F.expr("string(def_ord % 10)")).withColumn("text", F.expr("'T' || (def_ord % 3)"))
    return regions.distinct_definitions(defs, ["book_id"]).select("book_id", "marker", "text", "chapter_index")


@query("""SELECT book_id, chapter_index, CAST(def_ord % 10 AS VARCHAR) AS marker, CAST(def_ord // 30 AS INTEGER) AS line_index, CAST(min(def_ord) AS INTEGER) AS def_ord FROM definition GROUP BY book_id, chapter_index, def_ord % 10, def_ord // 30""", corpus=True)
def set_line_definitions(spark, sf_dir):
    defs = C.definitions(spark, sf_dir).withColumn("marker", F.expr("string(def_ord % 10)")).withColumn("line_index", F.expr("int(def_ord div 30)")).withColumn("text", F.lit("one text"))
    return regions.distinct_definitions(defs, ITEM, by_line=True).select(*ITEM, "marker", "line_index", "def_ord")


@query("""SELECT DISTINCT a.book_id, 'fn' || a.anchor_ord AS frag FROM anchor a WHERE NOT EXISTS (SELECT 1 FROM definition d WHERE d.book_id = a.book_id AND d.def_ord = a.anchor_ord AND d.chapter_index = 0)""", corpus=True)
def set_unknown_fragments(spark, sf_dir):
    anchors = C.anchors(spark, sf_dir).withColumn("frag", F.concat(F.lit("fn"), "marker"))
    return regions.unknown_fragments(anchors, C.definitions(spark, sf_dir).where("chapter_index = 0").select("book_id", F.concat(F.lit("fn"), "marker").alias("def_id")))


@query("""SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker, CASE WHEN a.anchor_ord % 2 = 0 THEN 'kept' ELSE f.text END AS suggested_definition, CASE WHEN a.anchor_ord % 2 = 1 AND f.text IS NOT NULL THEN 'id_link' ELSE 'x' END AS match_method
FROM anchor a LEFT JOIN (SELECT book_id, def_ord, min(text) AS text FROM definition GROUP BY ALL) f ON f.book_id = a.book_id AND f.def_ord = a.anchor_ord""", corpus=True)
def jn_fragment_fill(spark, sf_dir):
    rows = C.anchors(spark, sf_dir).withColumn("frag", F.col("marker")).withColumn("suggested_definition", F.expr("if(anchor_ord % 2 = 0, 'kept', null)"))
    rows = rows.withColumn("match_method", F.lit("x")).withColumn("confidence", F.lit("")).withColumn("confidence_score", F.lit(0.0))
    found = regions.filled_by_fragment(rows, C.definitions(spark, sf_dir).select("book_id", F.col("marker").alias("def_id"), "text"))
    return found.select(*ITEM, "marker", "suggested_definition", "match_method")


@query("""SELECT d.book_id, d.chapter_index, CAST(d.def_ord AS VARCHAR) AS marker, CASE WHEN d.def_ord = max(d.def_ord) OVER (PARTITION BY d.doc_id) AND d.chapter_index % 2 = 0 AND n.doc_id IS NOT NULL THEN d.text || ' runs on into ' || n.doc_id ELSE d.text END AS text
FROM definition d LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL) n ON n.doc_id = d.doc_id + 1 AND n.doc_id % 20 > 0""", corpus=True)
def def_spill_over(spark, sf_dir):
    items = C.documents(spark, sf_dir).where("text is not null").select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.concat(F.lit(" runs on into "), F.col("doc_id").cast("string")).alias("lead"), F.expr("doc_id % 2 = 1").alias("resumes"))
    return regions.spilled_over(C.definitions(spark, sf_dir), items).select(*ITEM, "marker", "text")


# Blocks of the mini-books


@query("""SELECT doc_id // 20 AS book_id, CAST(doc_id % 20 AS INTEGER) AS chapter_index, count(*) AS definitions, min('Note ' || md5(doc_id || '-' || k)) AS first_text FROM numbered WHERE defined GROUP BY doc_id""", corpus=True)
def def_of_blocks(spark, sf_dir):
    found = blocks.block_definitions(C.items(spark, sf_dir))
    return found.groupBy(*ITEM).agg(F.count("*").alias("definitions"), F.min("text").alias("first_text"))


@query("""SELECT b.doc_id // 20 AS book_id, CAST(b.doc_id % 20 AS INTEGER) AS chapter_index, count(*) FILTER (ord >= 1000000) AS excluded, count(*) FILTER (ord < 1000000) AS prose FROM book_line b
JOIN (SELECT doc_id FROM numbered WHERE defined GROUP BY doc_id) n USING (doc_id) WHERE regexp_matches(text, '\\S') GROUP BY b.doc_id""", corpus=True)
def spl_prose_view(spark, sf_dir):
    defined = C.numbered(spark, sf_dir).where("defined").select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index")).distinct()
    found = blocks.prose_lines(C.items(spark, sf_dir).join(defined, ITEM, "left_semi")).where(r"text rlike '\\S'")
    return found.groupBy(*ITEM).agg(F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("prose"))


@query("""SELECT DISTINCT doc_id // 20 AS book_id, CAST(doc_id % 20 AS INTEGER) AS chapter_index, 'CHAPTER ' || (doc_id % 50 + 1) AS label, CAST(doc_id % 50 + 1 AS INTEGER) AS token FROM documents WHERE text IS NOT NULL""")
def hdg_logical_label(spark, sf_dir):
    head = F.concat(F.lit("CHAPTER "), F.expr("doc_id % 50 + 1").cast("string"), F.lit("\n\nprose begins here, in small letters.\n"))
    items = C.documents(spark, sf_dir).where("text is not null").select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.concat(head, F.lower("text")).alias("text"))
    return blocks.logical_labels(items)


# Conventions of HTML books, on pages made of the mini-books' notes


def _note_pages(spark, sf_dir, before, after):
    """A page for each document with its definitions, each between two pieces of markup."""
    marks = C.numbered(spark, sf_dir).where("defined")
    block = F.concat(before, F.col("k").cast("string"), F.lit(". "), C.note_text(), after)
    packed = marks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("h")))), lambda x: x["h"]), "").alias("html"))
    pages = packed.select(F.expr("doc_id div 20").alias("book_id"), F.expr("int(doc_id % 20)").alias("chapter_index"), F.concat(F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("chapter_name"), "html")
    return html.elements(pages)


def _id(name: str):
    return F.concat(F.lit(f'<p id="{name}'), F.col("k").cast("string"), F.lit('">'))


_DEFINED = "SELECT book_id, chapter_index, CAST(def_ord AS VARCHAR) AS marker, text FROM definition"


@query(_DEFINED, corpus=True)
def def_filepos(spark, sf_dir):
    link = F.concat(F.lit('</p><a href="#filepos'), F.col("k").cast("string"), F.lit('">x</a>'))
    return note_elements.filepos_definitions(_note_pages(spark, sf_dir, _id("filepos"), link), ITEM).select(*ITEM, "marker", "text")


@query("SELECT book_id, chapter_index, CAST(def_ord AS VARCHAR) AS marker, text || ' Second block.' AS text FROM definition", corpus=True)
def def_structured(spark, sf_dir):
    return note_elements.structured_definitions(_note_pages(spark, sf_dir, _id("_rfn"), F.lit("</p><p>Second block.</p>")), ITEM).select(*ITEM, "marker", "text")


@query(_DEFINED, corpus=True)
def def_linked_pairs(spark, sf_dir):
    anchors, defs = note_elements.linked_pairs(_note_pages(spark, sf_dir, F.concat(F.lit('<a id="st'), F.col("k").cast("string"), F.lit('">*</a>'), _id("rst")), F.lit("</p>")), ITEM)
    return anchors.join(defs.drop("node_id"), [*ITEM, "pair"]).select(*ITEM, "marker", "text")


@query(_DEFINED, corpus=True)
def def_note_class(spark, sf_dir):
    return note_elements.class_definitions(_note_pages(spark, sf_dir, F.lit('<div class="footnote">'), F.lit("</div><p>between</p>")), ITEM).select(*ITEM, "marker", "text")


@query("""SELECT book_id, chapter_index, CAST(def_ord AS VARCHAR) AS marker, text || CASE WHEN def_ord % 2 = 0 THEN ' runs on' ELSE '' END AS text FROM definition WHERE doc_id IN (SELECT doc_id FROM definition GROUP BY doc_id HAVING count(*) >= 5)""", corpus=True)
def def_paragraphs(spark, sf_dir):
    after = F.when(F.expr("k % 2 = 0"), "</p><p>runs on</p>").otherwise("</p>")
    return note_elements.paragraph_definitions(_note_pages(spark, sf_dir, F.lit("<p>"), after), ITEM).select(*ITEM, "marker", "text")


@query(_DEFINED + " WHERE def_ord % 3 = 0", corpus=True)
def def_gap_fill(spark, sf_dir):
    missing = C.definitions(spark, sf_dir).where("def_ord % 3 = 0").select("book_id", F.concat(F.lit("g"), "marker").alias("frag")).distinct()
    return note_elements.gap_definitions(_note_pages(spark, sf_dir, _id("g"), F.lit("</p>")), missing, ITEM).select(*ITEM, "marker", "text")


@query("""WITH n AS (SELECT *, doc_id // 20 AS book_id FROM (SELECT doc_id, count(*) AS n FROM numbered WHERE defined GROUP BY doc_id)) SELECT book_id, CAST(sum(n) AS BIGINT) AS markers, count(*) AS files, sum(n) >= 10 AND count(*) >= 3 AS superscript FROM n WHERE n >= 2 GROUP BY book_id""".replace("WITH n AS", ", n AS", 1), corpus=True)
def agg_superscript_book(spark, sf_dir):
    sup = F.concat(F.lit("<sup>"), F.col("k").cast("string"), F.lit("</sup><p>"))
    return regions.superscript_books(_note_pages(spark, sf_dir, sup, F.lit("</p>")))


@query("SELECT book_id, chapter_index, 'Note ' || def_ord AS label FROM definition", corpus=True)
def hdg_toc_fragment(spark, sf_dir):
    rows = _note_pages(spark, sf_dir, _id("t"), F.lit("</p>"))
    toc = C.definitions(spark, sf_dir).select("book_id", F.concat(F.expr("book_id * 20 + chapter_index").cast("string"), F.lit(".xhtml")).alias("file_base"), F.concat(F.lit("Note "), "marker").alias("label"), F.concat(F.lit("t"), "marker").alias("fragment"))
    return regions.label_at_fragment(toc, rows).where("pos > 0 or label is not null").select(*ITEM, "label")


# Operators that no other query runs


@query("SELECT a.book_id, a.chapter_index, h.pos * 1000 AS pos, coalesce(lead(h.pos * 1000) OVER (PARTITION BY h.doc_id ORDER BY h.pos), 1000000) AS stop FROM heading h JOIN (SELECT DISTINCT doc_id, book_id, chapter_index FROM anchor) a USING (doc_id)", corpus=True)
def win_regions(spark, sf_dir):
    lengths = C.anchors(spark, sf_dir).select(*ITEM).distinct().withColumn("length", F.lit(1_000_000).cast("long"))
    return H.regions(_headings(spark, sf_dir).select(*ITEM, "pos"), lengths, ITEM)


@query("""SELECT a.book_id, a.chapter_index, CAST(a.anchor_ord AS VARCHAR) AS marker FROM anchor a JOIN (SELECT DISTINCT doc_id FROM anchor) d USING (doc_id) WHERE NOT (a.position >= 5000 AND a.position < 20000)""", corpus=True)
def flt_outside_regions(spark, sf_dir):
    a = C.anchors(spark, sf_dir)
    spans = a.select(*ITEM).distinct().select("*", F.lit(5000).cast("long").alias("start"), F.lit(20000).cast("long").alias("stop"))
    return H.outside(a, spans, ITEM).select(*ITEM, "marker")


@query("""SELECT d.book_id, d.chapter_index, CAST(d.def_ord AS VARCHAR) AS marker FROM definition d LEFT JOIN anchor a ON a.doc_id = d.doc_id AND a.anchor_ord = d.def_ord WHERE a.doc_id IS NULL""", corpus=True)
def syn_unpaired_orphans(spark, sf_dir):
    from marginalia.operators.pairing import pair

    defs = C.definitions(spark, sf_dir)
    return repair.unpaired_orphans(pair(C.anchors(spark, sf_dir), defs), defs).select(*ITEM, "marker")


_METHODS = "CASE anchor_ord % 4 WHEN 0 THEN 'id_link' WHEN 1 THEN 'orphan_definition' WHEN 2 THEN 'recovered_anchor' ELSE 'marker_unique' END"


def _mixed(spark, sf_dir):
    """Rows of several methods for each marker, by arithmetic."""
    rows = C.anchors(spark, sf_dir).withColumn("match_method", F.expr(_METHODS)).withColumn("confidence_score", F.expr("double(anchor_ord % 7) / 10")).withColumn("marker", F.expr("string((anchor_ord - 1) % 10)"))
    return rows


_MIXED = f", r AS (SELECT *, {_METHODS} AS method, CAST((anchor_ord - 1) % 10 AS VARCHAR) AS m, (anchor_ord % 7)::DOUBLE / 10 AS score FROM anchor)"


@query(_MIXED + """ SELECT book_id, chapter_index, CAST(anchor_ord AS INTEGER) AS anchor_ord FROM (SELECT *, max(method = 'id_link') OVER (PARTITION BY doc_id, m) AS linked FROM r) WHERE NOT linked OR method = 'id_link'""", corpus=True)
def set_prefer_links(spark, sf_dir):
    return repair.prefer_links(_mixed(spark, sf_dir), ITEM).select(*ITEM, "anchor_ord")


@query(_MIXED + """ SELECT book_id, chapter_index, CAST(anchor_ord AS INTEGER) AS anchor_ord FROM (SELECT *, max(method <> 'orphan_definition') OVER (PARTITION BY doc_id, m) AS covered FROM r) WHERE NOT covered OR method <> 'orphan_definition'""", corpus=True)
def set_covered_orphans(spark, sf_dir):
    return repair.without_covered_orphans(_mixed(spark, sf_dir), ITEM).select(*ITEM, "anchor_ord")


@query(_MIXED + """ SELECT book_id, chapter_index, CAST(anchor_ord AS INTEGER) AS anchor_ord FROM (SELECT *, max(score) FILTER (method <> 'recovered_anchor') OVER (PARTITION BY doc_id, m) AS other FROM r) WHERE method <> 'recovered_anchor' OR other IS NULL OR other < score""", corpus=True)
def set_weak_recovered(spark, sf_dir):
    return repair.without_weak_recovered(_mixed(spark, sf_dir), ITEM).select(*ITEM, "anchor_ord")


@query(_MIXED + """, n AS (SELECT doc_id, count(*) FILTER (method = 'id_link') AS old, count(*) FILTER (method = 'id_link' OR doc_id % 2 = 0) AS new FROM r GROUP BY doc_id)
SELECT r.book_id, r.chapter_index, CAST(r.anchor_ord AS INTEGER) AS anchor_ord, CASE WHEN n.new > n.old THEN 'id_link' ELSE method END AS match_method FROM r JOIN n USING (doc_id)""", corpus=True)
def set_replaced_items(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    rebuilt = rows.withColumn("match_method", F.expr("if(chapter_index % 2 = 0, 'id_link', match_method)"))
    return repair.replaced_items(rows, rebuilt).select(*ITEM, "anchor_ord", "match_method")


@query(_MIXED + """ SELECT book_id, chapter_index, CAST(anchor_ord AS INTEGER) AS anchor_ord FROM r WHERE book_id % 2 = 1 OR chapter_index % 5 = 0 OR method IN ('id_link', 'orphan_definition')""", corpus=True)
def flt_structured_only(spark, sf_dir):
    return repair.structured_only(_mixed(spark, sf_dir), F.expr("book_id % 2 = 0"), F.expr("chapter_index % 5 = 0")).select(*ITEM, "anchor_ord")


# Text functions that no other query runs


@query("""SELECT conv_id, turn, CASE WHEN length(s) >= 15 THEN lower(substring(s, 1, 40)) END AS body_key FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM conversations)""")
def txt_body_key(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.body_key(T.safe_text(F.col("text"))).alias("body_key"))


@query("""SELECT event_id, CASE WHEN length(CAST(event_id % 2000 AS VARCHAR)) <= 3 THEN CAST(event_id % 2000 AS INTEGER) END AS n FROM events""")
def txt_marker_number(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", T.marker_number(F.expr("string(event_id % 2000)")).alias("n"))


def _roman_sql(n: str) -> str:
    tens, ones = "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']", "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"
    return f"repeat('C', CAST({n} // 100 AS INTEGER)) || {tens}[CAST({n} // 10 % 10 + 1 AS INTEGER)] || {ones}[CAST({n} % 10 + 1 AS INTEGER)]"


@query(f"""SELECT event_id, {_roman_sql('(event_id % 399 + 1)')} AS roman, CAST(event_id % 399 + 1 AS INTEGER) AS n FROM events""")
def txt_roman(spark, sf_dir):
    digits = lambda names, e: F.element_at(F.array(*map(F.lit, names)), F.expr(f"int({e}) + 1"))
    n = "(event_id % 399 + 1)"
    tens, ones = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.expr(f"repeat('C', int({n} div 100))"), digits(tens, f"{n} div 10 % 10"), digits(ones, f"{n} % 10")).alias("roman"))
    return rows.select("event_id", "roman", T.roman_to_int(F.col("roman")).alias("n"))


@query("""SELECT user_id, CAST(max(event_id) AS BIGINT) AS n, 'Footnotes to chapter ' || CAST(user_id % 40 + 1 AS VARCHAR) AS header, CAST(user_id % 40 + 1 AS INTEGER) AS token FROM events GROUP BY user_id""")
def txt_chapter_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("n"))
    header = F.concat(F.lit("Footnotes to chapter "), F.expr("string(user_id % 40 + 1)"))
    return rows.select("user_id", "n", header.alias("header"), T.notes_header_token(header).alias("token"))
