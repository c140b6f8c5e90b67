"""Filters, rescues and labels by region: what a chapter's stretch of text says about the anchors and definitions in it.

Anchors, definitions and headings are rows of an item (book_id, chapter_index) with a place in its text; a region is the stretch of a
heading. Every step is a join or a window by item, group or book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import body_key, chapter_token, marker_category, marker_number
from marginalia.operators.repair import first_of

ITEM = ["book_id", "chapter_index"]
#: How a heading shows a roman chapter number (fixed values).
ROMAN = r"^\s*[IVXLC]{1,12}\s*\.?\s*\b|(?i)^\s*CHAPTER\s+[IVXLC]{1,12}\b"
#: A gap after the notes counts from so many characters; an appendix tail has so many definitions, so many of each kind, and reaches such a number.
GAP, TAIL, KIND, REACHES = 40, 80, 20, 100
#: Items that tell a book's profile; share of a book's chapters or anchors from which a structure counts.
SAMPLE_ITEMS, COVERAGE = 6, 0.80


def structural_headings(headings: DataFrame) -> DataFrame:
    """Headings of an item up to its last roman chapter number; without one, those with a number; without any number, all."""
    numbered = chapter_token(F.col("label")).isNotNull()
    item = W.partitionBy(*ITEM)
    last = F.max(F.when(numbered & F.col("label").rlike(ROMAN), F.col("pos"))).over(item)
    flagged = headings.withColumn("_n", numbered).withColumn("_last", last).withColumn("_any", F.max(numbered).over(item))
    return flagged.where(F.when(F.col("_last").isNotNull(), F.col("pos") <= F.col("_last")).otherwise(F.col("_n") | ~F.col("_any"))).drop("_n", "_last", "_any")


def lines_of(points: DataFrame, lines: DataFrame, keys: list[str] = ITEM, position: str = "position") -> DataFrame:
    """points with line_index, that of the line (keys, line_index, line_start) they stand in: the last one that starts at or before them."""
    from marginalia.operators.headings import last_heading

    starts = lines.select(*keys, F.col("line_start").alias("pos"), F.col("line_index").cast("string").alias("label"))
    return last_heading(points, starts, keys, position).withColumn("line_index", F.col("label").cast("int")).drop("label")


def off_headings(anchors: DataFrame, heading_lines: DataFrame) -> DataFrame:
    """Anchors without those bracketed numbers that stand on a heading's line; lines of PART and NIGHT keep theirs."""
    lines = heading_lines.where(~F.coalesce(F.upper(F.trim("label")).rlike(r"^\[?\s*(?:PART|NIGHT)\b"), F.lit(False))).select(*ITEM, "line_index").distinct()
    numbered = marker_category(F.col("marker_raw")).isin("num_paren", "num_bracket")
    return anchors.where(~numbered).unionByName(anchors.where(numbered).join(lines, [*ITEM, "line_index"], "left_anti"))


def outside_gaps(anchors: DataFrame, ends: DataFrame, headings: DataFrame, gap: int = GAP) -> DataFrame:
    """Anchors without those that aren't links and lie between the end of an item's definitions (ITEM, stop) and the next heading, where that is `gap` characters or more."""
    following = ends.join(headings.select(*ITEM, "pos"), ITEM).where("pos > stop").groupBy(*ITEM, "stop").agg(F.min("pos").alias("pos")).where(F.col("pos") - F.col("stop") >= gap)
    spans = following.select(*(F.col(k).alias(f"_{k}") for k in ITEM), "stop", "pos")
    inside = (F.col("book_id") == F.col("_book_id")) & (F.col("chapter_index") == F.col("_chapter_index")) & (F.col("position") >= F.col("stop")) & (F.col("position") < F.col("pos"))
    return anchors.where("href is not null").unionByName(anchors.where("href is null").join(spans, inside, "left_anti"))


def in_defined_groups(anchors: DataFrame, definitions: DataFrame, headings: DataFrame) -> DataFrame:
    """Anchors without those that aren't links and whose chapter group has no definition, in items of two headings or more."""
    several = headings.groupBy(*ITEM).agg(F.count("*").alias("_h")).where("_h >= 2").select(*ITEM, F.lit(True).alias("_several"))
    groups = definitions.where("chapter_group is not null").select(*ITEM, "chapter_group").distinct().withColumn("_defined", F.lit(True))
    both = anchors.join(several, ITEM, "left").join(groups, [*ITEM, "chapter_group"], "left")
    return both.where(F.col("href").isNotNull() | F.col("_several").isNull() | F.col("_defined").isNotNull()).select(*anchors.columns)


def without_definition_heads(anchors: DataFrame, definitions: DataFrame) -> DataFrame:
    """Anchors whose text after the marker (`after`) begins as a known definition of it does: the anchor is that definition's own number."""
    known = definitions.select(F.col("book_id").alias("_b"), F.col("marker").alias("_m"), body_key(F.col("text")).alias("_key")).where("_key is not null").distinct()
    same = (F.col("book_id") == F.col("_b")) & (F.col("marker") == F.col("_m")) & F.lower(F.trim(F.coalesce("after", F.lit("")))).startswith(F.col("_key"))
    return anchors.join(known, same, "left_anti")


def without_appendix_tails(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows without those of items that read like an index: many definitions, numbers and others mixed, to high numbers, under a label they only inherited (`inherited`)."""
    numeric = marker_number(F.col("marker"))
    counted = definitions.groupBy(*ITEM).agg(F.count("*").alias("n"), F.count(numeric).alias("numbers"), F.max(numeric).alias("highest"), F.max(F.coalesce("inherited", F.lit(False))).alias("inherited"))
    noisy = counted.where((F.col("n") >= TAIL) & (F.col("numbers") >= KIND) & (F.col("n") - F.col("numbers") >= KIND) & (F.col("highest") >= REACHES) & F.col("inherited"))
    return rows.join(noisy.select(*ITEM), ITEM, "left_anti")


def missing_in_regions(anchors: DataFrame, definitions: DataFrame, highest: int = 9) -> DataFrame:
    """Definitions 1 to `highest` of a chapter group that has two anchors or more, with an anchor on both sides of the gap, as orphan rows."""
    keys = [*ITEM, "chapter_group"]
    present = anchors.select(*keys, marker_number(F.col("marker")).alias("n")).where("n is not null").distinct()
    span = present.groupBy(*keys).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("present")).where("present >= 2")
    gaps = definitions.withColumn("n", marker_number(F.col("marker"))).where(F.col("n").between(1, highest)).join(present, [*keys, "n"], "left_anti").join(span, keys)
    found = gaps.where("n > least and n < most")
    return found.select(*keys, "marker", F.col("text").alias("suggested_definition"), F.lit("orphan_definition").alias("match_method"), F.lit(0.40).alias("confidence_score"), F.lit("Low (Orphan Definition)").alias("confidence"))


def rescued_in_regions(needed: DataFrame, regions: DataFrame) -> DataFrame:
    """For needed markers (ITEM, chapter_group, marker) the first place in their regions (ITEM, chapter_group, pos, text): the number in parentheses after a name, else in parentheses at all."""
    both = needed.join(regions, [*ITEM, "chapter_group"])
    named = F.regexp_instr("text", F.concat(F.lit(r"\b[A-Z][A-Za-z'’\-]{1,28}\s*\(\s*"), F.col("marker"), F.lit(r"\s*\)")))
    plain = F.regexp_instr("text", F.concat(F.lit(r"\(\s*"), F.col("marker"), F.lit(r"\s*\)")))
    hit = both.withColumn("_named", named).withColumn("_plain", plain).where("_plain > 0")
    # a name is a match's beginning; its number begins at the parenthesis
    start = F.when(F.col("_named") > 0, F.col("_named") + F.instr(F.expr("substring(text, _named)"), "(") - 1).otherwise(F.col("_plain"))
    found = hit.withColumn("_at", start).withColumn("position", F.col("pos") + F.col("_at") - 1)
    best = first_of(found.withColumn("_rank", F.when(F.col("_named") > 0, 0).otherwise(1)), [*ITEM, "chapter_group", "marker"], ["_rank", "position"])
    return best.select(*ITEM, "chapter_group", "marker", F.concat(F.lit("("), "marker", F.lit(")")).alias("marker_raw"), "position", F.expr("substring(text, greatest(_at - 80, 1), 163)").alias("context"))


def rescued_items(rows: DataFrame, anchors: DataFrame, definitions: DataFrame) -> DataFrame:
    """rows, and for items that have anchors and definitions but no row, what pairing those alone finds."""
    from marginalia.operators.pairing import pair

    bare = anchors.select(*ITEM).distinct().join(definitions.select(*ITEM).distinct(), ITEM, "left_semi").join(rows.select(*ITEM).distinct(), ITEM, "left_anti")
    found = pair(anchors.join(bare, ITEM, "left_semi"), definitions.join(bare, ITEM, "left_semi"))
    return rows.unionByName(found, allowMissingColumns=True)


def dominant_labels(rows: DataFrame, keys: list[str], label: str = "chapter_label") -> DataFrame:
    """(keys, label, n): the label most rows of a key have, ties to the one seen first; nulls don't count."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min("order_key").alias("_seen"))
    return first_of(counted, keys, [F.desc("n"), "_seen", label]).drop("_seen")


def promoted_labels(rows: DataFrame) -> DataFrame:
    """Rows with an inherited label take their item's own dominant label, where it has one."""
    own = dominant_labels(rows.where(~F.col("inherited")), ITEM).select(*ITEM, F.col("chapter_label").alias("_own"))
    both = rows.join(own, ITEM, "left")
    return both.withColumn("chapter_label", F.when(F.col("inherited"), F.coalesce("_own", "chapter_label")).otherwise(F.col("chapter_label"))).drop("_own")


def section_labels(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of items with several notes blocks (ITEM, start, stop) get "NOTES Section n" after their label, by the block their definition (def_position) lies in."""
    order = W.partitionBy(*ITEM).orderBy("start")
    numbered = blocks.withColumn("_n", F.row_number().over(order)).withColumn("_of", F.count("*").over(W.partitionBy(*ITEM))).where("_of > 1")
    spans = numbered.select(*(F.col(k).alias(f"_{k}") for k in ITEM), "start", "stop", "_n")
    on = (F.col("book_id") == F.col("_book_id")) & (F.col("chapter_index") == F.col("_chapter_index")) & (F.col("def_position") >= F.col("start")) & (F.col("def_position") < F.col("stop"))
    both = rows.join(spans, on, "left")
    label = F.when(F.col("_n").isNotNull(), F.concat_ws(" - ", "chapter_label", F.concat(F.lit("NOTES Section "), F.col("_n").cast("string")))).otherwise(F.col("chapter_label"))
    return both.withColumn("chapter_label", label).select(*rows.columns)


def shared_markers(rows: DataFrame, kind: str = "series") -> DataFrame:
    """For each group whether two kinds of notes (an author's and an editor's, say) use the same markers."""
    sets = rows.groupBy("book_id", "chapter_group", kind).agg(F.array_sort(F.collect_set("marker")).alias("markers"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, F.expr(f"a.book_id = b.book_id and a.chapter_group <=> b.chapter_group and a.{kind} < b.{kind}"))
    return pairs.select("a.book_id", "a.chapter_group", F.arrays_overlap("a.markers", "b.markers").alias("overlap")).groupBy("book_id", "chapter_group").agg(F.max("overlap").alias("overlap"))


def series_suffix(rows: DataFrame, overlap: DataFrame) -> DataFrame:
    """Where two kinds of notes share markers, symbols are the author's notes and numbers the editor's, as their label then says."""
    both = rows.join(overlap.withColumnRenamed("overlap", "_o"), ["book_id", "chapter_group"], "left")
    kind = F.when(F.col("marker").rlike("^[*†‡§]+$"), " (Author's Note)").otherwise(" (Editorial Note)")
    return both.withColumn("chapter_label", F.when(F.coalesce("_o", F.lit(False)), F.concat("chapter_label", kind)).otherwise(F.col("chapter_label"))).select(*rows.columns)


def unique_markers(rows: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    """(keys, marker) of the markers that stand once in their key."""
    return rows.groupBy(*keys, "marker").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def superscript_books(elements: DataFrame, least: int = 10, files: int = 3, per_file: int = 2) -> DataFrame:
    """(book_id, markers, files, superscript): whether a book marks its notes by bare superscripts, ten in three files of two or more."""
    raised = elements.where((F.col("tag") == "sup") & F.trim("text").rlike(r"^(?:[0-9]{1,3}|[*†‡§]+)$"))
    each = raised.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n")).where(F.col("n") >= per_file)
    return each.groupBy("book_id").agg(F.sum("n").alias("markers"), F.count("*").alias("files")).withColumn("superscript", (F.col("markers") >= least) & (F.col("files") >= files))


def covered(rows: DataFrame, flag: Column, keys: list[str], share: float = COVERAGE) -> DataFrame:
    """(keys, coverage, covered): the share of rows for which a flag holds, and whether it is enough."""
    found = rows.groupBy(*keys).agg(F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias("coverage"))
    return found.withColumn("covered", F.col("coverage") >= share)


def first_numbers(anchors: DataFrame, headings: DataFrame) -> DataFrame:
    """(ITEM, least): the least number among the anchors after an item's first heading; up to 3 it says that numbers restart there."""
    first = headings.groupBy(*ITEM).agg(F.min("pos").alias("_first"))
    after = anchors.join(first, ITEM).where(F.col("position") >= F.col("_first"))
    return after.groupBy(*ITEM).agg(F.min(marker_number(F.col("marker"))).alias("least"))


def in_scan_order(definitions: DataFrame, starts: DataFrame) -> DataFrame:
    """Definitions with their rank: those at or after the item's notes start (ITEM, start) first, then by line."""
    both = definitions.join(starts, ITEM, "left")
    later = F.when(F.col("line_index") >= F.col("start"), 0).otherwise(1)
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*ITEM).orderBy(later, "line_index", "marker"))).drop("start")


def profile_sample(items: DataFrame, most: int = SAMPLE_ITEMS) -> DataFrame:
    """The items that tell a book's marker profile: its first ones."""
    return items.where(F.col("chapter_index") < most)


def distinct_definitions(definitions: DataFrame, keys: list[str], by_line: bool = False) -> DataFrame:
    """The first of the definitions of one marker and text in a key; by_line: those of different lines stay."""
    return first_of(definitions, [*keys, "marker", "text", *(["line_index"] if by_line else [])], ["chapter_index", "def_ord"])


def unknown_fragments(anchors: DataFrame, ids: DataFrame) -> DataFrame:
    """(book_id, frag) that links lead to and no definition has."""
    known = ids.select("book_id", F.col("def_id").alias("frag"))
    return anchors.where("frag is not null").select("book_id", "frag").distinct().join(known, ["book_id", "frag"], "left_anti")


def filled_by_fragment(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without a definition get the one of their link's fragment, as id links."""
    texts = ids.groupBy("book_id", F.col("def_id").alias("frag")).agg(F.min("text").alias("_text"))
    both = rows.join(texts, ["book_id", "frag"], "left")
    fills = F.col("suggested_definition").isNull() & F.col("_text").isNotNull()
    filled = {"suggested_definition": F.col("_text"), "match_method": F.lit("id_link"), "confidence": F.lit("High (ID Link)"), "confidence_score": F.lit(0.98)}
    both = both.withColumn("_fills", fills)
    return both.withColumns({c: F.when(F.col("_fills"), v).otherwise(F.col(c)) for c, v in filled.items()}).select(*rows.columns)


def label_at_fragment(toc: DataFrame, elements: DataFrame) -> DataFrame:
    """TOC entries (book_id, file_base, label, fragment) as headings (book_id, chapter_index, pos, label): where their fragment's element stands, 0 without one."""
    places = elements.where("id is not null").groupBy("book_id", "chapter_index", F.lower(F.substring_index("chapter_name", "/", -1)).alias("file_base"), F.col("id").alias("fragment")).agg(F.min("start").alias("start"))
    files = elements.groupBy("book_id", F.lower(F.substring_index("chapter_name", "/", -1)).alias("file_base")).agg(F.min("chapter_index").alias("_item"))
    both = toc.join(files, ["book_id", "file_base"]).join(places, ["book_id", "file_base", "fragment"], "left")
    return both.select("book_id", F.coalesce("chapter_index", "_item").alias("chapter_index"), F.coalesce("start", F.lit(0)).cast("long").alias("pos"), "label")


def spilled_over(definitions: DataFrame, leads: DataFrame) -> DataFrame:
    """Definitions (ITEM, def_ord, marker, text, char_position) with what runs on into the next item.

    leads: (ITEM, lead, resumes) of each item: the text before its first definition or heading, and whether it begins amid notes. That
    text goes to the last definition of the item before; what an item defines before prose resumes is the earlier item's too.
    """
    own = W.partitionBy(*ITEM).orderBy(F.desc("def_ord"))
    after = leads.where("resumes").select("book_id", (F.col("chapter_index") - 1).alias("chapter_index"), "lead")
    both = definitions.withColumn("_last", F.row_number().over(own) == 1).join(after, ITEM, "left")
    longer = F.when(F.col("_last") & (F.trim(F.coalesce("lead", F.lit(""))) != ""), F.concat_ws(" ", "text", F.trim("lead"))).otherwise(F.col("text"))
    return both.withColumn("text", longer).drop("_last", "lead")
