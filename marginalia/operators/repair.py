"""Repair of note rows: outliers, orphans, duplicates, swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import keywords, marker_family

GROUP = ["book_id", "source", "chapter_index"]


def with_dominant(rows: DataFrame, keys: list[str], least: int, share: float, name: str) -> DataFrame:
    """rows with the family that makes up a share of the rows of their key, ties to the one seen first, null where none does; and how many the key and the row's own family have."""
    whole, same = W.partitionBy(*keys), W.partitionBy(*keys, "family")
    rows = rows.withColumn(f"{name}_total", F.count("*").over(whole)).withColumn(f"{name}_count", F.count("*").over(same)).withColumn("_seen", -F.min("order_key").over(same))
    top = F.max(F.struct(F.col(f"{name}_count").alias("c"), "_seen", "family")).over(whole)
    clear = (F.col(f"{name}_total") >= least) & (F.col("_top.c") >= share * F.col(f"{name}_total"))
    return rows.withColumn("_top", top).withColumn(f"{name}_family", F.when(clear, F.col("_top.family"))).drop("_top", "_seen")


def outlier_penalty(rows: DataFrame) -> DataFrame:
    """Rows of a marker family that is rare where another dominates get a score of 0.55 at most, and a flag.

    A clear family of the row's own chapter counts first, else one of the whole book; linked rows are never marked down. All windows
    are of a book or finer, so the rows move once.
    """
    named = rows.withColumn("family", marker_family(F.col("marker_raw"), F.col("marker")))
    named = with_dominant(with_dominant(named, ["book_id", "source"], 10, 0.75, "all"), GROUP, 5, 0.70, "own")
    own = F.col("own_family").isNotNull()
    family = F.coalesce("own_family", "all_family")
    count, total = F.when(own, F.col("own_count")).otherwise(F.col("all_count")), F.when(own, F.col("own_total")).otherwise(F.col("all_total"))
    rare = ~((count > 2) & (count / total > 0.20))
    outlier = F.coalesce(family.isNotNull() & (F.col("family") != family) & rare & (F.col("match_method") != "id_link"), F.lit(False))
    lower = outlier & (F.col("confidence_score") > 0.55)
    manual = F.lower("confidence").startswith("manual") | (F.col("confidence") == "")
    out = named.withColumn("confidence_score_base", F.when(outlier, F.col("confidence_score")))
    out = out.withColumn("confidence_flags", F.when(lower, F.array(F.lit("marker_family_outlier"))))
    out = out.withColumn("confidence", F.when(lower, F.when(manual, "Manual Review Required").otherwise("Low (Marker Outlier)")).otherwise(F.col("confidence")))
    out = out.withColumn("confidence_score", F.when(lower, 0.55).otherwise(F.col("confidence_score")))
    return out.drop("family", "own_family", "own_total", "all_family", "all_total", "own_count", "all_count")


def orphans(anchors: DataFrame, definitions: DataFrame) -> DataFrame:
    """Numeric definitions without an anchor whose neighbours (n - 1 and n + 1) both have one, as rows of their own."""
    keys = ["book_id", "chapter_index"]
    present = anchors.select(*keys, F.col("marker").try_cast("int").alias("n")).where("n is not null").distinct()
    missing = definitions.withColumn("n", F.col("marker").try_cast("int")).where("n is not null").join(present, [*keys, "n"], "left_anti")
    for step in (-1, 1):
        missing = missing.join(present.withColumn("n", F.col("n") - step), [*keys, "n"], "left_semi")
    return missing.select(*keys, "marker", F.col("text").alias("suggested_definition"), F.lit("orphan_definition").alias("match_method"), F.lit(0.40).alias("confidence_score"), F.lit("Low (Orphan Definition)").alias("confidence"))


def unpaired_orphans(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """A row for every definition whose text no row of its item has."""
    used = rows.where("suggested_definition is not null").select("book_id", "chapter_index", F.col("suggested_definition").alias("text")).distinct()
    left = definitions.join(used, ["book_id", "chapter_index", "text"], "left_anti")
    return left.select("book_id", "chapter_index", "marker", F.col("text").alias("suggested_definition"), F.lit("orphan_definition").alias("match_method"), F.lit(0.55).alias("confidence_score"), F.lit("Manual Review Required").alias("confidence"))


def recovered(orphan_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Orphans whose marker stands once, in parentheses, in their item's prose become anchors there, scored 0.65 or more."""
    both = orphan_rows.join(texts, ["book_id", "chapter_index"])
    needle = F.concat(F.lit("("), F.col("marker"), F.lit(")"))
    hits = (F.length("text") - F.length(F.replace("text", needle, F.lit("")))) / F.length(needle)
    at = F.instr("text", needle)
    found = both.where(hits == 1).withColumn("position", (at - 1).cast("long")).withColumn("context", F.expr("substring(text, greatest(position - 79, 1), 163)"))
    return found.drop("text").withColumn("match_method", F.lit("recovered_anchor")).withColumn("confidence", F.lit("Medium (Recovered Anchor)")).withColumn("confidence_score", F.greatest("confidence_score", F.lit(0.65)))


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, by an order that leaves no ties open."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_anchors(anchors: DataFrame) -> DataFrame:
    return first_of(anchors, ["book_id", "chapter_index", "marker", "context", "href", "position"], ["anchor_ord"])


def without_link_copies(anchors: DataFrame) -> DataFrame:
    """Anchors without a link go where one with a link says the same: context contained, within 25 characters, or alike in words."""
    linked = anchors.where("href is not null").select(*(F.col(c).alias(f"l_{c}") for c in ("book_id", "chapter_index", "marker", "context", "position")))
    plain = anchors.where("href is null")
    a, b = F.trim(F.coalesce("context", F.lit(""))), F.trim(F.coalesce("l_context", F.lit("")))
    words, theirs = keywords(a), keywords(b)
    both = F.size(F.array_intersect(words, theirs))
    alike = (F.length(a) >= 40) & (F.length(b) >= 40) & (both >= 4) & (both / F.greatest(F.size(F.array_union(words, theirs)), F.lit(1)) >= 0.55)
    near = (F.col("position") >= 0) & (F.col("l_position") >= 0) & (F.abs(F.col("position") - F.col("l_position")) <= 25)
    same = (F.col("book_id") == F.col("l_book_id")) & (F.col("chapter_index") == F.col("l_chapter_index")) & (F.col("marker") == F.col("l_marker"))
    copy = same & (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b) | F.coalesce(near, F.lit(False)) | alike)
    return anchors.where("href is not null").unionByName(plain.where("marker <> '' and trim(context) <> ''").join(linked, copy, "left_anti"))


def prefer_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric rows of a key go where one of them is an id_link, but for the links."""
    linked = F.max(F.col("match_method") == "id_link").over(W.partitionBy(*keys, "marker"))
    numeric = F.col("marker").rlike("^[0-9]{1,3}$")
    return rows.withColumn("_l", linked).where(~(numeric & F.col("_l")) | (F.col("match_method") == "id_link")).drop("_l")


def without_covered_orphans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Orphans go where their group has a row of the same marker that isn't one."""
    covered = F.max(F.col("match_method") != "orphan_definition").over(W.partitionBy(*keys, "marker"))
    return rows.withColumn("_c", covered).where((F.col("match_method") != "orphan_definition") | ~F.col("_c")).drop("_c")


def without_weak_recovered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered anchors go where a stronger row of their marker exists."""
    stronger = F.max(F.when(F.col("match_method") != "recovered_anchor", F.col("confidence_score"))).over(W.partitionBy(*keys, "marker"))
    return rows.withColumn("_s", stronger).where((F.col("match_method") != "recovered_anchor") | F.col("_s").isNull() | (F.col("_s") < F.col("confidence_score"))).drop("_s")


def swap_parent_child(rows: DataFrame, least: int = 5) -> DataFrame:
    """Definitions of a part and of its child chapter are exchanged where at least `least` markers of the two point the other way.

    rows: book_id, chapter_group, parent_group, marker, suggested_definition, alt_definition (what the other would take).
    """
    parent = rows.select("book_id", F.col("chapter_group").alias("parent_group"), "marker", F.col("suggested_definition").alias("p_text"), F.col("alt_definition").alias("p_alt"), F.col("confidence_score").alias("p_score"))
    both = rows.join(parent, ["book_id", "parent_group", "marker"])
    crossed = both.withColumn("swap", (F.col("suggested_definition") == F.col("p_alt")) & (F.col("p_text") == F.col("alt_definition")))
    crossed = crossed.withColumn("n", F.count_if(F.col("swap")).over(W.partitionBy("book_id", "chapter_group", "parent_group"))).where("swap").where(F.col("n") >= least)
    score = F.greatest("p_score", F.lit(0.78))
    child = crossed.select("book_id", "chapter_group", "marker", F.col("p_text").alias("new_text"), F.lit("structural_child_swap").alias("new_method"), score.alias("new_score"))
    up = crossed.select("book_id", F.col("parent_group").alias("chapter_group"), "marker", F.col("suggested_definition").alias("new_text"), F.lit("structural_parent_swap").alias("new_method"), F.greatest("confidence_score", F.lit(0.78)).alias("new_score"))
    moved = rows.join(child.unionByName(up), ["book_id", "chapter_group", "marker"], "left")
    for column, new in (("suggested_definition", "new_text"), ("match_method", "new_method"), ("confidence_score", "new_score")):
        moved = moved.withColumn(column, F.coalesce(new, column))
    return moved.withColumn("confidence", F.when(F.col("new_method").isNotNull(), "Medium (Structural Notes Swap)").otherwise(F.col("confidence"))).drop("new_text", "new_method", "new_score")


def replaced_items(rows: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Items whose rebuilt rows have more id links than theirs are replaced whole."""
    keys = ["book_id", "chapter_index"]
    links = lambda df, name: df.groupBy(*keys).agg(F.count_if(F.col("match_method") == "id_link").alias(name))
    better = links(rebuilt, "new").join(links(rows, "old"), keys, "left").where("new > coalesce(old, 0)").select(*keys)
    return rows.join(better, keys, "left_anti").unionByName(rebuilt.join(better, keys, "left_semi"), allowMissingColumns=True)


def structured_only(rows: DataFrame, structured: Column, fell_back: Column) -> DataFrame:
    """In a book whose notes are linked both ways only links and orphans count, but for chapters that fell back."""
    return rows.where(~structured | fell_back | F.col("match_method").isin("id_link", "orphan_definition"))
