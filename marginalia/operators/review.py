"""Review of note rows: deduplication, chapters, order, summaries, edits, search, timed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import chapter_key, chapter_title, marker_number, natural_key, order_value, review_token
from marginalia.operators.repair import first_of

NOTE_COLUMNS = {
    "source": "string", "chapter_group": "string", "chapter_label": "string", "chapter_index": "int", "chapter_name": "string", "page_index": "int", "file_name": "string",
    "order_key": "long", "position": "long", "id": "long", "marker": "string", "context": "string", "suggested_definition": "string", "user_status": "string", "user_definition": "string",
}


def shaped(rows: DataFrame) -> DataFrame:
    """Rows with every column the review reads; missing ones null."""
    for name, kind in NOTE_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def reviewed(rows: DataFrame) -> DataFrame:
    """Rows deduplicated by marker, context and position (a paired one first), with chapter, title, order and token."""
    rows = shaped(rows)
    order = order_value(F.col("order_key"), F.col("position"), F.col("id"))
    rows = rows.withColumn("order_value", order)
    keyed = rows.withColumn("_c", F.coalesce("context", F.lit(""))).withColumn("_p", F.coalesce("position", F.lit(0)))
    keys = [*(["book_id"] if "book_id" in rows.columns else []), "marker", "_c", "_p"]
    rows = first_of(keyed, keys, [F.col("suggested_definition").isNull(), "order_value", "id"]).drop("_c", "_p")
    key = chapter_key(*(F.col(c) for c in ("source", "chapter_group", "chapter_label", "chapter_index", "page_index", "file_name")))
    title = chapter_title(*(F.col(c) for c in ("source", "chapter_label", "chapter_index", "chapter_name", "page_index", "file_name")))
    return rows.withColumn("chapter_key", key).withColumn("chapter_title", title).withColumn("token", review_token(F.col("chapter_label")))


def chapter_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, paired rows and rows to review of each chapter."""
    paired = F.col("suggested_definition").isNotNull() & (F.col("suggested_definition") != "")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(paired).alias("paired"), F.count_if(~paired).alias("needs_review"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Profile used, and questions to the language model: asked, matched, unavailable."""
    ask = lambda c, v: F.count_if(F.col(c) == v)
    return rows.agg(F.max("marker_profile").alias("profile"), ask("match_method", "ai").alias("ai_needed"), ask("ai_status", "matched").alias("ai_matched"), ask("ai_status", "unavailable").alias("ai_unavailable"))


def best_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each chapter's label: that of its most common chapter number, ties to the earliest, the longest label of it; else the first label."""
    labelled = rows.where("chapter_label is not null and chapter_label <> ''")
    tokens = labelled.where("token is not null").groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min(F.struct("order_value", "id")).alias("seen"), F.min_by("chapter_label", F.struct(-F.length("chapter_label"), F.col("order_value"), F.col("id"))).alias("label"))
    best = tokens.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("seen"))).alias("token_label"))
    first = labelled.groupBy(*keys).agg(F.min_by("chapter_label", F.struct("order_value", "id")).alias("first_label"))
    base = rows.groupBy(*keys).agg(F.min_by("chapter_title", F.struct("order_value", "id")).alias("title"))
    return base.join(first, keys, "left").join(best, keys, "left").select(*keys, F.coalesce("token_label", "first_label", "title").alias("label"))


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """row_number of each row inside its chapter: order value, marker as number, then marker as text with numbers by value."""
    number = marker_number(F.col("marker"))
    order = W.partitionBy(*keys).orderBy("order_value", number.asc_nulls_last(), natural_key(F.col("marker")), "id")
    return rows.withColumn("row_number", F.row_number().over(order))


def chapter_order(rows: DataFrame) -> DataFrame:
    """Chapters of each book in display order: item or page, chapter number (known first), least order value, natural name."""
    index = F.when(F.col("source") == "epub", F.col("chapter_index")).when(F.col("source") == "pdf", F.col("page_index"))
    each = rows.groupBy("book_id", "chapter_key").agg(F.min(index).alias("base"), F.min("token").alias("token"), F.min("order_value").alias("least"))
    order = W.partitionBy("book_id").orderBy(F.col("base").asc_nulls_last(), F.col("token").asc_nulls_last(), "least", natural_key(F.col("chapter_key")))
    return each.withColumn("chapter_number", F.row_number().over(order))


def definitions_by_marker(rows: DataFrame) -> DataFrame:
    """The distinct definitions of each marker, in order of first use."""
    used = rows.where("suggested_definition is not null and suggested_definition <> ''").groupBy("book_id", "marker", "suggested_definition").agg(F.min(F.struct("order_value", "id")).alias("seen"))
    return used.groupBy("book_id", "marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "suggested_definition"))), lambda x: x["suggested_definition"]).alias("definitions"))


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with the reader's last decisions: edits (id, seq, action, value) with action confirm, ignore or rematch.

    A status repeated on a row that has it takes it back; a rematch without a value takes the reader's definition back.
    """
    status = edits.where("action in ('confirm', 'ignore')").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("a"))
    toggled = F.aggregate("a", F.lit(None).cast("string"), lambda s, x: F.when(s.eqNullSafe(F.concat(x["action"], F.when(x["action"] == "confirm", "ed").otherwise("d"))), F.lit(None).cast("string")).otherwise(F.when(x["action"] == "confirm", "confirmed").otherwise("ignored")))
    text = edits.where("action = 'rematch'").groupBy("id").agg(F.max_by(F.struct(F.nullif("value", F.lit("")).alias("v")), "seq").alias("t"))
    rows = shaped(rows).join(status.select("id", toggled.alias("_s"), F.lit(True).alias("_has")), "id", "left").join(text, "id", "left")
    rows = rows.withColumn("user_status", F.when(F.col("_has"), F.col("_s")).otherwise(F.col("user_status"))).withColumn("user_definition", F.when(F.col("t").isNotNull(), F.col("t.v")).otherwise(F.col("user_definition")))
    return rows.drop("_s", "_has", "t")


def confirm_all(rows: DataFrame) -> DataFrame:
    return shaped(rows).withColumn("user_status", F.coalesce("user_status", F.lit("confirmed")))


def toggle_chapter(rows: DataFrame, key: str, status: str) -> DataFrame:
    """A whole chapter's status: set, or taken back where all its rows have it."""
    all_have = F.min(F.coalesce(F.col("user_status") == status, F.lit(False))).over(W.partitionBy("chapter_key"))
    own = F.when(all_have, F.lit(None).cast("string")).otherwise(status)
    return rows.withColumn("_own", own).withColumn("user_status", F.when(F.col("chapter_key") == key, F.col("_own")).otherwise(F.col("user_status"))).drop("_own")


def occurrences(df: DataFrame, needle: str, match_case: bool = False, text: str = "text") -> DataFrame:
    """A row for each hit of a literal in each text: its number and its offset in characters.

    The text is split at the literal and the lengths of what stands between are summed, so offsets count characters.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(body if match_case else F.lower(body), r"\Q" + (needle if match_case else needle.lower()) + r"\E")
    lengths = F.transform(parts, F.length)
    each = df.withColumn("_l", lengths).where(F.size("_l") > 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_l") - 1)))
    before = F.aggregate(F.slice("_l", F.lit(1), F.col("_k")), F.lit(0), lambda s, x: s + x) + (F.col("_k") - 1) * len(needle)
    return each.select(*[c for c in df.columns if c != text], F.col("_k").alias("hit"), before.cast("long").alias("offset"))


def next_hit(hits: DataFrame, keys: list[str], cursor: int) -> DataFrame:
    """The first hit at or after a cursor in each text, else (wrapped round) its first hit."""
    return hits.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("offset") >= cursor, F.col("offset"))), F.min("offset")).alias("offset"), F.count("*").alias("hits"))


def words_in_paragraphs(words: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each timed word with the paragraph whose interval holds its start: the last paragraph that began by then, in one window."""
    p = paragraphs.select("book_id", F.col("start_ms").alias("at"), F.lit(0).alias("side"), F.col("seq").alias("p_seq"), F.col("end_ms").alias("p_end"), F.lit(None).cast("long").alias("w_seq"), F.lit(None).cast("string").alias("word"))
    w = words.select("book_id", F.col("start_ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("p_seq"), F.lit(None).cast("long").alias("p_end"), F.col("seq").alias("w_seq"), "word")
    last = W.partitionBy("book_id").orderBy("at", "side", "p_seq", "w_seq").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(w).withColumn("paragraph_seq", F.last("p_seq", ignorenulls=True).over(last)).withColumn("_end", F.last("p_end", ignorenulls=True).over(last))
    return both.where("side = 1").select("book_id", F.col("w_seq").alias("seq"), "word", F.col("at").alias("start_ms"), F.when(F.col("at") < F.col("_end"), F.col("paragraph_seq")).alias("paragraph_seq"))


def span_at(spans: DataFrame, ms: int) -> DataFrame:
    """The span that is spoken at a time."""
    return spans.where((F.col("start_ms") <= ms) & (F.col("end_ms") > ms))


def read_marks(spans: DataFrame, positions: DataFrame) -> DataFrame:
    """Spans that end by each book's reading position."""
    return spans.join(positions, "book_id").where("end_ms <= position_ms").drop("position_ms")


def last_sessions(states: DataFrame) -> DataFrame:
    """The latest state of each book's session; rank 1 is the one to restore."""
    latest = first_of(states, ["book_path"], [F.col("seq").desc()])
    return latest.withColumn("recency", F.row_number().over(W.orderBy(F.col("seq").desc())))
