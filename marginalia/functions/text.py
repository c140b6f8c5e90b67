"""Text functions as column expressions: cleaning, markers, tokens, keywords, words.

All run in the JVM. Patterns start with (?U), so that \\s, \\d and \\w mean what Unicode says; the four separators U+001C
to U+001F, which (?U)\\s leaves out, become spaces first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters and words that the formats define.
SUPERSCRIPTS, SUBSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉", "0123456789"
SYMBOLS = "*†‡§"
STOPWORDS = (
    "the and that with from this have will were been they them into about under over your their there which when what "
    "would could should then than also only more"
).split()
CAPITAL_STOPWORDS = "the and for with from this that but not see said".split()
MARKER = (
    r"\[\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*\)|\[\s*[a-zA-Z]\s*\]|\(\s*[a-zA-Z]\s*\)|\*+|†+|‡+|§+"
    r"|(?:(?<=\w)|(?<=[)\]}'\"’”.,;:!?]))[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}(?=\s|$|[)\]}'\"’”.,;:!?])"
    r"|(?:(?<=\w)|(?<=[)\]}'\"’”.,;:!?]))[₀₁₂₃₄₅₆₇₈₉]{1,4}(?=\s|$|[)\]}'\"’”.,;:!?])"
)
#: Markers that RE2, which has no lookaround, can find too.
PLAIN_MARKER = r"\[\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*\)|\[\s*[a-zA-Z]\s*\]|\(\s*[a-zA-Z]\s*\)|\*+|†+|‡+|§+"


def safe_text(c: Column) -> Column:
    """Null to empty, runs of white space to one space, trimmed."""
    spaced = F.translate(F.coalesce(c, F.lit("")), "\x1c\x1d\x1e\x1f", "    ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def clean_line(c: Column) -> Column:
    """Odd spaces to spaces, invisible characters away; null to empty."""
    return F.translate(F.coalesce(c, F.lit("")), "   ﻿​⁠", "   ")


def clean_like_scanner(c: Column) -> Column:
    """clean_line, and joiners, direction marks and soft hyphens away too."""
    return F.translate(F.coalesce(c, F.lit("")), "   ﻿​⁠‌‍‎‏­", "   ")


def normalize_marker(c: Column) -> Column:
    """A marker's stable key: no brackets, plain digits."""
    m = F.regexp_replace(_strip(F.coalesce(c, F.lit(""))), r"^\[\[", "[")
    m = _strip(F.regexp_replace(m, r"\]\]$", "]"))
    m = _strip(F.regexp_replace(F.regexp_replace(m, r"^\((.*)\)$", "$1"), r"^\[(.*)\]$", "$1"))
    return safe_text(F.translate(m, SUPERSCRIPTS + SUBSCRIPTS, DIGITS * 2))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def heading_without_marker(c: Column) -> Column:
    """A heading without the note markers at its end; null if nothing is left."""
    end = r"(?U)(?:\s*(?:\(\s*\d{1,3}\s*\)|\[\s*\d{1,3}\s*\]|[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}|[*†‡§]+)\s*)+$"
    return F.nullif(F.rtrim(F.regexp_replace(safe_text(c), end, "")), F.lit(""))


def chapter_group_key(c: Column) -> Column:
    key = F.regexp_replace(F.upper(safe_text(c)), "[^A-Z0-9]+", "_")
    return F.nullif(F.regexp_replace(key, "^_+|_+$", ""), F.lit(""))


def roman_to_int(c: Column) -> Column:
    """Value of the numerals I to C in a text, other characters left out; null outside 1 to 500."""
    letters = F.reverse(F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^IVXLC]", ""), ""))
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).otherwise(0)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    total = F.aggregate(
        letters, start,
        lambda s, x: F.when(value(x) < s["last"], F.struct((s["total"] - value(x)).alias("total"), s["last"].alias("last"))).otherwise(F.struct((s["total"] + value(x)).alias("total"), value(x).alias("last"))),
        lambda s: s["total"],
    )
    return F.when(total.between(1, 500), total)


def _number(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int")).when(token != "", roman_to_int(token))


def chapter_token(c: Column) -> Column:
    """Chapter number of a label: CHAPTER n, else a numeral with a dot, else a numeral and a space."""
    t = safe_text(c)
    token = lambda p: F.regexp_extract(t, p, 1)
    one = token(r"(?i)^CHAPTER\s+([IVXLC]{1,12}|[0-9]{1,3})\b")
    two = token(r"^([IVXLC]{1,12}|[0-9]{1,3})\.(?:\s|$)")
    three = token(r"^([IVXLC]{1,12}|[0-9]{1,3})\s+\S")
    return F.when(one != "", _number(one)).when(two != "", _number(two)).when(three != "", _number(three))


def review_token(c: Column) -> Column:
    """Chapter number as the review reads it: NOTES TO CHAPTER n too, anywhere in the label; never of a PART heading."""
    t = safe_text(c)
    found = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (
        r"(?i)\b(?:NOTES|FOOTNOTES|ENDNOTES)\s+(?:TO|ON)\s+CHAPTER\s+([IVXLC]{1,12}|[0-9]{1,3})\b", r"(?i)\bCHAPTER\s+([IVXLC]{1,12}|[0-9]{1,3})\b",
        r"(?i)^([IVXLC]{1,12}|[0-9]{1,3})\s*\.", r"(?i)^([IVXLC]{1,12}|[0-9]{1,3})\b",
    )))
    return F.when(~t.rlike(r"(?i)^\[?\s*PART\b"), _number(found))


def notes_header_token(c: Column) -> Column:
    """Chapter number of a notes header such as NOTES TO CHAPTER VI."""
    return _number(F.regexp_extract(safe_text(c), r"(?i)^(?:FOOTNOTES|FOOTNOTES\s+AND\s+ENDNOTES|ENDNOTES|NOTES)\s+(?:TO|ON)\s+CHAPTER\s+([IVXLC]{1,12}|[0-9]{1,3})\s*[:.]?$", 1))


def upper_letters(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\p{Lu}")), F.lit(0))


def lower_letters(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\p{Ll}")), F.lit(0))


def letters(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(0))


def probe_window(raw: Column, norm: Column, context: Column, radius: int) -> Column:
    """The context about a marker's first hit: as written, in parentheses, in brackets, bare; else the context's start."""
    ctx = safe_text(context)
    out = F.substring(ctx, 1, max(40, 2 * radius))
    for needle in (norm, F.concat(F.lit("["), norm, F.lit("]")), F.concat(F.lit("("), norm, F.lit(")")), raw):
        at = F.instr(ctx, needle)
        start = F.greatest(at - radius, F.lit(1))
        window = F.substring(ctx, start, at + F.length(needle) + radius - start)
        out = F.when((F.coalesce(needle, F.lit("")) != "") & (at > 0), window).otherwise(out)
    return out


def context_window(text: Column, marker: Column, radius: int = 220, tidied: bool = False) -> Column:
    """Up to radius characters on either side of a marker's first hit; without a hit the first 400. tidied: both have been through safe_text."""
    t, mk = (text, marker) if tidied else (safe_text(text), safe_text(marker))
    quoted = F.concat(F.lit(r"\Q"), mk, F.lit(r"\E"))
    bare = F.when(mk.rlike("^[0-9]{1,3}$"), F.concat(F.lit(r"(?<![0-9])"), quoted, F.lit(r"(?![0-9])"))).when(mk.rlike("^[A-Za-z]$"), F.concat(F.lit(r"(?<![A-Za-z])"), quoted, F.lit(r"(?![A-Za-z])"))).otherwise(quoted)
    spaced = mk.rlike("^(?:[0-9]{1,3}|[A-Za-z])$")
    gap = F.when(spaced, F.lit(r"\s*")).otherwise(F.lit(""))
    out = F.substring(t, 1, 400)
    for pattern in (bare, F.concat(F.lit(r"\["), gap, quoted, gap, F.lit(r"\]")), F.concat(F.lit(r"\("), gap, quoted, gap, F.lit(r"\)"))):
        # a position by the length of what stands before: regexp_instr counts UTF-16 units
        before = F.call_function("regexp_extract", t, F.concat(F.lit("(?s)^(.*?)(?:"), pattern, F.lit(")")), F.lit(1))
        hit = F.regexp_substr(t, pattern)
        start = F.greatest(F.length(before) - radius, F.lit(0))
        window = F.substring(t, start + 1, F.length(before) + F.length(hit) + radius - start)
        out = F.when(hit.isNotNull() & (mk != ""), window).otherwise(out)
    return F.when(t == "", "").otherwise(out)


def keywords(c: Column, least: int = 4, most: int | None = 12) -> Column:
    """Distinct lower-case words of `least` letters or more that are no stopwords, in order, the first `most`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    kept = F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOPWORDS))))
    return kept if most is None else F.slice(kept, 1, most)


def capitalised(c: Column) -> Column:
    """Distinct capitalised words, lower-cased, without common ones."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b[A-Z][A-Za-z'’\-]{2,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, CAPITAL_STOPWORDS)))


def paragraphs(c: Column) -> Column:
    """Runs of lines that aren't blank, each stripped and joined by a space."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    blocks = F.split(text, r"(?U)\n(?:[\s&&[^\n]]*\n)+")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), _strip), lambda x: x != ""), " "))
    return F.filter(joined, lambda b: b != "")


def word_tokens(c: Column) -> Column:
    """Words with inner apostrophes and hyphens, and single other characters; white space falls away."""
    pattern = r"[a-zA-Z0-9](?:[a-zA-Z0-9'\-‐‑‘’]*[a-zA-Z0-9])?|[^a-zA-Z0-9\s]"
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def word_count(c: Column) -> Column:
    t = safe_text(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def first_words(c: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(safe_text(c), " "), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), " ")


def without_pronunciation(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")


def language_code(c: Column) -> Column:
    """Speech language of a voice's language tag: b for British English, else a."""
    return F.when(c.startswith("en-gb"), "b").otherwise("a")


def html_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marker_number(c: Column) -> Column:
    """A marker of one to three digits as a number, else null."""
    t = _strip(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("^[0-9]{1,3}$"), t.try_cast("int"))


def body_key(c: Column) -> Column:
    """First 40 characters, lower-cased, of a definition of 15 or more."""
    t = safe_text(c)
    return F.when(F.length(t) >= 15, F.lower(F.substring(t, 1, 40)))


def marker_category(c: Column) -> Column:
    t = _strip(F.coalesce(c, F.lit("")))
    ladder = (
        (r"^\(\s*\d{1,3}\s*\)$", "num_paren"), (r"^\[\s*\d{1,3}\s*\]$", "num_bracket"), (r"^[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}$", "num_sup"), (r"^[₀₁₂₃₄₅₆₇₈₉]{1,4}$", "num_sub"),
        (r"^\(\s*[a-zA-Z]\s*\)$", "let_paren"), (r"^\[\s*[a-zA-Z]\s*\]$", "let_bracket"), (r"^[*†‡§]+$", "symbol"), (r"^\d{1,3}$", "num_plain"), (r"^[a-zA-Z]{1,4}\d{1,3}[a-z]?$", "num_plain"),
    )
    out = F.lit("other")
    for pattern, name in reversed(ladder):
        out = F.when(t.rlike(f"(?U){pattern}"), name).otherwise(out)
    return out


def marker_family(raw: Column, norm: Column) -> Column:
    """Broad family of a marker: numeric, symbol, roman (single I V X L C too), letter, other or unknown."""
    t = safe_text(F.coalesce(F.nullif(raw, F.lit("")), norm))
    inner = F.when(t.rlike(r"^(?:\(.*\)|\[.*\])$"), _strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return (
        F.when(t == "", "unknown").when(inner.rlike(r"(?U)^(?:\d{1,3}|[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4}|[₀₁₂₃₄₅₆₇₈₉]{1,4})$"), "numeric").when(inner.rlike(r"^[*†‡§]+$"), "symbol")
        .when(F.upper(inner).rlike(r"^[IVXLC]{1,12}\.*$"), "roman").when(inner.rlike("^[A-Za-z]$"), "letter").otherwise("other")
    )


def chapter_key(source: Column, group: Column, label: Column, index: Column, page: Column, file: Column) -> Column:
    """The group a row is reviewed in."""
    chapter = F.coalesce(F.nullif(group, F.lit("")), F.nullif(label, F.lit("")), index.cast("string"), F.lit("undefined"))
    return (
        F.when(source == "epub", F.concat(F.lit("epub:"), chapter)).when(source == "pdf", F.concat(F.lit("pdf:"), page.cast("string")))
        .when(source == "text", F.concat(F.lit("text:"), F.coalesce(file, F.lit("")))).otherwise(F.concat(F.lit("other:"), F.coalesce(source, F.lit(""))))
    )


def chapter_title(source: Column, label: Column, index: Column, name: Column, page: Column, file: Column) -> Column:
    """What the review calls a row's chapter."""
    item = F.coalesce(F.nullif(F.substring_index(name, "/", -1), F.lit("")), F.concat(F.lit("Item "), index.cast("string")))
    return (
        F.when(source == "epub", F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Spine "), index.cast("string"), F.lit(": "), item)))
        .when(source == "pdf", F.concat(F.lit("Page "), (page + 1).cast("string"))).when(source == "text", F.concat(F.lit("File: "), F.coalesce(F.nullif(file, F.lit("")), F.lit("Text"))))
        .otherwise(F.concat(F.coalesce(source, F.lit("Source")), F.lit(" ")))
    )


def order_value(order_key: Column, position: Column, id: Column) -> Column:
    return F.coalesce(F.when(order_key >= 0, order_key), F.when(position >= 0, position.cast("long")), id.cast("long"), F.lit(0).cast("long"))


def order_key(base: Column, position: Column) -> Column:
    """Reading order: item or page, then position; a missing position comes last in its item."""
    last = 999_999_999
    return F.coalesce(base, F.lit(0)).cast("long") * 1_000_000_000 + F.least(F.when(position >= 0, position).otherwise(last), F.lit(last)).cast("long")


def natural_key(c: Column) -> Column:
    """A key that sorts digits by value inside text, case aside."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def file_label(c: Column) -> Column:
    """A name safe for files: letters, digits, - _ and . stay, spaces become underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_strip(F.coalesce(c, F.lit(""))), r"(?U)[^\w\-. ]", ""), " ", "_"), F.lit("")), F.lit("book"))


def book_stem(path: Column) -> Column:
    """Stem of a book's output files."""
    name = F.regexp_replace(F.substring_index(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(_strip(name), r"[^a-zA-Z0-9_\-.,() ]", "_"), r"\s+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^_+|_+$", ""), F.lit("")), F.lit("tts"))
