"""Questions to a language model: a client the caller gives; nothing here opens a connection.

A client is a function (prompt, max_tokens) -> answer or None. It runs in the tasks, a batch of BATCH questions a call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Client = Callable[[str, int], str | None]
BATCH = 5
#: What an answer's line looks like (fixed value).
ANSWER = re.compile(r"\s*ID\s*:\s*(\d+)\s+BEST\s*:\s*(C\d+|NONE)\s+CONF\s*:\s*([01](?:\.\d+)?)\s*", re.I)
PAIRING = "Pair each note anchor with its definition. For each ID give the best candidate (C0..Cn) or NONE, one line each: ID:<id> BEST:<Ck|NONE> CONF:<0.00-1.00>.\n\n"
PROFILE = "Say how notes are marked in this excerpt, in one word: numeric, symbol, letter or unknown.\n\n"
HEADER = "Which line number is the header of the notes section? Answer with the number or NONE.\n\n"


#: Where a client asks if nothing else is said, and the path of an endpoint (fixed values).
ENDPOINT, CHAT = "http://localhost:8080/v1/chat/completions", "/chat/completions"


def endpoint(url: str | None) -> str:
    """A chat endpoint's whole address: of a bare host, of its /v1, or as it is."""
    given = (url or "").strip(" \t\r\n\"'").rstrip("/")
    missing = {r".*/chat/completions": "", r".*/v1": CHAT, r"https?://[^/?#]*": f"/v1{CHAT}"}
    return next((given + more for form, more in missing.items() if re.fullmatch(form, given, re.I)), given) if given else ENDPOINT


def question(id: int, marker: str, context: str, candidates: list[str]) -> str:
    listed = "\n".join(f"  - C{k}: {c[:200]}" for k, c in enumerate(candidates))
    return f"ID: {id}\nMarker: {marker}\nAnchor context: {context[:250]}\nCandidates:\n{listed}\n"


def answers(text: str | None) -> dict[int, tuple[int | None, float]]:
    """Candidate (None: none fits) and confidence by id; lines of another form are left out."""
    found = (ANSWER.match(line.strip()) for line in (text or "").splitlines())
    return {int(m[1]): (None if m[2].upper() == "NONE" else int(m[2][1:]), float(m[3])) for m in found if m}


def disambiguate(rows: DataFrame, client: Client) -> DataFrame:
    """Pending rows (id, marker, context, candidates, confidence_score) with the model's choice.

    ai_status becomes matched, none, unparsed, or unavailable where the client gives no answer; what was found else stays.
    """
    waiting = rows.where("ai_status = 'pending'").withColumn("_batch", F.floor((F.row_number().over(W.partitionBy("book_id", "chapter_index").orderBy("id")) - 1) / BATCH))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data = sorted(table.to_pylist(), key=lambda r: r["id"])
        reply = client(PAIRING + "\n---\n".join(question(r["id"], r["marker"], r["context"] or "", r["candidates"] or []) for r in data), 700)
        chosen = answers(reply)
        out = []
        for r in data:
            text, score, label, status = None, r["confidence_score"], r["confidence"], "unavailable" if not reply else "unparsed"
            if r["id"] in chosen:
                k, sure = chosen[r["id"]]
                if k is None:
                    score, label, status = min(score, 0.5), "Manual Review Required", "none"
                elif k < len(r["candidates"] or []):
                    score = max(score, sure)
                    text, label, status = r["candidates"][k], f"AI Match ({score:.2f})", "matched"
            out.append((r["id"], text, score, label, status))
        names = ("id", "_text", "_score", "_label", "_status")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string()), strict=True)})

    asked = waiting.select("book_id", "chapter_index", "_batch", F.col("id").cast("long"), "marker", "context", "candidates", "confidence_score", "confidence")
    found = asked.groupBy("book_id", "chapter_index", "_batch").applyInArrow(run, "id long, _text string, _score double, _label string, _status string")
    both = rows.join(found, "id", "left")
    for column, new in (("suggested_definition", "_text"), ("confidence_score", "_score"), ("confidence", "_label"), ("ai_status", "_status")):
        both = both.withColumn(column, F.coalesce(new, column))
    return both.drop("_text", "_score", "_label", "_status")


def profiles(books: DataFrame, client: Client) -> DataFrame:
    """(book_id, text) to the model's marker profile, from the first 5,000 characters; null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [((client(PROFILE + (t or "")[:5_000], 10) if t else None) or "").strip().lower().split(" ")[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array([w if w in ("numeric", "symbol", "letter") else None for w in words], pa.string())], ["book_id", "profile"])

    return books.select("book_id", "text").mapInArrow(run, "book_id long, profile string")


def header_line(lines: list[str], candidates: list[int], client: Client) -> int | None:
    """The line the model takes for the notes header, among those shown with 80 lines before and 40 after the first."""
    if not candidates:
        return None
    first = max(0, candidates[0] - 80)
    shown = "\n".join(f"{k}: {lines[k][:120]}" for k in range(first, min(len(lines), candidates[0] + 40)))
    m = re.match(r"\s*(\d+)", client(HEADER + shown, 10) or "")
    return int(m[1]) if m and int(m[1]) in candidates else None
