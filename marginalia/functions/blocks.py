"""Notes blocks of an item: where they lie, what prose is left without them, and which label a place has.

Functions on the lines of one item, called from the Arrow pass of a scan.
"""

from __future__ import annotations

import re
from itertools import pairwise
from typing import NamedTuple

from marginalia.functions import chapters as C
from marginalia.functions import notes as N
from marginalia.functions.rules import tidy

#: Share of an item up to which a notes block that ends counts as notes in the middle (fixed value).
MIDDLE = 0.70


class Block(NamedTuple):
    """A notes block: its header's line, the line after it where it starts, and the line where it ends."""

    header: int
    start: int
    stop: int

    def middle(self, n_lines: int) -> bool:
        """Whether prose goes on after it."""
        return self.stop < n_lines and self.start <= MIDDLE * n_lines


def notes_blocks(lines: list[str]) -> list[Block]:
    """Every notes block with a definition: from a header to where prose resumes or the next header stands."""
    headers = [k for k, line in enumerate(lines) if N.is_header(line) or N._token(line) is not None]
    out = []
    for k, following in pairwise([*headers, len(lines)]):
        start = next((j for j in range(k + 1, following) if lines[j].strip()), None)
        if start is None or not (N.DEFINITION.match(lines[start]) or N.MARKER_ONLY.match(lines[start])):
            continue
        out.append(Block(k, start, C.notes_end(lines[:following], k)))
    return out


def excluded(lines: list[str]) -> list[bool]:
    """For each line whether it belongs to notes: in a block, or after the place where the notes of an item without blocks start."""
    mask = [False] * len(lines)
    blocks = notes_blocks(lines)
    for b in blocks:
        mask[b.header : b.stop] = [True] * (b.stop - b.header)
    if not blocks:
        start = N.split_or_tail(lines)[1].main_end
        mask[start:] = [True] * (len(lines) - start)
    return mask


def prose_view(lines: list[str]) -> list[str]:
    """The lines with those of notes blank, so that places stay the same line for line."""
    return ["" if out else line for line, out in zip(lines, excluded(lines), strict=True)]


def block_definitions(lines: list[str]) -> list[N.Definition]:
    """Definitions of all notes blocks of an item, each with the chapter number of its own header."""
    out: list[N.Definition] = []
    for b in notes_blocks(lines):
        out += N.definitions(lines[: b.stop], b.start, scoped=True, token=N._token(lines[b.header]))
    return out


#: Lines in which an item's label is looked for (fixed value).
LABEL_LINES = 20_000


def logical_label(lines: list[str]) -> C.Heading | None:
    """The first heading with a chapter number, else the first heading."""
    found = C.headings(lines[:LABEL_LINES])
    return next((h for h in found if h.token is not None), found[0] if found else None)


def relocated(text: str, marker_raw: str, context: str, words: int = 3) -> int | None:
    """Where an anchor stands in the text as it was: after the last words that lead up to it, at its marker if it stands once, or where its context begins."""
    at = context.find(marker_raw)
    lead = tidy(context[:at] if at >= 0 else context).split()[-words:]
    flexible = r"\s+".join(map(re.escape, lead))
    for pattern in ([flexible + r"\s*" + re.escape(marker_raw), flexible] if lead else []):
        if m := re.search(pattern, text):
            return m.end() - (len(marker_raw) if pattern != flexible else 0)
    if marker_raw and text.count(marker_raw) == 1:
        return text.index(marker_raw)
    beginning = r"\s+".join(map(re.escape, tidy(context).split()[:words]))
    return m.start() if beginning and (m := re.search(beginning, text)) else None


def spoken_word(word: str, following: str) -> str:
    """A timed word for display: without note symbols, with a space after it where a word follows, without one where punctuation does."""
    plain = re.sub(r"[*†‡§]+", "", word)
    rest = following.lstrip("*†‡§ \t")
    a_word = rest[:1].isalnum()
    if plain[-1:].isalnum():
        return plain + " " if a_word else plain
    return plain.rstrip() if plain != word and not a_word else plain
