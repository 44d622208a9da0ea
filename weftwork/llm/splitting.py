"""Oversized texts cut into pieces at natural boundaries.

Sizes are prefix sums over the text, in characters or in tokens; boundaries are
sorted arrays of positions, one for each kind. From a piece's start a binary search
in the prefix sums gives the farthest end under the limit, another in the boundary
arrays the last boundary before it: the best kind with a boundary in the later half
of the room, else any kind, else a hard cut between two characters as readers see
them. The next piece starts the overlap before the end of the last.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from weftwork.session import spread

#: Kinds of boundaries, best first.
KINDS = ("paragraph", "line", "sentence", "word")
_FIND = {
    "paragraph": regex.compile(r"(?:\r\n|[\n\r  ])(?:[ \t 　]*(?:\r\n|[\n\r  ]))+"),
    "line": regex.compile(r"\r\n|[\n\r  ]"),
    "sentence": regex.compile(r"[.!?…؟।]+[\"'”’)\]»]*\s+|[。！？]+[」』”）]*\s*"),
    "word": regex.compile(r"\s+"),
}
_GRAPHEME = regex.compile(r"\X")


def boundaries(text: str) -> dict[str, list[int]]:
    """Sorted positions after which a new piece may start, by kind."""
    return {kind: [m.end() for m in pattern.finditer(text)] for kind, pattern in _FIND.items()}


def graphemes(text: str) -> list[int] | None:
    """Borders of user-perceived characters, or None where every position is one."""
    if text.isascii() and "\r\n" not in text:
        return None
    return [0, *(m.end() for m in _GRAPHEME.finditer(text))]


def _last(positions, low: int, high: int) -> int | None:
    """The last position in (low, high]."""
    i = bisect_right(positions, high)
    return positions[i - 1] if i and positions[i - 1] > low else None


def pieces(text: str, limit: int, overlap: int = 0, prefix: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of a text.

    ``prefix[i]`` is the size of the first i characters; None counts characters.
    Cuts then lie where a size begins (at a token). The last piece ends with kind
    ``end``. An overlap of the limit or more cannot be met; half the limit is taken.
    """
    n = len(text)
    size = (lambda i: i) if prefix is None else (lambda i: int(prefix[i]))
    if limit < 1 or size(n) <= limit:
        return [(0, n, "end")] if n else []
    overlap = max(0, overlap)
    overlap = overlap if overlap < limit else limit // 2
    cuts = boundaries(text)
    whole = graphemes(text)
    if prefix is not None:
        begins = np.flatnonzero(np.diff(prefix)).tolist()  # a token starts here
        allowed = set(begins)
        cuts = {kind: [p for p in positions if p in allowed] for kind, positions in cuts.items()}
        whole = sorted(allowed.intersection(whole)) if whole is not None else begins
    natural = cuts
    if overlap and whole is not None:
        # rather end where the next piece, stepped back, begins with a whole character
        borders = set(whole)
        natural = {kind: [p for p in positions if p - overlap in borders] for kind, positions in cuts.items()} if prefix is None else cuts
    out, start = [], 0
    while size(n) - size(start) > limit:
        if prefix is None:
            high = start + limit
            low = start + overlap
        else:
            high = int(np.searchsorted(prefix, prefix[start] + limit, side="right")) - 1
            low = int(np.searchsorted(prefix, prefix[start] + overlap, side="right")) - 1
        middle = max(low, start + (high - start) // 2)
        end, kind = None, ""
        for kind, places in ((k, c[k]) for k in KINDS for c in (natural, cuts)):
            if (end := _last(places, middle, high)) is not None:
                break
        if end is None:
            end, kind = max(((p, k) for k in KINDS if (p := _last(natural[k], low, high)) is not None), default=(None, ""))
        if end is None:
            end, kind = max(((p, k) for k in KINDS if (p := _last(cuts[k], low, high)) is not None), default=(None, ""))
        if end is None:
            kind = "hard"
            end = high if whole is None else _last(whole, low, high) or high
            if prefix is None and overlap and whole is not None and end - overlap not in borders:
                end = next((p for p in reversed(whole[bisect_right(whole, middle) : bisect_right(whole, high)]) if p - overlap in borders), end)
        out.append((start, end, kind))
        if prefix is None:
            start = end - overlap
        else:
            back = bisect_right(prefix, prefix[end] - overlap) - 1 if overlap else end  # where that token begins
            start = back if back > start else end
    return [*out, (start, n, "end")]


def split_texts(requests: DataFrame) -> DataFrame:
    """Pieces of ``requests.text`` under ``max_chars`` with ``overlap_chars`` shared by neighbours.

    ``request_id, piece_no, start_at, end_at, cut, text``; offsets count code
    points. Null and blank texts give no piece, texts within the limit one. A null
    or non-positive limit means none; a null or negative overlap means none.
    Requests sent twice keep their own pieces.
    """
    columns = ["request_id", "piece_no", "start_at", "end_at", "cut", "text"]

    def split(batches):
        for batch in batches:
            rows = []
            limits = batch["max_chars"].fillna(0).astype("int64")
            overlaps = batch["overlap_chars"].fillna(0).astype("int64")
            for key, text, limit, overlap in zip(batch["request_id"], batch["text"], limits, overlaps, strict=True):
                if text is not None and text.strip():
                    rows += [(key, k, a, b, cut, text[a:b]) for k, (a, b, cut) in enumerate(pieces(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=columns)

    source = spread(requests.select("request_id", "text", "max_chars", "overlap_chars").where("text is not null"))
    return source.mapInPandas(split, "request_id bigint, piece_no int, start_at int, end_at int, cut string, text string")
