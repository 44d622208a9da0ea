"""Statistics of texts, vectorised over all characters of a batch.

The texts of a batch are one array of code points; classes of characters are looked up
in a table, and counts of lines, words and texts are differences of running sums. No
step looks at one text by itself but the removal of markup.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd

_CELL = re.compile(r"</(?:td|th)>\s*<(?:td|th)\b[^<>]*>", re.I)
_ITEM = re.compile(r"<li\b[^<>]*>|\[\*\]", re.I)
_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|table|blockquote|h[1-6]|pre)\b[^<>]*>|\\n", re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|\[(?![xX]\])/?[a-zA-Z]+(?:=[^\[\]\n]*)?\]|&(?:amp;)*(?:#?\w{2,31});|%[0-9A-Fa-f]{2}")
_QUOTE = re.compile(r"^[ \t]*(?:[>|:][ \t]?)+", re.M)

# Bits of a character's class.
LETTER, DIGIT, SPACE, UPPER, VOWEL, ASCII, STOP, CELL, SIGN, HEX, CORE, INNER, PART, FILL = (1 << k for k in range(14))
#: Ends of sentences, marks between parts, borders of table cells, bullets.
_STOPS, _INNER, _PARTS, _CELLS, _BULLETS = ".!?…。！？؟।", ".!?,;:", ",;/•|", "|│¦\t", "-*•·▪◦+–#"
_VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûæøåœëïãõ"

_known = np.zeros(0x110000, bool)
_class = np.zeros(0x110000, np.uint16)
_lower = np.arange(0x110000, dtype=np.uint32)


def _classify(code: int) -> tuple[int, int]:
    char = chr(code)
    if 0xD800 <= code < 0xE000:
        return 0, code
    kind = unicodedata.category(char)
    bits = 0
    if kind[0] in "LM":
        bits |= LETTER
    if kind == "Nd":
        bits |= DIGIT
    if char.isspace():
        bits |= SPACE
    if kind == "Lu":
        bits |= UPPER
    low = char.lower()
    if low in _VOWELS:
        bits |= VOWEL
    if "a" <= low <= "z":
        bits |= ASCII
    if char in _STOPS:
        bits |= STOP
    if char in _INNER:
        bits |= INNER
    if char in _PARTS:
        bits |= PART
    if char in "._":
        bits |= FILL
    if bits & (LETTER | DIGIT | STOP) or char in ",:":
        bits |= CORE
    if char in _CELLS:
        bits |= CELL
    if kind in ("Sc", "So", "Sm", "Sk", "Pf", "Pi", "No", "Cc", "Cn") and not char.isspace():
        bits |= SIGN
    if char in "0123456789abcdefABCDEF":
        bits |= HEX
    return bits, ord(low) if len(low) == 1 else code


def _learn(codes: np.ndarray) -> None:
    """Classes of characters not met before in this process."""
    if _known[codes].all():
        return
    here = np.zeros(0x110000, bool)
    here[codes] = True
    for code in np.flatnonzero(here & ~_known).tolist():
        _class[code], _lower[code] = _classify(code)
    _known[:] |= here


def unrolled(text: str) -> str:
    """Text with block markup as line breaks, other markup and quote marks removed."""
    if "<" in text or "[" in text or "\\n" in text:
        text = _BREAK.sub("\n", _ITEM.sub("\n- ", _CELL.sub(" | ", text)))
    if "<" in text or "[" in text or "&" in text or "%" in text:
        text = html.unescape(_TAG.sub("", text))
    return _QUOTE.sub("", text)


def _sums(flags: np.ndarray) -> np.ndarray:
    """Running sums with a leading 0."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def _hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a polynomial of its characters; the work follows the characters, however long a word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat(codes[np.repeat(starts, sizes) + place].astype(np.uint64) * powers[place], before) + sizes.astype(np.uint64)


def word_hash(word: str) -> int:
    codes = np.array([ord(c) for c in word], np.uint64)
    return int(_hash(codes, np.array([0]), np.array([len(codes)]))[0])


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def line_table(texts: list[str], common: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """(statistics of lines, statistics of texts, text of each pair, hashes of pairs of neighbouring words) of a batch.

    ``common`` are the sorted hashes of common words.
    """
    plain = [unrolled(t) for t in texts]
    big = "".join(p + "\n" for p in plain)
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    _learn(codes)
    cls = _class[codes]
    low = _lower[codes]
    n = len(codes)
    text_end = np.cumsum([len(p) + 1 for p in plain])
    line_end = np.flatnonzero(codes == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    m = len(line_end)
    solid = (cls & SPACE) == 0

    def has(bit):
        return (cls & bit) != 0

    def per_line(flags):
        places = np.flatnonzero(flags)
        if 20 * len(places) < n:
            return np.bincount(np.searchsorted(line_end, places), minlength=m)
        s = _sums(flags)
        return s[line_end] - s[line_start]

    def spans(flags):
        edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def after(flags, k=1):
        out = np.zeros(n, bool)
        out[: max(0, n - k)] = flags[k:]
        return out

    def before(flags, k=1):
        out = np.zeros(n, bool)
        out[k:] = flags[: max(0, n - k)]
        return out

    # tokens between blanks; links are set aside
    t0, t1 = spans(solid)
    t_line = np.searchsorted(line_end, t0)
    slashes = (codes == ord(":")) & after(codes == ord("/")) & after(codes == ord("/"), 2)
    s = _sums(slashes)
    is_www = (low[t0] == ord("w")) & (low[np.minimum(t0 + 3, n - 1)] == ord(".")) if len(t0) else np.zeros(0, bool)
    is_url = (s[t1] - s[t0] > 0) | is_www
    edge = np.zeros(n + 1, np.int32)
    edge[t0[is_url]] += 1
    edge[t1[is_url]] -= 1
    in_url = np.cumsum(edge[:-1]) > 0
    cls = np.where(in_url, np.uint16(0), cls)
    letter, digit = has(LETTER), has(DIGIT)
    lines = pd.DataFrame({"visible": per_line(solid), "url": per_line(in_url)})
    text = np.searchsorted(text_end - 1, line_end)
    lines["text"] = text

    def by_line(values, ids):
        return np.bincount(ids, values, m).astype(np.int64)

    lines["tokens"] = by_line(~is_url, t_line)
    s_letter, s_digit, s_hex = _sums(letter), _sums(digit), _sums(has(HEX))
    t_len, t_letters, t_digits = t1 - t0, s_letter[t1] - s_letter[t0], s_digit[t1] - s_digit[t0]
    lines["letters"], lines["digits"] = per_line(letter), per_line(digit)
    lines["signs"] = per_line(has(SIGN))
    lines["cells"] = per_line(has(CELL))
    lines["parts"] = per_line(has(PART))
    # values behind a separator without a blank, as in exported tables
    lines["fields"] = per_line(after(digit) & ((codes == ord(";")) | ((codes == ord(",")) & before(letter))))
    long = (t_len >= 40) & ~is_url
    lines["long"] = by_line(np.where(long, t_len, 0), t_line)
    lines["hex"] = by_line(np.isin(t_len, (2, 4, 8)) & (s_hex[t1] - s_hex[t0] == t_len), t_line)
    # figures: tokens of at least one digit and no letter, counted with their signs
    number = (t_digits > 0) & (t_letters == 0) & ~is_url
    lines["numbers"] = by_line(number, t_line)
    # gaps within a line and fillers
    gap = (codes == 32) & after(codes == 32) & after(codes == 32, 2)
    lines["gaps"] = per_line(gap & before(solid))
    filler = has(FILL)
    lines["fillers"] = per_line(filler & after(filler) & after(filler, 2) & after(filler, 3))
    equals = codes == ord("=")
    lines["equals"] = per_line(equals & (before(letter) | before(digit)) & after(solid))
    clock = digit & after(codes == ord(":")) & after(digit, 2) & after(digit, 3) & after(codes == ord(":"), 4) & after(digit, 5)
    first = np.searchsorted(t0, line_start)
    begin = np.where(first < len(t0), t0[np.minimum(first, max(len(t0) - 1, 0))], n - 1) if len(t0) else np.zeros(m, int)
    s = _sums(clock)
    lines["clock"] = s[np.minimum(np.minimum(begin + 24, line_end), n)] - s[np.minimum(begin, line_end)]
    # bullets: a mark, a number or a letter with a bracket or dot, in front of a blank
    head = codes[begin]
    head_len = np.where(first < len(t0), t_len[np.minimum(first, max(len(t0) - 1, 0))], 0) if len(t0) else np.zeros(m, int)
    tail = codes[np.minimum(begin + np.maximum(head_len - 1, 0), n - 1)]
    lead = np.where(first < len(t0), t_digits[np.minimum(first, max(len(t0) - 1, 0))], 0) if len(t0) else np.zeros(m, int)
    mark = np.isin(head, [ord(c) for c in _BULLETS]) & (head_len <= 3)
    counted = np.isin(tail, (ord("."), ord(")"))) & (lead == head_len - 1) & (lead >= 1) & (lead <= 3)
    lettered = (tail == ord(")")) & (head_len <= 3) & (head_len >= 2) & (lead == 0)
    box = (head == ord("[")) & (head_len <= 3)
    lines["bullet"] = ((mark | counted | lettered | box | ((head == ord("o")) & (head_len == 1))) & (begin + head_len < line_end)).astype(np.int64)
    # stops
    stop = has(STOP)
    quote = solid & ~letter & ~digit & ~stop
    closed = stop & (after(~solid) | (after(quote) & after(~solid, 2)))
    lines["stops"] = per_line(closed) - (counted & (tail == ord(".")))
    places = np.flatnonzero(has(CORE))
    at = np.searchsorted(places, line_end) - 1
    last = np.where(at >= 0, places[np.maximum(at, 0)], -1) if len(places) else np.full(m, -1)
    lines["ends"] = ((last >= line_start) & ~(letter | digit)[np.maximum(last, 0)]).astype(np.int64)

    # words
    w0, w1 = spans(letter)
    w_line = np.searchsorted(line_end, w0)
    w_len = w1 - w0
    hashes = _hash(low, w0, w1)
    is_common = _find(common, hashes) >= 0
    lines["words"] = by_line(np.ones(len(w0)), w_line)
    lines["common"] = by_line(is_common, w_line)
    ascii_letter, vowel = has(ASCII), has(VOWEL)
    s_ascii, s_vowel = _sums(ascii_letter), _sums(vowel)
    consonant = ascii_letter & ~vowel
    two = consonant & after(consonant)
    s_run = _sums(two & after(two, 2) & after(consonant, 4))
    w_ascii, w_vowel = s_ascii[w1] - s_ascii[w0], s_vowel[w1] - s_vowel[w0]
    odd = (w_ascii == w_len) & (((w_len >= 4) & ((w_vowel == 0) | (s_run[w1] - s_run[w0] > 0))) | ((w_len >= 6) & (5 * w_vowel < w_len)))
    lines["odd"] = by_line(np.where(odd, w_len, 0), w_line)
    lines["ascii"] = per_line(ascii_letter)
    lines["vowels"] = per_line(vowel & ascii_letter)
    # marks of things counted or ordered: x3, AB-12, a bracket at the end
    s_part = _sums(has(UPPER) & after(codes == ord("-")) & after(digit, 2))
    amount = (low[t0] == ord("x")) & (t_len >= 2) & (t_digits == t_len - 1)
    lines["stock"] = by_line(amount | (s_part[t1] - s_part[t0] > 0), t_line) + ((codes[np.maximum(line_end - 1, 0)] == ord(")")) & (lines["words"] > 0))

    # per text
    k = len(texts)
    texts_out = pd.DataFrame({"n_chars": [len(t) for t in texts]})
    texts_out["markup"] = np.maximum(0, texts_out["n_chars"] - [len(p) for p in plain])
    w_text = text[w_line] if len(w_line) else np.zeros(0, int)
    s_solid = _sums(solid)
    near = (s_solid[w0[1:]] == s_solid[w1[:-1]]) & (w_text[1:] == w_text[:-1])
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[near].view(np.int64)
    # repeats: a token that equals one of the three before or behind it
    t_hash = _hash(low, t0, t1)
    t_text = text[t_line] if len(t_line) else np.zeros(0, int)
    again = np.zeros(len(t0), bool)
    for d in (1, 2, 3):
        if len(t0) > d:
            same = (t_hash[d:] == t_hash[:-d]) & (t_text[d:] == t_text[:-d])
            again[d:] |= same
            again[:-d] |= same
    texts_out["repeated"] = np.bincount(t_text, np.where(again, t_len, 0), k).astype(np.int64)
    # marks within the text: what stands behind the last word does not count
    count_to = _sums(has(INNER) & after(~solid))
    start = np.concatenate([[0], text_end[:-1]])
    at = np.searchsorted(w1, text_end) - 1
    behind = np.where(at >= 0, w1[np.maximum(at, 0)], 0) if len(w1) else np.zeros(k, int)
    texts_out["inner"] = np.maximum(0, count_to[np.maximum(behind, start)] - count_to[start])
    texts_out["words"] = np.bincount(w_text, minlength=k)
    texts_out["tokens"] = np.bincount(t_text, minlength=k)
    return lines, texts_out, w_text[1:][near], pairs
