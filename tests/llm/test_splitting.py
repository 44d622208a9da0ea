import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import splitting as sp


def check(text, limit, overlap, out):
    assert out[0][0] == 0 and out[-1][1] == len(text) and out[-1][2] == "end"
    for (a, b, cut), (c, d, _) in zip(out, out[1:], strict=False):
        assert b - a <= limit and c == b - overlap and c > a and d > b
        if cut == "hard":
            low = a + overlap
            assert not any(low < p <= a + limit for places in sp.boundaries(text).values() for p in places)
    assert out[-1][1] - out[-1][0] <= limit


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab.! \n\ré́‍\U0001f469。"), max_size=200), st.integers(2, 40), st.integers(0, 30))
def test_invariants(text, limit, overlap):
    if text:
        out = sp.pieces(text, limit, overlap)
        check(text, limit, overlap if overlap < limit else limit // 2, out)


def test_prefers_better_boundaries():
    text = "One two. Three four.\n\nFive six seven eight nine ten."
    assert [text[a:b] for a, b, _ in sp.pieces(text, 30)][0] == "One two. Three four.\n\n"
    assert sp.pieces("aaaa bbbb. cc dd", 12)[0] == (0, 11, "sentence")
    assert sp.pieces("x" * 25, 10, 3) == [(0, 10, "hard"), (7, 17, "hard"), (14, 24, "hard"), (21, 25, "end")]


def test_hard_cuts_keep_graphemes():
    family = "\U0001f469‍\U0001f469‍\U0001f467"
    text = family * 10
    borders = {0, *(m.end() for m in regex.finditer(r"\X", text))}
    assert all(b in borders for _, b, _ in sp.pieces(text, 12))


def test_pieces_begin_with_whole_characters():
    family = "\U0001f469\u200d\U0001f469\u200d\U0001f467"
    text = (family + "ab. " + "abcdefgh. ") * 20
    borders = {0, *(m.end() for m in regex.finditer(r"\X", text))}
    assert all(a in borders and b in borders for a, b, _ in sp.pieces(text, 40, 6))


def test_token_prefix_sums():
    text = "alpha beta gamma delta epsilon zeta"
    starts = [m.start() for m in regex.finditer(r"\S+", text)]
    prefix = np.searchsorted(np.array(starts), np.arange(len(text) + 1), side="left")
    out = sp.pieces(text, 2, 1, prefix)
    assert [text[a:b] for a, b, _ in out] == ["alpha beta ", "beta gamma ", "gamma delta ", "delta epsilon ", "epsilon zeta"]


def test_rows(spark):
    rows = [(1, "a b " * 30, 20, 5, "x"), (2, None, 5, 1, "x"), (3, "  \n", 1, 0, "x"), (4, "short", 100, None, "x"), (5, "y" * 50, None, None, "x"), (6, "z" * 30, 10, -4, "x"), (1, "a b " * 30, 20, 5, "x"), (7, "q" * 300_000, 100_000, 200_000, "x")]
    df = spark.createDataFrame(rows, "request_id bigint, text string, max_chars int, overlap_chars int, cut string")
    out = sp.split_texts(df).collect()
    by = {k: sorted((r.piece_no, r.start_at, r.end_at, r.text) for r in out if r.request_id == k) for k in range(1, 8)}
    assert not by[2] and not by[3] and len(by[4]) == len(by[5]) == 1 and len(by[6]) == 3
    assert len(by[1]) % 2 == 0 and by[1][0] == by[1][1]
    assert all(e - s <= 100_000 for _, s, e, _ in by[7])
    assert sp.split_texts(df.limit(0)).count() == 0
