import random

import pytest

from weftwork.llm import canonical as c

VOCAB = [
    ("node", "person", ["individual", "human"]), ("node", "organization", ["company", None]), ("node", "location", ["loc"]), ("node", "job_title", None),
    ("edge", "works_for", ["employed by"]), ("edge", "owns", []), (None, "x", ["y"]), ("edge", None, ["z"]),
]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "kind string, canonical string, aliases array<string>")


CASES = [
    ("node", "person", "person", True), ("node", "PERSON ", "person", False), ("node", "type: perison", "person", False), ("node", "'Humann' #12", "person", False),
    ("node", "companies", "organization", False), ("node", "companys", "organization", False), ("node", "jobTitle", "job_title", False), ("node", "is job title (4)", "job_title", False),
    ("node", "lco", "location", False), ("node", "thing-ish", c.NONE, False), ("node", "???", c.NONE, False), ("node", "848", c.NONE, False), ("node", "works_for", c.NONE, False),
    ("edge", "wroks-for_17", "works_for", False), ("edge", "Employed By", "works_for", False), ("edge", "ownns", "owns", False), ("edge", "smells_like", c.NONE, False),
    ("edge", "owns", "owns", True), ("other", "owns", c.NONE, False), ("node", None, c.NONE, False), ("node", "person" * 3000, c.NONE, False), (None, "person", c.NONE, False),
]


def test_cases_both_ways(spark, vocab):
    rows = spark.createDataFrame([(k, *x[:2], "clash") for k, x in enumerate(CASES)], "k int, kind string, value string, name string")
    for limit in (c.MAX_KEYS, 3):
        got = {r.k: (r.canonical, r.exact) for r in c.map_values(rows, vocab, max_keys=limit).collect()}
        for k, x in enumerate(CASES):
            assert got[k] == x[2:], (x, got[k], limit)


def test_ties_and_empty(spark, vocab):
    rows = spark.createDataFrame([], "kind string, value string")
    assert c.map_values(rows, vocab).count() == 0
    two = spark.createDataFrame([("node", "aaam", None), ("node", "aaav", None)], "kind string, canonical string, aliases array<string>")
    tie = spark.createDataFrame([("node", "aaaq")], "kind string, value string")
    assert c.map_values(tie, two).first().canonical == "aaam"
    none = spark.createDataFrame([], "kind string, canonical string, aliases array<string>")
    assert c.map_values(tie, none).first().canonical == c.NONE


def dl(a, b):
    """Unrestricted Damerau-Levenshtein, recursively."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, d(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return d(len(a), len(b))


def test_symmetric_deletes_find_every_close_name():
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    lexicon = c.Lexicon([(n, n, 0) for n in names])
    for _ in range(300):
        typed = list(rng.choice(names))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(typed))
            what = rng.randrange(4)
            if what == 0 and len(typed) > 5:
                typed.pop(at)
            elif what == 1:
                typed.insert(at, rng.choice("abcd"))
            elif what == 2:
                typed[at] = rng.choice("abcd")
            elif at:
                typed[at - 1], typed[at] = typed[at], typed[at - 1]
        typed = "".join(typed)
        close = [n for n in names if c.typo_cost(n, typed) <= 2]
        assert all(dl(n, typed) <= 3 for n in close)
        exact = [n for n in names if dl(n, typed) <= 2]
        # every name within two edits shares a remain, so the best one is found
        found = lexicon.find(typed)
        if exact:
            assert c.typo_cost(found, typed) <= min(c.typo_cost(n, typed) for n in exact) + 1e-9


def test_long_compatibility_names_both_ways(spark):
    """A character that stands for many counts as many, with the dictionary broadcast or joined."""
    vocab = spark.createDataFrame([("node", "\ufdfa", None)], "kind string, canonical string, aliases array<string>")
    rows = spark.createDataFrame([("node", "\ufdfa!")], "kind string, value string")
    assert {c.map_values(rows, vocab, max_keys=limit).first().canonical for limit in (c.MAX_KEYS, 0)} == {"\ufdfa"}
    names = c.vocabulary(spark.createDataFrame([("node", "abcd", ["xyz"])], "kind string, canonical string, aliases array<string>"))
    assert c.key_count(names) == len(c.remains("abcd", 2)) + len(c.remains("xyz", 2))
