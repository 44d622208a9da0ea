"""Free-typed values mapped to a canonical list.

A symmetric-delete dictionary: every name of the list and every value loses up to
two characters in all ways; equal remains propose a pair, whose weighted
Damerau-Levenshtein distance decides, names seen more often winning ties. Values
that no name explains map to ``NONE`` and are reported.

The dictionary goes to the executors as a broadcast only while its keys are within
``max_keys``; the rows then never shuffle. A larger list takes ``map_distinct``,
which joins the remains of the distinct values with those of the names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import has_text

NONE = "(none)"
#: Keys up to which the dictionary is broadcast, about 200 MB in a worker.
MAX_KEYS = 2_000_000
#: Rows of the keyboard, for typing errors between neighbours.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_NEAR = {
    (a, b)
    for r, row in enumerate(KEYBOARD)
    for i, a in enumerate(row)
    for q in (r - 1, r, r + 1)
    if 0 <= q < len(KEYBOARD)
    for j, b in enumerate(KEYBOARD[q])
    if a != b and abs(i - j) <= 1
}
_COUNTER = re.compile(r"[\W_]*(?:#\s*\d+|\(\s*\d+\s*\)|\[\s*\d+\s*\]|\d+)[\W_]*$")
_LEAD = re.compile(r"^(?:(?:type|rel|is|a|an|the)[\s:_]+)+")


def squash(text: str) -> str:
    """Letters and digits only, without case, accents or compatibility forms."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in plain if c.isalnum())


def forms(value: str) -> list[str]:
    """What a typed value may stand for: without counter, with and without leading word, with and without plural s."""
    text = unicodedata.normalize("NFKC", value).casefold().strip()
    while (cut := _COUNTER.sub("", text)) != text:
        text = cut
    text = re.sub(r"^[\W_]+|[\W_]+$", "", text)
    found = [squash(text), squash(_LEAD.sub("", text))]
    found += [f[:-1] for f in found if len(f) > 3 and f.endswith("s")]
    return list(dict.fromkeys(f for f in found if f))


def allowed(length: int) -> int:
    """Edits a name of this many characters may have."""
    return 1 if length < 5 else 2


def remains(word: str, edits: int) -> set[str]:
    """The word without up to ``edits`` of its characters."""
    cuts = [word[:i] + word[i + 1 :] for i in range(len(word))]
    out = {word, *cuts} if edits else {word}
    if edits == 2:
        # the second character to go stands behind the first
        out.update(cut[:j] + cut[j + 1 :] for i, cut in enumerate(cuts) for j in range(i, len(cut)))
    return out


def typo_cost(name: str, typed: str, bound: float = 99.0) -> float:
    """Weighted Damerau-Levenshtein distance from a name to what was typed.

    Unit edits cost 1; a doubled or undoubled letter 0.6, neighbouring keys 0.8 and
    a swap 0.8, also of letters that came apart since.
    """
    n, m = len(name), len(typed)
    if abs(n - m) > bound / 0.6:
        return math.inf
    rows = [[float(j) for j in range(m + 1)]]
    last_row: dict[str, int] = {}
    for i in range(1, n + 1):
        a = name[i - 1]
        above, row, last_column = rows[-1], [float(i)], 0
        for j in range(1, m + 1):
            b = typed[j - 1]
            gone = 0.6 if i > 1 and name[i - 2] == a else 1.0
            extra = 0.6 if j > 1 and typed[j - 2] == b else 1.0
            other = 0.0 if a == b else 0.8 if (a, b) in _NEAR else 1.0
            best = min(above[j] + gone, row[j - 1] + extra, above[j - 1] + other)
            k = last_row.get(b, 0)
            if k and last_column and a != b:
                best = min(best, rows[k - 1][last_column - 1] + 0.8 + (i - k - 1) + (j - last_column - 1))
            if a == b:
                last_column = j
            row.append(best)
        last_row[a] = i
        rows.append(row)
    return rows[n][m]


def score(cost: float, frequency: int) -> float:
    """Less is better: typing cost against how often the entry is seen."""
    return cost - 0.03 * math.log1p(frequency)


class Lexicon:
    """Names of one kind with their entries, indexed by what remains after deletions.

    ``names``: (name, canonical, frequency of the canonical).
    """

    def __init__(self, names):
        self.entries = [(squash(name), canonical, frequency) for name, canonical, frequency in names if name and squash(name)]
        #: A longer value has no name within two edits.
        self.longest = max((len(name) for name, _, _ in self.entries), default=0) + 2
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, (name, _, _) in enumerate(self.entries):
            for rest in remains(name, allowed(len(name))):
                self.index[rest].append(k)
        self.find = lru_cache(maxsize=100_000)(self._find)

    def __getstate__(self):
        return {"entries": self.entries, "longest": self.longest, "index": self.index}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.find = lru_cache(maxsize=100_000)(self._find)

    def _find(self, value: str) -> str:
        best, said = math.inf, NONE
        for form in forms(value):
            if len(form) > self.longest:
                continue
            for k in {k for rest in remains(form, 2) for k in self.index.get(rest, ())}:
                name, canonical, frequency = self.entries[k]
                limit = allowed(len(name))
                cost = typo_cost(name, form, limit)
                if cost <= limit and (rank := (score(cost, frequency), canonical)) < (best, said):
                    best, said = rank
        return said


def vocabulary(vocab: DataFrame) -> DataFrame:
    """``kind, name, canonical``: each canonical with itself and its aliases as names; nulls left out."""
    return (
        vocab.select("kind", "canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
        .where("kind is not null and canonical is not null and name is not null")
        .distinct()
    )


def typed_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Types of both tables that have text: ``kind, row_key, value``."""
    both = nodes.select(F.lit("node").alias("kind"), F.col("node_key").alias("row_key"), F.col("type").alias("value")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("row_key"), F.col("type").alias("value"))
    )
    return both.where(has_text(F.col("value")))


def frequencies(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` with how often each canonical is typed exactly; the counts have at most one row an entry."""
    seen = rows.join(F.broadcast(names.select("kind", F.col("canonical").alias("value")).distinct()), ["kind", "value"], "left_semi")
    seen = seen.groupBy("kind", F.col("value").alias("canonical")).agg(F.count("*").alias("frequency"))
    return names.join(seen, ["kind", "canonical"], "left").fillna(0, ["frequency"])


def key_count(names: DataFrame) -> int:
    """At most how many keys the dictionary has: a name of n characters leaves 1 + n + n(n-1)/2 remains."""
    n = F.length("name").cast("double")
    return int(names.agg(F.sum(1 + n + n * (n - 1) / 2)).first()[0] or 0)


def map_values(rows: DataFrame, vocab: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """``rows`` (``kind``, ``value`` and others) with ``canonical`` and ``exact``.

    ``exact`` is true where the value is a canonical of its kind as stored. Null and
    blank values, and kinds without names, map to ``NONE``. Ties go to the smaller
    canonical. Aliases and letter case never make a value exact.
    """
    names = vocabulary(vocab)
    if key_count(names) > max_keys:
        return map_distinct(rows, names)
    spark = rows.sparkSession
    listed = defaultdict(list)
    for row in frequencies(rows, names).collect():  # at most max_keys rows
        listed[row.kind].append((row.name, row.canonical, row.frequency))
    shared = spark.sparkContext.broadcast({kind: Lexicon(sorted(entries)) for kind, entries in listed.items()})
    exact = {(kind, canonical) for kind, entries in listed.items() for _, canonical, _ in entries}
    known = spark.sparkContext.broadcast(exact)

    @F.pandas_udf("canonical string, exact boolean")
    def find(kind: pd.Series, value: pd.Series) -> pd.DataFrame:
        lexicons, canonicals = shared.value, known.value
        out = []
        for k, v in zip(kind, value, strict=True):
            if (k, v) in canonicals:
                out.append((v, True))
            else:
                out.append((lexicons[k].find(v) if v is not None and k in lexicons else NONE, False))
        return pd.DataFrame(out, columns=["canonical", "exact"])

    return rows.withColumn("found", find("kind", "value")).select(*rows.columns, "found.canonical", "found.exact")


def map_distinct(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The same by joins, for lists too large to broadcast."""
    names = names.select("kind", "canonical", "name")
    seen = rows.join(names.select("kind", F.col("canonical").alias("value")).distinct(), ["kind", "value"], "left_semi")
    seen = seen.groupBy("kind", F.col("value").alias("canonical")).agg(F.count("*").alias("frequency"))
    names = names.join(seen, ["kind", "canonical"], "left").fillna(0, ["frequency"])

    @F.pandas_udf("int")
    def squashed_length(name: pd.Series) -> pd.Series:
        return name.map(lambda n: len(squash(n)))

    # measured as ``Lexicon`` does
    longest = (names.agg(F.max(squashed_length("name"))).first()[0] or 0) + 2

    @F.pandas_udf("array<struct<form string, rest string>>")
    def of_name(name: pd.Series) -> pd.Series:
        return name.map(lambda n: [{"form": s, "rest": r} for s in [squash(n)] if s for r in sorted(remains(s, allowed(len(s))))])

    @F.pandas_udf("array<struct<form string, rest string>>")
    def of_value(value: pd.Series) -> pd.Series:
        return value.map(lambda v: [{"form": s, "rest": r} for s in forms(v or "") if len(s) <= longest for r in sorted(remains(s, 2))])

    @F.pandas_udf("double")
    def cost(name: pd.Series, form: pd.Series, frequency: pd.Series) -> pd.Series:
        def one(n, f, q):
            c = typo_cost(n, f, allowed(len(n)))
            return score(c, q) if c <= allowed(len(n)) else None

        return pd.Series([one(*x) for x in zip(name, form, frequency, strict=True)], dtype="float64")

    index = names.select("kind", "canonical", "frequency", F.explode(of_name("name")).alias("n")).select("kind", "canonical", "frequency", F.col("n.form").alias("name"), "n.rest")
    values = rows.select("kind", "value").where("value is not null").distinct()
    probes = values.select("kind", "value", F.explode(of_value("value")).alias("v")).select("kind", "value", "v.form", "v.rest")
    pairs = probes.join(index, ["kind", "rest"]).select("kind", "value", "form", "name", "canonical", "frequency").distinct()
    ranked = pairs.withColumn("rank", cost("name", "form", "frequency")).where("rank is not null")
    first = ranked.withColumn("k", F.row_number().over(Window.partitionBy("kind", "value").orderBy("rank", "canonical"))).where("k = 1")
    exact = names.select("kind", F.col("canonical").alias("value"), F.lit(True).alias("is_exact")).distinct()
    return (
        rows.join(first.select("kind", "value", F.col("canonical").alias("close")), ["kind", "value"], "left")
        .join(exact, ["kind", "value"], "left")
        .select(
            *rows.columns,
            F.when(F.col("is_exact"), F.col("value")).otherwise(F.coalesce("close", F.lit(NONE))).alias("canonical"),
            F.coalesce("is_exact", F.lit(False)).alias("exact"),
        )
    )
