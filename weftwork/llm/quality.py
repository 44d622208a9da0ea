"""Per-document text statistics and the rules that tell prose from the rest.

``statistics`` computes counts in the JVM: words, letters of words, symbols, lines,
lines that end in punctuation, bullets, common words. ``rules`` applies fixed
thresholds to them, those published for web corpora, and records every rule that
fails.

Posts mix prose with other things and are often shorter than those thresholds
suppose, so ``kinds_of_text`` takes the same statistics of every line (``linestats``,
vectorised over a batch) and applies fixed thresholds to lines, ``LINE_RULES``, and to
whole texts. The characters of lines that fail are summed by rule, and a text whose
failing characters outweigh the rest is no prose; the rules that failed are recorded.
Words that form no sentences show in no count of a single text. Texts with hardly a
mark between their words are therefore measured by the share of their neighbouring
words that also stand side by side in enough of the punctuated texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.linestats import line_table, word_hash
from weftwork.session import fresh_folder, spread

#: Thresholds of the published rules, as (reason, SQL condition of failure).
#: Word count, mean word length, symbols to words, bullets, words with a letter and stop
#: words are those of Rae et al. 2021; the share of punctuated lines is that of Raffel et al. 2020.
RULES = (
    ("few_words", "n_words < 50"),
    ("many_words", "n_words > 100000"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("bullets", "10 * n_bullets > 9 * n_lines"),
    ("few_letters", "10 * n_alpha_words < 8 * n_words"),
    ("few_common_words", "n_common < 2"),
    ("few_line_ends", "10 * n_line_ends < n_lines"),
)
#: What counts as the end of a sentence at the end of a line, and as a bullet.
LINE_END = r"[.!?…。！？][\"'”’)»]*\s*$"
BULLET = r"^\s*(?:[-*•·▪+–]|\d{1,3}[.)]|\[[ xX*]?\])\s"

COUNTS = ("n_words", "word_chars", "n_alpha_words", "n_symbols", "n_lines", "n_line_ends", "n_bullets", "n_common")


#: Rows up to which a list of common words is a short one.
MAX_COMMON = 10_000


def listed_words(common_words: DataFrame) -> list[str]:
    """The common words in lower case; a list longer than ``MAX_COMMON`` is an error, never cut."""
    found = common_words.select("word").where("word is not null").distinct().limit(MAX_COMMON + 1).collect()
    if len(found) > MAX_COMMON:
        raise ValueError(f"common_words must be a short list, of at most {MAX_COMMON} words")
    return sorted({r.word.lower() for r in found})


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and the counts of ``COUNTS``, all bigint.

    Words are what stands between blanks; symbols are ``#`` and ellipses; a common
    word is one of the list in any language, without punctuation around it, in lower
    case. Null texts give no row; empty texts give zeros. The list is a fixed table
    of a few hundred words; it becomes a literal of the plan.
    """
    listed = listed_words(common_words)
    is_common = F.create_map(*(x for w in listed for x in (F.lit(w), F.lit(True)))) if listed else None
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"\S"))

    def count(items: Column, test) -> Column:
        return F.size(F.filter(items, test)).cast("bigint")

    bare = F.transform("words", lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return (
        spread(documents.select("doc_id", "text").where("text is not null"))
        .withColumns({"words": words, "lines": lines})
        .withColumn("bare", bare)
        .select(
            "doc_id",
            F.length("text").cast("bigint").alias("n_chars"),
            F.size("words").cast("bigint").alias("n_words"),
            F.coalesce(F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)), F.lit(0)).alias("word_chars"),
            count(F.col("words"), lambda w: w.rlike(r"\p{L}")).alias("n_alpha_words"),
            (F.regexp_count("text", F.lit("#")) + F.regexp_count("text", F.lit(r"\.\.\.|…"))).cast("bigint").alias("n_symbols"),
            F.size("lines").cast("bigint").alias("n_lines"),
            count(F.col("lines"), lambda x: x.rlike(LINE_END)).alias("n_line_ends"),
            count(F.col("lines"), lambda x: x.rlike(BULLET)).alias("n_bullets"),
            (count(F.col("bare"), lambda w: is_common[w].isNotNull()) if listed else F.lit(0).cast("bigint")).alias("n_common"),
        )
    )


def rules(stats: DataFrame) -> DataFrame:
    """``stats`` with ``reasons``, the failed rules in the order of ``RULES`` joined by commas ('' if none)."""
    return stats.withColumn("reasons", F.concat_ws(",", *(F.when(F.expr(test), F.lit(name)) for name, test in RULES)))


# --- kinds of lines -----------------------------------------------------------------

#: Thresholds on the statistics of a line (see ``linestats``), as (reason, condition
#: of failure); the first that fails names the line. Like the published ones they bound the
#: shares of letters, symbols, long words, bullets, line ends and common words.
LINE_RULES = (
    ("links", "(5 * url > 3 * visible) & (words < 4)"),
    ("log", "clock > 0"),
    ("figures", "(words == 0) & (digits > 0)"),
    ("symbols", "words == 0"),
    ("encoded", "(2 * long > solid) | ((tokens >= 4) & (5 * hex > 4 * tokens))"),
    ("table", "(cells >= 2) | ((cells == 1) & (digits > 0)) | (equals >= 2)"),
    ("table", "((fillers > 0) & (ends == 0) & (digits > 0)) | ((gaps > 0) & (stops == 0))"),
    ("figures", "(20 * digits > 7 * solid) & ~((ends == 1) & (common >= 2))"),
    ("figures", "(parts >= 2) & (fields >= 1) & (stops == 0) & (ends == 0)"),
    ("symbols", "2 * letters < solid"),
    ("symbols", "(4 * signs > solid) | ((5 * signs > solid) & (10 * common < words))"),
    ("noise", "(letters >= 12) & (5 * odd > 2 * letters)"),
    ("noise", "(ascii >= 25) & (ascii == letters) & (100 * vowels < 28 * ascii) & (10 * common < words)"),
    ("list", "(bullet == 1) & ~((stops > 0) & (words >= 4))"),
    ("list", "(parts >= 3) & (stops == 0) & (words <= 4 * (parts + 1)) & (5 * common < 2 * words)"),
    ("list", "(parts >= 3) & (stops == 0) & (5 * stock >= parts)"),
)
#: All reasons; the last three are those of whole texts.
REASONS = (*dict.fromkeys(name for name, _ in LINE_RULES), "repeats", "salad", "markup")
_CONDITIONS = [(name, compile(test, name, "eval")) for name, test in LINE_RULES]

#: A pair of words is known if this share of the texts holds it, and ``LEAST_DOCS`` do.
PAIR_SHARE = 1 / 1500
LEAST_DOCS = 3
#: Texts of fewer pairs are not asked whether their words form sentences; those where a
#: smaller share of the pairs is known do not form any.
LEAST_PAIRS = 11
KNOWN_SHARE = 0.3
#: Texts that know fewer pairs in all are too few to say what forms sentences.
ENOUGH_PAIRS = 200
#: Characters of the texts that are measured together, so that the arrays stay small; a longer text is measured alone.
TOGETHER = 400_000


def measured(texts: list[str], common: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(a row for each text, text of each pair, hash of each pair of neighbouring words).

    Rows hold ``prose`` and one column for each of ``REASONS`` with the visible
    characters that fail it, and ``loose``: enough words and hardly a mark between them.
    """
    lines, whole, pair_text, pairs = line_table(texts, common)
    n = len(texts)
    of = {c: lines[c].to_numpy() for c in lines}
    of["solid"] = of["visible"] - of["url"]
    text, visible = of["text"], of["visible"]
    free = visible > 0
    out = pd.DataFrame(0, index=range(n), columns=["prose", *REASONS], dtype="int64")
    for name, test in _CONDITIONS:
        hit = free & eval(test, {}, of)
        out[name] += np.bincount(text[hit], visible[hit], n).astype("int64")
        free &= ~hit
    out["prose"] = np.bincount(text[free], visible[free], n).astype("int64")

    def move(amount: np.ndarray, name: str) -> None:
        amount = np.minimum(out["prose"], amount.astype("int64"))
        out["prose"] -= amount
        out[name] += amount

    # short lines without an end are entries of a list where some carry an amount or a part number and few words are common
    short = free & (of["ends"] == 0) & (of["tokens"] <= 9)
    stock = (of["stock"] > 0) & (short | (~free & (visible > 0)))
    n_short, n_stock = np.bincount(text, short | stock, n), np.bincount(text, stock, n)
    few_common = 5 * np.bincount(text, np.where(short, of["common"], 0), n) <= 2 * np.bincount(text, np.where(short, of["words"], 0), n)
    entries = (n_short >= 4) & (10 * n_stock >= n_short) & few_common
    move(np.where(entries, np.bincount(text, np.where(short, visible, 0), n), 0), "list")
    move(np.where((whole["tokens"] >= 12) & (5 * whole["repeated"] > out["prose"]), whole["repeated"], 0), "repeats")
    rest = out.sum(axis=1)
    out["markup"] = np.where(whole["markup"] > 3 * rest, whole["markup"], 0)
    n_pairs = np.bincount(pair_text, minlength=n)
    out["loose"] = (n_pairs >= LEAST_PAIRS) & (25 * whole["inner"] < whole["words"])
    return out, pair_text, pairs


#: Pairs whose counts a task holds before it passes them on.
HELD_PAIRS = 500_000

_MEASURES = "what int, doc_id bigint, key bigint, pair bigint, n bigint, " + ", ".join(f"{c} bigint" for c in ("prose", *REASONS))
_TEXTS, _ASKED, _SEEN = range(3)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def measures(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One pass over the texts: rows of three kinds (``what``).

    ``_TEXTS``: a row for each text with its characters by rule, and ``key``, a hash of
    the text, if it is loose. ``_ASKED``: ``key, pair`` of the loose texts, equal texts
    of a batch once. ``_SEEN``: ``pair, n``, in how many of some other texts a pair
    stands, so that no loose text, however often copied, makes its own pairs known.
    """
    listed = np.array(sorted(word_hash(w) for w in listed_words(common_words)), np.uint64)
    names = [c.split()[0] for c in _MEASURES.split(", ")]

    def told(seen: dict[int, int]) -> pd.DataFrame:
        return pd.DataFrame({"what": _SEEN, "pair": list(seen), "n": list(seen.values())}).reindex(columns=names)

    def read(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            # texts are grouped by where the running sum of their lengths stands
            lengths = batch["text"].str.len().to_numpy()
            group = (np.cumsum(lengths) - 1) // TOGETHER
            for _, part in batch.groupby(np.maximum(group, 0), sort=False):
                texts = part["text"].tolist()
                rows, at, pairs = measured(texts, listed)
                loose = rows.pop("loose").to_numpy()
                key = pd.array([_key(t) if x else None for t, x in zip(texts, loose, strict=True)], dtype="Int64")
                yield rows.assign(what=_TEXTS, doc_id=part["doc_id"].to_numpy(), key=key, pair=pd.NA, n=pd.NA)[names]
                asked = pd.DataFrame({"key": key[at], "pair": pairs, "at": at})[loose[at]]
                first = asked.groupby("key")["at"].transform("min")
                asked = asked[asked["at"] == first]
                yield pd.DataFrame({"what": _ASKED, "key": asked["key"], "pair": asked["pair"]}).reindex(columns=names)
                # each pair once a text
                mine = ~loose[at]
                order = np.lexsort((pairs[mine], at[mine]))
                p, a = pairs[mine][order], at[mine][order]
                fresh = np.ones(len(p), bool)
                fresh[1:] = (p[1:] != p[:-1]) | (a[1:] != a[:-1])
                values, counts = np.unique(p[fresh], return_counts=True)
                for v, c in zip(values.tolist(), counts.tolist(), strict=True):
                    seen[v] = seen.get(v, 0) + c
                if len(seen) > HELD_PAIRS:
                    yield told(seen)
                    seen = {}
        yield told(seen)

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(read, _MEASURES)


def kinds_of_text(documents: DataFrame, common_words: DataFrame, share: float = PAIR_SHARE, least: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, n_prose, n_other, other_kind, reasons``: visible characters of prose and of anything else.

    ``other_kind`` is the rule most of the other characters fail ('' if none), ``reasons``
    all that fail, by commas. Null texts give no row; texts without visible characters
    give zeros. A text sent twice gives a row each time. Where the punctuated texts know
    fewer than ``ENOUGH_PAIRS`` pairs, no text fails for its pairs.
    """
    spark = documents.sparkSession
    path = fresh_folder(spark, "measures")
    measures(documents, common_words).write.partitionBy("what").parquet(path)
    rows = spark.read.schema(_MEASURES).parquet(path)
    texts = rows.where(F.col("what") == _TEXTS).select("doc_id", "key", "prose", *REASONS)
    total = texts.count()
    known = rows.where(F.col("what") == _SEEN).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, total * share)).select("pair", F.lit(1).alias("known"))
    if known.count() < ENOUGH_PAIRS:
        known = known.where("false")
        needed = 0.0
    else:
        needed = KNOWN_SHARE
    asked = rows.where(F.col("what") == _ASKED).groupBy("key", "pair").agg(F.count("*").alias("n"))
    odd = asked.join(known, "pair", "left").groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("known")).alias("k"))
    odd = odd.where(F.coalesce("k", F.lit(0)) < needed * F.col("n")).select("key", F.lit(True).alias("odd"))
    # texts without a key stay out of the join, where they would be one hot key
    plain = texts.where("key is null").withColumn("odd", F.lit(False))
    judged = texts.where("key is not null").join(odd, "key", "left").select(*plain.columns).unionByName(plain)
    moved = F.when(F.col("odd"), F.col("prose")).otherwise(0)
    judged = judged.withColumns({"salad": moved, "prose": F.col("prose") - moved})
    amounts = [F.col(c) for c in REASONS]
    main = F.array_max(F.array(*(F.struct(F.col(c).alias("n"), F.lit(c).alias("name")) for c in REASONS)))
    return judged.select(
        "doc_id", F.col("prose").alias("n_prose"), sum(amounts[1:], amounts[0]).alias("n_other"),
        F.when(main["n"] > 0, main["name"]).otherwise("").alias("other_kind"), F.concat_ws(",", *(F.when(F.col(c) > 0, c) for c in REASONS)).alias("reasons"),
    )


def not_prose(kinds: DataFrame) -> DataFrame:
    """Rows of ``kinds_of_text`` with more than half of the characters something other than prose."""
    return kinds.where("n_other > n_prose")
