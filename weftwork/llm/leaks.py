"""Evaluation texts inside training texts.

All runs of ``RUN`` words of the items form one Aho-Corasick automaton per block of
items. A post's text is reduced to its letters and digits, without markup, and read
once; hits must start and end at word borders. A hit marks its words of the item as
covered, and an item counts as leaked into a post once the marked share is reached.
Every normalised character knows its place in the original, so matches come with
offsets. The automaton holds at most ``block_chars`` characters of items and is built
once in a worker; more items are taken in blocks, each read against all posts.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import has_text, js_trim
from weftwork.session import spread

RUN = 5
SHARE = 0.4
#: Characters of items in one automaton; broadcast and build stay small below this.
BLOCK_CHARS = 8_000_000

#: Markup to drop, entities, apostrophes to drop, words.
_PIECE = re.compile(
    r"(?P<mark><[a-zA-Z/!][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|code|list|size|color|font|left|center|spoiler|\*)(?:=[^\[\]\n]*)?\])"
    r"|(?P<entity>&(?:amp;)*(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,31});)"
    r"|(?P<word>[^\W_]+(?:['’‘ʼ`´­​-‍⁠﻿]+[^\W_]+)*)",
    re.IGNORECASE,
)
_JOIN = frozenset("'’‘ʼ`´")


_HYPHENS = frozenset("-\u2010\u2011\u00ad")
#: A hyphen within a word, with a line break and quote marks behind it or without.
_HYPHEN = re.compile(r"[-\u2010\u2011\u00ad](?:[ \t]*\r?\n[ \t>|:*]*)?")


def normal_words(text: str) -> list[tuple[str, int, int, bool]]:
    """(normalised word, start, end, joined to the one before) in order.

    Words are joined where only an apostrophe entity, or a hyphen with any line
    break and quote marks after it, stands between them.
    """
    out: list[tuple[str, int, int, bool]] = []
    glue = False
    last = -1
    for m in _PIECE.finditer(text):
        start, end = m.span()
        between = text[last:start] if last >= 0 else ""
        if m.lastgroup == "mark":
            continue
        if m.lastgroup == "entity":
            char = html.unescape(html.unescape(m.group().replace("&amp;", "&")))
            if char in _JOIN and start == last:
                glue = True
                last = end
                continue
            if not (len(char) == 1 and char.isalnum()):
                continue
            word, joined = char, start == last
        else:
            word, joined = m.group(), glue and start == last
        joined = joined or (between[:1] in _HYPHENS and bool(_HYPHEN.fullmatch(between)))
        glue = False
        folded = word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).casefold()
        if not folded.isalnum():
            folded = "".join(filter(str.isalnum, folded))
        if folded:
            out.append((folded, start, end, joined))
            last = end
            # an accented letter written as an entity goes on into the next word
            glue = m.lastgroup == "entity"
    return out


def item_words(text: str) -> list[str]:
    """Words of an item, with hyphenated ones as one."""
    words: list[str] = []
    for word, _, _, joined in normal_words(text):
        if joined and words:
            words[-1] += word
        else:
            words.append(word)
    return words


class Leaks:
    """The automaton over one block of items: (item_id, text without instruction)."""

    def __init__(self, items, run: int = RUN, share: float = SHARE):
        self.share, self.run = share, run
        self.sizes, self.ids = [], []
        places = defaultdict(list)
        for item_id, text in items:
            words = item_words(text)
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            for i in range(max(1, len(words) - run + 1)):
                places["".join(words[i : i + run])].append((number, i, min(run, len(words))))
        self.automaton = ahocorasick.Automaton()
        for key, value in places.items():
            self.automaton.add_word(key, (len(key), value))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, words of the item, words covered, start, end) of each leaked item."""
        if not self.ids:
            return []
        words = normal_words(text)
        stream = "".join(w[0] for w in words)
        starts: dict[int, int] = {}
        ends: dict[int, int] = {}
        at = 0
        for word, start, end, _ in words:
            starts[at] = start
            at += len(word)
            ends[at] = end
        covered: dict[int, set[int]] = defaultdict(set)
        span: dict[int, list[int]] = {}
        for last, (length, places) in self.automaton.iter(stream):
            begin = starts.get(last + 1 - length)
            end = ends.get(last + 1)
            if begin is None or end is None:
                continue
            for number, first, n in places:
                covered[number].update(range(first, first + n))
                if number in span:
                    span[number] = [min(span[number][0], begin), max(span[number][1], end)]
                else:
                    span[number] = [begin, end]
        return [
            (self.ids[k], self.sizes[k], len(c), *span[k])
            for k, c in covered.items()
            if len(c) >= self.share * self.sizes[k] - 1e-9
        ]


#: The automaton this process built last, under the digest of its items, for the next tasks of a worker.
_BUILT: dict[str, Leaks] = {}


def _built(digest: str, items, run: int, share: float) -> Leaks:
    if digest not in _BUILT:
        _BUILT.clear()
        _BUILT[digest] = Leaks(items, run, share)
    return _BUILT[digest]


def without_instruction(items: DataFrame) -> DataFrame:
    """``item_id, text`` without a first line that items with different texts share.

    Null and blank texts are left out, repeated rows count once; an item of one
    line keeps it.
    """
    lines = items.select("item_id", "text").where(has_text(F.col("text")) & F.col("item_id").isNotNull()).distinct()
    lines = lines.withColumn("first", js_trim(F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))))
    shared = lines.groupBy("first").agg(F.countDistinct("text").alias("n")).where("n > 1").select("first", F.lit(True).alias("drop"))
    rest = F.expr("substring(text, instr(text, '\n') + 1)")
    return lines.join(shared, "first", "left").select(
        "item_id", F.when(F.col("drop") & F.contains("text", F.lit("\n")) & has_text(rest), rest).otherwise(F.col("text")).alias("text")
    )


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_words, n_covered, start_at, end_at``: posts with the items they hold.

    ``start_at`` and ``end_at`` are offsets in the post's text as stored, from the
    first to behind the last covered word. Null texts hold nothing. An item of
    fewer words than a run must occur whole.
    """
    spark = documents.sparkSession
    items = without_instruction(items)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    schema = "doc_id bigint, item_id bigint, n_words int, n_covered int, start_at int, end_at int"
    posts = spread(documents.select("doc_id", "text").where("text is not null"))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about block_chars characters
        listed = [(r.item_id, r.text) for r in mine]
        shared = spark.sparkContext.broadcast(listed)
        digest = hashlib.md5(repr((listed, run, share)).encode("utf-8", "surrogatepass")).hexdigest()

        def scan(batches, shared=shared, digest=digest):
            matcher = _built(digest, shared.value, run, share)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in matcher.find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_covered", "start_at", "end_at"])

        part = posts.mapInPandas(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_items(found: DataFrame) -> DataFrame:
    """``item_id, n_docs``: the leaked items with the number of posts that hold them."""
    return found.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"))
