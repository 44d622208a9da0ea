"""Posts packed into containers of a fixed number of tokens.

Minimum bin slack on the histogram of lengths: the longest length that is left
opens a container, a bitset subset-sum over the lengths that are left finds the
fullest combination beside it, and the combination is taken as often as the counts
allow. A histogram has at most ``capacity`` rows, and every combination uses up a
length or more than halves one, so this part needs the same work for any number of
posts and runs on the driver. The posts get ranks within their length (counted in
salted groups, since one length may hold a large share), and rank and length give
the container.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.splitting import pieces
from weftwork.session import spread, written

CAPACITY = 2048
#: Fixed value: how the byte-level vocabularies of 50,000 tokens cut a text before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITEMS = "doc_id bigint, piece_no int, start_at int, end_at int, n_tokens int"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer of a file of ranks, as the ``tiktoken`` library reads them; once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_starts(text: str, tokens: list[int], model) -> np.ndarray:
    """For each token the character it begins in."""
    sizes = np.fromiter((len(model.decode_single_token_bytes(t)) for t in tokens), np.int64, len(tokens))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    begins = np.cumsum(widths) - widths
    return np.searchsorted(begins, np.cumsum(sizes) - sizes, side="right") - 1


def token_pieces(text: str, capacity: int, model) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text under the capacity, each counted by itself.

    A piece that takes more tokens alone than within the text is cut again with a
    smaller limit; a single character of more tokens than the capacity stays whole.
    """
    tokens = model.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    starts = token_starts(text, tokens, model)
    prefix = np.searchsorted(starts, np.arange(len(text) + 1), side="left")
    prefix[-1] = len(starts)
    limit = capacity
    while True:
        spans = [(a, b) for a, b, _ in pieces(text, limit, 0, prefix)]
        sizes = [len(model.encode_ordinary(text[a:b])) for a, b in spans]
        over = max(sizes) - capacity
        if over <= 0 or limit == 1:
            return [(a, b, n) for (a, b), n in zip(spans, sizes, strict=True)]
        limit = max(1, limit - over)


def token_items(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, start_at, end_at, n_tokens``: every post, or its pieces if it exceeds the capacity.

    ``path`` is the file of a public byte-level vocabulary that every executor can read.
    Null and empty texts are one item of no tokens. Special tokens' names in a text are
    ordinary text.
    """

    def measure(batches):
        model = tokenizer(path)
        for batch in batches:
            rows = [(doc_id, k, *piece) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for k, piece in enumerate(token_pieces(text or "", capacity, model))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_at", "end_at", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInPandas(measure, ITEMS)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths (descending) with the greatest sum up to ``room``.

    A bitset of reachable sums grows by doubled parts of each length's count; the
    bitsets before each part lead back from the best sum to the parts used.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for length in lengths:
        left = min(counts[length], room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & full:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] += take
            best -= length * take
    return dict(used)


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their multiplicity, how often) of the containers for a histogram of lengths."""
    counts = {length: n for length, n in histogram.items() if 0 < length <= capacity and n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        room = capacity - longest
        used = fullest([x for x in lengths[bisect.bisect_left(lengths, -room, key=lambda x: -x) :] if counts[x]], counts, room) if room else {}
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * times
        out.append((used, times))
        lengths = [x for x in lengths if counts[x]]
    return out


def containers(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``container_id``: containers from 0, none filled beyond the capacity.

    Items of no tokens go to container 0. An item beyond the capacity, which only
    an unsplittable character can be, gets a container of its own. Equal rows may
    swap places; no items give no rows.
    """
    spark = items.sparkSession
    items = written(items, "items")
    histogram = {r.n_tokens: r.n for r in items.where(F.col("n_tokens").between(1, capacity)).groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (first rank, first container, multiplicity)
    used: dict[int, int] = defaultdict(int)
    number = 0
    for combination, times in combinations(histogram, capacity):
        for length, n in combination.items():
            slots[length].append((used[length], number, n))
            used[length] += n * times
        number += times
    shared = spark.sparkContext.broadcast({length: tuple(map(np.array, zip(*rows, strict=True))) for length, rows in slots.items()})
    after = number

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int")
    long = F.when(F.col("n_tokens") > capacity, capacity + 1).otherwise(F.col("n_tokens"))
    salted = items.withColumns({"size": long, "salt": salt})
    sizes = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("size", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece_no", "start_at", "n_tokens")) - 1
    ranked = salted.withColumn("own", own).join(offsets, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("own"))

    @F.pandas_udf("bigint")
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        sizes, ranks, table = size.to_numpy(), rank.to_numpy(), shared.value
        for length in np.unique(sizes):
            mine = sizes == length
            if length == capacity + 1:
                out[mine] = after + ranks[mine]
            elif length > 0:
                first, container, n = table[int(length)]
                k = np.searchsorted(first, ranks[mine], side="right") - 1
                out[mine] = container[k] + (ranks[mine] - first[k]) // n[k]
        return pd.Series(out)

    return ranked.withColumn("container_id", place("size", "rank")).select(*items.columns, "container_id")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container_id, n_items, n_tokens, unused``: how full each container is."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), (capacity - F.sum("n_tokens")).alias("unused"))
