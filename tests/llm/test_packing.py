import itertools
import random

import pytest

from weftwork.llm import packing as pk
from weftwork.llm.queries import TOKENIZER


def test_fullest_is_the_best_subset():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(1, 60)
        used = pk.fullest(sorted(counts, reverse=True), counts, room)
        best = max(
            s for s in (sum(n * x for n, x in zip(pick, counts, strict=True)) for pick in itertools.product(*(range(counts[x] + 1) for x in counts))) if s <= room
        )
        assert all(0 < n <= counts[x] for x, n in used.items())
        assert sum(n * x for x, n in used.items()) == best


def test_combinations_use_everything_once():
    rng = random.Random(10)
    for _ in range(40):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(rng.randrange(1, 30))}
        out = pk.combinations(histogram, 100)
        used = {}
        for combination, times in out:
            assert sum(x * n for x, n in combination.items()) <= 100 and times > 0
            for x, n in combination.items():
                used[x] = used.get(x, 0) + n * times
        assert used == histogram
        total = sum(x * n for x, n in histogram.items())
        assert sum(t for _, t in out) >= -(-total // 100)


def test_containers(spark):
    rng = random.Random(11)
    rows = [(d, 0, 0, 1, rng.choice([20, 20, 20, rng.randrange(0, 81), 170])) for d in range(2000)] + [(5, 0, 0, 1, 20)] * 3
    items = spark.createDataFrame(rows, pk.ITEMS)
    packed = pk.containers(items, 100).collect()
    assert len(packed) == len(rows)
    fill = {}
    for r in packed:
        fill.setdefault(r.container_id, []).append(r.n_tokens)
    assert all(sum(v) <= 100 or len(v) == 1 for v in fill.values())
    assert sorted(fill) == list(range(len(fill)))
    small = sum(n for *_, n in rows if n <= 100)
    assert sum(1 for v in fill.values() if v[0] <= 100) <= -(-small // 100) * 1.05 + 1
    assert pk.containers(items.limit(0), 100).count() == 0


@pytest.mark.parametrize("capacity", [16, 64])
def test_items_round_trip(spark, capacity):
    texts = ["short", "", None, "word " * 300, "\U0001f469‍\U0001f467" * 40, "x" * 2000, "<|endoftext|> a", "Grüße, 你好。" * 50, "y" * 200_000, " " * 200_000, "\n\n" * 50_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    rows = pk.token_items(docs, TOKENIZER, capacity).collect()
    model = pk.tokenizer(TOKENIZER)
    for k, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece_no)
        assert "".join((text or "")[r.start_at : r.end_at] for r in mine) == (text or "")
        for r in mine:
            assert r.n_tokens == len(model.encode_ordinary((text or "")[r.start_at : r.end_at]))
            assert r.n_tokens <= capacity or r.end_at - r.start_at == 1
    assert [r.n_tokens for r in rows if r.doc_id == 6][0] > 2


def test_token_starts():
    model = pk.tokenizer(TOKENIZER)
    for text in ("plain words", "Grüße 你好 \U0001f469‍\U0001f467!", "é" * 30, ""):
        tokens = model.encode_ordinary(text)
        starts = pk.token_starts(text, tokens, model).tolist()
        assert starts == sorted(starts) and (not text or starts[0] == 0)
        assert starts == model.decode_with_offsets(tokens)[1] if text else starts == []
