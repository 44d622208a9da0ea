import random
import re

from weftwork.llm import leaks as lk

ITEM = "In 1494, the cobalt ledger of Rosvin's town overlooked an orchard, and nobody claimed the copper-lined reward.\nWho owned it?"
ITEMS = [(1, "Read this.\n" + ITEM, "x"), (2, "Read this.\nThe amber foundry of Filkigut catalogued thirteen aqueducts at the request of Bunfeb.\nWhy?", "x"), (3, None, "x"), (4, " ", "x"), (5, "one line only of four", "x")]
COLUMNS = "item_id bigint, text string, doc_id string"


def found(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    return {(r.doc_id, r.item_id): r for r in lk.leaks(docs, spark.createDataFrame(items, COLUMNS), **options).collect()}


PASSAGE = "In 1494, the cobalt ledger of Rosvin's town overlooked an orchard, and nobody claimed the copper-lined reward."


def test_disguises(spark):
    texts = [
        f"Hello. {PASSAGE} Bye.",
        "> " + PASSAGE.replace(" town", "\n> town").replace("copper-lined", "copper-\n> lined"),
        PASSAGE.upper().replace("'", "’").replace(" ", "  "),
        "<p>" + PASSAGE.replace("cobalt", "<b>cobalt</b>").replace("'", "&#39;").replace("orchard", "[i]orchard[/i]") + "</p>",
        "in 1494 the cobalt ledger of rosvins town overlooked an orchard and nobody claimed the copper lined reward",
        "the cobalt ledger of another man",
        "Read this.",
        None,
        "",
        "of Rosvin's towns overlooked an orchard, xin 1494 the cobalt ledger",
        "x" * 100_000 + " " + PASSAGE,
        "one line only of four",
        PASSAGE,
        PASSAGE.replace(" ledger", f' <span style="{"color " * 200}">ledger</span>').replace(" town", f" [url={'u' * 900}]town[/url]"),
        "<a " * 30_000 + PASSAGE,
        "[url=" * 30_000 + PASSAGE,
    ]
    got = found(spark, texts)
    assert {d for d, i in got if i == 1} == {0, 1, 2, 3, 4, 10, 12, 13, 14, 15}
    assert {d for d, i in got if i == 5} == {11}
    assert not [1 for _, i in got if i in (2, 3, 4)]
    for d in (0, 1, 2, 3, 10):
        r = got[d, 1]
        piece = re.sub(r"[^a-z0-9]", "", re.sub(r"<[^>]*>|\[/?i\]|&#39;", "", texts[d][r.start_at : r.end_at]).lower())
        assert piece == re.sub(r"[^a-z0-9]", "", PASSAGE.lower())


def test_blocks_give_the_same(spark):
    texts = [PASSAGE, ITEMS[1][1], "nothing"]
    assert set(found(spark, texts)) == set(found(spark, texts, block_chars=50)) == {(0, 1), (1, 2)}


def test_empty_and_repeated(spark):
    assert not found(spark, [], ITEMS)
    assert not found(spark, [PASSAGE], [])
    assert set(found(spark, [PASSAGE], ITEMS + ITEMS)) == {(0, 1)}


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20)), "") for i in range(6)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(30)]
        source = rng.choice(items)[1].split()
        a, n = rng.randrange(12), rng.randrange(3, 14)
        words[5:5] = source[a : a + n]
        texts.append(" ".join(words))
    want = set()
    for d, text in enumerate(texts):
        words = text.split()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for i, item, _ in items:
            its = item.split()
            covered = {p for k in range(len(its) - 4) if tuple(its[k : k + 5]) in runs for p in range(k, k + 5)}
            if len(covered) >= 0.4 * len(its):
                want.add((d, i))
    assert set(found(spark, texts, items)) == want and want
