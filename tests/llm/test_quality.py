import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftwork.llm import quality as q
from weftwork.llm.linestats import unrolled, word_hash

COMMON = frozenset("the a and is it i to of that was with on not my this".split())
PROSE = [
    "Nice tone arm!",
    "Got 22 minutes, expected 25. Works fine now. Checked spindle, extruder, even canoe hull, nothing helps.",
    "my patch cable is home made and i would rather keep it that way\nit took 8 euros until a friend noticed condensation",
    "<p>Anyone else seeing flickering light?</p>",
    "> quoted words of someone, who wrote them.\n>> and more of them.",
    "Met wat geduld kun je de kraan ook zelf repareren.",
    "Get 45 followers for your page within one night. See http://fagampzb.example/WJTTA for a free trial.",
    "ok",
    "",
    "Если бы я знал, я бы не спрашивал.",
]
OTHER = [
    "- washer\n- yeast x1\n- bee hive\n- bearing 608",
    "| yeast | 428.22 | 65416.6 |\n| washer | 76 | 8 |",
    "cork\t78.89\t53\nloom\t3\t9",
    "2024-01-10 00:10:07 [INFO] ch0 t=35 v=4.0\n2024-02-11 01:11:07 [WARN] ch1 t=3 v=9",
    "60808.98;14272.75;2.7;8.6\n-;ok;57168.8;n/a",
    "da 34 7f 8e ee d3 4f cd 1f 3b 58 dc\n81 4d 82 77 d8 37",
    "qnw3so9AI7rtLGD0RqY2Z9NJgO38wTIzVPeIDRbEuiPbqbB350ZangH7X2Ff3TUtNcdLyM0DSD8n6gyaDVz",
    "http://uvujht.example/manx/8739\nhttp://xchbec.example/eysa/47",
    "bp dzglpksn jxvdxutll zopzdw hshdnh vqx zzlixjt yid ynlxnuh kcccazzh",
    "free! " * 30,
    "cheap\n" * 30,
    "</div><span style=\"\">[/quote]<br>%20&nbsp;</div></div>",
    "🔥 ❤️ 😂 !!! 💥 🔥 🔥",
    "FS: inner tube; wobbly extruder x3; CD-179 rev B; spare fuse; washer",
    "<ul><li>nozzle x2</li><li>die Kette x5</li><li>bee hive</li></ul>",
    "washer\nBN-17 rev B\nyeast x4\nbrand new loom\nset of cork",
]


def share(text):
    listed = np.array(sorted(word_hash(w) for w in COMMON), np.uint64)
    row = q.measured([text], listed)[0].iloc[0]
    return row["prose"], sum(row[c] for c in q.REASONS), bool(row["loose"])


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    prose, other, _ = share(text)
    assert other <= prose


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    prose, other, _ = share(text)
    assert other > prose


@given(st.lists(st.text(alphabet=st.sampled_from("aé 漢3.,;:|<>[]&-*\n\t…\r\ud800x/=") , max_size=40), max_size=6))
def test_batches_measure_as_single_texts(texts):
    listed = np.array(sorted(word_hash(w) for w in COMMON), np.uint64)
    together = q.measured([*texts, "the end"], listed)[0]
    for k, text in enumerate(texts):
        assert together.iloc[k].to_dict() == q.measured([text], listed)[0].iloc[0].to_dict()
        assert together.iloc[k][["prose", *q.REASONS]].sum() >= 0


def test_long_tags_are_markup():
    tag = f'<span style="{"x" * 900}">'
    assert unrolled(f"one {tag}two[url={'y' * 900}] three") == "one two three"


def test_loose():
    assert share("words that go on and on with no mark of any kind between them at all")[2]
    assert not share("words that go on, and on, with marks of any kind. Between them, here")[2] and not share("few words")[2]


def frames(spark, texts):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    words = spark.createDataFrame([("en", w, 1) for w in COMMON] + [(None, None, 1)], "lang string, word string, rank_no int")
    return docs, words


def test_rows(spark):
    texts = [*PROSE, *OTHER, None, "y" * 100_000 + "\n" + "z " * 50_000]
    docs, words = frames(spark, texts)
    rows = {r.doc_id: r for r in q.kinds_of_text(docs, words).collect()}
    assert len(rows) == len(texts) - 1
    found = {r.doc_id for r in q.not_prose(q.kinds_of_text(docs, words)).collect()}
    assert found.issuperset(range(len(PROSE), len(PROSE) + len(OTHER))) and not found & set(range(len(PROSE)))
    assert q.kinds_of_text(docs.limit(0), words).count() == 0


def test_statistics(spark):
    docs, words = frames(spark, ["The (cat) sat.\n- on it #1 ...\n\nx?", "", None, "   "])
    rows = {r.doc_id: r for r in q.rules(q.statistics(docs, words)).collect()}
    r = rows[0]
    assert (r.n_words, r.word_chars, r.n_alpha_words, r.n_symbols, r.n_lines, r.n_line_ends, r.n_bullets, r.n_common) == (9, 24, 6, 2, 3, 3, 1, 3)
    assert "few_words" in r.reasons and set(rows) == {0, 1, 3} and rows[1].n_words == 0


def test_many_common_words_are_an_error(spark):
    docs, _ = frames(spark, ["a"])
    words = spark.range(q.MAX_COMMON + 1).selectExpr("'en' AS lang", "concat('w', id) AS word", "1 AS rank_no")
    with pytest.raises(ValueError, match="short list"):
        q.kinds_of_text(docs, words)
    with pytest.raises(ValueError, match="short list"):
        q.statistics(docs, words)


def test_salad_and_its_copies(spark):
    """Neighbours that the punctuated texts do not know; a salad's own copies do not make them known."""
    rng = random.Random(3)
    letters = "abcdefghij"
    common = [a + b for a in letters for b in "aeiou"][:30]
    prose = [" ".join(rng.choice(common) for _ in range(40)) + f". Is it {a}{b}, or not? No, it is." for a in letters for b in letters]
    loose = [" ".join(prose[k].split(".")[0].split()[:20]) for k in range(5)]
    salad = " ".join("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40))
    copies = [f"{salad} {k}" if k % 2 else salad for k in range(160)]
    docs, words = frames(spark, prose + loose + copies)
    found = {r.doc_id for r in q.not_prose(q.kinds_of_text(docs, words)).collect()}
    assert found == set(range(len(prose) + len(loose), len(prose) + len(loose) + len(copies)))


def test_one_very_long_word_and_groups(spark, monkeypatch):
    monkeypatch.setattr(q, "TOGETHER", 50)
    texts = ["Nice tone arm!", "", "x" * 3_000_000, "a b " * 20_000, *PROSE, *OTHER]
    docs, words = frames(spark, texts)
    rows = {r.doc_id: r for r in q.kinds_of_text(docs, words).collect()}
    assert len(rows) == len(texts) and rows[2].other_kind == "encoded" and rows[3].other_kind == "repeats" and rows[0].n_other == 0
    assert rows[2].n_other == 3_000_000
