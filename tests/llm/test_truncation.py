import random

from weftwork.llm import truncation as tr

BODY = '{"nodes": [{"id": "1", "label": "A, [x]}"}], "edges": [{"id": "e", "source": "1", "target": "1"}]}'
SAID = ["I hope this helps. Some were implied.", "Done :)", "Total: 4 nodes, 6 edges"]
REFUSAL = "I could not find any entities in this text."
WHOLE = [BODY, f"```json\n{BODY}\n```", "Sure! Here it is:\n" + BODY, BODY.replace("]}", ",]}"), BODY.replace('"', "'"), BODY.replace('"A, [x]}"', '"A'), REFUSAL, "null", '"no graph"', "[]", "{}", "[null]", "[true]"]
WHOLE += [f"{BODY}\n\n{s}" for s in SAID] + [f"```\n{BODY}\n```\n\n{s}" for s in SAID]
CUT = [BODY[:n] for n in (5, 30, 60, len(BODY) - 1, len(BODY) - 2)] + [BODY[:40] + m for m in ("…", "...", " [truncated]", "...[cut]", " [stopped]", "\n```", "�")] + [REFUSAL[:-9] + "...[cut]", f"{BODY}\n\n{SAID[0][:12]}…[cut]"]
CUT += [f"```json\n{BODY}", REFUSAL[:20], REFUSAL[:-1], "Sure! Here", f"{BODY}\n\n{SAID[0][:9]}", f"{BODY}\n\nTotal: 9 nodes, 3", f"```\n{BODY}\n```\n\nDo", "```json\n"]
COLUMNS = "graph_id bigint, attempt int, provider string, model string, raw string, state string, value string"


def judged(spark, raws):
    df = spark.createDataFrame([(k, 0, "p", "m" if k % 2 else None, r, "s", "v") for k, r in enumerate(raws)], COLUMNS)
    return df, {r.graph_id: r for r in tr.cut_replies(df).collect()}


def test_cases(spark):
    raws = [*WHOLE, *CUT, None]
    df, got = judged(spark, raws)
    for k, raw in enumerate(raws[:-1]):
        assert got[k].cut == (raw in CUT), raw
    assert len(raws) - 1 not in got
    report = tr.cut_report(tr.cut_replies(df)).collect()
    assert sum(r.n_cut for r in report) == len(CUT) and sum(r.n_replies for r in report) == len(raws) - 1


def test_repeats_and_empty(spark):
    _, got = judged(spark, [REFUSAL[:20]] * 3 + [REFUSAL] * 3)
    assert [got[k].cut for k in range(6)] == [True] * 3 + [False] * 3
    assert not judged(spark, [])[1]
    assert not judged(spark, ["", "   "])[1][0].cut


def test_prefix_join_against_brute_force(spark):
    rng = random.Random(8)
    values = [(rng.choice("kl"), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for _ in range(300)] + [("k", "z" * 50_000), ("k", "z" * 49_000), ("k", None), ("k", "")]
    import hashlib

    want = {(k, hashlib.md5(v.encode()).hexdigest()) for k, v in values if v and any(k == a and b and len(b) > len(v) and b.startswith(v) for a, b in values)}
    got = tr.prefixes_of_longer(spark.createDataFrame(values, "kind string, value string")).collect()
    assert {(r.kind, r.value_id) for r in got} == want
