import pytest

from weftwork.llm import names as nm
from weftwork.operators import components
from weftwork.session import written

VOCAB = [("node", "person", ["human"]), ("node", "organization", ["company"]), ("node", "location", []), ("node", "event", [])]


@pytest.mark.parametrize(
    "label,hint,kind,stem,contexts",
    [
        ("Katherine Nidgezafil", "person", "person", "nidgezafil", ("katherine",)),
        ("NIDGEZAFIL, Kate", "", "person", "nidgezafil", ("katherine",)),
        ("Prof. Dr. Freferick Natvotafut", "", "person", "natvotafut", ("frederick",)),
        ('Edward "Ted" Kimkrivogin (ret.)', "person", "person", "kimkrivogin", ("edward",)),
        ("Nidgezafil GD", "person", "person", "nidgezafil", ("g*",)),
        ("Rob. Gurludipet", "person", "person", "gurludipet", ("robert",)),
        ("The Harhemerit Optics Inc.", "organization", "firm", "harhemerit", ("optics",)),
        ("HARHEMERIT OPT. G.M.B.H.", "organization", "firm", "harhemerit", ("optics",)),
        ("Danstofumen Wtr Bd Co.", "", "firm", "danstofumen", ("water board",)),
        ("KudzavegolBreweries", "organization", "firm", "kudzavegol", ("breweries",)),
        ("Harhemerit Jewellers (formerly Harhemerit Bros)", "", "firm", "harhemerit", ("jewellers",)),
        ("Michael Koshonofen & Daughters GmbH", "organization", "firm+daughters", "koshonofen", ("michael",)),
        ("Koshonofen & Sons", "organization", "firm+sons", "koshonofen", ()),
        ("Ann Lee", "person", "person", "lee", ("ann",)),
        ("Lee, A.", "person", "person", "lee", ("a*",)),
        ("Robert King", "", "person", "king", ("robert",)),
        ("Bob Kim", "person", "person", "kim", ("robert",)),
        ("William James", "person", "person", "james", ("william",)),
        ("James, William", "person", "person", "james", ("william",)),
        ("Robert Roberts", "person", "person", "roberts", ("robert",)),
        ("Maria Gonzalez", "person", "person", "gonzalez", ("maria",)),
        ("Maria Garcia-Lopez", "person", "person", "garcia lopez", ("maria",)),
        ("Bo Li", "person", "person", "li", ("b*",)),
        ("Anna Lake", "person", "person", "lake", ("anna",)),
        ("Acme Optics", "organization", "firm", "acme", ("optics",)),
        ("Zorvath Toys", "organization", "firm", "zorvath", ("toys",)),
        ("Zorvath Bicycles Ltd", "organization", "firm", "zorvath", ("bicycles",)),
        ("Phharmaceuticalss Zorvath", "organization", "firm", "zorvath", ("pharmaceuticals",)),
        ("Studio 54 Foods", "organization", "firm", "studio 54", ("foods",)),
        ("The Very Long And Old Name Of Zorvath Optics Holdings Co Ltd", "organization", "firm", "very long old name zorvath", ("optics holdings",)),
        ("BAKPUGIGID", "organization", "firm", "bakpugigid", ()),
    ],
)
def test_readings(label, hint, kind, stem, contexts):
    assert nm.reading(label, hint) == (kind, stem, contexts)


@pytest.mark.parametrize("label", ["Morrugesot Bay", "Golstustumor", "Hulmal 100X", "4 June 2006", "shared training", "Seldrikrupon Fair 1990", "", "!!!", "x" * 5000])
def test_no_readings(label):
    assert nm.reading(label, "other") is None


SPELT = {
    "kate": ["Katherine Nidgezafil", "katherine nidgezafil", "Kate Nidgezafil", "Nidgezafil, Katherine", "Katherine Nidgzeafil", "Dr K. Nidgezafil"],
    "gwen": ["Gwendolyn Nidgezafil", "Gwen Nidgezafíl"],
    "optics": ["Harhemerit Optics Inc.", "Harhemerit Opt.", "harhemeri optics", "HARHEMERIT OPTICS INCORPORATED", "Optics, Harhemerit"],
    "jewel": ["Harhemerit Jewellers", "The Harhemerit Jewellers AG"],
    "family": ["Michael Koshonofen & Daughters GmbH", "Michael Koshonofen Daughters"],
    "founder": ["Michael Koshonofen", "Mike Koshonofen"],
    "short": ["Ann Lee", "Lee, Ann", "ANN LEE", "A. Lee"],
    "shorter": ["Bob Lee", "Robert Lee"],
    "unknown": ["Consuela Almodovar", "Consuella Almodovar", "Almodovar, Consuela", "Consuela Almodovr"],
    "toys": ["Zorvath Toys", "ZORVATH TOYS LTD", "Zorvat Toys", "zorvath toys"],
    "bicycles": ["Zorvath Bicycles", "Zorvath Bicycles Inc."],
    "long": ["The Very Long And Old Name Of Zorvath Optics Holdings Co Ltd", "Very Long & Old Name of Zorvath Optics Holdings"],
}
KIND = {"optics": "organization", "jewel": "Company", "family": "organization", "toys": "organization", "bicycles": "organization", "long": "organization"}


def tables(spark):
    rows = [(label, KIND.get(who, "person"), who) for who, labels in SPELT.items() for label in labels for _ in range(2)]
    rows += [("Nidgezafil Bay", "location", "-"), ("Harhemerit", "location", "-"), (None, "person", "-"), (" ", "person", "-"), ("Nidgezafil Fair 1990", None, "-")] * 2
    nodes = spark.createDataFrame(rows, "label string, type string, entity string")
    return nodes, spark.createDataFrame(VOCAB, "kind string, canonical string, aliases array<string>")


def test_entities(spark):
    members = nm.entities(*tables(spark))
    got = {frozenset((r.label_a, r.label_b)) for r in nm.variant_pairs(members).collect()}
    want = {frozenset((a, b)) for labels in SPELT.values() for a in labels for b in labels if a != b}
    assert got == want
    assert all(r.label_a.encode() < r.label_b.encode() for r in nm.variant_pairs(members).collect())
    best = {r.label: r.canonical for r in nm.canonical_spellings(members).collect()}
    assert best["Kate Nidgezafil"] == best["Katherine Nidgzeafil"]


def test_empty(spark):
    nodes, vocab = tables(spark)
    assert nm.entities(nodes.limit(0), vocab).count() == 0
    assert nm.entities(nodes.where("entity = '-'"), vocab).count() == 0


def test_learned_words(spark):
    """Words with many partners are contexts; their typos and beginnings are not; surnames are not."""
    stems = [f"{a}{b}{c}" for a in ("Kolt", "Ramp", "Visk") for b in ("or", "um") for c in ("ane", "olt", "isk", "umb")]
    rows = [(f"Consuela {x}", "person") for x in stems] + [(f"{x} Umbrellas Ltd", "organization") for x in stems]
    rows += [(f"Consuelo {x}", "person") for x in stems[:4]] + [(f"Cons {x}", "person") for x in stems[:7]] + [(f"{x} Umbrelas", "organization") for x in stems[:6]]
    rows += [("Consuela Smith", "person"), ("Some Place", "other")]
    lexicon = nm.learned(spark.createDataFrame(rows, "label string, hint string"))
    assert lexicon.learned == (("consuela",), ("umbrellas",))
    assert nm.reading("Koltorane, Cons", "person", lexicon) == ("person", "koltorane", ("cons*",))
    assert nm.reading("Koltorane Umbr.", "", lexicon) == ("firm", "koltorane", ("umbrellas",))
    assert nm.reading("Koltorane Umbr.", "") is None


def test_hot_surname_and_nulls(spark):
    """Many people of one surname stay apart; equal readings of many spellings are one."""
    given = [f"{a}{b}" for a in ("Bel", "Dor", "Fin", "Gor", "Hal") for b in ("abor", "ecut", "idum", "oveg", "uzil")]
    rows = [(f"{g} Smithson", "person") for g in given] + [(f"Smithson, {g}", "person") for g in given] + [(None, None), ("", "person"), ("\u200b", "person")]
    members = nm.entities(spark.createDataFrame(rows, "label string, type string"), tables(spark)[1])
    got = {frozenset((r.label_a, r.label_b)) for r in nm.variant_pairs(members).collect()}
    assert got == {frozenset((f"{g} Smithson", f"Smithson, {g}")) for g in given}


def test_pairs_of_an_entity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nm, "PAIR_BLOCK", 7)
    labels = [f"l{k:02}" for k in range(30)]
    members = spark.createDataFrame([(x, "hot", 1) for x in labels] + [("alone", "one", 5)], "label string, entity string, n bigint")
    got = [(r.label_a, r.label_b) for r in nm.variant_pairs(members).collect()]
    assert sorted(got) == [(a, b) for a in labels for b in labels if a < b]


def test_no_broadcast_of_what_grows(spark, monkeypatch):
    """Tables that grow with the input are not built in the memory of the driver, however small Spark takes them for."""
    plans = []

    def watched(df, name="result"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(nm, "written", watched)
    monkeypatch.setattr(components, "written", watched)
    members = nm.entities(*tables(spark))
    for result in (nm.variant_pairs(members), nm.canonical_spellings(members)):
        watched(result)
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
