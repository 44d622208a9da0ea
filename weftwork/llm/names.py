"""Variant spellings of the names of people and organisations.

Every distinct label is read as a person (given name and surname), as a firm (stem
and trade, or a family firm named after a person) or as neither. A reading has a
stem, the part that carries the identity, and a context, the given name or trade;
either may be misspelt, abbreviated, moved or missing. Which words are contexts is
learned from the labels: words that stand with many different partners. Tables of
given names, trades and titles are priors that help to read a label; a label whose type
says that it is a name is read by its form where they do not know its words.

Readings with a full context are profiles. A noisy channel attaches them: every profile
may be a variant of another, the prior of a candidate is how often it is written, the
likelihood falls with the typing errors, and the alternative, that it is a name of its
own, has the chance that a stranger comes as near, estimated from the stems of different
contexts, where close ones can only be strangers. Since the right form may be rarer than
its variants, each profile attaches to its candidate of maximum posterior and what hangs
together is an entity; its most frequent spelling is the canonical form. Candidates come from symmetric-delete indexes on stem and
context. Then each partial reading attaches to the entity of maximum posterior among
those its context allows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import has_text
from weftwork.llm import canonical
from weftwork.operators.components import connected_components
from weftwork.session import shuffled, written

#: Given names with their short and pet forms.
GIVEN = {
    "agatha": "aggie",
    "alexander": "alex sasha sandy xander alec",
    "andreas": "andy andi dre",
    "anthony": "tony ant",
    "benjamin": "ben benny benji",
    "catherine": "cathy cat",
    "charles": "chuck chas",
    "charlotte": "charlie lottie lotte lotty",
    "christopher": "chris kit topher",
    "daniel": "dan danny",
    "dorothea": "dot thea dottie dora dorry dolly",
    "edward": "ed ted eddie ned teddy",
    "elizabeth": "beth liz eliza betty lizzie bess lisa libby",
    "francesca": "fran chess frankie cesca franny",
    "frederick": "fred fritz freddy rick freddie",
    "gabriel": "gabe gab",
    "gwendolyn": "gwen wendy lyn",
    "henrietta": "hetty etta hettie",
    "hubert": "hub hugh bert hubie",
    "isabella": "izzy bella izzie isa bel",
    "james": "jim jamie jimmy jem",
    "josephine": "jo josie posy fina",
    "katherine": "kate kathy katie kat kitty kay",
    "leonard": "leo len lenny",
    "margaret": "maggie peggy meg madge greta marge daisy",
    "michael": "mike mick mickey mitch",
    "nicholas": "nick nicky klaus nico",
    "olivia": "liv livvy ollie",
    "patricia": "pat trish patty tricia patsy",
    "quentin": "quin quint",
    "richard": "dick rich rick ric ricky",
    "robert": "bob rob robbie bobby bert",
    "samuel": "sam sammy",
    "stephen": "steve stevie",
    "susanna": "sue susie sanna zanna",
    "theodore": "theo ted teddy",
    "thomas": "tom tommy",
    "ursula": "uschi ursel ulla",
    "victoria": "vicky tori vic vickie",
    "vincent": "vince vinny vin",
    "wilhelmina": "willa mina minnie billie wilma",
    "william": "bill will billy willy liam",
    "yolanda": "yoli yola",
    "zachary": "zach zack zac zak",
}
#: Words before or after a person's name that do not name the person.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame herr frau rev hon msc bsc ba ma mba phd md jr sr jun sen ii iii iv esq ret dipl ing".split())
#: Legal forms and their spellings.
LEGAL = frozenset("inc incorporated gmbh ltd limited corp corporation co company ag llc llp plc sa sas srl spa bv nv kg ohg ug se oy ab as pty".split())
#: Words around a firm's name that do not name the firm.
LOOSE = frozenset("the and group hq intl international formerly of".split())
#: Trades, as the words of a firm's name.
TRADES = (
    "aviation", "breweries", "chemicals", "dynamics", "engineering", "foods", "holdings", "instruments", "jewellers", "kinematics", "logistics",
    "maritime", "networks", "optics", "publishing", "robotics", "textiles", "university", "veterinary services", "water board",
    "bank", "insurance", "motors", "energy", "pharmaceuticals", "software", "media", "press", "museum", "institute", "hospital", "airlines",
    "steel", "mining", "construction", "furniture", "electronics", "ceramics", "shipping", "railways", "partners", "consulting",
)
#: Abbreviations that are no beginning or skeleton of their trade.
ABBREVIATIONS = {"uni": "university", "univ": "university", "eng": "engineering", "engrg": "engineering", "svcs": "services", "serv": "services", "hldgs": "holdings"}
#: Family words of firms.
FAMILY = {"sons": "sons", "son": "sons", "daughters": "daughters", "daughter": "daughters", "brothers": "brothers", "bros": "brothers", "sisters": "sisters"}
#: Words of other kinds of things, which no person's name holds.
OTHER = frozenset("bay valley heights fair flood regatta summit congress river lake street island".split())

#: Typing cost up to which two stems are compared: an edit. Names drawn at random come
#: within two edits of each other once a context has thousands of them, seldom within one.
EDIT = 1.0
#: What a unit of typing cost takes from the logarithm of the prior.
PENALTY = 6.0
#: Stems and contexts of fewer letters are compared exactly, since most short words have a neighbour.
MIN_TYPO = 5
#: Different partners that make a word a context, at least and as a share of the labels; the
#: share bounds the learned words, since a label gives a word at most one partner.
LEARN, LEARN_SHARE = 5, 1 / 20_000

_TRADE_WORDS = {w for t in TRADES for w in t.split()}
_SHORT = {}
for _name, _forms in GIVEN.items():
    for _form in _forms.split():
        _SHORT.setdefault(_form, []).append(_name)


_CAMEL = re.compile(r"(?<=[^\W\d_A-Z][^\W\d_A-Z])(?=[A-Z][a-z])")
_REMARK = re.compile(r"\([^)]*\)|\[[^\]]*\]|[\"“”„][^\"“”„]*[\"“”„]")
_INITIAL_DOT = re.compile(r"(?<![^\W_]{2})(?<=[^\W_])\.(?=[^\W_](?:\.|\b))")
_APOSTROPHE = re.compile(r"(?<=[^\W_])['’`](?=[^\W_])")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents; words run together in camel case come apart."""
    if text.isascii():
        return _CAMEL.sub(" ", text).lower()
    text = _CAMEL.sub(" ", unicodedata.normalize("NFKC", text))
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return plain.casefold().translate({0xF8: "o", 0x142: "l", 0xE6: "ae", 0x153: "oe", 0x111: "d", 0x131: "i"})


def tokens(label: str) -> list[str]:
    """Words of a name without remarks in brackets, pet names in quotes and dots within initials."""
    text = _REMARK.sub(" ", fold(label))
    if "." in text:
        text = _INITIAL_DOT.sub("", text)
    return _WORDS.findall(_APOSTROPHE.sub("", text))


def _skeleton_of(word: str, name: str) -> bool:
    """Whether a word is a name without its vowels and perhaps some consonants."""
    rest = iter(name)
    return len(name) > len(word) and name[0] == word[0] and not set(word[1:]) & set("aeiou") and all(c in rest for c in word)


class Words:
    """One list of context words, looked up exactly, by a typo and by a beginning."""

    def __init__(self, listed, learned=()):
        self.names = frozenset(listed) | frozenset(learned)
        self.index: dict[str, list[str]] = {}
        self.heads: dict[str, list[str]] = {}
        for name in sorted(self.names):
            for rest in canonical.remains(name, 2 if name in listed else 1):
                self.index.setdefault(rest, []).append(name)
            for k in range(2, min(7, len(name))):
                self.heads.setdefault(name[:k], []).append(name)
        self.initials: dict[str, list[str]] = {}
        for name in sorted(listed):
            self.initials.setdefault(name[0], []).append(name)
        self.longest = max(map(len, self.names), default=0)
        self.near = lru_cache(maxsize=200_000)(self._near)

    def _near(self, word: str, bound: float) -> str | None:
        """The name a word most likely is a typo of, within a typing cost."""
        if len(word) > self.longest + 2:
            return None  # no name lies within two edits
        close = {n for rest in canonical.remains(word, 2) for n in self.index.get(rest, ())}
        best = min(((canonical.typo_cost(n, word, bound), n) for n in close), default=(99.0, ""))
        return best[1] if best[0] <= bound else None


class Lexicon:
    """Given names and trade words, those of the tables and learned ones."""

    def __init__(self, given=(), trades=()):
        self.learned = (tuple(given), tuple(trades))
        self.given = Words(GIVEN, given)
        self.trades = Words(_TRADE_WORDS, trades)
        self.family = Words(("brothers", "daughters"))
        self.trade_words = lru_cache(maxsize=200_000)(self._trade_words)

    def __reduce__(self):
        return Lexicon, self.learned

    def given_names(self, word: str) -> tuple[str, ...]:
        """Given names a word may stand for; initials and stumps give a beginning and a star."""
        if word in self.given.names:
            return (word,)
        if word in _SHORT:
            return tuple(_SHORT[word])
        if len(word) <= 2:
            return (word[0] + "*",) if word.isalpha() else ()
        if len(word) <= 5 and word in self.given.heads:
            return (word + "*",)
        if len(word) >= 4 and (near := self.given.near(word, 1.0 if len(word) < 7 else 2.0)):
            return (near,)
        return ()

    def _trade_words(self, word: str) -> tuple[str, ...]:
        """Trade words a word may stand for: itself, a typo, a beginning or a skeleton of consonants."""
        if word in self.trades.names:
            return (word,)
        if word in ABBREVIATIONS:
            return (ABBREVIATIONS[word],)
        if len(word) >= 5 and (near := self.trades.near(word, 1.0 if len(word) < 7 else 2.0)):
            return (near,)
        if 2 <= len(word) <= 6 and word in self.trades.heads:
            return tuple(self.trades.heads[word])
        if 2 <= len(word) <= 8:
            return tuple(t for t in self.trades.initials.get(word[0], ()) if _skeleton_of(word, t))
        return ()

    def trade(self, words: list[str], sure: bool = False) -> tuple[str, ...]:
        """Contexts that the words may be, all of them used; unknown words stand for themselves if ``sure``."""
        read = [self.trade_words(w) or ((w,) if sure else ()) for w in words]
        if not words or not all(read):
            return ()
        if math.prod(map(len, read)) > 64:
            return ("*",)
        found = tuple(" ".join(parts) for parts in product(*read))
        return tuple(t for t in found if t in _TRADE_SET) or found


@lru_cache(maxsize=1)
def _plain() -> Lexicon:
    return Lexicon()


_TRADE_SET = frozenset(TRADES)


def _person(label: str, words: list[str], lexicon: Lexicon, sure: bool) -> tuple[str, tuple[str, ...]] | None:
    """(surname, possible given names): by the words known, else, if ``sure``, by the form of the label."""
    people = [w for w in words if w not in TITLES]
    surnames = [w for w in people if len(w) > 2 and not lexicon.given_names(w)]
    if len(surnames) == 1:
        firsts = [w for w in people if w != surnames[0]]
        if not firsts and sure:
            firsts = [w for w in words if w in TITLES and len(w) == 2]  # initials that look like a title
        full = [w for w in firsts if len(w) > 2]
        found = lexicon.given_names(full[0] if full else firsts[0]) if firsts else ()
        return (surnames[0], found) if found or not firsts else None
    if not sure:
        return None
    people = people or words
    before, comma, behind = label.partition(",")
    last = [w for w in tokens(before) if w in people] if comma else []
    if last and any(w in people for w in tokens(behind)):
        firsts = [w for w in people if w not in last]
    else:
        full = [w for w in people if len(w) > 2] or people
        given = next((w for w in full[:-1] if w in lexicon.given.names or w in _SHORT), full[0]) if len(full) > 1 else ""
        last = list(full)
        if given:
            last.remove(given)
        firsts = [given] if given else [w for w in people if w not in full]
    if not firsts:
        return " ".join(last), ()
    first = next((w for w in firsts if len(w) > 2), firsts[0])
    return " ".join(last), lexicon.given_names(first) or (first,)


def _firm(words: list[str], lexicon: Lexicon) -> tuple[str, tuple[str, ...]]:
    """(stem, possible trades) of what is known to be a firm, by the form of its name."""
    rest = [w for w in words if w not in LEGAL and w not in LOOSE and w not in FAMILY] or words
    stem = [w for w in rest if not lexicon.trade_words(w)]
    if len(stem) == len(rest) or not stem:
        stem = rest[:1]
    others = list(rest)
    for w in stem:
        others.remove(w)
    return " ".join(stem), lexicon.trade(others, sure=True)


def reading(label: str, hint: str = "", lexicon: Lexicon | None = None) -> tuple[str, str, tuple[str, ...]] | None:
    """(kind, stem, possible contexts) of a label, or None if it names no person or firm.

    ``hint`` is what the types of its rows say most: ``person``, ``organization``,
    ``other`` or nothing; with one of the first two every label with a letter or digit
    has a reading. Kinds are ``person``, ``firm`` and, for a family firm, ``firm+`` with
    its family word. A context with a star is a beginning; none at all means any.
    """
    lexicon = lexicon or _plain()
    words = tokens(label)
    human, firm = hint == "person", hint == "organization"
    if not words or (not human and not firm and any(w.isdigit() or w in OTHER for w in words)):
        return None
    if not human:
        family = next((FAMILY[w] for w in words if w in FAMILY), "")
        rest = [w for w in words if w not in LEGAL and w not in LOOSE and w not in FAMILY]
        if not family:
            for w in rest:
                if len(w) >= 6 and (near := lexicon.family.near(w, 1.7)):
                    family = near
                    rest.remove(w)
                    break
        known = [w for w in rest if w in lexicon.given.names or w in _SHORT or w in TITLES]
        if family and (found := _person("", rest, lexicon, firm) if rest else None):
            return f"firm+{family}", found[0], found[1]
        stems = [w for w in rest if w not in lexicon.trades.names and w not in known]
        for stem in sorted(stems, key=lambda w: (bool(lexicon.trade_words(w)), -len(w))):
            others = list(rest)
            others.remove(stem)
            if all(w in known for w in others):
                break  # a person, or a name alone
            if found := lexicon.trade(others):
                return "firm", stem, found
        if firm:
            return ("firm", *_firm(words, lexicon))
    found = _person(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", label), words, lexicon, human)
    return ("person", *found) if found and (human or found[1]) else None


def labels(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """``label, n, hint``: distinct labels with their rows and what their types say most.

    Types are mapped by ``vocab`` (as in ``canonical``); null and unknown types say
    nothing. Ties go to the person, then to the organisation.
    """
    typed = nodes.select("label", "type").where(has_text(F.col("label"))).groupBy("label", "type").agg(F.count("*").alias("n"))
    mapped = canonical.map_values(typed.select("label", "n", F.lit("node").alias("kind"), F.col("type").alias("value")), vocab)
    said = F.col("canonical")
    votes = mapped.groupBy("label").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.when(said == kind, F.col("n")).otherwise(0)).alias(kind) for kind in ("person", "organization")),
        F.sum(F.when(said.isin("person", "organization", canonical.NONE), 0).otherwise(F.col("n"))).alias("other"),
    )
    most = F.greatest("person", "organization", "other")
    hint = F.when(most == 0, "").when(F.col("person") == most, "person").when(F.col("organization") == most, "organization").otherwise("other")
    return votes.select("label", "n", hint.alias("hint"))


_READING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("contexts", T.ArrayType(T.StringType()))])


def _roles(label: str, hint: str) -> list[tuple[str, str, bool]]:
    """(word, partner, whether the word stands where contexts do) of a name."""
    words = [w for w in tokens(label) if len(w) > 1]
    if hint == "person":
        words = [w for w in words if w not in TITLES]
        before, comma, _ = label.partition(",")
        if comma:
            words = [w for w in words if w not in tokens(before)] + [w for w in words if w in tokens(before)]
        return [(words[0], words[-1], True), (words[-1], words[0], False)] if len(words) > 1 else []
    words = [w for w in words if w not in LEGAL and w not in LOOSE and w not in FAMILY]
    return [(words[0], words[-1], False), *((w, words[0], True) for w in words[1:])] if len(words) > 1 else []


_ROLE = T.StructType([T.StructField("word", T.StringType()), T.StructField("partner", T.StringType()), T.StructField("context", T.BooleanType())])


@F.pandas_udf(T.ArrayType(_ROLE))
def _role_column(label: pd.Series, hint: pd.Series) -> pd.Series:
    return pd.Series([[{"word": w, "partner": p, "context": c} for w, p, c in _roles(x, h)] for x, h in zip(label, hint, strict=True)], dtype=object)


def learned(spelt: DataFrame, least: int = LEARN, share: float = LEARN_SHARE) -> Lexicon:
    """Context words of ``spelt`` (``label, hint``): words with many different partners, mostly where contexts stand.

    A word that is a beginning or a typo of one with three times the partners is its
    variant and left out. At most (words a label) / ``share`` words reach the driver.
    """
    names = spelt.where("hint in ('person', 'organization')")
    total = names.count()
    rows = names.select("hint", F.explode(_role_column("label", "hint")).alias("r")).select("hint", "r.word", "r.partner", "r.context").distinct()
    counted = rows.groupBy("hint", "word").agg(F.count_if("context").alias("n"), F.count_if(~F.col("context")).alias("m"))
    found = counted.where((F.col("n") >= max(least, total * share)) & (F.col("n") > F.col("m"))).select("hint", "word", "n").collect()  # bounded by share
    plain, kept = _plain(), {"person": [], "organization": []}
    for hint, known in (("person", plain.given_names), ("organization", plain.trade_words)):
        ranked = sorted(((r.n, r.word) for r in found if r.hint == hint), key=lambda x: (-x[0], x[1]))
        near: dict[str, list[tuple[int, str]]] = {}
        for n, word in ranked:
            rests = canonical.remains(word, 1)
            variant = any(m >= 3 * n and (w.startswith(word) or (len(word) >= MIN_TYPO and canonical.typo_cost(w, word, EDIT) <= EDIT)) for x in rests | {word} for m, w in near.get(x, ()))
            if not variant and not known(word):
                kept[hint].append(word)
            for x in rests | {word[:k] for k in range(2, min(7, len(word)))}:
                near.setdefault(x, []).append((n, word))
    return Lexicon(sorted(kept["person"]), sorted(kept["organization"]))


@F.pandas_udf(T.DoubleType())
def _cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([canonical.typo_cost(x, y, EDIT) for x, y in zip(a, b, strict=True)], dtype="float64")


def _remains(word):
    """The word and, unless it is short, the word without each of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.explode(F.when(F.length(word) >= MIN_TYPO, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word)))


def _strangers(keys: DataFrame, close: DataFrame) -> dict[str, float]:
    """For each kind the logarithm of the odds that a close profile of the same context is a stranger.

    ``keys``: ``kind, context, stem, near``; ``close``: pairs of profiles with ``kind``.
    Stems that are close in different contexts are strangers; as many per pair of
    profiles are expected within a context. One row a kind reaches the driver.
    """
    alike = keys.select("kind", "stem", "near").distinct().groupBy("kind", "near").agg(F.count("*").alias("d")).where("d > 1")
    pairs = alike.groupBy("kind").agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("t"))
    contexts = keys.groupBy("kind").agg(F.count_distinct("context").alias("c"))
    within = close.groupBy("kind").agg(F.count("*").alias("w"))
    rows = within.join(contexts, "kind").join(pairs, "kind", "left").collect()
    out = {}
    for r in rows:
        strange = max((r.t or 0) - r.w, 0) / max(r.c - 1, 1)
        out[r.kind] = math.log((strange + 0.01) / (max(r.w - strange, 0) + 0.01))
    return out


def _odds(kind, odds: dict[str, float]):
    """The odds of ``_strangers`` as a column; at first sight strangers are rare."""
    first = math.log(0.01)
    if not odds:
        return F.lit(first)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))[kind], F.lit(first))


def entities(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """``label, entity, n``: every label that names a person or organisation, with its entity.

    Labels are compared as stored; null and blank ones are left out. Ties in the
    posterior go to the greater profile in byte order. A partial reading that no
    profile explains is its own entity together with equal partial readings.
    """
    spark = nodes.sparkSession
    spelt = written(labels(nodes, vocab), "labels")
    lexicon = spark.sparkContext.broadcast(learned(spelt))

    @F.pandas_udf(_READING)
    def read_label(label: pd.Series, hint: pd.Series) -> pd.DataFrame:
        found = [reading(x, h, lexicon.value) or (None, None, None) for x, h in zip(label, hint, strict=True)]
        return pd.DataFrame([(k, s, list(c) if c is not None else None) for k, s, c in found], columns=["kind", "stem", "contexts"])

    read = spelt.withColumn("r", read_label("label", "hint")).where("r.kind is not null")
    read = written(read.select("label", "n", "r.kind", "r.stem", "r.contexts"), "readings")
    full = (F.size("contexts") == 1) & ~F.coalesce(F.endswith(F.col("contexts")[0], F.lit("*")), F.lit(False))
    profile = F.concat_ws("|", "kind", "context", "stem")

    profiles = (
        read.where(full)
        .select("n", "kind", "stem", F.col("contexts")[0].alias("context"))
        .groupBy("kind", "context", "stem")
        .agg(F.sum("n").alias("n"))
        .withColumn("profile", profile)
    )
    profiles = written(profiles, "profiles")
    # candidates by stem within a context, and by context with the same stem; keys are hashes, the costs sort out what they mix up
    rests = profiles.select("kind", "context", "stem", "profile", _remains(F.col("stem")).alias("rest"))
    keys = written(rests.select("kind", "context", "profile", "stem", F.xxhash64("kind", "rest").alias("near"), F.xxhash64("kind", "context", "rest").alias("key")), "keys")
    said = profiles.select("profile", "kind", "context", "stem", "n")

    def candidates(mine):
        others = shuffled(mine.select("key", F.col("profile").alias("c_profile")))
        pairs = mine.select("key", "profile").join(others, "key").where("profile <> c_profile").select("profile", "c_profile").distinct()
        theirs = said.select(F.col("profile").alias("c_profile"), F.col("context").alias("c_context"), F.col("stem").alias("c_stem"), F.col("n").alias("c_n"))
        return pairs.join(shuffled(said), "profile").join(shuffled(theirs), "c_profile")

    by_stem = candidates(keys).where("context = c_context").withColumn("cost", _cost("c_stem", "stem")).where(F.col("cost") <= EDIT)
    by_context = candidates(profiles.withColumn("rest", _remains(F.col("context"))).withColumn("key", F.xxhash64("kind", "stem", "rest")))
    # a context one whole edit away is another name, unless it is long and begins alike
    alike = (F.length("context") >= 7) & (F.substring("context", 1, 1) == F.substring("c_context", 1, 1))
    by_context = by_context.where("stem = c_stem").withColumn("cost", _cost("c_context", "context")).where((F.col("cost") < EDIT) | ((F.col("cost") <= EDIT) & alike))
    close = written(by_stem.unionByName(by_context).select("kind", "profile", "n", "c_profile", "c_n", "cost"), "close")
    odds = _odds(F.col("kind"), _strangers(keys, close))
    posterior = F.log(F.col("c_n") / (F.col("c_n") + 1)) + PENALTY * (EDIT - F.col("cost"))
    links = close.where(posterior > odds).groupBy("profile").agg(F.max_by("c_profile", F.struct(F.log("c_n") - PENALTY * F.col("cost"), "c_profile")).alias("c_profile"))
    joined = connected_components(links.select(F.col("profile").alias("src"), F.col("c_profile").alias("dst")))
    named = profiles.join(shuffled(joined.select(F.col("vertex").alias("profile"), "component")), "profile", "left").select(
        "kind", "context", "stem", "n", F.coalesce("component", "profile").alias("entity")
    )
    named = written(named, "entities")

    whole = read.where(full).select("label", "n", "kind", "stem", F.col("contexts")[0].alias("context")).join(shuffled(named.drop("n")), ["kind", "context", "stem"])

    # partial readings: one for each kind, stem and set of contexts
    partial = read.where(~full).select("kind", "stem", "contexts").distinct()
    wanted = F.explode(F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(F.array(F.lit("*"))))
    asked = partial.select("kind", "stem", "contexts", wanted.alias("wanted"))
    star = F.endswith(F.col("wanted"), F.lit("*"))
    asked = asked.select(
        "kind", "stem", "contexts", "wanted", F.when(star, F.regexp_replace("wanted", r"\*$", "")).alias("head"),
        F.when(star & (F.length("wanted") > 1), F.concat(F.substring("wanted", 1, 1), F.lit("*"))).otherwise(F.col("wanted")).alias("context"),
        _remains(F.col("stem")).alias("rest"),
    ).withColumn("key", F.xxhash64("kind", "context", "rest"))
    prior = named.groupBy("entity").agg(F.sum("n").alias("prior"))
    ways = F.array(F.col("context"), F.concat(F.substring("context", 1, 1), F.lit("*")), F.lit("*"))
    spelt_as = named.select("kind", F.col("context").alias("c_context"), F.explode(ways).alias("context"), F.col("stem").alias("c_stem"), "entity").distinct()
    offered = spelt_as.select("kind", "context", "c_context", "c_stem", "entity", _remains(F.col("c_stem")).alias("rest"))
    offered = offered.select(F.xxhash64("kind", "context", "rest").alias("key"), F.col("kind").alias("c_kind"), "c_context", "c_stem", "entity")
    fits = F.when(F.col("head").isNull(), F.col("c_context") == F.col("wanted")).otherwise(F.startswith(F.col("c_context"), F.col("head")))
    of_kind = F.col("kind") == F.col("c_kind")
    tries = asked.drop("context", "rest").join(shuffled(offered), "key").where(of_kind & fits).select("kind", "stem", "contexts", "c_stem", "entity").distinct()
    tries = tries.withColumn("cost", _cost("c_stem", "stem")).where(F.col("cost") <= EDIT).join(shuffled(prior), "entity")
    tries = tries.where((F.col("cost") == 0) | (PENALTY * (EDIT - F.col("cost")) > odds))
    posterior = F.log("prior") - PENALTY * F.col("cost")
    best = tries.groupBy("kind", "stem", "contexts").agg(F.max_by("entity", F.struct(posterior, "entity")).alias("entity"))
    alone = F.concat_ws("|", "kind", F.array_join("contexts", "/"), "stem", F.lit("?"))
    parts = read.where(~full).join(shuffled(best), ["kind", "stem", "contexts"], "left").select("label", F.coalesce("entity", alone).alias("entity"), "n")
    return written(whole.select("label", "entity", "n").unionByName(parts), "members")


#: Spellings of an entity that one task pairs with all of them.
PAIR_BLOCK = 500


def variant_pairs(members: DataFrame) -> DataFrame:
    """``label_a, label_b``: every pair of spellings of an entity, smaller one first.

    Spellings are distinct labels, so a pair occurs once, however often they are
    written. ``canonical_spellings`` says the same without pairs. An entity of many
    spellings is paired in blocks, so that no task pairs more than ``PAIR_BLOCK`` of
    them with all; single spellings do not reach the join.
    """
    sizes = members.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks"))
    rows = members.select("entity", "label").join(shuffled(sizes), "entity")
    left = rows.select("entity", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int").alias("block"), F.col("label").alias("label_a"))
    right = rows.select("entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("label").alias("label_b"))
    return left.join(shuffled(right), ["entity", "block"]).where("label_a < label_b").select("label_a", "label_b")


def canonical_spellings(members: DataFrame) -> DataFrame:
    """``label, canonical``: each spelling with the most frequent one of its entity, ties to the greater in byte order."""
    best = members.groupBy("entity").agg(F.max_by("label", F.struct("n", "label")).alias("canonical"))
    return members.join(shuffled(best), "entity").select("label", "canonical")
