"""Review sentiment from a lexicon table.

The rules are those published for lexicon scoring of short social texts (Hutto & Gilbert, 2014): the valence of
a word is raised or lowered by intensifiers among the three words before it, turned round by negators there,
strengthened by capitals, and weighted by its side of a "but". Only the sign of the sum decides the label, so
the final scaling and the emphasis of punctuation, which keep the sign, are left out. With a table of phrases, the rules
for runs of words hold too: idioms, boosters of two words, "least", "never so", "without doubt" and "no" before a word.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.steps import computed

# Fixed values of the published method.
BOOST = 0.293
BOOST_BY_DISTANCE = [1.0, 0.95, 0.9]
NEGATION = -0.74
CAPITALS = 0.733
BEFORE_BUT = 0.5
AFTER_BUT = 1.5

NEGATORS = [
    "not", "nor", "never", "none", "nope", "nothing", "nowhere", "neither", "cannot", "without",
    "rarely", "seldom", "despite", "aint", "arent", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neednt", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "wont", "wouldnt",
]
INTENSIFIERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "unusually",
    "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely",
    "slightly", "somewhat", "sorta",
]

# Fixed values of the published method: idioms with their valence, boosters of several words with what they add.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}
PHRASE_BOOSTERS = {"kind of": -0.293, "sort of": -0.293, "just enough": -0.293}
NEVER_SO = 1.25

#: a lexicon or phrase table of more rows is not taken for one
MOST_ROWS = 200_000
#: words of a phrase, at most
LONGEST_PHRASE = 3

# Fixed value: the ASCII punctuation that is cut off words.
PUNCTUATION = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def spoken_words(text: Column) -> Column:
    """Words between blanks without outer punctuation; what is then too short stays whole, as smileys do."""
    pieces = F.filter(F.split(text, r"\s+"), lambda piece: piece != "")

    def bare(piece: Column) -> Column:
        stripped = F.btrim(piece, F.lit(PUNCTUATION))
        return F.when(F.length(stripped) <= 2, piece).otherwise(stripped)

    return F.transform(pieces, bare)


def _shouted(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def published_phrases(spark: SparkSession) -> DataFrame:
    """phrase, kind (idiom or booster), value: the phrases of the published method."""
    rows = [(phrase, "idiom", value) for phrase, value in IDIOMS.items()] + [(phrase, "booster", value) for phrase, value in PHRASE_BOOSTERS.items()]
    return spark.createDataFrame(rows, "phrase string, kind string, value double")


def _few(table: DataFrame, *columns: str) -> list:
    """The rows of a word list, refused if it is no such list."""
    rows = table.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows in a word list")
    return rows


def _push(neighbour: Column, mixed: Column, weight: float, scored: list[str]) -> Column:
    """How far one of the words before pushes away from zero. Capitals do, also those of a dampener; words in `scored` do not."""
    word = F.lower(neighbour)
    loud = F.when(mixed & _shouted(neighbour), F.lit(CAPITALS)).otherwise(F.lit(0.0))
    stronger, weaker = ([w for w in words if w not in scored] for words in (INTENSIFIERS, DAMPENERS))
    return F.when(word.isin(stronger), loud + BOOST).when(word.isin(weaker), loud - BOOST).otherwise(F.lit(0.0)) * weight


def _negates(neighbour: Column, scored: list[str]) -> Column:
    """Whether one of the words before is a negator that the lexicon does not score itself."""
    word = F.lower(neighbour)
    return word.isin([w for w in NEGATORS if w not in scored]) | (word.contains("n't") & ~word.isin([w for w in scored if "n't" in w]))


class _Phrases:
    """The rules for runs of words, as steps on the valence of a word; near: the words w3, w2, w1, w0, n1, n2 in lower case."""

    def __init__(self, phrases: DataFrame, tokens: list[str]):
        found: dict[str, dict[str, float]] = {"idiom": {}, "booster": {}}
        for r in _few(phrases, "phrase", "kind", "value"):
            if len(r["phrase"].split(" ")) > LONGEST_PHRASE:
                raise ValueError(f"a phrase of more than {LONGEST_PHRASE} words: {r['phrase']}")
            found[r["kind"]][r["phrase"].lower()] = float(r["value"])
        self.found, self.tokens = found, tokens
        self.low = {name: F.lower(F.coalesce(f"near.{name}", F.lit(""))) for name in ("w0", "w1", "w2", "w3", "n1", "n2")}

    def said(self, kind: str, *names: str) -> Column:
        """What the run of these words is worth, null if it is no phrase."""
        if not self.found[kind]:
            return F.lit(None).cast("double")
        table = F.create_map(*[F.lit(x) for pair in self.found[kind].items() for x in pair])
        return F.element_at(table, F.concat_ws(" ", *[self.low[name] for name in names]))

    def start(self, valence: Column) -> Column:
        low = self.low
        refused = (low["w1"] == "no") | (low["w2"] == "no") | ((low["w3"] == "no") & low["w1"].isin("or", "nor"))
        return F.when(refused, valence * NEGATION).when((low["w0"] == "no") & low["n1"].isin(self.tokens), 0.0).otherwise(valence)

    def turn(self, distance: int, plain: Column) -> Column:
        """The factor of a neighbour, where `plain` is that of a word alone."""
        if distance == 1:
            return plain
        far, nearer = self.low[f"w{distance}"], [self.low[f"w{d}"] for d in range(distance - 1, 0, -1)]
        one_is = lambda *words: reduce(or_, [w.isin(*words) for w in nearer])
        return F.when((far == "never") & one_is("so", "this"), NEVER_SO).when((far == "without") & one_is("doubt"), 1.0).otherwise(plain)

    def end(self, valence: Column) -> Column:
        """After the third word before, if there is one that the lexicon does not score: idioms, then boosters."""
        runs = [("w1", "w0"), ("w2", "w1", "w0"), ("w2", "w1"), ("w3", "w2", "w1"), ("w3", "w2")]
        after = [("w0", "n1"), ("w0", "n1", "n2")]
        idiom = F.coalesce(*[self.said("idiom", *names) for names in [*after[::-1], *runs]])
        added = sum((F.coalesce(self.said("booster", *names), F.lit(0.0)) for names in (("w3", "w2", "w1"), ("w3", "w2"), ("w2", "w1"))), F.lit(0.0))
        there = F.col("near.w3").isNotNull() & ~self.low["w3"].isin(self.tokens)
        return F.when(there, F.coalesce(idiom, valence) + added).otherwise(valence)

    def least(self, valence: Column) -> Column:
        spared = F.col("near.w2").isNotNull() & self.low["w2"].isin("at", "very")
        turned = (self.low["w1"] == "least") & F.lit("least" not in self.tokens) & ~spared
        return F.when(turned, valence * NEGATION).otherwise(valence)


def lexicon_polarity(
    texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str, score: str = "polarity", phrases: DataFrame | None = None
) -> DataFrame:
    """Sum of the adjusted valences of each text: one row per distinct `keys`, 0 where no word is known.

    `keys` tell different texts apart; equal texts under one key count once. `phrases` (phrase, kind, value) adds the rules for
    runs of words; a word whose valence is 0 by then stays so.

    Only known words leave their text, each with the words around it, so the rules need no window, and the words of a
    text are summed by the task that read it before anything is shuffled. `lexicon` (token, valence) has one row per
    token; it is a word list, whose tokens are part of the plan, and refused beyond MOST_ROWS.
    """
    tokens = sorted({r["token"] for r in _few(lexicon, "token")})
    acting = {*INTENSIFIERS, *DAMPENERS, *NEGATORS}
    scored = [t for t in tokens if t in acting or "n't" in t]
    spoken = texts.select(*keys, spoken_words(F.col(text)).alias("words"))
    spoken = spoken.select(
        *keys,
        "words",
        F.array_position(F.transform("words", F.lower), "but").alias("but_at"),
        (F.exists("words", _shouted) & F.exists("words", lambda word: ~_shouted(word))).alias("mixed"),
    )
    around = {f"w{d}": -d for d in (1, 2, 3)} | ({"n1": 1, "n2": 2} if phrases is not None else {})
    known = F.filter(
        F.transform("words", lambda word, i: F.struct(i.alias("at"), word.alias("w0"))), lambda x: F.lower(x["w0"]).isin(tokens)
    )
    context = F.transform(known, lambda x: F.struct(x["at"], x["w0"], *[F.get("words", x["at"] + d).alias(name) for name, d in around.items()]))
    # a text without a known word keeps one row
    each = spoken.select(*keys, "but_at", "mixed", F.posexplode_outer(context).alias("nr", "near"))
    each = each.join(lexicon.select("token", "valence"), F.lower("near.w0") == F.col("token"), "left")

    rules = _Phrases(phrases, tokens) if phrases is not None else None
    word, mixed = F.col("near.w0"), F.col("mixed")
    is_booster = F.lower(word).isin(INTENSIFIERS + DAMPENERS)
    if rules:
        is_booster |= (rules.low["w0"] == "kind") & (rules.low["n1"] == "of")
    valence = F.when(is_booster, F.lit(0.0)).otherwise(rules.start(F.col("valence")) if rules else F.col("valence"))
    emphasis = F.when(mixed & _shouted(word), F.lit(CAPITALS)).otherwise(F.lit(0.0))
    effects = [F.struct(emphasis.alias("push"), F.lit(1.0).alias("turn"))]
    for distance, weight in enumerate(BOOST_BY_DISTANCE, 1):
        neighbour = F.coalesce(f"near.w{distance}", F.lit(""))
        turn = F.when(_negates(neighbour, scored), F.lit(NEGATION)).otherwise(F.lit(1.0))
        if rules:
            turn = F.when(F.lower(neighbour).isin(scored), F.lit(1.0)).otherwise(rules.turn(distance, turn))
        effects.append(F.struct(_push(neighbour, mixed, weight, scored).alias("push"), turn.alias("turn")))
    adjusted = F.aggregate(F.array(*effects), valence, lambda v, e: (v + F.signum(v) * e["push"]) * e["turn"])
    if rules:
        adjusted = F.when(is_booster, 0.0).otherwise(rules.least(rules.end(adjusted)))
    spot = F.col("near.at") + 1
    side = F.when(F.col("but_at") == 0, 1.0).when(spot < F.col("but_at"), BEFORE_BUT).when(spot > F.col("but_at"), AFTER_BUT)
    part = F.when(F.col("valence").isNull(), F.lit(0.0)).otherwise(adjusted * F.coalesce(side, F.lit(1.0)))
    # computed before the grouping, which then runs as compiled code
    each = each.select(*keys, F.when(F.coalesce("nr", F.lit(0)) == 0, 1).alias("first"), part.alias("part"))
    copies = F.greatest(F.count("first"), F.lit(1))
    return each.groupBy(*keys).agg((F.round(F.sum("part") / copies, 6) + 0.0).alias(score))


def sentiment_label(review: Column, recommend: Column, polarity: Column) -> Column:
    """0 negative, 1 neutral, 2 positive: null text is neutral, a review that advises against is negative."""
    return (
        F.when(review.isNull(), 1)
        .when(~recommend, 0)
        .when(polarity > 0, 2)
        .when(polarity < 0, 0)
        .otherwise(1)
    )


def label_reviews(
    reviews: DataFrame, lexicon: DataFrame, sentinel_first: bool = False, name: str = "sentiment_analysis", phrases: DataFrame | None = None
) -> DataFrame:
    """Adds the label to reviews (recommend, review, and further columns that tell the rows apart).

    A row is matched to its score by a digest of its text, so equal texts share one score and the text itself
    is shuffled only if a later step asks for it. `sentinel_first` reads a missing text as the words "no data".
    """
    review = F.coalesce(F.col("review"), F.lit("no data")) if sentinel_first else F.col("review")
    keyed = computed(reviews, _digest=F.sha2(review, 256))
    scores = lexicon_polarity(keyed.select("_digest", review.alias("_text")), lexicon, ["_digest"], "_text", "_polarity", phrases)
    label = sentiment_label(review, F.col("recommend"), F.col("_polarity")).alias(name)
    return keyed.join(scores, "_digest", "left").select(*reviews.columns, label)
