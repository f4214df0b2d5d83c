import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import neighbours, sentiment, tfidf, wordcounts
from tallyshelf.plans import similar
from tallyshelf.operators.shape import add_normalized_title

LEXICON = {"best": 3.2, "stupid": -2.4, "no": -1.2, "good": 1.9, "bad": -2.5, "fine": 0.8}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


def polarity(spark, lexicon, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scored = sentiment.lexicon_polarity(df, lexicon, ["id"], "text").collect()
    return [r["polarity"] for r in sorted(scored)]


@pytest.mark.parametrize(
    "text, score",
    [
        ("a good day", 1.9),
        ("Good!!!", 1.9),
        ("not good", 1.9 * -0.74),
        ("not a very good", (1.9 + 0.293) * -0.74),
        ("not that it is good", 1.9),
        ("very good", 1.9 + 0.293),
        ("very much good", 1.9 + 0.293 * 0.95),
        ("very much so good", 1.9 + 0.293 + 0.293 * 0.9),
        ("slightly bad", -2.5 + 0.293),
        ("VERY good here", 1.9 + 0.293 + 0.733),
        ("GOOD day", 1.9 + 0.733),
        ("GOOD DAY", 1.9),
        ("isn't good", 1.9 * -0.74),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("never never good", 1.9 * 0.74 * 0.74),
        ("slightly fine", 0.8 - 0.293),
        ("table", 0.0),
        ("", 0.0),
        (None, 0.0),
        ("good bad good", 1.9 - 2.5 + 1.9),
    ],
)
def test_polarity(spark, lexicon, text, score):
    assert polarity(spark, lexicon, text) == [pytest.approx(score, abs=1e-6)]


def phrased(spark, *texts):
    words = {**LEXICON, "kind": 2.4}
    lexicon = spark.createDataFrame(list(words.items()), "token string, valence double")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scored = sentiment.lexicon_polarity(df, lexicon, ["id"], "text", phrases=sentiment.published_phrases(spark)).collect()
    return [r["polarity"] for r in sorted(scored)]


PHRASED = [
    ("it is least good", 1.9 * -0.74),
    ("least good", 1.9 * -0.74),
    ("this is at least good", 1.9),
    ("the very least good", 1.9 + 0.293 * 0.95),
    ("she was never so good", (1.9 + 0.293) * 1.25),  # "so" strengthens as well
    ("never was this good", 1.9 * 1.25),
    ("it never was good", 1.9 * -0.74),
    ("never so very good", (1.9 + 0.293 + 0.293 * 0.95) * 1.25),
    ("she is no good", 1.9 * -0.74),
    ("no", -1.2),
    ("no table", -1.2),
    ("neither no one nor good", -1.2 * -0.74 + 1.9 * -0.74 * -0.74),  # both negated by the word before
    ("it was kind of good", 1.9 - 0.293),
    ("a kind person", 2.4),
    ("this was just enough bad", -2.5 - 0.293),
    ("he is a bad ass", 1.5),
    ("he is bad ass", -2.5),
    ("one bad ass", -2.5),
    ("and it was stupid", -2.4),
    ("", 0.0),
]


def test_rules_for_runs_of_words(spark):
    # a run counts from the fourth word on, as the published method has it
    got = phrased(spark, *[text for text, _ in PHRASED])
    assert dict(zip([text for text, _ in PHRASED], got)) == {text: pytest.approx(score, abs=1e-6) for text, score in PHRASED}


def test_without_doubt(spark):
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    df = spark.createDataFrame([(0, "without doubt good"), (1, "without any doubt good"), (2, "without it good"), (3, "without good")], "id int, text string")
    scored = sentiment.lexicon_polarity(df, words, ["id"], "text", phrases=sentiment.published_phrases(spark)).collect()
    assert [r["polarity"] for r in sorted(scored)] == [pytest.approx(x, abs=1e-6) for x in (1.9, 1.9, 1.9 * -0.74, 1.9 * -0.74)]


def test_phrases_are_short_lists(spark, lexicon):
    long = spark.createDataFrame([("one two three four", "idiom", 1.0)], "phrase string, kind string, value double")
    df = spark.createDataFrame([(1, "good")], "id int, text string")
    with pytest.raises(ValueError, match="more than 3 words"):
        sentiment.lexicon_polarity(df, lexicon, ["id"], "text", phrases=long)


def test_equal_texts_under_one_key_count_once(spark, lexicon):
    df = spark.createDataFrame([("k", "good")] * 7 + [("e", "")] * 3, "id string, text string")
    assert sorted(map(tuple, sentiment.lexicon_polarity(df, lexicon, ["id"], "text").collect())) == [("e", 0.0), ("k", 1.9)]


def test_labels(spark, lexicon):
    rows = [(0, None, True), (1, "best", False), (2, "best", True), (3, "table", True), (4, "stupid", True),
            (5, "best", None), (6, None, False), (7, "best", True)]
    df = spark.createDataFrame(rows, "id int, review string, recommend boolean")
    labels = [r["sentiment_analysis"] for r in sentiment.label_reviews(df, lexicon).orderBy("id").collect()]
    assert labels == [1, 0, 2, 1, 0, 2, 1, 2]
    first = sentiment.label_reviews(df, lexicon, sentinel_first=True).orderBy("id").collect()
    assert [r["sentiment_analysis"] for r in first] == [0, 0, 2, 1, 0, 2, 0, 2]


def weights(texts):
    """Term weights by the plain formula."""
    counts = [Counter(re.findall(r"\b\w\w+\b", text.lower())) for text in texts]
    df = Counter(term for c in counts for term in c)
    out = []
    for c in counts:
        raw = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(w * w for w in raw.values())) or 1
        out.append({t: w / length for t, w in raw.items()})
    return out


def nearest(ids, texts, k):
    """Full search, ties to the smaller id."""
    w = weights(texts)
    out = {}
    for i, a in zip(ids, w):
        ranked = sorted(
            (-round(sum(v * z.get(t, 0) for t, v in a.items()), 6) + 0.0, j) for j, z in zip(ids, w) if j != i
        )
        out[i] = [(j, -s + 0.0) for s, j in ranked[:k]]
    return out


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(n)]
    # a third are copies of one text, some have no words, some share none, some are one bag in another order
    texts[: n // 3] = ["same words here"] * (n // 3)
    texts[-1], texts[-2], texts[-3], texts[-4] = "", "? !", "alone lonely", "here words same"
    ids = [int(i) for i in rng.permutation(n * 2)[:n]]
    return ids, texts


def test_weights(spark):
    ids, texts = corpus(40)
    df = spark.createDataFrame(list(zip(ids, texts)), "id long, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf_vectors(df).collect()}
    want = {(i, t): w for i, doc in zip(ids, weights(texts)) for t, w in doc.items()}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-12 for key in want)


@pytest.mark.parametrize("single", [True, False])
def test_nearest_of_one(spark, single):
    ids, texts = corpus(60)
    df = spark.createDataFrame(list(zip(ids, texts)), "id long, text string")
    vectors = tfidf.tfidf_vectors(df)
    want = nearest(ids, texts, 5)
    for id in [ids[0], ids[30], ids[-1], ids[-3]]:
        wanted = spark.createDataFrame([(id,)], "id long")
        found = neighbours.nearest_to(df.select("id"), vectors, wanted, 5, single).orderBy("place").collect()
        assert [(r["neighbour"], r["similarity"]) for r in found] == want[id]


def test_sorted_joins_give_the_same(spark, lexicon, sorted_joins):
    ids, texts = corpus(90, seed=11)
    df = spark.createDataFrame([(i, t, True, t + " good") for i, t in zip(ids, texts)],
                               "id long, text string, recommend boolean, review string")
    vectors = tfidf.tfidf_vectors(df)
    wanted = spark.createDataFrame([(i,) for i in ids[::9]], "id long")
    with sorted_joins():
        some = neighbours.nearest_to(df.select("id"), vectors, wanted).orderBy("id", "place").collect()
        labels = sentiment.label_reviews(df, lexicon).select("id", "sentiment_analysis").collect()
    want = nearest(ids, texts, 5)
    assert [(r["neighbour"], r["similarity"]) for r in some] == [pair for i in sorted(ids[::9]) for pair in want[i]]
    assert sorted(labels) == [(i, 2) for i in sorted(ids)]


def test_fewer_documents_than_neighbours(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two three")], "id long, text string")
    vectors = tfidf.tfidf_vectors(df)
    assert neighbours.nearest_to(df, vectors, df.select("id").where("id = 1")).count() == 1


def test_similarity_is_symmetric_and_at_most_one(spark):
    ids, texts = corpus(80, seed=5)
    df = spark.createDataFrame(list(zip(ids, texts)), "id long, text string")
    near = neighbours.nearest_to(df.select("id"), tfidf.tfidf_vectors(df), df.select("id"), 79)
    assert near.count() == 80 * 79
    both = near.alias("a").join(near.alias("z"), F.expr("a.id = z.neighbour and a.neighbour = z.id"))
    assert both.where("a.similarity <> z.similarity or a.similarity > 1 or a.similarity < 0").count() == 0


def test_titles(spark):
    rows = [(3, "Half-Life 2™", "shooter gordon"), (1, "half life 2", "shooter gordon"), (2, "Portal", "puzzle gordon"),
            (4, "日本語", "puzzle"), (5, "Other", "unrelated")]
    model = add_normalized_title(spark.createDataFrame(rows, "id long, title string, description string"))
    vectors = similar.model_vectors(model)
    found = similar.similar_titles(model, vectors, "HALF life-2").orderBy("place").collect()
    assert [(r["id"], r["neighbour"]) for r in found] == [(1, 3), (1, 2), (1, 4), (1, 5)]
    assert similar.similar_titles(model, vectors, "日本").count() == 0
    assert similar.similar_titles(model, vectors, "missing").count() == 0
    asked = spark.createDataFrame([("Portal",), ("portal!",), ("other",), ("none",)], "title string")
    got = similar.similar_to_titles(model, vectors, asked, 1).collect()
    assert sorted((r["id"], r["neighbour"]) for r in got) == [(2, 4), (5, 1)]


def test_word_counts(spark):
    rows = [("The cat and the Cat", ["Red fox"]), ("a dog", None)]
    df = spark.createDataFrame(rows, "title string, tags array<string>")
    got = [tuple(r) for r in wordcounts.word_frequency(df, ["title", "tags"], ["the", "and"]).orderBy("field", "place").collect()]
    assert got == [("tags", "fox", 1, 1), ("tags", "red", 1, 2), ("title", "cat", 2, 1), ("title", "dog", 1, 2)]
    pairs = wordcounts.bigram_frequency(df, ["title", "tags"], ["and"]).orderBy("field", "place").collect()
    assert [tuple(r) for r in pairs] == [("tags", "red fox", 1, 1), ("title", "the cat", 2, 1)]
    assert wordcounts.word_frequency(df, ["title"], [], 1).count() == 1
    assert {"the", "and", "of"} <= set(wordcounts.stop_words())
