"""Frequencies of words and of adjacent word pairs."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.text import words

TOP_WORDS = 200


def stop_words(language: str = "english") -> list[str]:
    """The words that Spark itself lists as stop words of a language, as whole words of this library."""
    return [word for word in StopWordsRemover.loadDefaultStopWords(language) if "'" not in word]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row and column: the name of the column and its words."""
    parts = [F.struct(F.lit(name).alias("field"), words(_as_text(df, name)).alias("words")) for name in columns]
    return df.select(F.inline(F.array(*parts)))


def _as_text(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(name, " ")
    return F.col(name).cast("string")


def _top(counts: DataFrame, unit: str, k: int) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.desc("n"), unit)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _told(word: Column, stop_words: list[str]) -> Column:
    return ~word.isin(stop_words)


def _word_counts(long: DataFrame, stop_words: list[str]) -> DataFrame:
    each = long.select("field", F.explode("words").alias("word")).where(_told(F.col("word"), stop_words))
    return each.groupBy("field", "word").agg(F.count(F.lit(1)).alias("n"))


def _pairs(long: DataFrame, stop_words: list[str]) -> DataFrame:
    """Neighbouring words of one text, none of them a stop word: field, a, b."""
    after = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), after.alias("b"))
    each = long.select("field", F.explode(pairs).alias("pair")).select("field", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    return each.where(_told(F.col("a"), stop_words) & _told(F.col("b"), stop_words))


def word_frequency(df: DataFrame, columns: list[str], stop_words: list[str], k: int = TOP_WORDS) -> DataFrame:
    """The k most frequent words of each column, without stop words: field, word, n, place."""
    return _top(_word_counts(_long(df, columns), stop_words), "word", k)


def bigram_frequency(df: DataFrame, columns: list[str], stop_words: list[str], k: int = TOP_WORDS) -> DataFrame:
    """The k most frequent pairs of neighbouring words of one text, none of them a stop word."""
    counts = _pairs(_long(df, columns), stop_words).groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return _top(counts.select("field", F.concat_ws(" ", "a", "b").alias("bigram"), "n"), "bigram", k)


def _stem(word: Column) -> Column:
    """A word in -s without it; -ss stays. No more than a word and its plural share a stem."""
    return F.when(word.endswith("s") & ~word.endswith("ss"), F.left(word, F.length(word) - 1)).otherwise(word)


def _standard(stem: Column, singular: Column) -> Column:
    """The form that a word and its plural count as: the singular, if it occurs in the field, else the plural itself."""
    return F.when(singular > 0, stem).otherwise(F.concat(stem, F.lit("s")))


def _folded(counts: DataFrame) -> DataFrame:
    """Words with their plurals, from field, word, n: field, standard, n, and the words that count as the standard form."""
    stems = counts.withColumn("stem", _stem(F.col("word"))).groupBy("field", "stem").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("word") == F.col("stem"), F.col("n")).otherwise(0)).alias("singular")
    )
    plural = F.when(F.col("n") > F.col("singular"), F.concat("stem", F.lit("s")))
    words_ = F.array_compact(F.array(F.when(F.col("singular") > 0, F.col("stem")), plural))
    return stems.select("field", _standard(F.col("stem"), F.col("singular")).alias("standard"), "n", words_.alias("words"))


def _folded_pairs(long: DataFrame, stop_words: list[str]) -> DataFrame:
    """Pairs counted with the plural of their second word: field, a, b, n."""
    each = _pairs(long, stop_words).withColumn("stem", _stem(F.col("b")))
    stems = each.groupBy("field", "a", "stem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") == F.col("stem")).alias("singular"))
    return stems.select("field", "a", _standard(F.col("stem"), F.col("singular")).alias("b"), "n")


def _log_likelihood(k: Column, n: Column, x: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.log(F.greatest(x, tiny)) * k + F.log(F.greatest(1 - x, tiny)) * (n - k)


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Twice the log-likelihood ratio (Dunning, 1993) of a pair against its words' occurring independently.

    0 where one of the words is all there is."""
    pair, first, second, total = (c.cast("double") for c in (pair, first, second, total))
    p, p1, p2 = second / total, F.try_divide(pair, first), F.try_divide(second - pair, total - first)
    ratio = (
        _log_likelihood(pair, first, p) + _log_likelihood(second - pair, total - first, p)
        - _log_likelihood(pair, first, p1) - _log_likelihood(second - pair, total - first, p2)
    )
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(-2 * ratio)


def collocations(df: DataFrame, columns: list[str], stop_words: list[str], threshold: float = 30.0) -> DataFrame:
    """Pairs that occur together more than their words would by chance: field, a, b, n, score.

    Words and pairs are counted in one pass over the texts each, plurals with their singular. a and b are the words'
    standard forms, n the pair's count.
    """
    long = _long(df, columns)
    counts = _word_counts(long, stop_words)
    total = counts.groupBy("field").agg(F.sum("n").alias("total"))
    forms = _folded(counts).select("field", "standard", "n", F.explode("words").alias("word"))
    folded = _folded_pairs(long, stop_words)
    for side in ("a", "b"):
        own = forms.select("field", F.col("word").alias(side), F.col("standard").alias(f"{side}_word"), F.col("n").alias(f"{side}_n"))
        folded = folded.join(own, ["field", side])
    scored = folded.join(total, "field").withColumn("score", collocation_score(F.col("n"), F.col("a_n"), F.col("b_n"), F.col("total")))
    return scored.where(F.col("score") > threshold).select("field", "a", "b", "a_word", "b_word", "n", "score")


def word_and_collocation_frequency(df: DataFrame, columns: list[str], stop_words: list[str], k: int = TOP_WORDS, threshold: float = 30.0) -> DataFrame:
    """The k most frequent words and collocations of each column, as a word cloud counts them: field, unit, n, place.

    Plurals count with their singular, and a word's count is without its occurrences in collocations.
    """
    counted = _folded(_word_counts(_long(df, columns), stop_words)).drop("words")
    pairs = collocations(df, columns, stop_words, threshold)
    taken = pairs.select("field", F.explode(F.array("a_word", "b_word")).alias("standard"), "n").groupBy("field", "standard").agg(F.sum("n").alias("taken"))
    left = counted.join(taken, ["field", "standard"], "left").withColumn("n", F.col("n") - F.coalesce("taken", F.lit(0)))
    units = left.where("n > 0").select("field", F.col("standard").alias("unit"), "n")
    return _top(units.unionByName(pairs.select("field", F.concat_ws(" ", "a", "b").alias("unit"), "n")), "unit", k)
