"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

Every normalised text is cut where its own letters say so, and is then known by the ordered list of its chunks'
identifiers, its recipe. Identifiers are verified: all chunks meet once, and no two different chunks may share one. Texts
are equal exactly if their recipes are, so beyond that one meeting only recipes move, some 32 bytes per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyshelf.llm.common import normalized, side, stored

#: A chunk ends, from 512 characters on, at a blank whose neighbours fall into three classes of letters and digits, or at
#: 4096. Texts in which no such place is near are cut every 4096 characters, which costs matches but no correctness.
CHUNK = r"(?s).{512,4093}?[adgjmpsvyADGJMPSVY0369][behknqtwzBEHKNQTWZ147]\x20(?=[acegikmoqsuwyACEGIKMOQSUWY13579])|.{1,4096}"


def sha256_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def own_bytes(chunk: Column) -> Column:
    """The chunk itself: an identifier that never fails."""
    return chunk.cast("binary")


IDENTIFIERS = (sha256_id, own_bytes)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous(texts: DataFrame, identifier: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that different chunks of the column `text` share. Equal chunks meet on the map side first."""
    pairs = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    return pairs.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def verified_identifier(texts: DataFrame, identifiers=IDENTIFIERS) -> Callable[[Column], Column]:
    """The first identifier that no two different chunks share; the last one needs no proof."""
    for identifier in identifiers[:-1]:
        if ambiguous(texts, identifier).isEmpty():
            return identifier
    return identifiers[-1]


def exact_duplicates(docs: DataFrame, identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest doc_id stays; if several rows hold that doc_id, one of them. Null
    doc_ids come after all others, and keep_id is null in a group without any. Null text equals empty text. An empty table
    gives an empty result; other columns are not read.
    """
    texts = docs.select("doc_id", normalized(F.col("text")).alias("text"))
    identifier = verified_identifier(texts, identifiers)
    recipe = F.transform(chunks_of(F.col("text")), identifier)
    recipes = stored(texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe")), "recipes")
    rows = recipes.groupBy("doc_id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("copies"))
    groups = side(recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return (
        rows.join(groups, "recipe")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256")
    )
