"""Titles with the most similar description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import normalize_title
from tallyshelf.operators.neighbours import nearest_to
from tallyshelf.operators.postings import nearest_by_postings
from tallyshelf.operators.tfidf import tfidf_vectors


def model_vectors(model: DataFrame) -> DataFrame:
    """Term weights of the descriptions; worth writing once and reading for every request."""
    return tfidf_vectors(model, "id", "description")


def find_titles(model: DataFrame, titles: DataFrame) -> DataFrame:
    """The smallest id under each requested title, whatever its case and signs; blank titles find nothing."""
    wanted = titles.select(normalize_title(F.col("title")).alias("normalized_title")).distinct()
    known = model.where("normalized_title != ''").join(wanted, "normalized_title", "left_semi")
    return known.groupBy("normalized_title").agg(F.min("id").alias("id"))


def _with_titles(near: DataFrame, model: DataFrame) -> DataFrame:
    titles = model.select(F.col("id").alias("neighbour"), F.col("title").alias("similar_title"))
    return titles.join(near, "neighbour").select("id", "place", "neighbour", "similar_title", "similarity")


def similar_to_titles(model: DataFrame, vectors: DataFrame | None, titles: DataFrame, k: int = 5, postings: str | None = None) -> DataFrame:
    """The k most similar titles for each of a list of requested titles, from vectors or from written posting lists."""
    wanted = find_titles(model, titles).select("id")
    if postings is not None:
        return _with_titles(nearest_by_postings(model.sparkSession, postings, model.select("id"), wanted, k), model)
    return _with_titles(nearest_to(model.select("id"), vectors, wanted, k), model)


def similar_titles(model: DataFrame, vectors: DataFrame | None, title: str, k: int = 5, postings: str | None = None) -> DataFrame:
    """The k most similar titles for one title; empty if there is no such title."""
    asked = normalize_title(F.lit(title))
    found = model.where((F.col("normalized_title") == asked) & (asked != "")).agg(F.min("id").alias("id"))
    wanted = found.where("id is not null")
    if postings is not None:
        near = nearest_by_postings(model.sparkSession, postings, model.select("id"), wanted, k, single=True)
    else:
        near = nearest_to(model.select("id"), vectors, wanted, k, single=True)
    return _with_titles(F.broadcast(near), model)
