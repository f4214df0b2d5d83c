"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are bucketed by length. A first pass over the bucket of the longest vectors gives every query a lower bound
of its k-th score. Every other bucket meets the blocks of queries that it can still serve: with the bucket's greatest
length, a query's bound becomes a threshold of the cosine. Above 1 the bucket is skipped; a high one admits only vectors
whose coordinates lie near the query's largest ones; a low one admits the longest part of the bucket. What is admitted
is verified by its product. Bounds have a margin above rounding, so nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyshelf.llm.common import stored

#: vectors in a bucket and queries in a block, on average
BUCKET, BLOCK = 1024, 2048
#: ranges of length, before large ones are dealt over buckets
RANGES = 64
#: cosine from which coordinates are compared, and how many
COORDINATE_FROM, FOCUS = 0.6, 3
MARGIN = 1e-9
#: products up to here are exact as doubles
EXACT = 2**52

HITS = "query_id long, vec_id long, score long"


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component; an empty vector has none of these."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_hits(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a bucket for each query of a block; both have id, v, norm; queries also bound (the k-th score so far or null)."""
    rows = rows.sort_values("norm", ascending=False)
    p, q = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    ids, lengths = rows["id"].to_numpy(), rows["norm"].to_numpy()
    q_ids, q_lengths, bounds = queries["id"].to_numpy(), queries["norm"].to_numpy(), queries["bound"].to_numpy(float)
    exact = p.shape[1] == 0 or np.abs(p).max() * np.abs(q).max() * p.shape[1] < EXACT
    if not exact:
        p, q = p.astype(np.int64), q.astype(np.int64)
    unit = p / np.where(lengths > 0, lengths, 1)[:, None]
    out: list[tuple[np.ndarray, ...]] = []

    def keep(i: int, admitted: np.ndarray | slice, scores: np.ndarray) -> None:
        own = ids[admitted]
        fit = own != q_ids[i]
        if bounds[i] == bounds[i]:
            fit &= scores >= bounds[i]
        own, scores = own[fit], scores[fit]
        if len(own) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            own, scores = own[scores >= least], scores[scores >= least]
            best = np.lexsort((own, -scores))[:k]
            own, scores = own[best], scores[best]
        out.append((np.full(len(own), q_ids[i]), own, scores.astype(np.int64)))

    # the longest vectors that can still reach the bound of each query; a bound of 0 or less admits all
    reach = np.where(bounds > 0, bounds / np.where(q_lengths > 0, q_lengths, 1e-300), 0)
    upto = np.searchsorted(-lengths, -(reach * (1 - MARGIN)), side="right")
    cosine = np.where(bounds > 0, reach / max(lengths[0], 1e-300), 0) if len(lengths) else reach
    near = (cosine >= COORDINATE_FROM) & (upto > 0)
    for i in np.flatnonzero(near):
        direction = np.clip(q[i] / q_lengths[i], -1, 1)
        apart = np.arccos(min(1.0, cosine[i] * (1 - MARGIN)))  # the angle that reaches the bound
        admitted = np.arange(upto[i])
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            own = np.arccos(direction[f])
            low, high = np.cos(min(np.pi, own + apart)) - 1e-7, np.cos(max(0.0, own - apart)) + 1e-7
            admitted = admitted[(unit[admitted, f] >= low) & (unit[admitted, f] <= high)]
        keep(i, admitted, p[admitted] @ q[i])
    for block in np.array_split(np.flatnonzero(~near & (upto > 0)), max(1, int((~near).sum()) // 256)):
        if len(block):
            scores = q[block] @ p[: upto[block].max()].T
            for i, own in zip(block, scores, strict=True):
                keep(i, slice(0, upto[i]), own[: upto[i]])
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def met(rows: DataFrame, asking: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Hits of the given pairs of bucket and block."""
    left = rows.join(pairs, ["dim", "cell"]).select("cell", "block", "id", "v", "norm")
    right = asking.join(pairs, ["dim", "block"]).select(F.col("cell").alias("of_cell"), F.col("block").alias("of_block"), "id", "v", "norm", "bound")
    return left.groupBy("cell", "block").cogroup(right.groupBy("of_cell", "of_block")).applyInPandas(
        lambda p, q: top_hits(q, p, k) if len(p) and len(q) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64"), HITS
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row of `vectors` (vec_id, embedding) the k other rows with the
    greatest inner product of the floored components, ties to the smaller vec_id; fewer, if there are fewer.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id; rows of other
    dimensions do not meet. A row is no candidate of its own vec_id. Rows that share a vec_id are candidates each, and ask
    together: the list has the best hits of all of them (of equal rows no more than k can be in it). Equal lengths
    are dealt over several buckets. Scores are exact while they fit in 64 bits. An empty table gives an empty result; other
    columns are not read.
    """
    rows = (
        vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select("vec_id", F.coalesce(is_query, F.lit(False)).alias("asks"), floored(F.col("embedding"), scale).alias("v"))
        .groupBy(F.col("vec_id").cast("long").alias("id"), "v", "asks")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .drop("copies")
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
        .withColumn("dim", F.size("v"))
    )
    rows = stored(rows, "vectors")
    # per dimension: how many queries, and the 63 lengths that cut the rows into ranges
    shape = rows.groupBy("dim").agg(
        F.ceil(F.count(F.when(F.col("asks"), 1)) / block).alias("blocks"),
        F.percentile_approx("norm", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"),
    )
    ranged = rows.join(shape, "dim").withColumn("range", F.size(F.filter("cuts", lambda c: c > F.col("norm")))).drop("cuts")
    held = ranged.groupBy("dim", "range").agg(F.count(F.lit(1)).alias("held"))
    salt = F.pmod(F.xxhash64("id", "v", "copy"), F.ceil(F.col("held") / bucket))
    dealt = stored(ranged.join(held, ["dim", "range"]).withColumn("cell", F.concat_ws("-", "dim", "range", salt)), "buckets")
    asking = dealt.filter("asks").select("dim", "id", "v", "norm", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).alias("block"))
    asking = stored(asking, "queries")
    cells = dealt.groupBy("dim", "cell").agg(F.max("norm").alias("longest"))
    blocks = asking.select("dim", "block").distinct()

    first = cells.groupBy("dim").agg(F.max_by("cell", F.struct("longest", "cell")).alias("cell"))
    seen = met(dealt, asking.withColumn("bound", F.lit(None).cast("double")), blocks.join(first, "dim").select("dim", "cell", "block"), k)
    # the k-th score within the longest bucket, if it has k
    bounds = best(seen, k).groupBy("query_id").agg(F.when(F.max("rank") == k, F.min("score")).cast("double").alias("bound"))
    bounded = stored(asking.join(bounds.withColumnRenamed("query_id", "id"), "id", "left"), "bounds")

    open_end = F.col("bound").isNull() | (F.col("bound") <= 0)
    reach = bounded.groupBy("dim", "block").agg(F.min(F.when(open_end, 0.0).otherwise(F.col("bound") / F.col("norm"))).alias("reach"))
    pairs = cells.join(reach, "dim").filter(F.col("longest") >= F.col("reach") * (1 - MARGIN)).select("dim", "cell", "block")
    hits = best(met(dealt, bounded, pairs, k), k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
