"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; a source's documents are taken in key order up
to its token budget. Whole passes over a source (epochs) come first, the key order decides on the rest. Where the budget
ends is found digit by digit: each step adds up the sizes per source and digit of the keys, of which there are 1024, and
goes on inside the digit at which the budget is used up. No source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyshelf.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
DIGIT = 1024
DIGITS = 4


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from SHA-256 of the seed and the doc_id; the same in every run."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 13), 16, 10)
    return -F.ln((drawn.cast("double") + 0.5) / float(16**13)) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for a table of source, source_size (one row per source).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. No target exceeds
    `most` times its source's size; the excess is shared by weight among the others until none does: a level is raised
    until what the sources take, each its weight times the level or its bound, is the whole. Each step adds up the
    sources at their bound.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    parts = F.array(*[F.lit(float(w)) for w in weights])
    table = stored(
        sizes.withColumn("weight", F.element_at(parts, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))), "sources"
    )
    whole, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    level, at_bound = whole / weight, None
    while True:
        full = F.col("weight") * level >= F.col("source_size") * most
        count, held, free = table.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == at_bound or not free:
            break
        level, at_bound = (whole - held) / free, count
    target = F.least(F.col("weight") * level, (F.col("source_size") * most).cast("double"))
    return table.select("source", "source_size", F.round(target, 6).alias("target"))


def weighed(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size, weight of documents: 2 for those labelled as good, 0.5 for bad ones, 1 for those without a label;
    with `carry` also row, the whole row."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more)
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality").isNotNull(), 0.5).otherwise(1.0)
    return rows.join(known, "doc_id", "left").select("doc_id", "source", "size", weight.alias("weight"), *["row"] * carry)


def copies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, source, text, others) as often as the mix takes them, whole.

    The document at the end of a source's budget is taken where half of it or more is wanted, so that a source differs from
    its target by half a document at most. Documents without a word, also null texts, go. Rows are told apart, so
    null and repeated doc_ids and repeated rows count by themselves; extra columns come along under any name. An
    empty table gives an empty result.
    """
    mixed = mix(weighed(docs, labels, carry=True), carry=["row"]).filter("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("one")).select("row.*")


def mix(
    rows: DataFrame, seed: str = "mix", weights=WEIGHTS, most: int = MOST_EPOCHS, digits: int = DIGITS, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, taken for rows of doc_id, source, size, weight (above 0; null counts as 1), and the
    columns named by `carry`.

    taken is the epochs times the size, and once more the size for documents in the part of the key order that the rest
    of the budget covers; the document at its end gives the words still wanting, so sources meet their targets. Rows
    without a word take none. Ties of keys go by doc_id, null last. Repeated rows share a key and are taken one after the
    other. An empty table gives an empty result.
    """
    carry = carry or []
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    key = exponential_key(F.col("doc_id"), weight, seed)
    place = F.floor((1 - F.exp(-key)) * float(DIGIT**digits))  # keys in order, evenly over all digits
    rows = stored(
        rows.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), key.alias("key"), place.alias("place"), *carry), "keys"
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    budget = F.floor("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    cut = targets.select(
        "*",
        F.least(F.floor(budget / size), F.lit(most)).cast("long").alias("epochs"),
        F.lit(0).cast("long").alias("prefix"),
    ).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    cut = stored(cut, "cut")
    same = F.col("r.source").eqNullSafe(F.col("c.source"))
    for i in range(digits):
        step = DIGIT ** (digits - 1 - i)
        inside = F.floor(F.col("r.place") / (step * DIGIT)) == F.col("c.prefix")
        cells = (
            rows.alias("r")
            .join(cut.select("source", "prefix").alias("c"), same & inside)
            .groupBy("r.source", F.floor(F.col("r.place") / step).alias("cell"))
            .agg(F.sum("size").alias("held"))
        )
        before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = (
            cells.withColumn("before", before)
            .join(cut.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
            .filter(F.col("before") <= F.col("rest"))
            .groupBy("source")
            .agg(F.max_by("cell", F.col("cell")).alias("cell"), F.max("before").alias("before"))
        )
        cut = stored(
            cut.alias("c")
            .join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left")
            .select(
                "c.source", "source_size", "target", "epochs",
                F.coalesce(F.col("l.cell"), F.col("c.prefix") * DIGIT).alias("prefix"),
                (F.col("c.rest") - F.coalesce(F.col("l.before"), F.lit(0))).alias("rest"),
            ),
            "cut",
        )
    placed = rows.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    sure = placed.filter(F.col("place") != F.col("prefix")).withColumn("part", F.when(F.col("place") < F.col("prefix"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = placed.filter(F.col("place") == F.col("prefix")).withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return sure.unionByName(edge).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)
