"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its five-word shingles, each weighing its occurrences times the mean inverse document frequency of
its words; the frequencies are counted over all documents, in a fixed number of cells that words are hashed to. Consistent
samples of the set agree between two texts with the probability of their weighted Jaccard similarity. Texts that share a
band of samples meet in a bucket, and weighted Jaccard similarity is computed for pairs from there.

A bucket's texts need not all be compared: what matters is which are linked in the end. In some rounds every bucket's
texts get one of them as a leader, another in each round, and each text is compared with the two leaders that agree best
with it and that it is not linked with yet; after these, all pairs that are still not linked and that can be similar.

In a family of near copies most of these cannot. Texts x and y of weights |x| and |y| are similar only if they share a
weight of t / (1 + t) * (|x| + |y|), and what x can share is what it has in common with any text that it is not linked
with. This gives x a reach, the greatest |y| it can be similar to; whoever reaches nobody leaves, takes its shingles
along, and so shortens the reach of others. Nothing similar is lost by this. Classes are the connected components of the
verified links. Texts with equal words are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyshelf.llm.common import side, slices, stored

#: words of a shingle
WIDTH = 5
#: consistent samples of a text, cut into bands of so many
SAMPLES, ROWS = 60, 4
#: A pair is compared if so many samples agree: of pairs of similarity 0.8, fewer than one in a million has fewer.
AGREE = 32
SIMILAR = 0.8
#: rounds of comparing with one text per bucket
LEADERS = 3
#: buckets of more open texts have these sorted out by reach before they meet, in so many rounds; of smaller ones all meet
CROWDED, SORTINGS = 16, 2
BATCH = 1_000_000
#: cells that words are hashed to for their document frequencies
CELLS = 1 << 18
TABLE = 1 << 16
#: what names a row
KEY = ["id", "known", "text_hash"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words (runs of other than white space), and the number of words of each text. Null has none."""
    import xxhash

    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    words = pc.ascii_split_whitespace(lowered)
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    real = hashes != 0
    return hashes[real], np.bincount(own[real], minlength=len(words))


def weighted_shingles(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash and weight of the different shingles of all texts, in text order. A text of fewer words is one shingle."""
    ends = np.cumsum(counts)
    begins = ends - counts
    word_idf = idf[cell_of(hashes)]
    sums = np.concatenate([[0], np.cumsum(word_idf, dtype=np.float64)])
    n = np.maximum(counts - WIDTH + 1, (counts > 0).astype(np.int64))
    own = np.repeat(np.arange(len(counts)), n)
    total = int(n.sum())
    at = np.arange(total) + np.repeat(begins - (np.cumsum(n) - n), n)
    h = np.zeros(total, np.uint64)
    stop = ends[own]
    padded = np.concatenate([hashes, np.zeros(WIDTH, np.uint64)])
    for k in range(WIDTH):
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(at + k < stop, padded[at + k], np.uint64(0))
    h = mixed(h)
    upto = np.minimum(at + WIDTH, stop)
    weight = (sums[upto] - sums[at]) / (upto - at)
    order = np.argsort(h)
    order = order[np.argsort(own[order], kind="stable")]
    h, own, weight = h[order], own[order], weight[order]
    first = np.ones(total, bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    place = np.flatnonzero(first)
    times = np.diff(np.append(place, total))
    return own[place], h[place], weight[place] * times


class Sampler:
    """ICWS: Gamma(2, 1) and uniform draws per element and sample come from tables, at places that its hash names."""

    def __init__(self, samples: int = SAMPLES):
        rng = np.random.default_rng(7)
        u = (np.arange(TABLE) + 0.5) / TABLE
        x = 2.0 * np.ones(TABLE)
        for _ in range(60):  # quantiles of Gamma(2, 1) by Newton's method: 1 - (1 + x) exp(-x) = u
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x) + 1e-300), x / 4)
        self.gamma, self.log_gamma = x.astype(np.float32), np.log(x).astype(np.float32)
        self.seeds = rng.integers(0, 2**63, samples, dtype=np.uint64)

    def __call__(self, own: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """texts x samples: a 32-bit name of the element and step that is sampled; 0 for texts without shingles."""
        out = np.zeros((texts, len(self.seeds)), np.uint32)
        if not len(h):
            return out
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        log_weight = np.log(weight).astype(np.float32)
        low = np.uint64(TABLE - 1)
        for k, seed in enumerate(self.seeds):
            x = mixed(h ^ seed)
            r = self.gamma[(x & low).astype(np.int64)]
            log_c = self.log_gamma[((x >> np.uint64(16)) & low).astype(np.int64)]
            beta = ((x >> np.uint64(32)) & low).astype(np.float32) / np.float32(TABLE)
            step = np.floor(log_weight / r + beta)
            a = log_c - r * (step - beta) - r
            bits = a.view(np.int32)
            rank = np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32).astype(np.uint64)
            name = mixed(x + step.astype(np.int64).view(np.uint64)) >> np.uint64(32)
            out[own[begins], k] = np.minimum.reduceat(rank << np.uint64(32) | name, begins) & np.uint64(0xFFFFFFFF)
        return out


def placed(docs: DataFrame) -> DataFrame:
    """id (0 where it is null), known (whether it is not), text_hash and text of each row."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0).cast("long")).alias("id"), key.isNotNull().alias("known"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each cell of words, over all documents. A fixed number of counts comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                hashes, counts = word_hashes(part.column("text"))
                own = np.repeat(np.arange(len(counts)), counts)
                seen = np.unique(own * CELLS + cell_of(hashes))
                total += np.bincount(seen % CELLS, minlength=CELLS)
                rows += len(counts)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1)), pa.array(np.append(total[cell], rows))], ["cell", "n"])

    counts = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = counts["cell"].to_numpy(), counts["n"].to_numpy()
    held = np.zeros(CELLS)
    held[cell[cell >= 0]] = n[cell >= 0]
    return (np.log((n[cell < 0].sum() + 1) / (held + 1)) + 1).astype(np.float32)


def signatures(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """id, known, text_hash, node (a hash of the words), words, signature for rows of id, known, text_hash, text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                hashes, counts = word_hashes(part.column("text"))
                names = sampler(*weighted_shingles(hashes, counts, idf), len(counts))
                flat = pa.array(names.view(np.int32).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SAMPLES, dtype=np.int32)), flat)
                node = text_keys(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in KEY), pa.array(node.view(np.int64)), pa.array(counts.astype(np.int64)), lists],
                    [*KEY, "node", "words", "signature"],
                )

    return rows.mapInArrow(sign, "id long, known boolean, text_hash long, node long, words long, signature array<int>")


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def text_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each text."""
    ends = np.cumsum(counts)
    begins = ends - counts
    place = np.arange(len(hashes)) - np.repeat(begins, counts)
    terms = mixed(hashes ^ mixed(place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    return mixed(sums[ends] - sums[begins] + counts.astype(np.uint64))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights of two texts, given hashes (sorted) and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - least
    return float(least / whole) if whole > 0 else 0.0


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have a weighted Jaccard similarity of SIMILAR or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b", BATCH):
                sets = []
                for column in ("text_a", "text_b"):
                    coded = part.column(column).dictionary_encode()  # a text that is in many pairs is cut up once
                    own, h, w = weighted_shingles(*word_hashes(coded.dictionary), idf)
                    cuts = np.searchsorted(own, np.arange(len(coded.dictionary) + 1))
                    sets.append((coded.indices.to_numpy(), cuts, h, w))
                (ia, ca, ha, wa), (ib, cb, hb, wb) = sets
                keep = [
                    weighted_jaccard((ha[ca[x] : ca[x + 1]], wa[ca[x] : ca[x + 1]]), (hb[cb[y] : cb[y + 1]], wb[cb[y] : cb[y + 1]])) >= SIMILAR
                    for x, y in zip(ia.tolist(), ib.tolist(), strict=True)
                ]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """u and v, the least node of its component, for all nodes u that are not the least themselves; edges: u, v.

    Large and small stars in turn: every node is tied to the least of its neighbours, until nothing changes.
    """
    ordered = lambda e: e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(ordered(edges), "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = stored(ordered(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        edges = stored(ordered(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))), "small")


def agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def band_of(signature: Column, i: Column) -> Column:
    return F.xxhash64(i, F.slice(signature, i * ROWS + 1, ROWS))


def leading_pairs(own: DataFrame, lead: DataFrame, tied: DataFrame, chosen: DataFrame) -> DataFrame:
    """a and b: each text with the two leaders of its buckets that agree best with it, of those it is not linked with."""
    roots = tied.select(F.col("u").alias("lead"), F.col("v").alias("lead_root"))
    lead = lead.select("bucket", "lead").join(roots, "lead", "left").select("bucket", "lead", F.coalesce("lead_root", "lead").alias("lead_root"))
    pairs = own.join(lead, "bucket").filter("root <> lead_root").select(F.col("node").alias("x"), F.col("lead").alias("y")).distinct()
    x, y = (chosen.select(F.col("node").alias(c), F.col("signature").alias(f"s_{c}")) for c in ("x", "y"))
    seen = pairs.join(x, "x").join(y, "y").select("x", "y", agreement(F.col("s_x"), F.col("s_y")).alias("n")).filter(F.col("n") >= AGREE)
    best = Window.partitionBy("x").orderBy(F.desc("n"), "y")
    return seen.withColumn("i", F.row_number().over(best)).filter("i <= 2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shingle_weights(nodes: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, root, shingle, weight of the shingles of some texts; nodes: node, root."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                own, h, weight = weighted_shingles(*word_hashes(part.column("text")), idf)
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column("node").take(own), part.column("root").take(own), pa.array(h.view(np.int64)), pa.array(weight)], ["node", "root", "shingle", "weight"])

    return nodes.join(texts, "node").select("node", "root", "text").mapInArrow(cut, "node long, root long, shingle long, weight double")


def within_reach(own: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """bucket, band, node, root, weight, reach: the texts of open buckets that can be similar to one of their bucket that
    they are not linked with; in buckets that are not crowded all texts, with null as weight and reach."""
    share = SIMILAR / (1 + SIMILAR)
    sizes = side(own.groupBy("bucket").agg((F.count(F.lit(1)) > CROWDED).alias("crowded")))
    own = stored(own.join(sizes, "bucket").select("bucket", "band", "node", "root", "crowded"), "sized")
    unknown = F.lit(None).cast("double")
    free = own.filter("not crowded").select("bucket", "band", "node", "root", unknown.alias("weight"), unknown.alias("reach"))
    crowd = own.filter("crowded").drop("crowded")
    if crowd.isEmpty():
        return free
    shingles = stored(shingle_weights(crowd.select("node", "root").distinct(), texts, idf), "shingles")
    weights, held = stored(shingles.groupBy("node").agg(F.sum("weight").alias("weight")), "weights"), shingles
    for _ in range(SORTINGS):
        common = side(held.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle"))
        usable = held.join(common, "shingle", "left_semi").groupBy("node").agg(F.sum("weight").alias("usable")).join(weights, "node")
        reach = stored(usable.select("node", "weight", (F.col("usable") * (1 + 1e-9) / share - F.col("weight")).alias("reach")), "reach")
        reaching = crowd.join(reach, "node")
        least = side(reaching.groupBy("bucket").agg(F.min("weight").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high"))
        kept = stored(reaching.join(least, "bucket").filter("reach >= least").select(*free.columns), "crowd")
        crowd = kept.drop("weight", "reach")
        held = shingles.join(crowd.select("node").distinct(), "node", "left_semi")
    return free.unionByName(kept)


def remaining_pairs(own: DataFrame, open_buckets: DataFrame, chosen: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a and b: all pairs of a bucket that agree well enough, reach each other and are not linked. What is not of the bucket's
    largest part meets all of the bucket; a pair counts in the first band that it shares alone."""
    own = within_reach(own.join(open_buckets.select("bucket"), "bucket", "left_semi"), texts, idf).join(chosen, "node")
    main = side(own.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    own = stored(own.join(main, "bucket"), "open")
    x = own.filter("root <> main").select("bucket", "band", *[F.col(c).alias(f"{c}_x") for c in ("node", "root", "signature", "weight", "reach")], "main")
    y = own.select(F.col("bucket").alias("bucket_y"), *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "signature", "weight", "reach")])
    reached = F.coalesce((F.col("weight_x") <= F.col("reach_y")) & (F.col("weight_y") <= F.col("reach_x")), F.lit(True))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(SAMPLES // ROWS - 1)), lambda i: (i < F.col("band")) & (F.slice("signature_x", i * ROWS + 1, ROWS) == F.slice("signature_y", i * ROWS + 1, ROWS)))
    once = (F.col("root_y") == F.col("main")) | (F.col("node_x") < F.col("node_y"))  # two of the others meet once
    fit = (F.col("bucket") == F.col("bucket_y")) & (F.col("root_x") != F.col("root_y")) & once & reached & (agreement(F.col("signature_x"), F.col("signature_y")) >= AGREE) & ~earlier
    return x.join(y, fit).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def links(rows: DataFrame, idf: np.ndarray, signed: DataFrame) -> DataFrame:
    """u and v, the least node of its class, for all nodes u that are not the least themselves."""
    nodes = stored(signed.filter("words > 0").dropDuplicates(["node"]), "nodes")
    numbers = F.sequence(F.lit(0), F.lit(SAMPLES // ROWS - 1))
    bands = nodes.select("node", "signature", F.explode(numbers).alias("band")).select("node", "band", band_of(F.col("signature"), F.col("band")).alias("bucket"))
    shared = side(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    members = stored(bands.join(shared, "bucket", "left_semi"), "members")
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi")
    texts = stored(rows.join(chosen.select(*KEY, "node"), KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    chosen = stored(chosen.select("node", "signature"), "signatures")

    none = nodes.limit(0)  # a list from the driver would be read by Python workers of its own, on every executor
    tied = none.select(F.col("node").alias("u"), F.col("node").alias("v"))
    tested = none.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for turn in range(LEADERS + 1):
        roots = tied.select(F.col("u").alias("node"), F.col("v").alias("root"))
        own = stored(members.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root")), "rooted")
        order = F.xxhash64("bucket", F.lit(turn))  # another text leads in every bucket and turn
        lead = own.groupBy("bucket").agg(
            F.min(F.col("node").bitwiseXOR(order)).alias("first"), F.min("root").alias("low"), F.max("root").alias("high")
        ).filter("low <> high")
        lead = side(lead.withColumn("lead", F.col("first").bitwiseXOR(order)))
        if lead.isEmpty():  # every bucket's texts are linked
            break
        pairs = leading_pairs(own, lead, tied, chosen) if turn < LEADERS else remaining_pairs(own, lead, chosen, texts, idf)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found = verified(pairs, texts, idf).select(F.col("b").alias("u"), F.col("a").alias("v"))
        tied = components(found.union(tied))
        tested = tested.union(pairs)
    return tied


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept, text_hash for every row of `docs` (doc_id, text).

    Rows are in one class if a chain of links joins them, each between texts with equal words or with a weighted Jaccard
    similarity of 0.8 or more. class_id is the least doc_id of the class, null before all others, and that row stays (one of
    them, if several rows hold that doc_id and the same text). Null texts count as empty; a text without a word is alone,
    as are texts whose only near ones are themselves. Very long texts count whole. Repeated rows come back as often. An
    empty table gives an empty result; other columns are not read.
    """
    rows = placed(docs)
    idf = inverse_frequencies(rows)
    signed = stored(signatures(rows, idf), "signed")
    tied = links(rows, idf, signed).withColumnRenamed("u", "node")
    known = signed.filter("words > 0").groupBy(*KEY, "node").agg(F.count(F.lit(1)).alias("copies"))
    known = known.join(tied, "node", "left").select(*KEY, "copies", F.coalesce("v", "node").alias("root"))
    known = stored(known, "classes")
    name = F.struct("known", "id")  # null ids come first
    classes = side(known.groupBy("root").agg(F.min(F.struct("known", "id", "text_hash")).alias("first"), F.sum("copies").alias("class_size")))
    held = (
        known.join(classes, "root")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(*KEY, F.struct("first.known", "first.id").alias("class"), "class_size", ((F.struct("known", "id", "text_hash") == F.col("first")) & (F.col("copy") == 1)).alias("kept"))
    )
    alone = signed.filter("words = 0").select(*KEY, name.alias("class"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    given = lambda known, key: F.when(F.col(known), F.col(key))
    return held.unionByName(alone).select(given("known", "id").alias("doc_id"), given("class.known", "class.id").alias("class_id"), "class_size", "kept", "text_hash")
