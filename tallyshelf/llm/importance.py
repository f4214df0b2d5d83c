"""Importance resampling towards a target, with a head-tail vocabulary of hashed features.

A feature is a run of one to three words; its bucket is its CRC-32 modulo the number of buckets. Words that are frequent
in the corpus go to all tasks with their CRC states, frequent pairs of them with their own: a feature that begins with
these goes on from there. What is not among them, the tail, takes its CRC from its bytes. Both give the true CRC, so
the head is a matter of speed alone and all counts, gains and weights are exact.

CRCs are linear: the state of a text with n bytes after it is a fixed linear map of the state, which tables by byte hold
for each n, and meets the CRC of these bytes by exclusive or.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyshelf.llm.common import byte_runs, slices, stored

BUCKETS = 10_000
#: frequent words (of eight bytes at most) and pairs of these that go to all tasks: a megabyte at most
HEAD_WORDS, HEAD_PAIRS = 1 << 14, 1 << 16
#: a word or pair is counted for the head where it makes up such a share of a batch
HEAD_SHARE = 1 / 50_000
BATCH = 2_000_000
#: lengths with a table of their own; longer ones are put together from powers of two
TABLED = 64

BYTE = np.zeros(256, np.uint8)  # lower case of what belongs to words, 0 for all else
BYTE[48:58] = np.arange(48, 58)
BYTE[97:123] = BYTE[65:91] = np.arange(97, 123)
BYTE[128:] = np.arange(128, 256)


def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each length below TABLED, and for each power of two from it on: the map of a CRC by that many bytes after it,
    as four tables by byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    one = np.empty((4, 256), np.uint32)  # by one byte: crc -> (crc >> 8) ^ table[crc & 255]
    for k in range(4):
        part = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = (part >> np.uint32(8)) ^ table[part & np.uint32(255)]
    lengths = [np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(TABLED):
        lengths.append(mapped(one, lengths[-1]))
    powers = [lengths[TABLED]]
    for _ in range(24):
        powers.append(mapped(powers[-1], powers[-1]))
    return np.array(lengths[:TABLED]), np.array(powers)


def mapped(by: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return by[0][crc & low] ^ by[1][(crc >> np.uint32(8)) & low] ^ by[2][(crc >> np.uint32(16)) & low] ^ by[3][crc >> np.uint32(24)]


class Crc:
    """CRC-32 of many byte strings at once."""

    def __init__(self):
        self.lengths, self.powers = step_tables()
        self.flat = self.lengths.reshape(-1)
        self.byte = self.lengths[1][0]  # the table of CRC-32

    def after(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """CRCs mapped by n bytes after them."""
        low, base = np.uint32(255), (n % TABLED) * 1024
        out = self.flat[base + (crc & low)] ^ self.flat[base + 256 + ((crc >> np.uint32(8)) & low)]
        out ^= self.flat[base + 512 + ((crc >> np.uint32(16)) & low)] ^ self.flat[base + 768 + (crc >> np.uint32(24))]
        long = np.flatnonzero(n >= TABLED)
        if len(long):
            rest, value = n[long] // TABLED, out[long]
            for power in self.powers:
                odd = (rest & 1) == 1
                value[odd] = mapped(power, value[odd])
                rest >>= 1
            out[long] = value
        return out

    def direct(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of data[begin : begin + length], byte by byte."""
        crc = np.full(len(begin), 0xFFFFFFFF, np.uint32)
        long = np.flatnonzero(length > TABLED)
        order = np.argsort(-np.minimum(length, TABLED), kind="stable")
        place, ends = begin[order], np.searchsorted(-np.minimum(length, TABLED)[order], -np.arange(TABLED), side="left")
        state = crc[order]
        for k in range(TABLED):
            m = ends[k]  # so many are longer than k
            if not m:
                break
            state[:m] = self.byte[(state[:m] ^ data[place[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
        crc[order] = ~state
        for i in long:
            crc[i] = zlib.crc32(data[begin[i] : begin[i] + length[i]].tobytes())
        return crc

    def extended(self, crc: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of strings with CRC crc, a blank, and a word with CRC `word` and that length."""
        blank = np.full(len(word), zlib.crc32(b" "), np.uint32)
        return self.after(crc, length + 1) ^ self.after(blank, length) ^ word


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column with A-Z in lower case, and begin, length and text of each word."""
    data, starts = byte_runs(texts)
    data = BYTE[data]
    real = np.concatenate([[False], data != 0, [False]])
    real_edges = np.concatenate([real[1:] != real[:-1]])
    # a word ends with its text
    text_edge = np.zeros(len(data) + 1, bool)
    text_edge[starts[(starts > 0) & (starts < len(data))]] = True
    inner = text_edge & real[1:] & real[:-1]
    begin = np.flatnonzero((real_edges & real[1:]) | inner)
    end = np.flatnonzero((real_edges & real[:-1]) | inner)
    return data, begin, end - begin, np.searchsorted(starts, begin, side="right") - 1


def packed(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words of eight bytes at most as numbers, 0 for longer ones; bytes of words are never 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = padded[begin[:, None] + np.arange(8)].view("<u8")[:, 0]
    short = np.minimum(length, 8).astype(np.uint64)
    mask = np.where(short == 8, np.uint64(2**64 - 1), (np.uint64(1) << (short * np.uint64(8) % np.uint64(64))) - np.uint64(1))
    return np.where(length <= 8, wide & mask, np.uint64(0))


def found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the key is there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return place, keys[place] == sought


class Head:
    """Frequent words with their CRC states, and frequent pairs with theirs."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        """words: packed, sorted; pairs: sorted, place of the first word * HEAD_WORDS + place of the second."""
        crc = Crc()
        self.words, self.pairs = words, pairs
        data = words.astype("<u8").view(np.uint8)
        self.length = (data.reshape(-1, 8) != 0).sum(1)
        self.state = crc.direct(data, np.arange(len(words)) * 8, self.length)
        first, second = pairs // HEAD_WORDS, pairs % HEAD_WORDS
        self.pair_state = crc.extended(self.state[first], self.state[second], self.length[second])


def frequent(batches: DataFrame, schema: str, most: int, keys: list[str]) -> list:
    """The most frequent keys; each batch counts its own and hands on those with a share of it."""
    counted = batches.groupBy(*keys).agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), *keys).limit(most).select(*keys).collect()


def head_of(texts: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, share: float = HEAD_SHARE) -> Head:
    """The head of a corpus: its most frequent words, and pairs of them. At most `words` and `pairs` come to the driver."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                key = packed(*words_of(part.column("text"))[:3])
                word, n = np.unique(key[key != 0], return_counts=True)
                often = n >= max(2, share * len(key))
                yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    seen = frequent(texts.mapInArrow(count_words, "word long, n long"), "word long", words, ["word"])
    known = np.sort(np.array([r["word"] for r in seen], np.int64).view(np.uint64))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                data, begin, length, own = words_of(part.column("text"))
                place, there = found(known, packed(data, begin, length))
                both = (own[1:] == own[:-1]) & there[1:] & there[:-1]
                pair, n = np.unique((place[:-1] * HEAD_WORDS + place[1:])[both], return_counts=True)
                often = n >= max(2, share * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(pair[often]), pa.array(n[often])], ["pair", "n"])

    seen = frequent(texts.mapInArrow(count_pairs, "pair long, n long"), "pair long", pairs, ["pair"]) if len(known) else []
    return Head(known, np.sort(np.array([r["pair"] for r in seen], np.int64)))


class Features:
    """Buckets of the features of texts."""

    def __init__(self, head: Head):
        self.head, self.crc = head, Crc()

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """text and bucket of each feature: of the words, then of runs of two, then of three."""
        data, begin, length, own = words_of(texts)
        place, there = found(self.head.words, packed(data, begin, length))
        word = np.zeros(len(begin), np.uint32)
        word[there] = self.head.state[place[there]]
        tail = ~there
        word[tail] = self.crc.direct(data, begin[tail], length[tail])
        yield own, word % np.uint32(BUCKETS)
        two = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
        key = np.where(there[two] & there[two + 1], place[two] * HEAD_WORDS + place[two + 1], -1)
        at, known = found(self.head.pairs, key)
        pair = np.zeros(len(two), np.uint32)
        pair[known] = self.head.pair_state[at[known]]
        rest = two[~known]
        pair[~known] = self.crc.extended(word[rest], word[rest + 1], length[rest + 1])
        yield own[two], pair % np.uint32(BUCKETS)
        three = np.flatnonzero(own[two] == own[np.minimum(two + 2, len(own) - 1)]) if len(two) else two
        three = three[two[three] + 2 < len(own)]
        last = two[three] + 2
        yield own[last], self.crc.extended(pair[three], word[last], length[last]) % np.uint32(BUCKETS)


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features of all texts by bucket; a fixed number of counts comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(head), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                for _, bucket in features(part.column("text")):
                    total += np.bincount(bucket, minlength=BUCKETS)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], ["bucket", "n"])

    counts = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in counts:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each bucket, in doubles."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in pairs], np.int64)


def noise(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, fixed by the key: floor(-1000 * ln(-ln(u)))."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `docs` (doc_id, text), drawn towards `target` (text).

    Features are runs of one to three words, which are made of ASCII digits, letters (in lower case) and all characters
    beyond ASCII. weight is the sum of the gains of a text's features, score adds a Gumbel draw by doc_id, and
    floor(percent * N / 100) of the N rows with `least_words` words or more are ranked, the highest scores first, ties by
    the smaller doc_id, null last. Null texts count as empty and weigh 0, a null doc_id draws like an empty one, repeated
    rows are rows of their own and, ranked, follow each other in any order. Very long texts and words are taken whole. An
    empty table gives an empty result, an empty target is all buckets at 0; other columns are not read.
    """
    head = head_of(docs.select("text"))
    gain = gains(bucket_totals(docs.select("text"), head), bucket_totals(target.select("text"), head))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(head)
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                n, weight, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for k, (own, bucket) in enumerate(features(part.column("text"))):
                    of_run = np.bincount(own, minlength=part.num_rows)
                    n += of_run
                    words = of_run if k == 0 else words
                    # sums of whole numbers, exact as doubles
                    weight += np.bincount(own, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(words)], ["doc_id", "n_features", "weight", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long, words long")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id())
    weighed = stored(rows, "weighed")
    # ranges of falling scores, one per task; the place parts what is equal
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    ranged = stored(weighed.filter(F.col("words") >= least_words).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    held = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    drawn = percent * sum(n for _, n in held) // 100
    before, needed, upto = 0, [], -1
    for part, n in held:  # one number per range
        if before < drawn:
            needed.append((part, before))
            upto = part
        before += n
    offsets = docs.sparkSession.createDataFrame(needed, "part int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    top = ranged.join(F.broadcast(offsets), "part").withColumn("rank", rank)  # as many rows as there are ranges
    columns = ["doc_id", "n_features", "weight", "score"]
    top = top.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    others = [ranged.filter(F.col("part") > upto), weighed.filter(F.col("words") < least_words)]
    for rest in others:
        top = top.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
    return top
