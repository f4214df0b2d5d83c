"""Best-fit packing: documents as token pieces, packed best-fit decreasing into sequences of fixed length.

Tokenizing depends on one word at a time (white space only separates words), so each task encodes the different words of
a batch and lays the ids out with numpy. Pieces are dealt into shards of some thousand by a hash; each shard is packed by
one task. A second round packs the sequences that stayed rather empty, with those of other shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyshelf.llm.common import slices, stored

LENGTH = 2048
#: pieces per shard, on average
SHARD = 4096
#: sequences filled less than this share of the length are packed again
FULL = 0.98
#: words a worker remembers at most, and text bytes it takes at once
REMEMBERED, BATCH = 1_000_000, 4_000_000
#: words encoded at a time
TOGETHER = 1000

#: a letter and a sign that is no part of a contraction or of a special token; not after U+0130, whose lower case ends in a
#: mark that the tokenizer joins to the sign
SIGN = r"([^\PL\x{0130}])([.,;:!?$%&*#])"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts, by the ids of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row. Words of letters alone are encoded many at a time."""
        lengths, parts = [], []
        for begin in range(0, len(words), TOGETHER):
            some = words[begin : begin + TOGETHER]
            if all(map(str.isalpha, some)):
                found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                own = np.bincount(np.array(found.word_ids, np.int64))
                if len(own) == len(some):
                    lengths.append(own)
                    parts.append(np.array(found.ids, np.uint32))
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter((i for ids in found for i in ids), np.uint32))
        return np.concatenate(lengths), np.concatenate(parts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts, "")
        # the tokenizer lowers letters itself and starts a token where a sign follows a letter; only marks need their case
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, SIGN, r"\1 \2"))
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        per_text = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = sorted((w for w in distinct if w not in self.known), key=str.isalpha)
        if new:
            lengths, ids = self.encoded(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        begins = np.cumsum(self.lengths) - self.lengths
        place = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(begins[place] - (ends - lengths), lengths)
        ends = np.concatenate([[0], ends])
        upto = np.concatenate([[0], np.cumsum(per_text)])
        return self.ids[where], ends[upto[1:]] - ends[upto[:-1]]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a document's ids and a closing 0, cut every `length` ids.

    Null text counts as empty: one piece with the closing 0. Rows with the same doc_id, or a null one, are documents of
    their own. An empty table gives no pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                ids, counts = encoder(part.column("text"))
                rows, begin = [], 0
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[begin : begin + n], 0).astype("<u4")
                    begin += n
                    for k, at in enumerate(range(0, n + 1, length)):
                        piece = own[at : at + length]
                        rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes())))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Tightest:
    """Segment tree over remaining capacities: each leaf holds the open bins with that much room left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least room of at least `need`, taken out, or None; both ways take logarithmic time."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        bin_id = self.bins[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, bin_id


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each length, which come longest first, and the number of bins."""
    tree, bins, offsets, used = Tightest(length), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, bin_id, used = length, used, used + 1
        else:
            room, bin_id = found
        bins.append(bin_id)
        offsets.append(length - room)
        if room > n:
            tree.add(room - n, bin_id)
    return bins, offsets, used


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD, full: float = FULL) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of one shard go longest first, then by doc_id (null first) and piece, to the bin with the least sufficient
    room. Offsets are gapless from 0. Lengths are 1 to `length`. An empty table gives an empty result.
    """
    count = pieces.count()

    def packing(bits: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first", kind="stable")
            bins, offsets, used = best_fit(rows["length"].tolist(), length)
            bins = np.array(bins, np.int64)
            fill = np.bincount(bins, weights=rows["length"], minlength=used)
            return rows.assign(sequence_id=(int(key[0]) << 24 | bins) << 1 | bits, offset=np.array(offsets, np.int64), fill=fill[bins].astype(np.int64))

        return run

    schema = PIECES + ", shard long, sequence_id long, offset long, fill long"
    seed = lambda i: F.xxhash64(F.lit(i), "doc_id", "piece", "ids_crc32")
    dealt = lambda rows, n, i: rows.withColumn("shard", F.pmod(seed(i), F.lit(max(1, -(-n // shard)))))
    first = stored(dealt(pieces, count, 1).groupBy("shard").applyInPandas(packing(0), schema), "packed")
    again = first.filter(F.col("fill") < full * length).select(pieces.columns)
    second = dealt(again, again.count(), 2).groupBy("shard").applyInPandas(packing(1), schema)
    return first.filter(F.col("fill") >= full * length).unionByName(second).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their place; see `token_pieces` and `pack`."""
    return pack(stored(token_pieces(docs, tokenizer, length), "pieces"), length)
