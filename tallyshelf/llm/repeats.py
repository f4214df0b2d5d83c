"""Repeated passages: windows grouped by hashes, in passes that narrow the groups down.

A byte string of `length` that starts at two places is a window of each. A radix sort of suffixes would group equal windows
digit by digit; here each pass groups by a hash instead, so that neighbouring windows travel together as long as they
agree, and drops what is alone in its group. Every window is led by its smallest gram
(the least hash among its 48-byte grams, the leftmost of equal ones), and neighbouring windows with the same gram form a
run. Equal windows have equal leading grams at the same offset, so the passes are:

1. the gram: runs whose gram leads no other run are alone, and so are all their windows;
2. the run as a whole (all bytes of its windows): equal runs are repeated in all their windows at once;
3. for grams that lead different runs, one run of each kind is cut into blocks of 16 windows, by their offset to the gram: a
   block whose core (the bytes all its windows share) no other block has is alone; blocks that are equal as a whole are
   repeated at once;
4. for cores of different blocks, the windows themselves.

Places of documents are known by doc_id and a hash of the text. Polynomial hashes only lead what may be equal together;
what counts as equal has the same 64-bit xxh3 of all its bytes within such a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyshelf.llm.common import byte_runs, side, slices, stored

LENGTH = 400
GRAM = 48
#: windows of a block
BLOCK = 16
#: bytes a task hashes at a time
BATCH, SEGMENT = 4_000_000, 1 << 17
#: rows a task hands over at a time
ROWS = 200_000
#: the bits of a ranked hash that hold a place within a segment
PLACE = np.uint64((1 << 21) - 1)

RUNS = "id long, text_hash long, start int, n int, lead int, gram long, whole long"
BLOCKS = "id long, text_hash long, start int, n int, single boolean, core long, whole long"
WINDOWS = "id long, text_hash long, start int, single boolean, core long, whole long"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Hasher:
    """Polynomial hashes modulo 2**64 of stretches of up to `most` bytes, from prefix sums."""

    def __init__(self, seed: int, most: int):
        draw = np.random.default_rng(seed)
        base = int(draw.integers(1, 2**62)) * 2 + 1
        self.values = draw.integers(0, 2**64 - 1, 256, dtype=np.uint64)
        self.powers, self.back = self._powers(base, most), self._powers(pow(base, -1, 2**64), most)

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        powers = np.full(most + 1, base, np.uint64)
        powers[0] = 1
        return np.cumprod(powers)

    def sums(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.values[data]
        terms *= self.powers[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return sums

    def every(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all stretches of one width."""
        h = sums[width:] - sums[:-width]
        h *= self.back[: len(h)]
        return mixed(h)

    def some(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[begin]) * self.back[begin])


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the bytes of stretches; with polynomials modulo 2**64 some unequal stretches would be equal for any base."""
    view = memoryview(np.ascontiguousarray(data))
    places = zip(begin.tolist(), end.tolist(), seeds.tolist() if seeds is not None else [0] * len(begin), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b, seed in places), np.uint64, len(begin)).view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each stretch of `width` lies, by its upper 43 bits, the leftmost of equal ones."""
    n = len(values)
    blocks = -(-n // width)
    ranked = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(values, ~PLACE, out=ranked[:n])
    ranked[:n] |= np.arange(n, dtype=np.uint64)
    grid = ranked.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return (np.minimum(back[:m], upto[width - 1 : width - 1 + m]) & PLACE).astype(np.int64)


def segments(starts: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last row, begin and end of stretches of bytes to hash at once: some whole texts, or a part of one; parts
    overlap by length - 1, so that every window is in exactly one."""
    rows, i = len(starts) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT, side="right")) - 1)
        if starts[j] - starts[i] <= SEGMENT:
            yield i, j, int(starts[i]), int(starts[j])
        else:
            j = i + 1
            for at in range(int(starts[i]), int(starts[j]) - length + 1, SEGMENT - length + 1):
                yield i, j, at, min(int(starts[j]), at + SEGMENT)
        i = j


def windows_in(starts: np.ndarray, i: int, j: int, begin: int, end: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each window start of a segment, and whether the window lies within its row."""
    at = np.arange(begin, end - length + 1)
    row = np.repeat(np.arange(i, j), np.diff(np.clip(starts[i : j + 1], begin, end)))[: len(at)]
    return row, at + length <= starts[row + 1]


def runs_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, start, n, lead (offset of the gram to the first window), gram hash and hash of all bytes of the runs of many texts."""
    hasher = hashing()
    found = [tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64))]
    for i, j, begin, end in segments(starts, length):
        if end - begin < length:
            continue
        sums = hasher.sums(data[begin:end])
        grams = hasher.every(sums, gram)
        leads = leftmost_minima(grams, length - gram + 1)
        row, within = windows_in(starts, i, j, begin, end, length)
        new = np.ones(len(leads), bool)
        new[1:] = (leads[1:] != leads[:-1]) | (row[1:] != row[:-1]) | ~within[:-1]
        at = np.flatnonzero(new)
        count = np.add.reduceat(within.astype(np.int64), at)
        at, n = at[within[at]], count[within[at]]
        found.append((
            row[at], (at + begin - starts[row[at]]).astype(np.int32), n.astype(np.int32), (leads[at] - at).astype(np.int32),
            grams[leads[at]].view(np.int64), digests(data, at + begin, at + begin + n - 1 + length),
        ))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


_HASHER: list[Hasher] = []


def hashing() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher(1, SEGMENT))
    return _HASHER[0]


def places(docs: DataFrame) -> DataFrame:
    """id (null as -1), text_hash, doc_id, text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), F.xxhash64(text).alias("text_hash"), "doc_id", text.alias("text"))


def all_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per run of windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                data, starts = byte_runs(part.column("text"))
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_hash"))
                row, *found = runs_of(data, starts, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[row], hashes[row], *found)], [c.split()[0] for c in RUNS.split(", ")])

    return places(docs).select("id", "text_hash", "text").mapInArrow(find, RUNS)


def settled(table: DataFrame, outer: str, inner: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One pass over stretches (id, text_hash, start, n, single): equal in `outer` is a group, equal in `inner` too a kind.

    Gives the single ones whose kind occurs more than once, and one of each kind of the groups that have several kinds, as
    long as a single one is among them; these stay single if their kind occurs once.
    """
    place = ("id", "text_hash", "start", "n", *more)
    kinds = table.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("c"), F.max("single").alias("any"), *[F.first(x).alias(x) for x in place])
    kinds = stored(kinds.withColumn("single", F.col("any") & (F.col("c") == 1)).drop("any"), "kinds")
    repeated = table.filter("single").join(kinds.filter("c > 1").select(outer, inner), [outer, inner], "left_semi")
    repeated = stored(repeated.select("id", "text_hash", "start", "n"), "repeated")
    groups = side(kinds.groupBy(outer).agg(F.count(F.lit(1)).alias("kinds"), F.max("single").alias("open")).filter("kinds > 1 and open").select(outer))
    return repeated, kinds.join(groups, outer, "left_semi").select(*place, "single", outer)


def expanded(docs: DataFrame, chosen: DataFrame, cut, schema: str) -> DataFrame:
    """What `cut` makes of each chosen stretch (a struct) and the bytes of its text: columns after id and text_hash."""
    names = [c.split()[0] for c in schema.split(", ")]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                data, starts = byte_runs(part.column("text"))
                found, rows, size = [], [], 0
                lists = part.column("own").to_pylist()
                for i, own in enumerate(lists):
                    for stretch in own:
                        found.append(cut(data[starts[i] : starts[i + 1]], stretch))
                        rows.append(np.full(len(found[-1][0]), i))
                        size += len(rows[-1])
                    if found and (size >= ROWS or i == len(lists) - 1):
                        row = np.concatenate(rows)
                        ids = [part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "text_hash")]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, *map(np.concatenate, zip(*found, strict=True)))], names)
                        found, rows, size = [], [], 0

    own = [c for c in chosen.columns if c not in ("id", "text_hash")]
    lists = chosen.groupBy("id", "text_hash").agg(F.collect_list(F.struct(*own)).alias("own"))
    return places(docs).join(lists, ["id", "text_hash"]).select("id", "text_hash", "text", "own").mapInArrow(expand, schema)


def blocks_of(text: np.ndarray, run: dict, length: int) -> tuple[np.ndarray, ...]:
    """start, n, single, core and whole of the blocks of a run."""
    start, n, lead = run["start"], run["n"], run["lead"]
    hasher = hashing()
    b = np.arange((lead - n + 1) // BLOCK, lead // BLOCK + 1)[::-1]
    last = start + lead - b * BLOCK  # the window of the block's least offset, where its core begins
    low, high = np.maximum(last - BLOCK + 1, start), np.minimum(last, start + n - 1)
    sums = hasher.sums(text[start : start + n - 1 + length])
    core = hasher.some(sums, last - start, last - BLOCK + 1 + length - start)
    core = mixed(core ^ mixed(b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([run["gram"]]).view(np.uint64)))
    whole = digests(text, low, high + length, high - low + BLOCK * (last - low))
    return low.astype(np.int32), (high - low + 1).astype(np.int32), np.full(len(b), run["single"]), core.view(np.int64), whole


def windows_of(text: np.ndarray, block: dict, length: int) -> tuple[np.ndarray, ...]:
    """start, single, core and hash of the windows of a block."""
    start, n = block["start"], block["n"]
    at = np.arange(start, start + n, dtype=np.int32)
    return at, np.full(n, block["single"]), np.full(n, block["core"]), digests(text, at, at + length)


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, text_hash, start, n: stretches of n neighbouring window starts whose windows occur more than once."""
    runs = stored(all_runs(docs, length, gram), "runs")
    again = side(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"))
    runs = stored(runs.join(again, "gram", "left_semi").withColumn("single", F.lit(True)), "led")
    whole_runs, chosen = settled(runs, "gram", "whole", ("lead",))
    blocks = stored(expanded(docs, chosen, lambda text, run: blocks_of(text, run, length), BLOCKS), "blocks")
    whole_blocks, chosen = settled(blocks, "core", "whole")
    windows = expanded(docs, chosen, lambda text, block: windows_of(text, block, length), WINDOWS)
    equal = windows.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core", "whole")
    met = windows.filter("single").join(equal, ["core", "whole"], "left_semi")
    return whole_runs.unionByName(whole_blocks).unionByName(met.select("id", "text_hash", "start", F.lit(1).alias("n")))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of `docs` (doc_id, text).

    Removed is every byte of the UTF-8 text that a string of `length` bytes covers which also starts elsewhere, in any
    document or the same one; overlapping places count, and all strings are judged on the input. Null text counts as
    empty, shorter texts stay whole, repeated rows are repeats of each other. An empty table gives an empty result.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                data, starts = byte_runs(part.column("text"))
                rows = []
                for i, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    own = data[begin:end]
                    start, n = (part.column(c)[i].values for c in ("starts", "counts"))
                    if start is None or not len(start):
                        rows.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                        continue
                    start, n = start.to_numpy(), n.to_numpy()
                    edges = np.bincount(start, minlength=len(own) + 1) - np.bincount(start + n - 1 + length, minlength=len(own) + 1)
                    gone = np.cumsum(edges[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(own), int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], [c.split()[0] for c in KEPT.split(", ")])

    # equal rows have equal spans, each of them counted once
    spans = repeated_windows(docs, length, gram).distinct().groupBy("id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    rows = places(docs).join(spans, ["id", "text_hash"], "left").select(F.col("doc_id").cast("long"), "text", "starts", "counts")
    return rows.mapInArrow(remove, KEPT)
