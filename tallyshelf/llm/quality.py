"""Quality by compressed size.

One zstandard dictionary is trained on windows of good text, one on windows of bad text. Every window of a text is
compressed with both; the difference of the two sizes, by the window's length, says which kind it resembles. The mean,
extremes and shares of these differences over a text, and how well it compresses at all, are calibrated to a score by
logistic regression. Learning texts are measured by dictionaries that have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyshelf.llm.common import byte_runs, slices, stored
from tallyshelf.llm.toxicity import fitted

#: The classifier is fitted on at most so many labelled rows of either kind, those with the least hash of the doc_id.
FIT_ROWS = 4000
#: Dictionaries are trained on at most so many windows of these rows, those with the least hash; 8 MB of either kind.
TRAIN_WINDOWS = 16_384
#: bytes of a window and of a dictionary, the dictionary trainer's segment and gram, and the level
WINDOW, DICTIONARY, SEGMENT, GRAM, LEVEL = 512, 65_536, 256, 8, 3
#: parts of the learning rows; each is measured by dictionaries of the others
FOLDS = 4
#: differences, as parts of the length, that count as leaning to bad text, and as strongly so
LEANING = (0.02, 0.08)
BATCH = 2_000_000


def windows_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Windows of all texts in order, and the number of windows of each; an empty text is one empty window."""
    data, starts = byte_runs(texts)
    whole = data.tobytes()
    sizes = np.diff(starts)
    counts = np.maximum(-(-sizes // WINDOW), 1)
    first = np.cumsum(counts) - counts
    own = np.repeat(np.arange(len(sizes)), counts)
    begin = starts[own] + (np.arange(len(own)) - first[own]) * WINDOW
    end = np.minimum(begin + WINDOW, starts[own + 1])
    return [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], counts


def training_windows(sample: DataFrame) -> list[list[tuple[int, bytes]]]:
    """Fold and bytes of the windows to train on, of bad and of good text, in a fixed order; at most TRAIN_WINDOWS of either."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                windows, counts = windows_of(part.column("text"))
                own = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([part.column("good").take(own), part.column("fold").take(own), pa.array(windows, pa.binary())], ["good", "fold", "window"])

    windows = sample.select("good", "fold", "text").mapInArrow(cut, "good int, fold int, window binary").filter("length(window) > 0")
    chosen = lambda kind: windows.filter(F.col("good") == kind).orderBy(F.xxhash64("window"), "window").limit(TRAIN_WINDOWS)
    return [[(r["fold"], bytes(r["window"])) for r in chosen(kind).collect()] for kind in (0, 1)]


def dictionary(windows: list[bytes]) -> bytes:
    """A dictionary trained on the windows; so little text that none can be trained is the dictionary itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, windows, k=SEGMENT, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b" " * GRAM + b"".join(windows)[-DICTIONARY:]


class Sizes:
    """Statistics of the compressed sizes of texts under the dictionaries of bad and of good text."""

    def __init__(self, bad: bytes, good: bytes):
        import zstandard

        self.compressors = []
        for content in (bad, good):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, texts: pa.Array) -> np.ndarray:
        windows, counts = windows_of(texts)
        if not len(counts):
            return np.zeros((0, 19))
        first = np.cumsum(counts) - counts
        bad, good = (np.fromiter((len(c.compress(w)) for w in windows), float, len(windows)) for c in self.compressors)
        size = np.fromiter(map(len, windows), float, len(windows)) + 8.0
        total = lambda x: np.add.reduceat(x, first)
        apart = (good - bad) / size
        least, whole = np.minimum(good, bad), total(size)
        mean, packed = (total(good) - total(bad)) / whole, np.minimum(total(good), total(bad)) / whole
        length = np.log(whole)
        plain = np.column_stack([mean, np.maximum.reduceat(apart, first), np.minimum.reduceat(apart, first), length, packed, np.minimum.reduceat(least / size, first)])
        leaning = [total((apart > x).astype(float)) for x in LEANING]
        shares = [y for x in leaning for y in (np.log1p(x), x / counts)]
        return np.column_stack([plain, *shares, plain**2, mean * length, packed * length, plain[:, 1] * length])


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, at_least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    `labels` (doc_id, quality) marks rows; of contradicting labels the bad one counts. Learned is from labelled documents
    that are not `held_out` (a condition on doc_id; null counts as not). Texts alone make the score, whole, however long:
    null counts as empty, and empty texts get what an empty text is worth. Equal texts, repeated rows among them, have equal
    scores. Without labelled rows of both kinds the score is the share of good ones, or 0. An empty table gives an
    empty result; other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(False))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    learn = docs.select("doc_id", held.alias("held")).distinct().filter("not held").join(marks, "doc_id")
    learn = stored(learn.select("doc_id", (F.col("quality") > 0).cast("int").alias("good")), "labelled")
    of_kind = {r["good"]: r["n"] for r in learn.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = of_kind.get(1, 0) / sum(of_kind.values()) if of_kind else 0.0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if len(of_kind) < 2:
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= at_least)).alias("predicted"))
    first = lambda kind: learn.filter(F.col("good") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most twice fit_rows ids
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")  # equal texts are in one
    sample = stored(docs.select("doc_id", "text", fold.alias("fold")).join(chosen, "doc_id").select("text", "fold", "good"), "sample")
    windows = training_windows(sample)
    contents = tuple(dictionary([w for _, w in own]) for own in windows)
    # a fold that leaves nothing of a kind is measured by all
    others = [[[w for f, w in own if f != fold] for own in windows] for fold in range(FOLDS)]
    of_fold = [tuple(map(dictionary, own)) if all(own) else contents for own in others]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [Sizes(*c) for c in of_fold]
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                for part in slices(batch.filter(pa.array(folds == f)), "text", BATCH):
                    x = sizes[f].features(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(list(x), pa.list_(pa.float64()))], ["good", "x"])

    seen = sample.mapInArrow(measure, "good int, x array<double>").collect()  # at most twice fit_rows documents
    seen.sort(key=lambda r: (r["good"], r["x"]))
    y = np.array([r["good"] for r in seen], float)
    weight = np.where(y > 0, of_kind[1] / y.sum(), of_kind[0] / (len(y) - y.sum()))
    model = fitted(np.array([r["x"] for r in seen]), y, weight * len(y) / weight.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, (mean, scale, w) = Sizes(*contents), model
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                x = (sizes.features(part.column("text")) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= at_least).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
