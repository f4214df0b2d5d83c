"""Toxicity by compression distance.

Three zstandard dictionaries of raw content are made from learning text: all hold frequent words of ordinary text, one
also the strings that mark toxic text best, one all strings and word pairs that occur more often in toxic text, as far as
zstandard's dictionary size goes, and one further ordinary words. A window is a word, between two frames that all
dictionaries know; two words in a row are one too where the dictionary lists them as a pair. How long a window gets
with the toxic dictionary, and how much longer with the ordinary one, sorts the windows of a text; a logistic regression
calibrates the counts above the thresholds of both. It is fitted on counts by dictionaries of the other
learning rows, as a text's own rare words tell nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyshelf.llm.common import byte_runs, slices, stored

#: The classifier is fitted on at most so many labelled rows of either kind, those with the least hash of the doc_id.
FIT_ROWS = 4000
#: strings in the toxic part, words in the part that both dictionaries share, and in the ordinary part
TOXIC_STRINGS, SHARED_WORDS, ORDINARY_WORDS = 80, 2000, 100
#: letters of a gram, the least number of documents and the least weight that make one a mark of toxic text
GRAM, MARK_DOCS, MARK_WEIGHT = 6, 4, 12.0
#: grams that the strings are made of
MARKS = 1000
#: the least number of toxic documents, and the least weight, of what goes into the dictionary of all marks: what repeats,
#: and is e^4 times as likely in toxic text as chance would have it, however many the learning rows
TERM_DOCS, TERM_WEIGHT = 2, 4.0
#: bytes of that dictionary's strings and pairs: zstandard's own bound for a dictionary
DICTIONARY = 112_640
#: parts of the learning rows; each is measured by dictionaries of the others
FOLDS = 5
#: longest window; longer words are several
WIDEST = 64
FRAME = b" of and the in that with is for "
LEVEL = 9
#: thresholds of the length (in steps of two bytes) and of the difference
LENGTHS, GAINS = 5, 7
BATCH, REMEMBERED = 2_000_000, 500_000
SIGN = r"(\pL)([^\pL\pN\s]+)"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text; signs after a letter are words of their own. Null has none."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, SIGN, r"\1 \2"))
    return words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words


def pairs_of(own: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """text and window of each two words in a row; a text of one word has it as its window."""
    real = np.asarray(pc.not_equal(words, ""), bool)
    own, words = own[real], words.filter(pa.array(real))
    starts = np.append(own[1:] == own[:-1], False) if len(own) else np.zeros(0, bool)
    lone = ~starts & np.append(True, ~starts[:-1])[: len(own)]
    place = np.flatnonzero(starts)
    pairs = pc.binary_join_element_wise(words.take(pa.array(place)), words.take(pa.array(place + 1)), pa.scalar(" ", words.type))
    return np.concatenate([own[place], own[lone]]), pa.concat_arrays([pairs, words.filter(pa.array(lone))])


def term_frequencies(sample: DataFrame) -> DataFrame:
    """term, pair, fold, toxic documents and ordinary documents of a labelled sample (text, toxic, fold)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                words = words_of(part.column("text"))
                toxic, fold = (part.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "fold"))
                own = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
                for pair, (texts, terms) in enumerate(((own, words.flatten()), pairs_of(own, words.flatten()))):
                    seen = pa.table({"d": texts, "w": terms}).group_by(["d", "w"]).aggregate([])
                    d = seen["d"].to_numpy()
                    found = pa.table({"w": seen["w"], "f": fold[d], "t": toxic[d], "o": 1 - toxic[d]}).group_by(["w", "f"]).aggregate([("t", "sum"), ("o", "sum")])
                    columns = [found["w"].combine_chunks().cast(pa.string()), pa.array(np.full(len(found), pair, bool)), *(found[c].combine_chunks() for c in ("f", "t_sum", "o_sum"))]
                    yield pa.RecordBatch.from_arrays(columns, ["term", "pair", "fold", "toxic", "ordinary"])

    counted = sample.select("text", F.col("toxic").cast("long").alias("toxic"), F.col("fold").cast("long").alias("fold"))
    counted = counted.mapInArrow(count, "term string, pair boolean, fold long, toxic long, ordinary long")
    return counted.filter("term <> ''").groupBy("term", "pair", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, and t and o, the toxic and ordinary documents of the words that hold it."""
    framed = F.concat(F.lit(" "), F.col("term"), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (GRAM - 1), F.lit(1)))
    grams = words.select("toxic", "ordinary", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(framed, i, GRAM)))).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))


def marking(counts: DataFrame, toxic_docs: int, ordinary_docs: int, docs: int, least: float, most: int) -> dict[str, float]:
    """The grams or pairs that tell toxic text best, with the log ratio of the two shares times the toxic documents."""
    weight = F.col("t") * F.log((F.col("t") / toxic_docs) / ((F.col("o") + 0.5) / ordinary_docs))
    marks = counts.filter(F.col("t") >= docs).select("gram", weight.alias("weight")).filter(F.col("weight") >= least)
    return {r["gram"]: r["weight"] for r in marks.orderBy(F.desc("weight"), "gram").limit(most).collect()}


def fitting(strings: list[str], size: int) -> list[str]:
    """The first strings, as many as `size` bytes hold with a byte between them."""
    ends = np.cumsum([len(x.encode()) + 1 for x in strings])
    return strings[: int(np.searchsorted(ends, size, side="right"))]


def dictionaries(terms: DataFrame, toxic_docs: int, ordinary_docs: int) -> tuple[bytes, bytes, bytes]:
    """Contents of the dictionaries of the best toxic strings, of all toxic strings and pairs, and of ordinary words.

    terms: term, pair, toxic, ordinary. What is collected for a dictionary is at most as many strings as it has bytes.
    """
    words = terms.filter("not pair")
    grams = stored(gram_counts(words.filter("toxic > 0 or ordinary > 0")), "grams")
    best = toxic_strings(marking(grams, toxic_docs, ordinary_docs, MARK_DOCS, MARK_WEIGHT, MARKS), TOXIC_STRINGS)
    some = toxic_strings(marking(grams, toxic_docs, ordinary_docs, TERM_DOCS, TERM_WEIGHT, DICTIONARY), DICTIONARY)
    counts = terms.filter("pair").select(F.col("term").alias("gram"), F.col("toxic").alias("t"), F.col("ordinary").alias("o"))
    pairs = list(marking(counts, toxic_docs, ordinary_docs, TERM_DOCS, TERM_WEIGHT, DICTIONARY))
    some = fitting(pairs, max(DICTIONARY // 2, DICTIONARY - sum(len(x.encode()) + 1 for x in some))) + some
    some = fitting(some, DICTIONARY)
    common = [r["term"] for r in words.filter("ordinary > 0").orderBy(F.desc("ordinary"), "term").limit(SHARED_WORDS + ORDINARY_WORDS).collect()]
    shared = " ".join(common[:SHARED_WORDS][::-1]).encode() + FRAME
    best, some = ("\n".join(strings[::-1]).encode() + b"\n" + shared for strings in (best, some))
    return best, some, " ".join(common[SHARED_WORDS:]).encode() + b" " + shared


def toxic_strings(marks: dict[str, float], most: int) -> list[str]:
    """Strings that overlapping grams make up, the best first.

    A gram is continued on either side by the best gram that overlaps with all but one of its letters, as long as that
    weighs at least half as much; what follows a stem is left out, as ordinary words hold it too.
    """
    after, before, used, out = {}, {}, set(), []
    for gram in marks:  # best first
        after.setdefault(gram[:-1], []).append(gram)
        before.setdefault(gram[1:], []).append(gram)
    for gram, weight in marks.items():
        if len(out) == most:
            break
        if gram in used:
            continue
        text = gram
        used.add(gram)
        for on_right, following in ((True, after), (False, before)):
            while True:
                edge = text[-(len(gram) - 1) :] if on_right else text[: len(gram) - 1]
                more = next((g for g in following.get(edge, ()) if g not in used and marks[g] >= weight / 2), None)
                if more is None:
                    break
                used.add(more)
                text = text + more[-1] if on_right else more[0] + text
        out.append(text)
    return out


def byte_grams(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on, as numbers."""
    n = max(len(data) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


class Windows:
    """Compressed lengths of windows under the two dictionaries, as a cell of length and gain, or -1 without gain.

    Only windows that hold GRAM bytes of a string that the toxic dictionary has alone, or are a pair of words that it has
    alone, are compressed: what others could gain is an accident of shorter matches.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        own = toxic[: toxic.rfind(b"\n") + 1]  # what is shared is one line, the last
        lines = own.split(b"\n")
        pairs = [line for line in lines if b" " in line.strip()]  # strings have blanks at their ends alone
        self.pairs = pa.array([line.decode() for line in pairs], pa.large_string())
        strings = b"\n".join(line for line in lines if b" " not in line.strip())
        self.grams = np.unique(byte_grams(np.frombuffer(strings, np.uint8)))
        self.marked = np.zeros(1 << 20, bool)
        self.marked[self.place(self.grams)] = True
        self.compressors = []
        for content in (toxic, ordinary):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False))
        self.bare = len(self.compressors[0].compress(FRAME + FRAME))
        self.known: dict[str, int] = {}

    def place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def touched(self, windows: pa.Array) -> np.ndarray:
        """Which windows, with a blank before and after, hold GRAM bytes of a toxic string or are a toxic pair."""
        blank, windows = pa.scalar(" ", pa.large_string()), windows.cast(pa.large_string())
        data, starts = byte_runs(pc.binary_join_element_wise(blank, windows, blank, pa.scalar("", pa.large_string())))
        grams = byte_grams(data)
        hits = np.flatnonzero(self.marked[self.place(grams)])
        hits = hits[np.isin(grams[hits], self.grams)]
        window = np.searchsorted(starts, hits, side="right") - 1
        out = np.asarray(pc.is_in(windows, value_set=self.pairs), bool) if len(self.pairs) else np.zeros(len(windows), bool)
        out[window[hits + GRAM <= starts[window + 1]]] = True
        return out

    def cell(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            window = FRAME + word.encode() + FRAME
            toxic, ordinary = (len(c.compress(window)) for c in self.compressors)
            gain = ordinary - toxic
            length = min(max((toxic - self.bare - 1) // 2, 0), LENGTHS - 1)
            found = self.known[word] = length * GAINS + min(gain, GAINS) - 1 if gain > 0 else -1
        return found

    def features(self, own: np.ndarray, windows: pa.Array, texts: int) -> np.ndarray:
        """Per text: logarithms of the number, and of the share, of windows beyond each pair of thresholds; and the size."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        n = (np.bincount(own, minlength=texts) + 1.0)[:, None]
        coded = windows.dictionary_encode()
        distinct = coded.dictionary
        cells, pieces = np.full(len(distinct), -1), []
        place = np.flatnonzero(self.touched(distinct))
        for k, word in zip(place.tolist(), distinct.take(pa.array(place)).to_pylist(), strict=True):
            if len(word) > WIDEST:  # a long word is several windows
                pieces.append((k, np.array([self.cell(word[i : i + WIDEST]) for i in range(0, len(word), WIDEST)])))
            else:
                cells[k] = self.cell(word)
        size = LENGTHS * GAINS
        index = coded.indices.to_numpy(zero_copy_only=False)
        cell = cells[index] if len(index) else np.zeros(0, np.int64)
        hit = cell >= 0
        counts = np.bincount(own[hit] * size + cell[hit], minlength=texts * size)
        for place, many in pieces:
            for row in own[index == place]:
                np.add.at(counts, row * size + many[many >= 0], 1)
        counts = counts.reshape(texts, LENGTHS, GAINS)
        beyond = counts[:, :, ::-1].cumsum(2)[:, :, ::-1].cumsum(1).reshape(texts, size)
        return np.hstack([np.log1p(beyond), np.log(n), np.log1p(300 * beyond / n)])


class Measures:
    """Features of texts by words under the best strings, and by words and toxic pairs of words under all marks."""

    def __init__(self, best: bytes, some: bytes, ordinary: bytes):
        self.best, self.some = Windows(best, ordinary), Windows(some, ordinary)

    def features(self, texts: pa.Array) -> np.ndarray:
        words = words_of(texts)
        own = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        flat = words.flatten()
        of_pair, pairs = pairs_of(own, flat)
        toxic = pc.is_in(pairs, value_set=self.some.pairs)
        of_pair, pairs = of_pair[np.asarray(toxic, bool)], pairs.filter(toxic)
        some = np.concatenate([own, of_pair]), pa.concat_arrays([flat, pairs])
        return np.hstack([self.best.features(own, flat, len(words)), self.some.features(*some, len(words))])


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients of a weighted logistic regression."""
    mean, scale = np.average(x, 0, weight), x.std(0) + 0.01
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, at_least: float = 0.3, fit_rows: int = FIT_ROWS, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text); with `carry` the whole row too, as `row`.

    `labels` (doc_id, toxic) marks rows; of contradicting labels toxic counts. Learned is from labelled documents that
    are not `held_out` (a condition on doc_id; null counts as not). Texts alone make the score: null counts as empty,
    and empty texts get what an empty text is worth. Without labelled rows of both kinds the score is the share of toxic ones,
    or 0. Equal texts have equal scores. An empty table gives an empty result.
    """
    held = F.coalesce(held_out, F.lit(False))
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = stored(docs.select("doc_id", held.alias("held")).distinct().filter("not held").join(marks, "doc_id").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")
    of_kind = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(of_kind.values())
    share = of_kind.get(1, 0) / total if total else 0.0
    result = T.StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int")
    rows = docs.select(F.struct(*docs.columns if carry else ("doc_id", "text")).alias("row"), F.col("doc_id").cast("long"), held.alias("held_out"))
    if len(of_kind) < 2:
        more = ["row"] if carry else []
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= at_least)).alias("predicted"), *more)
    if carry:
        result = result.add("row", rows.schema["row"].dataType)
    first = lambda kind: learn.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most twice fit_rows ids
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")  # equal texts are in one
    sample = stored(docs.select("doc_id", "text", fold.alias("fold")).join(chosen, "doc_id"), "sample")
    terms = stored(term_frequencies(sample), "terms")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {kind: sum(v for (_, k), v in sizes.items() if k == kind) for kind in (0, 1)}

    def without(left_out: int | None) -> tuple[bytes, bytes, bytes]:
        held = {kind: n[kind] - sizes.get((left_out, kind), 0) for kind in n}
        own = terms.filter(F.col("fold") != left_out) if left_out is not None else terms
        return dictionaries(own.groupBy("term", "pair").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), held[1], held[0])

    contents = without(None)
    divided = all(sizes.get((f, kind)) for f in range(FOLDS) for kind in n)  # else each text is measured by its own
    of_fold = [without(f) if divided else contents for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = [Measures(*c) for c in of_fold]
        for batch in batches:
            for f in range(FOLDS):
                for part in slices(batch.filter(pc.equal(batch.column("fold"), f)), "text", BATCH):
                    found = measures[f].features(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(found), pa.list_(pa.float64()))], ["toxic", "x"])

    seen = sample.select("toxic", "fold", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in seen], float)
    weight = np.where(y > 0, of_kind[1] / n[1], of_kind[0] / n[0])
    model = fitted(np.array([r["x"] for r in seen]), y, weight * len(y) / weight.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, (mean, scale, w) = Measures(*contents), model
        for batch in batches:
            batch = batch.append_column("text", pc.struct_field(batch.column("row"), "text"))
            for part in slices(batch, "text", BATCH):
                x = (measures.features(part.column("text")) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= at_least).astype(np.int32)), part.column("row")]
                names = ["doc_id", "held_out", "score", "predicted", "row"]
                yield pa.RecordBatch.from_arrays(columns[: 4 + carry], names[: 4 + carry])

    return rows.mapInArrow(score, result)
