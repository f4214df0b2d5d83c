"""Language identification as multilingual mixture inference.

Each learned language is a distribution over hashed character n-grams, smoothed, counted over all learning documents. A
document is a mixture: each word is drawn from one language, with the product of its n-grams' likelihoods, so that
expectation-maximisation over the words gives the proportions. Languages are then taken out, the least used first, while
the likelihood, less a penalty per language, does not fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyshelf.llm.common import byte_runs, slices

#: cells that n-grams are hashed to, their widths in bytes, and what smooths a cell
CELLS, WIDTHS, SMOOTH = 1 << 15, (2, 3, 4), 0.5
ROUNDS, PENALTY = 6, 3.0
#: a word's log likelihood is held within this distance of its best language
FLOOR = 12.0
BATCH = 1_000_000


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all n-grams of all words, the word of each, and the text of each word.

    Words are runs of letters in lower case, with a blank before and after; grams lie within.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    spaced = pc.utf8_trim(pc.replace_substring_regex(lowered, r"\PL+", " "), " ")
    blank = pa.scalar(" ", pa.large_string())
    framed = pc.binary_join_element_wise(blank, spaced, blank, pa.scalar("", pa.large_string()))
    data, starts = byte_runs(framed)
    blank = data == 32
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1  # after a blank
    word_at = np.zeros(len(data), np.int64)
    word_at[begins] = 1
    word_at = np.cumsum(word_at) - 1
    wide = data.astype(np.uint64) + np.uint64(1)
    cells, words = [], []
    for width in WIDTHS:
        n = len(data) - width + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(width):
            h = h * np.uint64(257) + wide[k : k + n]
            if 0 < k < width - 1:
                inner |= blank[k : k + n]
        # within one word, with a letter
        fit = ~inner & ~(blank[:n] & blank[width - 1 : width - 1 + n])
        place = np.flatnonzero(fit)
        cells.append((mix(h[place] + np.uint64(width << 56)) & np.uint64(CELLS - 1)).astype(np.int64))
        words.append(word_at[np.where(blank[place], place + 1, place)])
    empty = np.zeros(0, np.int64)
    text_of = np.searchsorted(starts, begins, side="right") - 1
    return (np.concatenate(cells), np.concatenate(words), text_of) if cells else (empty, empty, text_of)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, cell, n over all rows of text, lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                cells, words, text_of = word_grams(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)[text_of[words]]
                names = langs.dictionary.to_pylist()
                found = np.bincount(code * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, own in zip(names, found, strict=True):
                    total[name] = total[name] + own if name in total else own
        for name, own in total.items():
            cell = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(own[cell])], ["lang", "cell", "n"])

    return docs.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log likelihood of each cell; one row of cells per language comes to the driver."""
    counts = gram_counts(docs).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    rows = sorted((r["lang"], r["cells"]) for r in counts.collect())
    table = np.full((len(rows), CELLS), SMOOTH)
    for own, (_, cells) in zip(table, rows, strict=True):
        for cell, n in cells:
            own[cell] += n
    return [name for name, _ in rows], np.log(table / table.sum(1, keepdims=True)) if rows else table


def proportions(likelihood: np.ndarray, text_of: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages of each text (texts x languages), and the log likelihoods of the texts.

    likelihood: words x languages, in text order; each text has a word.
    """
    begins = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1]]))
    place = np.cumsum(np.concatenate([[0], (text_of[1:] != text_of[:-1]).astype(np.int64)]))
    n = np.diff(np.append(begins, len(text_of)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        part = likelihood * share[place]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begins, axis=0) / n
    return share, np.add.reduceat(np.log((likelihood * share[place]).sum(1)), begins)


def infer(likelihood: np.ndarray, text_of: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the selected languages of each text: the least used language leaves while that costs less
    likelihood than the penalty."""
    texts = int(text_of[-1]) + 1
    allowed = np.ones((texts, likelihood.shape[1]))
    share, fit = proportions(likelihood, text_of, allowed, rounds)
    open_texts = np.arange(texts)
    while len(open_texts):
        trial = allowed[open_texts].copy()
        least = np.where(trial > 0, share[open_texts], np.inf).argmin(1)
        trial[np.arange(len(trial)), least] = 0
        ok = trial.sum(1) > 0
        open_texts, trial = open_texts[ok], trial[ok]
        if not len(open_texts):
            break
        chosen = np.isin(text_of, open_texts)
        renumbered = np.searchsorted(open_texts, text_of[chosen])
        new_share, new_fit = proportions(likelihood[chosen], renumbered, trial, rounds)
        better = new_fit + penalty >= fit[open_texts]
        open_texts = open_texts[better]
        allowed[open_texts], share[open_texts], fit[open_texts] = trial[better], new_share[better], new_fit[better]
    return share


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture for every row of `docs` (doc_id, text, lang).

    Learned is from rows with text and lang that are not `held_out` (a condition; null counts as not). lang_pred is the
    language with the greatest proportion, the first by code point of equal ones, score its proportion, mixture the
    selected languages with theirs. Null texts, texts without a letter, and all texts if nothing was learned, are `und`
    with score 0. An empty table gives an empty result.
    """
    held = F.coalesce(held_out, F.lit(False))
    names, model = learned(docs.filter(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    table = np.ascontiguousarray(model.T.astype(np.float32))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                langs, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                mixtures: list = [None] * part.num_rows
                cells, words, text_of = word_grams(part.column("text")) if names else (np.zeros(0), np.zeros(0), np.zeros(0))
                if len(text_of):
                    total = np.column_stack([np.bincount(words, weights=own, minlength=len(text_of)) for own in table[cells].T])
                    total -= total.max(1, keepdims=True)
                    seen = np.unique(text_of)
                    share = infer(np.exp(np.maximum(total, -FLOOR)), np.searchsorted(seen, text_of))
                    best = share.argmax(1)
                    scores[seen] = share[np.arange(len(seen)), best]
                    for row, own, k in zip(seen.tolist(), share, best.tolist(), strict=True):
                        langs[row] = names[k]
                        mixtures[row] = [(name, float(x)) for name, x in zip(names, own, strict=True) if x > 0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(np.clip(scores, 0, 1)), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string, double>")
