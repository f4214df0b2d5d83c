"""Secrets: fixed patterns, and password guess cost for values in a credential's context.

The guess cost of a value is the least cost of any way to cut it into words, dates, repeats, runs, keyboard walks and spans
that only trying all characters finds, by dynamic programming over its positions. A word costs its rank: frequent passwords
come first, then words in the order of a public vocabulary and, as far as they rank better, of their frequency in the
corpus, where values in a credential's context do not count. Values that would take more guesses than the bound are
reported.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyshelf.llm.common import slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer fails, so that no shorter match can matter
#: a credential's name, which may end a longer one, a separator and its value
CONTEXT = re.compile(
    r"""(?i:(?:pass(?:word|wd|phrase|code)|pwd|secret|(?:auth|access|refresh|bearer)?_?token|(?:api|access|private|secret)[_-]?key|credentials?|client[_-]?secret))["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\s"'<>,;]+)""",
    re.ASCII,
)
#: log10 of the guesses from which a value counts as a secret, and its least length
BOUND, SHORTEST = 8.0, 6

# Frequent passwords and words in them, most frequent first.
WORDS = """password 123456 qwerty admin welcome letmein login user test guest master secret default changeme root abc123
dragon monkey football baseball iloveyou sunshine princess shadow superman michael jordan summer winter spring autumn
love hello freedom whatever trustno starwars computer internet access server example sample company service account
system manager public private database token key pass the and for you with this that not from your""".split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Letters that signs and digits stand for.
LEET = str.maketrans("43105$7@", "aeiossta")

#: words of vocabulary and corpus: least and greatest length, and how many of the corpus are ranked (half a megabyte)
WORD_LENGTHS, CORPUS_WORDS = (4, 20), 1 << 15
BATCH = 4_000_000

RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(max(map(len, WORDS)), WORD_LENGTHS[1])
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,16}?)\1+")


def _neighbours() -> dict[str, str]:
    near = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            around = [ROWS[v][u] for v in (y - 1, y, y + 1) if 0 <= v < len(ROWS) for u in (x - 1, x, x + 1) if 0 <= u < len(ROWS[v])]
            near[c] = "".join(around).replace(c, "")
    return near


NEAR = _neighbours()


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a tokenizer file whose tokens say where a word ends, in the order of their ids, so frequent ones first."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    words = ((i, t.removesuffix("</w>")) for t, i in tokens.items() if t.endswith("</w>"))
    return [w for _, w in sorted(words) if w.isalpha() and WORD_LENGTHS[0] <= len(w) <= WORD_LENGTHS[1]]


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The most frequent words of all texts in ASCII letters, values in a credential's context left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                texts = [t if t is None or not (":" in t or "=" in t) else CONTEXT.sub(" ", t) for t in part.column("text").to_pylist()]
                letters = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")), "[^a-z]+", " ")
                words = pc.ascii_split_whitespace(letters).flatten()
                length = pc.binary_length(words)
                fit = pc.and_(pc.greater_equal(length, WORD_LENGTHS[0]), pc.less_equal(length, WORD_LENGTHS[1]))
                seen = words.filter(fit).value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()), seen.field("counts")], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def ranked(*lists: list[str]) -> dict[str, int]:
    """The best rank of each word, after the frequent passwords."""
    ranks = dict(RANKS)
    for words in lists:
        for i, word in enumerate(words, len(WORDS) + 1):
            ranks[word] = min(i, ranks.get(word, i))
    return ranks


def segments(value: str, depth: int = 0, ranks: dict[str, int] = RANKS) -> Iterator[tuple[int, int, float]]:
    """begin, end and cost (log10 of guesses) of what is cheaper than trying all characters."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j]) or 2 * ranks.get(plain[i:j], 0)
            if rank:
                yield i, j, math.log10(rank + 1) + 0.3 * (value[i:j] != low[i:j])
        if (found := DATE.match(value, i)) is not None:
            yield i, found.end(), math.log10(365 * 120 if found.end() - i > 4 else 120)
    for found in REPEAT.finditer(value) if depth == 0 else ():
        if found.end() - found.start() >= 3:
            yield *found.span(), guess_cost(found[1], 1, ranks) + math.log10((found.end() - found.start()) // len(found[1]))
    i = 0
    while i < n - 2:  # runs: letters or digits in steps of one
        step = ord(value[i + 1]) - ord(value[i])
        j = i + 2
        while j < n and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if step in (1, -1) and j - i >= 3:
            yield i, j, math.log10(26 * (j - i))
        i = j - 1
    i = 0
    while i < n - 2:  # keyboard walks
        j, turns, last = i + 1, 1, None
        while j < n and low[j] in NEAR.get(low[j - 1], ""):
            way = ord(low[j]) - ord(low[j - 1])
            turns += last is not None and way != last
            last, j = way, j + 1
        if j - i >= 3:
            yield i, j, math.log10(47 * (j - i)) + turns * 0.6
        i = max(j - 1, i + 1)


def guess_cost(value: str, depth: int = 0, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses that the cheapest segmentation takes; a character alone takes ten."""
    best = [0.0] + [math.inf] * len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, depth, ranks):
        ending.setdefault(j, []).append((i, cost))
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + 1
        for i, cost in ending.get(j, ()):
            best[j] = min(best[j], best[i] + cost + (0.3 if i else 0))
    return best[-1]


def find_secrets(text: str, ranks: dict[str, int] = RANKS) -> list[tuple[int, int, int]]:
    """start, kind and end (exclusive, in code points) of all secrets of a text, by start and kind."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans.sort()
        starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            end = start + len(m[1].rstrip(".!?)]}:"))
            before = bisect_left(starts, end)
            # a base span that reaches as far covers the value already; one that ends inside it does not
            beyond = not before or reach[before - 1] < end
            if beyond and end - start >= SHORTEST and guess_cost(text[start:end], ranks=ranks) >= BOUND:
                spans.append((start, 3, end))
    return sorted(spans)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, found for every row of `docs` (doc_id, text).

    found holds kind, start, end and text of each span; spans joins kind:start:end by start and kind; base_sha256 is of
    those without `guess`. `vocabulary` is the path of a tokenizer file for words (see `vocabulary_words`); the corpus's own
    words are counted in any case. Null text counts as empty and holds nothing, very long texts are read whole, repeated
    rows and ids give rows of their own. An empty table gives an empty result; other columns are not read.
    """
    ranks = ranked(vocabulary_words(vocabulary) if vocabulary else [], corpus_words(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = find_secrets(text, ranks)
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
                base = ",".join(n for n, (_, k, _) in zip(named, spans, strict=True) if k < 3)
                counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                found = [{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in spans]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(named), found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint, text: string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)
