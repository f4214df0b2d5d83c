"""Whitening against numpy, quality on texts made for it, importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import importance, quality, whitening
from tallyshelf.llm.common import held_out

DOC = "doc_id long, text string"
VEC = "vec_id long, embedding array<float>"


# whitening


def plain_whitening(rows, components):
    """vec_id, deviation and the whitened rows, with the shares of the components."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(1).tolist(), c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("rank", [12, 4])
def test_whitening_equals_the_eigenvectors(table, rank):
    r = np.random.default_rng(rank)
    v = (r.normal(size=(300, rank)) @ r.normal(size=(rank, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("-inf")] * 12), (5, rows[6][1]), (None, rows[7][1])]
    got = whitening.whiten(table(VEC, rows), 8).collect()
    ids, deviation, want, explained = plain_whitening(rows, 8)
    assert len(got) == want.size and {r.n for r in got} == {len(ids)}
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == Counter(zip(ids, deviation, strict=True))
    by = {(r.vec_id, r.component): r for r in got if r.vec_id not in (5, None)}
    signs = [np.sign(by[0, k + 1].whitened * want[0, k]) for k in range(want.shape[1])]
    for row, i in enumerate(ids):
        if i not in (5, None):
            assert [by[i, k + 1].whitened * signs[k] for k in range(want.shape[1])] == pytest.approx(list(want[row]), abs=1e-6)
    assert [by[0, k + 1].explained for k in range(want.shape[1])] == pytest.approx(list(explained), rel=1e-6)
    assert all(r.identity_error < 1e-6 for r in got)


def test_whitening_of_odd_tables(table):
    assert whitening.whiten(table(VEC, [])).count() == 0
    assert whitening.whiten(table(VEC, [(1, None), (2, []), (3, [1e30, 0.0])])).count() == 0
    assert whitening.whiten(table(VEC, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance
    two = whitening.whiten(table(VEC, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [5.0]), (4, [6.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.n) for r in two) == [(1, 1, 1.0, 2), (2, 1, 1.0, 2), (3, 1, 1.0, 2), (4, 1, 1.0, 2)]
    # the other component is less than rounding
    great = whitening.whiten(table(VEC, [(i, [float(2**33 * (-1) ** i), float(i)]) for i in range(6)])).collect()
    assert len(great) == 6 and all(r.deviation > 2**63 for r in great) and great[0].identity_error < 1e-6


def test_inertia_counts_and_leading_eigenvalues():
    r = np.random.default_rng(1)
    for e in ([5, 4, 3, 2, 1], [3, 3, 3, 1, 0], [1, 1, 1, 1, 1], [1, 1 - 1e-9, 0.5, 1e-6, 0], [2, 0, 0, 0, -2]):
        q, _ = np.linalg.qr(r.normal(size=(5, 5)))
        a = q @ np.diag(np.array(e, float)) @ q.T
        a = (a + a.T) / 2
        for shift in (-3, -1, 0.25, 0.75, 1.5, 2.5, 6):
            assert whitening.negative_pivots(a, shift) == sum(x < shift for x in e)
        values, vectors = whitening.leading(a, 4)
        want = [x for x in e[:4] if x > 1e-11]
        assert values == pytest.approx(want, abs=1e-12) and np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-9
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12


# quality


def quality_rows():
    r = random.Random(6)
    stems = "the of and house water light thing small great from with over under about".split()
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(stems) for _ in range(r.randrange(20, 200))]
        good = i % 4 > 0
        if not good:
            words = [w.upper() + "!!" if i % 8 else f"{w} |" for w in words]
        rows.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_is_learned_from_rows_that_are_not_held_out(table):
    rows, labels = quality_rows()
    more = [(2000, None), (2001, ""), (2002, "the " * 200_000), (None, rows[0][1]), (2003, rows[0][1]), (2003, rows[0][1])]
    marks = table("doc_id long, quality int", [*labels, (None, 1), (3000, None), (1, 1), (1, 0)], extra=False)
    got = quality.quality(table(DOC, rows + more), marks, held_out(F.col("doc_id"), 3, 1)).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [r for r in got if r.held_out and (r.doc_id or 0) < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in tested]) > 0.98
    assert len({r.score for r in got if r.doc_id in (None, 0, 2003)}) == 1 and len({r.score for r in got if r.doc_id in (2000, 2001)}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, 1), (2, 0)]])
def test_quality_with_few_labels(table, labels):
    marks = table("doc_id long, quality int", labels, extra=False)
    got = quality.quality(table(DOC, [(1, "a"), (2, None)]), marks, F.lit(False)).collect()
    if len(labels) < 2:
        assert [r.score for r in got] == [float(bool(labels) and labels[0][1])] * 2
    assert len(got) == 2 and quality.quality(table(DOC, []), marks, F.lit(False)).count() == 0


def test_windows_are_whole_texts():
    windows, counts = quality.windows_of(pa.array(["é" * 700, None, "", "a"]))
    assert counts.tolist() == [3, 1, 1, 1] and b"".join(windows).decode() == "é" * 700 + "a"


# importance


def runs(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return [" ".join(words[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, target, percent, least):
    found = [(i, *runs(t)) for i, t in docs]
    s = Counter(zlib.crc32(f) % 10000 for _, fs, _ in found for f in fs)
    t = Counter(zlib.crc32(f) % 10000 for _, text in target for f in runs(text)[0])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    rows = []
    for i, fs, n in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % 10000) for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


def importance_rows():
    r = random.Random(4)
    some = ["the", "The", "of", "x1", "é", "Ünï", "日本語", "w" * 8, "w" * 9, "l" * 70, "ABC", "zz", "q" * 64, "q" * 63]
    some += ["".join(r.choice("abcde") for _ in range(r.randrange(2, 12))) for _ in range(300)]
    gaps = [" ", ", ", "\n", "--", "_", "\x7f", "`", "{", "/"]
    rows = [(i, "".join(r.choice(some) + r.choice(gaps) for _ in range(r.choice([0, 1, 2, 19, 20, 60])))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "... !"), (None, rows[3][1] + " the" * 30), (None, rows[3][1] + " the" * 30), (7, "the of " * 20), (503, "big " * 100_000)]
    return rows


@pytest.mark.parametrize("head", [(importance.HEAD_WORDS, importance.HEAD_PAIRS, 0.0), (3, 2, 0.0), (0, 0, 1.0)])
def test_resampling_equals_a_plain_version(table, monkeypatch, head):
    plain = importance.head_of
    monkeypatch.setattr(importance, "head_of", lambda texts: plain(texts, *head))
    docs, target = importance_rows(), [(1, "The of x1, the ABC é"), (2, None), (3, "zz zz of the")]
    got = importance.resample(table(DOC, docs), table(DOC, target), 25, 20).collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, target, 25, 20)


def test_resampling_of_odd_tables(table):
    assert importance.resample(table(DOC, []), table(DOC, [(1, "a")])).count() == 0
    docs = [(i, "a b c " * 7) for i in range(100)]
    got = importance.resample(table(DOC, docs), table(DOC, [])).collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, [], 5, 20) and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    none = importance.resample(table(DOC, [(1, "a"), (2, None)]), table(DOC, [])).collect()
    assert [r["rank"] for r in none] == [None, None]


def test_crcs_of_all_lengths():
    crc = importance.Crc()
    r = random.Random(3)
    for n in (0, 1, 7, 63, 64, 65, 127, 128, 1000, 70_000):
        a, b = (bytes(r.randrange(1, 256) for _ in range(m)) for m in (5, n))
        data = np.frombuffer(a + b, np.uint8)
        one = crc.direct(data, np.array([0, 5]), np.array([5, n]))
        assert one.tolist() == [zlib.crc32(a), zlib.crc32(b)]
        assert crc.extended(one[:1], one[1:], np.array([n])).tolist() == [zlib.crc32(a + b" " + b)]
