"""Exact and near duplicates, and repeated passages, against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import exact_dedup, near_dedup, repeats

DOC = "doc_id long, text string"


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


ODD = [
    (1, "a  b"), (2, "a\tb"), (3, "a b"), (0, None), (4, ""), (5, " "), (6, "\n\t "), (None, "a b"), (None, None), (7, "é b"),
    (8, "a b"), (9, text(1, 5000)), (10, text(1, 5000).replace(" ", "  ")), (11, text(1, 5000) + "x"), (3, "a b"), (12, "z" * 10_000),
]


def plain_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (d, _), t in zip(rows, norm, strict=True):
        ids.setdefault(t, []).append(d)
    out, first = [], set()
    for (d, _), t in zip(rows, norm, strict=True):
        least = min((x for x in ids[t] if x is not None), default=None)
        kept = d == least and t not in first
        if kept:
            first.add(t)
        out.append((d, least, len(ids[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("identifiers", [exact_dedup.IDENTIFIERS, (lambda c: F.substring(F.sha2(c, 256), 1, 1), exact_dedup.own_bytes)])
def test_exact_duplicates_are_those_of_equal_normalised_texts(table, identifiers):
    got = exact_dedup.exact_duplicates(table(DOC, ODD), identifiers)
    assert Counter(map(tuple, got.collect())) == plain_exact(ODD)


def test_identifier_that_fails_is_not_used(table):
    one = lambda c: F.lit(1)
    docs = table(DOC, ODD).select(F.coalesce("text", F.lit("")).alias("text"))
    assert exact_dedup.verified_identifier(docs, (one, exact_dedup.sha256_id, exact_dedup.own_bytes)) is exact_dedup.sha256_id


def test_chunks_make_up_the_text_and_meet_again_after_an_insertion(spark):
    long = text(2, 20_000)
    df = spark.createDataFrame([(long,), ("inserted " + long,)], "text string")
    a, b = (r[0] for r in df.select(exact_dedup.chunks_of(F.col("text"))).collect())
    assert "".join(a) == long and "".join(b) == "inserted " + long
    assert len(a) > 20 and len(set(a) & set(b)) > len(a) / 2


@pytest.mark.parametrize("operator", [exact_dedup.exact_duplicates, near_dedup.near_duplicates, repeats.without_repeats])
def test_empty_tables_give_empty_results(table, operator):
    assert operator(table(DOC, [])).count() == 0


# near duplicates


def plain_classes(rows):
    """Classes by all pairs, with the operator's weights."""
    hashes, counts = near_dedup.word_hashes(pa.array([t for _, t in rows]))
    own = np.repeat(np.arange(len(counts)), counts)
    seen = np.unique(own * near_dedup.CELLS + near_dedup.cell_of(hashes))
    held = np.bincount(seen % near_dedup.CELLS, minlength=near_dedup.CELLS)
    idf = (np.log((len(rows) + 1) / (held + 1)) + 1).astype(np.float32)
    own, h, w = near_dedup.weighted_shingles(hashes, counts, idf)
    sets = [dict(zip(h[own == i].tolist(), w[own == i].tolist(), strict=True)) for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            least = sum(min(x, b[k]) for k, x in a.items() if k in b)
            if a and b and least / (sum(a.values()) + sum(b.values()) - least) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def varied(base, share, seed):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in base)


def near_rows():
    rows, n = [], 0
    for group in range(12):
        base = words(group, 300)
        for k in range(25 if group == 0 else 5):
            rows.append((n, varied(base, 0.0 if k == 0 else 0.012 + 0.002 * (group % 3), 1000 * group + k)))
            n += 1
    shared = text(99, 150)  # a passage that many texts share, half of each
    rows += [(n + i, shared + " " + text(500 + i, 150)) for i in range(30)]
    n += 30
    rows += [(n, "a b c"), (n + 1, "A  b\tc"), (n + 2, "a b d"), (n + 3, "one"), (n + 4, "one")]
    return rows


def test_near_duplicates_are_the_classes_of_all_linked_pairs(table):
    rows = near_rows()
    got = near_dedup.near_duplicates(table(DOC, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicates_that_leaders_miss_are_found_by_the_last_round(table, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEADERS", 0)
    rows = near_rows()[:60]
    got = near_dedup.near_duplicates(table(DOC, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(rows)


def test_near_duplicates_of_odd_rows(table):
    got = near_dedup.near_duplicates(table(DOC, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in by_id[1] + by_id[2] + by_id[3]} == {None}  # with the row without doc_id, counted as -1
    assert by_id[10][0].class_id == 9 and by_id[11][0].class_id == 9
    assert all(r.class_id == r.doc_id and r.class_size == 1 and r.kept for i in (0, 4, 5, 6) for r in by_id[i])
    twice = near_dedup.near_duplicates(table(DOC, [(1, "a b c")] * 3)).collect()
    assert sorted(r.kept for r in twice) == [False, False, True]


def test_near_duplicates_start_no_python_workers_for_empty_tables(table, monkeypatch):
    rows = [(1, text(1, 60)), (2, text(1, 60) + " x"), (3, text(2, 60))]
    docs = table(DOC, rows)

    def refused(*args, **kwargs):
        raise AssertionError("a table from the driver")

    monkeypatch.setattr(type(docs.sparkSession), "createDataFrame", refused)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_negative_ids_stay_what_they_are(table):
    got = near_dedup.near_duplicates(table(DOC, [(-1, "a b c"), (3, "a b c"), (0, "x y z"), (None, "x y z"), (-2, None)])).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in got) == Counter({(-1, -1, True): 1, (3, -1, False): 1, (0, None, False): 1, (None, None, True): 1, (-2, -2, True): 1})


@pytest.mark.parametrize("leaders", [0, 3])
def test_who_reaches_nobody_is_left_out_and_no_link_is_lost(table, monkeypatch, leaders):
    monkeypatch.setattr(near_dedup, "CROWDED", 2)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    met, remaining = [], near_dedup.remaining_pairs
    monkeypatch.setattr(near_dedup, "remaining_pairs", lambda *a: met.append(remaining(*a)) or met[-1])
    base, rows = words(1, 200), []
    for k in range(120):  # most are farther than 0.8 from each other, some are near copies of these
        own = varied(base, [0.0, 0.01, 0.02, 0.03, 0.04][k % 5], k).split()
        rows.append((k, " ".join(own)))
        if k % 7 == 0:
            rows.append((1000 + k, " ".join([*own[:100], "y", *own[100:]])))
    got = near_dedup.near_duplicates(table(DOC, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(rows)
    assert met and met[0].count() < 120 * 119 / 2 / 2


def test_linked_pairs_with_few_equal_samples_are_found(table):
    r = random.Random(22337)  # 33 of 60 samples agree, at a similarity of 0.803
    a = [f"w{r.randrange(4000)}" for _ in range(53)]
    b = [*a]
    a[26], b[26] = "y22337", "x22337"
    rows = [(0, " ".join(a)), (1, " ".join(b))]
    assert plain_classes(rows) == {0: 0, 1: 0}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(DOC, rows)).collect()} == {0: 0, 1: 0}


def test_samples_agree_with_the_probability_of_the_weighted_similarity():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 300, dtype=np.uint64)
    a = r.uniform(1, 10, 300)
    b = np.concatenate([r.uniform(1, 10, 90), a[90:]])
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    names = near_dedup.Sampler(3000)(np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([a, b]), 2)
    assert abs((names[0] == names[1]).mean() - want) < 0.03


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 30)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(chain + star, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 30)}


# repeated passages


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((d, len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passage_rows():
    r = random.Random(5)
    letters = "abcdefghij klmé"
    prose = lambda n: "".join(r.choice(letters) for _ in range(n))
    passage = prose(900)
    rows = [(i, prose(r.randrange(1500)) + passage[: r.randrange(350, 900)] + prose(300)) for i in range(40)]
    rows += [(100, passage), (101, passage), (101, passage), (102, "ab" * 700), (103, "ab" * 200 + "c"), (104, "x" * 399), (105, "x" * 400), (106, "x" * 401)]
    rows += [(107, None), (108, ""), (None, passage[:500]), (109, rows[3][1][:700] + "Z" + rows[3][1][701:]), (110, prose(200) + "qrs" * 300)]
    return rows


def test_repeated_passages_are_those_of_all_windows(table):
    rows = passage_rows()
    got = repeats.without_repeats(table(DOC, rows))
    assert Counter(map(tuple, got.collect())) == plain_repeats(rows, 400)


def test_repeated_passages_across_the_parts_of_a_long_text(table, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1500)
    monkeypatch.setattr(repeats, "_HASHER", [repeats.Hasher(1, 1 << 17)])
    rows = passage_rows() + [(200, text(3, 3000)), (201, text(4, 700) + text(3, 3000)[2000:9000])]
    got = repeats.without_repeats(table(DOC, rows), length=400)
    assert Counter(map(tuple, got.collect())) == plain_repeats(rows, 400)


def test_texts_with_equal_polynomial_hashes_are_told_apart(table):
    """Thue-Morse arrangements of two strings, whose polynomials modulo 2**64 are equal for any odd base."""
    turn = [bin(i).count("1") % 2 for i in range(64)]
    start = text(8, 100)[:208]
    rows = [(k, start + "".join(("s7m", "s7V")[t ^ k] for t in turn)) for k in (0, 1)]
    assert len(rows[0][1]) == 400
    got = repeats.without_repeats(table(DOC, rows)).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(400, 0), (400, 0)]


def test_many_equal_rows_without_an_id(table):
    passage = text(9, 200)
    rows = [(None, passage)] * 1000 + [(1, passage + "x"), (2, text(10, 200))]
    got = Counter(map(tuple, repeats.without_repeats(table(DOC, rows)).collect()))
    few = plain_repeats(rows[-4:], 400)  # two of the equal rows and the others
    assert got == Counter({row: 1000 if row[0] is None else n for row, n in few.items()})


def test_leftmost_minima():
    r = np.random.default_rng(1)
    for n, width in ((1, 1), (7, 3), (50, 50), (64, 9)):
        v = r.integers(0, 4, n).astype(np.uint64) << np.uint64(40)
        assert repeats.leftmost_minima(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(n - width + 1)]
