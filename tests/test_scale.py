"""Steps whose memory, disk or time once grew faster than their input."""

import math
from collections import Counter

import pytest

from checks import bindings
from tallyshelf.operators import neighbours, postings, tfidf, wordcounts
from tallyshelf.session import fresh_path
from tallyshelf.sources import files, keyed


def plan_of(df):
    return df._jdf.queryExecution().toString()


TEXTS = [(i, "common " + " ".join(f"w{(i * j) % 11}" for j in range(1, 4))) for i in range(1, 31)] + [(31, ""), (32, None), (33, "common w1 w2 w3"), (34, "common w1 w2 w3")]


def nearest_by_hand(rows, wanted, k):
    counts = {i: Counter((text or "").split()) for i, text in rows}
    df = Counter(t for c in counts.values() for t in c)
    raw = {i: {t: n * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, n in c.items()} for i, c in counts.items()}
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in raw.items()}
    found = []
    for a in wanted:
        scores = sorted((-round(sum(w * unit[b].get(t, 0) for t, w in unit[a].items()), 6), b) for b in unit if b != a)
        found += [(a, b, -s, place) for place, (s, b) in enumerate(scores[:k], 1)]
    return found


@pytest.mark.parametrize("entries, at_once", [(1_000_000, 2_000_000), (9, 5)])
def test_requests_meet_the_corpus_without_moved_products(spark, monkeypatch, entries, at_once):
    monkeypatch.setattr(neighbours, "ENTRIES", entries)
    monkeypatch.setattr(neighbours, "AT_ONCE", at_once)
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    wanted = docs.select("id").where("id % 2 = 1")
    near = neighbours.nearest_to(docs.select("id"), tfidf.tfidf_vectors(docs), wanted, 4)
    expected = nearest_by_hand(TEXTS, [i for i, _ in TEXTS if i % 2], 4)
    assert [tuple(r) for r in near.select("id", "neighbour", "similarity", "place").orderBy("id", "place").collect()] == [(a, b, pytest.approx(s, abs=2e-6), p) for a, b, s, p in expected]
    assert "FlatMapCoGroupsInArrow" in plan_of(near)


@pytest.mark.parametrize("entries, at_once", [(1_000_000, 2_000_000), (9, 5)])
def test_requests_meet_posting_lists_without_moved_products(spark, monkeypatch, entries, at_once):
    monkeypatch.setattr(neighbours, "ENTRIES", entries)
    monkeypatch.setattr(neighbours, "AT_ONCE", at_once)
    monkeypatch.setattr(postings, "BLOCK", 3)
    docs, path = spark.createDataFrame(TEXTS, "id long, text string"), fresh_path(spark, "postings")
    postings.write_postings(tfidf.tfidf_vectors(docs), path)
    near = postings.nearest_by_postings(spark, path, docs.select("id"), docs.select("id").where("id % 2 = 1"), 4)
    expected = nearest_by_hand(TEXTS, [i for i, _ in TEXTS if i % 2], 4)
    assert [tuple(r) for r in near.select("id", "neighbour", "similarity", "place").orderBy("id", "place").collect()] == [(a, b, pytest.approx(s, abs=2e-6), p) for a, b, s, p in expected]
    assert "FlatMapCoGroupsInArrow" in plan_of(near)


def test_collocations_fold_plurals_without_joins(spark):
    texts = ["blue gizmos"] * 12 + ["blue gizmo"] * 8 + ["old glass"] * 9 + ["red cars"] * 7 + ["some other words here and there"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = wordcounts.collocations(df, ["text"], ["and"])
    got = {(r["a"], r["b"]): (r["a_word"], r["b_word"], r["n"]) for r in found.collect()}
    assert got[("blue", "gizmo")] == ("blue", "gizmo", 20)
    assert got[("old", "glass")] == ("old", "glass", 9)
    assert got[("red", "cars")] == ("red", "cars", 7)
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Join ") == 3  # two words and the total


def test_term_weights_are_counted_in_parts_of_their_size(spark, monkeypatch):
    rows = [(i, f"one two w{i % 5} w{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    whole = sorted(tuple(r) for r in tfidf.tfidf_vectors(docs).collect())
    monkeypatch.setattr(tfidf, "PART", 64)
    vectors = tfidf.tfidf_vectors(docs)
    got = sorted(tuple(r) for r in vectors.collect())
    assert [r[:3] for r in got] == [r[:3] for r in whole]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in whole])
    size = sum(len(text) for _, text in rows)
    assert f", {1 + size // 64})" in plan_of(vectors)


def test_ranges_of_text_keys_are_found_without_a_sort_of_the_rows(spark):
    rows = spark.createDataFrame([(None, "f"), ("b", "f"), ("a", "f"), ("ä", "g"), ("z", "g"), (None, "h")], "key string, file string")
    found = keyed._ranges(rows.repartition(3))
    assert sorted(map(tuple, found.collect())) == [("f", "a", "b"), ("g", "z", "ä"), ("h", None, None)]
    assert "MapInArrow" in plan_of(found)


def test_catalogue_lines_are_dealt_over_all_cores(spark, sf):
    lines = bindings.game_lines(spark, sf)
    assert f"RoundRobinPartitioning({spark.sparkContext.defaultParallelism})" in plan_of(lines)
    assert lines.count() == bindings.table(spark, sf, "part").count()


def test_weights_are_moved_packed_and_once(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    vectors = tfidf.tfidf_vectors(docs)
    assert "Generate" not in plan_of(vectors) and "SortMergeJoin" not in plan_of(vectors)
    near = neighbours.nearest_to(docs.select("id"), files.stored(vectors, "vectors"), docs.select("id").where("id % 2 = 1"), 4)
    assert "sequence(" not in plan_of(near)  # no copies for blocks
    assert "MapInArrow pack" in plan_of(near)


def test_repeated_and_missing_ids_are_weighed_as_one_document(spark):
    rows = [(1, "a1 a1 b1"), (1, "b1 c1"), (None, "a1"), (None, "d1 a1"), (2, "a1 zz"), (3, None)]
    got = {(r["id"], r["term"]): (r["df"], r["weight"]) for r in tfidf.tfidf_vectors(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()}
    counts = {1: {"a1": 2, "b1": 2, "c1": 1}, None: {"a1": 2, "d1": 1}, 2: {"a1": 1, "zz": 1}}
    df = {"a1": 4, "b1": 2, "c1": 1, "d1": 1, "zz": 1}
    raw = {i: {t: n * (math.log(7 / (df[t] + 1)) + 1) for t, n in c.items()} for i, c in counts.items()}
    assert got == {(i, t): (df[t], pytest.approx(w / math.sqrt(sum(x * x for x in c.values())))) for i, c in raw.items() for t, w in c.items()}


def test_lists_meet_requests_packed(spark):
    docs, path = spark.createDataFrame(TEXTS, "id long, text string"), fresh_path(spark, "postings")
    postings.write_postings(tfidf.tfidf_vectors(docs), path)
    wanted = docs.select("id").where("id % 2 = 1")
    plan = plan_of(postings.nearest_by_postings(spark, path, docs.select("id"), wanted, 4))
    assert "MapInArrow split" in plan and "inline" not in plan  # no row per entry is moved
    assert "left_semi" not in plan and "LeftSemi" not in plan  # the requests' terms are found once, not for each use
