"""Search, packing and mixing against plain versions of themselves."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyshelf.llm import mixing, norm_search, packing
from tallyshelf.llm.common import slices

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
VEC = "vec_id long, embedding array<float>"


def plain_top(rows, k, scale, every):
    vectors = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = Counter()
    for q in {i for i, _ in vectors if i % every == 0}:
        asking = [v for i, v in vectors if i == q]
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for v in asking for i, w in vectors if i != q and len(w) == len(v))
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))
    return out


def vector_rows(kind):
    r = np.random.default_rng(3)
    n = 400
    v = r.normal(size=(n, 8))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "spread":
        v *= r.lognormal(0, 2, (n, 1))
    if kind == "clustered":  # close to few directions, so that thresholds of the cosine are high
        v = r.normal(size=(4, 8))[r.integers(0, 4, n)] * r.lognormal(0, 0.2, (n, 1)) + 0.02 * v
    if kind == "equal":
        v[: n // 2] = v[0]
    return [(i, [float(x) for x in row]) for i, row in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("kind", ["unit", "spread", "clustered", "equal"])
def test_top_k_is_that_of_all_products(table, kind):
    rows = vector_rows(kind)
    got = norm_search.top_k(table(VEC, rows), F.col("vec_id") % 20 == 0, 5, 64, bucket=40, block=7)
    assert Counter(map(tuple, got.collect())) == plain_top(rows, 5, 64, 20)


def test_top_k_of_odd_vectors(table):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
        (40, []), (41, []), (7, [1.0]), (60, [1.0]), (None, [1.0, 0.0]), (8, [-1.0, -1.0]), (0, [1.0, 0.0]), (9, [-0.001, 0.001]), (80, [-1e6, 1e6]), (10, [1e6, -1e6]),
        (11, [1.0, 0.0]), (11, [5.0, 0.0]), (20, [0.5, 2.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0]),
    ]
    got = norm_search.top_k(table(VEC, rows), F.col("vec_id") % 20 == 0, 3, 64)
    assert Counter(map(tuple, got.collect())) == plain_top(rows, 3, 64, 20)
    assert norm_search.top_k(table(VEC, []), F.col("vec_id") % 20 == 0).count() == 0


def token_rows():
    r = random.Random(1)
    some = ["the", "Cat.", "caffè", "x1y2", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "a,b", "ÉTÉ!", "…", "100%", "été", "日本語", "ǅ", "İstanbul", " ", "'s", "o'ré"]
    rows = [(i, " ".join(r.choice(some) for _ in range(r.randrange(1, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "word " * 5000), (None, "null id"), (54, "same"), (54, "same"), (55, "A.B.c" * 900)]
    return rows


def test_pieces_are_those_of_whole_texts(table):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for d, t in token_rows():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    got = packing.token_pieces(table("doc_id long, text string", token_rows()), WORD_BPE, 64).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_worker_memory_of_words_can_be_dropped(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder, tokenizer = packing.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for part in (["a b c d e"], ["d e f", None], [], ["a"]):
        ids, counts = encoder(pa.array(part, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def packed_well(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= length
    return len(by)


def test_a_worker_encodes_little_text_at_once():
    texts = pa.array([" ".join(f"w{(i * 7919 + k) % 3000}" for k in range(400)) for i in range(6000)])  # 13 MB
    encoder = packing.WordEncoder(WORD_BPE)
    tracemalloc.start()
    try:
        counts = [encoder(part.column("text"))[1] for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", packing.BATCH)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, counts)) == len(texts) and peak < 150e6, peak


def test_packing_places_every_piece_once_in_few_sequences(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([r.randrange(1, 100), r.randrange(1, 20), 100]), i) for i in range(3000)]
    rows += [(None, 0, 0, 5, 1), (None, 0, 0, 5, 1), (7, 0, 0, rows[7][3], 7)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, 100, shard=400).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(rows, key=str)
    assert packed_well(got, 100) <= 1.03 * sum(x[3] for x in rows) / 100 + 1
    assert packing.pack(pieces.limit(0), 100).count() == 0


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(3)
    lengths = sorted((r.randrange(1, 65) for _ in range(500)), reverse=True)
    bins, offsets, used = packing.best_fit(lengths, 64)
    rooms, want = [], []
    for n in lengths:
        fit = [x for x in rooms if x >= n]
        want.append(min(fit) if fit else 64)
        if fit:
            rooms.remove(min(fit))
        rooms.append(want[-1] - n)
    assert [64 - o for o in offsets] == want and used == len(rooms) == max(bins) + 1


# mixing


def test_targets_are_shared_by_weight_up_to_their_bounds(spark):
    r = random.Random(4)
    for sizes in ([10, 1000, 1000, 1, 0, 500], [5], [0, 0], [r.randrange(1000) for _ in range(20)], [1, 1, 10**6]):
        names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
        got = mixing.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
        target, open_sources = {n: 0.0 for n in names}, dict(zip(names, [(5, 2, 1)[i % 3] for i in range(len(sizes))], strict=True))
        left, bound = float(sum(sizes)), {n: 3.0 * s for n, s in zip(names, sizes, strict=True)}
        while left > 1e-9 and open_sources:
            level = left / sum(open_sources.values())
            step = min(level, min((bound[n] - target[n]) / w for n, w in open_sources.items()))
            for n, w in list(open_sources.items()):
                target[n] += step * w
                left -= step * w
                if bound[n] - target[n] < 1e-9:
                    del open_sources[n]
        assert {x.source: x.target for x in got} == pytest.approx(target, abs=1e-3)


def mix_rows():
    r = random.Random(5)
    rows = [(i, f"s{i % 5}" if i % 5 else None, r.randrange(1, 50), r.choice([None, 0.5, 1.0, 2.0])) for i in range(600)]
    rows += [(700 + i, "hot", 40, 1.0) for i in range(900)] + [(None, "hot", 3, 1.0), (5, "s0", 0, 1.0), (5, "s0", None, 1.0), (9, "rare", 7, 1.0), (9, "rare", 7, 1.0)]
    return rows


def test_mix_meets_targets_and_takes_documents_in_key_order(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    by = defaultdict(list)
    for (_, source, *_), g in zip(sorted(rows, key=lambda x: (str(x[0]), x[2] or 0)), sorted(got, key=lambda x: (str(x.doc_id), x.size)), strict=True):
        by[source].append(g)
        assert g.taken <= 3 * g.size
    total = sum(x[2] or 0 for x in rows)
    assert sum(g.taken for g in got) == pytest.approx(total, abs=10)
    for own in by.values():
        assert sum(g.taken for g in own) == math.floor(own[0].target) and own[0].source_size == sum(g.size for g in own)
        epochs = min(3, math.floor(own[0].target) // max(1, own[0].source_size))
        assert all(epochs * g.size <= g.taken <= (epochs + 1) * g.size for g in own)
        assert sum(epochs * g.size < g.taken < (epochs + 1) * g.size for g in own) <= 1


def test_heavier_documents_are_drawn_more_often(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 1, 4.0 if i % 4 < 2 else 0.25) for i in range(4000)], "doc_id long, source string, size long, weight double")
    got = mixing.mix(df, weights=(3, 1)).filter("taken > 0 and target < source_size").collect()
    assert sum(g.doc_id % 4 < 2 for g in got) > 0.8 * len(got)


def test_word_count_and_empty_mix(spark):
    df = spark.createDataFrame([("a\tb  c\n",), ("",), (None,), (" ",), ("é b",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [3, 0, 0, 0, 1]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long, weight double")).count() == 0
