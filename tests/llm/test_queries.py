"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import duckdb
import pytest

import corpus_pipeline
from tallyshelf.llm import mixing, near_dedup, toxicity
from tallyshelf.llm.queries import ORACLES, QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        db.sql(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    held = corpus_pipeline.held_out(docs["doc_id"], 4, 2)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"), held).collect()
    clean = corpus_pipeline.without_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if not r.predicted}
    single = corpus_pipeline.without_copies(spark, clean, sf).collect()
    least = {}
    for r in clean.collect():
        key = " ".join(r.text.split(" "))
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in single} <= set(least.values()) and all(texts[r.doc_id] == r.text for r in single)
    single = spark.createDataFrame(single, docs.schema)
    near = corpus_pipeline.without_near_copies(spark, single, sf)
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in near_dedup.near_duplicates(single).filter("kept").collect()}
    mix = corpus_pipeline.mixed(spark, near, sf)
    assert mix.columns == docs.columns
    rows = mix.collect()
    assert all(texts[r.doc_id] == r.text for r in rows)
    planned = mixing.mix(mixing.weighed(near, spark.read.parquet(f"{sf}/labels.parquet"), carry=True), carry=["row"]).collect()
    target, longest, held = {}, {}, {}
    for r in planned:
        source = r.row.source
        target[source], longest[source] = r.target, max(longest.get(source, 0), r.size)
    for r in rows:
        held[r.source] = held.get(r.source, 0) + len(r.text.split())
    assert all(abs(held.get(source, 0) - target[source]) <= longest[source] / 2 + 1 for source in target)
    assert corpus_pipeline.packed(spark, mix, sf).select("doc_id").distinct().count() == len({r.doc_id for r in rows})


def test_stages_take_empty_tables_and_repeated_rows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "a b", "en", None, 3), (1, "other text", None, "s", 10), (2, None, None, None, None), (3, "", "en", "s", 0)]
    for docs, least in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame(rows, schema), 2)):
        for name, stage in corpus_pipeline.STAGES:
            docs.write.mode("overwrite").parquet(path := f"{tmp_path}/{name}{least}")
            docs = stage(spark, spark.read.parquet(path), sf)
            assert docs.count() >= least, name
            if name == "exact dedup" and least:
                assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, "a b"), (1, "other text"), (2, None)]


def test_mixing_tells_rows_apart(spark, sf):
    schema = "doc_id long, text string, source string, _size long, size long, row string, weight string"
    rows = [(None, "a b c", "s", 77, 1, "x", "w"), (None, "d e f", "t", 77, 1, "x", "w"), (5, "g h i", "s", 1, 1, "y", "w"), (5, "j k l", "s", 1, 1, "z", "w"), (6, None, "s", 1, 1, "", ""), (7, "m " * 50_000, None, 1, 1, "", "")]
    docs = spark.createDataFrame(rows, schema)
    mix = corpus_pipeline.mixed(spark, docs, sf)
    assert mix.columns == docs.columns and {tuple(r) for r in mix.collect()} <= set(rows)
    assert {r.source for r in mix.collect()} == {"s", "t", None}
