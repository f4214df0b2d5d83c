import ast
from types import SimpleNamespace

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf import schemas
from tallyshelf.functions.text import list_literal, text_literal
from tallyshelf.plans import tables
from tallyshelf.session import fresh_path, shared_folder
from tallyshelf.sources import files
from tallyshelf.sources.literals import parse_literal_records, parse_patched_records, rejected_records


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def records(df):
    return [row["record"] and row["record"].asDict(True) for row in df.collect()]


def test_literal_lines(spark):
    raw = lines(
        spark,
        """{'user_id': 'u1', 'reviews': [{'item_id': '10', 'recommend': True, 'review': "it's ok"}]}""",
        "{u'user_id': u'u2', u'reviews': []}",
        "{broken",
    )
    parsed = parse_literal_records(raw, schemas.RAW_REVIEWS)
    one, two, three = records(parsed)
    assert one["reviews"][0] == {
        "funny": None, "posted": None, "last_edited": None, "item_id": "10", "recommend": "true", "review": "it's ok",
    }
    assert two["user_id"] == "u2" and two["reviews"] == [] and three is None
    assert [r["value"] for r in rejected_records(parsed).collect()] == ["{broken"]
    flat = tables.flat_reviews(raw).collect()
    assert [(r["user_id"], r["item_id"]) for r in flat] == [("u1", "10"), ("u2", None)]


@pytest.mark.parametrize(
    "line",
    [
        "{'user_id': true}",
        "{'user_id': null}",
        "{'user_id': NaN}",
        "{'user_id': 'a'} {'user_id': 'b'}",
        "{'user_id': 'a'}}",
        "{'user_id': 012}",
        "['user_id']",
        "{'user_id': __import__('os')}",
        "",
        "{'user_id': 'a' 5}",
    ],
)
def test_lines_that_are_no_record(spark, line):
    assert records(parse_literal_records(lines(spark, line), schemas.RAW_REVIEWS)) == [None]


@pytest.mark.parametrize(
    "line, value",
    [
        (r"{'user_id': 'caf\xe9'}", "café"),
        (r"{'user_id': 'é\n\t\\ \' \"'}", "é\n\t\\ ' \""),
        (r"{'user_id': '\/'}", "\\/"),
        (r"{'user_id': '😀'}", "😀"),
        ("{'user_id': 'a' 'b'}", "ab"),
        ("{'user_id': 'True, None: False'}", "True, None: False"),
        ("{'user_id': 'x',}", "x"),
        ("{'user_id': 'one', 'user_id': 'two'}", "two"),
        ("  {'user_id': None}  ", None),
        ('{"user_id": "say \'True\'"}', "say 'True'"),
    ],
)
def test_single_values(spark, line, value):
    (record,) = records(parse_literal_records(lines(spark, line), schemas.RAW_REVIEWS))
    assert record["user_id"] == value


def test_long_line_is_parsed(spark):
    entries = ", ".join(f"{{'item_id': '{i}', 'item_name': \"it's {i}\", 'playtime_forever': {i}}}" for i in range(30000))
    raw = lines(spark, "{'user_id': 'u', 'items': [" + entries + "]}")
    assert tables.flat_items(raw).agg(F.sum("playtime_forever").cast("bigint")).first()[0] == sum(range(30000))


texts = st.text(st.characters(blacklist_categories=("Cs", "Zl", "Zp", "Cc"), blacklist_characters="\x85"), max_size=12)


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(st.dictionaries(st.sampled_from(["user_id", "user_url"]), texts | st.none()), min_size=30, max_size=60))
def test_equals_literal_eval(spark, rows):
    written = [repr(row) for row in rows]
    found = records(parse_literal_records(lines(spark, *written).coalesce(1), schemas.RAW_REVIEWS))
    want = [ast.literal_eval(text) for text in written]
    assert [(r["user_id"], r["user_url"]) for r in found] == [(w.get("user_id"), w.get("user_url")) for w in want]


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(texts, min_size=30, max_size=60))
def test_written_literals_read_back(spark, values):
    df = spark.createDataFrame([(v, [v, "x"]) for v in values], "t string, l array<string>").coalesce(1)
    got = df.select(text_literal(F.col("t")).alias("t"), list_literal(F.col("l")).alias("l")).collect()
    assert [ast.literal_eval(r["t"]) for r in got] == values
    assert [ast.literal_eval(r["l"]) for r in got] == [[v, "x"] for v in values]


def test_literals_look_as_python_writes_them(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab", "é日本"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in df.select(text_literal(F.col("t"))).collect()] == [repr(v) for v in values]
    assert df.select(text_literal(F.lit(None).cast("string"))).first()[0] == "None"


def test_patched_words_only_outside_strings(spark):
    raw = lines(
        spark,
        '{"title": "true story NaN", "price": NaN, "url": ""http://a/", "early_access": false, "genres": ["A"]}',
        "{'title': u'x', 'early_access': true, 'price': 4.99}",
        "{'title': null}",
    )
    one, two, three = records(parse_patched_records(raw, schemas.RAW_GAMES))
    assert (one["title"], one["price"], one["url"], one["early_access"]) == ("true story NaN", None, "http://a/", "false")
    assert (two["title"], two["early_access"], two["price"], three) == ("x", "true", "4.99", None)


def test_ragged_csv(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('a,b,c\n1,x,2\n2,y\n3,z,4,5\n4,"multi\nline ""q"", x",6\n7,w,8,\n', encoding="utf-8")
    schema = T.StructType(
        [T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.LongType())]
    )
    kept = [tuple(r) for r in files.read_csv_skip_long_rows(spark, str(path), schema, multi_line=True).collect()]
    assert kept == [(1, "x", 2), (2, "y", None), (4, 'multi\nline "q", x', 6)]
    narrow = files.read_csv_skip_long_rows(spark, str(path), schema, multi_line=True).select("a").collect()
    assert [r["a"] for r in narrow] == [1, 2, 4]
    assert files.read_csv_skip_long_rows(spark, str(path), schema, multi_line=True).count() == 3
    assert [r["row"] for r in files.read_csv_long_rows(spark, str(path), schema, multi_line=True).collect()] == ["3,z,4,5", "7,w,8,"]
    with pytest.raises(Exception, match="too many fields: 3,z,4,5"):
        files.read_csv(spark, str(path), schema, multi_line=True).collect()


def test_csv_round_trip(spark):
    path = fresh_path(spark, "csv")
    df = spark.createDataFrame(
        [(1, ' a "b", c\nd ', 4.5, True, ["x", "it's"]), (2, None, None, None, None)],
        "id long, t string, p double, f boolean, l array<string>",
    )
    files.write_csv(df, path)
    schema = T.StructType([T.StructField("l", T.StringType()) if f.name == "l" else f for f in df.schema])
    back = sorted(tuple(r) for r in files.read_csv(spark, path, schema, multi_line=True).collect())
    assert back == [(1, ' a "b", c\nd ', 4.5, True, "['x', \"it's\"]"), (2, None, None, None, None)]


def test_missing_texts_are_null(spark, tmp_path):
    path = tmp_path / "missing.csv"
    path.write_text("a,b\nNaN,NA\n1e3,ok\n1d,n/a\n", encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    got = [tuple(r) for r in files.read_csv(spark, str(path), schema).collect()]
    assert got == [(None, None), (1000.0, "ok"), (None, None)]


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("good\t1.9\t0.9\t[1, 2]\nbad\t-2.5\t0.6\t[-2]\n", encoding="utf-8")
    got = {r["token"]: r["valence"] for r in files.read_lexicon(spark, str(path)).collect()}
    assert got == {"good": 1.9, "bad": -2.5}


class NamedSession:
    """Stands for a session whose settings and master are given."""

    def __init__(self, master, **conf):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    named = NamedSession("yarn", spark_checkpoint_dir="/somewhere/shared/")
    assert fresh_path(named, "x").startswith("/somewhere/shared/x-")
    with pytest.raises(ValueError):
        shared_folder(NamedSession("yarn"))
