"""The schema found over all records, against a fold on the driver."""

import random

from pyspark.sql import types as T

from tallyshelf import schemas
from tallyshelf.sources.literals import found_schema, parse_literal_records, schema_paths, widened


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def kind(value):
    """None, 'boolean', 'bigint', 'double', 'string', ['list', element] or a dict of fields."""
    if value is None:
        return None
    if isinstance(value, dict):
        return {k: kind(v) for k, v in value.items()}
    if isinstance(value, list):
        found = None
        for v in value:
            found = joined(found, kind(v))
        return ["list", found]
    return {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]


def joined(a, b):
    if a is None or b is None or a == b:
        return b if a is None else a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: joined(a.get(k), b.get(k)) for k in a.keys() | b.keys()}
    if isinstance(a, list) and isinstance(b, list):
        return ["list", joined(a[1], b[1])]
    return "double" if {str(a), str(b)} == {"bigint", "double"} else "string"


def paths(found, path=""):
    if isinstance(found, dict) and found:
        return [x for k, v in found.items() for x in paths(v, f"{path}.{k}" if path else k)]
    if isinstance(found, list):
        return paths(found[1], f"{path}[]")
    return [(path, "string" if found is None or found == {} else found)]


def some_value(rng, depth):
    if depth and rng.random() < 0.4:
        if rng.random() < 0.5:
            return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["a", "b c", "é", "VOID", "OBJECT"]): some_value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([None, True, 7, 2.5, "x", "it's", '"q"', -3, 1e300])


def test_equals_a_fold(spark):
    rng = random.Random(5)
    for _ in range(4):
        values = [{rng.choice("klmno"): some_value(rng, 3) for _ in range(4)} for _ in range(40)]
        want = None
        for v in values:
            want = joined(want, kind(v))
        raw = lines(spark, *map(repr, values), "{broken", "[1, 2]").repartition(7)
        assert sorted(schema_paths(found_schema(raw))) == sorted(paths(want))


def test_all_fields_are_kept(spark):
    raw = lines(spark, "{'user_id': 'u', 'items': [{'item_id': '1', 'rating': 4.5}], 'country': 'ES'}", "{u'user_id': 'v', 'n': 3}", "{'user_id': 5}")
    first, second, third = (r["record"].asDict(True) for r in parse_literal_records(raw, None).collect())
    assert first == {"user_id": "u", "items": [{"item_id": "1", "rating": 4.5}], "country": "ES", "n": None}
    assert second["n"] == 3 and third["user_id"] == "5"
    rows = parse_literal_records(raw, schemas.RAW_ITEMS, unknown="unknown").collect()
    assert [r["unknown"] for r in rows] == [{"country": "ES"}, {"n": "3"}, None]
    schema = widened(schemas.RAW_ITEMS, found_schema(raw))
    assert [f.name for f in schema] == ["user_id", "user_url", "items", "country", "n"]
    assert schema["items"].dataType.elementType.fieldNames()[-1] == "rating"


def test_no_records(spark):
    assert found_schema(lines(spark, "{broken", "")) == T.StructType()
    assert found_schema(lines(spark, "{}")) == T.StructType()
    assert found_schema(spark.createDataFrame([], "value string")) == T.StructType()
    assert [r["record"] for r in parse_literal_records(lines(spark, "{broken"), None).collect()] == [None]


def test_patched_words(spark):
    raw = lines(spark, """{"a": NaN, "b": true, "url": ""http://x"}""", """{"a": 1, "b": False}""")
    assert schema_paths(found_schema(raw, patched=True)) == [("a", "bigint"), ("b", "boolean"), ("url", "string")]
