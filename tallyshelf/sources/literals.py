"""Text lines that hold one Python-literal record each.

Nearly all such lines become JSON by renaming a few bare words, so the JVM parses them. A line that does
not fit this narrow form (prefixes, tuples, unusual escapes, damage) goes to `ast.literal_eval` in an
Arrow-batched function; every other line reaches that function as null, so one pass over the lines does both.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.steps import computed

# Quoted strings, matched without backtracking so that long lines stay linear.
_SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_STRING = f"(?:{_SINGLE}|{_DOUBLE})"

# Escapes that mean the same in a Python literal and in JSON read with backslashEscapingAnyCharacter.
_SHARED_ESCAPE = r"""\\(?:[\\'"ntrbf]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"""

_JSON_WORDS = {"True": "true", "False": "false", "None": "null"}

_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_broken",
    "allowSingleQuotes": "true",
    "allowUnquotedControlChars": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}


def _rename_bare_word(line: Column, word: str, other: str) -> Column:
    """Replace a word outside quotes; a match always starts where the last one ended."""
    head, tail = word[0], word[1:]
    return F.regexp_replace(line, rf"""\G((?:[^'"{head}]++|{_STRING}|{head}(?!{tail}\b))*+){word}\b""", f"$1{other}")


def _has_json_shape(line: Column, frame: Column, bare_words: list[str]) -> Column:
    """`frame` is the line with every quoted string reduced to one mark."""
    plain = r'[\[\]{}:,"\s0-9.+\-eE]*+'
    shape = rf"^\s*+\{{{plain}(?:(?:{'|'.join(bare_words)})\b{plain})*+$"

    def count(mark: str) -> Column:
        return F.length(frame) - F.length(F.replace(frame, F.lit(mark), F.lit("")))

    return (
        frame.rlike(shape)
        & frame.rlike(r"\}\s*$")
        & ~frame.rlike(r'[}\]"]\s*[{\["]')
        & (count("{") == count("}"))
        & (count("[") == count("]"))
        & ~F.regexp_replace(line, _SHARED_ESCAPE, "").contains("\\")
    )


# A record read as one value; a repeated name makes it null, and the line goes the long way.
_VARIANT_OPTIONS = {k: v for k, v in _JSON_OPTIONS.items() if k != "columnNameOfCorruptRecord"}
# Types of such values that are written otherwise in schemas; names come first, and in quotes if they need them.
_VARIANT_WORDS = re.compile(r"`(?:[^`]|``)*`|OBJECT<>|OBJECT<|\b(?:VOID|VARIANT)\b(?!:)|DECIMAL\(\d+,\s*(?P<scale>\d+)\)")


@F.pandas_udf(T.StringType())
def _literal_to_json(lines: pd.Series) -> pd.Series:
    def convert(line: str | None) -> str | None:
        if line is None:
            return None
        try:
            record = ast.literal_eval(line.strip())
            if not isinstance(record, dict):
                return None
            text = json.dumps(record, ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return lines.map(convert, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def _renamed(lines: DataFrame, line: str, literal: Column) -> tuple[DataFrame, Column, Column]:
    """The lines with steps on the way to JSON, the JSON text, and whether the line has the form that this holds for."""
    kept = [c for c in lines.columns if c != line]
    staged = lines.select(*kept, F.trim(F.col(line)).alias(line))
    staged = computed(staged, _literal=literal)
    staged = computed(staged, _plain=F.regexp_replace("_literal", f"[uU]?({_STRING})", "$1"))
    staged = computed(staged, _frame=F.regexp_replace("_plain", _STRING, '"'))
    renamed = F.col("_plain")
    for word, other in _JSON_WORDS.items():
        renamed = _rename_bare_word(renamed, word, other)
    return staged, renamed, _has_json_shape(F.col("_plain"), F.col("_frame"), list(_JSON_WORDS))


def _parse(lines: DataFrame, schema: T.StructType, line: str, literal: Column, unknown: str | None) -> DataFrame:
    fields = [T.StructField("record", schema), T.StructField("_broken", T.StringType())]
    if unknown:  # the same text once more, as all its fields
        fields.insert(1, T.StructField("all", T.MapType(T.StringType(), T.StringType())))
    wrapped = T.StructType(fields)

    def from_json(text: Column) -> Column:
        again = [F.lit(', "all": '), text] if unknown else []
        return F.from_json(F.concat(F.lit('{"record": '), text, *again, F.lit("}")), wrapped, _JSON_OPTIONS)

    staged, renamed, shaped = _renamed(lines, line, literal)
    staged = computed(staged, _fast=F.when(shaped, from_json(renamed)))
    fast_ok = F.col("_fast").isNotNull() & F.col("_fast._broken").isNull()
    staged = staged.withColumn("_rest", _literal_to_json(F.when(~fast_ok, F.col("_literal"))))
    slow = F.when(F.col("_rest").isNotNull(), from_json(F.col("_rest")))
    parsed = computed(staged, _parsed=F.when(fast_ok, F.col("_fast")).otherwise(slow))
    found = [F.col("_parsed.record").alias("record")]
    if unknown:
        others = F.map_filter("_parsed.all", lambda name, _: ~name.isin(schema.fieldNames()))
        found.append(F.when(F.size(others) > 0, others).alias(unknown))
    return parsed.select(*[c for c in lines.columns if c != line], line, *found)


def _patched(line: Column) -> Column:
    literal = F.replace(line, F.lit('""http'), F.lit('"http'))
    for word, other in {"NaN": "None", "true": "True", "false": "False"}.items():
        literal = _rename_bare_word(literal, word, other)
    return literal


def parse_literal_records(lines: DataFrame, schema: T.StructType | None, line: str = "value", unknown: str | None = None) -> DataFrame:
    """Adds `record`, the parsed literal of each line; null where the line is no record.

    Without a schema the one found over all lines is used, in a pass of its own. `unknown` names a column for the fields of a
    record that the schema lacks, as a map of names to texts, null if there are none.
    """
    return _parse(lines, schema or found_schema(lines, line), line, F.col(line), unknown)


def parse_patched_records(lines: DataFrame, schema: T.StructType | None, line: str = "value", unknown: str | None = None) -> DataFrame:
    """Same for lines that mix in JSON words: NaN, true and false count as None, True and False, and a
    doubled quote before a web address as a single one. Words inside strings stay as they are."""
    return _parse(lines, schema or found_schema(lines, line, patched=True), line, _patched(F.col(line)), unknown)


def found_schema(lines: DataFrame, line: str = "value", patched: bool = False) -> T.StructType:
    """The fields of all records, at every level, with the narrowest types that hold all values.

    Types form a lattice that tasks fold by themselves and that is merged across them: a null fits any type, whole numbers
    widen to longer ones and to fractions, lists to the type of all elements and records to the union of their fields;
    what has no other common type is text, as is a field that is always null, always an empty list's element or
    always an empty record. Lines that hold no record do not count.
    """
    staged, renamed, shaped = _renamed(lines.select(line), line, _patched(F.col(line)) if patched else F.col(line))
    value = lambda text: F.from_json(text, "variant", _VARIANT_OPTIONS)
    staged = computed(staged, _fast=F.when(shaped, value(renamed)))
    staged = staged.withColumn("_rest", _literal_to_json(F.when(F.col("_fast").isNull(), F.col("_literal"))))
    found = staged.agg(F.schema_of_variant_agg(F.coalesce("_fast", value(F.col("_rest")))).alias("found")).first()["found"]
    if not found.startswith("OBJECT<") or found == "OBJECT<>":  # no record at all, or none with a field
        return T.StructType()
    return T.StructType.fromDDL(f"record {_VARIANT_WORDS.sub(_usual_type, found)}")["record"].dataType


def _usual_type(found: re.Match) -> str:
    word = found[0]
    if word.startswith("`"):
        return word
    if word.startswith("DECIMAL"):  # whole numbers beyond 64 bits stay exact
        return "DECIMAL(38,0)" if found["scale"] == "0" else "DOUBLE"
    return "STRUCT<" if word == "OBJECT<" else "STRING"


def widened(declared: T.StructType, found: T.StructType) -> T.StructType:
    """The declared fields with their types and, at every level, the found ones that it lacks."""

    def merged(own: T.DataType, other: T.DataType) -> T.DataType:
        if isinstance(own, T.StructType) and isinstance(other, T.StructType):
            return widened(own, other)
        if isinstance(own, T.ArrayType) and isinstance(other, T.ArrayType):
            return T.ArrayType(merged(own.elementType, other.elementType))
        return own

    others = {f.name: f for f in found}
    fields = [T.StructField(f.name, merged(f.dataType, others[f.name].dataType) if f.name in others else f.dataType) for f in declared]
    return T.StructType(fields + [f for f in found if f.name not in declared.fieldNames()])


def schema_paths(schema: T.StructType) -> list[tuple[str, str]]:
    """Path and type of every field that holds no further ones; `[]` stands for the elements of a list."""

    def walk(path: str, kind: T.DataType) -> list[tuple[str, str]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in walk(f"{path}.{f.name}" if path else f.name, f.dataType)]
        if isinstance(kind, T.ArrayType):
            return walk(f"{path}[]", kind.elementType)
        return [(path, kind.simpleString())]

    return walk("", schema)


def good_records(parsed: DataFrame) -> DataFrame:
    """The parsed records as columns."""
    return parsed.where(F.col("record").isNotNull()).select("record.*")


def rejected_records(parsed: DataFrame) -> DataFrame:
    """The lines that hold no record, with whatever columns came along."""
    return parsed.where(F.col("record").isNull()).drop("record")
