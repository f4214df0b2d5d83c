"""Column expressions for titles, words and lists kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def normalize_title(title: Column) -> Column:
    """Lower-case ASCII letters, digits and blanks only, without outer blanks."""
    return F.trim(F.lower(F.regexp_replace(title, "[^a-zA-Z0-9 ]", " ")))


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def text_literal(text: Column) -> Column:
    """Text as a quoted Python string; null gives None."""
    escaped = F.regexp_replace(text, r"\\", r"\\\\")
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + name))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def list_literal(items: Column) -> Column:
    """Array of texts written as a Python list, the form used in exported files."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, text_literal), ", "), F.lit("]"))


def strip_list_marks(text: Column) -> Column:
    """Remove the brackets and apostrophes of a list kept as text."""
    return F.regexp_replace(text, r"[\[\]']", "")


def list_items(text: Column) -> Column:
    """Items of a list kept as text, without outer blanks."""
    return F.transform(F.split(strip_list_marks(text), ","), lambda item: F.trim(item))
