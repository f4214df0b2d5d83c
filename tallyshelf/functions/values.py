"""Column expressions for imperfect numbers, prices, dates and shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price texts that carry a number, and texts that mean "free".
PRICE_TEXTS = {"Starting at $499.00": 499.0, "Starting at $449.00": 449.0}
FREE_TEXTS = [
    "Free To Play",
    "Install Now",
    "Play WARMACHINE: Tactics Demo",
    "Free Mod",
    "Install Theme",
    "Third-party",
    "Free HITMAN™ Holiday Pack",
    "Play Now",
    "Free to Try",
    "Free Movie",
    "Free to Use",
    "Free to Play",
    "Free",
    "Free Demo",
    "Play the Demo",
    "Play for Free!",
]

# Accepted date formats, tried in this order after the ISO forms; the month comes first where both fit.
DATE_FORMATS = [
    "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "MMM yyyy", "MMMM yyyy", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy",
    "MMM d yyyy", "MMMM d yyyy", "d MMM, yyyy", "d MMM yyyy",
]
WHOLE = r"^\s*([-+]?[0-9]{1,18})(?:\.0*)?\s*$"

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double, null where it is not a plain decimal number."""
    text = text.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_whole(text: Column) -> Column:
    """Text to bigint, also with a fraction of zeros; null where it is not a whole number of up to 18 digits."""
    return F.nullif(F.regexp_extract(text.cast("string"), WHOLE, 1), F.lit("")).try_cast("bigint")


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def map_price_text(price: Column) -> Column:
    """Whole-string replacement of the known price texts by their number, as text."""
    known = F.lit(None).cast("string")
    for text, number in PRICE_TEXTS.items():
        known = F.when(price == text, F.lit(str(number))).otherwise(known)
    return F.when(price.isin(FREE_TEXTS), F.lit("0")).otherwise(F.coalesce(known, price))


def to_date(text: Column) -> Column:
    """Text to date by the ISO forms, then by DATE_FORMATS, then by its tokens; null where nothing fits."""
    given = F.nullif(F.trim(text), F.lit(""))  # no text would fit the formats, which are all optional
    text = F.regexp_replace(given, r"(?i)\bsept\b", "Sep")
    parsed = F.try_to_timestamp(text, F.lit("".join(f"[{fmt}]" for fmt in DATE_FORMATS)))
    return F.coalesce(text.try_cast("date"), parsed.cast("date"), _date_by_tokens(given))


# Month names, the first letters that tell them apart, and how they go on.
MONTHS = ["jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?"]
WEEKDAY = r"(?<![a-z])(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])"
TIME = r"(?:[\sT]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]\.?m\.?)?)$"
# The orders of tokens that are a date: @ marks a month by name. Year, month and day are y, m and d; a day that is not there is the first.
TOKEN_RULES = [
    (r"^(\d{4}) (\d{1,2}) (\d{1,2})$", "ymd"), (r"^(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})$", "mdy"),
    (r"^@(\d{2}) (\d{1,2}) (\d{4}|\d{2})$", "mdy"), (r"^(\d{1,2}) @(\d{2}) (\d{4}|\d{2})$", "dmy"), (r"^(\d{4}) @(\d{2}) (\d{1,2})$", "ymd"),
    (r"^(\d{4}) (\d{1,2}) @(\d{2})$", "ydm"), (r"^@(\d{2}) (\d{4})$", "my"), (r"^(\d{4}) @(\d{2})$", "ym"), (r"^(\d{1,2}) (\d{4})$", "my"), (r"^(\d{4}) (\d{1,2})$", "ym"),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date_by_tokens(text: Column) -> Column:
    """Text to date by its tokens: numbers, ordinals and month names in one of the orders above.

    Weekdays and a time of day are left out, and blanks, commas, points, slashes and hyphens part tokens alike. Of two
    small numbers the first is the month, unless it exceeds 12. Two digits are a year from 1969 to 2068.
    """
    low = F.regexp_replace(F.lower(text), TIME, "")
    low = F.regexp_replace(low, WEEKDAY, " ")
    low = F.regexp_replace(low, r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)(?![a-z])", "$1 ")
    low = F.regexp_replace(low, r"(?<![a-z])(?:of|the)(?![a-z])", " ")
    for number, name in enumerate(MONTHS, 1):
        low = F.regexp_replace(low, rf"(?<![a-z]){name}(?![a-z])", f" @{number:02d} ")
    tokens = F.trim(F.regexp_replace(low, r"[\s,./-]+", " "))

    def read(tokens: Column, pattern: str, order: str) -> Column:
        part = {c: F.regexp_extract(tokens, pattern, i) for i, c in enumerate(order, 1)}
        year, month, day = part["y"], part["m"], part.get("d", F.lit("1"))
        if "@" not in pattern and order == "mdy":
            month, day = (F.when(part["m"].try_cast("int") > 12, a).otherwise(b) for a, b in ((day, month), (month, day)))
        century = F.when(year.try_cast("int") < 69, "20").otherwise("19")
        year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
        return F.when(tokens.rlike(pattern), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))

    return _let(tokens, lambda t: F.coalesce(*[read(t, pattern, order) for pattern, order in TOKEN_RULES]))


def share_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half-even to two decimals; null for an empty whole."""
    return F.rint(F.try_divide(part.cast("double"), whole.cast("double")) * 100 * 100) / 100


def total(number: Column) -> Column:
    """Sum in the number's own type, 0 for no value at all. Sums of doubles depend on the order of rows in their last digits."""
    return F.coalesce(F.sum(number), F.lit(0))


def minutes_to_hours(minutes: Column) -> Column:
    return minutes / 60
