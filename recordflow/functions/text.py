"""Text forms and lax casts that follow the record layer's rules rather than Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens read as missing in delimited input.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words read as booleans, by full-field casts and by typed list items.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
ITEM_TRUE_WORDS = ("true", "t", "1", "yes", "y")
ITEM_FALSE_WORDS = ("false", "f", "0", "no", "n")

_INT_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*(\.0+)?$"
_FLOAT_PATTERN = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FLOAT_WORDS = ("nan", "inf", "infinity", "+inf", "-inf", "+infinity", "-infinity", "+nan", "-nan")


def double_text(col: Column) -> Column:
    """Shortest decimal text of a double: ``1.0``, ``10000000.0``, ``1e+16``, ``1e-05``.

    The digits are those of the JVM, which before Java 19 may print one digit too many for some
    magnitudes outside 1e-3 to 1e17.
    """
    raw = col.cast("string")
    plain = F.regexp_replace(raw.cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0*$", "$1")
    science = F.regexp_replace(F.replace(raw, F.lit(".0E"), F.lit("E")), r"E([0-9])", "e+$1")
    science = F.regexp_replace(F.replace(science, F.lit("E-"), F.lit("e-")), r"(e[+-])([0-9])$", "$10$2")
    return (
        F.when(raw.contains("E"), F.when(F.abs(col).between(1e-4, 9999999999999998.0), plain).otherwise(science))
        .when(raw.contains("."), raw)
        .otherwise(F.lower(F.replace(raw, F.lit("inity"), F.lit(""))))
    )


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a source value as rules compare it: booleans capitalised, doubles in plain decimal."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(col.cast("double"))
    return col.cast("string")


def title_text(col: Column) -> Column:
    """Title case restarting after every non-letter, unlike ``initcap``."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip(col: Column) -> Column:
    """Trim spaces, tabs and line breaks; ``trim`` alone takes spaces only."""
    return F.btrim(col, F.lit(" \t\n\r\f\u000b"))


def blank(col: Column) -> Column:
    """True for null or whitespace-only text."""
    return F.coalesce(strip(col) == "", F.lit(True))


def null_if_na(col: Column) -> Column:
    """Missing tokens become null."""
    return F.when(~col.isin(*NA_TOKENS), col)


def lax_int(col: Column) -> Column:
    trimmed = strip(col)
    digits = F.regexp_replace(F.regexp_replace(trimmed, r"\.0+$", ""), "_", "")
    return F.when(trimmed.rlike(_INT_PATTERN), digits.try_cast("bigint"))


def lax_float(col: Column) -> Column:
    trimmed = strip(col)
    number = F.regexp_replace(trimmed, "_", "")
    lowered = F.lower(trimmed)
    return F.when(trimmed.rlike(_FLOAT_PATTERN), number.try_cast("double")).when(
        lowered.isin(*_FLOAT_WORDS),
        F.when(lowered.contains("nan"), F.lit(float("nan")))
        .when(lowered.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )


def lax_bool(col: Column) -> Column:
    word = F.lower(col)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def lax_cast(col: Column, dtype: T.DataType) -> Column:
    """Text to the declared type; null where the text is not accepted.

    Integers accept blanks around them, underscores and a zero fraction; booleans accept a fixed
    word list and no blanks around it. Other types go through ``try_cast``.
    """
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return lax_int(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return lax_float(col)
    if isinstance(dtype, T.BooleanType):
        return lax_bool(col)
    return col.try_cast(dtype)


def coerce_list_item(col: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """One typed list item from entered text: (value, error).

    Items are trimmed; blank items and unparsable numbers are errors; an unknown boolean word is a
    null item, not an error.
    """
    item = strip(col)
    empty = F.coalesce(item == "", F.lit(True))
    number = F.regexp_replace(item, "_", "")
    if isinstance(dtype, T.LongType):
        value = F.when(item.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), number.try_cast("bigint"))
    elif isinstance(dtype, T.DoubleType):
        value = lax_float(item)
    elif isinstance(dtype, T.BooleanType):
        word = F.lower(item)
        value = F.when(word.isin(*ITEM_TRUE_WORDS), F.lit(True)).when(
            word.isin(*ITEM_FALSE_WORDS), F.lit(False)
        )
    else:
        value = item
    error = F.when(empty, F.lit("no item"))
    if isinstance(dtype, (T.LongType, T.DoubleType)):
        error = error.when(value.isNull(), F.lit("invalid input"))
    return F.when(~empty, value), error


def splice(text: Column, pattern: str, replacement: Callable[[Column], Column],
           matches: Column | None = None) -> Column:
    """Replace every match by a column expression of the match; ``matches`` may pass them ready.

    The text is cut at the matches and put together again, so equal substrings elsewhere are left
    alone. The pattern must not match the empty text.
    """
    pieces = F.split(text, pattern, -1)
    if matches is None:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(
        pieces, matches, lambda piece, match: F.concat(piece, F.when(match.isNull(), F.lit("")).otherwise(replacement(match)))
    )
    return F.array_join(joined, "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a lambda over one item binds it."""
    return F.get(F.transform(F.array(value), lambda one: use(one)), F.lit(0))


_TEXT_END = "~~end-of-text~~"

# A number held as text inside parsed JSON starts with this; in JSON text the first character is escaped.
NUMBER_TAG = "\x01#"
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|-?Infinity|NaN"


def _tagged_numbers(text: Column) -> Column:
    """JSON text with every number, NaN and Infinity as a tagged string; what was no JSON stays none.

    Escaped quotes are hidden first, so that a string is a run without quotes; strings and numbers are
    then told apart by one scan that does not recurse. The marks are control characters, which JSON
    does not allow as they are.
    """
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x04")), F.lit('\\"'), F.lit("\x05"))
    marked = F.regexp_replace(hidden, f'("[^"]*+")|({_NUMBER})', "$1\x02$2\x03")
    marked = F.replace(marked, F.lit("\x02\x03"), F.lit(""))
    marked = F.replace(F.replace(marked, F.lit("\x02"), F.lit('"\\u0001#')), F.lit("\x03"), F.lit('"'))
    shown = F.replace(F.replace(marked, F.lit("\x05"), F.lit('\\"')), F.lit("\x04"), F.lit("\\\\"))
    return F.when(~text.rlike("[\x01-\x05]"), shown)


def scalar_text(value: Column) -> Column:
    """Text of a scalar that was parsed with ``as_written``: numbers as they stood in the JSON."""
    shown = value.cast("string")
    return F.when(shown.startswith(NUMBER_TAG), F.substring(shown, len(NUMBER_TAG) + 1, 2**31 - 1)).otherwise(shown)


def json_text(value: Column) -> Column:
    """Compact JSON of a value that was parsed with ``as_written``: numbers as they stood."""
    return F.regexp_replace(F.to_json(value), r'"\\u0001#([^"]*)"', "$1")


def tagged_json(text: Column) -> Column:
    """JSON text for readers that would rewrite numbers; ``untagged`` takes their answers back."""
    return _tagged_numbers(text)


def untagged(text: Column) -> Column:
    """A member read from ``tagged_json``: a number as it stood, also inside a nested value's JSON."""
    whole = F.substring(text, len(NUMBER_TAG) + 1, 2**31 - 1)
    return F.when(text.startswith(NUMBER_TAG), whole).otherwise(F.regexp_replace(text, r'"\\u0001#([^"]*)"', "$1"))


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """While plans are built inside, JSON objects may repeat a key, the last of which counts.

    Spark fixes this when it analyses a plan; the session's own setting is put back.
    """
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def strict_json(text: Column, as_written: bool = False) -> Column:
    """The text as a variant, null unless all of it is one JSON value.

    ``try_parse_json`` stops after the first value; here the text is read as the first of two array
    items, and the second must be the end mark. ``as_written`` takes NaN and Infinity too and keeps
    numbers as tagged text, for ``scalar_text`` and ``json_text``.
    """
    body = _tagged_numbers(text) if as_written else text
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{_TEXT_END}"]')))

    def first_if_whole(value: Column) -> Column:
        whole = F.try_variant_get(value, "$[1]", "string") == _TEXT_END
        return F.when(whole, F.try_variant_get(value, "$[0]", "variant"))

    return bound(wrapped, first_if_whole)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
