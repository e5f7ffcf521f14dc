"""Lenient casts from text (TYP-3 to TYP-8). Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucarne.functions.vocabulary import FALSE_MARKERS, LENIENT_TRUE_MARKERS, MONTHS, TRUE_MARKERS

# Accepted spellings, tried in turn, the first valid one wins. Each is a shape and
# the rewriting that turns it into year-month-day, which Spark casts without a formatter.
DATE_SHAPES = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
]
NAMED_DATE_SHAPES = [
    (r"^(\d{1,2})-(\d{4})-(\d{1,2})$", "$2-$1-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
]
_CLOCK = r"(\d{1,2}:\d{1,2}:\d{1,2})"
TIMESTAMP_SHAPES = [
    (rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}) {_CLOCK}$", "$1 $2"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}}) {_CLOCK}$", "$3-$2-$1 $4"),
    (rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}})T{_CLOCK}$", "$1 $2"),
    (rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}) {_CLOCK}(\.\d{{1,9}})$", "$1 $2$3"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}) (\d{1,2}:\d{1,2})$", "$1 $2:00"),
]
UNIX_MILLIS_ABOVE = 10**11
LONGEST_NAMED_DATE = 24    # two nine-letter months, a year, two separators


def trimmed(c: Column) -> Column:
    """The cell as text without surrounding white space."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def to_boolean_lenient(c: Column) -> Column:
    """True markers are true, every other value is false, null stays null (TYP-3)."""
    return trimmed(F.lower(c.cast("string"))).isin(LENIENT_TRUE_MARKERS)


def to_boolean_strict(c: Column) -> Column:
    """True and false markers only, anything else is null (TYP-4)."""
    text = F.lower(trimmed(c))
    return F.when(text.isin(TRUE_MARKERS), F.lit(True)).when(text.isin(FALSE_MARKERS), F.lit(False))


def _first_shape(text: Column, shapes: list[tuple[str, str]], target: str) -> Column:
    return F.coalesce(*[
        F.when(text.rlike(shape), F.regexp_replace(text, shape, order).try_cast(target)) for shape, order in shapes
    ])


def _months_as_numbers(text: Column) -> Column:
    """Lower-cased words that name a month, at their first occurrence, become its number."""
    months = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    words = F.split(F.lower(text), r"(?U)\b")
    def numbered(word: Column, i: Column) -> Column:
        return F.when(F.array_position(words, word) == i + 1, F.coalesce(F.try_element_at(months, word), word)).otherwise(word)

    return F.array_join(F.transform(words, numbered), "")


def to_date(c: Column) -> Column:
    """Dates written with ``- / .`` or blanks, then dates with a French or English month name (TYP-5)."""
    text = trimmed(c)
    plain = _first_shape(F.regexp_replace(text, r"[/.\s]", "-"), DATE_SHAPES, "date")
    # Separators first: what is left of a date is at most two month names and a year, so longer
    # cells (whole documents) are ruled out before their words are looked up.
    joined = F.regexp_replace(F.regexp_replace(text, r"[\s/.]+", "-"), r"^-+|-+$", "")
    # The one-element transform evaluates the replaced text once for all three shapes.
    named = F.get(F.transform(
        F.array(_months_as_numbers(joined)), lambda t: _first_shape(t, NAMED_DATE_SHAPES, "date")
    ), F.lit(0))
    worth_it = (F.length(joined) <= LONGEST_NAMED_DATE) & joined.rlike(r"\p{L}")
    return F.coalesce(plain, F.when(worth_it, named))


def to_timestamp(c: Column) -> Column:
    """Date and time, five spellings after ``/`` became ``-`` (TYP-6); wall-clock, without zone."""
    return _first_shape(F.regexp_replace(trimmed(c), "/", "-"), TIMESTAMP_SHAPES, "timestamp_ntz")


def unix_to_timestamp(c: Column) -> Column:
    """Seconds or, above 10^11, milliseconds since 1970 (TYP-7)."""
    number = c.cast("string").try_cast("bigint")
    millis = F.when(number > UNIX_MILLIS_ABOVE, number).otherwise(number * 1000)
    return F.timestamp_millis(millis)


def clean_number(c: Column) -> Column:
    """Keep digits, points, commas and minus signs; the first comma becomes a point (TYP-8)."""
    kept = F.regexp_replace(c.cast("string"), r"[^\d.,\-]", "")
    return F.regexp_replace(kept, r"^([^,]*),(.*)$", "$1.$2").try_cast("double")


def clean_integer(c: Column) -> Column:
    """As ``clean_number``, then truncated towards zero (TYP-8)."""
    return clean_number(c).try_cast("bigint")


NUMERIC_PREFIXES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TEMPORAL = ("date", "timestamp", "timestamp_ntz")


def is_numeric_type(dtype: str) -> bool:
    """Whether a ``df.dtypes`` entry is a number type ("interval ..." is not)."""
    return dtype in NUMERIC_PREFIXES or dtype.startswith("decimal(")


def recast(c: Column, dtype: str, target: str, through_text: bool = False) -> Column:
    """Cast to one of the six user-facing types: Int64, Float64, String, Boolean, Date, Datetime.

    ``through_text`` is the recast operator's stricter reading: values that are neither text nor
    number are cleaned as text, and booleans take only known markers. Numbers are never sent
    through text, because Spark prints large doubles with an exponent.
    """
    if target == "String":
        return c.cast("string")
    if target in ("Int64", "Float64"):
        whole = target == "Int64"
        if dtype == "string" or (through_text and not is_numeric_type(dtype)):
            return clean_integer(c) if whole else clean_number(c)
        if dtype == "date":
            c = F.unix_date(c)
        elif dtype in TEMPORAL:
            c = F.unix_micros(c.cast("timestamp"))
        return c.try_cast("bigint" if whole else "double")
    if target == "Boolean":
        return to_boolean_strict(c) if through_text else to_boolean_lenient(c)
    if target == "Date":
        return c.cast("date") if dtype in TEMPORAL else to_date(c)
    if target == "Datetime":
        return c.cast("timestamp_ntz") if dtype in TEMPORAL else to_timestamp(c)
    raise ValueError(f"unknown target type {target!r}")


def shown(column: Column, dtype: str) -> Column:
    """A cell as users write it: fractions without an exponent from 0.00001 up to 10^16, all else as Spark's text."""
    text = column.cast("string")
    if dtype not in ("float", "double"):
        return text
    size = F.abs(column)
    plain = F.when(size >= 1, text.try_cast("decimal(38,10)").cast("string")).otherwise(text.try_cast("decimal(38,24)").cast("string"))
    bare = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")
    return F.when(F.contains(text, F.lit("E")) & (size >= 1e-5) & (size < 1e16), bare).otherwise(text)
