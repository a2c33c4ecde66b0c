"""Scalar helpers over cell text.

All of them are built-in Column expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.  Each helper has a DuckDB twin
(``*_sql``) used only by the oracle queries.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar (ASCII digits, optional sign, fraction, exponent).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
# The non-finite literals a float/real column accepts.
NON_FINITE_PATTERN = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
# A clock time for `time` columns.
TIME_PATTERN = r"^\s*([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,7})?)?\s*$"
# Integer digits of a number (sign and leading zeros not counted).
INTEGER_DIGITS_PATTERN = r"^\s*[+-]?0*([0-9]*)"
# Fraction digits of a number.
FRACTION_DIGITS_PATTERN = r"[.]([0-9]*?)0*(?:$|[^0-9])"      # closing zeros carry no value

# Cell texts read as NULL (pandas' default missing-value markers).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null")

# Accepted date/time layouts.  A date part (exact shape with year, month and day
# groups, and their order) may be followed by a time part of hours and minutes, seconds, and 1
# to 6 digits of a second.
DATE_SHAPES = (
    (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", (1, 2, 3)),
    (r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", (3, 1, 2)),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3)),
)
PLAIN_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,6})?)?$"
TIME_SHAPE = r"[ T]([0-9]{2}:[0-9]{2})(:[0-9]{2})?([.][0-9]{1,6})?"

DAY_KEY_FORMAT = "yyyyMMdd"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_str(value: str) -> str:
    """Quote a Python string as a SQL literal (both engines)."""
    return "'" + str(value).replace("'", "''") + "'"


# --- S1/S2: number tests ----------------------------------------------------

def is_number(c: Column | str, allow_non_finite: bool = False) -> Column:
    c = _col(c)
    test = c.rlike(NUMBER_PATTERN)
    if allow_non_finite:
        test = test | c.rlike(NON_FINITE_PATTERN)
    return test


def is_number_sql(c: str, allow_non_finite: bool = False) -> str:
    test = f"regexp_matches({c}, {sql_str(NUMBER_PATTERN)})"
    if allow_non_finite:
        test = f"({test} OR regexp_matches({c}, {sql_str(NON_FINITE_PATTERN)}))"
    return test


def is_plain(c: Column | str) -> Column:
    """ASCII text that, blanks aside, starts and ends as a number may: where a cast to a number takes it, the grammar does too.

    Casts also strip control characters and read other scripts' digits, which the grammar doesn't."""
    c = _col(c)
    text = F.trim(c)
    return ((F.octet_length(c) == F.length(c)) & F.left(text, F.lit(1)).between("+", "9") & F.right(text, F.lit(1)).between(".", "9"))


def has_digit(c: Column | str) -> Column:
    return _col(c).rlike("[0-9]")


def has_digit_sql(c: str) -> str:
    return f"regexp_matches({c}, '[0-9]')"


def as_decimal(c: Column | str) -> Column:
    """Exact value of a number text; NULL beyond 28 integer digits."""
    return F.trim(_col(c)).try_cast("decimal(38,10)")


def as_decimal_sql(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DECIMAL(38,10))"


def as_double(c: Column | str) -> Column:
    return F.trim(_col(c)).try_cast("double")


def as_double_sql(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def _exact_limit(limit) -> bool:
    return abs(Decimal(str(limit))) < Decimal(10) ** 28


def _compare(c: Column | str, limit, op) -> Column:
    """Exact where the decimal cast holds; by double beyond 28 integer digits."""
    dec = as_decimal(c)
    if _exact_limit(limit):
        exact = op(dec, F.lit(str(limit)).cast("decimal(38,10)"))
    else:
        exact = F.when(dec.isNotNull(), op(dec.cast("double"), F.lit(float(limit))))
    return F.coalesce(exact, op(as_double(c), F.lit(float(limit))))


def _compare_sql(c: str, limit, op: str) -> str:
    dec = as_decimal_sql(c)
    lim = f"CAST('{float(limit)!r}' AS DOUBLE)"
    if _exact_limit(limit):
        exact = f"{dec} {op} CAST('{limit}' AS DECIMAL(38,10))"
    else:
        exact = f"CASE WHEN {dec} IS NOT NULL THEN CAST({dec} AS DOUBLE) {op} {lim} END"
    return f"coalesce({exact}, {as_double_sql(c)} {op} {lim})"


def compare_parsed(dec: Column, dbl: Column, limit, op) -> Column:
    """As :func:`_compare` over values parsed once: ``dec`` exact, ``dbl`` only where ``dec`` is NULL."""
    if _exact_limit(limit):
        exact = op(dec, F.lit(str(limit)).cast("decimal(38,10)"))
    else:
        exact = F.when(dec.isNotNull(), op(dec.cast("double"), F.lit(float(limit))))
    return F.coalesce(exact, op(dbl, F.lit(float(limit))))


def below(c: Column | str, limit) -> Column:
    return _compare(c, limit, lambda a, b: a < b)


def below_sql(c: str, limit) -> str:
    return _compare_sql(c, limit, "<")


def above(c: Column | str, limit) -> Column:
    return _compare(c, limit, lambda a, b: a > b)


def above_sql(c: str, limit) -> str:
    return _compare_sql(c, limit, ">")


def is_fractional(c: Column | str) -> Column:
    d = as_decimal(c)
    return d != F.floor(d)


def is_fractional_sql(c: str) -> str:
    return f"({as_decimal_sql(c)} <> floor({as_decimal_sql(c)}))"


# --- S3/S4: lengths and number parts ------------------------------------------

def text_length(c: Column | str) -> Column:
    return F.length(_col(c).cast("string")).cast("bigint")


def text_length_sql(c: str) -> str:
    return f"CAST(length(CAST({c} AS VARCHAR)) AS BIGINT)"


def integer_digits(c: Column | str) -> Column:
    return F.length(F.regexp_extract(_col(c), INTEGER_DIGITS_PATTERN, 1)).cast("bigint")


def integer_digits_sql(c: str) -> str:
    return f"CAST(length(regexp_extract({c}, {sql_str(INTEGER_DIGITS_PATTERN)}, 1)) AS BIGINT)"


def fraction_digits(c: Column | str) -> Column:
    return F.length(F.regexp_extract(F.trim(_col(c)), FRACTION_DIGITS_PATTERN, 1)).cast("bigint")


def fraction_digits_sql(c: str) -> str:
    return f"CAST(length(regexp_extract(trim({c}), {sql_str(FRACTION_DIGITS_PATTERN)}, 1)) AS BIGINT)"


def fits_decimal(c: Column | str, precision: int, scale: int) -> Column:
    return F.trim(_col(c)).try_cast(f"decimal({precision},{scale})").isNotNull()


def fits_decimal_sql(c: str, precision: int, scale: int) -> str:
    return f"(TRY_CAST(trim({c}) AS DECIMAL({precision},{scale})) IS NOT NULL)"


# --- S8: lenient date/time parse ----------------------------------------------

def _shapes() -> list[tuple[str, tuple[int, int, int]]]:
    return [(f"^{date}(?:{TIME_SHAPE})?$", order) for date, order in DATE_SHAPES]


def parse_datetime(c: Column | str) -> Column:
    """A date/time text as TIMESTAMP_NTZ, NULL if it is none.  The session's time zone plays no part."""
    c = F.trim(_col(c))

    def iso(shape: str, order: tuple[int, int, int]) -> Column:
        part = lambda g: F.regexp_extract(c, shape, g)
        y, m, d = (part(g) for g in order)
        clock = F.when(part(4) == "", "00:00:00").otherwise(F.concat(
            part(4), F.when(part(5) == "", ":00").otherwise(part(5)), part(6)))
        return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit(" "), clock)

    # what the cast reads as it stands comes first: no pieces are cut out of it
    return F.coalesce(F.when(c.rlike(PLAIN_SHAPE), c),
                      *[F.when(c.rlike(shape), iso(shape, order)) for shape, order in _shapes()]).try_cast("timestamp_ntz")


def parse_datetime_sql(c: str) -> str:
    def iso(shape: str, order: tuple[int, int, int]) -> str:
        part = lambda g: f"regexp_extract(trim({c}), {sql_str(shape)}, {g})"
        y, m, d = (part(g) for g in order)
        clock = (f"CASE WHEN {part(4)} = '' THEN '00:00:00' ELSE {part(4)} || CASE WHEN {part(5)} = '' THEN ':00' "
                 f"ELSE {part(5)} END || {part(6)} END")
        return f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') || ' ' || {clock}"

    return "TRY_CAST(coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches(trim({c}), {sql_str(shape)}) THEN {iso(shape, order)} END" for shape, order in _shapes()) + ") AS TIMESTAMP)"


def is_time(c: Column | str) -> Column:
    return _col(c).rlike(TIME_PATTERN)


def is_time_sql(c: str) -> str:
    return f"regexp_matches({c}, {sql_str(TIME_PATTERN)})"


# --- S5/S6/S10/S13: names, day keys, file names, authors ------------------------

def day_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), DAY_KEY_FORMAT)


def day_key_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y%m%d')"


def base_name(path: Column | str) -> Column:
    # a regular expression would try every place of the path
    return F.substring_index(F.substring_index(_col(path), "/", -1), "\\", -1)


def base_name_sql(path: str) -> str:
    return f"regexp_extract({path}, '([^/\\\\]*)$', 1)"


def extension(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"(\.[^./\\]*)$", 1)


def extension_sql(path: str) -> str:
    return f"regexp_extract({path}, '(\\.[^./\\\\]*)$', 1)"


def authors_text(authors: Column | str) -> Column:
    """', '-joined author list; NULL when there is none."""
    a = _col(authors)
    return F.when(F.size(a) > 0, F.array_join(a, ", "))


def mode_of_tab(tab: Column | str) -> Column:
    """Update wins over insert; case-insensitive substring; else NULL."""
    t = F.lower(_col(tab))
    return F.when(t.contains("update_"), F.lit("update")).when(t.contains("insert_"), F.lit("insert"))


def mode_of_tab_sql(tab: str) -> str:
    return (f"CASE WHEN contains(lower({tab}), 'update_') THEN 'update' "
            f"WHEN contains(lower({tab}), 'insert_') THEN 'insert' END")


def is_schema_table(name: Column | str) -> Column:
    """Exactly ``schema.table``."""
    n = _col(name)
    return n.isNotNull() & (F.size(F.split(n, "[.]")) == 2)


def is_schema_table_sql(name: str) -> str:
    return f"({name} IS NOT NULL AND len(string_split({name}, '.')) = 2)"
