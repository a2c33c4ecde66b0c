"""Declared SQL Server column types: families, limits and Spark types.

Every value here must equal what the source tool checks, so they are kept
together as plain text.
"""

from __future__ import annotations

from decimal import Decimal

# Declared type names by family (same names as the catalog uses).
TEXT_TYPES = ("xml", "text", "varchar", "nvarchar", "uniqueidentifier", "nchar",
              "geography", "char", "ntext")
INTEGER_TYPES = ("varbinary", "binary", "bit", "int", "tinyint", "smallint", "bigint")
DATETIME_TYPES = ("smalldatetime", "date", "datetime", "datetime2", "time")
NUMERIC_TYPES = ("money", "smallmoney", "numeric", "decimal", "float", "real")

# Inclusive (minimum, maximum) per integer-like type; binary kinds
# are checked as numbers 1..8000.
INTEGER_LIMITS = {
    "varbinary": (1, 8000),
    "binary": (1, 8000),
    "bit": (0, 1),
    "tinyint": (0, 255),
    "smallint": (-32768, 32767),
    "int": (-2147483648, 2147483647),
    "bigint": (-9223372036854775808, 9223372036854775807),
}

# Inclusive (minimum, maximum) per exact numeric type.
NUMERIC_LIMITS = {
    "money": (Decimal("-922337203685477.5808"), Decimal("922337203685477.5807")),
    "smallmoney": (Decimal("-214748.3648"), Decimal("214748.3647")),
    "decimal": (-(10 ** 38) + 1, 10 ** 38 - 1),
    "numeric": (-(10 ** 38) + 1, 10 ** 38 - 1),
}

# Default retention and edit-stamp settings for a table without its own entry.
DEFAULT_AUTO_EDIT = True
DEFAULT_SHELF_LIFE_DAYS = 14

# Columns the edit stamp writes, in order of preference.
EDIT_STAMP_COLUMNS = ("edit_dt", "edit_date")


def family(data_type: str) -> str:
    t = (data_type or "").lower()
    if t in TEXT_TYPES:
        return "text"
    if t in INTEGER_TYPES:
        return "integer"
    if t in DATETIME_TYPES:
        return "datetime"
    if t in NUMERIC_TYPES:
        return "numeric"
    return "other"


def spark_type(data_type: str, precision: int | None = None, scale: int | None = None) -> str:
    """Spark SQL type name a validated text value is cast to."""
    t = (data_type or "").lower()
    if t in ("bit",):
        return "boolean"
    if t == "tinyint":
        return "smallint"  # 0..255 does not fit a signed byte
    if t in ("smallint", "int", "bigint"):
        return t
    if t in ("binary", "varbinary"):
        return "int"
    if t == "money":
        return "decimal(19,4)"
    if t == "smallmoney":
        return "decimal(10,4)"
    if t in ("decimal", "numeric"):
        return f"decimal({precision or 18},{scale or 0})"
    if t == "float":
        return "double"
    if t == "real":
        return "float"
    if t == "date":
        return "date"
    if t in ("smalldatetime", "datetime", "datetime2"):
        return "timestamp_ntz"
    return "string"  # text kinds, time and anything unknown stay text
