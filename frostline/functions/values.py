"""Keys and numbers of values, and their types when rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _seconds(column: Column, kind: T.DataType) -> Column:
    """Whole seconds since 1970 in UTC, fractions dropped towards 1970, whatever the session's time zone. Times
    without a zone are in UTC."""
    if isinstance(kind, T.TimestampNTZType):
        of_day = F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
        whole = _days(column).cast("long") * 86400 + of_day
        part = F.date_part(F.lit("SECOND"), column) % 1 != 0
    else:
        whole, part = F.unix_seconds(column), F.unix_micros(column) % 1_000_000 != 0
    return whole + F.when((whole < 0) & part, 1).otherwise(0)


def _days(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date"))


def _zoned(text: Column) -> Column:
    """Text of a time as a time; one without a zone is in UTC."""
    zoned = F.when(text.rlike(r"\d[T ]\d") & ~text.rlike(r"(?:[Zz]|UTC|[+-]\d{2}:?\d{2})$"), F.concat(text, F.lit("Z"))).otherwise(text)
    return F.when(text.rlike(r"\d[T ]\d"), zoned.try_cast("timestamp"))


def key(column: Column, kind: T.DataType) -> Column:
    """The value as text: the key of exact-match indexes and of the primary key. Null stays null.
    Numbers have no exponent and no trailing zeros; times are whole seconds, RFC 3339 in UTC."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.FloatType | T.DoubleType):
        text = column.cast("string")
        plain = F.regexp_replace(F.regexp_replace(column.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(F.isnan(column), "NaN").when(text.contains("Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).when(text.contains("E"), F.coalesce(plain, text)).otherwise(F.regexp_replace(text, r"\.0$", ""))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        plain = F.timestamp_add("SECOND", _seconds(column, kind), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return F.concat(F.replace(plain.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(column)
    return column.cast("string")


def number(column: Column, kind: T.DataType, index: str) -> Column:
    """What range conditions compare: numbers as such, dates as days and times as seconds since 1970. Text that isn't
    one gives null. Dates and times are those of UTC."""
    if index == "range":
        return column.cast("double") if isinstance(kind, T.NumericType) else F.trim(key(column, kind)).try_cast("double")
    if index == "date":
        if isinstance(kind, T.TimestampType):
            return F.floor(F.unix_seconds(column) / 86400).cast("double")
        return _days(column if isinstance(kind, T.DateType | T.TimestampNTZType) else F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}$"), column).try_cast("date")).cast("double")
    if isinstance(kind, T.DateType):
        return (_days(column) * 86400).cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return _seconds(column, kind).cast("double")
    return _seconds(_zoned(column), T.TimestampType()).cast("double")


def rendered(text: Column, index: str | None) -> Column:
    """A stored value, given as its key, as a piece of JSON, its type taken from its looks: true, false,
    numbers (not those with leading zeros: postal codes stay text), else text. Ranges accept any number."""
    quoted = F.when(text.isNotNull(), F.to_json(F.array(text)))
    quoted = F.regexp_replace(quoted, r"(?s)^\[(.*)\]$", "$1")
    bare = F.trim(text)
    whole = bare.rlike(r"^[+-]?\d{1,19}$") & bare.try_cast("bigint").isNotNull()
    real = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    shown = F.regexp_replace(bare.try_cast("double").cast("string"), r"E\+?", "e")
    if index in ("date", "datetime"):
        return quoted
    if index == "range":
        return F.when(whole, bare.try_cast("bigint").cast("string")).when(real, shown).otherwise(quoted)
    code = whole & bare.rlike("^0.")
    return F.when(text.isin("true", "false"), text).when(code, quoted).when(whole, bare.try_cast("bigint").cast("string")).when(real, shown).otherwise(quoted)
