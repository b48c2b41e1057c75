"""Coercions of untyped values. All are column expressions that give null, never an error, for what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_WORDS = ("true", "1", "yes", "y")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_str(x) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(_c(x).cast("string")), F.lit(""))


def safe_float(x) -> Column:
    """A finite number written plainly; anything else is null."""
    text = safe_str(x)
    return finite(F.when(text.rlike(NUMBER), text.try_cast("double")))


def safe_int(x) -> Column:
    """An integral number; fractions, words and blanks are null."""
    number = safe_float(x)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def truncated_int(x) -> Column:
    return safe_float(x).try_cast("bigint")


def finite(x) -> Column:
    """Null for NaN and infinities."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nan_to_null(x) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def flag(x) -> Column:
    """True for true, 1, yes and y in any case; False for all else, null too."""
    return F.coalesce(F.lower(_c(x).cast("string")).isin(*TRUE_WORDS), F.lit(False))


def nullable_flag(x) -> Column:
    """As flag, over trimmed text; null stays null."""
    return F.lower(F.trim(_c(x).cast("string"))).isin(*TRUE_WORDS)


def or_default(x, default) -> Column:
    """default for null and the empty string."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def matches_kind(x, kind: str) -> Column:
    """Whether a value can be read as int, float or str (not blank)."""
    return {"int": safe_int, "float": safe_float, "str": safe_str}[kind](x).isNotNull()


def in_range(x, low: float, high: float) -> Column:
    return F.coalesce(safe_float(x).between(low, high), F.lit(False))


def ratio(a, b) -> Column:
    """a / b; null where b is zero or null."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def ensure_columns(df: DataFrame, schema) -> DataFrame:
    """The schema's columns, in its order and types; missing ones as nulls."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def one_or_many(text, element: str) -> Column:
    """JSON that holds one object or an array of them, as an array of struct `element`; null if it is neither."""
    x = F.trim(_c(text))
    many, one = F.from_json(x, f"array<{element}>"), F.from_json(x, element)
    return F.when(x.startswith("["), many).when(x.startswith("{"), F.array(one))


def mapped(x, values: dict, default) -> Column:
    """A value for each key, default for all others."""
    pairs = [F.lit(v) for kv in values.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(x)), F.lit(default))


def first_match(branches: list[tuple[Column, object]], default) -> Column:
    """The value of the first condition that holds."""
    out = None
    for when, value in branches:
        out = F.when(when, value) if out is None else out.when(when, value)
    return F.lit(default) if out is None else out.otherwise(default)


def event_key(*parts, length: int = 16) -> Column:
    """A short digest of a tuple, for once-only handling; equal tuples give equal keys."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])), 256), 1, length)
