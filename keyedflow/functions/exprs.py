"""Expressions over ``key`` and ``value``, with the conversions the operators need.

An expression is a Spark ``Column`` or a Spark SQL string. Conversions look at
the type Spark resolves for it, so the same call works on a typed struct field
and on a VARIANT path. On VARIANT a missing path is SQL NULL while a JSON null is
a variant null; on a struct both read as SQL NULL.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPLATE_PART = re.compile(r"@\{([^}]*)\}")
_TRUE_TEXTS = ("true", "on", "yes", "1")
_FALSE_TEXTS = ("false", "off", "no", "0")


def to_column(expr: Column | str) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


def json_path(*names: str) -> str:
    """JSON path of nested field names; a name is taken literally, dots included."""
    for name in names:
        if "'" in name and '"' in name:
            raise ValueError(f"a JSON path cannot hold a name with both kinds of quotes: {name!r}")
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def path(*names: str) -> Column:
    """Field of a VARIANT ``value``; a struct field is simply ``F.col("value.f")``."""
    return F.variant_get("value", json_path(*names), "variant")


def resolved(df: DataFrame, expr: Column | str) -> T.StructField:
    """Type and nullability Spark resolves for ``expr`` (analysis only, runs nothing)."""
    return df.select(to_column(expr).alias("c")).schema[0]


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def _variant_text(c: Column) -> Column:
    """Text of a variant: empty for objects and arrays, NULL for null and missing.

    VARIANT keeps 10.50 as the decimal 10.5 and 10.0 as the decimal 10, but with another
    type than the integer 10; as doubles they read 10.5 and 10.0 again. Integers too long
    for a BIGINT are decimals as well, of 19 digits and more, and keep their digits.
    """
    kind = F.schema_of_variant(c)
    long_integer = kind.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")
    fraction = (kind == "DOUBLE") | (kind.startswith("DECIMAL") & ~long_integer)
    return (
        F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(""))
        .when(fraction, c.cast("double").cast("string"))
        .otherwise(c.cast("string"))
    )


def _or_raise(c: Column, message: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(message)))


def as_text(df: DataFrame, expr: Column | str, strict: bool = True) -> Column:
    """Text of an expression, as used for every key.

    Objects and arrays give empty text. Null and missing raise, unless
    ``strict=False``, which gives NULL.
    """
    c, field = to_column(expr), resolved(df, expr)
    if isinstance(field.dataType, T.VariantType):
        text = _variant_text(c)
    elif _is_nested(field.dataType):
        text = F.when(c.isNotNull(), F.lit(""))
    else:
        text = c.cast("string")
    if not strict or not field.nullable:
        return text
    return _or_raise(text, f"key expression {expr} is null or missing")


def as_bool(df: DataFrame, expr: Column | str, strict: bool = True) -> Column:
    """Boolean of an expression; null raises unless ``strict=False``.

    Numbers are true when non-zero. Texts true/on/yes/1 and false/off/no/0 convert,
    empty text is null, and any other text raises.
    """
    c, field = to_column(expr), resolved(df, expr)
    if isinstance(field.dataType, T.NumericType):
        flag = c != 0
    elif isinstance(field.dataType, T.StringType):
        low = F.lower(F.trim(c))
        flag = (
            F.when(low.isin(*_TRUE_TEXTS), F.lit(True))
            .when(low.isin(*_FALSE_TEXTS), F.lit(False))
            .when(low != "", F.raise_error(F.lit(f"predicate {expr} is not a boolean")).cast("boolean"))
        )
    elif isinstance(field.dataType, (T.BooleanType, T.VariantType)):
        flag = c.cast("boolean")
    else:
        raise ValueError(f"predicate {expr} has type {field.dataType.simpleString()}, not boolean")
    if not strict or not field.nullable:
        return flag
    return _or_raise(flag, f"predicate {expr} is null")


def as_node(df: DataFrame, expr: Column | str, strict: bool = True) -> Column:
    """Value of an expression with its type kept: JSON null stays, missing raises.

    Only VARIANT can tell missing from null; typed columns pass through.
    """
    c, field = to_column(expr), resolved(df, expr)
    if strict and field.nullable and isinstance(field.dataType, T.VariantType):
        return _or_raise(c, f"field {expr} is missing")
    return c


def as_double(df: DataFrame, expr: Column | str) -> Column:
    """Number of an expression; missing, null, nested or unparsable gives 0.0."""
    c, dtype = to_column(expr), resolved(df, expr).dataType
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.try_variant_get(c, "$", "double"), F.lit(0.0))
    if isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType)):
        return F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.lit(0.0)


def lenient_text(df: DataFrame, expr: Column | str) -> Column:
    """Text that never raises: missing, objects and arrays give ``""``; a variant null gives ``"null"``."""
    c, dtype = to_column(expr), resolved(df, expr).dataType
    if isinstance(dtype, T.VariantType):
        return F.when(F.is_variant_null(c), F.lit("null")).otherwise(F.coalesce(_variant_text(c), F.lit("")))
    if _is_nested(dtype):
        return F.lit("")
    return F.coalesce(c.cast("string"), F.lit(""))


def template(df: DataFrame, text: str) -> Column:
    """Text such as ``order:@{key}:@{value.orderId}`` with embedded Spark SQL expressions."""
    pieces = _TEMPLATE_PART.split(text)
    # re.split with one group alternates literal text (even) and expressions (odd).
    return F.concat(*[lenient_text(df, p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def now_millis() -> Column:
    """Wall clock in epoch ms; one value per query or micro-batch, not per record."""
    return F.unix_millis(F.current_timestamp())


def value_field(df: DataFrame, name: str) -> Column:
    """Top-level field of ``value`` by its plain name; NULL when there is none."""
    dtype = df.schema["value"].dataType
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get("value", json_path(name), "variant")
    if isinstance(dtype, T.StructType) and name in dtype.fieldNames():
        return F.col("value").getField(name)
    return F.lit(None).cast("double")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)
