"""Type names of catalog columns: parse, render, normalize, map to Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Internal type names and the names people write.
TYPE_ALIASES = {
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "bool": "boolean",
    "bpchar": "char",
    "float4": "real",
    "float8": "double precision",
    "timetz": "time with time zone",
    "varbit": "bit varying",
    "decimal": "numeric",
}

# One-letter codes of referential actions.
ACTION_CODES = {
    "a": "no_action",
    "r": "restrict",
    "c": "cascade",
    "n": "set_null",
    "d": "set_default",
}

# Fixed value: the accepted form of a written type.
_PATTERN = r"^\s*([a-zA-Z ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$"


def _lookup(mapping: dict[str, str], col: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def parse_type(col: Column) -> Column:
    """`varchar(255)` to `struct<base, params>`; null when it does not parse."""
    base = F.lower(F.trim(F.regexp_extract(col, _PATTERN, 1)))
    params = F.filter(
        F.array(
            F.regexp_extract(col, _PATTERN, 2).try_cast("int"),
            F.regexp_extract(col, _PATTERN, 3).try_cast("int"),
        ),
        lambda p: p.isNotNull(),
    )
    written = F.filter(
        F.array(F.regexp_extract(col, _PATTERN, 2), F.regexp_extract(col, _PATTERN, 3)), lambda p: p != ""
    )
    ok = col.rlike(_PATTERN) & (base != "") & (F.size(params) == F.size(written))
    return F.when(ok, F.struct(base.alias("base"), params.alias("params")))


def render_type(base: Column, params: Column) -> Column:
    """The inverse of `parse_type`."""
    has_params = F.coalesce(F.size(params), F.lit(0)) > 0
    listed = F.array_join(F.transform(params, lambda p: p.cast("string")), ",")
    return F.when(has_params, F.concat(base, F.lit("("), listed, F.lit(")"))).otherwise(base)


def normal_type_name(col: Column) -> Column:
    name = F.lower(F.trim(col))
    return F.coalesce(_lookup(TYPE_ALIASES, name), name)


def action_name(code: Column) -> Column:
    return F.coalesce(_lookup(ACTION_CODES, code), F.lit("no_action"))


def action_words(action: Column) -> Column:
    return F.upper(F.replace(action, F.lit("_"), F.lit(" ")))


def spark_type(name: str) -> T.DataType | None:
    """Spark type of a rendered type name, or None where there is none."""
    base, _, rest = name.strip().lower().partition("(")
    params = [int(p) for p in rest.rstrip(")").split(",") if p.strip().isdigit()]
    base = TYPE_ALIASES.get(base.strip(), base.strip())
    simple = {
        "smallint": T.ShortType(),
        "integer": T.IntegerType(),
        "bigint": T.LongType(),
        "bigserial": T.LongType(),
        "boolean": T.BooleanType(),
        "char": T.StringType(),
        "varchar": T.StringType(),
        "text": T.StringType(),
        "real": T.FloatType(),
        "double precision": T.DoubleType(),
        "timestamp": T.TimestampNTZType(),
        "date": T.DateType(),
    }
    if base == "numeric":
        precision = params[0] if params else 38
        scale = params[1] if len(params) > 1 else (0 if params else 18)
        return T.DecimalType(precision, scale)
    return simple.get(base)


def length_limit(name: str) -> int | None:
    """`n` of `char(n)` and `varchar(n)`."""
    base, _, rest = name.strip().lower().partition("(")
    if base.strip() in ("char", "varchar", "bpchar") and rest.rstrip(")").strip().isdigit():
        return int(rest.rstrip(")"))
    return None
