"""Resolve the catalog facts of a column to a mart type name and a Spark type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from sparkmart.plans.spec import ColumnSpec

# Source type names and the mart type each one becomes. Anything else becomes text.
MART_TYPES = {
    "smallint": "smallint",
    "int2": "smallint",
    "int": "integer",
    "integer": "integer",
    "int4": "integer",
    "bigint": "bigint",
    "int8": "bigint",
    "real": "real",
    "float4": "real",
    "float": "real",
    "double precision": "double precision",
    "float8": "double precision",
    "numeric": "numeric",
    "decimal": "numeric",
    "money": "money",
    "boolean": "boolean",
    "bool": "boolean",
    "character varying": "varchar",
    "varchar": "varchar",
    "character": "char",
    "char": "char",
    "bpchar": "char",
    "text": "text",
    "bytea": "bytea",
    "date": "date",
    "time with time zone": "timetz",
    "timetz": "timetz",
    "time without time zone": "time",
    "time": "time",
    "timestamp with time zone": "timestamptz",
    "timestamptz": "timestamptz",
    "timestamp without time zone": "timestamp",
    "timestamp": "timestamp",
    "interval": "interval",
    "uuid": "uuid",
    "json": "json",
    "jsonb": "jsonb",
    "xml": "xml",
    "inet": "inet",
    "cidr": "cidr",
    "macaddr": "macaddr",
    "macaddr8": "macaddr8",
    "bit": "varbit",
    "varbit": "varbit",
    "bit varying": "varbit",
    "tsvector": "tsvector",
    "tsquery": "tsquery",
    "point": "point",
    "line": "line",
    "lseg": "lseg",
    "box": "box",
    "path": "path",
    "polygon": "polygon",
    "circle": "circle",
    "int4range": "int4range",
    "numrange": "numrange",
    "daterange": "daterange",
    "tsrange": "tsrange",
    "tstzrange": "tstzrange",
}

# Mart types with a native Spark type; the others are kept as text.
SPARK_TYPES = {
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "money": T.DecimalType(19, 2),
    "boolean": T.BooleanType(),
    "bytea": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}

# The compact profile knows only these source names; everything else is a string.
COMPACT_TYPES = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "int4": T.IntegerType(),
    "bigint": T.LongType(),
    "int8": T.LongType(),
    "double precision": T.DoubleType(),
    "float8": T.DoubleType(),
    "float4": T.FloatType(),
    "real": T.FloatType(),
    "boolean": T.ShortType(),
    "bool": T.ShortType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp without time zone": T.TimestampType(),
    "timestamptz": T.TimestampType(),
}

_SUFFIX = re.compile(r"^(?P<head>[^(]*)\((?P<args>[\d\s,]+)\)(?P<tail>.*)$")


@dataclass(frozen=True)
class MartType:
    """A resolved type: its name, numeric arguments and whether it is an array."""

    name: str
    args: tuple[int, ...] = ()
    is_array: bool = False

    @property
    def ddl(self) -> str:
        args = f"({','.join(map(str, self.args))})" if self.args and self.name != "varbit" else ""
        return f"{self.name}{args}{'[]' if self.is_array else ''}"

    @property
    def length(self) -> int | None:
        """Declared length of a varchar, char or bit type."""
        return self.args[0] if self.args and self.name in ("varchar", "char", "varbit") else None

    @property
    def is_temporal(self) -> bool:
        return not self.is_array and self.name in ("date", "time", "timetz", "timestamp", "timestamptz")


def _clean(text: str) -> str:
    return " ".join((text or "").lower().split())


def _parse(text: str) -> tuple[str, tuple[int, ...], bool]:
    """Split ``varchar(20)``, ``_int4`` or ``int4[]`` into name, arguments and array flag."""
    text = _clean(text)
    array = text.startswith("_") or text.endswith("[]")
    text = text.removeprefix("_").removesuffix("[]")
    hit = _SUFFIX.match(text)
    if not hit:
        return text, (), array
    args = tuple(int(a) for a in hit["args"].split(",") if a.strip())
    return _clean(f"{hit['head']} {hit['tail']}"), args, array


def mart_type(col: ColumnSpec) -> MartType:
    """The type a column has in the mart.

    The element type of an array comes from the udt name, else from the plain type. User-defined types
    are text. The base name is taken from udt, then data type, then the plain type.
    """
    udt, udt_args, udt_array = _parse(col.udt_name)
    data, data_args, _ = _parse(col.data_type)
    plain, plain_args, plain_array = _parse(col.type)
    array = udt_array or plain_array or data == "array"

    if data == "user-defined":
        return MartType("text", is_array=udt_array or plain_array)
    named = [(n, a) for n, a in ((udt, udt_args), (data, data_args)) if n and n != "array"]
    base, args = named[0] if named else (plain, plain_args)
    name = MART_TYPES.get(base, "text")
    if name == "numeric":
        given = tuple(n for n in (col.num_precision, col.num_scale) if n is not None)
        args = given if col.num_precision is not None else args or plain_args
    elif name in ("varchar", "char"):
        args = (col.char_max_len,) if col.char_max_len is not None else (args or plain_args)[:1]
        if not args:
            name = "text"
    elif name == "varbit":
        args = (args or plain_args)[:1]
    else:
        args = ()
    return MartType(name, args, array)


def _element(kind: MartType) -> T.DataType:
    if kind.name == "numeric":
        precision, scale = (*kind.args, 0)[:2] if kind.args else (38, 18)
        return T.DecimalType(precision, scale) if precision <= 38 else T.StringType()
    return SPARK_TYPES.get(kind.name, T.StringType())


def spark_type(col: ColumnSpec, profile: str = "full") -> T.DataType:
    """The Spark type of a mart column under the ``full`` or the ``compact`` profile."""
    if profile == "compact":
        return COMPACT_TYPES.get(_clean(col.type), T.StringType())
    kind = mart_type(col)
    element = _element(kind)
    return T.ArrayType(element) if kind.is_array else element


def type_name(dtype: T.DataType) -> str:
    """The source type name that stands for a Spark type (the inverse of ``spark_type``)."""
    if isinstance(dtype, T.ArrayType):
        return f"_{type_name(dtype.elementType)}"
    if isinstance(dtype, T.DecimalType):
        return f"numeric({dtype.precision},{dtype.scale})"
    # Money shares its Spark type with a decimal, so only plain types are looked up here.
    return next((n for n, t in SPARK_TYPES.items() if t == dtype), "text")


def row_type(**fields: T.DataType) -> T.StructType:
    """A row schema from ``name=type`` pairs."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])
