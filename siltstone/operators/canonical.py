"""Canonical JSON texts of nested columns, made in the plan from their types: keys in order, exact numbers, bytes that never vary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short escapes of JSON strings; other control characters are \u00XX in lower case.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_LONG = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _SHORT}

#: A struct of this one field stands for a value that is JSON already, of whatever kind.
RAW = "json"


def quoted(value: Column, ascii_only: bool = False) -> Column:
    """The JSON string of a text; with ascii_only code points over 126 are escaped, those over U+FFFF as two."""
    out = value
    for char, escape in _SHORT.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in _LONG.items()])
    out = _with(out, lambda s: F.when(s.rlike(r"[\x00-\x1f]"), F.aggregate(table, s, lambda acc, x: F.replace(acc, x["c"], x["e"]))).otherwise(s))
    if ascii_only:
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

        def one(c: Column) -> Column:
            code = F.ascii(c)
            high, low = F.floor((code - 0x10000) / 1024) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
            return F.when(code < 127, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

        out = _with(out, lambda s: F.when(s.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c == "", c).otherwise(one(c))), "")).otherwise(s))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def text(value: Column, kind: T.DataType, indent: int | None = None, ascii_only: bool = False, level: int = 0) -> Column:
    """The JSON text of a column of a type: keys sorted by code point, null as null.

    Without an indent there is no white space at all; with one, every item and key is on a line of its own, empty lists and
    objects stay on theirs. Whole numbers are told exactly. Fractions are refused (ValueError), for their text would
    depend on who writes it; so are other types without a JSON form. A struct of the one field `json` is taken as it is.
    """
    inner, outer = ("", "") if indent is None else ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level)
    colon = ":" if indent is None else ": "
    deeper = lambda v, k: text(v, k, indent, ascii_only, level + 1)

    def wrapped(parts: Column, ends: str) -> Column:
        body = F.concat(F.lit(ends[0] + inner), F.array_join(parts, "," + inner), F.lit(outer + ends[1]))
        return F.when(F.size(parts) == 0, F.lit(ends)).otherwise(body)

    if isinstance(kind, T.StringType):
        out = quoted(value, ascii_only)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        out = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    elif isinstance(kind, T.ArrayType):
        out = _with(F.transform(value, lambda x: deeper(x, kind.elementType)), lambda p: wrapped(p, "[]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: k))
        pairs = F.transform(entries, lambda k: F.concat(quoted(k, ascii_only), F.lit(colon), deeper(F.element_at(value, k), kind.valueType)))
        out = _with(pairs, lambda p: wrapped(p, "{}"))
    elif isinstance(kind, T.StructType) and kind.names == [RAW]:
        return F.coalesce(value[RAW], F.lit("null"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        pairs = F.array(*[F.concat(quoted(F.lit(f.name), ascii_only), F.lit(colon), deeper(value[f.name], f.dataType)) for f in fields])
        body = F.concat(F.lit("{" + inner), F.array_join(pairs, "," + inner), F.lit(outer + "}")) if fields else F.lit("{}")  # its parts are read once
        out = F.when(value.isNotNull(), body)
    else:
        raise ValueError(f"no canonical text of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def least_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that the text of a value can't have fewer of, counted without rendering any of it: lengths, keys and separators alone.
    Escapes and indents only add to it."""
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    if isinstance(kind, T.StringType):
        out = F.octet_length(value).cast("bigint") + 2
    elif isinstance(kind, T.ArrayType):
        out = total(F.transform(value, lambda x: least_bytes(x, kind.elementType) + 1)) + 1 + (F.size(value) == 0).cast("bigint")
    elif isinstance(kind, T.MapType):
        out = total(F.transform(F.map_entries(value), lambda e: F.octet_length(e["key"]) + 4 + least_bytes(e["value"], kind.valueType))) + 1 + (F.size(value) == 0).cast("bigint")
    elif isinstance(kind, T.StructType) and kind.names == [RAW]:
        return F.coalesce(F.octet_length(value[RAW]).cast("bigint"), F.lit(4).cast("bigint"))
    elif isinstance(kind, T.StructType):
        out = F.when(value.isNotNull(), sum((least_bytes(value[f.name], f.dataType) + len(f.name.encode()) + 4 for f in kind.fields), F.lit(1 + (not kind.fields)).cast("bigint")))
    else:
        out = F.octet_length(value.cast("string")).cast("bigint")
    return F.coalesce(out, F.lit(4).cast("bigint"))


def of(df: DataFrame, column: str, indent: int | None = None, ascii_only: bool = False) -> Column:
    """The canonical text of a column of df, by the type it has there."""
    return text(F.col(column), df.schema[column].dataType, indent, ascii_only)


#: Keys that would make a record depend on its run, and starts of texts that tell of the machine it was made on.
RUN_KEYS = ("collected_at", "duration", "elapsed", "generated_at", "hostname", "pid", "started_at", "finished_at", "timestamp")
HOST_PATH = r"^(?:/|[A-Za-z]:[\\/]|\\\\|file://|~/)"


def unfit(value: Column, kind: T.DataType, path: str = "") -> Column:
    """Why a value must not be kept as evidence: an array of `path: reason`, empty if it may be.

    Refused are fractions and keys of a run (by type, so for all rows), and texts that are paths of a machine.
    """
    none = F.array().cast("array<string>")
    told = lambda why: F.array(F.lit(f"{path or '.'}: {why}"))
    if isinstance(kind, T.StringType):
        return F.when(value.rlike(HOST_PATH), told("path of a machine")).otherwise(none)
    if isinstance(kind, (T.FractionalType, T.DecimalType)) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return F.when(value.isNotNull(), told("fraction")).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_distinct(F.flatten(F.transform(value, lambda x: unfit(x, kind.elementType, path + "[]")))), none)
    if isinstance(kind, T.MapType):
        keys = F.transform(F.filter(F.map_keys(value), lambda k: k.isin(*RUN_KEYS)), lambda k: F.concat(F.lit(path + "."), k, F.lit(": key of a run")))
        values = F.flatten(F.transform(F.map_values(value), lambda x: unfit(x, kind.valueType, path + ".*")))
        return F.coalesce(F.concat(keys, F.array_distinct(values)), none)
    if isinstance(kind, T.StructType):
        parts = [F.when(value[f.name].isNotNull(), F.array(F.lit(f"{path}.{f.name}: key of a run"))).otherwise(none) for f in kind.fields if f.name in RUN_KEYS]
        parts += [unfit(value[f.name], f.dataType, f"{path}.{f.name}") for f in kind.fields]
        return F.concat(*parts) if parts else none
    return none
