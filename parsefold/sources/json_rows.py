"""JSON rows checked against a schema: a value or an error for each, none lost.

A row is parsed once into a variant. Every leaf of the schema is then looked up by its path:
nested structs become flat columns; a field that is missing though the schema requires it,
or that holds another kind of JSON value, is named in the error; fields that the schema does
not know are listed by their paths. All expressions of the JVM, one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.functions.arrays import fresh

NOT_JSON, NOT_OBJECT, NO_ROW = "not JSON", "not an object", "no row"
#: Kinds of JSON values by the schema's types: what schema_of_variant says begins so.
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructField, bool]]:
    """(path, field, required): structs are gone into; a field below one that may be missing
    is required only where that one is there."""
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name), f, not f.nullable


def _structs(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructField | None, T.StructType]]:
    yield path, None, schema
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            for below, field, kind in _structs(f.dataType, (*path, f.name)):
                yield below, field or f, kind


def _json_path(path: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a type of number; null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _fits(kind: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return kind == "STRING"
    if isinstance(wanted, T.BooleanType):
        return kind == "BOOLEAN"
    if isinstance(wanted, T.ArrayType):
        return kind == "ARRAY"
    if isinstance(wanted, T.MapType):
        return kind == "OBJECT"
    if isinstance(wanted, T.NumericType):
        return kind.isin(*_NUMBERS)
    return F.lit(True)


def checked_json(rows: DataFrame, column: str, schema: T.StructType, separator: str = "_", error: str = "json_error", unknown: str = "json_unknown") -> DataFrame:
    """rows with a column for each leaf of the schema, named by its path with the separator,
    and with `error` (null, or what is wrong, parts joined by "; ") and `unknown` (paths of
    fields that the schema does not know, in order of code points).

    In a row with an error the columns hold what fits. A null row has the error "no row", one
    that does not parse "not JSON", one that is no object "not an object". A JSON null counts
    as missing. Numbers fit numbers that hold them exactly enough to be cast; texts are not
    read as numbers, nor numbers as texts; an array fits if each of its elements is null or of
    the kind asked for. Of a field written twice the last counts or the row
    does not parse, as Spark's parser decides. Columns of these names are replaced; an empty
    table gives no rows."""
    parsed, raw = fresh(rows, "__variant"), F.col(column).cast("string")
    got = rows.withColumn(parsed, F.try_parse_json(raw))
    whole = F.col(parsed)
    # A variant is looked at only where it is an object, so that no path fails on a text.
    is_object = _kind(whole) == "OBJECT"
    at = lambda path: F.when(is_object, F.try_variant_get(whole, _json_path(path), "variant"))

    problems, columns = [], {}
    for path, field, _ in _structs(schema):
        if path and field is not None:
            value = at(path)
            there = value.isNotNull() & (_kind(value) != "VOID")
            problems.append(F.when(there & (_kind(value) != "OBJECT"), F.lit(f"{'.'.join(path)}: not an object")))
            own = next(f for p, f in _fields(schema) if p == path)
            if not own.nullable:
                problems.append(F.when(_parent_there(at, path) & ~F.coalesce(there, F.lit(False)), F.lit(f"{'.'.join(path)}: missing")))
    for path, field, required in _leaves(schema):
        value = at(path)
        there = F.coalesce(value.isNotNull() & (_kind(value) != "VOID"), F.lit(False))
        fits = _fits(_kind(value), field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            # Elements that don't fit would else become null.
            kind = field.dataType.elementType
            parts = F.try_variant_get(whole, _json_path(path), "array<variant>")
            fits &= ~F.coalesce(F.exists(parts, lambda x: ~F.is_variant_null(x) & ~_fits(_kind(x), kind)), F.lit(False))  # noqa: B023
        cast = F.when(there & fits, F.try_variant_get(whole, _json_path(path), field.dataType.simpleString()))
        columns[separator.join(path)] = cast
        name = ".".join(path)
        problems.append(F.when(there & (~fits | cast.isNull()), F.lit(f"{name}: not {field.dataType.simpleString()}")))
        if required:
            problems.append(F.when(_parent_there(at, path) & ~there, F.lit(f"{name}: missing")))
    found = F.array_compact(F.array(*problems))
    said = F.when(raw.isNull(), NO_ROW).when(whole.isNull(), NOT_JSON).when(~is_object, NOT_OBJECT).when(F.size(found) > 0, F.array_join(found, "; "))
    strange = []
    for path, _, kind in _structs(schema):
        keys = F.when(F.coalesce(is_object, F.lit(False)), F.json_object_keys(raw if not path else F.get_json_object(raw, _json_path(path))))
        above = F.lit("".join(f"{x}." for x in path))
        named = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(above, k))  # noqa: B023  called at once
        strange.append(F.array_except(named, F.array(*[F.lit(".".join((*path, f.name))) for f in kind]).cast("array<string>")))
    return got.withColumns({**columns, error: said, unknown: F.array_sort(F.array_distinct(F.concat(*strange)))}).drop(parsed)


def _fields(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructField]]:
    for f in schema:
        yield (*path, f.name), f
        if isinstance(f.dataType, T.StructType):
            yield from _fields(f.dataType, (*path, f.name))


def _parent_there(at, path: tuple[str, ...]) -> Column:
    """Whether the object that should hold the field is there at all."""
    return F.lit(True) if len(path) == 1 else F.coalesce(_kind(at(path[:-1])) == "OBJECT", F.lit(False))
