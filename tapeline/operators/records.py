"""Record work: cast to a declared shape, flatten, check, encode, number."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    MapType,
    StringType,
    StructType,
    VariantType,
)

from tapeline.functions.fields import composite_key
from tapeline.plans.prefix import BLOCK_BITS, dense_rank_by

_COMPLEX = (ArrayType, MapType, StructType)
# The default JSON formats stop at milliseconds.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _as_type(column: Column, have: DataType, want: DataType) -> Column:
    if have == want:
        return column
    if isinstance(want, StringType) and isinstance(have, (*_COMPLEX, VariantType)):
        return F.to_json(column, _JSON)
    if isinstance(have, StringType) and isinstance(want, _COMPLEX):
        return F.from_json(column, want)
    return column.try_cast(want)


def conform_topic(
    df: DataFrame, schema: StructType, keep: Sequence[str] = ()
) -> DataFrame:
    """The declared columns in declared types.

    A value that does not cast becomes null, a missing column is all null, a column
    the schema does not know is dropped. A field declared as string takes any type:
    nested values arrive as JSON text.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [F.col(name) for name in keep]
    for f in schema.fields:
        if f.name in have:
            out.append(_as_type(F.col(f.name), have[f.name], f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def many_types_to_string(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fields that arrive in several types, as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: _as_type(F.col(c), types[c], StringType()) for c in columns}
    )


def open_variant(
    df: DataFrame, column: str, fields: Mapping[str, str | None], keep: Sequence[str] = ()
) -> DataFrame:
    """Fields of JSON text that arrive in several types, each value in the type that came.

    ``fields`` names top-level fields and the types asked for. With None a field stays a
    Variant, so a number is still a number and a text a text; with a type it is cast, and a
    value that does not cast is null. Beside each field, ``<field>_kind`` tells what came
    (null for a field that is not there). Text that is not JSON, or not an object, gives nulls.
    """
    held = df.select(*keep, F.try_parse_json(column).alias("__v"))
    out = [F.col(name) for name in keep]
    for name, kind in fields.items():
        path = f"$['{name}']"
        whole = F.try_variant_get("__v", path, "variant")
        value = whole if kind is None else F.try_variant_get("__v", path, kind)
        out += [value.alias(name), variant_kind(whole).alias(f"{name}_kind")]
    return held.select(*out)


def variant_kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean``, ``null`` or another type's name."""
    shown = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    number = shown.isin("bigint", "decimal", "double", "float")
    return F.when(number, "number").when(shown == "void", "null").otherwise(shown)


def flat_names(paths: Sequence[Sequence[str]], taken: Sequence[str] = ()) -> list[str]:
    """A column name for each nested path, all different.

    The dotted path with everything but letters and digits as ``_``; a name that is taken
    gets the next free number at its end.
    """
    used, names = {t.lower() for t in taken}, []
    for path in paths:
        plain = "".join(c if c.isalnum() else "_" for c in ".".join(path))
        name, number = plain, 1
        while name.lower() in used:
            number += 1
            name = f"{plain}_{number}"
        used.add(name.lower())
        names.append(name)
    return names


def leaf_paths(schema: StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    paths = []
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, StructType):
            paths += leaf_paths(f.dataType, path)
        else:
            paths.append(path)
    return paths


def flatten(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One column per leaf of every struct; ``keep`` names columns left as they are.

    The dotted path of a leaf stays in the column's metadata under ``path``.
    """
    out = [F.col(name) for name in keep]
    paths = leaf_paths(df.drop(*keep).schema)
    for path, name in zip(paths, flat_names(paths, keep)):
        quoted = ".".join(f"`{part}`" for part in path)
        out.append(F.col(quoted).alias(name, metadata={"path": ".".join(path)}))
    return df.select(*out)


def encode_collections(df: DataFrame) -> DataFrame:
    """Array and map columns as JSON text."""
    return df.withColumns(
        {
            f.name: F.to_json(f.name, _JSON)
            for f in df.schema.fields
            if isinstance(f.dataType, (ArrayType, MapType))
        }
    )


def conformance_report(
    df: DataFrame, schema: StructType, enums: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """How far raw columns are from their declaration: one row per declared column.

    ``rows``, ``nulls``, ``failed_casts`` (a value is there, but not of the type) and
    ``outside_enum``. All counts come from one pass with one combined aggregate.
    """
    counts, lines = _conformance(df, schema, enums or {})
    return df.agg(*counts).select(F.inline(F.array(*lines)))


def observe_conformance(
    df: DataFrame, schema: StructType, enums: Mapping[str, Sequence[str]] | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``conform_topic``, and the report of it for free: the counts are collected while the
    conformed rows are written, in that one scan. The second value gives the report as
    ``conformance_report`` would, once an action has run on the first.

    The counts are those of that action: write the rows once, whole."""
    counts, lines = _conformance(df, schema, enums or {})
    seen = Observation()
    observed = conform_topic(df.observe(seen, *counts), schema, keep)

    def report() -> DataFrame:
        values = seen.get
        row = df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in values.items()])
        return row.select(F.inline(F.array(*lines)))

    return observed, report


def _conformance(
    df: DataFrame, schema: StructType, enums: Mapping[str, Sequence[str]]
) -> tuple[list[Column], list[Column]]:
    """The counts, and the lines of the report made of them."""
    have = {f.name: f.dataType for f in df.schema.fields}
    counts, lines = [F.count("*").alias("rows")], []
    for i, f in enumerate(schema.fields):
        raw = F.col(f.name) if f.name in have else F.lit(None).cast("string")
        typed = _as_type(raw, have.get(f.name, StringType()), f.dataType)
        allowed = enums.get(f.name)
        outside = raw.isNotNull() & ~raw.isin(*allowed) if allowed else F.lit(False)
        counts += [
            F.count_if(raw.isNull()).alias(f"n{i}"),
            F.count_if(raw.isNotNull() & typed.isNull()).alias(f"c{i}"),
            F.count_if(outside).alias(f"e{i}"),
        ]
        lines.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col("rows"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"c{i}").alias("failed_casts"),
                F.col(f"e{i}").alias("outside_enum"),
            )
        )
    return counts, lines


def to_topic(
    df: DataFrame, topic: str, key: Sequence[str], meta: str | None = None
) -> DataFrame:
    """Rows as keyed envelopes: JSON value with nulls written out, ``|``-joined key.

    ``meta`` names an existing ``_meta`` struct column to carry; it is not part of
    the value. Without it ``_meta`` is null, as for records not sent yet.
    """
    value = [c for c in df.columns if c != meta]
    carried = F.col(meta) if meta else F.lit(None)
    return df.select(
        F.lit(topic).alias("topic"),
        composite_key(*key).alias("_key"),
        F.to_json(F.struct(*value), _JSON).alias("value"),
        carried.cast("struct<partition:int,offset:bigint,timestamp:timestamp_ntz>").alias("_meta"),
    )


def hash_partition(key: str, partitions: int) -> Column:
    """A partition number that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def assign_offsets(
    df: DataFrame,
    key: str,
    order: str,
    partitions: int = 3,
    partition: Column | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Adds ``partition`` and a dense 0-based ``offset`` inside it, in send order.

    ``order`` is the integral, unique send number. A log has few partitions, so a
    plain window would hold a third of all rows in one task; the numbering goes by
    blocks instead.
    """
    number = hash_partition(key, partitions) if partition is None else partition.cast("int")
    return dense_rank_by(
        df.withColumn("partition", number), ["partition"], order, "offset", block_bits
    )
