"""JSON records: key case and declared contracts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def to_camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.capitalize() for part in tail)


def rename_type(data_type: T.DataType, rename) -> T.DataType:
    """The type with every struct field renamed, at any depth. Map keys are data and stay."""
    if isinstance(data_type, T.StructType):
        return T.StructType(
            [T.StructField(rename(f.name), rename_type(f.dataType, rename), f.nullable) for f in data_type]
        )
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(rename_type(data_type.elementType, rename), data_type.containsNull)
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, rename_type(data_type.valueType, rename), data_type.valueContainsNull)
    return data_type


def rename_keys(df: DataFrame, rename) -> DataFrame:
    """Rename all keys by casting to the renamed type; only the schema changes (our definition)."""
    return df.select(
        *[F.col(f"`{f.name}`").cast(rename_type(f.dataType, rename)).alias(rename(f.name)) for f in df.schema]
    )


def conform_records(
    df: DataFrame, json: str, schema: T.StructType, required: list[str], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Parse JSON into the declared fields and list what is wrong with each record.

    Adds the declared fields (absent ones are null or their default) and ``errors``: ``malformed``,
    ``missing:<field>`` for required fields, ``type:<field>`` for values of another type. Strict
    callers keep rows without errors.
    """
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_bad", T.StringType())])
    raw = F.from_json(json, raw_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = df.withColumn("_raw", raw)
    malformed = F.col("_raw").isNull() | F.col("_raw._bad").isNotNull()
    checks = [F.when(malformed, F.lit("malformed"))]
    fields = []
    for f in schema:
        text = F.col(f"_raw.{f.name}")
        nested = isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)
        value = F.from_json(text, f.dataType) if nested else text.try_cast(f.dataType)
        if f.name in required:
            checks.append(F.when(~malformed & text.isNull(), F.lit(f"missing:{f.name}")))
        checks.append(F.when(~malformed & text.isNotNull() & value.isNull(), F.lit(f"type:{f.name}")))
        if defaults and f.name in defaults:
            value = F.when(text.isNull(), defaults[f.name].cast(f.dataType)).otherwise(value)
        fields.append(F.when(~malformed, value).alias(f.name))
    return parsed.select(*df.columns, *fields, F.array_compact(F.array(*checks)).alias("errors"))
