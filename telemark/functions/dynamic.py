"""Dynamic (JSON) values: parse, path access, key listing and bag unpacking (F-8..F-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions._col import col


def parse_json(c) -> Column:
    """F-8 ``parse_json`` / ``todynamic``: VARIANT, null on bad input."""
    return F.try_parse_json(col(c))


def json_path(c, *path: str) -> Column:
    """F-9 ``v.a.b`` / ``v["k.with.dots"]`` on JSON text, as text."""
    p = "$" + "".join(f"['{k}']" if not k.isidentifier() else f".{k}" for k in path)
    return F.get_json_object(col(c), p)


def bag_keys(c) -> Column:
    """F-11 ``bag_keys``: key list of a JSON object (null for non-objects)."""
    return F.json_object_keys(col(c))


def typeof(c) -> Column:
    """F-11 ``typeof``: 'dynamic' for a JSON object or array, else 'string'."""
    return F.when(F.json_object_keys(col(c)).isNotNull() | (F.json_array_length(col(c)).isNotNull()),
                  F.lit("dynamic")).otherwise(F.lit("string"))


def variant_kind(v: Column) -> Column:
    """F-11 the kind of a VARIANT: object, array, string, boolean, number or null."""
    schema = F.schema_of_variant(v)
    return (F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
            .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number"))


def bag_rows(df: DataFrame, c: str, key: str = "key", kind: str = "kind", value: str = "value") -> DataFrame:
    """F-10 / F-11 the fields of a JSON object as rows: the other columns, then
    the field's name, kind and text (strings unquoted, null for JSON null).
    Names need not be known and no list of them is made; a text that is no
    object gives no row."""
    others = [x for x in df.columns if x != c]
    d = df.withColumn("_bag", F.try_parse_json(F.col(c)))
    rows = d.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_bag").outer())).filter("key is not null")
    field = rows["value"]
    return rows.select(*[d[x] for x in others], rows["key"].alias(key), variant_kind(field).alias(kind), field.cast("string").alias(value))


def bag_unpack(df: DataFrame, c: str, keys, prefix: str = "", drop: bool = True) -> DataFrame:
    """F-10 ``evaluate bag_unpack(c, prefix)``: one column for each of ``keys``
    (``bag_rows`` needs no keys).  Values are the JSON text of each field
    (strings unquoted), parsed once per row into a map."""
    m = F.from_json(col(c), "map<string,string>")
    out = df.withColumn("_bag", m)
    out = out.withColumns({f"{prefix}{k}": F.col("_bag")[k] for k in sorted(keys)}).drop("_bag")
    return out.drop(c) if drop else out
