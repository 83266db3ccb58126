"""JSON without a fixed schema, by Spark's VARIANT type: parsed once, asked by path, taken apart to rows.

A path is dotted; a segment of digits is a list's place or an object's key, whichever is there: "a.b.0.c". JSON that can't be
parsed is null, and so is all that is asked of it; a JSON null is a value of kind VOID.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from rankloom.operators.rounds import kept


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(text: str | Column) -> Column:
    return F.try_parse_json(_name(text))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, or a scalar's type; VOID for a JSON null, null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def at(v: str | Column, path: str, type_: str = "variant") -> Column:
    """What lies at a path, as type_; null where there is none or it can't be cast."""
    parts = path.split(".")
    forms = product(*([f"[{p}]", f"['{p}']"] if p.isdigit() else [f"['{p}']"] for p in parts))
    found = [F.try_variant_get(_name(v), "$" + "".join(f), type_) for f in forms]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def only_list(v: Column) -> Column:
    """v if it is a list, else null."""
    return F.when(kind(v) == "ARRAY", v)


def only_strings(v: Column) -> Column:
    """A list of strings as an array; null for anything else, also for lists with other items."""
    items = F.try_variant_get(only_list(v), "$", "array<variant>")
    return F.when(F.forall(items, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), F.try_variant_get(v, "$", "array<string>"))


def _fields(v: Column) -> Column:
    return F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))


def only_keys(v: Column, keys: list[str]) -> Column:
    """An object with those of its keys that are listed; null for anything else."""
    return F.to_variant_object(F.map_filter(_fields(v), lambda k, _: k.isin(keys)))


def with_keys(v: Column, keys: list[str]) -> Column:
    """JSON text of an object with just these keys, in this order, null where it has none; null for anything else."""
    cell = lambda k: F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(at(v, k)), F.lit("null")))
    return F.when(kind(v) == "OBJECT", F.concat(F.lit("{"), F.concat_ws(",", *map(cell, keys)), F.lit("}")))


def wrapped(c: str | Column, type_: DataType) -> Column:
    """A column of a nested type with every scalar in a list of its own; lists of scalars stay, nulls too."""
    c = _name(c)
    if isinstance(type_, StructType):
        return F.when(c.isNotNull(), F.struct(*(wrapped(c[f.name], f.dataType).alias(f.name) for f in type_.fields)))
    if isinstance(type_, ArrayType):
        return F.transform(c, lambda x: wrapped(x, type_.elementType)) if isinstance(type_.elementType, (StructType, ArrayType)) else c
    return F.when(c.isNotNull(), F.array(c))


def leaves(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, kind, value) of everything in each document that isn't taken apart further: scalars, and lists of scalars
    alone. Fields are "a.b", places in other lists "a[0]", of a list at the top "__root__[0]". value is a scalar's text, a
    list's JSON. Empty objects have no row, documents that can't be parsed neither. A round a depth, each reading what is left;
    a document's fields and items become rows, so a large document is no group."""
    spark = docs.sparkSession
    rest = docs.select(F.col(id_col).alias("id"), F.lit("").alias("path"), parsed(json_col).alias("v")).filter("v is not null")
    done = None
    while True:
        rest = kept(rest.withColumn("kind", kind(F.col("v"))), "json")
        items = F.when(F.col("kind") == "ARRAY", F.try_variant_get("v", "$", "array<variant>"))
        inner = (F.col("kind") == "OBJECT") | F.coalesce(F.exists(items, lambda x: kind(x).isin("OBJECT", "ARRAY")), F.lit(False))
        value = F.when(F.col("kind") == "ARRAY", F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
        named = F.when((F.col("kind") == "ARRAY") & (F.col("path") == ""), "__root__").otherwise(F.col("path"))
        now = rest.filter(~inner).select("id", named.alias("path"), "kind", value.alias("value"))
        done = now if done is None else done.union(now)
        nested = rest.filter(inner)
        if nested.isEmpty():
            return done.withColumnRenamed("id", id_col)
        each = nested.withColumnRenamed("v", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        below = F.when(F.col("kind") == "ARRAY", F.concat(F.when(F.col("path") == "", "__root__").otherwise(F.col("path")), F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        below = below.otherwise(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), F.col("key")))
        rest = each.select("id", below.alias("path"), F.col("value").alias("v"))


def keys_to_columns(docs: DataFrame, id_col: str, json_col: str, keys: list[str]) -> DataFrame:
    """(id, one string column a key): an object's fields as columns, scalars as their text."""
    v = docs.select(id_col, parsed(json_col).alias("_v"))
    return v.select(id_col, *(at("_v", k, "string").alias(k) for k in keys))


def key_counts(docs: DataFrame, json_col: str) -> DataFrame:
    """(key, n, kinds): the keys at the top of all documents, from which columns may be chosen."""
    fields = docs.select(F.explode(_fields(parsed(json_col))).alias("key", "v"))
    return fields.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(kind(F.col("v")))).alias("kinds"))
