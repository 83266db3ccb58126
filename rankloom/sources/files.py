"""Reading and writing folders of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, folder: str, schema: str | None = None, recursive: bool = True, keep_broken: bool = False) -> DataFrame:
    """One document or list a file; a broken file is a row of nulls with _corrupt_record, left out unless asked for."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json")
    if schema:
        reader = reader.schema(T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType()))
    out = reader.json(folder)
    if "_corrupt_record" not in out.columns:
        return out
    return out if keep_broken else out.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def json_records(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A file {key: record, ...} as rows (key, record's fields)."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>"))).select("key", "value.*")


def with_ids(docs: DataFrame) -> DataFrame:
    """Documents read from files with an id of their own: file name, # and the place in the file's list, from 0."""
    named = docs.select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), F.monotonically_increasing_id().alias("_at"))
    nth = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1  # a file is read by one task, in its order
    return named.withColumn("_id", F.concat_ws("#", "_file", nth)).drop("_file", "_at")


def separated_robust(spark: SparkSession, path: str, columns: int = 2, separators: tuple[str, ...] = (",", ";", "\t")) -> DataFrame:
    """CSV without a schema: the first separator whose header has ``columns`` names or more; if quotes don't close in some line,
    quotes are letters. Lines with more or fewer fields than the header are left out."""
    head = spark.read.text(path).limit(1).first()
    line = head[0] if head else ""
    sep = next((x for x in separators if len(line.split(x)) >= columns), separators[0])
    names = [n.strip().strip('"') for n in line.split(sep)]
    odd = spark.read.text(path).filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "DROPMALFORMED")
    return (reader if odd else reader.option("quote", "")).csv(path)


def two_level(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with two header lines: columns upper__lower, an empty upper name goes on from its left. All strings."""
    head = [[x.strip() for x in r[0].split(sep)] for r in spark.read.text(path).limit(2).collect()]
    upper, lower = list(head[0]), head[1]
    for i in range(1, len(upper)):
        upper[i] = upper[i] or upper[i - 1]
    names = [f"{u}__{w}" if u and w else u or w for u, w in zip(upper, lower)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("sep", sep).csv(path)
    for line in head:
        same = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) == v for n, v in zip(names, line)])
        rows = rows.filter(~same)
    return rows


def tab_table(spark: SparkSession, path: str) -> DataFrame:
    """A reference table with tabs and a header; empty fields are null."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def key_values(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of JSON and of plain 'key: value' files as (file, key, value): scalars at the top of a document, as strings."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), "[\"']", "")).alias("value"))
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S")), pair)
    cells = F.when(F.col("file").endswith(".json"), F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(lines)
    return texts.select("file", F.explode(cells).alias("x")).select("file", "x.*")


def routed(docs: DataFrame, members: DataFrame, key: str, inside: str, outside: str) -> None:
    """Documents whose key is a member to one folder, the rest to another."""
    own = members.select(key).distinct()
    write_json(docs.join(own, key, "left_semi"), inside)
    write_json(docs.join(own, key, "left_anti"), outside)


def updated(docs: DataFrame, changes: DataFrame, key: str, path: str) -> None:
    """Documents with the fields that changes has for their key (null: as it was), written to a new folder, never in place."""
    fields = [c for c in changes.columns if c != key]
    both = docs.join(changes.toDF(*(c if c == key else f"_{c}" for c in changes.columns)), key, "left")
    write_json(both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in docs.columns), *(F.col(f"_{c}").alias(c) for c in fields if c not in docs.columns)), path)


def file_name(c: Column) -> Column:
    """A key as the name of a file: anything but letters, digits, dots and hyphens as _."""
    return F.regexp_replace(c, "[^A-Za-z0-9.-]+", "_")


def write_separated(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; lists joined by ' | '. Spark commits the whole job or nothing."""
    plain = [F.array_join(f.name, " | ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*plain).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def separated(spark: SparkSession, path: str, schema: str, separators: tuple[str, ...] = (",", ";", "\t")) -> DataFrame:
    """CSV with the first separator that gives the header two columns or more; broken lines are left out."""
    head = spark.read.text(path).limit(1).first()
    line = head[0] if head else ""
    sep = next((s for s in separators if s in line), separators[0])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, a folder for each key if ``by`` is given; nulls are kept. Spark commits the whole job or nothing."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    if by:
        writer = df.withColumn(by, file_name(F.col(by))).write.mode("overwrite").option("ignoreNullFields", False).partitionBy(by)
    writer.json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(kind: T.StructType, at: str = "") -> list[str]:
        return [x for f in kind.fields for x in (leaves(f.dataType, f"{at}{f.name}.") if isinstance(f.dataType, T.StructType) else [f"{at}{f.name}"])]

    return df.select(*(F.col(".".join(f"`{p}`" for p in x.split("."))).alias(x) for x in leaves(df.schema)))
