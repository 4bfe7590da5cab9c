"""Post files: JSON arrays, CSV with a header, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

COMMENT = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)
POST_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("comments", T.ArrayType(COMMENT)),
    ]
)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _json(spark: SparkSession, schema: T.StructType, mode: str):
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", mode)
    return reader.option("timestampNTZFormat", TIME_FORMAT)


def read_json(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = POST_SCHEMA
) -> DataFrame:
    """Posts of many files, each one JSON array; rows of all files follow each other.

    Such a file cannot be split, so a crawl should be many files. Missing fields are null. A file
    that does not parse ends the job; ``read_json_or_reject`` hands such files over instead.
    """
    return _json(spark, schema, "FAILFAST").json(paths)


def read_json_or_reject(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = POST_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """``(posts, rejects)``: what parses, and ``(file, text)`` of each file or record that does not."""
    marked = T.StructType([*schema, T.StructField("_rejected", T.StringType())])
    read = _json(spark, marked, "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(paths)
    # Parsed once into a table: what was rejected cannot be asked for on its own while parsing.
    read = written(read.withColumn("_file", F.col("_metadata.file_path")))
    rejects = read.filter("_rejected is not null").select(F.col("_file").alias("file"), F.col("_rejected").alias("text"))
    return read.filter("_rejected is null").drop("_rejected", "_file"), rejects


def read_json_by_lines(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = POST_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """``(posts, rejects)`` of arrays whose records end where lines end, however large a file is.

    Text files are cut by bytes and each part begins at its first whole line, so one file is read by
    many tasks. JSON spells line breaks in strings out, so a line holds whole records: one, as the crawler
    writes them, or several. The brackets and commas between records are left out. ``rejects`` has
    ``(file, text)`` of each line that is not made of records; the lines around it are kept.
    """
    lines = spark.read.text(paths).select(F.btrim("value", F.lit(" \t\r")).alias("line"), F.col("_metadata.file_path").alias("file"))
    # A bracket or comma at either end stands between records: a record itself has braces there.
    inner = F.regexp_replace(F.regexp_replace("line", r"^[\[,]\s*|\ufeff", ""), r"\s*\]$", "")
    inner = F.regexp_replace(inner, r"\s*,$", "")
    records = F.from_json(
        F.concat(F.lit("["), "inner", F.lit("]")), T.ArrayType(schema), {"timestampNTZFormat": TIME_FORMAT}
    )
    # Parsed once into a table: what was rejected cannot be asked for on its own while parsing.
    read = written(lines.withColumn("inner", inner).filter("inner <> ''").select("file", "line", "inner", records.alias("records")))
    whole = F.col("records").isNotNull() & F.col("inner").startswith("{") & F.col("inner").endswith("}")
    kept = read.filter(whole).select(F.inline("records"))
    return kept, read.filter(~F.coalesce(whole, F.lit(False))).select("file", F.col("line").alias("text"))


def write_json_arrays(posts: DataFrame, path: str, file_key: str) -> None:
    """Posts as text files of one JSON array per value of ``file_key``.

    A file is one value in one task, so the key must cut the posts into pieces of bounded size.
    """
    record = F.to_json(
        F.struct(*[c for c in posts.columns if c != file_key]), {"timestampNTZFormat": TIME_FORMAT}
    )
    arrays = posts.groupBy(file_key).agg(F.array_join(F.collect_list(record), ",\n").alias("rows"))
    one_per_file = arrays.select(F.concat(F.lit("["), "rows", F.lit("]")).alias("value"))
    one_per_file.write.option("maxRecordsPerFile", 1).text(path)


def write_epochs(batches: DataFrame, path: str) -> None:
    """Shuffled batches for a trainer: one folder per epoch, its files in batch order."""
    batches.repartitionByRange("epoch", "batch").sortWithinPartitions(
        "epoch", "batch", "rank"
    ).write.partitionBy("epoch").parquet(path)


def _one_line(value: Column) -> Column:
    """Text without line breaks: ``\\n``, ``\\r``, and ``\\b`` for a backslash."""
    for plain, shown in (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(plain), F.lit(shown))
    return value


def _as_it_was(value: Column) -> Column:
    for plain, shown in (("\n", "\\n"), ("\r", "\\r"), ("\\", "\\b")):
        value = F.replace(value, F.lit(shown), F.lit(plain))
    return value


def _on_text(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Line breaks in texts are spelt out, so a row is a line and files can be split."""
    _on_text(df, _one_line).write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "timestampNTZFormat", TIME_FORMAT
    ).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV as ``write_csv`` makes it. Select the wanted columns; the rest is not converted.

    A malformed row ends the job.
    """
    read = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )
    return _on_text(read, _as_it_was)
