"""Readers and writers with the options that reproduce the stages' files."""

from __future__ import annotations

import csv
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Embedded line breaks and doubled quotes are read as CSV writers of other tools write them.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
PRIORITY = ("eid", "title", "abstract", "cover_date", "doi", "citedby_count")
IGNORED = ("subject_areas", "num_subdisciplinas", "idioma")
RECORD = "_record"


def read_csv(spark: SparkSession, path: str | list[str], skip_bad: bool = True) -> DataFrame:
    """All columns as text; rows that do not fit the header are skipped."""
    return spark.read.options(**CSV, mode="DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.options(**CSV).mode(mode).csv(path)


def append_rows(path: str, columns: list[str], rows: list[dict]) -> None:
    """Appends a few rows to one CSV file on the driver; a new or empty file gets a header."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns)
        if not f.tell():
            out.writeheader()
        out.writerows(rows)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_records(spark: SparkSession, path: str, glob: str = "metadata_*.json") -> DataFrame:
    """``eid, record``: one raw JSON document per file, the id from its name."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("value").alias("record"), F.input_file_name().alias("_f"))
    return raw.select(F.regexp_extract("_f", r"metadata_([^/]+)\.json$", 1).alias("eid"), "record")


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    out = df.write.mode(mode)
    (out.partitionBy(partition) if partition else out).parquet(path)


def header(columns: list[list[str]], extra: tuple[str, ...] = (), priority: tuple[str, ...] = PRIORITY, ignored: tuple[str, ...] = IGNORED) -> list[str]:
    """The union of several headers: priority columns first, the others sorted, ``extra`` last, ignored ones out."""
    seen = {c for cs in columns for c in cs} - set(ignored) - set(extra)
    return [c for c in priority if c in seen] + sorted(seen - set(priority)) + list(extra)


def union(frames: list[DataFrame], extra: tuple[str, ...] = ()) -> DataFrame:
    """Frames with different columns under one header; absent columns are empty texts."""
    names = header([f.columns for f in frames], extra)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in both.columns else F.lit("").alias(c) for c in names])


def by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of a path or pattern, by their headers; files without one are left out.

    One short read per file, of its first line; files are listed by Spark, wherever they are.
    """
    listed = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for r in listed:
        columns = tuple(spark.read.options(**CSV).csv(r.path).columns)
        if columns:
            out.setdefault(columns, []).append(r.path)
    return out


def read_union(spark: SparkSession, path: str | list[str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with different headers, by name under one header, and the ``file, record`` of rows that do not fit.

    Files of one header are read together by their own columns, so their order may differ from file to file.  A row with
    too few fields lacks its last ones (empty texts); one with too many is kept as it stands instead of dropped.
    """
    frames, misfits = [], []
    for columns, paths in by_header(spark, path).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, RECORD)])
        # Without pruning: a row is judged by all its fields, whatever is read of it.
        raw = spark.read.options(**CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, columnPruning=False).schema(schema).csv(paths)
        fields = F.size(F.split(F.regexp_replace(RECORD, r'"(?:[^"]|"")*"', ""), ","))
        parsed = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in columns])) >= 0  # always: Spark refuses to read the record alone
        raw = raw.withColumn("_many", F.coalesce(parsed & (fields > len(columns)), F.lit(False))).withColumn("_file", F.col("_metadata.file_path"))
        frames.append(raw.where(~F.col("_many")).select(*[F.col(f"`{c}`") for c in columns]))
        misfits.append(raw.where("_many").select(F.col("_file").alias("file"), F.col(RECORD).alias("record")))
    if not frames:
        raise FileNotFoundError(f"no file with a header at {path}")
    return union(frames, extra), reduce(DataFrame.unionByName, misfits)
