"""Files in: discovery, dispatch, CSV and sheets as typed tables, content hashes, documents."""

from __future__ import annotations

import csv
import datetime as dt
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, sanitize_identifier
from ..plans.scratch import Scratch
from .shared import SharedFiles
from .workbook import Workbook

STRUCTURED = (".csv", ".xlsx", ".xlsm")
_SHEET_TYPES = {bool: "boolean", dt.date: "date", dt.datetime: "timestamp_ntz", str: "string"}


def is_structured(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in STRUCTURED


def structured(path: Column) -> Column:
    """is_structured as an expression."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*STRUCTURED)


def discover(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, length, structured[, content]): a file, or all files below a folder, by path.

    Hidden files and whatever lies in hidden folders are left out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/")
    below = F.regexp_replace("path", "^.*?" + re.escape(root), "")
    kept = rows.filter(~below.rlike(r"(^|/)\.[^/]"))
    return kept.select("path", "length", structured(F.col("path")).alias("structured"), *(["content"] if content else [])).orderBy("path")


def hashed(files: DataFrame) -> DataFrame:
    """files with the sha256 of their content."""
    return files.withColumn("sha256", F.sha2("content", 256))


def check_header(columns: list[str | None]) -> None:
    bad = [i for i, c in enumerate(columns) if not str(c or "").strip()]
    if bad:
        raise ValueError(f"header cells {bad} are empty")


def normalise_types(df: DataFrame) -> DataFrame:
    """Inferred types as a store keeps them: whole numbers as BIGINT, and Yes/No columns as BOOLEAN."""
    texts = [c for c, t in df.dtypes if t == "string"]
    flags = {}
    if texts:
        word = lambda c: F.lower(F.trim(F.col(f"`{c}`")))
        flags = df.agg(
            *[
                F.coalesce(
                    F.bool_and(F.col(f"`{c}`").isNull() | word(c).isin("yes", "no")) & (F.count(f"`{c}`") > 0), F.lit(False)
                ).alias(f"f{i}") for i, c in enumerate(texts)
            ]
        ).first().asDict()
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif t == "string" and flags.get(f"f{texts.index(c)}"):
            col = F.lower(F.trim(col)) == "yes"
        out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, header_row: int = 0) -> DataFrame:
    """A CSV file as a typed table; lines before the header row are left out."""
    reader = spark.read.option("inferSchema", True).option("mode", "FAILFAST")
    if header_row == 0:
        first = spark.read.text(path).limit(1).collect()
        df = reader.option("header", True).csv(path)
    else:
        lines = spark.read.text(path, wholetext=False).rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: x[1] >= header_row).map(lambda x: x[0])
        first = [(lines.first(),)]
        df = reader.option("header", True).csv(lines)
    check_header(next(csv.reader([first[0][0]])) if first else [])
    return normalise_types(df)


def workbook(spark: SparkSession, path: str) -> Workbook:
    return Workbook(SharedFiles(spark).read_bytes(path))


def sheets(spark: SparkSession, path: str) -> list[str]:
    """The visible sheets of a workbook that have cells."""
    book = workbook(spark, path)
    return [n for n in book.sheets if any(v is not None for row in book.rows(n) for v in row)]


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """One sheet of a workbook, the first with cells if none is named, as a typed table; rows without any value are left out."""
    import pandas as pd

    book = workbook(spark, path)
    rows = book.rows(sheet or sheets(spark, path)[0])[header_row:]
    check_header(rows[0])
    kept = [r for r in rows[1:] if any(v is not None for v in r)]
    columns = {}
    for i, name in enumerate(rows[0]):
        values = [r[i] for r in kept]
        kinds = {type(v) for v in values if v is not None}
        if kinds == {int}:
            columns[str(name)] = pd.array(values, "Int64")
        elif kinds <= {int, float} and kinds:
            columns[str(name)] = pd.array(values, "Float64")
        else:
            same = len(kinds) == 1
            columns[str(name)] = pd.Series([v if v is None or same else str(v) for v in values], dtype="object")
    types = {
        c: (
            "bigint" if str(v.dtype) == "Int64" else "double" if str(v.dtype) == "Float64" else _SHEET_TYPES.get(
                next((type(x) for x in v if x is not None), str), "string"
            )
        ) for c, v in columns.items()
    }
    plain = [[None if pd.isna(v) else v for v in row] for row in zip(*columns.values(), strict=True)]
    return normalise_types(
        spark.createDataFrame(
            [
                [
                    float(v) if t == "double" and v is not None else int(v) if t == "bigint" and v is not None else v for v, t in zip(
                        r, types.values(), strict=True
                    )
                ] for r in plain
            ],
            ", ".join(f"`{c}` {t}" for c, t in types.items()),
        )
    )


def source_tables(path: str, names: list[str] | None = None, table: str | None = None) -> dict[str, str | None]:
    """Table names a file makes, with the sheet of each of `names`; more than one sheet makes `stem__sheet`."""
    stem = sanitize_identifier(table or os.path.splitext(os.path.basename(path))[0])
    if path.lower().endswith(".csv"):
        return {stem: None}
    if names is None:
        raise ValueError("a workbook needs the names of its sheets")
    return {stem: names[0]} if len(names) == 1 else {f"{stem}__{sanitize_identifier(n)}": n for n in names}


def load_table(spark: SparkSession, source: str, target: str, sheet: str | None = None, header_row: int = 0) -> int:
    """A file into a Parquet table, in place of what was there; its number of rows."""
    df = read_csv(spark, source, header_row) if source.lower().endswith(".csv") else read_sheet(spark, source, sheet, header_row)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def stage(spark: SparkSession, source: str, scratch: Scratch, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """A file as a typed table beside the tables that are there, none of which is touched."""
    df = read_csv(spark, source, header_row) if source.lower().endswith(".csv") else read_sheet(spark, source, sheet, header_row)
    return scratch.save(df, "staged")


def unchanged(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files all of whose tables were loaded from the same content: (path)."""
    known = registry.groupBy("path").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    return files.join(known, "path").filter("lo = hi AND sha256 = lo").select("path")


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of web pages."""
    return pages.select("page_id", "url", html_text(F.col("html")).alias("text"))
