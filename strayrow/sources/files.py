"""Parquet and delimited text, in and out."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each file suffix means, and the delimiters that are tried.
FORMATS = {".csv": "csv", ".xlsx": "xlsx", ".xls": "xls", ".txt": "txt", ".parquet": "parquet"}
DELIMITERS = (",", ";", "|", "\t")
_HEAD_LINES = 20


def format_by_suffix(name: str) -> str | None:
    return FORMATS.get(os.path.splitext(name.lower())[1])


def format_of(name: Column) -> Column:
    """The same rule for a column of file names."""
    # As for paths: a leading dot belongs to the name, and so does a dot in a folder.
    suffix = F.regexp_extract(F.lower(name), r"[^/](\.[^./]*)/*$", 1)
    kind = F.lit(None).cast("string")
    for ending, label in FORMATS.items():
        kind = F.when(suffix == ending, F.lit(label)).otherwise(kind)
    return kind


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file, a folder or a glob."""
    return spark.read.parquet(path)


def _fields_of(line: str, delimiter: str) -> list[str]:
    parts, quoted, current = [], False, ""
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == delimiter and not quoted:
            parts.append(current)
            current = ""
            continue
        current += ch
    return [*parts, current]


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


@dataclass
class Dialect:
    delimiter: str
    header: bool


def detect_dialect(spark: SparkSession, path: str) -> Dialect:
    """Guess delimiter and header from the first lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(_HEAD_LINES).collect()]
    lines = [line for line in lines if line.strip()]
    if not lines:
        return Dialect(",", False)

    def agreement(delimiter: str) -> tuple[int, int]:
        widths = [len(_fields_of(line, delimiter)) for line in lines]
        usual = max(set(widths), key=lambda w: (widths.count(w), w))
        return (widths.count(usual) if usual > 1 else 0, usual)

    delimiter = max(DELIMITERS, key=agreement)
    cells = [[c.strip().strip('"') for c in _fields_of(line, delimiter)] for line in lines]
    names, body = cells[0], [row for row in cells[1:] if len(row) == len(cells[0])]
    typed = any(
        _is_number(row[i]) and not _is_number(names[i]) for row in body for i in range(len(names))
    )
    textual = all(names) and not any(map(_is_number, names)) and len(set(names)) == len(names)
    return Dialect(delimiter, typed or (textual and bool(body)))


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    delimiter: str | None = None,
    header: bool | None = None,
) -> DataFrame:
    """Delimited text; what is not given is detected, and rows that do not fit are dropped.

    Giving a ``schema`` saves the pass over all rows that type inference needs. To count rows,
    convert to Parquet first: pruned columns are not parsed, so bad rows are not seen.
    """
    if delimiter is None or header is None:
        guess = detect_dialect(spark, path)
        delimiter = guess.delimiter if delimiter is None else delimiter
        header = guess.header if header is None else header
    reader = spark.read.options(sep=delimiter, header=header, mode="DROPMALFORMED", escape='"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_txt(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_csv(spark, path, **options)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by what its suffix says."""
    kind = format_by_suffix(path)
    if kind == "parquet":
        return scan_parquet(spark, path)
    if kind in ("csv", "txt"):
        return scan_csv(spark, path, **options)
    raise ValueError(f"unsupported file format: {path}")


def scan_batch(
    spark: SparkSession, path: str, kind: str | None = None, unit: str = "file", name: str = "source_file", **options
) -> DataFrame:
    """All files of a folder or glob as one table, with the path each row came from.

    ``unit`` is ``file``, or ``folder`` where the files of a folder are the parts of one table.
    ``kind`` is parquet, csv or txt; the suffix tells if it is not given. Files have one schema.
    """
    kind = kind or format_by_suffix(path)
    if kind not in ("parquet", "csv", "txt"):
        raise ValueError(f"unsupported file format: {path}")
    if unit not in ("file", "folder"):
        raise ValueError(f"no unit of files of this name: {unit}")
    rows = scan_parquet(spark, path) if kind == "parquet" else scan_csv(spark, path, **options)
    source = F.col("_metadata.file_path")
    if unit == "folder":
        source = F.regexp_replace(source, "/[^/]*$", "")
    return rows.withColumn(name, source)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


@dataclass
class Converted:
    path: str
    row_count: int
    column_count: int


def convert_to_parquet(spark: SparkSession, source: str, target: str, **options) -> Converted:
    """Copy a source to Parquet; rows are counted from the footers of what was written."""
    write_parquet(load(spark, source, **options), target)
    written = spark.read.parquet(target)
    return Converted(target, written.count(), len(written.columns))

