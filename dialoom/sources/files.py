"""Sources and sinks: formats by suffix, folders with lineage, small JSON trees, sheets, batches and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text
from dialoom.functions.blank import strip

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}
MAX_TREE_BYTES = 64 << 20


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A file or folder in the format of its suffix; with a schema nothing is inferred, with columns only those are read."""
    kind = FORMATS.get(Path(path).suffix.lower())
    if kind is None:
        raise ValueError(f"no reader for {path}; known: {', '.join(sorted(FORMATS))}")
    reader = spark.read.format(kind)
    reader = reader.schema(schema) if schema is not None else reader
    reader = reader.option("header", True) if kind == "csv" else reader
    df = reader.load(path)
    return df.select(*columns) if columns else df


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet", lineage: str | None = "source_file") -> DataFrame:
    """Every file of a folder that fits the pattern, columns aligned by name, with the file's name in front."""
    suffix = Path(pattern).suffix
    kind = FORMATS.get(suffix, "parquet")
    reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    reader = reader.option("mergeSchema", True) if kind in ("parquet", "orc") else reader.option("header", True)
    df = reader.load(folder)
    return df.select(F.col("_metadata.file_name").alias(lineage), "*") if lineage else df


def ids_from_name(name: Column) -> dict[str, Column]:
    """customer and sales ids of a file called ``customer-kind-Cn-Sn-sales-tenant``."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "-")
    return {"customer_id": F.try_element_at(parts, F.lit(1)), "sales_id": F.try_element_at(parts, F.lit(5))}


def with_row_order(df: DataFrame) -> DataFrame:
    """Number the rows of a Parquet scan in the order of files (by path) and of rows within them.

    Every ordered rule needs this number, made once, at ingest. It comes from the file's path and the row's place in it,
    so neither the packing of splits nor a task's retry changes it; the offsets are one row per file, joined by broadcast as far as
    their size at run time allows.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    sizes = placed.groupBy("__file").agg((F.max("__place") + 1).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("__file", before.alias("__before")), "__file").withColumn("row_order", F.col("__before") + F.col("__place")).drop("__file", "__place", "__before")


def read_tree(path: str) -> dict:
    """A small JSON tree on the driver; an unreadable one is empty."""
    file = Path(path)
    try:
        if file.stat().st_size > MAX_TREE_BYTES:
            raise ValueError(f"{path} is no small tree")
        tree = json.loads(file.read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError, UnicodeDecodeError):
        return {}
    return tree if isinstance(tree, dict) else {}


# Default share of keywords, and that of one category.
MIN_RATIO, CATEGORY_RATIO = 0.45, {"province_analysis": 0.5}


def load_patterns(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Keyword patterns from configuration, ordered by category and name; the last entry of a (category, text) wins.

    Entries without text, category or keywords are left out. Keywords not given are the text's pieces. For
    ``operators.compliance``: pattern_id, category, name, text, source, keywords, mandatory, min_matches, min_ratio,
    template, fuzzy_threshold.
    """
    given = "n int, name string, category string, text string, source string, keywords array<string>, mandatory array<string>, min_matches int, min_ratio double, template string, fuzzy_threshold double"
    number = lambda v, kind: kind(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
    words = lambda v: [w.strip() for w in v if w.strip()] if v is not None else None
    rows = [
        (n, e.get("name") or f"pattern_{n}", str(e.get("category") or ""), str(e.get("text") or ""), e.get("source") or "custom", words(e.get("keywords")), words(e.get("mandatory_keywords") or []),
         number(e.get("min_matches"), int), number(e.get("min_ratio"), float), e.get("template") or "", number(e.get("fuzzy_threshold"), float))
        for n, e in enumerate(entries, 1)
    ]
    df = spark.createDataFrame(rows, given).withColumns({"text": text.without_attachments(F.col("text")), "category": strip(F.col("category"))})
    df = df.withColumn("keywords", F.coalesce("keywords", F.array_sort(F.array_distinct(text.keywords(F.col("text")))))).filter("text <> '' and category <> '' and size(keywords) > 0")
    ratio = F.coalesce("min_ratio", *[F.when(F.col("category") == c, r) for c, r in CATEGORY_RATIO.items()], F.lit(MIN_RATIO))
    df = df.withColumns({"min_matches": F.coalesce("min_matches", F.greatest(F.lit(2), F.ceil(F.size("keywords") * 0.35).cast("int"))), "min_ratio": ratio, "fuzzy_threshold": F.coalesce("fuzzy_threshold", F.lit(0.88))})
    kept = df.withColumn("last", F.row_number().over(Window.partitionBy("category", "text").orderBy(F.desc("n")))).filter("last = 1")
    order = F.row_number().over(Window.orderBy("category", "name", "n"))  # a configuration, not data
    return kept.withColumn("pattern_id", order.cast("long")).drop("n", "last")


def read_sheets(spark: SparkSession, folder: str, names: Iterable[str], suffix: str = "") -> dict[str, DataFrame]:
    """The sheets that ``write_sheets`` wrote; a name that isn't there is an error of the reader."""
    return {name: read(spark, f"{folder}/{name.replace('/', '_')}{suffix}") if suffix else spark.read.parquet(f"{folder}/{name.replace('/', '_')}") for name in names}


def overlay(defaults: dict, path: str | None) -> dict:
    """Settings: the defaults with the values of a small JSON file over them; an unreadable or missing file changes nothing."""
    return {**defaults, **(read_tree(path) if path else {})}


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """The first candidate that the table has."""
    wanted = list(dict.fromkeys(candidates))
    found = next((c for c in wanted if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(wanted)}; there are {', '.join(df.columns)}")
    return found


def first_filled(df: DataFrame, columns: Iterable[str]) -> str | None:
    """The first of the columns that holds any value (to sort by), None if none does. One pass over them."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(there)]).first() if there else ()
    return next((c for i, c in enumerate(there) if counts[i]), None)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Result columns under their output names; names that the table lacks are passed over."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def project(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A fixed column order, with empty strings for what is missing."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A few rows from the driver as a table; no rows, or rows that are no dicts, are an error."""
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("rows must be a non-empty list of dicts")
    write(spark.createDataFrame(rows), path)


def write(df: DataFrame, path: str, mode: str = "overwrite", max_rows: int | None = None, partition_by: Iterable[str] = ()) -> None:
    """Write in the format of the suffix (Parquet without one), optionally in parts of at most ``max_rows``."""
    writer = df.write.mode(mode).format(FORMATS.get(Path(path).suffix.lower(), "parquet"))
    writer = writer.option("maxRecordsPerFile", max_rows) if max_rows else writer
    writer = writer.option("header", True) if path.endswith(".csv") else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str, **options: object) -> dict[str, str]:
    """One sub-folder for each sheet of a workbook; returns their paths."""
    paths = {name: f"{folder}/{name.replace('/', '_')}" for name in sheets}
    for name, df in sheets.items():
        write(df, paths[name], **options)
    return paths


def update_column(df: DataFrame, column: str, new: Column) -> tuple[DataFrame, Column]:
    """The table with a column replaced where the new value differs, and the condition under which it did."""
    changed = ~F.col(column).eqNullSafe(new)
    return df.withColumn(column, F.when(changed, new).otherwise(F.col(column))), changed


def markdown(title: str, tables: dict[str, DataFrame], most: int = 100) -> str:
    """A report of small aggregates: at most ``most`` rows of each are collected."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def output_path(source: str, suffix: str, folder: str | None = None) -> str:
    """Where a result goes: beside its source or in a folder, with a suffix in the name."""
    p = Path(source)
    return str((Path(folder) if folder else p.parent) / f"{p.stem}_{suffix}{p.suffix or '.parquet'}")
