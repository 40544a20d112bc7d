"""Sources and sinks: by file suffix, JSON lines, lines, zipped and annotated text, provenance."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, JSON lines, JSON, CSV, TSV or text by suffix; .gz after it is transparent."""
    stem = re.sub(r"\.gz$", "", path.rstrip("/").lower())
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if stem.endswith(".parquet"):
        return reader.parquet(path)
    if stem.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path, schema)
    if stem.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if stem.endswith((".csv", ".tsv")):
        return read_csv(spark, path, "\t" if stem.endswith(".tsv") else ",", schema)
    if stem.endswith((".txt", ".text")):
        return read_lines(spark, path)
    raise ValueError(f"no reader for {path}")


def read_csv(spark: SparkSession, path: str, separator: str = ",", schema=None) -> DataFrame:
    """CSV with a header; all strings unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A fixed superset of columns; missing ones and nulls become empty text."""
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema=None, front_matter: bool = True) -> DataFrame:
    """JSON lines; blank lines, front matter marks and lines that can't be read are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if front_matter:
        lines = lines.where(~F.trim("value").startswith("---"))
    good = lines.where(F.expr("try_parse_json(value) is not null"))
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    return good.select(F.from_json("value", schema).alias("row")).select("row.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_zipped(spark: SparkSession, path: str, suffix: str = ".xml", most: int = 16 << 20) -> DataFrame:
    """(archive, member, text) of the members of zip files whose names end so.

    Each archive's directory is read first; partitions then hold ranges of its
    members with at most `most` bytes of text (or one member). Stores that only
    Spark reads give one task per archive.
    """
    from .zips import opened, zip_members

    found = spark.read.format("binaryFile").load(path)
    archives = sorted(r["path"] for r in found.select("path").collect())  # names only
    try:
        if archives:
            opened(archives[0]).close()
        return zip_members(spark, archives, suffix, most)
    except (OSError, ValueError):  # Arrow doesn't know the store
        pass

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(suffix):
                            yield pd.DataFrame({"archive": [where], "member": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return found.select("path", "content").mapInPandas(members, "archive string, member string, text string")


def read_packed_text(spark: SparkSession, path: str) -> DataFrame:
    """(archive, text) of docx and epub files: their markup members without tags."""
    pages = read_zipped(spark, path, "").where(F.col("member").rlike(r"(document\.xml|\.x?html)$"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]*>", " "), r"\s+", " "))
    return pages.groupBy("archive").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", plain.alias("t")))), lambda p: p["t"]), " ").alias("text"))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of annotation TSV: sentence, text, token_id, begin, end, surface, layers.

    A line `#Text=` opens a sentence; token lines carry id, begin-end, surface and layers.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    from pyspark.sql import Window as W

    upto = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    opened = F.col("line").startswith("#Text=")
    rows = lines.withColumn("sentence", F.sum(opened.cast("int")).over(upto)).withColumn("text", F.last(F.when(opened, F.expr("substring(line, 7)")), ignorenulls=True).over(upto))
    parts = F.split("line", "\t")
    tokens = rows.where(F.col("line").rlike(r"^\d+-\d+\t")).withColumn("p", parts)
    span = F.split(F.col("p")[1], "-")
    return tokens.select("file", "sentence", "text", F.col("p")[0].alias("token_id"), span[0].cast("int").alias("begin"), span[1].cast("int").alias("end"), F.col("p")[2].alias("surface"), F.slice("p", 4, 100).alias("layers"))


def read_records(text: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of catalogue records in XML text, by one pattern with a group per field."""
    return text.select(*text.columns, *(F.regexp_extract_all(F.col(column), F.lit(p), F.lit(1)).alias(name) for name, p in fields.items()))


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """An Excel sheet as text columns; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as err:
        raise RuntimeError("reading Excel files needs openpyxl") from err
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str, keep_default_na=False))


def read_separated(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports that may open with a line `sep=;` naming their separator; all text, header from the first line after it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = [r["value"].lstrip("\ufeff").strip() for r in lines.limit(2).collect()]
    if not first:
        return spark.createDataFrame([], "value string")
    named = first[0].lower().startswith("sep=")
    separator = first[0][4:5] if named else ","
    header = first[1] if named and len(first) > 1 else first[0]
    names = next(csv.reader([header], delimiter=separator))
    clean = F.trim(F.ltrim(F.col("value"), F.lit("\ufeff")))
    rows = lines.where((clean != header) & ~F.lower(clean).startswith("sep="))
    parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": separator, "quote": '"', "escape": '"'})
    return rows.select(parsed.alias("row")).select("row.*")


def _sidecar(spark: SparkSession, path: str, record: dict) -> dict:
    """Provenance beside a table, written after its data."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.meta")
    return record


def _record(df: DataFrame, name: str, parents: Sequence[str], description: str, phase: str) -> dict:
    return {"name": name, "parents": list(parents), "description": description, "phase": phase, "columns": df.columns, "written": datetime.now(timezone.utc).isoformat(timespec="seconds")}


def write_jsonl(df: DataFrame, path: str, name: str, parents: Sequence[str] = (), description: str = "", phase: str = "explore") -> dict:
    """JSON lines (nulls kept, text as it is) with a sidecar that holds the number of records, too."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    spark = df.sparkSession
    return _sidecar(spark, path, _record(df, name, parents, description, phase) | {"records": spark.read.text(path).count()})


def import_labelled(spark: SparkSession, source: str, table: str, mirror: str, labelled: str = "labelled", name: str = "gold") -> DataFrame:
    """Labelled rows of a CSV sheet as a Parquet table and a JSON lines mirror, both with provenance.

    A row counts as labelled where that column says yes; a sheet without any
    raises ValueError and writes nothing.
    """
    from ..functions.text import tolerant_bool

    rows = read_csv(spark, source).where(F.coalesce(tolerant_bool(F.col(labelled)), F.lit(False)))
    if rows.isEmpty():
        raise ValueError(f"no labelled rows in {source}: set {labelled} for the rows to import")
    write_jsonl(rows, mirror, f"{name}_jsonl", [source], "mirror of the labelled rows")
    write_parquet(rows, table, name, [source, f"{name}_jsonl"], "labelled rows")
    return spark.read.parquet(table)


def load_assets(spark: SparkSession, path: str, schema: str) -> list[dict]:
    """Few-shot examples or other small assets from a JSON file, in the file's order; a list of objects of that schema."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return [r.asDict(recursive=True) for r in rows.collect()]  # an asset file is a parameter


def write_parquet(df: DataFrame, path: str, name: str, parents: Sequence[str] = (), description: str = "", phase: str = "frozen") -> dict:
    """Parquet with provenance in the columns' metadata, and a sidecar written after the data."""
    record = _record(df, name, parents, description, phase)
    df.select(*(F.col(f"`{c}`").alias(c, metadata={"lexiforge": {"name": name, "parents": list(parents), "phase": phase}}) for c in df.columns)).write.mode("overwrite").parquet(path)
    return _sidecar(df.sparkSession, path, record)


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    """A Parquet table and its provenance; None where no column has any."""
    df = spark.read.parquet(path)
    found = [f.metadata["lexiforge"] for f in df.schema.fields if "lexiforge" in f.metadata]
    return df, found[0] if found else None
