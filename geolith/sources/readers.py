"""Readers of the raw file formats, and the partitioned sink."""

from __future__ import annotations

import codecs
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.session import small

from .views import sector_of_chapter

BACI_SCHEMA = "t SHORT, i INT, j INT, k INT, v DOUBLE, q DOUBLE"
#: Position of the columns that are read from a daily event file, and their names.
GDELT_COLUMNS = {
    1: "sql_date", 6: "actor1", 7: "a1", 12: "actor1_type", 16: "actor2", 17: "a2", 22: "actor2_type",
    26: "event_code", 30: "goldstein", 33: "num_articles", 57: "url",
}
PREFERRED = {".csv": 0, ".xlsx": 1, ".zip": 2}


def read_baci(spark: SparkSession, path: str) -> DataFrame:
    """Raw trade rows of all yearly files under ``path``; the year also comes from the name of the file, or of its folder."""
    raw = spark.read.schema(BACI_SCHEMA).option("header", True).option("recursiveFileLookup", True).csv(path)
    year = F.regexp_extract("_metadata.file_path", r".*_Y(\d{4})_V", 1).try_cast("int")
    return raw.select("*", year.alias("file_year"))


def baci_flows(raw: DataFrame, countries: DataFrame) -> DataFrame:
    """Flows by country name: summed over products per sector first, then named.

    ``countries`` (country_code, country_name) is sent to all tasks if it is
    small; rows of unknown codes go.
    """
    sector = sector_of_chapter(F.floor(F.col("k") / 10000).cast("int"))
    sums = raw.groupBy(F.col("t").cast("int").alias("year"), "i", "j", sector.alias("sector")).agg(
        F.sum(F.col("v")).alias("trade_value"), F.sum("q").alias("quantity")
    )
    names = countries.select("country_code", "country_name")
    a = small(names.toDF("i", "exporter"))
    b = small(names.toDF("j", "importer"))
    return sums.join(a, "i").join(b, "j").where("i <> j").select(
        "exporter", "importer", "year", "sector", "trade_value", "quantity"
    )


def available_years(raw: DataFrame) -> list[int]:
    return [r[0] for r in raw.select("file_year").distinct().where("file_year IS NOT NULL").orderBy("file_year").collect()]


def read_gdelt(spark: SparkSession, path: str) -> DataFrame:
    """Coded events from headless tab-separated files: the columns needed, by position, as strings."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return raw.select(*(F.col(f"_c{i}").alias(name) for i, name in GDELT_COLUMNS.items()))


def day_countries(events: DataFrame) -> DataFrame:
    """(sql_date, country): every country code that a day's events name, on either side."""
    codes = F.explode(F.array("a1", "a2")).alias("country")
    return events.select("sql_date", codes).where("country IS NOT NULL AND trim(country) <> ''").distinct()


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by all columns from left to right, each as one JSON text; empty fields are kept."""
    first = df.orderBy(*df.columns).limit(rows)
    return first.select(F.to_json(F.struct(*first.columns), {"ignoreNullFields": "false"}).alias("row"))


def read_dyads(spark: SparkSession, path: str) -> DataFrame:
    """(dyad, year, s, d) from a file whose first seven columns are meant; from 1990 on, known static scores only."""
    raw = spark.read.option("header", True).csv(path)
    names = ["a", "b", "code_a", "code_b", "year", "s", "d"]
    first = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns[:7], names, strict=False)))
    return first.select(
        F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("dyad"),
        F.col("year").try_cast("int").alias("year"),
        F.round(F.col("s").try_cast("double"), 4).alias("s"),
        F.round(F.col("d").try_cast("double"), 4).alias("d"),
    ).where("year >= 1990 AND s IS NOT NULL")


def dyad_series(dyads: DataFrame) -> DataFrame:
    """One row per dyad with its years in order."""
    return dyads.groupBy("dyad").agg(F.array_sort(F.collect_list(F.struct("year", "s", "d"))).alias("series"))


def read_world_bank(spark: SparkSession, path: str, indicator: str) -> DataFrame:
    """(country, year, indicator) from landed service responses: known values of three-letter countries."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    rows = F.from_json(
        F.get_json_object("value", "$[1]"), "array<struct<countryiso3code:string,date:string,value:double>>"
    )
    return raw.select(F.explode(rows).alias("r")).select(
        F.col("r.countryiso3code").alias("country"),
        F.col("r.date").try_cast("int").alias("year"),
        F.col("r.value").alias(indicator),
    ).where(f"length(country) = 3 AND `{indicator}` IS NOT NULL")


def join_indicators(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["country", "year"], "full_outer")


def excel_year(serial: float) -> int:
    """Year of a spreadsheet's day number."""
    return (date(1899, 12, 30) + timedelta(days=int(serial))).year


def workbook_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of all sheets of a workbook as header to text; read as a stream, shared strings resolved."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, node in ET.iterparse(book.open("xl/sharedStrings.xml")):
                if node.tag.endswith("}si"):
                    strings.append("".join(t.text or "" for t in node.iter() if t.tag.endswith("}t")))
                    node.clear()
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        for sheet in sorted(sheets, key=lambda n: int(re.search(r"\d+", n).group())):
            yield from _sheet_rows(book, sheet, strings)


def _sheet_rows(book: zipfile.ZipFile, sheet: str, strings: list[str]) -> Iterator[dict[str, str]]:
    """Rows of one sheet; its first filled row is the header."""
    header: dict[str, str] = {}
    for _, node in ET.iterparse(book.open(sheet)):
        if not node.tag.endswith("}row"):
            continue
        row = {}
        for cell in node:
            column = re.match(r"[A-Z]+", cell.get("r", "A")).group()
            value = next((c.text for c in cell.iter() if c.tag.endswith(("}v", "}t"))), None)
            if value is not None:
                row[column] = strings[int(value)] if cell.get("t") == "s" else value
        node.clear()
        if not header:
            header = {k: v.strip().lower() for k, v in row.items()}
        elif row:
            yield {header[k]: v for k, v in row.items() if k in header}


def read_workbooks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All rows of all sheets of workbooks under ``path``; one workbook is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [[name, *(r.get(c) for c in columns)] for r in workbook_rows(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", *columns])

    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in ["path", *columns]))


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding (UTF-8, else Latin-1) and separator of a text file by its first bytes.

    A character that the head's end cuts in two does not count against UTF-8.
    """
    try:
        encoding, text = "utf-8", codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        encoding, text = "iso-8859-1", head.decode("iso-8859-1")
    first = text.splitlines()[0] if text else ""
    return encoding, max(",;\t|", key=lambda s: (first.count(s), -",;\t|".index(s)))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of unknown encoding and separator, which are guessed for each file from its head.

    Files of one encoding and separator are read together; columns that
    only some of them have are null in the others.
    """
    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 65536).alias("head"))
    kinds: dict[tuple[str, str], list[str]] = {}
    for row in heads.toLocalIterator():
        kinds.setdefault(sniff(bytes(row["head"])), []).append(row["path"])
    parts = [
        spark.read.option("header", True).option("encoding", encoding).option("sep", separator).csv(paths)
        for (encoding, separator), paths in sorted(kinds.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def choose_files(paths: list[str]) -> dict[str, str]:
    """One file per dataset name: csv before xlsx before zip, then the shortest path."""
    best: dict[str, tuple] = {}
    for path in paths:
        p = PurePosixPath(path)
        if p.suffix.lower() in PREFERRED:
            name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?i)[-_ ]?v?\d+([._]\d+)*$", "", p.stem).lower()).strip("_")
            rank = (PREFERRED[p.suffix.lower()], len(path), path)
            best[name] = min(best.get(name, rank), rank)
    return {name: rank[2] for name, rank in best.items()}


def codebook_lines(lines: DataFrame) -> DataFrame:
    """(dataset, column, code, label) from codebook text: a column heading, then "code = label" lines.

    ``lines`` has dataset, line_no and line; the last heading before a line is its column.
    """
    from pyspark.sql import Window

    heading = F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z0-9_]+)\s*:?\s*$", 1)
    order = Window.partitionBy("dataset").orderBy("line_no")
    named = lines.withColumn("column", F.last(F.when(heading != "", F.lower(heading)), ignorenulls=True).over(order))
    pattern = r"^\s*(-?\d+)\s*[=:.)-]\s*(.+?)\s*$"
    return named.select(
        "dataset",
        "column",
        F.regexp_extract("line", pattern, 1).alias("code"),
        F.regexp_extract("line", pattern, 2).alias("label"),
    ).where("code <> '' AND column IS NOT NULL")


def decode(df: DataFrame, codes: DataFrame, dataset: str, column: str) -> DataFrame:
    """``df`` with ``<column>_label``: the dataset's own code table, else any dataset's, else the code itself."""
    code = F.regexp_replace(F.col(column).cast("string"), r"\.0$", "")
    mine = codes.where((F.col("column") == column) & (F.col("dataset") == dataset)).groupBy("code").agg(F.min("label").alias("mine"))
    other = codes.where(F.col("column") == column).groupBy("code").agg(F.min("label").alias("other"))
    joined = df.withColumn("__code", code).join(mine.withColumnRenamed("code", "__code"), "__code", "left").join(
        other.withColumnRenamed("code", "__code"), "__code", "left"
    )
    return joined.withColumn(f"{column}_label", F.coalesce("mine", "other", "__code")).select(*df.columns, f"{column}_label")


def write_years(df: DataFrame, path: str, by: str = "year") -> None:
    """Parquet by year; years that are not in ``df`` stay as they are."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def manifest(df: DataFrame, by: str = "year") -> str:
    """What a written table holds, as JSON."""
    rows = df.groupBy(by).count().orderBy(by).collect()
    return json.dumps({"columns": df.columns, "rows": {str(r[by]): r["count"] for r in rows}}, sort_keys=True)
