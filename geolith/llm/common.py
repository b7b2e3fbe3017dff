"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.session import ARROW_ROWS, bounded_batches  # noqa: F401

#: ASCII white space as the operators' contracts define it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only a local master without
    that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keep_one_row(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component.

    ``rows`` has (doc_id, text_hash, fp) of every row and ``roots`` (fp, root)
    of linked fingerprints. The row of least doc_id, then of least text hash,
    stays; null ids come last. Rows are told apart by id and text, so null or
    repeated ids lose no text.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "rows")
    kept = checkpointed(
        rows.groupBy("fp", "doc_id", "text_hash")
        .agg(F.count("*").alias("rows"))
        .join(roots, "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min(order).alias("first"))
        .select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"), "first.rows")
    )
    out = docs.withColumn("__text_hash", F.xxhash64("text")).join(
        kept.select("__id", "__hash"),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")),
        "left_semi",
    )
    if kept.where("rows > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "__text_hash"])
    return out.drop("__text_hash")


#: Holds the columns that a stage does not read, so that names it adds cannot clash with them.
ASIDE = "__aside"


def set_aside(df: DataFrame, *needed: str) -> DataFrame:
    """``needed`` and, in one struct, all other columns of ``df``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*rest).alias(ASIDE)) if rest else df.select(*needed)


def restored(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns of the frame before :func:`set_aside`, in their order."""
    return df.select(*(F.col(c) if c in needed else F.col(f"{ASIDE}.`{c}`").alias(c) for c in columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements whose running sums are gathered in one array before arrays are joined.
SUM_BLOCK = 256


def exclusive_sums(values: Column) -> Column:
    """Running sums before each element of an array of longs, in built-in functions.

    Sums grow within blocks of fixed size, and so do the sums of the blocks
    before each; the time is in proportion to the elements.
    """
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("before"))

    def add(acc: Column, v: Column) -> Column:
        return F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before"))

    def blocks(xs: Column) -> Column:
        n = F.size(xs)
        return F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / SUM_BLOCK).cast("int")),
            lambda b: F.aggregate(
                F.sequence(b * SUM_BLOCK, F.least((b + 1) * SUM_BLOCK, n) - 1), start, lambda acc, i: add(acc, F.get(xs, i))
            ),
        )

    def joined(parts: Column) -> Column:
        bases = F.aggregate(parts, start, lambda acc, p: add(acc, p["sum"]))["before"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["before"], lambda s: base + s)))

    return F.when(F.size(values) > 0, bound(values, lambda xs: bound(blocks(xs), joined))).otherwise(
        F.array().cast("array<long>")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )
