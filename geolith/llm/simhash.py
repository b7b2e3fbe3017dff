"""Operator 5: near duplicates by SimHash with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, ASCII_UPPER, bounded_batches, checkpointed, keep_one_row, table
from .components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42
#: Two segments of 32 bits: of 3 differing bits at most one falls into one of them.
SEGMENT_BITS = 32

_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed long; null text counts as empty."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([df.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints in column ``fp`` that differ in 3 bits or fewer.

    Each fingerprint stands in two tables, one for each 32-bit segment. A
    pair within 3 bits differs by at most one bit in some segment, so each
    fingerprint asks both tables for its own segment and for those that have
    one more bit set; the pair's other direction needs no asking. Matches
    are verified on all 64 bits. ``distinct`` holds each fingerprint once, so
    copies meet no one here. The join deals by segment value, and adaptive
    execution splits a value that very many fingerprints share.
    """

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), i)

    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    keys = F.array(F.shiftrightunsigned("fp", SEGMENT_BITS), low.bitwiseOR(F.lit(1 << SEGMENT_BITS)))
    entries = distinct.select("fp", F.explode(keys).alias("key"))

    places = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    unset = F.filter(places, lambda i: F.col("key").bitwiseAND(bit(i)) == 0)
    ball = F.concat(F.array("key"), F.transform(unset, lambda i: F.col("key").bitwiseOR(bit(i))))
    probes = entries.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(ball).alias("key"))
    return (
        probes.join(entries.withColumnRenamed("fp", "b"), "key")
        .where((F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
        .select("a", "b")
    )


def fingerprint_roots(distinct: DataFrame) -> DataFrame:
    """(fp, root): the component of every fingerprint of ``distinct`` that has a link."""
    return connected_components(near_links(distinct), "a", "b").toDF("fp", "root")


def simhash_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``.

    ``component_id`` is the least doc_id that can be reached over links of 3
    differing bits or fewer, the row's own included. Texts without words,
    null ones too, have fingerprint 0 and link like any other. Rows stay as
    they are, repeated ones included; null ids are never a component's name
    unless it has no other. Only distinct fingerprints take part in the
    search, so groups of copies of any size cost one row there.
    """
    docs = checkpointed(fingerprints(df, text))
    distinct = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = distinct.join(fingerprint_roots(distinct), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of linked fingerprints, told apart by id and text as in :func:`keep_one_row`."""
    rows = checkpointed(
        fingerprints(docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")).select(
            "doc_id.doc_id", "doc_id.text_hash", "fp"
        )
    )
    return keep_one_row(docs, rows, fingerprint_roots(rows.select("fp").distinct()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
