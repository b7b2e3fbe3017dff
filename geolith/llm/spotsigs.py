"""Operator 10: SpotSigs document fingerprints."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, shuffle_partitions, table

# Common words that serve as anchors.
COMMON_WORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her
she or an will my one all would there their what so up out if about who get which go me when is are was
der die das und in zu den von ist mit sich des auf für als auch es an nicht ein eine er hat dass sie nach
im dem aus bei wird werden sind war noch wie einem über einen so zum kann nur
le la les de des du et un une en est que qui dans pour pas sur au aux avec ce cette il elle se ne par plus
son sa ses ou sont nous vous je mais comme
el los las y del por con no una su para es al lo como más pero sus o este ha sí porque esta entre cuando
muy sin sobre también me hasta hay donde quien desde todo nos
"""
#: Words of an anchor's chain.
CHAIN_WORDS = 2
#: In a text without common words, its first word and one word in so many, by hash, stand in for them.
HASHED_ANCHORS = 8
#: Relative error allowed for products with a threshold, far above that of doubles.
ROUNDING = 1e-9

_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@functools.lru_cache(maxsize=1)
def _common() -> frozenset[bytes]:
    return frozenset(w.encode() for w in COMMON_WORDS.split())


def signatures(text: str | None) -> np.ndarray:
    """A text's set of signatures: sorted distinct 32-bit hashes.

    An anchor is a common word; its signature is the anchor with the next two
    words after it that are not common. Only a text without common words has
    other anchors: its first word and one word in eight, by hash. A text
    without words has one signature, the hash of itself.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").lower().encode().translate(_BREAKS).split()
    if not words:
        digest = hashlib.sha256((text or "").encode()).digest()
        return np.frombuffer(digest[:4], ">u4").astype(np.uint32)
    n = len(words)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    common = np.fromiter(map(_common().__contains__, words), bool, n)
    anchors = common
    if not common.any():
        anchors = hashes % np.uint64(HASHED_ANCHORS) == 0
        anchors[0] = True
    at = np.flatnonzero(anchors)
    content = np.append(hashes[~common], np.zeros(CHAIN_WORDS, np.uint64))
    after = np.searchsorted(np.flatnonzero(~common), at, side="right")
    mixed = hashes[at] * np.uint64(_MIX[0])
    for i in range(CHAIN_WORDS):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ content[after + i]) * np.uint64(_MIX[i + 1])
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def to_fingerprint(signature_set: np.ndarray) -> str:
    return base64.b64encode(signature_set.astype(">u4").tobytes()).decode()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard likeness of two signature sets; 0 without a look inside if their sizes rule ``floor`` out."""
    if min(len(a), len(b)) < floor * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    likeness = shared / (len(a) + len(b) - shared)
    return likeness if likeness >= floor else 0.0


def with_signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``signatures``, an array of int; null text counts as empty."""
    bounded_batches(df.sparkSession)
    df = df.drop("signatures")
    schema = T.StructType([*df.schema.fields, T.StructField("signatures", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(x).view(np.int32) for x in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "signatures"])

    return df.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, set, class_id) and pairs (set_a, set_b, a, b, likeness) between classes of equal signature sets.

    A class is named by ``set``, the digest of its signatures, so rows without
    id and rows that share one lose no link and no two unlike texts share a class;
    ``class_id``, ``a`` and ``b`` are its least doc_id, null if no row of it has one. Null
    text counts as empty, every row has one membership, an empty table gives
    none. Each pair of unequal sets stands once, the shorter set first.

    Sets are dealt into partitions by length, each so narrow that a set's partners
    stand in its own or the next one, and meet there through one of their first
    signatures in order of rising document frequency: two sets as alike as
    ``threshold`` share one of the first ``n - ceil(threshold * n) + 1``, so early in both
    that enough others can follow. Lengths and the pair's overlap decide.
    The signature sets are checkpointed, as several joins read them.
    """
    digest = F.md5(F.array_join(F.col("signatures").cast("array<string>"), ","))
    sets = with_signatures(df.select("doc_id", "text")).drop("text")
    named = checkpointed(sets.select("doc_id", "signatures", digest.alias("set")))
    # Numbers stand for the sets' names in what is shuffled for each signature; the checkpoint keeps them.
    classes = checkpointed(
        named.groupBy("set")
        .agg(F.min("doc_id").alias("class_id"), F.any_value("signatures").alias("signatures"))
        .withColumn("no", F.monotonically_increasing_id())
    )
    least = classes.select("set", "class_id")
    members = named.select("doc_id", "set").join(least, "set").select("doc_id", "set", "class_id")

    def at_least(x: Column) -> Column:
        """The least whole number not below ``x``, whose last digits may be off."""
        return F.ceil(x - ROUNDING * x).cast("int")

    size = F.size("signatures")
    each = classes.select("no", size.alias("n"), F.explode("signatures").alias("s"))
    # Signatures of one set alone stand first in its order and meet nobody: they are counted, not shuffled on.
    counted = each.join(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s")
    ordered = counted.groupBy("no", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
    alone = F.col("n") - F.size("o")
    prefix = F.transform(F.slice("o", F.lit(1), F.greatest(F.lit(0), F.col("n") - at_least(F.col("n") * threshold) + 1 - alone)), lambda x: x["s"])
    width = -math.log(threshold) * (1 + ROUNDING)
    length_class = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    index = ordered.select("no", "n", length_class.alias("p"), alone.alias("alone"), F.posexplode(prefix).alias("i", "s"))
    index = index.select("no", "n", "p", (F.col("alone") + F.col("i")).alias("at"), "s")
    asked = index.select(
        F.col("no").alias("no_b"), F.col("n").alias("m"), F.col("at").alias("at_b"), "s",
        F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p"),
    )
    needed = at_least((F.col("n") + F.col("m")) * (threshold / (1 + threshold)))
    candidates = (
        index.withColumnRenamed("no", "no_a")
        .join(asked, ["p", "s"])
        .where("n < m OR n = m AND no_a < no_b")
        .where((F.col("at") + needed <= F.col("n")) & (F.col("at_b") + needed <= F.col("m")))
        .select("no_a", "no_b")
        .distinct()
    )
    left, right = classes.toDF("set_a", "a", "x", "no_a"), classes.toDF("set_b", "b", "y", "no_b")
    shared = F.size(F.array_intersect("x", "y"))
    pairs = (
        candidates.join(left, "no_a")
        .join(right, "no_b")
        .select("set_a", "set_b", "a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
    return members, pairs


def _in_id_order(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt into ranges of falling doc_id, each with the first row of the next at its end.

    Gives doc_id, ``packed`` (the text in UTF-8 under Zstandard, which halves
    what the shuffle writes), ``range`` and ``tail``; partitions come sorted by range,
    tail, doc_id (falling, nulls last), text hash and packed text. Range borders
    are approximate quantiles, so ranges are even; rows without id stand in
    ranges of their text's hash. Each range's border and first row's key reach the
    driver, two numbers a range, and tasks look borders up by bisection. The
    last range ends with the very first row.
    """
    spark = df.sparkSession
    ranges = 2 * shuffle_partitions(spark)
    cuts, n, known = df.agg(
        F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges), F.count("*"), F.count("doc_id")
    ).first()
    borders = np.array(sorted(set(cuts or [])), np.int64)
    unnamed = max(1, round(ranges * (n - known) / max(1, n)))  # ranges of rows without id
    width = -(-(1 << 64) // unnamed)

    def places(ids: pa.Array, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each row's range, and its key there: what sorts rows of a range, least first."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        hashed = hashes.to_numpy(zero_copy_only=False)
        at = len(borders) - np.searchsorted(borders, own, side="left")
        later = len(borders) + 1 + np.array([(int(h) + (1 << 63)) // width for h in hashed[null]], np.int64)
        at[null] = later
        return at, np.where(null, hashed, ~own)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key = places(batch.column("doc_id"), batch.column("hash"))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(key)], names=["range", "key"])

    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    firsts = sorted(
        (r["range"], r["key"])
        for r in hashed.select("doc_id", "hash")
        .mapInArrow(first_keys, "range long, key long")
        .groupBy("range")
        .agg(F.min("key").alias("key"))
        .collect()
    )
    shared = spark.sparkContext.broadcast(
        {of: (key, firsts[i - 1][0]) for i, (of, key) in enumerate(firsts)}  # the first range's row ends the last one
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor, begin = zstandard.ZstdCompressor(level=3), shared.value
        for batch in batches:
            at, key = places(batch.column("doc_id"), batch.column("hash"))
            texts = [compressor.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            # A range's first row stands at the end of the range before too.
            again = [i for i, (r, k) in enumerate(zip(at.tolist(), key.tolist(), strict=True)) if begin[r][0] == k]
            rows = pa.array([*range(len(at)), *again], pa.int64())
            to = [*at.tolist(), *(begin[at[i]][1] for i in again)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("hash").take(rows), pa.array(texts, pa.binary()).take(rows),
                    pa.array(to, pa.int64()), pa.array([False] * len(at) + [True] * len(again)),
                ],
                names=["doc_id", "hash", "packed", "range", "tail"],
            )

    return (
        hashed.mapInArrow(dealt, "doc_id long, hash long, packed binary, range long, tail boolean")
        .repartition(shuffle_partitions(spark), "range")
        .sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), F.col("hash")), "packed")
        .drop("hash")
    )


def fingerprint_edits(df: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning.

    The next document is that of the next smaller doc_id (ties by packed text;
    null ids last, by a hash of their text), after the last the first. The edit replaces the last half of a text
    (rounded down, code points) by as many first ones of the next text, or all.
    Null text counts as empty; rows stay as they are, repeated ones included,
    an empty table gives none, and a single row is its own next. Rows of one id
    stand in one range. Texts are shuffled once, into ranges of ids that
    are read as streams; very long texts cost memory in proportion.

    The likeness of each given pair is the result, so its comparison has no
    floor to prune by; :func:`near_duplicates` searches all pairs by length class and floor.
    """
    bounded_batches(df.sparkSession)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # (doc_id, text, signatures) that waits for the next one
        for batch in batches:
            rows = []
            for doc_id, packed, _, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None and tail:
                    continue  # further copies of the row that ended the range
                text = unpack(packed).decode()
                mine = signatures(text)
                if last is not None:
                    before, old, old_set = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new_set = signatures(edited)
                    rows.append(
                        (
                            before,
                            len(old),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            to_fingerprint(old_set),
                            to_fingerprint(new_set),
                            pruned_jaccard(old_set, new_set),
                            pruned_jaccard(old_set, mine),
                        )
                    )
                last = None if tail else (doc_id, text, mine)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return _in_id_order(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, set, class_id, n_near): each document's class of equal signatures and how many other classes are near it."""
    members, pairs = near_duplicates(table(spark, sf_dir, "documents"))
    ends = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_near"))
    return members.join(ends, "set", "left").select("doc_id", "set", "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
