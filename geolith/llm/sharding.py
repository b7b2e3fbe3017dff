"""Operator 12: contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, table

SHARDS = 16
#: Ranges for each shuffle partition, so that no task gets much more than its share of them.
RANGES = 4
#: Names of the documents' global order: first id that has the text, the text, the document's id, the row.
ORDER = ("first", "h", "g", "doc_id", "row")


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text; null and empty are one text."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("h"), F.xxhash64(F.lit(1), known).alias("g")]


def _positions(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, ORDER, size, crc, copies): a row for each document, dealt by ranges of the global order and stored.

    Texts are read once. Row numbers make the order total, and what is stored
    keeps them: a task that runs again reads the same rows.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    rows = checkpointed(
        df.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(known) + 1).cast("long").alias("size"), F.crc32(known).alias("crc"),
            *_keys(F.col(text)), F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    ranges = RANGES * shuffle_partitions(df.sparkSession)
    dealt = rows.join(groups, ["h", "g"]).repartitionByRange(ranges, *ORDER)
    return checkpointed(dealt.select(F.spark_partition_id().alias("part"), *ORDER, "size", "crc", "copies"))


def _numbered(positions: DataFrame) -> DataFrame:
    """``positions`` with ``start``, the bytes, and ``number``, the documents that stand before each.

    Totals of the ranges, a row for each, are summed up in order and sent to all
    tasks; running sums inside a range add to them.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = positions.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("documents"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("documents_before"),
    )
    inside = Window.partitionBy("part").orderBy(*ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = positions.select(
        "*", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("bytes_inside"), (F.row_number().over(inside) - 1).alias("nth")
    )
    return summed.join(F.broadcast(bases), "part").select(
        *positions.columns,
        (F.col("bytes_before") + F.col("bytes_inside")).alias("start"),
        (F.col("documents_before") + F.col("nth")).alias("number"),
    )


def _cuts(numbered: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """The number of documents before each shard but the first.

    A document, or a group of equal texts that takes no more bytes than the largest
    document, stands in the shard that its middle falls into. Only rows that an
    equal target falls into come to the driver, one for each cut at most.
    """
    targets = range(1, shards)
    reaches = F.array(*(F.lit(total * s).cast("long") for s in targets))
    hit = F.filter(
        F.transform(reaches, lambda t, i: F.struct((i + 1).alias("s"), t.alias("t"))),
        lambda x: (F.col("start") * shards <= x["t"]) & (x["t"] < (F.col("start") + F.col("size")) * shards),
    )
    rows = numbered.withColumn("hit", hit).where(F.size("hit") > 0).select("h", "g", "start", "number", "size", "copies", F.col("hit.s").alias("s")).collect()
    whole = {(r.h, r.g) for r in rows if 1 < r.copies and r.copies * r.size <= largest}
    begins = {}
    if whole:
        named = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(g).alias("g")) for h, g in sorted(whole)))
        held = numbered.where(F.array_contains(named, F.struct("h", "g"))).groupBy("h", "g")
        begins = {(r.h, r.g): (r.start, r.number) for r in held.agg(F.min("start").alias("start"), F.min("number").alias("number")).collect()}
    found = {}
    for r in rows:
        start, number = begins.get((r.h, r.g), (r.start, r.number))
        n = r.copies if (r.h, r.g) in begins else 1
        for s in r.s:
            found[s] = number if (2 * start + n * r.size) * shards >= 2 * total * s else number + n
    return [found[s] for s in targets]


def shard_plan(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, g, size, text_crc32, shard, slot) for every row of ``df``.

    A document's size is the UTF-8 bytes of its text and one. Documents stand in the order of their
    ids, but equal texts (null and empty are equal) stand together where the first of them stands. The
    shards are contiguous in this order: global prefix sums of the sizes, made
    from totals of ranges, are cut at equal targets. A group of equal texts
    that is no larger than the largest document is not cut, so no shard is further from
    its share than by the largest document's size; a larger group is split between neighbours.
    Slots number a shard's documents without gaps.

    Rows without id come first, in the order they are read, and repeated rows
    are documents of their own. An empty table gives no rows; with fewer
    documents than shards, shards are empty. Only ids, hashes and sizes are shuffled. No group
    stands in one task: minima and counts of equal texts are aggregated before
    they are joined back, and the order ends in a row number, so ranges split everywhere.
    """
    positions = _positions(df, doc_id, text)
    total, largest = positions.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    numbered = _numbered(positions)
    cuts = _cuts(numbered, shards, total, largest) if total else [0] * (shards - 1)
    begins = F.array(*(F.lit(n).cast("long") for n in (0, *cuts)))
    passed = F.size(F.filter(begins, lambda n: n <= F.col("number")))
    return numbered.withColumn("shard", (passed - 1).cast("int")).select(
        F.col("doc_id").alias(doc_id), "h", "g", "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("number") - F.get(begins, F.col("shard"))).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, folder: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``df`` as Parquet into ``folder``, a folder for each shard, in order of slots; returns the plan.

    Rows meet their places by id and text; rows that repeat both are numbered and take one place each.
    Columns named shard or slot are replaced.
    """
    plan = checkpointed(shard_plan(df, shards, doc_id, text))

    def named(rows: DataFrame, order: Column) -> DataFrame:
        keyed = rows.withColumn("__id", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
        nth = F.row_number().over(Window.partitionBy("__id", "__h", "__g").orderBy(order))
        return keyed.withColumn("__nth", nth)

    docs = df.drop("shard", "slot")
    keyed = docs.select("*", *(c.alias(f"__{n}") for c, n in zip(_keys(F.col(text)), "hg", strict=True)))
    places = named(plan.withColumnsRenamed({"h": "__h", "g": "__g"}), F.col("slot")).select("__id", "__h", "__g", "__nth", "shard", "slot")
    placed = named(keyed, F.lit(0)).join(places, ["__id", "__h", "__g", "__nth"]).drop("__id", "__h", "__g", "__nth")
    ranges = max(shards, shuffle_partitions(df.sparkSession))
    placed.repartitionByRange(ranges, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return plan


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return plan.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP12_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
    SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
lut AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
    SELECT text, min(doc_id) AS first, count(*) AS copies, octet_length(encode(text)) + 1 AS size
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text
),
sums AS (
    SELECT text, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc
    FROM texts, lut
),
total AS (SELECT sum(size * copies)::HUGEINT AS total, max(size) AS largest FROM texts),
placed AS (
    SELECT *, coalesce(sum(size * copies) OVER (ORDER BY first, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM texts
),
docs AS (
    SELECT d.doc_id, p.text, p.size, p.first, p.start, p.copies,
           row_number() OVER (PARTITION BY p.text ORDER BY d.doc_id) - 1 AS k
    FROM documents d JOIN placed p ON coalesce(d.text, '') = p.text
),
dealt AS (
    SELECT docs.*, CASE WHEN size * copies <= largest THEN ((2 * start + size * copies) * 16) // (2 * total)
                ELSE ((2 * (start + k * size) + size) * 16) // (2 * total) END AS shard
    FROM docs, total
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY first, text, k) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt JOIN sums USING (text)
"""
