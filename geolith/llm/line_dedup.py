"""Operator 8: lines that many documents share, dropped but in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, bound, checkpointed, restored, set_aside, table

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(
    df: DataFrame, text: str = "text", min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``df`` with ``text`` cut to the kept lines, and ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` characters that stand in at
    least ``min_documents`` documents lose all their lines but those of the
    largest doc_id that holds them. Keys travel as two 64-bit hashes.

    Null and empty text is one empty line; null stays null. Repeated rows of
    one doc_id count as one document and lose the same lines; rows without
    doc_id count nowhere and keep all. Distinct documents of a key are counted
    after dealing by key and document. The shared keys are checkpointed, so that
    both sides of the join back are plain exchanges, and adaptive execution
    splits a very common line; nothing gathers the documents of a line. Texts are
    shuffled once, by document, and cut in time linear in their lines. Columns of
    the added names are replaced, columns of any other name stay.
    """
    added = ("n_lines", "n_dropped")
    keep = [c for c in df.columns if c not in added]
    row = set_aside(df.select(*(F.col(f"`{c}`") for c in keep)), "doc_id", text)
    row = row.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__th", F.xxhash64("__text"))
    lines = row.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "__th", F.posexplode(_lines(F.col("__text"))).alias("pos", "line")
    )
    keys = (
        lines.select("doc_id", "__th", "pos", ascii_lower(F.btrim("line", F.lit(ASCII_SPACE))).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            "doc_id", "__th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
        )
    )
    shared = checkpointed(
        keys.select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("documents"), F.max("doc_id").alias("owner"))
        .where(F.col("documents") >= min_documents)
    )
    dropped = (
        keys.join(shared, ["h1", "h2"])
        .where("doc_id < owner")
        .groupBy("doc_id", "__th")
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    joined = row.join(dropped, ["doc_id", "__th"], "left").withColumn("__lines", _lines(F.col("__text")))

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    out = joined.select(
        *(c for c in joined.columns if c != text),
        F.when(F.size("__dropped") > 0, bound(F.col("__lines"), kept)).otherwise(F.col(text)).alias(text),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
    )
    return restored(out, [*keep, *added], "doc_id", text, *added)


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_chars`` counted anew."""
    read = ("doc_id", "text", "n_chars")
    cut = dedup_lines(set_aside(docs, *read)).withColumn("n_chars", F.length("text").cast("long"))
    return restored(cut, docs.columns, *read)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM docs),
lines AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
),
keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
shared AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
    SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND k.doc_id < s.owner AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
