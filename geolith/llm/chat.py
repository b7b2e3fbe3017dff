"""Operator 6: chat formatting from typed parts, in built-in functions only.

Every turn becomes a turn mark, its role, then its parts in order, then an
end mark. A text part is a text mark and the escaped text; an attachment is a
placeholder mark. Marks have the form ``<|name|>``; text gets a backslash
inside anything that looks like the start of one, and loses it when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, exclusive_sums, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
TRAINED_ROLE = "assistant"

PART_TYPE = "array<struct<type:string,text:string,uri:string,units:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _visit(part: Column, trained: Column) -> Column:
    """One part as a mark and its content; attachments have no content."""
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    tokens = F.coalesce(*(F.when(kind == k, F.coalesce(part["units"], F.lit(1)) * n) for k, n in UNIT_TOKENS.items()))
    return F.struct(
        F.when(tokens.isNull(), F.lit(TEXT)).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("mark"),
        F.when(tokens.isNull(), escape(F.coalesce(part["text"], F.lit("")))).otherwise("").alias("content"),
        (trained & tokens.isNull()).alias("train"),
        F.when(tokens.isNotNull(), kind).alias("attachment"),
        part["uri"].alias("uri"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    )


def _plain(mark: str, content: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(mark).alias("mark"),
        content.alias("content"),
        F.lit(False).alias("train"),
        none.alias("attachment"),
        none.alias("uri"),
        F.lit(0).cast("long").alias("tokens"),
    )


def format_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, parts).

    Returns conv_id, ``formatted``, ``loss_mask`` (one struct(start, end,
    train) per text part, in order, code points), ``attachments`` (in order:
    type, uri, start of the placeholder, tokens it expands to) and
    ``expanded_tokens``. ``parts`` is an array of struct(type, text, uri, units);
    types other than image, audio and document count as text.

    Texts of the role "assistant", so written, are trained. Null text is empty,
    null roles are empty and not trained, null parts are no parts. Rows stand by turn, null turns first, ties by role and parts;
    repeated rows are turns of their own. Rows without conv_id are one
    conversation. A formatted conversation is one value and so must fit in
    one row.
    """
    trained = F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    turns = df.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("parts", F.array().cast(PART_TYPE)).alias("parts"),
            trained.alias("trained"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        return F.concat(
            F.array(_plain(TURN, escape(t["role"]))),
            F.transform(t["parts"], lambda p: _visit(p, t["trained"])),
            F.array(_plain(END, F.lit("\n"))),
        )

    out = grouped.withColumn("segments", F.flatten(F.transform("turns", segments)))
    out = out.withColumn(
        "sizes", F.transform("segments", lambda s: (F.length(s["mark"]) + F.length(s["content"])).cast("long"))
    ).withColumn("starts", exclusive_sums(F.col("sizes")))
    placed = F.zip_with(
        "segments",
        "starts",
        lambda s, at: F.struct(
            s["mark"].alias("mark"),
            (at + F.length(s["mark"])).alias("start"),
            (at + F.length(s["mark"]) + F.length(s["content"])).alias("end"),
            s["train"].alias("train"),
            s["attachment"].alias("type"),
            s["uri"].alias("uri"),
            at.alias("at"),
            s["tokens"].alias("tokens"),
        ),
    )
    out = out.withColumn("placed", placed)
    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: F.concat(s["mark"], s["content"])), "").alias("formatted"),
        F.transform(
            F.filter("placed", lambda p: p["mark"] == TEXT),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["train"].alias("train")),
        ).alias("loss_mask"),
        F.transform(
            F.filter("placed", lambda p: p["type"].isNotNull()),
            lambda p: F.struct(
                p["type"].alias("type"), p["uri"].alias("uri"), p["at"].alias("start"), p["tokens"].alias("tokens")
            ),
        ).alias("attachments"),
        F.aggregate("placed", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role, text) and ``loss_text``, from ``formatted`` and ``loss_mask`` alone."""
    mark = r"<\|[a-z]+\|>"
    chunks = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.lit(1 << 30))
    out = formatted.withColumn("chunks", chunks)
    out = out.withColumn(
        "chunk_sizes", F.transform("chunks", lambda c: (F.length(c) + len(TURN)).cast("long"))
    ).withColumn("chunk_starts", exclusive_sums(F.col("chunk_sizes")))

    def placed(chunk: Column, at: Column, pieces: Column, marks: Column, sizes: Column, starts: Column) -> Column:
        texts = F.transform(
            marks,
            lambda m, i: F.when(
                m == TEXT,
                F.struct(
                    (at + len(TURN) + F.get(starts, i) + F.get(sizes, i)).alias("start"),
                    F.get(pieces, i + 1).alias("raw"),
                ),
            ),
        )
        return F.struct(F.get(pieces, F.lit(0)).alias("role"), F.array_compact(texts).alias("texts"))

    def parsed(chunk: Column, at: Column) -> Column:
        def with_sizes(x: Column) -> Column:
            sizes = F.transform(x["marks"], lambda m, i: (F.length(F.get(x["pieces"], i)) + F.length(m)).cast("long"))
            return bound(
                sizes,
                lambda z: bound(exclusive_sums(z), lambda starts: placed(chunk, at, x["pieces"], x["marks"], z, starts)),
            )

        cut = F.struct(
            F.split(chunk, mark, -1).alias("pieces"), F.regexp_extract_all(chunk, F.lit(mark), F.lit(0)).alias("marks")
        )
        return bound(cut, with_sizes)

    out = out.withColumn("parsed", F.zip_with("chunks", "chunk_starts", parsed))
    out = out.withColumn("all_texts", F.flatten(F.transform("parsed", lambda t: t["texts"])))
    under = F.zip_with(
        "all_texts",
        "loss_mask",
        lambda t, m: F.when(
            m["train"] & (m["start"] == t["start"]) & (m["end"] == t["start"] + F.length(t["raw"])), unescape(t["raw"])
        ),
    )
    return out.select(
        "conv_id",
        F.transform(
            "parsed",
            lambda t: F.struct(
                unescape(t["role"]).alias("role"),
                F.array_join(F.transform(t["texts"], lambda x: unescape(x["raw"])), "").alias("text"),
            ),
        ).alias("turns"),
        F.array_join(F.array_compact(under), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        probe.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    text_part = F.struct(
        F.lit("text").alias("type"),
        F.col("text").alias("text"),
        F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("long").alias("units"),
    )
    parts = rows.select("conv_id", "turn", "role", F.array(text_part).alias("parts"))
    return read_back(format_conversations(parts)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# Length of a formatted turn: three marks (8 + 8 + 7), a line feed, and role and text with one
# backslash for every "<", any backslashes, "|" in them.
OP6_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
              FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text)
           + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT
           AS formatted_chars
FROM rows GROUP BY conv_id
"""
