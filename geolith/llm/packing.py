"""Operator 7: best-fit decreasing packing of documents into token sequences.

Only the counts of piece lengths reach the driver (at most one number per
length). There best fit decreasing runs over classes of equal bins, with a
segment tree over remaining capacities; the pieces are then placed on the
executors by their rank among pieces of the same length.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PIECE_PATTERN, byte_bpe
from .common import bounded_batches, checkpointed, shuffle_partitions, table

SEQUENCE_TOKENS = 2048
END_ID = 0
#: White space of so many characters in a row is left to the exact encoder; ``tiktoken`` takes quadratic time in it.
LONG_RUN = 256
_LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class Capacities:
    """Segment tree over remaining capacities 0..top: which of them some open bin has."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        node = capacity + self.leaves
        self.any[node] = present
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """Least capacity present that is no smaller than ``size``."""
        node = size + self.leaves
        if self.any[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where best fit decreasing puts pieces, given how many there are of each length.

    Rows (length, rank, bins, first_bin, per_bin, offset): pieces of
    ``length`` with ranks from ``rank`` on fill ``bins`` bins from
    ``first_bin`` on, ``per_bin`` in each, side by side from ``offset``. A bin
    that takes a piece of some length stays the tightest one while it has
    room for another, so equal bins are filled as one class; a class is split
    where the pieces run out. The rows are bounded by a few per length.
    """
    tree = Capacities(capacity)
    classes: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first bin, bins)
    rows, opened = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if bins:
            if not classes.get(room):
                classes[room] = []
                tree.set(room, True)
            classes[room].append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, opened
                bins = -(-left // (room // length))
                opened += bins
            else:
                first, bins = classes[room].pop()
                if not classes[room]:
                    tree.set(room, False)
            each = room // length
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, full, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                if left:  # fewer than one bin takes: the last bin of this class that is touched
                    rows.append((length, rank, 1, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    left, full = 0, full + 1
                put(room, first + full, bins - full)
    return pd.DataFrame(rows, columns=["length", "rank", "bins", "first_bin", "per_bin", "offset"], dtype="int64")


class Encoder:
    """Ids of a byte-level vocabulary file, by ``tiktoken`` where that is proven equal, else by :class:`ByteBpe`.

    ``tiktoken`` merges by ids alone. Where ids stand in merge order and every
    token is what its own bytes are encoded as, any two neighbours that form a
    token are that token's own merge, so both give the same ids; the vocabulary
    is tested for that at load. Its time grows with the square of a run of
    white space, so texts with a run of ``LONG_RUN`` go to ``ByteBpe``.
    """

    def __init__(self, path: str):
        import tiktoken

        self.exact = byte_bpe(path)
        self.quick = None
        if self.exact.ids_are_ranks:
            special = self.exact.special
            ranks = {b: i for i, b in self.exact.token_bytes.items() if i not in special.values()}
            self.quick = tiktoken.Encoding("packing", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or _LONG_SPACE.search(text):
            return self.exact.encode(text)
        return self.quick.encode_to_numpy(text, allowed_special="all")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(df: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with id 0 at the end.

    The ids are those of :func:`~geolith.llm.bpe.encode`, whatever a text holds. ``path`` names a vocabulary file that every executor can read.
    Documents longer than ``capacity`` are cut so that all pieces but the first
    have that length. Null text counts as empty, which leaves one piece of one
    token. The pieces are checkpointed, as dealing them by range reads them twice.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(path)
        for batch in batches:
            owner, pieces = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = model.encode(text or "").astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                n, begin = len(data) // 4, 0
                count = -(-n // capacity)
                for piece in range(count):
                    end = n - capacity * (count - 1 - piece)
                    owner.append(row)
                    pieces.append((piece, begin, end - begin, zlib.crc32(data[4 * begin : 4 * end])))
                    begin = end
            columns = np.array(pieces, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(columns[0].astype(np.int32)),
                    *map(pa.array, columns[1:]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return checkpointed(
        df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            run, "doc_id long, piece int, start long, length long, ids_crc32 long"
        )
    )


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the place of each in sequences of ``capacity`` tokens.

    ``pieces`` has doc_id, piece and length (1 to ``capacity``). They are
    ordered by length over all partitions, ties by document and piece, so a
    very common length is spread as well; a piece's rank among its length is its
    place in its partition plus what earlier partitions hold. The driver sees
    one count per length and partition. Repeated rows are packed as rows of
    their own; an empty table gives none. Columns of the added names are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    ordered = checkpointed(
        pieces.repartitionByRange(shuffle_partitions(spark), F.desc("length"), "doc_id", "piece")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", 33).alias("part")
    held = (
        ordered.groupBy(part, "length").agg(F.count("*").alias("n"), F.min("__at").alias("first")).toPandas()
    ).sort_values(["length", "part"])
    held["rank"] = held.groupby("length")["n"].cumsum() - held["n"]
    plan = best_fit_decreasing({int(k): int(v) for k, v in held.groupby("length")["n"].sum().items()}, capacity)
    shared = spark.sparkContext.broadcast((held[["part", "length", "first", "rank"]], plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, plan = shared.value
        key = plan["length"].to_numpy() * (1 << 44) + plan["rank"].to_numpy()  # by length, then rank
        order = np.argsort(key, kind="stable")
        key, columns = key[order], {c: plan[c].to_numpy()[order] for c in plan}
        starts = {(p, n): (f, r) for p, n, f, r in held.itertuples(index=False)}
        for batch in batches:
            length, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__at"))
            rank = np.empty(len(at), np.int64)
            which = (at >> 33) << 20 | length
            for w in np.unique(which):
                first, base = starts[int(w >> 20), int(w & 0xFFFFF)]
                mine = which == w
                rank[mine] = at[mine] - first + base
            row = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            inside = rank - columns["rank"][row]
            each = columns["per_bin"][row]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "__at"),
                    pa.array(columns["first_bin"][row] + inside // each),
                    pa.array(columns["offset"][row] + inside % each * length),
                ],
                names=[*(c for c in batch.schema.names if c != "__at"), "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ordered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
