"""Operator 13: ranked lexical search over bit-sliced Bloom signatures.

An index holds blocks of documents. A block is a Bloom filter for each
document, stored by slice: one bitmap of all its documents for each place of the
filters. The AND of a term's slices marks the documents that may hold it.
Terms are entered once for each frequency level they reach, so the
slices also bound how often a term occurs, and with that its part of the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.session import small

from .common import bounded_batches, checkpointed, shared_folder, table, written

TOP_K = 20
#: Slices that a key is entered in, and slices for each key of a block's fullest document.
HASHES, SLICES_PER_KEY = 4, 16
#: Documents of a block, and cells (documents times slices) that a block is closed at.
BLOCK_DOCUMENTS, BLOCK_CELLS = 2048, 1 << 25
#: Keys that a task holds for blocks that are not full yet.
OPEN_KEYS = 4_000_000
#: (item, term) pairs of a round of queries, and terms that are looked up in a block at once.
ROUND_TERMS, TERM_GROUP = 20_000, 2048
#: Terms whose counts or hashes a task holds before it hands them on.
HELD_TERMS = 500_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x20


def _term_bytes() -> bytes:
    """Where each byte goes: separators to blanks, A-Z to a-z."""
    out = bytearray(range(256))
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[low : high + 1] = bytes([SPACE]) * (high + 1 - low)
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    return bytes(out)


TERM_BYTES = _term_bytes()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: stretches of ASCII letters, digits and other characters than ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split() if text else []


def level(j: int) -> int:
    """The least frequency of level ``j``: 1, 2, 3, 4, 6, 8, 12, 16, and so on."""
    return j + 1 if j < 3 else (4 if j % 2 else 6) << (j - 3) // 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(hashes: np.ndarray, j: int) -> np.ndarray:
    """What stands for terms at level ``j``."""
    return _mixed(hashes + np.array([j + 1], np.uint64) * GOLDEN)


def _places(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slices of each key, a row of ``HASHES`` for each."""
    step = _mixed(keys + GOLDEN) | np.uint64(1)
    at = keys[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (_mixed(at) % np.uint64(slices)).astype(np.int64)


class Hashes(dict):
    """64-bit hashes of terms, a bounded number of them remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= HELD_TERMS:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value

    def of(self, terms: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), np.uint64, n)


INDEX = "docs array<long>, texts array<long>, sizes array<long>, slices int, bits binary, term binary, documents long"
_INDEX_ARROW = pa.schema(
    [
        ("docs", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.int32()),
        ("bits", pa.binary()), ("term", pa.binary()), ("documents", pa.int64()),
    ]
)


class _Blocks:
    """Documents of like size gathered until they fill a block."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple]] = {}
        self.held = 0

    def add(self, doc: int | None, text: int, size: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = math.ceil(2 * math.log2(len(keys) + 1))
        rows = self.open.setdefault(kind, [])
        rows.append((doc, text, size, keys))
        self.held += len(keys)
        if len(rows) == BLOCK_DOCUMENTS or (len(rows) + 1) * SLICES_PER_KEY * 2 ** (kind / 2) > BLOCK_CELLS:
            yield self.close(kind)
        while self.held > OPEN_KEYS:
            yield self.close(max(self.open, key=lambda k: sum(len(r[3]) for r in self.open[k])))

    def close(self, kind: int) -> pa.RecordBatch:
        docs, texts, sizes, keys = zip(*self.open.pop(kind), strict=True)
        counts = [len(k) for k in keys]
        self.held -= sum(counts)
        slices = SLICES_PER_KEY * max(counts)
        cells = np.zeros((slices, -(-len(docs) // 8) * 8), np.uint8)
        of = np.repeat(np.arange(len(docs)), counts)
        for at in _places(np.concatenate(keys), slices).T:
            cells[at, of] = 1
        bits = np.packbits(cells, axis=1).tobytes()
        row = {"docs": list(docs), "texts": list(texts), "sizes": list(sizes), "slices": slices, "bits": bits}
        return pa.RecordBatch.from_pylist([row], _INDEX_ARROW)


def _term_rows(found: Counter) -> pa.RecordBatch:
    n = len(found)
    empty = [pa.nulls(n, f.type) for f in list(_INDEX_ARROW)[:5]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], schema=_INDEX_ARROW)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of signatures and numbers of documents for each term, from (doc_id, text_hash, text)."""
    blocks, holding, hashes = _Blocks(), Counter(), Hashes()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, text_hash, text in zip(ids, texts, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            terms = terms_of(text)
            if not terms:
                continue
            counted = Counter(terms)
            holding.update(counted.keys())
            h = hashes.of(counted.keys(), len(counted))
            times = np.fromiter(counted.values(), np.int64, len(counted))
            keys, j, most = [_keys(h, 0)], 1, int(times.max())
            while level(j) <= most:
                keys.append(_keys(h[times >= level(j)], j))
                j += 1
            yield from blocks.add(doc, text_hash, len(terms), np.concatenate(keys))
            if len(holding) >= HELD_TERMS:
                yield _term_rows(holding)
                holding = Counter()
    for kind in list(blocks.open):
        yield blocks.close(kind)
    if holding:
        yield _term_rows(holding)


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``df``, written to the shared folder: blocks of signatures and numbers of documents by term.

    Documents without a term are left out. Blocks hold documents of like size, so
    that no long document makes the signatures of short ones long; a block and what a
    task holds for open blocks are bounded. One pass over the texts, nothing is shuffled.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_indexed, INDEX), "lexical-index")


class _Round:
    """The queries of one round: items, their terms, weights, and how often each item holds each term."""

    def __init__(self, rows: list[tuple], documents: int, words: int):
        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))
        terms = sorted({r[1]: r[3] for r in rows}.items())
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for _, df in terms], np.int64)
        self.documents, self.words = documents, words
        self.hashes = Hashes().of((t for t, _ in terms), len(terms))
        self.at = {t: i for i, (t, _) in enumerate(terms)}
        place = {item: i for i, item in enumerate(self.items)}
        self.times = np.zeros((len(self.items), len(terms)))
        for item, term, times, _ in rows:
            self.times[place[item], self.at[term]] = times
        if float((self.times * np.maximum(self.weights, 0)).sum(axis=1).max(initial=0)) * 1e6 >= 2**53:
            self.times = self.times.astype(np.int64)  # sums beyond what doubles hold exactly

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        """A document's m."""
        return 75 + 25 * sizes * self.documents // self.words

    def bounds(self, block: dict) -> np.ndarray:
        """What each item's score in each document of a block is at most: weighted sums of slices."""
        sizes = np.array(block["sizes"], np.int64)
        m, n = self.norm(sizes), len(sizes)
        bits = np.frombuffer(block["bits"], np.uint8).reshape(block["slices"], -1)
        total = np.zeros((len(self.items), n), self.times.dtype)
        for low in range(0, len(self.hashes), TERM_GROUP):
            some = np.arange(low, min(low + TERM_GROUP, len(self.hashes)))
            reached, levels, parts = None, None, [np.zeros(n, np.int64)]
            alive = np.arange(len(some))
            while len(alive):
                places = _places(_keys(self.hashes[some[alive]], len(parts) - 1), block["slices"])
                now = np.bitwise_and.reduce(bits[places], axis=1)
                if reached is not None:
                    now &= reached
                held = now.any(axis=1)
                alive, reached = alive[held], now[held]
                if not len(alive):
                    break
                if levels is None:
                    some, alive = some[alive], np.arange(len(alive))
                    levels = np.zeros((len(some), n), np.uint8)
                levels[alive] += np.unpackbits(reached, axis=1, count=n)
                most = np.minimum(level(len(parts)) - 1, sizes)
                parts.append(1_000_000_000 * most // (1000 * most + 12 * m))
            if levels is not None:
                part = np.take_along_axis(np.stack(parts), levels.astype(np.intp), axis=0) * self.weights[some, None]
                total += self.times[:, some] @ part.astype(self.times.dtype)
        return total.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in ("docs", "texts", "sizes", "slices", "bits")}


_PAIRS = "item int, doc_id long, text_hash long, size long, bound long"
_PAIRS_ARROW = pa.schema([("item", pa.int32()), *((n, pa.int64()) for n in ("doc_id", "text_hash", "size", "bound"))])


def _pairs(item: np.ndarray, at: np.ndarray, bound: np.ndarray, block: dict) -> pa.RecordBatch:
    at = pa.array(at)
    named = (pa.array(block[n], pa.int64()).take(at) for n in ("docs", "texts", "sizes"))
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), *named, pa.array(bound)], schema=_PAIRS_ARROW)


def _likely(blocks: DataFrame, shared, k: int) -> DataFrame:
    """The ``k`` documents of highest bound of each item in each task."""

    def run(batches):
        queries, best = shared.value, _PAIRS_ARROW.empty_table()
        for block in _blocks(batches):
            bounds = queries.bounds(block)
            top = np.argsort(-bounds, axis=1, kind="stable")[:, :k]
            item, at = np.repeat(np.arange(len(bounds)), top.shape[1]), top.ravel()
            above = bounds[item, at] > 0
            found = _pairs(item[above], at[above], bounds[item[above], at[above]], block)
            best = _best(pa.concat_tables([best, pa.Table.from_batches([found])]), k)
        yield from best.combine_chunks().to_batches()

    return blocks.mapInArrow(run, _PAIRS)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` rows of highest bound of each item."""
    rows = rows.sort_by([("item", "ascending"), ("bound", "descending")])
    item = rows.column("item").to_numpy()
    return rows.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def _survivors(blocks: DataFrame, shared, floors) -> DataFrame:
    """Every (item, document) that its bound doesn't prove to be below the item's floor, a pair of score and id."""

    def run(batches):
        queries = shared.value
        scores, ids = floors.value
        for block in _blocks(batches):
            bounds = queries.bounds(block)
            docs = np.array([np.iinfo(np.int64).max if d is None else d for d in block["docs"]])
            open_ = (bounds > scores[:, None]) | (bounds == scores[:, None]) & (docs <= ids[:, None])
            item, at = np.nonzero(open_ & (bounds > 0))
            if len(item):
                yield _pairs(item, at, bounds[item, at], block)

    return blocks.mapInArrow(run, _PAIRS)


_SCORES = "item int, doc_id long, score long"
_SCORES_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _rescored(docs: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """(item, doc_id, score) of the given pairs, exactly, from the whole texts; scores above 0 only."""
    named = pairs.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("item").alias("items"))
    wanted = small(checkpointed(named))
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))

    def run(batches):
        queries = shared.value
        for batch in batches:
            out = []
            for doc, text, items in zip(
                batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                terms = terms_of(text)
                counted = [(queries.at[t], c) for t, c in Counter(terms).items() if t in queries.at]
                if not counted:
                    continue
                at, times = np.array(counted, np.int64).T
                m = queries.norm(np.array([len(terms)], np.int64))
                part = queries.weights[at] * (1_000_000_000 * times // (1000 * times + 12 * m))
                scores = queries.times[np.ix_(items, at)].astype(np.int64) @ part
                out += [(i, doc, int(s)) for i, s in zip(items, scores, strict=True) if s > 0]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_SCORES_ARROW.names, r, strict=True)) for r in out], _SCORES_ARROW)

    return rows.select("doc_id", "text", "items").mapInArrow(run, _SCORES)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) for each different term of each item."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counted = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(counted), pa.int64()), pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())],
                    names=["item_id", "term", "times"],
                )

    return items.mapInArrow(run, "item_id long, term binary, times long")


def search(df: DataFrame, queries: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0, ties to smaller ids.

    ``queries`` has (item_id, text); ``index`` is :func:`build_index` of ``df``, built here if it is not given.

    The bounds of a few documents of each task choose the first documents that are
    scored; their ``k``-th score is each query's floor. Then every document whose bound
    reaches the floor (or ties with it under a smaller id) is scored exactly from its whole text: no
    document is left out that its bound does not prove to be out. Of copies of one text (equal hash, size and
    bound) the ``k`` of least id are scored: others cannot rank. Queries go in rounds of
    bounded size, each of which reads the whole index; documents that are scored are found
    by id and hash of text, sent to all tasks if they are few and joined otherwise.

    A null or empty text has no terms; a query without terms has no rows. Repeated documents are ranked
    one by one, documents without id after those with one. Of repeated item ids the least text asks;
    a null item id is an item too. Empty tables give no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared_folder(spark)
    index = build_index(df, doc_id, text) if index is None else index
    blocks = index.where("bits IS NOT NULL").select("docs", "texts", "sizes", "slices", "bits")
    counted = index.where("bits IS NOT NULL").select("sizes").agg(
        F.coalesce(F.sum(F.size("sizes")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    )
    documents, words = counted.first()
    asked = queries.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    pairs = _item_terms(asked)
    held = index.where("term IS NOT NULL").join(pairs.select("term").distinct(), "term", "left_semi")
    known = held.groupBy("term").agg(F.sum("documents").alias("documents"))
    terms = checkpointed(pairs.join(known, "term").select("item_id", "term", "times", "documents"))
    rounds = -(-terms.count() // ROUND_TERMS)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for r in range(rounds):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()
        if not rows:
            continue
        asking = _Round([(x.item_id, bytes(x.term), x.times, x.documents) for x in rows], documents, words)
        shared = spark.sparkContext.broadcast(asking)
        likely = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"), "text_hash")
        first = _likely(blocks, shared, k).withColumn("rank", F.row_number().over(likely)).where(F.col("rank") <= k)
        scores, ids = np.zeros(len(asking.items), np.int64), np.full(len(asking.items), np.iinfo(np.int64).max)
        for x in _ranked(_rescored(docs, first, shared), k).where(F.col("rank") == k).collect():
            scores[x.item], ids[x.item] = x.score, np.iinfo(np.int64).max if x.doc_id is None else x.doc_id
        floors = spark.sparkContext.broadcast((scores, ids))
        copies = Window.partitionBy("item", "text_hash", "size", "bound").orderBy(F.asc_nulls_last("doc_id"))
        open_ = _survivors(blocks, shared, floors).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
        found = _ranked(_rescored(docs, open_, shared), k)
        named = F.array(*(F.lit(i).cast("long") for i in asking.items))
        out = out.unionByName(found.select(F.get(named, F.col("item")).alias("item_id"), "rank", "doc_id", "score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
sizes AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY 1, 2
),
w AS (
    SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM q JOIN df USING (term), total
),
scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM w JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY 1, 2
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
