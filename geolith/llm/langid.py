"""Operator 2: language identification as a mixture over languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, restored, set_aside, table

#: About so many documents of each language, by hash of their id, train the model.
TRAIN_DOCS_PER_LANGUAGE = 1500
#: Hashed byte trigrams.
BUCKETS = 1 << 16
SMOOTHING = 0.2
#: Expectation-maximisation ends when no share moves by so much, or after so many rounds.
TOLERANCE, EM_ROUNDS = 1e-3, 100
#: Rounds after which documents that a bound shows to be of one language leave.
FIRST_ROUNDS = 4
#: Weight of the penalty for each further language, in units of log(words) / 2.
PENALTY = 4.0
#: Positions times languages that are scored at a time; a longer text is scored in pieces cut at words.
SCORE_CELLS = 4_000_000
#: Documents whose main language has a smaller share are rejected in the pipeline: no language leads.
MIN_SHARE = 0.34
#: So are documents whose trigrams are less likely on average: the languages explain them no better than
#: random letters, which stand at -12 or less, where texts in the languages stand at -8 or more.
MIN_FIT = -10.0
UNDETERMINED = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def letter_bytes(text: str) -> bytes:
    """Lower-cased text in UTF-8 between spaces, ASCII characters that are no letters as spaces."""
    return b" " + text.lower().encode().translate(_LETTERS) + b" "


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte; BUCKETS for spaces and the ends."""
    out = np.full(len(data), BUCKETS, np.int32)
    if len(data) >= 3:
        x = data.astype(np.uint32)
        key = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)
        out[1:-1] = np.where(data[1:-1] == 32, BUCKETS, key >> np.uint32(16))
    return out


class LanguageModel:
    """Log likelihoods of trigrams by language, and the mixture inference on them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts.astype(np.float64) + SMOOTHING
        self.table = np.zeros((BUCKETS + 1, len(languages)), np.float32)  # the last row: no trigram
        self.table[:BUCKETS] = np.log(smooth / smooth.sum(axis=0))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, share, log likelihood per trigram, size of the language set) of each text."""
        out: list = [(UNDETERMINED, 0.0, 0.0, 0)] * len(texts)
        if not self.languages:
            return out
        room, some, size = SCORE_CELLS // len(self.languages), [], 0
        todo = [(i, letter_bytes(t)) for i, t in enumerate(texts) if has_letter(t)]
        for item in todo:
            if some and size + len(item[1]) > room:
                self._judge(some, out)
                some, size = [], 0
            some.append(item)
            size += len(item[1])
        if some:
            self._judge(some, out)
        return out

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of ``data`` start, and the log likelihood of each in every language."""
        room = SCORE_CELLS // len(self.languages)
        starts, scores, at = [], [], 0
        while at < len(data) - 1:
            stop = len(data) if len(data) - at <= room else data.rfind(b" ", at + 1, at + room) + 1
            if stop <= at + 1:  # one word that is longer than a piece
                stop = (data.find(b" ", at + room) + 1) or len(data)
            piece = np.frombuffer(data, np.uint8, stop - at, at)
            space = piece == 32
            first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            if len(first):
                starts.append(first + at)
                scores.append(np.add.reduceat(self.table[trigram_buckets(piece)], first, axis=0).astype(np.float64))
            at = stop - 1  # the space between two pieces stands in both
        if not starts:
            return np.empty(0, np.int64), np.empty((0, len(self.languages)))
        return np.concatenate(starts), np.concatenate(scores)

    def _judge(self, items: list[tuple[int, bytes]], out: list) -> None:
        data = b"".join(x for _, x in items)
        starts, words = self._words(data)
        ends = np.cumsum([len(x) for _, x in items])
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
        n = np.diff(np.append(first, len(starts)))
        rows = np.flatnonzero(n > 0)  # a text may have letters outside the pattern's reach
        if not len(rows):
            return
        first, n = first[rows], n[rows]
        trigrams = np.array([len(items[r][1]) - items[r][1].count(b" ") for r in rows])
        shares, fit = choose_languages(words, first, n)
        main = shares.argmax(axis=1)
        for row, m, s, f, k in zip(rows, main, shares.max(axis=1), fit / trigrams, (shares > 0).sum(axis=1), strict=True):
            out[items[row][0]] = (self.languages[m], float(min(1.0, s)), float(f), int(k))


class _Mixture:
    """Documents as runs of words; ``odds`` holds each word's likelihoods over its greatest."""

    def __init__(self, words: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.first, self.n = first, n
        self.doc = np.repeat(np.arange(len(n)), n)
        top = words.max(axis=1)
        self.odds = np.exp(words - top[:, None])
        self.base = np.add.reduceat(top, first)

    def of(self, some: np.ndarray) -> _Mixture:
        """The documents of the mask ``some`` alone."""
        kept = _Mixture.__new__(_Mixture)
        inside = some[self.doc]
        kept.n, kept.base, kept.odds = self.n[some], self.base[some], self.odds[inside]
        kept.first = np.concatenate([[0], np.cumsum(kept.n)[:-1]]).astype(np.int64)
        kept.doc = np.repeat(np.arange(len(kept.n)), kept.n)
        return kept

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of ``share``, its slope by language over the words, and the shares one round later."""
        mixed = np.maximum((self.odds * share[self.doc]).sum(axis=1), 1e-300)
        fit = self.base + np.add.reduceat(np.log(mixed), self.first)
        slope = np.add.reduceat(self.odds / mixed[:, None], self.first, axis=0) / self.n[:, None]
        return fit, slope, share * slope

    def settled(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log likelihood when expectation-maximisation has converged; a share of 0 stays 0."""
        share, out, fit_out = share.copy(), share.copy(), np.zeros(len(share))
        left, here = np.arange(len(share)), self
        for round_ in range(EM_ROUNDS + 1):
            fit, _, after = here.step(share)
            done = (np.abs(after - share).max(axis=1) < TOLERANCE) | (round_ == EM_ROUNDS)
            out[left[done]], fit_out[left[done]] = share[done], fit[done]
            if done.all():
                break
            if done.any():
                here, left, share = here.of(~done), left[~done], after[~done]
            else:
                share = after
        return out, fit_out


def penalty(n: np.ndarray, languages) -> np.ndarray:
    return PENALTY * (languages - 1) * np.log(n + 1) / 2


def choose_languages(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (0 outside the chosen set) and log likelihood of each document.

    Expectation-maximisation starts with all languages. The log likelihood is
    concave in the shares, so its slope after a few rounds bounds what any set can
    reach; where that is less than the best single language and the penalty, the
    document is of that language. The others go on: of the shares that it settles
    at, the least is dropped, until one language is left, and the set of the
    best penalised log likelihood is taken. Of equally likely languages the first
    by name wins. No number of languages is too large.
    """
    alone = np.add.reduceat(words, first, axis=0)
    shares = np.zeros((len(n), words.shape[1]))
    shares[np.arange(len(n)), alone.argmax(axis=1)] = 1.0
    value, fit = alone.max(axis=1), alone.max(axis=1)
    if words.shape[1] == 1:
        return shares, fit
    left, mixture = np.arange(len(n)), _Mixture(words, first, n)
    share = np.full(shares.shape, 1.0 / words.shape[1])
    for _ in range(FIRST_ROUNDS):
        likely, slope, share = mixture.step(share)
        most = likely + mixture.n * (slope.max(axis=1) - 1.0)
        rivals = most - penalty(mixture.n, 2) > value[left]
        if not rivals.any():
            return shares, fit
        if not rivals.all():
            left, mixture, share = left[rivals], mixture.of(rivals), share[rivals]
    for k in range(words.shape[1], 1, -1):
        share, likely = mixture.settled(share)
        judged = likely - penalty(n[left], k)
        better = judged > value[left]
        at = left[better]
        shares[at], value[at], fit[at] = share[better], judged[better], likely[better]
        held = np.where(share > 0, share, np.inf)
        share[np.arange(len(share)), held.argmin(axis=1)] = 0.0
        share /= share.sum(axis=1, keepdims=True)
    return shares, fit


def train(docs: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> LanguageModel:
    """Trigram counts by ``lang`` over about ``per_language`` documents of each language.

    Only rows outside the held-out fifth with text and lang count; which ones
    is set by a hash of their id. Counts are summed per partition, then over
    all; the driver gets at most BUCKETS numbers per language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    kept = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.select("lang", "text", place.alias("place")).where(F.col("place") < F.element_at(kept, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                buckets = trigram_buckets(np.frombuffer(letter_bytes(text), np.uint8))
                mine = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                mine += np.bincount(buckets, minlength=BUCKETS + 1)
        for lang, counts in found.items():
            at = np.flatnonzero(counts[:BUCKETS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                names=["lang", "bucket", "n"],
            )

    summed = (
        sample.select("lang", "text")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((BUCKETS, len(languages)))
    at = {k: i for i, k in enumerate(languages)}
    counts[summed["bucket"].to_numpy(int), summed["lang"].map(at).to_numpy(int)] = summed["n"].to_numpy()
    return LanguageModel(languages, counts)


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``lang_score``, ``lang_fit`` and ``lang_count``.

    Words are drawn from a mixture of languages; expectation-maximisation gives
    the document's shares, and :func:`choose_languages` the set of the best
    penalised likelihood. The prediction is the language of the greatest share
    (of equal ones the first by name), the score that share, ``lang_fit`` the
    log likelihood per trigram. Null text, and text without a letter, is
    ``und`` with score 0. An empty table gives no rows; without training rows
    every text is ``und``. Row-local; rows stay as they are, repeated ones
    included, columns of the added names are replaced. Very long texts
    are scored in pieces.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), ("lang_fit", T.DoubleType()), ("lang_count", T.IntegerType())]
    df = df.drop(*(n for n, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(*x) for x in added)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = list(zip(*model.predict(batch.column(at).to_pylist()), strict=True)) or [[]] * 4
            types = [pa.string(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(found, types, strict=True))],
                names=[*batch.schema.names, *(n for n, _ in added)],
            )

    return df.mapInArrow(run, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` in which some language is determined, leads and explains the text."""
    judged = identify(set_aside(docs, "text"), train(docs.select("doc_id", "text", "lang")))
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= MIN_SHARE) & (F.col("lang_fit") >= MIN_FIT))
    return restored(kept, docs.columns, "text")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_count").alias("n_languages"),
    )
