"""Operator 11: periodic runs of words by internal pattern matching.

A run of period q holds an aligned block of about q words that occurs again q
words on. So every aligned block of each length 2^k asks for its occurrences in the
window behind it. A suffix array has the occurrences of a block side by side; a
wavelet matrix over it gives the least of them from a place on (range
successor). Few occurrences are candidates as they are; more of them form an
arithmetic progression, and then only the two periods that align the ends of the
progressions can be a run's.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bound, restored, set_aside, table

#: A run has so many words, and so many times its period.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of the shortest blocks; runs of ``MIN_WORDS`` hold a block and its next occurrence.
BASE = MIN_WORDS // 3
#: Words that are worked on at once; a longer text is worked on alone.
GROUP_WORDS = 200_000
#: Words compared first when a stretch is extended.
FIRST_STEP = 32


class Wavelet:
    """Wavelet matrix of an array of numbers: counts and order statistics of its ranges, many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for k in reversed(range(self.bits)):
            bit = (values >> k & 1).astype(bool)
            padded = np.zeros(len(bit) // 64 * 64 + 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((k, words, before, len(bit) - int(before[-1])))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [low, high) are less than ``x``."""
        total, whole = np.zeros(len(low), np.int64), x >> self.bits > 0
        size = high - low
        for k, words, before, zeros in self.levels:
            l1, h1 = self._ones(words, before, low), self._ones(words, before, high)
            up = (x >> k & 1).astype(bool)
            total += np.where(up, (high - h1) - (low - l1), 0)
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return np.where(whole, size, total)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of rank ``n``, from 0, in [low, high)."""
        value = np.zeros(len(low), np.int64)
        for k, words, before, zeros in self.levels:
            l1, h1 = self._ones(words, before, low), self._ones(words, before, high)
            down = (high - h1) - (low - l1)
            up = n >= down
            n = np.where(up, n - down, n)
            value |= up.astype(np.int64) << k
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value from ``x`` on in [low, high), and where there is none a number beyond all."""
        passed = self.less(low, high, x)
        found = self.nth(low, high, np.minimum(passed, high - low - 1))
        return np.where(passed < high - low, found, np.iinfo(np.int64).max)


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs, equal ones by place, and each pair's class, named by the place of its first in that order."""
    key = first * (len(first) + 1) + second
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order, rank


def _doubled(rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """From classes of stretches of ``length`` words to those of twice as many; what ends early comes first."""
    behind = np.zeros(len(rank), np.int64)
    behind[: len(rank) - length] = rank[length:] + 1
    return _ordered(rank, behind)


class _Stretches:
    """Maximal stretches of a period, each extended once."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.known: dict[int, tuple[list[int], list[int]]] = {}

    def _equal(self, at: int, period: int, way: int) -> int:
        """How many places from ``at`` on, forwards or backwards, equal the ones a period behind them."""
        x, n, step = self.x, 0, FIRST_STEP
        while True:
            if way > 0:
                a, b = x[at + n : at + n + step], x[at + n + period : at + n + period + step]
                a = a[: len(b)]
            else:
                end = at - n + 1
                start = max(0, end - step)
                a, b = x[start:end][::-1], x[start + period : end + period][::-1]
            unequal = a != b
            if unequal.any():
                return n + int(unequal.argmax())
            n += len(a)
            if len(a) < step:
                return n
            step *= 2

    def around(self, at: int, period: int) -> tuple[int, int]:
        """The maximal stretch of ``period`` around ``at``, which equals the word a period on."""
        starts, ends = self.known.setdefault(period, ([], []))
        i = bisect.bisect_right(starts, at) - 1
        if i >= 0 and at + period < ends[i]:
            return starts[i], ends[i]
        start = at - (self._equal(at - 1, period, -1) if at else 0)
        end = at + self._equal(at, period, 1) + period
        starts.insert(i + 1, start)
        ends.insert(i + 1, end)
        return start, end


def _runs(x: np.ndarray, rank: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of ``x``; ``rank`` has the classes of stretches of ``BASE`` words.

    No text in ``x`` has more than ``longest`` words, and texts are parted by words of their own.
    """
    order, rank = _ordered(rank, np.zeros(len(rank), np.int64))
    blocks, length = [], BASE
    while True:
        at = np.arange(0, len(x), length)
        sizes = np.bincount(rank, minlength=len(x))[rank[at]]
        if not (sizes > 1).any() and (np.bincount(rank) <= 1).all():
            break
        held = at[sizes > 1]
        blocks.append((length, held, rank[held], rank[held] + sizes[sizes > 1]))
        if 2 * length * MIN_PERIODS > longest:
            break
        order, rank = _doubled(rank, length)
        length *= 2
    wavelet, stretches, found = Wavelet(order), _Stretches(x), {}

    def keep(at: int, period: int) -> None:
        if period < 1 or at + period >= len(x) or x[at] != x[at + period]:
            return
        start, end = stretches.around(at, period)
        if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
            found[start, end] = min(period, found.get((start, end), period))

    for length, at, low, high in blocks:
        begin, until = (at + 1, at + 2 * length) if length == BASE else (at + length, at + 2 * length)
        times, place = [], begin
        while len(at):
            place = wavelet.successor(low, high, place)
            held = place < until
            at, low, high, until, place = at[held], low[held], high[held], until[held], place[held]
            times = [t[held] for t in times] + [place]
            if length > BASE and len(times) == 3:
                break
            if length == BASE or len(times) == 1:
                for i, p in zip(at.tolist(), place.tolist(), strict=True):
                    keep(i, p - i)
            elif len(times) == 2:
                for i, p in zip(at.tolist(), place.tolist(), strict=True):
                    keep(i, p - i)
            place = place + 1
        if len(times) == 3:
            for i, p, after in zip(at.tolist(), times[0].tolist(), times[1].tolist(), strict=True):
                step = after - p
                (a, b), (c, d) = stretches.around(i, step), stretches.around(p, step)
                keep(i, c - a)
                keep(i, d - b)
    return sorted((s, e, q) for (s, e), q in found.items())


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    A text in which every stretch of ``BASE`` words is another has no run and goes no further.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    named: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.empty(begins[-1], np.int64)
    for i, words in enumerate(texts):
        x[begins[i] : begins[i + 1] - 1] = [named.setdefault(w, len(named)) for w in words]
        x[begins[i + 1] - 1] = -1 - i
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    order, rank = _ordered(x + len(texts), np.zeros(len(x), np.int64))
    length = 1
    while length < BASE:
        order, rank = _doubled(rank, length)
        length *= 2
    again = (rank[order[1:]] == rank[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    chosen = np.unique(of[order[1:][again]])
    if not len(chosen):
        return out
    kept = np.isin(of, chosen)
    x, rank, of, places = x[kept], rank[kept], of[kept], np.flatnonzero(kept)
    for start, end, period in _runs(x, rank, int(sizes[chosen].max())):
        out[of[start]].append((int(places[start] - begins[of[start]]), end - start, period))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; ties by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g)


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = ("n_words", "runs", "strongest", "collapsed")


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``runs``, the ``strongest`` of them and the text with every run ``collapsed``.

    Words are stretches without ASCII white space. A run is a stretch of at least ``MIN_WORDS``
    words and ``MIN_PERIODS`` times its smallest period that no neighbouring word extends. Runs are in order
    of start, then period; ``strongest`` has most periods (ties: first start, then period) and is null
    without runs. Collapsed texts keep each run's first period and join words by blanks.

    Null and empty text has no words, no runs and an empty collapsed text. Row-local: nothing is
    shuffled, repeated rows stay, columns of the added names are replaced. Texts are worked on in
    groups of bounded size; a longer text alone takes memory in proportion to its words.
    """
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ADDED]
    row = set_aside(df.select(*(F.col(f"`{c}`") for c in keep)), text)
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
    at = row.columns.index(text)
    run_arrow = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def named(run):
        return None if run is None else dict(zip(("start", "length", "period"), run, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            runs, group, words = [], [], 0
            for t in texts:
                if group and words + len(t) > GROUP_WORDS:
                    runs += runs_of(group)
                    group, words = [], 0
                group.append(t)
                words += len(t)
            runs += runs_of(group)
            columns = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[named(r) for r in rs] for rs in runs], pa.list_(run_arrow)),
                pa.array([named(_strongest(rs)) for rs in runs], run_arrow),
                pa.array([_collapsed(t, rs) for t, rs in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ADDED])

    return restored(row.mapInArrow(run, T.StructType([*row.schema.fields, *added])), [*keep, *ADDED], text, *ADDED)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text of one document in ten with a periodic end, as the query's contract has it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")).otherwise("")

    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " ", -1), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, bound(words, repeated)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return find_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
