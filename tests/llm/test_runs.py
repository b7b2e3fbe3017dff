import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.llm import runs as module
from geolith.llm.runs import Wavelet, find_runs, op11_runs, runs_of

from .helpers import as_table, documents


def plain_runs(words):
    """Every maximal stretch of every period, the smallest period of each, by comparing all words."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        t = 0
        while t + q < n:
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            if t + q - s >= max(24, 3 * q):
                found.setdefault((s, t + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    """Words with planted powers, powers of powers, and near misses."""
    kind = rng.randrange(5)
    letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 40]))]
    some = lambda k: [rng.choice(letters) for _ in range(k)]
    if kind == 0:
        return some(rng.randrange(200))
    out = some(rng.randrange(30))
    for _ in range(rng.randrange(1, 4)):
        root = some(rng.randrange(1, 40))
        if kind == 2:
            inner = some(rng.randrange(1, 4)) * rng.randrange(2, 14)
            root = inner + some(rng.randrange(1, 3)) + (inner if rng.random() < 0.5 else [])
        power = root * rng.randrange(2, 7)
        power = power[: len(power) - rng.randrange(len(root))]
        if kind == 3 and power:
            power[rng.randrange(len(power))] = "odd"
        out += power + some(rng.randrange(20))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(120)]
    found = runs_of([[w.encode() for w in t] for t in texts])
    for words, got in zip(texts, found, strict=True):
        assert got == plain_runs(words), words


def test_wavelet_equals_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        low = rng.integers(0, n, 200)
        high = low + 1 + rng.integers(0, n, 200) % (n - low)
        x = rng.integers(0, n + 3, 200)
        got = Wavelet(values).successor(low, high, x)
        want = [min((v for v in values[a:b] if v >= c), default=np.iinfo(np.int64).max) for a, b, c in zip(low, high, x, strict=True)]
        assert got.tolist() == want


def test_one_word_many_times_takes_linear_time():
    assert runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    block = ([b"a"] * 500 + [b"b"]) * 200
    assert (0, len(block), 501) in runs_of([block])[0]


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_plain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "GROUP_WORDS", 500)
    rng = random.Random(3)
    texts = [None, "", "  ", "  x\x1cy", "a " * 5000] + [rng.choice([" ", "\n", "\t "]).join(made(rng)) for _ in range(120)]
    df = documents(spark, texts, extra=True)
    df = df.unionByName(df.where("doc_id < 9")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = op11_runs(spark, as_table(df, tmp_path)).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)


def test_columns_of_added_names_are_replaced(spark):
    df = documents(spark, ["x y " * 20, None]).withColumn("runs", F.lit(1))
    got = find_runs(df).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [40, 0] and got[0].runs[0].period == 2 and got[1].strongest is None
    assert find_runs(df.where("false")).count() == 0
