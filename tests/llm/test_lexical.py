import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from geolith.llm import lexical
from geolith.llm.lexical import build_index, level, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain(docs, items, k=20):
    """Every score of every pair, in plain Python."""
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, words = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall(lowered(text))), []
        for doc, c, size in held:
            m = 75 + 25 * size * n // words
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "été", "naïve", "x1", "ſ"]
    text = lambda m: " ".join(rng.choice(words[: rng.choice([5, 40, 305])]) for _ in range(m))
    docs = [text(rng.choice([0, 1, 5, 60, 60, 60, 900])) for _ in range(n)]
    return docs + [docs[7]] * (n // 3) + [None, "", "...", "same same same"]


def run(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in search(d, q, k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "ROUND_TERMS", 60)
    docs = list(enumerate(corpus(seed, 150)))
    items = [(i, t) for i, t in enumerate(corpus(seed + 10, 8))] + [(99, "absent"), (100, "W1, w1 ÉTÉ été!")]
    assert run(spark, docs, items) == sorted(plain(docs, items))


def test_null_and_repeated_rows(spark):
    docs = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (2, "a a"), (4, None)]
    items = [(1, "a"), (2, None), (3, "")]
    assert sorted(run(spark, docs, items), key=str) == sorted(plain(docs, items), key=str)
    assert run(spark, docs, []) == [] == run(spark, [], items)


def test_levels_bound_frequencies():
    found = [level(j) for j in range(9)]
    assert found == [1, 2, 3, 4, 6, 8, 12, 16, 24]


def test_bounds_never_undercut(spark):
    docs = list(enumerate(corpus(5, 60)))
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string")).where("bits IS NOT NULL").collect()
    held = [terms_of((t or "").encode()) for _, t in docs]
    n, words = sum(map(bool, held)), sum(map(len, held))
    asked = [(1, t, 1, sum(t in h for h in held)) for t in (b"w1", b"w2", b"w30", b"w250")]
    queries = lexical._Round(asked, n, words)
    exact = {(d, s): v for d, _, s, v in ((r[2], 0, 0, r[3]) for r in plain(docs, [(1, "w1 w2 w30 w250")], 10**6))}
    few = {i for i, h in enumerate(held) if all(h.count(t) <= 3 for _, t, _, _ in asked)}
    tight = 0
    for block in index:
        bounds = queries.bounds(block.asDict())
        assert bounds.shape == (1, len(block.docs))
        for doc, bound in zip(block.docs, np.asarray(bounds)[0], strict=True):
            assert bound >= exact.get((doc, 0), 0)
            tight += doc in few and bound == exact.get((doc, 0), 0)
    assert tight > 0.9 * sum(map(bool, (held[i] for i in few)))
