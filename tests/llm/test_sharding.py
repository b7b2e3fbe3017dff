import zlib
from collections import Counter

import pytest

from geolith.llm.sharding import shard_plan, write_shards

from .helpers import documents


def plain(rows, shards):
    """(doc_id, text) in the order of first ids; each group in the shard of its middle, larger ones document by document."""
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i: (i is not None, i or 0)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    named = lambda ids: min((i for i in ids if i is not None), default=None)
    total, largest = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    at, out = 0, []
    for t, ids in sorted(groups.items(), key=lambda x: key(named(x[1]))):
        whole = size(t) * len(ids)
        for k, i in enumerate(sorted(ids, key=key)):
            middle = 2 * at + whole if whole <= largest else 2 * (at + k * size(t)) + size(t)
            out.append((i, zlib.crc32(t.encode()), size(t), middle * shards // (2 * total)))
        at += whole
    slots = Counter()
    for n, (*row, s) in enumerate(out):
        out[n] = (*row, s, slots[s])
        slots[s] += 1
    return out


TEXTS = ["a", "bb", "a", None, "", "ümlaut\n", "a", "x" * 90, "bb", "c" * 31, "a", "d", "e" * 7, "a", "a"]


def found(df, shards):
    return sorted((r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in shard_plan(df, shards).collect())


@pytest.mark.parametrize("shards", [1, 3, 16, 40])
def test_plan_equals_plain(spark, shards):
    df = documents(spark, TEXTS, extra=True).repartition(3)
    assert found(df, shards) == sorted(plain(list(enumerate(TEXTS)), shards))


def test_hot_group_is_split_evenly(spark):
    texts = ["same text of a third of all rows"] * 400 + [f"text {i} of {i % 7} words" for i in range(800)]
    got = found(documents(spark, texts), 16)
    assert got == sorted(plain(list(enumerate(texts)), 16))
    held = Counter()
    for _, _, size, shard, _ in got:
        held[shard] += size
    assert max(held.values()) - min(held.values()) <= 2 * max(r[2] for r in got)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (6, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_plan(df, 3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard_plan(df.where("false"), 3).count() == 0


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(1, "bb"), (1, "bb")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, slot int").withColumnRenamed("slot", "n")
    write_shards(df, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(r.n for r in back) == list(range(len(rows)))
    for s in range(4):
        slots = sorted(r.slot for r in back if r.shard == s)
        assert slots == list(range(len(slots)))
