import hashlib
import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from geolith.llm.chat import OP6_SQL, PART_TYPE, format_conversations, op6_chat, read_back
from geolith.llm.spotsigs import near_duplicates, op10_spotsigs, pruned_jaccard, signatures, spotsigs_classes
from geolith.llm.topk import op9_topk

from .helpers import as_table, documents

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["<|end|>", "<\\|text|>", "<\\\\|turn|>assistant", "<", "|>", "\\", "a\nb", "", None, "é😀<|text|>", "<|" * 500]


def test_conversations_equal_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "Assistant", "system", None, "<|turn|>"]), rng.choice(NASTY)) for c in range(30) for t in range(5)]
    rows += [(99, None, "user", "no turn"), (99, 1, "assistant", "x"), (99, 1, "assistant", "x"), (50, 0, "assistant", "y" * 200_000)]
    folder = as_table(spark.createDataFrame(rows, TURNS), tmp_path, "conversations")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = op6_chat(spark, folder)
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(
        db.sql(f"SELECT {', '.join(columns)} FROM ({OP6_SQL})").fetchall()
    )


def test_attachments_become_ordered_placeholders(spark):
    parts = [
        ("text", "look: <|image|>", None, None), ("image", None, "s3://a/b.png", 4), ("audio", None, "c.wav", 10),
        ("document", None, "d.pdf", None), ("text", "done", None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts[4:]), (2, 0, None, None)], f"conv_id long, turn int, role string, parts {PART_TYPE}")
    rows = {r.conv_id: r for r in format_conversations(df).collect()}
    first = rows[1]
    assert [(a.type, a.uri, a.tokens) for a in first.attachments] == [
        ("image", "s3://a/b.png", 1024), ("audio", "c.wav", 250), ("document", "d.pdf", 512),
    ]
    assert first.expanded_tokens == 1786
    assert all(first.formatted[a.start :].startswith(f"<|{a.type}|>") for a in first.attachments)
    assert [first.formatted[m.start : m.end] for m in first.loss_mask if m.train] == ["done"]
    back = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert back[1].loss_text == "done" and back[1].turns[0].text == "look: <|image|>done"
    assert [t.role for t in back[2].turns] == [""]
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_a_turn_of_many_parts_takes_time_in_proportion(spark):
    def seconds(n):
        parts = [("text", f"part <|{i}", None, None) if i % 2 else ("image", None, f"{i}.png", 1) for i in range(n)]
        df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn int, role string, parts {PART_TYPE}")
        began = time.perf_counter()
        (row,) = read_back(format_conversations(df)).collect()
        assert row.loss_text == "".join(f"part <|{i}" for i in range(1, n, 2))
        return time.perf_counter() - began

    seconds(40)
    assert seconds(40) < 5
    assert seconds(20_000) < 2.5 * seconds(10_000) + 1


def brute_topk(vectors):
    clean = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.setdefault(i, []).append([int(np.floor(64 * float(np.float32(x)))) for x in v])
    out = []
    for q, own in clean.items():
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(min(own), x)), i) for i, xs in clean.items() if i != q for x in xs]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:20])]
    return sorted(out)


def vectors_table(spark, rows, folder):
    schema = "vec_id long, embedding array<float>, label int"
    return as_table(spark.createDataFrame([(i, v, 0) for i, v in rows], schema), folder, "embeddings")


def test_search_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist()) for i in range(600)]
    rows += [(i, [1.0] * 8) for i in range(600, 760)]  # ties
    rows += [(760, None), (780, [float("nan")] * 8), (800, [float("inf")] * 8), (820, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(840, [2.0] * 3), (860, []), (5, rows[5][1]), (20, rows[20][1])]
    found = op9_topk(spark, vectors_table(spark, rows, tmp_path))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute_topk(rows)


def test_search_with_few_or_no_rows(spark, tmp_path):
    few = [(0, [0.5, 0.25]), (1, [1.0, -1.0]), (2, [3.0, 1e6])]
    assert len(op9_topk(spark, vectors_table(spark, few, tmp_path / "few")).collect()) == 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op9_topk(spark, as_table(none, tmp_path / "none", "embeddings")).count() == 0


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def check_edits(spark, folder, rows):
    order = sorted(rows, key=lambda r: -r[0])
    found = {r.doc_id: r for r in op10_spotsigs(spark, folder).collect()}
    assert len(found) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(signatures(text), signatures(edited))) < 1e-12
        assert abs(r.near_next - jaccard(signatures(text), signatures(after))) < 1e-12
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text or "", set()).add(found[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_edits_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = "the of house tree and green with river stone die und le la el que casa".split()
    texts = [None, "", "!!", "😀é", "The end.", "the " * 60_000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += texts[-3:]
    check_edits(spark, as_table(documents(spark, texts, extra=True), tmp_path), list(enumerate(texts)))


def test_edits_of_one_and_no_document(spark, tmp_path):
    check_edits(spark, as_table(documents(spark, ["only one document here"]), tmp_path / "one"), [(0, "only one document here")])
    assert op10_spotsigs(spark, as_table(documents(spark, ["x"]).limit(0), tmp_path / "none")).count() == 0


def test_edits_of_repeated_and_null_ids(spark, tmp_path):
    docs = documents(spark, [f"text number {i} of the set" for i in range(20)])
    nulls = docs.limit(2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")
    assert op10_spotsigs(spark, as_table(docs.union(docs).union(nulls), tmp_path)).count() == 42


def test_rows_without_id_stand_in_ranges_of_their_hash(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("the of a tree house green".split()) for _ in range(rng.randrange(5, 40))) + f" {i}" for i in range(150)]
    docs = documents(spark, [*texts, "the sea " * 300_000]).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    order = [(r.doc_id, r.text) for r in docs.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    expected = []
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        expected.append((doc_id or -1, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    found = op10_spotsigs(spark, as_table(docs, tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in found) == sorted(expected)


def test_only_common_words_are_anchors_where_there_are_some():
    assert len(signatures("the green tree stands and falls")) == 2
    assert len(signatures("green tree")) >= 1 and len(signatures("")) == 1
    assert signatures("The  green, tree").tolist() == signatures("the green tree").tolist()


def test_classes_query(spark, tmp_path):
    texts = ["the green tree of a house and the sea", "the green tree of a house and the sea", "quite another text", None]
    rows = {r.doc_id: (r.class_id, r.n_near) for r in spotsigs_classes(spark, as_table(documents(spark, texts), tmp_path)).collect()}
    assert rows == {0: (0, 0), 1: (0, 0), 2: (2, 0), 3: (3, 0)}


def test_pruning_by_size():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, dtype=np.uint32)
    assert pruned_jaccard(a, b) == 0.5 and pruned_jaccard(a, b, 0.6) == 0.0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(15):
        words = [rng.choice("the of and a to in stone river cloud green walk talk bird".split()) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(150)]
        texts += [" ".join(words), " ".join(words), " ".join([*words[:-3], "changed"]), " ".join(words[:90])]
    members, pairs = near_duplicates(documents(spark, texts))
    of = {r.doc_id: r.class_id for r in members.collect()}
    sets = {i: signatures(t) for i, t in enumerate(texts)}
    names = sorted(set(of.values()))
    expected = {frozenset((a, b)) for a in names for b in names if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert all(of[i] == min(j for j in sets if sets[j].tolist() == sets[i].tolist()) for i in sets)
    assert expected and {frozenset((r.a, r.b)) for r in pairs.collect()} == expected


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(5)
    base = [f"the {w}" for w in (rng.choice("stone river cloud walk bird").strip() + str(i) for i in range(30))]
    texts = [" ".join([*base[: 30 - k], *(f"the new{k}{i}" for i in range(k))]) for k in (0, 1, 2, 9)] + [None, "quite another text"]
    ids = [None, 1, 7, 7, None, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    docs = docs.union(docs.limit(2)).withColumn("set", F.lit("own")).withColumn("signatures", F.lit(0))
    sets = [signatures(t) for t in texts]
    for threshold in (0.5, 0.8):
        members, pairs = near_duplicates(docs, threshold)
        rows = members.collect()
        assert len(rows) == 8 and len({r.set for r in rows}) == 6
        near = [(i, j) for i in range(6) for j in range(i) if jaccard(sets[i], sets[j]) >= threshold]
        expected = sorted(tuple(sorted([-1 if ids[i] is None else ids[i], -1 if ids[j] is None else ids[j]])) for i, j in near)
        found = sorted(tuple(sorted([-1 if r.a is None else r.a, -1 if r.b is None else r.b])) for r in pairs.collect())
        assert found == expected and near
    assert all(x.count() == 0 for x in near_duplicates(docs.limit(0)))


def test_near_duplicates_at_the_border_of_every_length(spark):
    """Sets of n and of n / 0.55 or n / 0.8 signatures, the smaller within the larger, are just near."""
    for threshold, part, whole in ((0.8, 4, 5), (0.55, 11, 20)):
        texts = [" ".join(f"the w{k}x{i} v{i}" for i in range(k * size)) for k in range(1, 12) for size in (part, whole)]
        _, pairs = near_duplicates(documents(spark, texts), threshold)
        sets = [signatures(t) for t in texts]
        expected = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= threshold}
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in pairs.collect()} == expected
