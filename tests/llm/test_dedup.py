import random
import re
import time

import duckdb
import xxhash

from geolith.llm.components import connected_components
from geolith.llm.line_dedup import OP8_SQL, dedup_lines, op8_line_dedup
from geolith.llm.simhash import drop_near_duplicates, fingerprint, near_links, op5_simhash

from .helpers import as_table, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Alpha", "beta", "gamma", "Éta", "x"]) for _ in range(80)) for _ in range(25)]
    texts = [None, "", " \t", "one", "two words", "one", "\x85   a"]
    for b in base:
        words = b.split()
        texts += [b, b.upper(), " ".join([*words[:40], "new", *words[40:]]), b + " tail"]
    folder = as_table(documents(spark, texts, extra=True), tmp_path)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = roots(prints, linked)
    rows = op5_simhash(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == expected[r.doc_id]


def test_index_loses_no_link(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(6):
            flips = rng.sample(range(64), rng.randrange(1, 6))
            prints.add(s ^ sum(1 << b for b in flips))
    expected = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = near_links(spark.createDataFrame(signed, "fp long")).collect()
    assert {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (1, 0)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == roots({n for p in links for n in p}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = ["a b c d e f", "a b c d e f", "other words stand here now", None, ""]
    docs = documents(spark, texts, extra=True)
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [0, 2, 3]
    assert drop_near_duplicates(docs).columns == docs.columns
    assert sorted(r.doc_id for r in drop_near_duplicates(docs.union(docs)).collect()) == [0, 2, 3]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_long_text_fingerprint():
    text = "word " * 100_000
    assert fingerprint(text) == plain_fingerprint("word word word")


LINE = "This line is long enough to count."


def test_lines_equal_sql(spark, tmp_path):
    rng = random.Random(6)
    pool = [LINE, LINE.upper(), "  " + LINE + "\t", "short", "", "ÉTÉ " + LINE, "été " + LINE, "another shared line, long enough"]
    texts = [None, "", "\n\n", LINE, LINE + "\r", LINE + "\n" + LINE, "x" * 300_000]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = documents(spark, texts, extra=True)
    folder = as_table(docs, tmp_path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, op8_line_dedup(spark, folder).select(*columns).collect())) == sorted(
        db.sql(f"SELECT {', '.join(columns)} FROM ({OP8_SQL})").fetchall()
    )


def test_a_document_of_many_lines_takes_time_in_proportion(spark):
    def seconds(n):
        texts = ["\n".join([LINE, *(f"line {i}" for i in range(n))])] * 3
        began = time.perf_counter()
        rows = dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
        assert [r.n_dropped for r in rows] == [1, 1, 0] and rows[0].text.count("\n") == n - 1 and rows[0].n_lines == n + 1
        return time.perf_counter() - began

    seconds(10_000)
    assert seconds(100_000) < 2.5 * seconds(50_000) + 1


def test_line_columns_with_internal_names_stay(spark):
    docs = documents(spark, [LINE] * 3).selectExpr("*", "'u' AS __th", "'v' AS __aside", "'w' AS __dropped", "3 AS n_lines")
    out = dedup_lines(docs)
    assert out.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert {(r["__th"], r["__aside"], r["__dropped"], r.n_lines) for r in out.collect()} == {("u", "v", "w", 1)}


def test_repeated_rows_count_as_one_document(spark):
    docs = documents(spark, [LINE, LINE])
    assert {r.n_dropped for r in dedup_lines(docs.union(docs)).collect()} == {0}
    assert sorted(r.n_dropped for r in dedup_lines(documents(spark, [LINE] * 3)).collect()) == [0, 1, 1]
    assert dedup_lines(docs.limit(0)).count() == 0
