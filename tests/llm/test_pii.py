import hashlib
import random
import re
import time

import duckdb
import pytest

from geolith.llm.pii import OP1_SQL, find_pii, op1_pii, redact

from .helpers import as_table, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def test_base_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    alphabet = ["1", "2", "255", ".", " ", "-", "+", "@", "a", "B", "é", "😀", "(", ")", "_", "4111 1111 1111 1111", "x@y.zz"]
    texts = [None, "", "plain", "@" * 50, "a.b_c%d@e.f_g@h.i@j.k", "1.2.3.4.5.6.7.8", "001.2.3.0255 999.1.1.1.1.1.1.1"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    folder = as_table(documents(spark, texts), tmp_path)
    for row in op1_pii(spark, folder).collect():
        spans = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[row.doc_id]
        assert row.n_email == sum(s.startswith("email") for s in spans)
        assert row.n_card == sum(s.startswith("card") for s in spans)


def test_added_kinds_need_checksum_or_context(spark):
    texts = [
        "pay to GB82 WEST 1234 5698 7654 32 now",
        "pay to GB83 WEST 1234 5698 7654 32 now",
        "social security 123-45-6789",
        "part number 123-45-6789",
        "ssn 000-45-6789",
    ]
    found = {r.doc_id: [s.kind for s in r.pii_spans] for r in find_pii(documents(spark, texts)).collect()}
    assert found == {0: ["iban"], 1: [], 2: ["national_id"], 3: [], 4: []}


def test_context_adjusts_the_score(spark):
    rows = find_pii(documents(spark, ["email me: a@b.cc", "zzz a@b.cc"])).orderBy("doc_id").collect()
    assert rows[0].pii_spans[0].score == pytest.approx(1.0)
    assert rows[1].pii_spans[0].score == pytest.approx(0.8)


def test_long_texts_many_spans_and_clashing_columns(spark):
    texts = ["9" * 200_000, "a" * 200_000 + "@", "10.0.0.1 " * 4_000, "1 " * 100_000]
    rows = {r.doc_id: r for r in find_pii(documents(spark, texts, extra=True)).collect()}
    assert [len(rows[i].pii_spans) for i in range(4)] == [0, 0, 4000, 0]
    assert (rows[2].pii_spans[-1].start, rows[2].pii_spans[-1].end) == (9 * 3999, 9 * 3999 + 8)


def test_a_text_of_many_spans_takes_time_in_proportion(spark):
    def seconds(n):
        docs = documents(spark, ["10.0.0.1 a@b.cc " * n]).cache()
        docs.count()
        began = time.perf_counter()
        row = find_pii(docs).selectExpr("size(pii_spans) AS n", "element_at(pii_spans, -1).start AS last").first()
        assert (row.n, row["last"]) == (2 * n, 16 * (n - 1))
        return time.perf_counter() - began

    seconds(10_000)
    assert seconds(100_000) < 2.5 * seconds(50_000) + 1


def test_columns_with_internal_names_stay(spark):
    docs = documents(spark, ["a@b.cc"]).selectExpr("*", "'u' AS __text", "1 AS __email_m", "'v' AS __aside", "5 AS pii_spans")
    row = find_pii(docs).first()
    assert (row["__text"], row["__email_m"], row["__aside"]) == ("u", 1, "v") and row.pii_spans[0].kind == "email"
    assert find_pii(docs).columns == docs.columns


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a@b.cc"])
    assert find_pii(docs.union(docs)).count() == 2
    assert find_pii(docs.limit(0)).count() == 0


def test_redaction(spark):
    assert redact(find_pii(documents(spark, ["to a@b.cc!"]))).first().text == "to <email>!"
    texts = ["1.1.1.1 and 11.1.1.10", None, "none", "+49 10.1.1.1234567 x@y.zz", "a@b.cc"]
    rows = {r.doc_id: r.text for r in redact(find_pii(documents(spark, texts))).collect()}
    assert rows == {0: "<ip> and <ip>", 1: None, 2: "none", 3: "<phone> <email>", 4: "<email>"}


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    parts = [
        "a@b.cc", "_", " ", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234567", "GB82 WEST 1234 5698 7654 32",
        "GB82WEST12345698765433", "123-45-6789", "ssn", "social security", "666-12-3456", "-", "é", "tax id: ", "x" * 45, "7",
    ]
    texts = [None, "", *("".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(14))) for _ in range(300))]
    folder = as_table(documents(spark, texts), tmp_path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = op1_pii(spark, folder)
    columns = sorted(found.columns)
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({OP1_SQL})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected)
    assert sum(r[columns.index("n_iban")] for r in expected) > 10 and sum(r[columns.index("n_national_id")] for r in expected) > 10
