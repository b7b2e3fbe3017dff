"""What grows with the input: work for a long text, and what a Python worker holds at once."""

import time

from pyspark.sql import functions as F

from geolith.functions import text
from geolith.operators import events, questions
from geolith.plans import learning


def test_snippets_of_a_long_text_take_linear_time(spark):
    long = " ".join(f"Sentence {i} stands here." for i in range(12_000)) + " A license ends it. Done."
    rows = spark.createDataFrame([(1, long), (2, "No term here. At all."), (3, None), (4, "")], "doc_id long, text string")
    began = time.perf_counter()
    found = text.term_snippets(rows, "doc_id", "text", ["license"]).collect()
    assert time.perf_counter() - began < 20
    assert [(r.doc_id, r.n, list(r.snippets)) for r in found] == [(1, 1, ["Sentence 11999 stands here. A license ends it. Done."])]


def test_pages_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.createDataFrame([(1, "https://a.example/x", "<p>" + "word " * 20 + "</p>")], "page_id long, url string, html string")
    for query in (text.article_paragraphs, text.articles, text.article_texts):
        spark.conf.set(key, "10000")
        assert query(pages).count() == 1
        assert int(spark.conf.get(key)) <= 500


def test_a_question_is_parsed_once_however_often_it_is_asked(spark, monkeypatch):
    parsed = []
    plans = questions._plans
    monkeypatch.setattr(questions, "_plans", lambda asked, *rest: parsed.append(asked.count()) or plans(asked, *rest))
    names = spark.createDataFrame([("Peru", "PER"), ("Chile", "CHL")], "alias string, iso3 string")
    asked = spark.range(600).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'How do Peru and Chile relate in 1999?' WHEN 1 THEN 'Events in Peru' END AS text")
    found = {r.id: (r.intent, r.countries, r.year) for r in questions.parse(asked, names).collect()}
    assert parsed == [3] and len(found) == 600
    assert [found[i] for i in (0, 1, 2)] == [("bilateral", "CHL,PER", 1999), ("events", "PER", None), ("profile", "", None)]
    assert all(found[i] == found[i % 3] for i in range(600))


def test_cluster_quality_prepares_events_once(spark):
    drawn = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: drawn.add(1) or x, "double").asNondeterministic()
    rows = spark.range(60).selectExpr("id AS event_id", "lpad(1 + id % 15, 2, '0') AS root", "cast(id % 7 AS double) - 3 AS goldstein")
    assert "null" in events.cluster_quality(rows.withColumn("goldstein", seen("goldstein")).where("event_id >= 0"))
    assert drawn.value <= 120  # a row's filter and value; not again for each pass


def test_models_read_the_orders_once(spark, sf_dir):
    rows = learning._lagged(spark, sf_dir)
    assert rows.count() and "orders.parquet" not in " ".join(rows.inputFiles())
