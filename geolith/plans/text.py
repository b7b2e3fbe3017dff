"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import text
from geolith.operators import articles
from geolith.session import ship_package
from geolith.sources.views import table

from .trade import _rounded

TERMS_A, TERMS_B, PLACES = ["than", "the"], ["tion", "ing"], ["the", "of", "and", "that", "with"]


def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return text.article_paragraphs(table(spark, sf_dir, "pages"))


def text_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.sentences(F.coalesce("text", F.lit("")))).alias("n_sentences"))


# A boundary is a closing mark, white space, and then a capital, a digit or a quote.
TEXT_SENTENCE_COUNTS_SQL = r"""
SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0
       ELSE 1 + len(regexp_extract_all(text, '[.!?][ \t\n\x0B\f\r]+[\p{Lu}0-9"''“]')) END::INTEGER AS n_sentences FROM documents
"""


def text_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = docs.select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


TEXT_TOKEN_COUNTS_SQL = r"""
WITH w AS (
    SELECT regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '[^a-z0-9]', '', 'g') AS term
    FROM documents WHERE text IS NOT NULL
)
SELECT term, count(*) AS n FROM w WHERE length(term) >= 3 GROUP BY 1
"""


def text_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text.tf_idf(table(spark, sf_dir, "benchmark"), "item_id", "text"))


TEXT_TF_IDF_SQL = r"""
WITH w AS (
    SELECT item_id, term, count(*) AS tf FROM (
        SELECT item_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '[^a-z0-9]', '', 'g') AS term
        FROM benchmark)
    WHERE length(term) >= 3 GROUP BY 1, 2
), k AS (SELECT term, count(*) AS df FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300),
x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS v FROM w JOIN k USING (term))
SELECT item_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS weight FROM x
"""


def text_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.verdict(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS_A, TERMS_B, PLACES)


def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.term_snippets(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "licensed"])
    return found.select("doc_id", "n", F.array_join("snippets", " | ").alias("snippets"))


def text_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.array_join(text.slug_words(F.col("url")), " ").alias("words"),
        text.safe_url(F.col("url")).alias("safe"),
        text.normalize_key(F.col("url")).alias("url_key"),
    )


TEXT_URL_WORDS_SQL = r"""
WITH p AS (
    SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: length(s) > 8) AS segments,
           lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS protocol
    FROM pages
)
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(segments[-1], ''), '\.\w+$', '')), '[^a-z]+'), lambda w: length(w) >= 3), ' ') AS words,
       coalesce(protocol IN ('http', 'https') AND host <> '' AND NOT regexp_matches(host, '^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)'), false) AS safe,
       trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS url_key FROM p
"""


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return text.articles(table(spark, sf_dir, "pages"))


def _named_articles(spark: SparkSession, sf_dir: str):
    """Articles of all pages with two terms each, further names of the terms, and names of places.

    The first term is the first long word of the headline, the second one of the forty most frequent words, by page; each
    of these has the next one as a further name, and the last sixteen name places, two by two.
    """
    ship_package(spark)
    found = text.article_texts(table(spark, sf_dir, "pages"))
    long_words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{4,}(?![\p{L}\p{N}_])"), F.lit(0))
    counts = found.select(F.explode(long_words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    common = [r.w for r in counts.orderBy(F.desc("n"), "w").limit(40).collect()]
    names = spark.createDataFrame([(a, b) for a, b in zip(common, [*common[1:], *common[:1]], strict=True)], "term string, alias string")
    second = F.get(F.array(*map(F.lit, common)), F.pmod(F.col("page_id"), F.lit(max(1, len(common)))).cast("int"))
    first = F.get(F.regexp_extract_all(F.coalesce("headline", F.lit("")), F.lit(r"\p{L}{4,}"), F.lit(0)), F.lit(0))
    return found.select("*", first.alias("term_a"), second.alias("term_b")), names, {w: common[i // 2 * 2] for i, w in enumerate(common) if i >= 24}


def text_article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles.article_links(*_named_articles(spark, sf_dir))
    return found.withColumns({f"snippets_{x}": F.array_join(f"snippets_{x}", " | ") for x in "ab"})


def text_term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, names, _ = _named_articles(spark, sf_dir)
    terms = named.withColumn("term", F.concat_ws(" ", "term_a", "term_b"))
    found = articles.term_mentions(terms, names)
    return found.withColumns({c: F.array_join(c, " | ") for c in ("matched", "snippets")})


QUERIES = {
    f.__name__: f
    for f in (
        text_paragraphs, text_sentence_counts, text_token_counts, text_tf_idf, text_verdicts, text_snippets,
        text_url_words, text_articles, text_article_links, text_term_mentions,
    )
}
ORACLES = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
