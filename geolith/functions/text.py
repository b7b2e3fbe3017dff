"""Text functions: cleaning, sentences, terms, articles, edit distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.session import bounded_batches

MIN_PARAGRAPH_CHARS, MIN_ARTICLE_CHARS = 40, 500


def normalize_key(text: Column) -> Column:
    """Lower-case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_markdown(text: Column) -> Column:
    """Text without headings, emphasis, code marks, links' targets, list marks and rules."""
    for pattern, into in (
        (r"```[\s\S]*?```", " "),
        (r"`([^`]*)`", "$1"),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s*", ""),
        (r"(?m)^\s*([-*_]\s*){3,}$", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(\*\*|__)(.*?)\1", "$2"),
        (r"(\*|_)(\S.*?)\1", "$2"),
        (r"[ \t]+", " "),
    ):
        text = F.regexp_replace(text, pattern, into)
    return F.trim(text)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; text that is no such case stays."""
    only_latin1 = ~F.rlike(text, F.lit(r"[^\x00-\xFF]"))
    bytes_ = F.encode(F.when(only_latin1, text), "ISO-8859-1")
    valid = F.call_function("is_valid_utf8", bytes_.cast("string"))
    again = F.when(valid, F.decode(bytes_, "UTF-8"))
    return F.coalesce(again, text)


def tokens(text: Column, min_chars: int = 3) -> Column:
    """Lower-case alphanumeric words of at least ``min_chars`` characters."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(words, lambda w: F.length(w) >= min_chars)


def sentences(text: Column) -> Column:
    """Sentences: split after . ! or ? before white space and a capital, digit or quote."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}0-9\"'“])", -1)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def term_pattern(terms: list[str]) -> str:
    """One pattern for whole terms: long ones in any case with an optional plural, short ones as written."""

    def quoted(t: str) -> str:
        return "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"

    long = "|".join(quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t)) if len(t) > 3)
    short = "|".join(quoted(t) for t in sorted(terms) if len(t) <= 3)
    parts = [f"(?i:(?:{long})s?)"] if long else []
    parts += [f"(?:{short})"] if short else []
    return rf"(?<!\w)(?:{'|'.join(parts)})(?!\w)" if parts else r"(?!)"


def mentions(text: Column, terms: list[str]) -> Column:
    return F.regexp_extract_all(text, F.lit(term_pattern(terms)), F.lit(0))


def list_like(sentence: Column, places: list[str]) -> Column:
    """A sentence that names four or more different places."""
    return F.size(F.array_distinct(mentions(sentence, places))) >= 4


def term_snippets(df: DataFrame, key: str, text: str, terms: list[str], most: int = 3, width: int = 240) -> DataFrame:
    """Up to ``most`` sentences per row that have a term, each with its neighbours, cut to ``width`` characters.

    Only texts that have a term are cut into sentences, once each: the lambdas see the cut sentences, so that time is in
    proportion to the text however filters and columns are merged.
    """
    has_term = F.lit(term_pattern(terms))

    def snippets(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.rlike(F.get(s, i), has_term))
        return F.transform(
            F.slice(at, 1, most),
            lambda i: F.substring(
                F.array_join(F.slice(s, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "), 1, width
            ),
        )

    cut = F.transform(F.array(sentences(F.col(text))), lambda s: F.when(F.size(s) > 0, snippets(s)))
    found = df.where(F.rlike(F.col(text), has_term)).select(key, F.explode(cut).alias("snippets"))
    return found.where(F.size("snippets") > 0).select(key, "snippets", F.size("snippets").alias("n"))


def verdict(df: DataFrame, key: str, text: str, a: list[str], b: list[str], places: list[str]) -> DataFrame:
    """How an article links two parties.

    together: one sentence, not a mere list, names both; listed: only list-like ones do; one_sided:
    one party occurs; none; unavailable without text.
    """
    per = df.select(key, F.col(text).isNull().alias("missing"), F.explode_outer(sentences(F.col(text))).alias("s"))
    has_a, has_b = (F.coalesce(F.rlike("s", F.lit(term_pattern(t))), F.lit(False)) for t in (a, b))
    listed = F.coalesce(list_like(F.col("s"), places), F.lit(False))
    flags = per.groupBy(key).agg(
        F.bool_or("missing").alias("missing"),
        F.bool_or(has_a & has_b & ~listed).alias("both"),
        F.bool_or(has_a & has_b & listed).alias("listed"),
        F.bool_or(has_a).alias("a"),
        F.bool_or(has_b).alias("b"),
    )
    label = (
        F.when(F.col("missing"), "unavailable")
        .when(F.col("both"), "together")
        .when(F.col("listed"), "listed")
        .when(F.col("a") | F.col("b"), "one_sided")
        .otherwise("none")
    )
    return flags.select(key, label.alias("verdict"))


def slug_words(url: Column) -> Column:
    """Words of a URL's last long path segment."""
    segments = F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/")
    slug = F.regexp_replace(
        F.element_at(F.concat(F.array(F.lit("")), F.filter(segments, lambda s: F.length(s) > 8)), -1), r"\.\w+$", ""
    )
    return F.filter(F.split(F.lower(slug), "[^a-z]+"), lambda w: F.length(w) >= 3)


def safe_url(url: Column) -> Column:
    """A public http(s) address: no local or private host."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    private = F.rlike(
        host, F.lit(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[?::1|\[?f[cd])")
    )
    known = F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
    return F.coalesce(known & host.isNotNull() & ~private, F.lit(False))


def tf_idf(df: DataFrame, key: str, text: str, vocabulary: int = 300) -> DataFrame:
    """Long TF-IDF vectors of unit length over the words of highest document frequency.

    idf = ln((1 + N) / (1 + df)) + 1. Counts are aggregated before every
    shuffle; the vocabulary has a fixed size and is broadcast.
    """
    words = df.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("docs"))
    kept = words.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(vocabulary)
    idf = kept.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = words.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return weights.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def osa_distance(a: str, b: str, limit: int = 2) -> int:
    """Edits with neighbouring swaps between two short words; limit + 1 if they are farther apart."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, old = old, row
    return min(old[-1], limit + 1)


def fold(text: str) -> str:
    """Lower-case text without accents."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower().strip()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


class _Paragraphs(HTMLParser):
    """Texts of <p> elements, those inside article or main apart; page furniture is left out."""

    SKIP = ("nav", "script", "style", "footer", "header", "aside", "form", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.depth, self.parts = 0, 0, 0, []
        self.all: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.inside += tag in ("article", "main")
        if tag == "p":
            self._close()
            self.depth = 1

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag == "p":
            self._close()
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)

    def _close(self):
        if self.depth:
            self.all.append((" ".join("".join(self.parts).split()), bool(self.inside)))
        self.depth, self.parts = 0, []

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def paragraphs(html: str | None) -> list[str]:
    """An article's paragraphs of at least 40 characters, in order, none twice.

    Those inside article or main, unless they are under 500 characters in all.
    """
    parser = _Paragraphs()
    parser.feed(html or "")
    parser._close()
    long = [(t, inside) for t, inside in parser.all if len(t) >= MIN_PARAGRAPH_CHARS]
    chosen = [t for t, inside in long if inside]
    if sum(map(len, chosen)) < MIN_ARTICLE_CHARS:
        chosen = [t for t, _ in long]
    return list(dict.fromkeys(chosen))


def article_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, paragraph_no, paragraph) of raw pages; parsing runs on small Arrow batches."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, p) for i, h in zip(batch["page_id"], batch["html"], strict=True) for n, p in enumerate(paragraphs(h))]
            yield pd.DataFrame(rows, columns=["page_id", "paragraph_no", "paragraph"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, paragraph_no int, paragraph string")


# Words of pages that show no article without scripts or consent.
PLACEHOLDERS = (
    "javascript is disabled", "javascript is required", "please enable javascript", "enable javascript", "enable cookies",
    "checking your browser", "just a moment", "are you a human", "verify you are human", "access denied", "page not found",
    "404 not found", "attention required",
)
TITLE_ORDER = ("og:title", "twitter:title", "h1", "title-meta", "title")
BODY_PARAGRAPHS, BODY_CHARS, MIN_BODY_PARAGRAPH = 6, 1200, 60


class _Titles(HTMLParser):
    """The first text of each kind of title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.open: str | None = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "meta" and named.get("content"):
            kind = named.get("property") or named.get("name") or ""
            self.found.setdefault("title-meta" if kind == "title" else kind, named["content"].strip())
        elif tag in ("h1", "title") and tag not in self.found:
            self.open, self.found[tag] = tag, ""

    def handle_endtag(self, tag):
        if tag == self.open:
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.found[self.open] += data


def headline(html: str | None) -> str | None:
    """A page's headline without the site's name: the first title in order that reads like one."""
    parser = _Titles()
    parser.feed(html or "")
    titles = (" ".join(parser.found.get(k, "").split()) for k in TITLE_ORDER)
    chosen = next((t for t in titles if len(t) > 20 and " " in t), None)
    for mark in (" | ", " - ", " – ", " — ", " · "):
        if chosen and mark in chosen:
            chosen = max(chosen.split(mark), key=len).strip()
    return chosen


def article(html: str | None) -> tuple[str | None, str, bool]:
    """Headline, the first six long paragraphs (1,200 characters at most), and if the page is a mere placeholder."""
    title = headline(html)
    body = " ".join([p for p in paragraphs(html) if len(p) > MIN_BODY_PARAGRAPH][:BODY_PARAGRAPHS])
    body = body[:BODY_CHARS] + "…" if len(body) > BODY_CHARS else body
    said = f"{title or ''} {body}".lower()
    return title, body, len(body) < 200 and any(m in said for m in PLACEHOLDERS)


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, domain, headline, body, placeholder) of raw pages."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, u, *article(h)) for i, u, h in zip(batch["page_id"], batch["url"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "headline", "body", "placeholder"])

    found = pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id long, url string, headline string, body string, placeholder boolean"
    )
    domain = F.regexp_replace(F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")), "^www[.]", "")
    return found.select("page_id", domain.alias("domain"), "headline", "body", "placeholder")


def article_texts(pages: DataFrame) -> DataFrame:
    """(page_id, headline, text) of raw pages: all paragraphs, each on its line; null text where there is none."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, headline(h), "\n".join(paragraphs(h)) or None) for i, h in zip(batch["page_id"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "headline", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, headline string, text string")
