"""How articles name the two parties of an event, as column expressions over any number of articles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.session import small

# Where sentences end, and the limits of names, lists, snippets and prominence.
SENTENCE_END = r"(?<=[.!?])[\"'”’)]?\s+(?=[\"'“‘(]?[A-Z0-9])"
CODE_CHARACTERS = 3
LIST_PLACES = 4
SNIPPETS, SNIPPET_CHARACTERS = 2, 350
MENTION_SNIPPETS, MENTION_CHARACTERS = 3, 400
CENTRAL_MENTIONS = 3
WORD_CHARACTERS = 5
# What labels of parties hold that no name stands for.
GENERIC = ("unnamed", "unidentified", "unspecified", "unknown", "bloc actor", "an actor", "another party")

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def sentences(text: Column) -> Column:
    """Sentences of each line, without blanks at their ends; none of null text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_END, -1)))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def names_pattern(names: Column) -> Column:
    """One pattern for an array of names; null if there is none.

    Names stand between what is no letter, digit or underscore. Those of more
    than three characters are found in any case and with a plural s, shorter ones (codes)
    as they are written. At one place the longest name wins, and matches do not overlap.
    """

    def either(chosen: Column) -> Column:
        longest = F.array_sort(F.transform(chosen, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
        quoted = F.transform(longest, lambda y: F.regexp_replace(y["x"], r"([\\^$.|?*+(){}\[\]\-])", r"\\$1"))
        return F.when(F.size(chosen) > 0, F.array_join(quoted, "|"))

    known = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))
    long = either(F.filter(known, lambda x: F.length(x) > CODE_CHARACTERS))
    code = either(F.filter(known, lambda x: F.length(x) <= CODE_CHARACTERS))
    parts = F.array_compact(F.array(F.concat(F.lit("(?iu:(?:"), long, F.lit(")s?)")), F.concat(F.lit("(?:"), code, F.lit(")"))))
    return F.when(F.size(parts) > 0, F.concat(F.lit(f"{_BEFORE}(?:"), F.array_join(parts, "|"), F.lit(f"){_AFTER}")))


def _has(pattern: str):
    return lambda s: _found(s, F.col(pattern))


def _literal_pattern(names: Iterable[str]) -> str:
    """What :func:`names_pattern` says, for names known before the job."""
    longest = sorted(set(names) - {""}, key=lambda n: (-len(n), n))
    either = ["|".join(re.escape(n) for n in longest if (len(n) > CODE_CHARACTERS) == long) for long in (True, False)]
    parts = [head + x + tail for head, x, tail in zip(("(?iu:(?:", "(?:"), either, (")s?)", ")"), strict=True) if x]
    return f"{_BEFORE}(?:{'|'.join(parts)}){_AFTER}"


def generic_label(term: Column) -> Column:
    """A label such as "unnamed group", which no article can be searched for; null and blank ones too."""
    low = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    return (low == "") | F.rlike(low, F.lit("|".join(GENERIC)))


def _found(text: Column, pattern: Column) -> Column:
    """Like ``rlike``, but a pattern that comes from a column is compiled once for rows in which it stays the same."""
    return F.coalesce(F.regexp_instr(text, pattern) > 0, F.lit(False))


def capped(window: Column, core: Column, pattern: Column, most: int) -> Column:
    """``window`` if it has at most ``most`` characters, else its sentence ``core``, else the part of that round its first match."""
    ahead = F.length(F.coalesce(F.regexp_substr(core, F.concat(F.lit("(?s)^.*?(?="), pattern, F.lit(")"))), F.lit("")))
    end = F.least(F.length(core), F.greatest(ahead - most // 2, F.lit(0)) + most)
    start = F.greatest(end - most, F.lit(0))
    cut = F.regexp_replace(F.substring(core, start + 1, end - start), r"^\s+|\s+$", "")
    part = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(core), "…").otherwise(""))
    return F.when(F.length(window) <= most, window).when(F.length(core) <= most, core).otherwise(part)


def snippets(spoken: Column, hits: Column, pattern: Column, count: int, most: int) -> Column:
    """Up to ``count`` windows of a sentence that matches and its neighbours, none of which is shown twice.

    ``hits`` are the places of matching sentences, from 0, in order.
    """
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("shown"))

    def step(acc: Column, i: Column) -> Column:
        low = F.greatest(i - 1, acc["last"] + 1, F.lit(0))
        high = F.least(i + 1, F.size(spoken) - 1)
        window = F.array_join(F.slice(spoken, low + 1, high - low + 1), " ")
        text = capped(window, F.get(spoken, i), pattern, most)
        taken = F.struct(high.alias("last"), F.array_append(acc["shown"], text).alias("shown"))
        return F.when((i > acc["last"]) & (F.size(acc["shown"]) < count), taken).otherwise(acc)

    return F.aggregate(hits, start, step, lambda acc: acc["shown"])


def list_like(sentence: Column, places: Mapping[str, str]) -> Column:
    """A sentence that names four or more different places: a list, not an account of what its parties do.

    ``places`` maps names of places to the place; it is a dimension of some hundred names.
    """
    if not places:
        return F.lit(False)
    pattern = F.lit(_literal_pattern(places))
    table = F.create_map(*(F.lit(x) for name, place in sorted(places.items()) for x in (name.lower(), place)))

    def place(hit: Column) -> Column:
        said = F.lower(hit)
        return F.coalesce(F.element_at(table, said), F.element_at(table, F.substring(said, F.lit(1), F.length(said) - 1)), said)

    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(sentence, pattern, F.lit(0)), place))) >= LIST_PLACES


def _with_names(articles: DataFrame, term: str, aliases: DataFrame, into: str) -> DataFrame:
    """``articles`` with the pattern of all names of ``term``; codes among them are in capitals, generic labels have null."""
    upper = F.when((F.length("alias") <= CODE_CHARACTERS) & F.rlike("alias", F.lit(r"^[\p{L} ]+$")), F.upper("alias"))
    known = aliases.groupBy(F.lower(F.trim("term")).alias("__term")).agg(
        F.collect_set(F.coalesce(upper, F.trim("alias"))).alias("__names")
    )
    own = F.trim(F.coalesce(F.col(term), F.lit("")))
    code = (F.length(own) <= CODE_CHARACTERS) & F.rlike(own, F.lit(r"^[\p{L} ]+$"))
    names = F.concat(F.array(F.when(code, F.upper(own)).otherwise(own)), F.coalesce("__names", F.array().cast("array<string>")))
    joined = articles.join(small(known), F.lower(own) == F.col("__term"), "left")
    return joined.withColumn(into, F.when(~generic_label(F.col(term)), names_pattern(names))).drop("__term", "__names")


def article_links(articles: DataFrame, aliases: DataFrame, places: Mapping[str, str], key: str = "page_id") -> DataFrame:
    """How each article links the two parties that an event gives it.

    ``articles`` has ``key``, text (paragraphs on lines), headline, term_a, term_b; ``aliases`` has (term, alias), further
    names of a term (some dozen each). Gives per row, for a and b: count, in_headline, in_first (paragraph), prominence (central:
    in the headline or named three times, passing, absent, n/a for generic labels), snippets; then n_both
    (sentences with both), best_snippet and link:

    together: a sentence that is no list names both; listed: both are named, but not so; one_sided, none: one or neither
    is named; unavailable: no text, or labels that no name can tell. Equal terms are one party. Null or blank terms are
    labels of that kind; repeated rows stay; an empty table gives none. Whole texts are read.
    """
    named = _with_names(_with_names(articles, "term_a", aliases, "__a"), "term_b", aliases, "__b")
    same = F.lower(F.trim("term_a")).eqNullSafe(F.lower(F.trim("term_b")))
    text, head = F.coalesce("text", F.lit("")), F.coalesce("headline", F.lit(""))
    cut = named.select(
        F.col(key), "term_a", "term_b", "__a", "__b", text.alias("__text"), head.alias("__head"), same.alias("__same"),
        sentences(F.col("text")).alias("__s"),
    )
    told = F.transform(
        "__s",
        lambda s: F.struct(_found(s, F.col("__a")).alias("a"), (_found(s, F.col("__b")) & ~F.col("__same")).alias("b")),
    )
    flags = cut.withColumn("__told", told)
    # Only sentences that name a party are asked whether they are lists.
    listed = F.zip_with(
        "__s", "__told", lambda s, t: F.when(t["a"] | t["b"], F.coalesce(list_like(s, places), F.lit(False))).otherwise(False)
    )
    matches = {f"__count_{x}": F.size(F.regexp_extract_all("__text", F.col(f"__{x}"), F.lit(0))) for x in "ab"}
    flags = flags.withColumns({"__list": listed} | {k: F.coalesce(F.greatest(v, F.lit(0)), F.lit(0)) for k, v in matches.items()})
    at = F.when(F.size("__s") > 0, F.sequence(F.lit(0), F.size("__s") - 1)).otherwise(F.array().cast("array<int>"))

    def party(side: str) -> dict[str, Column]:
        pattern = F.col(f"__{side}")
        hits = F.filter(at, lambda i: F.get(F.col("__told"), i)[side])
        count = F.col(f"__count_{side}")
        heard = _found(F.col("__head"), pattern)
        prominence = (
            F.when(pattern.isNull(), "n/a")
            .when(heard | (count >= CENTRAL_MENTIONS), "central")
            .when(count > 0, "passing")
            .otherwise("absent")
        )
        shown = snippets(F.col("__s"), hits, pattern, SNIPPETS, SNIPPET_CHARACTERS)
        first = _found(F.substring_index("__text", "\n", 1), pattern)
        found = {"count": count, "in_headline": heard, "in_first": first, "prominence": prominence, "snippets": shown}
        if side == "b":
            none = {"count": F.lit(0), "in_headline": F.lit(False), "in_first": F.lit(False), "prominence": F.lit("n/a")}
            none["snippets"] = F.array().cast("array<string>")
            found = {k: F.when(F.col("__same"), none[k]).otherwise(v) for k, v in found.items()}
        return {f"{k}_{side}": v for k, v in found.items()}

    out = flags.withColumns(party("a") | party("b"))
    rank = F.transform(
        at,
        lambda i: F.struct(
            _rank(F.get(F.col("__told"), i)["a"], F.get(F.col("__told"), i)["b"], F.get(F.col("__list"), i)).alias("rank"),
            i.alias("i"),
        ),
    )
    best = F.array_min(F.filter(rank, lambda r: r["rank"].isNotNull()))
    core = F.get("__s", F.col("__best.i"))
    lead = F.when(F.get("__told", F.col("__best.i"))["a"], F.col("__a")).otherwise(F.col("__b"))
    both = F.size(F.filter("__told", lambda t: t["a"] & t["b"]))
    direct = F.exists(F.zip_with("__told", "__list", lambda t, x: t["a"] & (t["b"] | F.col("__same")) & ~x), lambda x: x)
    a, b = F.col("count_a") > 0, F.col("count_b") > 0
    no_a, no_b = F.col("__a").isNull(), F.col("__b").isNull()
    told_apart = F.when(direct, "together").otherwise("listed")
    link = (
        F.when((F.trim("__text") == "") | (no_a & no_b), "unavailable")
        .when(F.col("__same"), F.when(~a, "none").otherwise(told_apart))
        .when(no_a | no_b, F.when(~(a | b), "none").otherwise("unavailable"))
        .when(~a & ~b, "none")
        .when(a & b, told_apart)
        .otherwise("one_sided")
    )
    named_columns = [f"{k}_{side}" for side in "ab" for k in ("count", "in_headline", "in_first", "prominence", "snippets")]
    return out.withColumn("__best", best).select(
        key, "term_a", "term_b", *named_columns, both.alias("n_both"),
        F.coalesce(capped(core, core, lead, SNIPPET_CHARACTERS), F.lit("")).alias("best_snippet"), link.alias("link"),
    )


def _rank(a: Column, b: Column, listed: Column) -> Column:
    """How well a sentence shows the parties: no lists first, both before the first before the second; null for neither."""
    plain = F.when(a & b, 0).when(a, 1).when(b, 2)
    return F.when(~listed, plain).otherwise(F.when(a, 3).when(b, 4))


def term_mentions(articles: DataFrame, aliases: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, term, tier, confidence, matched, snippets): where an article names ``term``.

    First the whole term or an alias of it (tier ``full``, confidence 1); in an article without these, the
    term's own words of five or more letters (tier ``words``, confidence the share of them that is found). ``matched``
    has each spelling found once, whatever its case, in order. Other articles have null tier, 0 and empty arrays.
    """
    named = _with_names(articles, "term", aliases, "__full")
    words = F.filter(F.split(F.trim("term"), r"\s+"), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")) >= WORD_CHARACTERS)
    several = F.size(F.split(F.trim("term"), r"\s+")) > 1
    cut = named.select(
        key, "term", "__full", F.coalesce("text", F.lit("")).alias("__text"), sentences(F.col("text")).alias("__s"),
        F.when(several & F.col("__full").isNotNull(), words).otherwise(F.array().cast("array<string>")).alias("__words"),
    )
    in_full, in_words = (F.exists("__s", _has(p)) for p in ("__full", "__any"))
    tiers = cut.withColumn("__any", names_pattern(F.col("__words"))).withColumn("tier", F.when(in_full, "full").when(in_words, "words"))
    tiers = tiers.withColumn("__p", F.when(F.col("tier") == "full", F.col("__full")).when(F.col("tier") == "words", F.col("__any")))
    at = F.when(F.size("__s") > 0, F.sequence(F.lit(0), F.size("__s") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(at, lambda i: _found(F.get(F.col("__s"), i), F.col("__p")))
    said = F.flatten(F.transform("__s", lambda s: F.regexp_extract_all(s, F.col("__p"), F.lit(0))))
    lowered = F.transform(said, lambda x: F.lower(x))
    once = F.transform(F.array_distinct(lowered), lambda x: F.get(said, F.array_position(lowered, x).cast("int") - 1))
    heard = F.filter("__words", lambda w: _found(F.col("__text"), names_pattern(F.array(w))))
    none = F.array().cast("array<string>")
    return tiers.select(
        key, "term", "tier",
        F.when(F.col("tier") == "full", 1.0).when(F.col("tier") == "words", F.size(heard) / F.size("__words")).otherwise(0.0).alias("confidence"),
        F.when(F.col("tier").isNull(), none).otherwise(once).alias("matched"),
        F.when(F.col("tier").isNull(), none).otherwise(
            snippets(F.col("__s"), hits, F.col("__p"), MENTION_SNIPPETS, MENTION_CHARACTERS)
        ).alias("snippets"),
    )
