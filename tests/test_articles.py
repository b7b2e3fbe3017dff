"""Article linking against plain Python on written cases and on all pages."""

import regex

from geolith.operators import articles
from geolith.plans import text as plans

ENDS = regex.compile(articles.SENTENCE_END)


def spoken(text):
    return [s.strip() for line in (text or "").split("\n") for s in ENDS.split(line) if s.strip()]


class Names:
    """Matches of names, one at a time: the longest at each place, none over another."""

    def __init__(self, names):
        names = {n.upper() if len(n) <= 3 and n.replace(" ", "").isalpha() else n for n in names if n}
        self.long = sorted((n for n in names if len(n) > 3), key=lambda n: -len(n))
        self.code = sorted(n for n in names if len(n) <= 3)

    def at(self, text, i):
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            return None
        for names, fold in ((self.long, True), (self.code, False)):
            for n in names:
                for end in ([i + len(n) + 1, i + len(n)] if fold else [i + len(n)]):
                    said = text[i:end]
                    if len(said) < end - i or end < len(text) and (text[end].isalnum() or text[end] == "_"):
                        continue
                    wanted = n + "s" if end - i > len(n) else n
                    if said == wanted or fold and said.lower() == wanted.lower():
                        return end
        return None

    def spans(self, text):
        i, out = 0, []
        while i < len(text):
            end = self.at(text, i)
            if end:
                out.append((i, end))
            i = end or i + 1
        return out

    def hits(self, text):
        return [text[a:b] for a, b in self.spans(text)]


def cap(window, core, names, most):
    if len(window) <= most:
        return window
    if len(core) <= most:
        return core
    end = min(len(core), max(0, names.spans(core)[0][0] - most // 2) + most)
    start = max(0, end - most)
    return ("…" if start else "") + core[start:end].strip() + ("…" if end < len(core) else "")


def shown(said, names, count, most):
    out, last = [], -1
    for i, s in enumerate(said):
        if len(out) < count and i > last and names.hits(s):
            low, high = max(0, i - 1, last + 1), min(len(said) - 1, i + 1)
            out.append(cap(" ".join(said[low : high + 1]), s, names, most))
            last = high
    return out


def is_list(s, places):
    known = {k.lower(): v for k, v in places.items()}
    found = {known.get(h.lower()) or known.get(h.lower()[:-1]) or h.lower() for h in Names(places).hits(s)}
    return len(found) >= 4


def generic(term):
    return not (term or "").strip() or any(g in term.lower() for g in articles.GENERIC)


def linked(text, headline, a, b, aliases, places):
    same = (a or "").strip().lower() == (b or "").strip().lower()
    names = [None if generic(t) else Names([t.strip(), *aliases.get(t.strip().lower(), [])]) for t in (a, b)]
    said, parties = spoken(text), []
    for n in names[: 1 if same else 2]:
        count = len(n.hits(text or "")) if n else 0
        head = bool(n and n.hits(headline or ""))
        rank = "n/a" if not n else "central" if head or count >= 3 else "passing" if count else "absent"
        parties.append((count, head, bool(n and n.hits((text or "").split("\n")[0])), rank, shown(said, n, 2, 350) if n else []))
    parties += [(0, False, False, "n/a", [])] * (2 - len(parties))
    flags = [(bool(names[0] and names[0].hits(s)), bool(not same and names[1] and names[1].hits(s)), is_list(s, places)) for s in said]
    direct = any(x and (y or same) and not z for x, y, z in flags)
    ranked = [(0 if x and y and not z else 1 if x and not z else 2 if y and not z else 3 if x else 4, i) for i, (x, y, z) in enumerate(flags) if x or y]
    best = ""
    if ranked:
        i = min(ranked)[1]
        best = cap(said[i], said[i], names[0] if flags[i][0] else names[1], 350)
    n_a, n_b = parties[0][0], parties[1][0]
    if not (text or "").strip() or not names[0] and not names[1]:
        link = "unavailable"
    elif same:
        link = "none" if not n_a else "together" if direct else "listed"
    elif not names[0] or not names[1]:
        link = "unavailable" if n_a or n_b else "none"
    else:
        link = "none" if not n_a and not n_b else "one_sided" if not n_a or not n_b else "together" if direct else "listed"
    return (*parties[0], *parties[1], sum(x and y for x, y, _ in flags), best, link)


def check(spark, rows, aliases, places):
    """``rows``: (page_id, text, headline, term_a, term_b), each page once."""
    df = spark.createDataFrame(rows, "page_id long, text string, headline string, term_a string, term_b string")
    table = spark.createDataFrame([(t, a) for t, names in aliases.items() for a in names], "term string, alias string")
    found = {r.page_id: tuple(r)[3:] for r in articles.article_links(df, table, places).collect()}
    assert len(found) == len(rows)
    for i, text, headline, a, b in rows:
        expected = linked(text, headline, a, b, aliases, places)
        assert found[i] == expected, (i, found[i], expected)
    return {i: f[-1] for i, f in found.items()}


PLACES = {n: n for n in ("China", "India", "Peru", "Chad", "Mexico")} | {"Indian": "India"}


def test_links_of_written_cases(spark):
    aliases = {"united states": ["US", "U.S.", "America"], "india": ["Indian", "in"]}
    long = "x " * 300 + "China spoke to an Indian envoy " + "y " * 300
    cases = [
        ("China met India.", "A headline", "China", "India", "together"),
        ("Talks in China, India, Peru and Chad.", "", "China", "India", "listed"),
        ("China spoke. Later India spoke.", None, "China", "India", "listed"),
        ("China spoke. The us of it, and UNITED STATESMEN.", None, "China", "United States", "one_sided"),
        ("The US and U.S. troops. Americas. Chinas too.", "US news", "united states", "China", "listed"),
        ("Nothing here.", None, "China", "India", "none"),
        ("China met someone.", None, "China", "Unnamed group", "unavailable"),
        ("Nobody met someone.", None, "China", "an actor", "none"),
        (None, "China", "China", "India", "unavailable"),
        ("", "China", "China", "India", "unavailable"),
        ("China.", None, None, " ", "unavailable"),
        ("China stands. Peru. Chad. India.", None, "China", " china ", "together"),
        ("Chad, China, Indians, Indian, Peru and Mexico.", None, "china", "China", "listed"),
        (long, None, "China", "India", "together"),
        ("One. Two China. Three. Four. Five China. Six. Seven China. " * 3, "China", "China", "Peru (a.b)", "one_sided"),
        ("A\nB China 😀.\nIndia \"quoted.\" China (India) [India].", "x", "China", "India", "together"),
    ]
    rows = [(i, *c[:4]) for i, c in enumerate(cases)]
    assert list(check(spark, rows, aliases, PLACES).values()) == [c[4] for c in cases]
    check(spark, rows[:3], {}, {})


def test_links_of_no_articles_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "China.", None, "China", "India", 3)], "page_id long, text string, headline string, term_a string, term_b string, alias int")
    names = spark.createDataFrame([], "term string, alias string")
    assert articles.article_links(df, names, PLACES).first().link == "one_sided"
    assert articles.article_links(df.limit(0), names, PLACES).count() == 0
    assert articles.article_links(df.union(df), names, PLACES).count() == 2


def test_links_of_all_pages(spark, sf_dir):
    named, names, places = plans._named_articles(spark, sf_dir)
    aliases = {}
    for r in names.collect():
        aliases.setdefault(r.term, []).append(r.alias)
    rows = [tuple(r) for r in named.select("page_id", "text", "headline", "term_a", "term_b").collect()]
    kinds = check(spark, rows, aliases, places)
    assert set(kinds.values()) >= {"together", "listed"}


def test_mentions_by_tier(spark):
    rows = [
        (1, "The Workers Union met. Others met.", "Workers Union"),
        (2, "The workers met. WORKERS stayed. The union did not.", "Workers Union"),
        (3, "Nobody met.", "Workers Union"),
        (4, "Some striking people and Labour.", "Workers Union"),
        (5, "Workers only.", "Workers Congress"),
        (6, None, "China"),
        (7, "Text.", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, text string, term string")
    names = spark.createDataFrame([("workers union", "Labour")], "term string, alias string")
    found = {r.page_id: (r.tier, r.confidence, r.matched, len(r.snippets)) for r in articles.term_mentions(df, names).collect()}
    assert found == {
        1: ("full", 1.0, ["Workers Union"], 1),
        2: ("words", 1.0, ["workers", "union"], 2),
        3: (None, 0.0, [], 0),
        4: ("full", 1.0, ["Labour"], 1),
        5: ("words", 0.5, ["Workers"], 1),
        6: (None, 0.0, [], 0),
        7: (None, 0.0, [], 0),
    }
