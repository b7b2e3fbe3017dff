"""Mentions and scored rewriting against plain Python."""

import random
import re

import pytest

from geolith.operators import questions

LABELS = ["Korea", "South Korea", "Guinea", "Papua New Guinea", "Guinea-Bissau", "NATION_1", "NATION_12", "US", "it", "New York State Of Mind"]


def plain_mentions(text, labels):
    """Every place of every label by a scan, then the longest first."""
    pieces = re.findall(r"\w+|[^\w]+", text)
    fold = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    found = []
    for at, piece in enumerate(pieces):
        if not re.match(r"\w", piece):
            continue
        for label in labels:
            n = 2 * len(fold(label).split()) - 1
            part = pieces[at : at + n]
            if len(part) < n or fold("".join(part)) != fold(label) or not all(re.fullmatch(r"\w+|[\s-]+", x) for x in part):
                continue
            if len(fold(label)) <= 3 and "".join(part) != "".join(part).upper():
                continue
            if at >= 2 and re.fullmatch(r"[\s-]+", pieces[at - 1]) and pieces[at - 2].lower() in questions.COMPASS:
                continue
            found.append((-n, -len(fold(label)), at, n, label))
    kept = []
    for _, _, at, n, label in sorted(found):
        if all(at + n <= a or a + m <= at for a, m, _ in kept):
            kept.append((at, n, label))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    words = ["korea", "SOUTH", "Guinea", "papua", "new", "Bissau", "nation_1", "NATION_12", "us", "US", "it", "IT", "west", "York", "state", "of", "mind"]
    asked = ["".join(rng.choice(words) + rng.choice([" ", " ", "-", ", ", "  "]) for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(asked)) + [(999, None)], "id int, text string")
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    found = {r.id: [tuple(h) for h in r.hits] for r in questions.mentions(df, labels, "id", "text").collect()}
    assert len(found) == 151 and found[999] == []
    for i, text in enumerate(asked):
        assert found[i] == plain_mentions(text, LABELS), text
    assert questions.mentions(df, labels.limit(0), "id", "text").where("size(hits) > 0").count() == 0


def test_steps_and_their_confidence(spark):
    aliases = spark.createDataFrame(
        [("Deutschland", "Germany", "endonym"), ("Beijing", "China", "capital"), ("PRC", "China", "abbreviation")], "label string, into string, kind string"
    )
    words = spark.createDataFrame([(w,) for w in "exports germany china what would happen forecast twenty five percent next year cuts trade".split()], "word string")
    asked = [
        "Forecast Deutschland  exprots next year", "What would happen if Beijing cuts trade by twenty five percent", "exports of PRC", None, "prc",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    found = {r.id: r for r in questions.rewritten(df, aliases, words, 2024).collect()}
    assert found[0].text == "Forecast Germany exports 2025"
    assert [(s.step, s.n) for s in found[0].steps] == [("aliases", 1), ("spelling", 1), ("numbers", 1)]
    assert found[0].confidence == pytest.approx(0.95 * 0.9 * 0.9)
    assert found[1].text == "shock: China cuts trade by 25 %"
    assert found[1].confidence == pytest.approx(0.9 * 0.95 * 0.9 * 0.8)
    assert found[2].text == "exports of China" and found[2].confidence == pytest.approx(0.9)
    assert found[3].text == "" and found[3].confidence == 1.0 and found[4].text == "prc"
