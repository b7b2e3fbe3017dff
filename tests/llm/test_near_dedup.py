import random

import corpus_pipeline
from geolith.llm import jaccard, simhash

from .helpers import DOCS, documents
from .test_dedup import roots


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def edited_texts(seed=3, bases=30):
    """Random texts with copies whose words are replaced at rates that give similarities around 0.8."""
    rng, texts = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 600))]
        texts.append(" ".join(words))
        for rate in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03):
            texts.append(" ".join(f"v{rng.randrange(5000)}" if rng.random() < rate else w for w in words))
    return texts


def test_stage_links_every_pair_that_brute_force_finds(spark, tmp_path):
    texts = [None, "", "one two", "One  TWO", "a b c d e", *edited_texts()]
    sets = [plain_shingles(t) for t in texts]
    near = [
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    assert len(near) > 60
    expected = {r for r in roots(range(len(sets)), near).values()}
    docs = documents(spark, texts, extra=True)
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == expected


def test_no_set_is_joined_that_is_less_than_near(spark):
    words = [f"w{i}" for i in range(104)]
    changed = [*words[:50], "x", *words[51:]]  # 5 of 100 shingles differ: 95 / 105
    more = [*words[:20], "x", *words[21:40], "y", *words[41:60], "z", *words[61:]]  # 15 of 100: 85 / 115
    docs = documents(spark, [" ".join(x) for x in (words, changed, more)])
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()) == [0, 2]


def test_null_and_repeated_ids_lose_no_text(spark, tmp_path):
    texts = [f"text number {i} has words of its own number {i * i} and {i + 7}" for i in range(12)]
    ids = [None] * 6 + [7] * 4 + [8, 9]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    again = [*rows, rows[0], rows[7], (5, texts[1], "en", "s", 1), (None, texts[11], "en", "s", 2)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(again, DOCS), str(tmp_path)).collect()
    assert sorted(r.text for r in out) == sorted(texts)
    found = {r.text: r.doc_id for r in out}
    assert found[texts[1]] == 5 and found[texts[11]] == 9 and found[texts[0]] is None


def test_simhash_groups_keep_rows_with_null_and_repeated_ids(spark):
    texts = [None, "one", "two words", "three words here", "some other words stand in this text", "and one more text than before"]
    rows = [(i, t, "en", "s", 1) for i, t in zip([None, None, 3, 3, None, 4], texts, strict=True)]
    out = simhash.drop_near_duplicates(spark.createDataFrame([*rows, rows[1], rows[2]], DOCS)).collect()
    assert sorted(map(str, (r.text for r in out))) == sorted(map(str, texts))


def test_a_passage_in_many_documents_costs_no_pair_and_no_link(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(300)]
    texts += [texts[i] + " tail" for i in range(0, 300, 30)]
    docs = documents(spark, texts)
    keys, counts = jaccard.frequent_shingles(docs)
    assert len(keys) >= 56 and sorted(counts)[-56] > 250
    assert set(keys.tolist()) >= set(jaccard.shingles(" ".join(passage)).tolist())
    some = jaccard.shingles(texts[0])
    first, rare = jaccard.prefix(some, keys, counts)
    assert 0.3 < rare < 0.5
    assert len(first) == len(some) // 5 + 1 and not set(first.tolist()) & set(jaccard.shingles(" ".join(passage)).tolist())
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()) == list(range(300))


def test_simhash_of_a_set_is_the_operators_bits(spark):
    some = jaccard.shingles("a b c d e f g h i j")
    bits = [sum(int(h) % 2**64 >> b & 1 for h in some) * 2 > len(some) for b in range(64)]
    assert jaccard.simhash(some) % 2**64 == sum(1 << b for b, x in enumerate(bits) if x)
