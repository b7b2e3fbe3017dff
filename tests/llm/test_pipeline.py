import corpus_pipeline
from geolith.llm import langid, secrets
from geolith.llm.common import table
from tokenizers import Tokenizer
import public_tokenizers

from .test_dedup import roots
from .test_near_dedup import plain_shingles


def test_every_stage_keeps_the_columns_and_works_on_what_is_left(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] < counts[2] and counts[4] == counts[3]


def test_run_equals_the_steps_in_plain_python(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").toPandas()
    model = langid.train(table(spark, sf_dir, "documents"))
    judged = model.predict(rows["text"].tolist())
    texts = {d: t for d, t, (lang, share, _, _) in zip(rows["doc_id"], rows["text"], judged, strict=True) if lang != "und" and share >= langid.MIN_SHARE}
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for d, t in texts.items():
        for line in t.split("\n"):
            key = line.strip(strip).translate(lower)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    texts = {
        d: "\n".join(x for x in t.split("\n") if d >= gone.get(x.strip(strip).translate(lower), d)) for d, t in texts.items()
    }
    order = sorted(texts)
    sets = {d: plain_shingles(texts[d]) for d in order}
    linked = [
        (a, b) for i, a in enumerate(order) for b in order[i + 1 :]
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    kept = {d: texts[d] for d, root in roots(order, linked).items() if d == root}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(found["doc_id"]) == set(kept)
    sizes = found.groupby("doc_id")["length"].sum()
    same = [d for d, t in kept.items() if not list(secrets.candidates(t))]
    assert len(same) > 100
    assert all(sizes[d] == len(library.encode(kept[d], add_special_tokens=False).ids) + 1 for d in same)
    inside = found.sort_values("offset").groupby("sequence_id")["length"].agg(["sum"])
    assert inside["sum"].max() <= 2048
