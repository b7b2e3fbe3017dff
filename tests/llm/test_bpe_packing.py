import bisect
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geolith.llm.bpe import ByteBpe, Generations, encode, op4_bpe
from geolith.llm.packing import Capacities, Encoder, best_fit_decreasing, op7_packing, pack

from .helpers import as_table, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "".join(random.Random(3).choice("ab c\nd") for _ in range(60_000))
TEXTS = [
    None, "", " ", "\n\n  x  \n", "Hello, world! It's fine.", "a<|endoftext|>b <|endoftext|>", "ÄÖ ñandú 東京 😀😀",
    "x" * 5000, "aaaa" * 300, "1234567 89", "\x1c\x1d \x85 z", "word " * 3000, LONG, "Hello, world! It's fine.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return ByteBpe(PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library(spark, tmp_path, library):
    folder = as_table(documents(spark, TEXTS, extra=True), tmp_path)
    rows = {r.doc_id: r for r in op4_bpe(spark, folder).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == digest(",".join(map(str, ids)))
        assert rows[i].decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library_and_comes_back(text):
    own, library = _models()
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


_KEPT = []


def _models():
    if not _KEPT:
        _KEPT.extend([ByteBpe(PATH), Tokenizer.from_file(PATH)])
    return _KEPT


MILLIONS = [" " * 2_000_000, "\n" * 2_000_000, "x" * 2_000_000, " " * 1_000_000 + "word", "\n \t" * 300_000]


def test_very_long_runs_equal_the_library(model, library):
    for text in MILLIONS:
        assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_quick_and_exact_encoder_agree(model, library):
    encoder = Encoder(PATH)
    assert encoder.quick is not None and model.ids_are_ranks
    rng = random.Random(8)
    texts = [*MILLIONS, " " * 19_999, " " * 19_999 + "x", "\n" * 20_000, "a" * 300_000, "é" * 100_000, "7" * 300_000, "!" * 300_000]
    texts += ["".join(rng.choice(["the", " ", "  ", "\n", "é", "東", "12", "'s", "qz", "<|endoftext|>", "\x85"]) for _ in range(50)) for _ in range(500)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_whose_ids_are_no_ranks_goes_to_the_exact_encoder(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    first, last = ("".join(merges[i].split(" ") if isinstance(merges[i], str) else merges[i]) for i in (5, 900))
    vocab[first], vocab[last] = vocab[last], vocab[first]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(spec))
    encoder, other = Encoder(str(path)), Tokenizer.from_file(str(path))
    assert encoder.quick is None
    for text in TEXTS:
        assert encoder.encode(text or "").tolist() == other.encode(text or "", add_special_tokens=False).ids


def test_caches_are_bounded_by_bytes():
    made = []
    kept = Generations(lambda k: made.append(k) or k.encode(), 1000)
    for k in ["a", "b", "a", *map(str, range(20)), "x" * 500]:
        assert kept[k] == k.encode()
        assert kept.held <= 1000 and "x" * 500 not in kept
    assert len(kept) + len(kept.elder) <= 10 and made.count("a") == 1


def test_every_prefix_has_one_last_token(model, library):
    word = " internationalization"
    for n in range(1, len(word) + 1):
        assert model.encode_piece(word[:n].encode()) == library.encode(word[:n], add_special_tokens=False).ids


def test_empty_table(spark):
    assert encode(documents(spark, ["x"]).limit(0), PATH).count() == 0


def plain_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity
        if room > n:
            bisect.insort(rooms, room - n)
    return bins


def test_segment_tree_finds_the_tightest():
    tree, present = Capacities(100), set()
    rng = random.Random(5)
    for _ in range(2000):
        c = rng.randrange(101)
        present ^= {c}
        tree.set(c, c in present)
        n = rng.randrange(1, 101)
        assert tree.tightest(n) == min((x for x in present if x >= n), default=None)


def test_classes_of_bins_use_as_many_bins_as_single_ones():
    rng = random.Random(7)
    for capacity in (10, 64, 2048):
        for _ in range(30):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            plan = best_fit_decreasing(counts, capacity)
            assert (plan["bins"] * plan["per_bin"]).sum() == len(lengths)
            used = {b for r in plan.itertuples() for b in range(r.first_bin, r.first_bin + r.bins)}
            assert len(used) == plain_best_fit(lengths, capacity)


def test_packing_query(spark, tmp_path, library):
    folder = as_table(documents(spark, TEXTS), tmp_path)
    rows = op7_packing(spark, folder).toPandas()
    for doc_id, pieces in rows.groupby("doc_id"):
        ids = [*library.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids, 0]
        pieces = pieces.sort_values("piece")
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum()[:-1]]
        assert pieces["length"].sum() == len(ids)
        assert (pieces["length"].to_numpy()[1:] == 2048).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert rows["doc_id"].nunique() == len(TEXTS)
    for _, inside in rows.sort_values("offset").groupby("sequence_id"):
        assert inside["offset"].tolist() == [0, *inside["length"].cumsum()[:-1]]
        assert inside["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() == plain_best_fit(rows["length"].tolist(), 2048)


def test_packing_very_long_runs(spark, tmp_path, library):
    texts = [*MILLIONS[:2], "x" * 200_000]
    rows = op7_packing(spark, as_table(documents(spark, texts), tmp_path)).toPandas()
    for doc_id, pieces in rows.groupby("doc_id"):
        assert pieces["length"].sum() == len(library.encode(texts[doc_id], add_special_tokens=False).ids) + 1


def test_packing_replaces_columns_of_the_added_names(spark):
    pieces = spark.createDataFrame([(1, 0, 5, "x", "y")], "doc_id long, piece int, length long, sequence_id string, offset string")
    assert pack(pieces, 16).select("sequence_id", "offset").collect() == [(0, 0)]


def test_packing_repeated_and_no_rows(spark):
    pieces = spark.createDataFrame([(1, 0, 5)] * 9 + [(None, 0, 7)], "doc_id long, piece int, length long")
    rows = pack(pieces, 16).toPandas()
    assert len(rows) == 10 and rows.groupby("sequence_id")["length"].sum().max() <= 16
    assert pack(pieces.limit(0), 16).count() == 0


def test_time_grows_with_the_text_whatever_its_blanks():
    import time

    import public_tokenizers

    from geolith.llm.packing import LONG_RUN, Encoder

    model = Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    def took(text):
        began = time.process_time()
        assert model.encode(text).tolist() == model.exact.encode(text).tolist()
        return time.process_time() - began

    for run in (LONG_RUN - 1, LONG_RUN, 19_999):
        text = (" " * run + "x") * (200_000 // run)
        took(text)
        assert took(text * 4) < 8 * max(took(text), 0.05)
