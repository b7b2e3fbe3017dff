"""Operator 4: byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can stand last in
its encoding: the one whose pair with the last token of what comes before it
survives merging. An Aho-Corasick automaton over the vocabulary (its suffix
matches) proposes the tokens that end at each place; the pair test picks the
one that holds; back-pointers then give the ids.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

# Fixed value: how byte-level vocabularies of this family cut text into pieces.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that each of a cache's two generations may hold, in each Python worker.
CACHE_BYTES = 80 << 20
#: What an entry takes besides its characters and ids; longer keys than so many characters are not kept.
ENTRY_BYTES, LONG_KEY = 200, 64
#: Pairs whose test is remembered, about 130 bytes each.
PAIR_ENTRIES = 500_000
NEVER = 1 << 60
#: Stands before a piece's first token.
START = 0xFFFFF


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes in
    order for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Generations(dict):
    """A cache bounded by bytes: the younger generation, with what the elder still knows moved up."""

    def __init__(self, make, limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.limit, self.held, self.elder = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_KEY:
                return value
        self.held += ENTRY_BYTES + len(key) + len(value)
        if self.held > self.limit:
            self.elder = dict(self)
            self.clear()
            self.held = ENTRY_BYTES + len(key) + len(value)
        self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one vocabulary file; build it once in each worker."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocab[a], vocab[b]
            self.rank[left << 20 | right] = rank
            self.parts[vocab[a + b]] = (left, right, rank)
        self.sizes = {i: len(content) for i, content in self.token_bytes.items()}
        self.pieces = regex.compile(PIECE_PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.spines: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        plain = [i for i in self.token_bytes if i not in self.special.values()]
        held = list(filter(self._token_holds, plain))
        for i in held:
            self.automaton.add_word(self.token_bytes[i].decode("latin-1"), (i, self.sizes[i]))
        self.automaton.make_automaton()
        #: If ids alone tell which merge comes first, and every token is what its own bytes are encoded as.
        self.ids_are_ranks = len(held) == len(plain) and list(self.parts) == sorted(self.parts) and len(self.parts) + 256 == len(plain)
        self.piece_ids = Generations(lambda piece: self._packed(self.encode_piece(piece.encode())))
        self.chunk_ids = Generations(lambda chunk: b"".join(self._by_piece(" " + chunk)))

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From a token's outermost byte on one side up to itself: (node, rank of the merge that takes it)."""
        found = self.spines.get(token << 1 | side)
        if found is None:
            nodes, node, up = [], token, NEVER
            while node in self.parts:
                nodes.append((node, up))
                up = self.parts[node][2]
                node = self.parts[node][side]
            nodes.append((node, up))
            found = self.spines[token << 1 | side] = nodes[::-1]
        return found

    def _seam(self, left: int, right: int) -> tuple[int, bool]:
        """Rank of the first merge across the border of two tokens, and if both were whole by then.

        Both sides grow by their own merges in rank order. A merge across the
        border wins if it ranks below the next one of the left side, which
        stands before it, and no higher than that of the right side.
        """
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (x, next_x), (y, next_y) = a[i], b[j]
            across = self.rank.get(x << 20 | y, NEVER)
            if across < next_x and across <= next_y:
                return across, next_x == next_y == NEVER
            if next_x == next_y == NEVER:
                return NEVER, False
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _pair_holds(self, pair: int) -> bool:
        return pair >> 20 == START or self._seam(pair >> 20, pair & 0xFFFFF)[0] == NEVER

    def _token_holds(self, token: int) -> bool:
        """If a token's own bytes are encoded as that token alone."""
        if token not in self.parts:
            return True
        left, right, rank = self.parts[token]
        return self._token_holds(left) and self._token_holds(right) and self._seam(left, right) == (rank, True)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, in time proportional to its length.

        Every prefix has a last token, as single bytes are tokens, so the one
        before a proposed token is always known.
        """
        n, pairs = len(piece), self.pairs
        last = [-1] * (n + 1)
        last[0] = START
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                pair = last[end - size] << 20 | token
                holds = pairs.get(pair)
                if holds is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    holds = pairs[pair] = self._pair_holds(pair)
                if holds:
                    last[end] = token
        ids, sizes = [], self.sizes
        while n:
            ids.append(last[n])
            n -= sizes[last[n]]
        ids.reverse()
        return ids

    def _by_piece(self, text: str) -> list[bytes]:
        return list(map(self.piece_ids.__getitem__, self.pieces.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Packed ids of text without special tokens.

        Where no two white-space characters stand side by side, every space
        opens a new piece, so text is cut at spaces and whole chunks are
        looked up.
        """
        if re.search(r"\s\s", text):
            return b"".join(self._by_piece(text))
        first, *rest = text.split(" ")
        return b"".join(self._by_piece(first)) + b"".join(map(self.chunk_ids.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.specials is None or not self.specials.search(text):
            packed = self._plain(text)
        else:
            packed = b"".join(
                self._packed([self.special[x]]) if x in self.special else self._plain(x)
                for x in self.specials.split(text)
                if x
            )
        return np.frombuffer(packed, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``bpe_ids`` (array of int) and ``bpe_text``, what the ids decode to.

    ``path`` names a byte-level vocabulary file that every executor can read.
    Special tokens in a text become their own ids, as the library's defaults
    have it. Null text counts as empty: no ids, empty text. Row-local: nothing is
    shuffled, repeated rows stay, and pieces of any length take linear time.
    Columns of the added names are replaced. Caches in each worker are bounded by bytes.
    """
    bounded_batches(df.sparkSession)
    df = df.drop("bpe_ids", "bpe_text")
    out = T.StructType(
        [
            *df.schema.fields,
            T.StructField("bpe_ids", T.ArrayType(T.IntegerType())),
            T.StructField("bpe_text", T.StringType()),
        ]
    )
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for batch in batches:
            ids = [model.encode(x or "") for x in batch.column(at).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            texts = pa.array([model.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, texts], names=[*batch.schema.names, "bpe_ids", "bpe_text"]
            )

    return df.mapInArrow(run, out)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_text"), 256).alias("decoded_sha256"),
    )
