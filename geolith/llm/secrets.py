"""Operator 3: secrets in text, false positives removed by a random forest."""

from __future__ import annotations

import bisect
import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, restored, set_aside, shared_folder, table
from .made_findings import made_finding

#: About so many documents, by hash of their text, get labelled findings planted to fit the forest to.
SAMPLE_DOCS = 10_000
#: So many findings are planted in all, where there are fewer documents than that more than one in each.
SAMPLE_FINDINGS = 10_000
#: Words of at least this share of all word occurrences, and two of them, form the dictionary.
DICTIONARY_SHARE = 1e-6
#: A task hands on its counts when it holds so many different words.
TASK_WORDS = 500_000
TREES, DEPTH, SEED = 30, 8, 7
THRESHOLD = 0.5
LEFT_CHARS, RIGHT_CHARS = 48, 16
#: Words beside a finding and words of its path have a weight from so many labelled findings on.
LEAST_FINDINGS = 20
#: How many words to the left of a finding count as its neighbours.
NEIGHBOURS = 4

#: Runs of the characters that keys and tokens are written in; possessive, so long runs cost linear time.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=~.-])[A-Za-z0-9_+/=~.-]{16,}+")
#: The name before an ``=``, looked for in so many characters.
IDENTIFIER, NAME_CHARS = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_-]*$"), 64
KEY_BEGINS = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_ENDS = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: A word that stands alone; the letters between the digits of a key are none, however often the key is copied.
PLAIN_WORD = re.compile(r"\b[^\W\d_]{2,24}\b")

# Prefixes that providers give their keys.
KNOWN_PREFIX = re.compile(
    r"(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|rk_live_|sk-|SG\.|npm_|hf_|shpat_|dop_v1_|xox[abpr]-|AIza|eyJ[A-Za-z0-9]|//hooks\.[a-z.]+/services/)"
)
# Names of credentials in English, German, French and Spanish, after which shorter values are candidates too.
NAMES = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api[_ -]?key", "access[_ -]?key", "auth[_ -]?key", "private[_ -]?key",
    "master[_ -]?key", "encryption[_ -]?key", "credential", "passwort", "kennwort", "zugangscode", "schlüssel", "mot de passe", "mot_de_passe",
    "motdepasse", "jeton", "contraseña", "clave", "credencial",
)
NAMED = re.compile(rf"""(?i)(?:{"|".join(NAMES)})[\w-]{{0,24}}["']?\s{{0,3}}(?:=>|:=|[:=]|\b(?:is|ist|est|es)\b)\s{{0,3}}(["'`]?)""")
NAMED_CHARS, LONGEST_NAMED = 8, 200
BARE_VALUE = re.compile(rf"""[^\s"'`<>(),;&]{{{NAMED_CHARS},{LONGEST_NAMED + 1}}}""")
#: A variable or template that stands for a value.
REFERENCE = re.compile(r"\$\{.*\}?|\$\(.*|\{\{.*|%\(.*|%[A-Za-z_]+%|\$[A-Z_]+")
#: A word in one spelling: short values like it are taken for words, as nothing tells them from words that no document has.
ONE_WORD, WORD_CHARS = re.compile(r"[^\W\d_]?(?:[^\W\d_A-Z]+|[A-Z]+)"), 20
ASSIGNED = re.compile(r"""[:=]\s*["']?$""")

FEATURES = (
    "length", "transitions", "entropy", "digits", "classes", "distinct", "dictionary", "nearest_word", "words", "path",
    "assigned", "quoted", "known_prefix", "separators", "symbols",
)


def value_start(run: str) -> int:
    """Where the value of a run NAME=VALUE starts: after the first ``=`` that follows an identifier; 0 without one.

    The ``=`` at a run's end are padding of base64, not an assignment.
    """
    at, end = run.find("="), len(run.rstrip("="))
    while 0 <= at < end:
        if IDENTIFIER.search(run[max(0, at - NAME_CHARS) : at]):
            return at + 1
        at = run.find("=", at + 1)
    return 0


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private keys: from each beginning to the first end after it; found in one pass over the text."""
    if "-----BEGIN" not in text:
        return []
    ends = [m.end() for m in KEY_ENDS.finditer(text)]
    found, at = [], 0
    for m in KEY_BEGINS.finditer(text):
        if m.start() >= at:
            last = bisect.bisect_left(ends, m.end())
            if last == len(ends):
                break
            at = ends[last]
            found.append((m.start(), at))
    return found


def named_values(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values of 8 to 200 characters, without blanks, that the name of a credential is given: quoted ones whole, others up to a blank.

    Names of functions that are called, references to variables, and single words of under 20 letters are no values.
    """
    for m in NAMED.finditer(text):
        at, quote = m.end(), m.group(1)
        close = text.find(quote, at, at + LONGEST_NAMED + 1) if quote else -1
        if close >= 0:
            value = text[at:close]
        else:
            bare = BARE_VALUE.match(text, at)
            value = bare.group().rstrip(".:!?=-") if bare else ""
        called = close < 0 and text[at + len(value) : at + len(value) + 1] == "("
        word = len(value) < WORD_CHARS and ONE_WORD.fullmatch(value)
        if NAMED_CHARS <= len(value) <= LONGEST_NAMED and not re.search(r"\s", value) and not (called or word or REFERENCE.fullmatch(value)):
            yield at, at + len(value)


def candidates(text: str, blocks: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans of possible secrets: runs of 16 key characters with a letter and a digit, and values named as credentials.

    A run that lies in a longer named value is part of it; any other overlap leaves the run. Spans
    stand by start and don't overlap, nor do they reach into ``blocks``.
    """
    runs = list(_runs(text, blocks))
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    inside, named, last = set(), [], 0
    for a, b in named_values(text):
        low, high = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        block = bisect.bisect_right(blocks, (b,)) - 1
        if a < last or block >= 0 and blocks[block][1] > a or any(x < a or y > b or (x, y) == (a, b) for x, y in runs[low:high]):
            continue
        inside.update(range(low, high))
        named.append((a, b))
        last = b
    return sorted([r for i, r in enumerate(runs) if i not in inside] + named)


def _runs(text: str, blocks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters with a letter and a digit, without a name assigned to.

    What of a run lies in one of ``blocks`` is cut off; what stands before and after may still be a candidate.
    """
    block = 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while block < len(blocks) and blocks[block][1] <= at:
            block += 1
        here = block
        while at < end:
            inside = here < len(blocks) and blocks[here][0] < end
            stop = max(at, blocks[here][0]) if inside else end
            start = at + value_start(text[at:stop])
            value = text[start:stop]
            value = value.rstrip(".=-") or value
            if len(value) >= 16 and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
                yield start, start + len(value)
            at = max(at, blocks[here][1]) if inside else end
            here += 1


class TextStatistics:
    """Character transitions and a dictionary, counted over the plain words of all documents."""

    def __init__(self, pairs: dict[str, int], words: list[str]):
        heads = Counter()
        for pair, n in pairs.items():
            heads[pair[0]] += n
        self.log = {pair: math.log((n + 0.5) / (heads[pair[0]] + 64)) for pair, n in pairs.items()}
        self.unseen = math.log(0.5 / (max(heads.values(), default=0) + 64))
        self.words = frozenset(words)

    def transitions(self, value: str) -> float:
        low = value.lower()
        return sum(self.log.get(low[i : i + 2], self.unseen) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def coverage(self, value: str) -> float:
        """Share of the letters that dictionary words cover, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, sum(map(str.isalpha, low)))


def left_context(text: str, start: int) -> str:
    """What stands before a value; for a parameter in a URL only its name, as the address says nothing of it."""
    left = text[max(0, start - LEFT_CHARS) : start]
    parameter = re.search(r"[?&]([A-Za-z0-9_.-]+=)$", left)
    return parameter.group(1) if parameter else left


_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def split_words(text: str) -> list[str]:
    """Lower-cased words, those of a compound name each for itself."""
    return [w.lower() for w in _WORDS.findall(text) if len(w) > 1]


@dataclass
class WordWeights:
    """How much more often a word stands beside a secret than beside a look-alike, by its log odds."""

    beside: dict[str, float]
    path: dict[str, float]

    def of_neighbours(self, left: str) -> tuple[float, float]:
        """Weight of the nearest word that has one, and of the nearest words together."""
        known = [self.beside.get(w, 0.0) for w in split_words(left)[-NEIGHBOURS:]]
        return next((w for w in reversed(known) if w), 0.0), sum(known)

    def of_path(self, path: str | None) -> float:
        return sum(self.path.get(w, 0.0) for w in split_words(path or ""))


def features(value: str, left: str, right: str, path: str | None, stats: TextStatistics, weights: WordWeights) -> list[float]:
    counts, n = Counter(value), len(value)
    kinds = (str.isupper, str.islower, str.isdigit)
    nearest, together = weights.of_neighbours(left)
    return [
        float(n),
        stats.transitions(value),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(map(str.isdigit, value)) / n,
        float(sum(any(map(k, value)) for k in kinds)),
        len(counts) / min(n, 36),
        stats.coverage(value),
        nearest,
        together,
        weights.of_path(path),
        float(bool(ASSIGNED.search(left))),
        float(left[-1:] in "\"'" and right[:1] in "\"'" and bool(left) and bool(right)),
        float(bool(KNOWN_PREFIX.match(value))),
        sum(value.count(c) for c in "./-_") / n,
        sum(value.count(c) for c in "!#$%^&*@?") / n,
    ]


def planted(text: str, rng: random.Random, held: bool = False) -> tuple[str, str, str, str | None, bool] | None:
    """(value, left, right, path, label) of a made-up finding put between two words of a text.

    None if the finding is no candidate, or the text assigns something there. Secrets and look-alikes are known by
    how they are made, so no rule that the forest could repeat labels them.
    """
    middle = rng.randrange(len(text) + 1)
    before = re.sub(r"\S*$", "", text[max(0, middle - 400) : middle])
    after = re.sub(r"^\S*", "", text[middle : middle + 400])
    if re.search(r"""[=:"'>]\s*$""", before):
        return None
    words = [w for w in re.findall(r"[^\W\d_]{3,12}", before + after)] or ["some", "more", "words"]
    made, start, end, path, label = made_finding(rng, words, held)
    body, at = before + made + after, len(before)
    for a, b in candidates(body):
        if a < at + end and b > at + start:
            return body[a:b], left_context(body, a), body[b : b + RIGHT_CHARS], path, label
    return None


def text_statistics(docs: DataFrame) -> TextStatistics:
    """Character pairs and frequent words of 4 to 12 letters over the texts of all ``docs``.

    Tasks count their own documents and Spark adds the counts up. The
    dictionary holds at most 1 / DICTIONARY_SHARE words, however many documents
    there are.
    """

    def counted_rows(found: Counter) -> pa.RecordBatch:
        pairs: Counter = Counter()
        for word, n in found.items():
            for i in range(len(word) - 1):
                pairs[word[i : i + 2]] += n
        rows = [("all", "", sum(found.values()))] + [("pair", k, n) for k, n in pairs.items()]
        rows += [("word", k, n) for k, n in found.items() if 4 <= len(k) <= 12]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["kind", "key", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(PLAIN_WORD.findall(text.lower()) if text else ())
            if len(found) > TASK_WORDS:
                yield counted_rows(found)
                found = Counter()
        yield counted_rows(found)

    counted = checkpointed(
        docs.select("text")
        .mapInArrow(count, "kind string, key string, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    total = (counted.where("kind = 'all'").agg(F.sum("n")).first()[0]) or 0
    ascii_pairs = counted.where("kind = 'pair' AND key RLIKE '^[a-z]{2}$'").collect()
    least = max(2, math.ceil(DICTIONARY_SHARE * total))
    words = counted.where((F.col("kind") == "word") & (F.col("n") >= least)).select("key").collect()
    return TextStatistics({r["key"]: r["n"] for r in ascii_pairs}, [r["key"] for r in words])


class Forest:
    """A trained forest as plain trees, to be asked inside Python tasks.

    The trees come from the model's saved table of nodes.
    """

    def __init__(self, model: RandomForestClassificationModel, spark: SparkSession):
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        model.save(path)
        nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}
        self.trees = [self._node(nodes, tree, 0) for tree in sorted({t for t, _ in nodes})]

    def _node(self, nodes: dict, tree: int, at: int):
        node = nodes[tree, at]
        if node.leftChild < 0:
            return node.impurityStats[1] / sum(node.impurityStats)
        return (
            node.split.featureIndex,
            node.split.leftCategoriesOrThreshold[0],
            self._node(nodes, tree, node.leftChild),
            self._node(nodes, tree, node.rightChild),
        )

    def score(self, values: list[float]) -> float:
        """Mean over the trees of the share of secrets in the leaf, which is the library's probability."""
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if values[node[0]] <= node[1] else node[3]
            total += node
        return total / max(1, len(self.trees))


Model = tuple[TextStatistics, WordWeights, Forest]


def labelled_findings(docs: DataFrame, per_document: int, held: bool = False) -> DataFrame:
    """(value, left, right, path, label): ``per_document`` made-up findings planted in each text of ``docs``.

    What is made depends on the text alone, not on how rows are dealt.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rng = random.Random(xxh64_intdigest((text or "").encode(), SEED + held))
                rows += filter(None, (planted(text or "", rng, held) for _ in range(per_document)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["value", "left", "right", "path", "label"]
            )

    return docs.select("text").mapInArrow(plant, "value string, `left` string, `right` string, path string, label boolean")


def word_weights(findings: DataFrame) -> WordWeights:
    """Log odds of the words beside labelled findings, and of the words of their paths."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for left, path, label in zip(*(batch.column(c).to_pylist() for c in ("left", "path", "label")), strict=True):
                rows += [("beside", w, label) for w in set(split_words(left)[-NEIGHBOURS:])]
                rows += [("path", w, label) for w in set(split_words(path or ""))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)],
                names=["kind", "word", "label"],
            )

    counted = (
        findings.mapInArrow(split, "kind string, word string, label boolean")
        .groupBy("kind", "word")
        .agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"))
        .where(F.col("yes") + F.col("no") >= LEAST_FINDINGS)
        .collect()
    )
    odds = {(r.kind, r.word): math.log((r.yes + 2) / (r.no + 2)) for r in counted}
    return WordWeights(*({w: x for (k, w), x in odds.items() if k == kind} for kind in ("beside", "path")))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Text statistics of all ``docs``, weights of neighbouring words, and a random forest.

    The forest and the weights are fitted to made-up findings planted in about
    ``sample_docs`` of the texts, at least ``SAMPLE_FINDINGS`` in all: secrets
    and look-alikes under many names, in many forms and spellings. Their labels
    come from how they are made. Rows are put in order before the fit, so the
    forest does not depend on how they are dealt. Without documents the
    findings stand alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = docs.count()
    place = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = docs.where(F.col("text").isNotNull() & (place < min(1.0, sample_docs / max(1, n)))).select("text")
    alone = spark.createDataFrame([(f"{i} ",) for i in range(200)], "text string")
    each = -(-SAMPLE_FINDINGS // max(1, min(n, sample_docs)))
    findings = checkpointed(labelled_findings(sample, min(50, each)).unionByName(labelled_findings(alone, 5)))
    weights, stats = word_weights(findings), text_statistics(docs)
    shared = spark.sparkContext.broadcast((stats, weights))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, weights = shared.value
        for batch in batches:
            rows = [features(v, a, b, p, stats, weights) for v, a, b, p in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "values"]
            )

    rows = checkpointed(
        findings.mapInArrow(described, "label double, `values` array<double>")
        .repartition(1)
        .sortWithinPartitions("label", "values")
        .select("label", array_to_vector("values").alias("features"))
    )
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.5", featuresCol="features", labelCol="label"
    ).fit(rows)
    return stats, weights, Forest(forest, spark)


def scan(df: DataFrame, model: Model, text: str = "text", path: str = "source") -> DataFrame:
    """``df`` with ``n_candidates``, ``secrets`` (struct(start, end, value, score)) and ``redacted``.

    Candidates are runs of 16 or more key characters with a letter and a
    digit, values of 8 characters or more under the name of a credential, and
    private key blocks, which count at once; what of a run lies in a block is cut off. A candidate is a secret if the forest gives it at least
    0.5. ``redacted`` is the text with every secret as ``<SECRET>``. Spans stand
    by start and do not overlap. Null text has none and stays null, an empty
    table gives none; a null path counts as unknown. Row-local; repeated rows
    stay and get the same result, columns of the added names are replaced;
    very long runs and unfinished key blocks take linear time.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    df = df.drop("n_candidates", "secrets", "redacted")
    shared = spark.sparkContext.broadcast(model)
    secret = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("n_candidates", T.LongType()),
            T.StructField("secrets", T.ArrayType(secret)),
            T.StructField("redacted", T.StringType()),
        ]
    )
    arrow = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])
    )
    at, path_at = df.columns.index(text), df.columns.index(path) if path in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, weights, forest = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = batch.column(path_at).to_pylist() if path_at is not None else [None] * len(texts)
            seen, found, clean = [], [], []
            for body, where in zip(texts, paths, strict=True):
                blocks = key_blocks(body or "")
                proposed = candidates(body or "", blocks)
                kept = [(a, b, 1.0) for a, b in blocks]
                for a, b in proposed:
                    left, right = left_context(body, a), body[b : b + RIGHT_CHARS]
                    score = forest.score(features(body[a:b], left, right, where, stats, weights))
                    if score >= THRESHOLD:
                        kept.append((a, b, score))
                kept.sort()
                seen.append(len(proposed) + len(blocks))
                found.append([{"start": a, "end": b, "value": body[a:b], "score": s} for a, b, s in kept])
                if kept:
                    ends = [0, *(b for _, b, _ in kept)]
                    starts = [*(a for a, _, _ in kept), len(body)]
                    body = "<SECRET>".join(body[a:b] for a, b in zip(ends, starts, strict=True))
                clean.append(body)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seen, pa.int64()), pa.array(found, arrow), pa.array(clean, pa.string())],
                names=[*batch.schema.names, "n_candidates", "secrets", "redacted"],
            )

    return df.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced, and ``n_chars`` counted anew."""
    read = ("text", "source", "n_chars")
    scanned = scan(set_aside(docs, *read), train(docs.select("doc_id", "text", "source")))
    changed = scanned.withColumns({"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")})
    return restored(changed, docs.columns, *read)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return scan(docs, train(docs)).select(
        "doc_id",
        "n_candidates",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("spans"),
        F.round(F.array_max(F.transform("secrets", lambda s: s["score"])), 6).alias("max_score"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
