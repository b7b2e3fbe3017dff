"""Questions in plain words to query plans, as column expressions over any number of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.session import SMALL_ROWS, small

from .network import _checkpointed

# Wordings that are put into standard form before parsing, in this order.
REWRITES = (
    (r"(?i)\bu\.?s\.?a?\.?(?=\W|$)", "United States"),
    (r"(?i)\buk\b", "United Kingdom"),
    (r"(?i)\bper ?cent\b", "%"),
    (r"(?i)\bhalf\b", "50%"),
    (r"(?i)\btop ten\b", "top 10"),
    (r"(?i)\btop five\b", "top 5"),
    (r"(?i)\btop three\b", "top 3"),
    (r"(?i)\bwhat happens if\b", "shock:"),
)
SHOCK = r"(?i)(shock|cuts? off|stops? (exporting|selling)|embargo|disrupt|sanction|collapse)"
FORECAST = r"(?i)(forecast|predict|outlook|next (year|quarter|decade)|by 20[3-9]\d|will .* (grow|rise|fall))"
BLOCS = r"(?i)(bloc|alliance|camp|align)"
EVENTS = r"(?i)(event|news|yesterday|today|happen|incident|protest)"
RANKING = r"(?i)(which countr|top \d+|most|least|rank|largest|highest|lowest)"
PROFILE = r"(?i)(profile|overview|tell me about|summary of)"
SECTORS = {"energy": r"(?i)(energy|oil|gas|fuel)", "agriculture": r"(?i)(agricultur|food|grain|wheat)", "electronics": r"(?i)(electronic|chip|semiconductor)"}


def reformulate(text: Column) -> Column:
    """Questions in standard wording; blanks are single."""
    for pattern, into in REWRITES:
        text = F.regexp_replace(text, pattern, into)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Words that turn a country's name into a region's, unless the name itself has them.
COMPASS = ("north", "northern", "south", "southern", "east", "eastern", "west", "western", "central")
#: Names of so many characters are found in capitals only, as they are words too.
CODE_CHARACTERS = 3
_WORD = r"[\p{L}\p{N}_]+"
_RUNS = "array<struct<at:int,size:int,seen:string,before:string>>"
# How sure each kind of rewrite is; those of a question multiply.
CONFIDENCE = {
    "endonym": 0.95,
    "combining_form": 0.95,
    "abbreviation": 0.9,
    "capital": 0.9,
    "country_spelling": 0.8,
    "word_spelling": 0.9,
    "word_form": 0.95,
    "number_word": 0.95,
    "relative_year": 0.9,
    "lexicon": 0.9,
    "future_year": 0.85,
    "scenario": 0.8,
}


def _pieces(text: Column) -> Column:
    """Words and what stands between them, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_WORD}|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))


def _folded(label: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(label), F.lit(f"({_WORD})"), F.lit(1)), " ")


def mentions(questions: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hits): where each question names a label, as (at, size, label) in order; every question has a row.

    ``labels`` has (label, ...), each a name of one or more words. Names are matched whole, in any case, with blanks or
    hyphens between their words; names of up to three characters only in capitals. Longer names go first (by words, then
    characters), of equal ones the first in the text; names do not overlap. A name after a compass word is a region and
    not found. ``at`` counts pieces (words and what stands between them), ``size`` is their number. Runs of words up to the longest label are
    looked up by a join, so neither side is scanned for the other.
    """
    known = labels.select(F.col("label"), _folded(F.col("label")).alias("name")).where("name <> ''").distinct()
    longest = known.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(0))).first()[0]
    empty = questions.select(key, F.array().cast("array<struct<at:int,size:int,label:string>>").alias("hits"))
    if not longest:
        return empty
    inner = F.lit(f"^({_WORD}|[\\s-]+)$")

    def run(p: Column, at: Column, n: Column) -> Column:
        before = F.lower(F.when((at >= 2) & F.rlike(F.get(p, at - 1), F.lit(r"^[\s-]+$")), F.get(p, at - 2)))
        seen = F.array_join(F.slice(p, at + 1, 2 * n - 1), "")
        return F.struct(at.alias("at"), (2 * n - 1).alias("size"), seen.alias("seen"), before.alias("before"))

    def runs(p: Column) -> Column:
        """All runs of words of ``p``; pieces are seen through the lambda, so a question is cut once and not copied to its words."""
        words = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda at: F.rlike(F.get(p, at), F.lit(f"^{_WORD}$")))
        sizes = F.sequence(F.lit(1), F.lit(longest))

        def whole(at: Column, n: Column) -> Column:
            return (at + 2 * n - 1 <= F.size(p)) & F.forall(F.slice(p, at + 1, 2 * n - 1), lambda x: F.rlike(x, inner))

        return F.flatten(F.transform(words, lambda at: F.transform(F.filter(sizes, lambda n: whole(at, n)), lambda n: run(p, at, n))))

    each = F.flatten(F.transform(F.array(_pieces(F.col(text))), lambda p: F.when(F.size(p) > 0, runs(p)).otherwise(F.array().cast(_RUNS))))
    found = (
        questions.select(key, F.explode(each).alias("r"))
        .select(key, "r.*", _folded(F.col("r.seen")).alias("name"))
        .join(known, "name")
        .where((F.length("name") > CODE_CHARACTERS) | (F.upper("seen") == F.col("seen")))
        .where(F.coalesce(~F.col("before").isin(*COMPASS), F.lit(True)))
    )
    hit = F.struct((-F.col("size")).alias("s"), (-F.length("name")).alias("c"), F.col("at").cast("int").alias("at"), F.col("size").cast("int").alias("size"), "label")
    ordered = found.groupBy(key).agg(F.sort_array(F.collect_set(hit)).alias("found"))
    kept = F.aggregate(
        F.transform("found", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size"), h["label"].alias("label"))),
        F.array().cast("array<struct<at:int,size:int,label:string>>"),
        lambda acc, h: F.when(
            F.exists(acc, lambda k: (k["at"] < h["at"] + h["size"]) & (h["at"] < k["at"] + k["size"])), acc
        ).otherwise(F.array_append(acc, h)),
    )
    return questions.select(key).join(ordered, key, "left").select(
        key, F.coalesce(F.sort_array(kept), F.array().cast("array<struct<at:int,size:int,label:string>>")).alias("hits")
    )


def entity_mentions(questions: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, iso3s): countries that a question names, in order of their codes. ``aliases`` has (alias, iso3)."""
    labels = aliases.select(F.col("alias").alias("label"), "iso3")
    hits = mentions(questions, labels, key, text).select(key, F.explode("hits.label").alias("label"))
    return hits.join(labels, "label").groupBy(key).agg(F.sort_array(F.collect_set("iso3")).alias("iso3s"))


def replace_mentions(questions: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n, confidence): every name put in its standard form. ``labels`` has (label, into, kind), a row for each label."""
    hits = mentions(questions, labels, key, text)
    named = hits.select(key, F.explode("hits").alias("h")).select(key, "h.*").join(labels.select("label", "into", "kind"), "label")
    sure = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("kind"))
    changes = named.groupBy(key).agg(F.collect_list(F.struct("at", "size", "into", sure.alias("sure"))).alias("changes"))
    both = questions.select(key, text).join(changes, key, "left")
    done = F.coalesce("changes", F.array().cast("array<struct<at:int,size:int,into:string,sure:double>>"))

    def piece(p: Column, i: Column) -> Column:
        own = F.filter("done", lambda c: (c["at"] <= i) & (i < c["at"] + c["size"]))
        return F.when(F.size(own) == 0, p).when(F.get(own, F.lit(0))["at"] == i, F.get(own, F.lit(0))["into"]).otherwise("")

    return both.withColumn("done", done).select(
        key, F.array_join(F.transform(_pieces(F.col(text)), piece), "").alias(text), F.size("done").alias("n"),
        F.aggregate("done", F.lit(1.0), lambda a, c: a * c["sure"]).alias("confidence"),
    )


def number_labels(spark) -> DataFrame:
    """(label, into, kind): the words for 0 to 99, made from their parts."""
    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    names = ones + [t + (" " + ones[u] if u else "") for t in tens for u in range(10)]
    return spark.createDataFrame([(name, str(i), "number_word") for i, name in enumerate(names)], "label string, into string, kind string")


# Framings of a question about a cut in trade, put as a shock, and wordings of coming years.
SCENARIOS = ((r"(?i)\b(what (happens|would happen) if|suppose|imagine)\b", "shock:", "scenario"),)
COMING = ((r"(?i)\b(in|over) the (coming|next) years\b", "next decade", "future_year"),)


def rewritten(questions: DataFrame, aliases: DataFrame, vocabulary: DataFrame, year: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, original, text, steps, confidence): questions in standard wording, step by step.

    Aliases become standard names, unknown words the nearest known ones, number words and relative years figures, and framings
    those that :func:`parse` knows. ``steps`` has (step, n, confidence) of the steps that changed something; the question's
    confidence is their product. ``aliases`` has (label, into, kind) with a kind of ``CONFIDENCE``, ``vocabulary`` (word).
    Null counts as empty.
    """
    state = questions.select(key, F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")).alias("text"))
    original = state.withColumnRenamed("text", "original")
    taken = []

    def note(step: str, done: DataFrame) -> DataFrame:
        taken.append(done.select(key, F.lit(len(taken)).alias("i"), F.lit(step).alias("step"), "n", "confidence").where("n > 0"))
        return done.select(key, "text")

    state = note("aliases", replace_mentions(state, aliases, key, "text"))
    fixed = correct_spelling(state, vocabulary, key, "text")
    changed = F.size(F.filter(F.zip_with(_pieces(F.col("text")), _pieces(F.col("corrected")), lambda a, b: a != b), lambda x: x))
    state = note("spelling", fixed.select(key, F.col("corrected").alias("text"), changed.alias("n"), F.pow(F.lit(CONFIDENCE["word_spelling"]), changed).alias("confidence")))
    relative = ((r"(?i)\bnext year\b", str(year + 1), "relative_year"), (r"(?i)\bthis year\b", str(year), "relative_year"), (r"(?i)\blast year\b", str(year - 1), "relative_year"))
    numbers = replace_mentions(state, number_labels(questions.sparkSession), key, "text")
    state = note("numbers", _replaced(numbers, relative))
    phrases = tuple((p, into, "lexicon") for p, into in REWRITES) + SCENARIOS + COMING
    state = note("phrasing", _replaced(state.withColumns({"n": F.lit(0), "confidence": F.lit(1.0)}), phrases))
    steps = taken[0]
    for more in taken[1:]:
        steps = steps.unionByName(more)
    listed = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "step", "n", "confidence"))).alias("s"))
    fields = F.transform("s", lambda x: F.struct(x["step"].alias("step"), x["n"].alias("n"), x["confidence"].alias("confidence")))
    return original.join(state, key).join(listed, key, "left").select(
        key, "original", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.coalesce(fields, F.array().cast("array<struct<step:string,n:int,confidence:double>>")).alias("steps"),
        F.coalesce(F.aggregate("s", F.lit(1.0), lambda a, x: a * x["confidence"]), F.lit(1.0)).alias("confidence"),
    )


def _replaced(state: DataFrame, rules: tuple) -> DataFrame:
    """``state`` with every rule's pattern replaced; a rule that applies counts once and lowers the confidence by its kind."""
    for pattern, into, kind in rules:
        hit = F.rlike("text", F.lit(pattern))
        state = state.select(
            *(c for c in state.columns if c not in ("text", "n", "confidence")), F.regexp_replace("text", pattern, into).alias("text"),
            (F.col("n") + hit.cast("int")).alias("n"), (F.col("confidence") * F.when(hit, CONFIDENCE[kind]).otherwise(1.0)).alias("confidence"),
        )
    return state


def severity(text: Column) -> Column:
    """A percentage as a share; half without one, all if trade stops."""
    percent = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100
    stops = F.rlike(text, F.lit(r"(?i)(stop|cuts? off|embargo|collapse|complete)"))
    return F.least(F.lit(1.0), F.coalesce(percent, F.when(stops, 1.0), F.lit(0.5)))


def parse(questions: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Query plans: intent, countries, year, sector, severity, limit and how well the question was understood.

    Intents in order of precedence: shock with a country, forecast, bilateral
    with two, blocs, events with a country unless a profile is asked for,
    ranking without one, profile. Each different question is parsed once, however often it is asked; its digest joins
    the plan to its askers.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__asked")
    asked = questions.select(F.col(key), digest)
    different = _checkpointed(questions.select(digest, F.coalesce(F.col(text), F.lit("")).alias("text")).distinct())
    plans = _plans(different, aliases, "__asked", "text")
    few = different.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return asked.join(F.broadcast(plans) if few else plans, "__asked").drop("__asked")


def _plans(questions: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """The plans of different questions, by key."""
    plain = questions.select(key, reformulate(F.col(text)).alias("q"))
    both = plain.join(entity_mentions(plain, aliases, key, "q"), key, "left").withColumn(
        "iso3s", F.coalesce("iso3s", F.array().cast("array<string>"))
    )

    def says(pattern: str) -> Column:
        return F.rlike("q", F.lit(pattern))

    n = F.size("iso3s")
    intent = (
        F.when(says(SHOCK) & (n >= 1), "shock")
        .when(says(FORECAST), "forecast")
        .when(n >= 2, "bilateral")
        .when(says(BLOCS), "blocs")
        .when(says(EVENTS) & (n >= 1) & ~says(PROFILE), "events")
        .when(says(RANKING) & (n == 0), "ranking")
        .otherwise("profile")
    )
    sector = F.coalesce(*(F.when(says(p), F.lit(s)) for s, p in SECTORS.items()), F.lit("all"))
    top = F.regexp_extract("q", r"(?i)\btop (\d+)", 1).try_cast("int")
    limit = F.least(F.lit(20), F.greatest(F.lit(1), F.coalesce(top, F.when(F.col("intent") == "ranking", 10).otherwise(5))))
    year = F.regexp_extract("q", r"\b(19[5-9]\d|20[0-4]\d)\b", 1).try_cast("int")
    understanding = F.when((n == 0) & (F.col("intent") == "profile"), 0.4).otherwise(1.0)
    return both.withColumn("intent", intent).select(
        key,
        "intent",
        F.array_join("iso3s", ",").alias("countries"),
        year.alias("year"),
        sector.alias("sector"),
        F.when(F.col("intent") == "shock", severity(F.col("q"))).alias("severity"),
        limit.alias("limit"),
        understanding.alias("understanding"),
    )


def aligned_year(latest: DataFrame) -> DataFrame:
    """The year that all agents cover: the least of their latest ones. ``latest`` has (agent, year)."""
    per = latest.groupBy("agent").agg(F.max("year").alias("latest"))
    return per.agg(F.min("latest").alias("aligned_year"), F.max("latest").alias("newest_year"), F.count("*").alias("agents"))


def correct_spelling(questions: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, corrected): unknown words of four letters or more put right by the nearest known word.

    One edit (a swap of neighbours counts as one) is allowed, two from eight
    letters on; of equally near words the first by name counts. Distances are
    computed once for each distinct unknown word, against the words of about its
    length; ``vocabulary`` (word) has a few thousand rows and is broadcast.
    """
    from geolith.functions.text import osa

    known = small(vocabulary.select(F.lower("word").alias("w")).distinct())
    pieces = questions.select(
        key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))).alias("i", "piece")
    ).withColumn("w", F.lower("piece"))
    unknown = pieces.where(F.rlike("w", F.lit(r"^\p{L}{4,}$"))).select("w").distinct().join(known, "w", "left_anti")
    near = unknown.select("w", F.explode(F.sequence(F.length("w") - 2, F.length("w") + 2)).alias("size")).join(
        small(known.select(F.col("w").alias("right"), F.length("w").alias("size"))), "size"
    )
    allowed = F.when(F.length("w") >= 8, 2).otherwise(1)
    best = (
        near.withColumn("d", osa("w", "right"))
        .where(F.col("d") <= allowed)
        .groupBy("w")
        .agg(F.min_by("right", F.struct("d", "right")).alias("right"))
    )
    fixed = pieces.join(best, "w", "left").withColumn("piece", F.coalesce("right", "piece"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "piece")))
    whole = fixed.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("corrected"))
    return questions.select(key, text).join(whole, key, "left").withColumn("corrected", F.coalesce("corrected", F.lit("")))
