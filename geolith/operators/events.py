"""Event operators over coded daily events.

Events have (event_id, sql_date, a1, a2, event_code, goldstein, num_articles, url). Missing
actor codes stay the string "NAN", which grouping treats as a value and partner counts leave out.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import _checkpointed

# Names of the two-digit root codes.
ROOT_NAMES = {
    "01": "Verbal Cooperation", "02": "Material Cooperation", "03": "Diplomatic Cooperation", "04": "Consultation",
    "05": "Mediation", "06": "Engagement", "07": "Provision of Aid", "08": "Yield / Concession", "09": "Investigation",
    "10": "Demand", "11": "Disapprove", "12": "Reject", "13": "Threaten", "14": "Protest", "15": "Exhibit Force",
    "16": "Reduce Relations", "17": "Coerce", "18": "Assault", "19": "Fight", "20": "Mass Violence",
}
MISSING_CODES = ("", "NAN", "NONE")


def clean_code(code: Column) -> Column:
    """Upper-case code; empty, "nan" and "none" are null."""
    plain = F.upper(F.trim(code))
    return F.when(~plain.isin(*MISSING_CODES), plain)


def root_name(event_code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROOT_NAMES.items() for x in pair))
    return F.coalesce(names[F.substring(event_code, 1, 2)], F.lit("Other"))


def tone(goldstein: Column) -> Column:
    """Five bands of the Goldstein value; unknown is neutral."""
    return (
        F.when(goldstein.isNull() | F.isnan(goldstein), "neutral")
        .when(goldstein >= 5, "strongly cooperative")
        .when(goldstein >= 1, "cooperative")
        .when(goldstein > -1, "neutral")
        .when(goldstein >= -5, "tense")
        .otherwise("highly conflictual")
    )


def theme(event_code: Column) -> Column:
    root = F.substring(event_code, 1, 2).try_cast("int")
    return (
        F.when(root.between(1, 8), "Diplomatic Cooperation")
        .when(root.between(9, 12), "Diplomatic Pressure")
        .when(root.between(13, 16), "Escalation & Protest")
        .when(root.between(17, 20), "Conflict & Violence")
        .otherwise("Other")
    )


def role(a1: Column, a2: Column, country: str) -> Column:
    return F.when((a1 == country) & (a2 == country), "Both").when(a1 == country, "Initiator").otherwise("Recipient")


def prepare(events: DataFrame, country: str) -> DataFrame:
    """A country's events: first row per source, then those with a code; typed and described.

    "First" is the least event_id, as files have no order here. Sources are
    deduplicated before rows without a code go.
    """
    a1, a2 = (F.upper(F.trim(F.coalesce(c, F.lit("NAN")))) for c in ("a1", "a2"))
    mine = events.withColumns({"a1": a1, "a2": a2}).where((F.col("a1") == country) | (F.col("a2") == country))
    rest = [c for c in mine.columns if c != "url"]
    first = mine.groupBy("url").agg(F.min_by(F.struct(*rest), "event_id").alias("e")).select("url", "e.*")
    return first.where("event_code IS NOT NULL").withColumns(
        {
            "root": F.substring("event_code", 1, 2),
            "event_type": root_name(F.col("event_code")),
            "tone": tone(F.col("goldstein")),
            "theme": theme(F.col("event_code")),
            "role": role(F.col("a1"), F.col("a2"), country),
            "domestic": (F.col("a1") == country) & (F.col("a2") == country),
        }
    )


def top_events(prepared: DataFrame) -> DataFrame:
    """Five events: the three lowest and two highest Goldstein values, strongest first.

    Rows between equal actors go unless nothing else is left; of equal actors and
    root the row with most articles stays.
    """
    known = prepared.where("goldstein IS NOT NULL").withColumn("num_articles", F.coalesce("num_articles", F.lit(1)))
    other = F.col("a1") != F.col("a2")
    keys = ["a1", "a2", "root"]
    rest = [c for c in known.columns if c not in keys]
    best = (
        known.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("num_articles", -F.col("event_id"))).alias("e"))
        .select(*keys, "e.*")
    )
    any_other = best.agg(F.coalesce(F.max(other.cast("int")), F.lit(0)).alias("__any"))
    kept = best.crossJoin(F.broadcast(any_other)).where(other | (F.col("__any") == 0)).drop("__any")
    low = kept.orderBy("goldstein", "event_id").limit(3)
    high = kept.orderBy(F.desc("goldstein"), "event_id").limit(2)
    return low.union(high).dropDuplicates(["event_id"]).orderBy(F.desc(F.abs("goldstein")), "event_id").limit(5)


def partners(prepared: DataFrame, country: str, k: int = 8) -> DataFrame:
    """The k most frequent counterparts with mean Goldstein value."""
    partner = F.when(F.col("role") == "Recipient", F.col("a1")).otherwise(F.col("a2"))
    return (
        prepared.withColumn("partner", partner)
        .where(F.rlike("partner", F.lit("^[A-Z0-9]{3}$")) & ~F.col("partner").isin("NAN", country))
        .groupBy("partner")
        .agg(F.count("*").alias("events"), F.avg("goldstein").alias("mean_goldstein"))
        .orderBy(F.desc("events"), "partner")
        .limit(k)
    )


def partner_bands(prepared: DataFrame, country: str) -> DataFrame:
    """Per counterpart: conflict (-5 or less), cooperative (5 or more) and neutral events."""
    partner = F.when(F.col("role") == "Recipient", F.col("a1")).otherwise(F.col("a2"))
    return prepared.withColumn("partner", partner).where(F.col("partner") != country).groupBy("partner").agg(
        F.count_if(F.col("goldstein") <= -5).alias("conflict"),
        F.count_if(F.col("goldstein") >= 5).alias("cooperative"),
        F.count_if((F.col("goldstein") > -5) & (F.col("goldstein") < 5)).alias("neutral"),
    )


def day_metrics(prepared: DataFrame, *by: str) -> DataFrame:
    """Totals of a day's events: number, mean Goldstein, share initiated, domestic, ambiguous."""
    return prepared.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.avg("goldstein").alias("mean_goldstein"),
        (100 * F.avg((F.col("role") == "Initiator").cast("int"))).alias("initiator_pct"),
        F.count_if(F.col("domestic")).alias("domestic"),
        F.count_if(~F.col("domestic")).alias("international"),
        F.count_if(F.col("a2") == "NAN").alias("ambiguous"),
        F.sum("num_articles").alias("articles"),
    )


def value_counts(prepared: DataFrame, column: str) -> DataFrame:
    return prepared.groupBy(column).agg(F.count("*").alias("events"), F.avg("goldstein").alias("mean_goldstein"))


def scope_statistics(prepared: DataFrame) -> DataFrame:
    """Domestic and international events apart: mean, initiated, top type, worst and best type, top events."""
    per_type = prepared.groupBy("domestic", "event_type").agg(
        F.count("*").alias("n"),
        F.sum("goldstein").alias("g"),
        F.count_if(F.col("role") == "Initiator").alias("initiated"),
    )
    return per_type.groupBy("domestic").agg(
        F.sum("n").alias("events"),
        (F.sum("g") / F.sum("n")).alias("mean_goldstein"),
        F.sum("initiated").alias("initiated"),
        F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("top_type"),
        F.min_by("event_type", F.struct(F.round(F.col("g") / F.col("n"), 9), "event_type")).alias("worst_type"),
        F.min_by("event_type", F.struct(F.round(-F.col("g") / F.col("n"), 9), "event_type")).alias("best_type"),
    )


def actor_network(events: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Actors (number, mean value) and undirected edges among the most frequent ``top`` of them."""
    known = events.where("a1 NOT IN ('NAN', '') AND a2 NOT IN ('NAN', '')")
    actors = (
        known.select(F.explode(F.array("a1", "a2")).alias("actor"), "goldstein")
        .groupBy("actor")
        .agg(F.count("*").alias("n"), F.avg("goldstein").alias("mean_goldstein"))
        .orderBy(F.desc("n"), "actor")
        .limit(top)
    )
    names = F.broadcast(actors.select("actor"))  # ``top`` rows
    edge = (
        known.where("a1 <> a2")
        .join(names, F.col("a1") == F.col("actor"), "left_semi")
        .join(names, F.col("a2") == F.col("actor"), "left_semi")
        .groupBy(F.least("a1", "a2").alias("source"), F.greatest("a1", "a2").alias("target"))
        .agg(
            F.count("*").alias("n"),
            F.avg("goldstein").alias("mean_goldstein"),
            F.array_join(
                F.slice(F.sort_array(F.collect_set(root_name(F.col("event_code")))), 1, 3), ", "
            ).alias("types"),
        )
    )
    return actors, edge


def actor_events(events: DataFrame, actor: str) -> DataFrame:
    """One actor's events, one per (a1, a2, type, value to one decimal): the one with most articles.

    Values are rounded as tenths in doubles, half away from zero, as SQL engines do; Spark's own rounding to one
    decimal goes by the printed digits, so -7.949999999999999 would stand elsewhere.
    """
    typed = events.where((F.col("a1") == actor) | (F.col("a2") == actor)).withColumns(
        {"event_type": root_name(F.col("event_code")), "g1": F.round(F.col("goldstein") * 10) / 10}
    )
    keys = ["a1", "a2", "event_type", "g1"]
    order = Window.partitionBy(*keys).orderBy(F.desc("num_articles"), "event_id")
    return typed.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "g1")


def historical_context(yearly: DataFrame, by: str = "year") -> DataFrame:
    """Mean of a dyad's latest ten values, trend of the last three against the seven before, a label."""
    rn = F.row_number().over(Window.partitionBy("dyad").orderBy(F.desc(by)))
    stats = (
        yearly.withColumn("rn", rn)
        .where("rn <= 10")
        .groupBy("dyad")
        .agg(
            F.avg("s").alias("mean"),
            F.avg(F.when(F.col("rn") <= 3, F.col("s"))).alias("recent"),
            F.avg(F.when(F.col("rn") > 3, F.col("s"))).alias("prior"),
        )
    )
    change = F.round(F.col("recent") - F.col("prior"), 9)
    trend = F.when(change > 0.05, "improving").when(change < -0.05, "deteriorating").otherwise("stable")
    mean = F.round("mean", 4)
    label = (
        F.when(mean >= 0.3, "strongly cooperative")
        .when(mean >= 0.1, "moderately cooperative")
        .when(mean >= -0.1, "broadly neutral")
        .when(mean >= -0.3, "moderately tense")
        .otherwise("historically adversarial")
    )
    return stats.select("dyad", "mean", trend.alias("trend"), label.alias("label"))


MATCH_TOLERANCE = 1e-6


def matched(asked: DataFrame, events: DataFrame) -> DataFrame:
    """``asked`` rows (asked_id, url, event_type, goldstein) with the first event of the same address, type and value."""
    mine = asked.select("asked_id", "url", "event_type", F.col("goldstein").alias("__g"))
    found = mine.join(events, ["url", "event_type"]).where(F.abs(F.col("goldstein") - F.col("__g")) < MATCH_TOLERANCE)
    return found.groupBy("asked_id").agg(F.min("event_id").alias("event_id"))


def dyad_key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def title_case_words(text: Column) -> Column:
    """First letters of words upper-case, the rest lower; a letter after an apostrophe or hyphen starts a word."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0)),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
        ),
        "",
    )


def event_sentence() -> Column:
    """One sentence for an event of :func:`prepare`."""
    return F.concat(
        F.col("a1"), F.lit(" and "), F.col("a2"), F.lit(": "), F.lower("event_type"), F.lit(" ("),
        F.lower("tone"), F.lit(", "), F.col("num_articles").cast("string"), F.lit(" articles)"),
    )


def day_confidence(n: Column) -> Column:
    return F.least(F.lit(0.7), 0.3 + 0.1 * F.log10(1 + n))


def kmeans_themes(prepared: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """K-means over scaled (root, Goldstein); each cluster takes the theme of its most frequent root."""
    rows = prepared.where("goldstein IS NOT NULL").withColumn("root_n", F.col("root").cast("double"))
    found = rows.select("root_n", "goldstein").distinct().limit(k).count()
    if not found:
        return rows.limit(0).select("event_id", F.lit(0).alias("cluster"), F.lit("").alias("cluster_theme"))
    vectors = VectorAssembler(inputCols=["root_n", "goldstein"], outputCol="raw").transform(rows)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors).transform(vectors)
    if found < 2:
        placed = scaled.withColumn("cluster", F.lit(0))
    else:
        placed = KMeans(k=found, seed=seed, predictionCol="cluster").fit(scaled).transform(scaled)
    names = (
        placed.groupBy("cluster", "root", "theme")
        .count()
        .groupBy("cluster")
        .agg(F.min_by("theme", F.struct(-F.col("count"), "root")).alias("cluster_theme"))
    )
    return placed.join(F.broadcast(names), "cluster").select("event_id", "cluster", "cluster_theme")


SHUFFLES, SEEDS, LEAST_EVENTS = 2, 5, 10
CLUSTER_COUNTS = range(2, 7)


def rand_index(both: DataFrame, a: str, b: str, weight: str) -> float:
    """Adjusted Rand index of two labellings of weighted points, from the counts of their pairs of labels."""
    n = F.col("n")

    def pairs(*by: str) -> float:
        return both.groupBy(*by).agg(F.sum(weight).alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()[0]

    same, left, right, every = pairs(a, b), pairs(a), pairs(b), pairs()
    chance = left * right / every if every else 0.0
    return (same - chance) / ((left + right) / 2 - chance) if (left + right) / 2 != chance else 1.0


def cluster_quality(prepared: DataFrame, k: int = 4, seed: int = 42) -> dict:
    """Silhouette of the k-means themes over all events, that of shuffled labels, agreement over seeds, the best k.

    The silhouette is the library's, with squared distances. Shuffled labels
    have the clusters' sizes; agreement is the adjusted Rand index with the labels
    of other seeds. Under ten events, or without variation, there is a reason
    instead of figures. Events are prepared and stored once, and grouped once to different points with their number as weight, so
    that every fit and score runs on points; shuffled labels are drawn by event. The driver sees sums.
    """
    rows = _checkpointed(prepared.where("goldstein IS NOT NULL").select("event_id", F.col("root").cast("double").alias("root_n"), "goldstein"))
    points = _checkpointed(rows.groupBy("root_n", "goldstein").agg(F.count("*").cast("double").alias("w")))
    n, different = points.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.count("*")).first()
    if n < LEAST_EVENTS:
        return {"reason": "under ten events"}
    if different <= max(k, *CLUSTER_COUNTS):
        return {"reason": "no variation"}
    moments = rows.agg(*(f(c).alias(f"{c}_{m}") for c in ("root_n", "goldstein") for m, f in (("mean", F.avg), ("std", F.stddev_samp)))).first()
    axes = [(F.col(c) - moments[f"{c}_mean"]) / (moments[f"{c}_std"] or 1.0) for c in ("root_n", "goldstein")]
    scaled = points.select("root_n", "goldstein", "w", array_to_vector(F.array(*axes)).alias("features")).persist()

    def labelled(count: int, seed_: int, name: str = "cluster") -> KMeansModel:
        return KMeans(k=count, seed=seed_, predictionCol=name, weightCol="w").fit(scaled)

    def silhouette(df: DataFrame, name: str = "cluster") -> float:
        return ClusteringEvaluator(predictionCol=name, weightCol="w").evaluate(df)

    own = labelled(k, seed)
    placed = own.transform(scaled)
    sizes = [r["n"] for r in placed.groupBy("cluster").agg(F.sum("w").alias("n")).orderBy("cluster").collect()]
    bounds = [sum(sizes[: i + 1]) / sum(sizes) for i in range(len(sizes))]

    def shuffled(s: int) -> DataFrame:
        drawn = rows.withColumn("at", F.pmod(F.xxhash64("event_id", F.lit(s)), F.lit(1 << 30)) / float(1 << 30))
        label = sum((F.col("at") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
        dealt = drawn.groupBy("root_n", "goldstein", label.alias("cluster")).agg(F.count("*").cast("double").alias("w"))
        return dealt.join(scaled.drop("w"), ["root_n", "goldstein"])

    value = silhouette(placed)
    null = sum(silhouette(shuffled(s)) for s in range(SHUFFLES)) / SHUFFLES
    stability = sum(rand_index(labelled(k, seed + s, "other").transform(placed), "cluster", "other", "w") for s in range(1, SEEDS + 1)) / SEEDS
    sweep = {count: value if count == k else silhouette(labelled(count, seed).transform(scaled)) for count in CLUSTER_COUNTS}
    scaled.unpersist()
    bands = ((0.5, "strong"), (0.25, "reasonable"), (0.1, "weak"))
    return {
        "silhouette": value, "null": null, "stability": stability,
        "label": next((n for limit, n in bands if value >= limit), "none"), "weak": value < 0.1 or value <= null,
        "best_k": max(sweep, key=lambda c: (sweep[c], -c)),
    } | {f"silhouette_{c}": v for c, v in sweep.items()}
