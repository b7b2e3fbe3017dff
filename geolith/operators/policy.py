"""Policy operators over votes and conflict dyads.

Votes have (country_code, country_name, year, resolution, topic, vote, vote_numeric); dyads
(country_a, country_b, year, day, issue, deaths, relationship_type, conflict_name).
Vote vectors stay long: one row per country and resolution, never a wide pivot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1989, 2025
#: Vote agreement alone makes an edge from so many shared votes on, an ally from this rate on.
MIN_SHARED_VOTES, ALLY_RATE = 5, 0.66
#: Codes of sovereign states.
SOVEREIGN_CODES = (2, 920)


def vote_position(vote: Column) -> Column:
    """Y and N as 1 and -1; everything else, absence too, as 0 (the bloc measures' coding)."""
    return F.when(vote == "Y", 1.0).when(vote == "N", -1.0).otherwise(0.0)


def synthetic_code(name: Column) -> Column:
    """Code of a party without one, from the MD5 of its name."""
    return F.lit(10000) + F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint"), F.lit(900000))


def dedupe_votes(votes: DataFrame, order: str) -> DataFrame:
    """The vote with the largest ``order`` per country, year and resolution."""
    keys = ["country_code", "year", "resolution"]
    rest = [c for c in votes.columns if c not in keys]
    return votes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def vote_pairs(votes: DataFrame) -> DataFrame:
    """Every pair of countries with both votes in every resolution they share.

    A self join on (year, resolution): its size is the square of the voters of a
    resolution, of which there are 200 at most, times the resolutions.
    """
    v = votes.where("vote IS NOT NULL").select("year", "resolution", "country_name", "vote", "vote_numeric")
    a = v.select("year", "resolution", F.col("country_name").alias("a"), F.col("vote").alias("vote_a"))
    b = v.select("year", "resolution", F.col("country_name").alias("b"), F.col("vote").alias("vote_b"))
    return a.join(b, ["year", "resolution"]).where("a < b").withColumn(
        "same", (F.col("vote_a") == F.col("vote_b")).cast("int")
    )


def agreement(votes: DataFrame, *keys: str) -> DataFrame:
    """Shared and equal votes of every pair (and of ``keys``), and their rate."""
    return (
        vote_pairs(votes)
        .groupBy("a", "b", *keys)
        .agg(F.sum("same").alias("same"), F.count("*").alias("total"))
        .withColumn("rate", F.col("same") / F.col("total"))
    )


def temporal_agreement(votes: DataFrame) -> DataFrame:
    """Yearly agreement of the pairs that have at least two years."""
    years = F.count("*").over(Window.partitionBy("a", "b"))
    return agreement(votes, "year").withColumn("years", years).where("years >= 2").drop("years")


#: The matrix has a row for every two of so many voters at most.
MOST_VOTERS = 5000


def agreement_matrix(votes: DataFrame) -> DataFrame:
    """Mean yearly agreement for all ordered pairs of countries; 1 with itself, 0.5 without data."""
    mean = temporal_agreement(votes).groupBy("a", "b").agg(F.avg("rate").alias("rate"))
    both = mean.unionByName(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), "rate"))
    names = votes.select("country_name").distinct()
    if names.limit(MOST_VOTERS + 1).count() > MOST_VOTERS:
        raise ValueError(f"a matrix of more than {MOST_VOTERS} voters")
    grid = names.select(F.col("country_name").alias("a")).crossJoin(names.select(F.col("country_name").alias("b")))
    rate = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("rate", F.lit(0.5)))
    return grid.join(both, ["a", "b"], "left").select("a", "b", rate.alias("agreement"))


def compare(votes: DataFrame, a: str, b: str, recent: int = 100) -> DataFrame:
    """The most recent votes that two countries share, and whether they match."""
    left = votes.where(F.col("country_name") == a).select("year", "resolution", "topic", F.col("vote").alias("vote_a"))
    right = votes.where(F.col("country_name") == b).select("year", "resolution", F.col("vote").alias("vote_b"))
    return (
        left.join(right, ["year", "resolution"])
        .withColumn("match", F.col("vote_a") == F.col("vote_b"))
        .orderBy(F.desc("year"), F.desc("resolution"))
        .limit(recent)
    )


def vote_drift(yearly: DataFrame) -> DataFrame:
    """Mean agreement of a pair's last five years less that of its first five, and its direction."""
    up = Window.partitionBy("a", "b").orderBy("year")
    down = Window.partitionBy("a", "b").orderBy(F.desc("year"))
    ranked = yearly.withColumn("from_first", F.row_number().over(up)).withColumn("from_last", F.row_number().over(down))
    drift = 100 * (
        F.avg(F.when(F.col("from_last") <= 5, F.col("rate"))) - F.avg(F.when(F.col("from_first") <= 5, F.col("rate")))
    )
    label = F.when(F.col("drift") > 3, "converging").when(F.col("drift") < -3, "diverging").otherwise("stable")
    return ranked.groupBy("a", "b").agg(drift.alias("drift")).withColumn("direction", label)


def vote_vectors(votes: DataFrame, year: int, window: int = 7) -> DataFrame:
    """Mean position per country and resolution over the years [year - window, year]."""
    near = votes.where(F.col("year").between(year - window, year))
    return near.groupBy("country_name", "resolution").agg(F.avg(vote_position(F.col("vote"))).alias("x"))


def cosine_pairs(vectors: DataFrame, key: str, feature: str, value: str) -> DataFrame:
    """Cosine of every pair of long vectors that share a feature; others have none."""
    norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(value) ** 2)).alias("norm")).where("norm > 0")
    v = vectors.where(F.col(value) != 0).join(norm, key)
    a = v.select(F.col(key).alias("a"), feature, (F.col(value) / F.col("norm")).alias("x"))
    b = v.select(F.col(key).alias("b"), feature, (F.col(value) / F.col("norm")).alias("y"))
    return a.join(b, feature).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def anchor_blocs(vectors: DataFrame, anchors: dict[str, list[str]]) -> DataFrame:
    """Each country's bloc: the one whose anchors' mean direction is nearest by cosine.

    Ties go to the first bloc in order; anchors keep their own bloc, and their
    provenance says so.
    """
    spark = vectors.sparkSession
    order = list(anchors)
    table = spark.createDataFrame(
        [(c, b, order.index(b)) for b, members in anchors.items() for c in members],
        "country_name string, bloc string, bloc_order int",
    )
    norm = vectors.groupBy("country_name").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    unit = vectors.join(norm, "country_name").where("norm > 0").withColumn("u", F.col("x") / F.col("norm"))
    size = F.broadcast(
        unit.select("country_name").distinct().join(F.broadcast(table), "country_name").groupBy("bloc").count()
    )
    centre = (
        unit.join(F.broadcast(table), "country_name")
        .groupBy("bloc", "bloc_order", "resolution")
        .agg(F.sum("u").alias("s"))
        .join(size, "bloc")
        .withColumn("c", F.col("s") / F.col("count"))
    )
    length = centre.groupBy("bloc").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("length"))
    score = (
        unit.join(centre, "resolution")
        .groupBy("country_name", "bloc", "bloc_order")
        .agg(F.sum(F.col("u") * F.col("c")).alias("dot"))
        .join(length, "bloc")
        .withColumn("score", F.round(F.col("dot") / F.col("length"), 9))
    )
    best = score.groupBy("country_name").agg(
        F.max_by(F.struct("bloc", "score"), F.struct("score", -F.col("bloc_order"))).alias("best")
    )
    own = table.select("country_name", F.col("bloc").alias("own"))
    return best.join(F.broadcast(own), "country_name", "left").select(
        "country_name",
        F.coalesce("own", "best.bloc").alias("bloc"),
        F.col("best.score").alias("score"),
        F.when(F.col("own").isNotNull(), "anchor").otherwise("vote_model").alias("provenance"),
    )


def topics(votes: DataFrame, n: int = 100) -> DataFrame:
    return votes.groupBy("topic").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "topic").limit(n)


def topic_positions(votes: DataFrame) -> DataFrame:
    """Yes, no and abstain counts per country and topic, and the share of yes."""
    yes, no, abstain = (F.count_if(F.col("vote") == v) for v in ("Y", "N", "A"))
    return votes.groupBy("country_name", "topic").agg(
        yes.alias("yes"), no.alias("no"), abstain.alias("abstain"), (yes / (yes + no + abstain)).alias("pct_yes")
    )


def active_years(votes: DataFrame) -> DataFrame:
    """Each country's years with votes, as a sorted list."""
    return votes.groupBy("country_name").agg(
        F.array_join(F.sort_array(F.collect_set("year")).cast("array<string>"), ",").alias("active_years"),
        F.count("*").alias("votes"),
    )


def conflict_edges(dyads: DataFrame, vote_agreement: DataFrame | None = None) -> DataFrame:
    """One edge per pair: years, issues, conflicts, agreements, deaths, mean intensity, kind of relation.

    Conflict outranks peace partner, which outranks ally; pairs known from votes
    alone need five shared votes.
    """
    pair = (F.least("country_a", "country_b").alias("a"), F.greatest("country_a", "country_b").alias("b"))
    is_conflict = F.col("relationship_type") == "conflict"
    found = dyads.groupBy(*pair).agg(
        F.array_join(F.sort_array(F.collect_set("year")).cast("array<string>"), ",").alias("years"),
        F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("issues"),
        F.count_if(is_conflict).alias("conflict_count"),
        F.count_if(F.col("relationship_type") == "peace_partner").alias("peace_count"),
        F.sum(F.coalesce("deaths", F.lit(0.0))).alias("total_deaths"),
        F.avg(F.when(F.col("deaths") != 0, F.col("deaths"))).alias("avg_intensity"),
    )
    if vote_agreement is None:
        vote_agreement = dyads.sparkSession.createDataFrame([], "a int, b int, rate double, total long")
    known = vote_agreement.where(F.col("total") >= MIN_SHARED_VOTES).select("a", "b", "rate", "total")
    relation = (
        F.when(F.col("conflict_count") > 0, "conflict")
        .when(F.col("peace_count") > 0, "peace_partner")
        .when(F.col("rate") >= ALLY_RATE, "ally")
        .otherwise("neutral")
    )
    both = found.join(known, ["a", "b"], "full_outer").na.fill(0, ["conflict_count", "peace_count", "total_deaths"])
    return both.select(
        "a",
        "b",
        "years",
        "issues",
        "conflict_count",
        F.coalesce("total", F.lit(0).cast("long")).alias("agreements"),
        "total_deaths",
        "avg_intensity",
        F.col("rate").alias("un_agree_rate"),
        relation.alias("relationship_type"),
    )


def _sides(dyads: DataFrame) -> DataFrame:
    """Every dyad once for each of its countries."""
    return dyads.withColumn("country", F.explode(F.array("country_a", "country_b")))


def filter_edges(edges: DataFrame, issues: list[str], least_intensity: float = 0.0) -> DataFrame:
    """Edges of :func:`conflict_edges` that share an issue and reach a mean intensity; their ends are the nodes left."""
    wanted = F.array(*map(F.lit, issues)).cast("array<string>")
    return edges.where(
        F.arrays_overlap(F.split("issues", ","), wanted) & (F.coalesce("avg_intensity", F.lit(0.0)) >= least_intensity)
    )


def common_years(*frames: DataFrame) -> DataFrame:
    """Years that every frame has."""
    return reduce(lambda a, b: a.intersect(b), (f.select("year").where("year IS NOT NULL").distinct() for f in frames))


def timeline(dyads: DataFrame, *by: str) -> DataFrame:
    """Per country and ``by``: conflicts, deaths, deaths per conflict to one place."""
    rows = _sides(dyads.where("relationship_type = 'conflict'")).groupBy("country", *by)
    out = rows.agg(F.count("*").alias("conflicts"), F.sum("deaths").alias("deaths"))
    return out.withColumn("intensity", F.round(F.col("deaths") / F.col("conflicts"), 1))


def deaths_by(dyads: DataFrame, *by: str) -> DataFrame:
    return dyads.where("relationship_type = 'conflict'").groupBy(*by).agg(F.sum("deaths").alias("deaths"))


def new_conflicts(dyads: DataFrame, by: str) -> DataFrame:
    """Conflicts by when they first appear."""
    first = dyads.groupBy("conflict_name").agg(F.min(by).alias(by))
    return first.groupBy(by).agg(F.count("*").alias("new_conflicts"))


def issue_summary(dyads: DataFrame) -> DataFrame:
    """Counts of issues; a comma joins several in one row."""
    issue = F.explode(F.split("issue", ",")).alias("issue")
    return dyads.select(issue).select(F.trim("issue").alias("issue")).where("issue <> ''").groupBy("issue").agg(
        F.count("*").alias("n")
    )


def stance_matrix(dyads: DataFrame) -> DataFrame:
    """Counts by country and issue, with each issue's rank in its country."""
    counts = _sides(dyads).groupBy("country", "issue").agg(F.count("*").alias("n"), F.sum("deaths").alias("deaths"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "issue"))
    return counts.withColumn("rank", rank)


def co_activity(dyads: DataFrame) -> DataFrame:
    """Pairs of countries by the issues and days on which both were active.

    The number of common (issue, day) cells, which does not depend on row order.
    """
    cells = _sides(dyads).select("country", "issue", "day").distinct()
    a, b = cells.withColumnRenamed("country", "a"), cells.withColumnRenamed("country", "b")
    return a.join(b, ["issue", "day"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def graph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges (a, b) that one graph has and the other has not."""
    added = after.select("a", "b").distinct().join(before.select("a", "b"), ["a", "b"], "left_anti")
    removed = before.select("a", "b").distinct().join(after.select("a", "b"), ["a", "b"], "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def profile_partners(dyads: DataFrame, k: int = 5) -> DataFrame:
    """Each country's k most frequent counterparts."""
    sides = _sides(dyads).withColumn(
        "partner", F.when(F.col("country") == F.col("country_a"), F.col("country_b")).otherwise(F.col("country_a"))
    )
    counts = sides.groupBy("country", "partner").agg(F.count("*").alias("n"), F.sum("deaths").alias("deaths"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "partner"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def linear_forecast(series: DataFrame, key: str, t: str, y: str, window: int, horizon: int) -> DataFrame:
    """Line through the last ``window`` steps, carried on; never negative; trend beyond a tenth per step."""
    last = F.max(t).over(Window.partitionBy(key))
    fit = (
        series.withColumn("last_t", last)
        .where(F.col(t) >= F.col("last_t") - window)
        .groupBy(key)
        .agg(
            F.regr_slope(y, t).alias("slope"),
            F.regr_intercept(y, t).alias("intercept"),
            F.max("last_t").alias("last_t"),
            F.count("*").alias("n"),
        )
        .where("n >= 4")
    )
    trend = F.when(F.col("slope") > 0.1, "rising").when(F.col("slope") < -0.1, "falling").otherwise("stable")
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(
        key,
        "h",
        F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("last_t") + F.col("h"))).alias("forecast"),
        trend.alias("trend"),
    )


def discovered_blocs(vectors: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """Communities of the graph of similar voters, the largest first; countries without similar ones are left out."""
    from .graph import trade_blocs

    pairs = cosine_pairs(vectors, "country_name", "resolution", "x").where(F.col("cosine") >= min_similarity)
    edge = pairs.select(F.col("a").alias("exporter"), F.col("b").alias("importer"), F.col("cosine").alias("weight"))
    found = trade_blocs(edge)
    size = found.groupBy("bloc_id").agg(F.count("*").alias("members"), F.min("country").alias("first"))
    order = F.row_number().over(Window.orderBy(F.desc("members"), "first")).alias("cluster")
    return found.join(F.broadcast(size.select("bloc_id", "members", order)), "bloc_id").select("country", "cluster", "members")


def year_pivot(votes: DataFrame, years: list[int]) -> DataFrame:
    """Yes votes per country, a column for each of the given years."""
    yes = votes.where("vote = 'Y'").groupBy("country_name").pivot("year", years).agg(F.count("vote"))
    return yes.select("country_name", *(F.coalesce(F.col(f"`{y}`"), F.lit(0).cast("long")).alias(f"y{y}") for y in years))


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON document per edge, nulls included, ready for a JSON-lines sink."""
    return edges.select(F.to_json(F.struct(*edges.columns), {"ignoreNullFields": "false"}).alias("value"))
