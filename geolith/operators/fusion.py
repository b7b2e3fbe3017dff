"""Insights of several agents, fused into ranked findings.

An insight is a row (agent, entity_iso3, facet, sector, pair, claim, score, confidence, reason, caveat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CORROBORATED = 0.97
KIND_WEIGHTS = {"divergence": 1.35, "corroboration": 1.2, "cross_agent": 1.1, "insight": 1.0}
PRIMARY_BOOST, FOCUS_BOOST, OFF_FOCUS, CAVEAT_LOSS = 1.3, 1.1, 0.7, 0.85


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def invalid_insights(insights: DataFrame) -> DataFrame:
    """Rows that break the contract, with the reason."""
    problem = (
        F.when(F.col("agent").isNull(), "no agent")
        .when(F.coalesce(F.trim("claim"), F.lit("")) == "", "no claim")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence outside 0..1")
        .when(F.col("score").isNull() | F.isnan("score"), "no score")
    )
    return insights.withColumn("problem", problem).where("problem IS NOT NULL")


def dedupe_insights(insights: DataFrame) -> DataFrame:
    """Per agent, entity, facet, sector and pair the most confident insight, ties by claim."""
    keys = ["agent", "entity_iso3", "facet", "sector", "pair"]
    rest = [c for c in insights.columns if c not in keys]
    best = insights.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), "claim")).alias("i"))
    return best.select(*keys, "i.*")


def noisy_or(confidence: Column) -> Column:
    """1 minus the product of what each leaves open, capped; certain ones are guarded."""
    left = F.greatest(1 - confidence, F.lit(1e-9))
    return F.least(F.lit(MAX_CORROBORATED), 1 - F.exp(F.sum(F.log(left))))


def corroborations(insights: DataFrame) -> DataFrame:
    """Entity and facet on which two agents or more report: their confidences combined."""
    per_agent = insights.groupBy("entity_iso3", "facet", "agent").agg(F.max("confidence").alias("c"))
    return (
        per_agent.groupBy("entity_iso3", "facet")
        .agg(
            noisy_or(F.col("c")).alias("confidence"),
            F.array_join(F.sort_array(F.collect_list("agent")), ",").alias("agents"),
            F.count("*").alias("n_agents"),
        )
        .where("n_agents >= 2")
        .withColumn("kind", F.lit("corroboration"))
    )


def divergences(trade_blocs: DataFrame, policy_blocs: DataFrame) -> DataFrame:
    """Countries whose trade bloc and policy bloc differ; confidence is the smaller one.

    Both tables have (entity_iso3, bloc, confidence), blocs named alike.
    """
    t = trade_blocs.select("entity_iso3", F.col("bloc").alias("trade_bloc"), F.col("confidence").alias("tc"))
    p = policy_blocs.select("entity_iso3", F.col("bloc").alias("policy_bloc"), F.col("confidence").alias("pc"))
    return t.join(p, "entity_iso3").select(
        "entity_iso3",
        "trade_bloc",
        "policy_bloc",
        F.when(F.col("trade_bloc") == F.col("policy_bloc"), "corroboration").otherwise("divergence").alias("kind"),
        F.when(
            F.col("trade_bloc") == F.col("policy_bloc"),
            F.least(F.lit(MAX_CORROBORATED), 1 - (1 - F.col("tc")) * (1 - F.col("pc"))),
        )
        .otherwise(F.least("tc", "pc"))
        .alias("confidence"),
    )


def rank_findings(findings: DataFrame, primary_facets: list[str], focus: list[str], focus_agent: str | None = None) -> DataFrame:
    """Findings (kind, entity_iso3, facet, agents, confidence, caveat) with rank score and position.

    Cross findings come first; single insights weigh by focus, facet and agent.
    """
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WEIGHTS.items()), F.lit(1.0))
    primary = F.when(F.col("facet").isin(primary_facets), PRIMARY_BOOST).otherwise(1.0)
    single = F.col("kind") == "insight"
    in_focus = F.when(F.col("entity_iso3").isin(focus), 1.0).otherwise(OFF_FOCUS) if focus else F.lit(1.0)
    agent = F.when(F.col("agents") == focus_agent, FOCUS_BOOST).otherwise(1.0) if focus_agent else F.lit(1.0)
    caveat = F.when(F.col("caveat").isNotNull(), CAVEAT_LOSS).otherwise(1.0)
    score = F.col("confidence") * primary * F.when(single, in_focus * agent).otherwise(weight * caveat)
    scored = findings.withColumn("rank_score", F.round(score, 9)).withColumn("cross", (~single).cast("int"))
    order = Window.orderBy(F.desc("cross"), F.desc("rank_score"), "entity_iso3", "facet", "agents", "kind")
    return scored.withColumn("position", F.row_number().over(order)).drop("cross")


def assess_confidence(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the components and the limiting one, the first of equals."""
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    named = F.array(*(F.struct(F.round(c, 9).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)))
    return parts.withColumn("confidence", mean).withColumn("limiting", F.array_min(named)["name"])


def plan_scores(scored: DataFrame) -> DataFrame:
    """Per split: exact-match share, precision, recall and F1 of entities, Brier score, median and 95th latency.

    ``scored`` has split, exact, hit, predicted, gold, understanding, ms per question.
    """
    precision = F.when(F.sum("predicted") > 0, F.sum("hit") / F.sum("predicted")).otherwise(0.0)
    recall = F.when(F.sum("gold") > 0, F.sum("hit") / F.sum("gold")).otherwise(0.0)
    out = scored.groupBy("split").agg(
        F.avg(F.col("exact").cast("int")).alias("exact_match"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.avg((F.col("understanding") - F.col("exact").cast("int")) ** 2).alias("brier"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def briefing(findings: DataFrame, lines: int = 5) -> str:
    """The first findings as numbered lines with their sources; only they reach the driver."""
    rows = findings.orderBy("position").limit(lines).collect()
    return "\n".join(
        f"{r['position']}. {r['entity_iso3']} ({r['facet']}): {r['kind']}, confidence {r['confidence']:.2f} [{r['agents']}]"
        for r in rows
    )


def citation_rate(findings: DataFrame) -> DataFrame:
    """Share of findings, by kind, that name an agent as their source."""
    cited = F.coalesce(F.trim("agents") != "", F.lit(False))
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.avg(cited.cast("int")).alias("cited"))


def best_evidence(insights: DataFrame, agent: str, facet: str, prefix: str) -> DataFrame:
    """An agent's most confident insight of a facet per entity: score, confidence and claim under a prefix."""
    mine = insights.where((F.col("agent") == agent) & (F.col("facet") == facet))
    best = mine.groupBy("entity_iso3").agg(
        F.min_by(F.struct("score", "confidence", "claim"), F.struct(-F.col("confidence"), "claim")).alias("e")
    )
    return best.select("entity_iso3", *(F.col(f"e.{c}").alias(f"{prefix}_{c}") for c in ("score", "confidence", "claim")))


def critical_partners(trade: DataFrame, relations: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Partners an entity depends on by a share and with whom relations are in conflict.

    ``trade`` has (entity_iso3, partner, share, confidence), ``relations`` (entity_iso3, partner, relation, confidence).
    """
    joined = trade.where(F.col("share") >= least_share).join(
        relations.withColumnRenamed("confidence", "rc"), ["entity_iso3", "partner"]
    )
    return joined.where("relation = 'conflict'").select(
        "entity_iso3", "partner", "share", F.lit("cross_agent").alias("kind"), F.least("confidence", "rc").alias("confidence")
    )


def momentum_check(influence: DataFrame, blocs: DataFrame) -> DataFrame:
    """Rising or falling influence set beside an entity's bloc: (entity_iso3, trend, confidence) and (entity_iso3, bloc, confidence)."""
    joined = influence.where("trend <> 'stable'").join(blocs.withColumnRenamed("confidence", "bc"), "entity_iso3")
    return joined.select(
        "entity_iso3", "trend", "bloc", F.lit("cross_agent").alias("kind"), F.least("confidence", "bc").alias("confidence")
    )


def event_friction(partners: DataFrame, baseline: DataFrame, least_events: int = 3) -> DataFrame:
    """Days whose tone departs from a dyad's history.

    ``partners`` has (dyad, events, mean_goldstein, confidence), ``baseline`` (dyad, mean); enough events
    with a tone of one or more in size, against a baseline beyond a tenth of the other sign.
    """
    strong = partners.where((F.col("events") >= least_events) & (F.abs("mean_goldstein") >= 1))
    joined = strong.join(baseline, "dyad").where(F.abs("mean") >= 0.1)
    agrees = F.signum("mean_goldstein") == F.signum("mean")
    return joined.select(
        "dyad", "events", "mean_goldstein", "mean", F.when(agrees, "corroboration").otherwise("divergence").alias("kind"), "confidence"
    )


def bilateral_tension(dependence: DataFrame, agreement: DataFrame) -> DataFrame:
    """Pairs in which one side depends by a tenth or more while they vote alike in under half of all votes."""
    joined = dependence.where("dependence >= 0.10").join(agreement, ["a", "b"]).where("match_rate < 50")
    return joined.select("a", "b", "dependence", "match_rate", F.lit("divergence").alias("kind"), F.least("dc", "ac").alias("confidence"))


def shock_camps(impacts: DataFrame, blocs: DataFrame) -> DataFrame:
    """How a shock's impact falls on blocs: mean and number hit; confidence at most 0.75."""
    joined = impacts.where("impact > 0").join(blocs, "entity_iso3")
    return joined.groupBy("bloc").agg(
        F.avg("impact").alias("mean_impact"), F.count("*").alias("hit"), F.least(F.lit(0.75), F.min("confidence")).alias("confidence")
    )
