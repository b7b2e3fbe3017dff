"""Uploaded tables of unknown layout: inferred roles of columns, long form, normalised stance rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which a column's role is known.
ROLES = {
    "country": r"^(country|nation|state|iso3?|ccode|country_name|gwno.*)$",
    "year": r"^(year|yr|date)$",
    "issue": r"^(issue|topic|resolution|subject|incompatibility)$",
    "stance": r"^(stance|vote|position|ms_vote|value)$",
    "intensity": r"^(intensity|intensity_level|severity)$",
    "partner": r"^(partner|country_b|side_b|target|counterpart)$",
}
WIDE_COUNTRIES, BINARY_CAP, EXTRAS = 8, 80, 10


def _key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def infer_schema(df: DataFrame, countries: set[str]) -> dict:
    """Roles of columns by name, the year column also by content, and country columns of a wide table.

    One aggregation profiles all columns.
    """
    roles = {role: next((c for c in df.columns if re.match(p, _key(c))), None) for role, p in ROLES.items()}
    shares = df.agg(
        *(F.avg(F.coalesce(F.col(f"`{c}`").try_cast("int").between(1800, 2100), F.lit(False)).cast("int")).alias(f"c{i}") for i, c in enumerate(df.columns))
    ).first()
    if roles["year"] is None:
        roles["year"] = next((c for i, c in enumerate(df.columns) if (shares[i] or 0) > 0.85), None)
    wide = [c for c in df.columns if _key(c) in {_key(x) for x in countries}]
    return {"roles": {k: v for k, v in roles.items() if v}, "wide": wide if len(wide) >= WIDE_COUNTRIES else []}


def binary_columns(df: DataFrame, candidates: list[str]) -> list[str]:
    """Columns whose values are 0 and 1, both present; the first 80 of them."""
    if not candidates:
        return []
    value = {c: F.col(f"`{c}`").try_cast("double") for c in candidates}
    row = df.agg(
        *(
            ((F.min(v) == 0) & (F.max(v) == 1) & (F.count_if(~F.coalesce(v.isin(0.0, 1.0), F.lit(True))) == 0)).alias(f"c{i}")
            for i, v in enumerate(value.values())
        )
    ).first()
    return [c for i, c in enumerate(candidates) if row[i]][:BINARY_CAP]


def wide_to_long(df: DataFrame, countries: list[str], name: str = "country", value: str = "stance") -> DataFrame:
    """One row per country column that has a value."""
    ids = [c for c in df.columns if c not in countries]
    typed = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in countries else F.col(f"`{c}`") for c in df.columns))
    return typed.unpivot(ids, countries, name, value).where(F.col(value).isNotNull() & (F.trim(value) != ""))


def stance_score(stance: Column) -> Column:
    """Votes and words as 1, 0 or -1; numbers as they are, cut to that range."""
    s = F.lower(F.trim(stance.cast("string")))
    return (
        F.when(s.isin("y", "yes", "support", "for", "approve", "agree", "positive"), 1.0)
        .when(s.isin("n", "no", "oppose", "against", "reject", "disagree", "negative"), -1.0)
        .when(s.isin("a", "abstain", "neutral", "x", "absent"), 0.0)
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.try_cast("double"))))
    )


def interaction_type(dataset: Column, score: Column) -> Column:
    """Kind of relation by the dataset's name, else by the score."""
    d = F.lower(dataset)
    return (
        F.when(F.rlike(d, F.lit("conflict|war|battle|dispute")), "conflict")
        .when(F.rlike(d, F.lit("ally|alliance|treaty|peace")), "cooperation")
        .when(score > 0, "support")
        .when(score < 0, "opposition")
        .otherwise("neutral")
    )


def normalise(df: DataFrame, dataset: str, countries: set[str]) -> DataFrame:
    """Stance rows: dataset, country, partner, year, issue, stance, score, intensity, interaction, extra features."""
    found = infer_schema(df, countries)
    rows = wide_to_long(df, found["wide"]) if found["wide"] else df
    roles = dict(found["roles"]) | ({"country": "country", "stance": "stance"} if found["wide"] else {})
    extras = [c for c in rows.columns if c not in roles.values()][:EXTRAS]

    def column(role: str, kind: str = "string") -> Column:
        return F.col(f"`{roles[role]}`").try_cast(kind) if role in roles else F.lit(None).cast(kind)

    year = F.regexp_extract(F.coalesce(column("year"), F.lit("")), r"((?:18|19|20)\d{2})", 1).try_cast("int")
    features = F.map_filter(
        F.create_map(*(x for c in extras for x in (F.lit(c), F.col(f"`{c}`").cast("string")))) if extras else F.create_map().cast("map<string,string>"),
        lambda k, v: v.isNotNull(),
    )
    score = stance_score(column("stance"))
    return rows.select(
        F.lit(dataset).alias("dataset"), column("country").alias("country"), column("partner").alias("partner"),
        year.alias("year"), F.coalesce(column("issue"), F.lit("general")).alias("issue"), column("stance").alias("stance"),
        score.alias("score"), column("intensity", "double").alias("intensity"),
        interaction_type(F.lit(dataset), score).alias("interaction"), features.alias("extra_features"),
    ).where("country IS NOT NULL")
