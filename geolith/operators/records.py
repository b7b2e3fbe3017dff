"""Cleaning of raw records: years, parties, conflict tables, issue flags, actors, adjusted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.session import small

from .policy import FIRST_YEAR, LAST_YEAR, SOVEREIGN_CODES, synthetic_code

# Types of actors by their code.
ACTOR_TYPES = {
    "GOV": "government", "MIL": "military", "REB": "rebel", "OPP": "opposition", "INS": "insurgent", "COP": "police",
    "JUD": "judicial", "BUS": "business", "CRM": "criminal", "MED": "media", "NGO": "non-government",
    "IGO": "intergovernmental", "CVL": "civilian", "EDU": "education", "SEP": "separatist", "SPY": "intelligence",
    "UAF": "militant", "MNC": "corporate", "LEG": "legislative", "ELI": "elite", "REF": "refugee", "HRI": "human rights",
}

#: Where each dataset keeps its fields: the first filled column counts. A field in quotes is a constant.
CONFLICT_FIELDS = {
    "code_a": ["gwno_a", "gwnoa"], "label_a": ["side_a", "country"], "code_b": ["gwno_b", "gwnob"], "label_b": ["side_b"],
    "year": ["year", "date_start"], "intensity": ["intensity_level", "best", "bd_best"], "deaths": ["bd_best", "best"],
    "conflict_name": ["conflict_name", "location"], "dyad_id": ["dyad_id", "dyad_new_id"],
    "conflict_id": ["conflict_id", "conflict_new_id"], "relationship_type": ["'conflict'"],
    "issue": ["incompatibility_label", "incompatibility", "issue", "topic", "subjects", "agenda_title"],
}
DATASET_FIELDS = {
    "ucdp-prio-acd": {},
    "ucdp-dyadic": {},
    "ucdp-brd": {},
    "GED": {},
    "ucdp-candidate": {"code_a": ["country_id", "gwnoa"], "label_a": ["country"], "issue": ["conflict_name"], "intensity": ["best"], "deaths": ["best"]},
    "ucdp-nonstate": {
        "code_a": ["gwno_location"], "label_a": ["location"], "code_b": ["gwno_a_2nd", "gwno_b_2nd"],
        "label_b": ["side_a_name", "side_b_name"], "issue": ["'non-state conflict'"], "conflict_name": ["org"],
        "intensity": ["best_fatality_estimate"], "deaths": ["best_fatality_estimate"],
    },
    "ucdp-onesided": {
        "code_a": ["gwno_location", "gwnoa"], "label_a": ["location"], "code_b": [], "label_b": [],
        "issue": ["'one-sided violence'"], "conflict_name": ["actor_name"],
        "intensity": ["best_fatality_estimate"], "deaths": ["best_fatality_estimate"],
    },
    "ucdp-peace-agreements": {
        "code_a": ["gwno"], "label_a": ["actor_name"], "code_b": [], "label_b": [], "issue": ["'peace agreement'"],
        "conflict_name": ["conflict_name", "pa_name"], "intensity": ["'1'"], "deaths": ["'0'"],
        "relationship_type": ["'peace_partner'"],
    },
}


def filled(value: Column) -> Column:
    """Trimmed text; empty, "nan" and "none" are null."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none"), text)


def year_of(value: Column) -> Column:
    """A year from 1800 to 2100 out of a number, a date or a time in text."""
    text = filled(value)
    number = F.regexp_replace(text, r"\.0+$", "").try_cast("int")
    dated = F.year(F.coalesce(F.try_to_timestamp(text), F.try_to_date(text, "dd/MM/yyyy").cast("timestamp")))
    year = F.coalesce(number, dated)
    return F.when(year.between(1800, 2100), year)


def year_of_serial(days: Column) -> Column:
    """Year of a spreadsheet's day number."""
    return F.year(F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int")))


def resolve_parties(df: DataFrame, code: str, label: str, names: DataFrame, out: str) -> DataFrame:
    """``df`` with ``<out>_code`` and ``<out>``: a party by code, three-letter code or name, else a synthetic one.

    Of a comma list the first sovereign code counts. ``names`` (code, iso3,
    name, alias) is sent to all tasks if it is small, as a table of countries is;
    keys that no row matches are no error.
    """
    text = filled(F.col(code))
    listed = F.filter(
        F.transform(F.split(text, ","), lambda p: F.regexp_replace(F.trim(p), r"\.0+$", "").try_cast("int")),
        lambda c: c.isNotNull(),
    )
    several = F.contains(text, F.lit(","))
    number = F.when(several, F.get(F.filter(listed, lambda c: c.between(*SOVEREIGN_CODES)), F.lit(0))).otherwise(
        F.regexp_replace(text, r"\.0+$", "").try_cast("int")
    )
    word = F.coalesce(F.when(number.isNull(), text), filled(F.col(label)))
    by_code = small(names.groupBy(F.col("code").alias("__n")).agg(F.min("name").alias("__by_code")))
    words = names.select(F.explode(F.array(F.lower("iso3"), F.lower("alias"), F.lower("name"))).alias("__w"), "code", "name")
    by_word = small(words.where("__w IS NOT NULL").groupBy("__w").agg(F.min_by(F.struct("code", "name"), "code").alias("__by_word")))
    joined = (
        df.withColumns({"__n": number, "__word": word, "__w": F.lower(word)})
        .join(by_code, "__n", "left")
        .join(by_word, "__w", "left")
    )
    pretty = F.when(F.upper("__word") == F.col("__word"), F.initcap("__word")).otherwise(F.col("__word"))
    return joined.withColumns(
        {
            f"{out}_code": F.coalesce(
                "__n", "__by_word.code", F.when(F.col("__word").isNotNull(), synthetic_code(F.col("__w")).cast("int"))
            ),
            out: F.coalesce(F.when(F.col("__n").isNotNull(), F.coalesce("__by_code", "__word", F.col("__n").cast("string"))), "__by_word.name", pretty),
        }
    ).drop("__n", "__word", "__w", "__by_code", "__by_word")


def master_records(df: DataFrame, dataset: str, names: DataFrame) -> DataFrame:
    """A conflict dataset in the common layout; rows outside 1989 to 2025 are left out."""
    fields = CONFLICT_FIELDS | DATASET_FIELDS[dataset]

    def value(field: str) -> Column:
        found = [
            F.lit(c.strip("'")) if c.startswith("'") else filled(F.col(f"`{c}`"))
            for c in fields[field]
            if c.startswith("'") or c in df.columns
        ]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    plain = df.select(
        year_of(value("year")).alias("year"),
        *(value(f).alias(f) for f in ("code_a", "label_a", "code_b", "label_b", "issue", "conflict_name", "relationship_type")),
        *(value(f).try_cast("double").alias(f) for f in ("intensity", "deaths")),
        *(value(f).try_cast("int").alias(f) for f in ("dyad_id", "conflict_id")),
        F.lit(dataset).alias("dataset"),
        raw.alias("raw_row_json"),
    ).where(F.col("year").between(FIRST_YEAR, LAST_YEAR))
    both = resolve_parties(resolve_parties(plain, "code_a", "label_a", names, "country_a"), "code_b", "label_b", names, "country_b")
    return both.drop("code_a", "label_a", "code_b", "label_b")


def issue_flags(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(dyad_id, conflict_id, year, issues): named category columns if filled, else flag columns that are 1, decoded."""
    named = [c for c in df.columns if c.startswith(("ethnicity_", "geography_", "ideology_", "religion_"))]
    flags = [c for c in df.columns if c.isdigit()]
    texts = F.array_distinct(F.array_compact(F.array(*(filled(F.col(f"`{c}`")) for c in named)).cast("array<string>")))
    codes = F.array_distinct(
        F.array_compact(
            F.array(*(F.when(F.col(f"`{c}`").try_cast("double") == 1, labels.get(c, c)) for c in flags)).cast("array<string>")
        )
    )
    issues = F.when(F.size(texts) > 0, texts).otherwise(codes)
    return (
        df.select(F.col("dyad_id").try_cast("int").alias("dyad_id"), F.col("conflict_id").try_cast("int").alias("conflict_id"), year_of(F.col("year")).alias("year"), issues.alias("issues"))
        .where(F.col("year").between(FIRST_YEAR, LAST_YEAR) & (F.size("issues") > 0))
    )


def merge_issues(records: DataFrame, flags: DataFrame) -> DataFrame:
    """Records with the issues of their dyad, conflict and year; missing ids match missing ids."""
    issues = flags.groupBy("dyad_id", "conflict_id", "year").agg(
        F.array_join(F.array_distinct(F.flatten(F.collect_list("issues"))), ", ").alias("__issues")
    )
    renamed = issues.select(*(F.col(c).alias(f"__{c}") for c in ("dyad_id", "conflict_id", "year")), "__issues")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("dyad_id", "conflict_id", "year")]
    joined = records.join(renamed, same[0] & same[1] & same[2], "left")
    return joined.withColumn("issue", F.coalesce("__issues", "issue")).select(*records.columns)


def sovereign(df: DataFrame, code: str) -> DataFrame:
    return df.where(F.col(code).between(*SOVEREIGN_CODES))


def topic_of(subjects: Column, agenda: Column, title: Column) -> Column:
    return F.coalesce(filled(subjects), filled(agenda), filled(title))


def describe_actor(country: Column, type_code: Column) -> Column:
    """Words for an actor without a name, from its country and type."""
    kinds = F.create_map(*(F.lit(x) for pair in ACTOR_TYPES.items() for x in pair))
    kind = F.element_at(kinds, F.coalesce(F.upper(filled(type_code)), F.lit("")))
    place = filled(country)
    return (
        F.when(place.isNotNull() & kind.isNotNull(), F.concat(F.lit("a "), kind, F.lit(" source in "), place))
        .when(place.isNotNull(), F.concat(F.lit("an unnamed party from "), place))
        .when(kind.isNotNull(), F.concat(F.lit("a "), kind, F.lit(" source")))
        .otherwise("an unidentified party")
    )


def governance_penalty(freedom: Column) -> Column:
    """0 from 70 points on, rising to 8 at 40 and to 15 at 0; unknown scores lose nothing."""
    return (
        F.when(freedom.isNull() | F.isnan(freedom) | (freedom >= 70), 0.0)
        .when(freedom >= 40, F.round((70 - freedom) / 30 * 8.0, 2))
        .otherwise(F.round(8.0 + (40 - freedom) / 40 * 7.0, 2))
    )


def adjusted_scores(df: DataFrame) -> DataFrame:
    """Scores less the governance penalty, plus 3 for wealth above 75 with a score under 65; interval widened."""

    def bounded(c: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 2)

    with_parts = df.withColumns(
        {
            "governance_penalty": governance_penalty(F.col("freedom")),
            "wealth_bonus": F.when((F.col("wealth_score") > 75) & (F.col("score") < 65), 3.0).otherwise(0.0),
        }
    )
    return with_parts.withColumns(
        {
            "adjusted_score": bounded(F.col("score") - F.col("governance_penalty") + F.col("wealth_bonus")),
            "adj_ci_lower": bounded(F.col("ci_lower") - F.col("governance_penalty") * 0.5),
            "adj_ci_upper": bounded(F.col("ci_upper") + 1.5),
        }
    )


def without(df: DataFrame, excluded: DataFrame, key: str = "iso3") -> DataFrame:
    return df.join(small(excluded.select(key).distinct()), key, "left_anti")


def terciles(df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``tercile``, low, medium or high by the thirds of ``score``; cuts are right-closed, rows without a score have none."""
    cuts = df.agg(F.percentile(score, [1 / 3, 2 / 3]).alias("cuts"))
    band = F.when(F.col(score) <= F.get("cuts", F.lit(0)), "low").when(F.col(score) <= F.get("cuts", F.lit(1)), "medium").when(F.col(score).isNotNull(), "high")
    return df.crossJoin(F.broadcast(cuts)).withColumn("tercile", band).drop("cuts")
