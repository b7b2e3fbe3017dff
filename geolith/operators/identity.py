"""Countries by whatever identifier: number, two or three letters, name or alias; suggestions for misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.session import small

MIN_LIKENESS, SUGGESTIONS = 0.6, 3
#: Misspelt names are compared with so many names at most.
MOST_NAMES = 5000


def lookup_table(countries: DataFrame) -> DataFrame:
    """(key, country_code, country_name, iso3, priority): one row per identifier of each country.

    ``countries`` has country_code, country_name, country_iso2, country_iso3 and aliases.
    """
    keys = F.array(
        *(
            F.struct(F.lower(F.trim(F.col(c).cast("string"))).alias("key"), F.lit(i).alias("priority"))
            for i, c in enumerate(("country_code", "country_iso3", "country_iso2", "country_name"))
        )
    )
    aliases = F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda a: F.struct(F.lower(F.trim(a)).alias("key"), F.lit(4).alias("priority")),
    )
    named = countries.select(F.explode(F.concat(keys, aliases)).alias("k"), "country_code", "country_name", F.col("country_iso3").alias("iso3"))
    return named.select("k.key", "k.priority", "country_code", "country_name", "iso3").where("key IS NOT NULL AND key <> ''")


def resolve(asked: DataFrame, countries: DataFrame, text: str) -> DataFrame:
    """``asked`` with country_code, country_name and iso3 of what ``text`` names; null if nothing does."""
    table = lookup_table(countries)
    best = table.groupBy("key").agg(F.min_by(F.struct("country_code", "country_name", "iso3"), F.struct("priority", "country_name")).alias("c"))
    key = F.lower(F.trim(F.col(text)))
    joined = asked.withColumn("key", key).join(small(best), "key", "left")
    return joined.select(*(F.col(c) for c in asked.columns), "c.country_code", "c.country_name", "c.iso3")


def suggest(missed: DataFrame, countries: DataFrame, text: str) -> DataFrame:
    """Up to three likely names for each unknown text: by edit likeness of 0.6 or more, else those that contain it.

    Every text meets every country, a few hundred names.
    """
    if countries.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names to compare with")
    names = F.broadcast(countries.select("country_name"))
    wanted, name = F.lower(F.trim(F.col(text))), F.lower("country_name")
    likeness = 1 - F.levenshtein(wanted, name) / F.greatest(F.length(wanted), F.length(name), F.lit(1))
    pairs = missed.select(text).distinct().crossJoin(names).withColumns({"likeness": likeness, "inside": F.contains(name, wanted)})
    good = (F.col("likeness") >= MIN_LIKENESS).cast("int")
    any_good = F.max(good).over(Window.partitionBy(text))
    rank = F.row_number().over(Window.partitionBy(text).orderBy(F.desc("likeness"), "country_name"))
    kept = pairs.withColumn("any_good", any_good).where(
        ((F.col("any_good") == 1) & (good == 1)) | ((F.col("any_good") == 0) & F.col("inside"))
    )
    return (
        kept.withColumn("rank", rank)
        .where(F.col("rank") <= SUGGESTIONS)
        .groupBy(text)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "country_name"))), lambda x: x["country_name"]), ", ").alias("suggestions"))
    )
