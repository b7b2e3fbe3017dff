"""Trade operators over flows (exporter, importer, year, sector, trade_value).

Ties are broken by name everywhere. Edge tables have (exporter, importer, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs in which neither side depends by this share are left out.
MIN_DEPENDENCE = 0.005
SECTORS = ("agriculture", "electronics", "energy")


def clean_flows(flows: DataFrame) -> DataFrame:
    """Trimmed names, empty ones and "nan"/"None" as null; null, negative and self flows dropped."""

    def name(c: str) -> Column:
        trimmed = F.trim(F.col(c))
        return F.when(~trimmed.isin("", "nan", "None"), trimmed)

    out = flows.withColumns(
        {
            "exporter": name("exporter"),
            "importer": name("importer"),
            "year": F.col("year").try_cast("int"),
            "trade_value": F.col("trade_value").try_cast("double"),
            "sector": F.coalesce(F.lower(F.trim("sector")), F.lit("other")),
        }
    )
    return out.where(
        "exporter IS NOT NULL AND importer IS NOT NULL AND exporter <> importer AND year > 0 AND trade_value >= 0"
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def of_year(flows: DataFrame, year: int | None = None) -> DataFrame:
    """Flows of one year, by default the latest; a year outside the data is an error that names its range."""
    low, high = flows.agg(F.min("year"), F.max("year")).first()
    year = high if year is None else year
    if low is None or not low <= year <= high:
        raise ValueError(f"no data for {year}: the data covers {low} to {high}")
    return flows.where(F.col("year") == year)


def of_sector(flows: DataFrame, sector: str | None) -> DataFrame:
    wanted = (sector or "all").strip().lower()
    if wanted == "all":
        return flows
    if wanted not in SECTORS:
        raise ValueError(f"unknown sector {sector!r}: one of all, {', '.join(SECTORS)}")
    return flows.where(F.col("sector") == wanted)


def edges(flows: DataFrame, *keys: str) -> DataFrame:
    """Weighted directed edges; parallel flows are summed."""
    return flows.groupBy(*keys, "exporter", "importer").agg(F.sum("trade_value").alias("weight"))


def sector_rollup(flows: DataFrame) -> DataFrame:
    """Edges per year for every named sector and for "all" (which includes "other").

    One pass: grouping sets expand each partial row to at most two.
    """
    grouped = flows.groupingSets(
        [["exporter", "importer", "year", "sector"], ["exporter", "importer", "year"]],
        "exporter",
        "importer",
        "year",
        "sector",
    ).agg(F.sum("trade_value").alias("trade_value"), F.count("*").alias("n_flows"), F.grouping("sector").alias("total"))
    return (
        grouped.withColumn("sector", F.when(F.col("total") == 1, "all").otherwise(F.col("sector")))
        .where("sector <> 'other'")
        .drop("total")
    )


def country_year_totals(flows: DataFrame) -> DataFrame:
    """Exports, imports, partners and dependence ratios per country, year and sector."""
    keys = ["country", "year", "sector"]
    out = flows.groupBy(F.col("exporter").alias("country"), "year", "sector").agg(
        F.sum("trade_value").alias("exports"), F.count_distinct("importer").alias("export_partners")
    )
    into = flows.groupBy(F.col("importer").alias("country"), "year", "sector").agg(
        F.sum("trade_value").alias("imports"), F.count_distinct("exporter").alias("import_partners")
    )
    both = out.join(into, keys, "full_outer").na.fill(0)
    total = F.col("exports") + F.col("imports")
    return both.withColumns(
        {
            "trade_total": total,
            "import_dependency_ratio": F.when(total > 0, F.col("imports") / total).otherwise(0.0),
            "export_dependency_ratio": F.when(total > 0, F.col("exports") / total).otherwise(0.0),
        }
    )


def country_features(edge: DataFrame, *keys: str) -> DataFrame:
    """Imports, exports, total and import dependence of every country of a graph."""
    sides = edge.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("exporter").alias("country"), F.col("weight").alias("x"), F.lit(0.0).alias("m")),
                F.struct(F.col("importer").alias("country"), F.lit(0.0).alias("x"), F.col("weight").alias("m")),
            )
        ).alias("s"),
    )
    out = sides.groupBy(*keys, "s.country").agg(F.sum("s.x").alias("exports"), F.sum("s.m").alias("imports"))
    total = F.col("exports") + F.col("imports")
    return out.withColumns(
        {
            "trade_total": total,
            "import_dependency_ratio": F.when(total > 0, F.col("imports") / total).otherwise(0.0),
        }
    )


def data_quality(flows: DataFrame) -> DataFrame:
    """Per year and sector: shares of rows with all required values, with a value, with a quantity."""
    complete = F.col("exporter").isNotNull() & F.col("importer").isNotNull() & F.col("trade_value").isNotNull()
    has = "quantity" in flows.columns
    return flows.groupBy("year", "sector").agg(
        F.avg(complete.cast("int")).alias("required_ratio"),
        F.avg(F.col("trade_value").isNotNull().cast("int")).alias("value_ratio"),
        (F.avg((F.col("quantity") > 0).cast("int")) if has else F.lit(None).cast("double")).alias("quantity_ratio"),
        F.count("*").alias("row_count"),
    )


def quality_overall(quality: DataFrame) -> DataFrame:
    """The ratios over all years: means weighted by rows."""
    rows = F.col("row_count")
    return quality.groupBy("sector").agg(
        *((F.sum(F.col(c) * rows) / F.sum(rows)).alias(c) for c in ("required_ratio", "value_ratio", "quantity_ratio")),
        F.sum(rows).alias("row_count"),
    )


def partner_totals(edge: DataFrame, *keys: str) -> DataFrame:
    """Two-way trade of every country with every partner."""
    sides = F.array(
        F.struct(F.col("exporter").alias("country"), F.col("importer").alias("partner")),
        F.struct(F.col("importer").alias("country"), F.col("exporter").alias("partner")),
    )
    return (
        edge.select(*keys, F.explode(sides).alias("s"), "weight")
        .groupBy(*keys, "s.country", "s.partner")
        .agg(F.sum("weight").alias("partner_total"))
    )


def concentration(edge: DataFrame, *keys: str, top_n: int = 3) -> DataFrame:
    """Partner concentration: share of the top partners, HHI, partner count, top partners in order.

    Both directions are summed before squaring. Countries without positive
    trade have HHI and share 0.
    """
    groups = [*keys, "country"]
    ranked = partner_totals(edge, *keys).withColumn(
        "rn", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("partner_total"), "partner"))
    )
    out = ranked.groupBy(*groups).agg(
        F.sum("partner_total").alias("total"),
        F.sum(F.when(F.col("rn") <= top_n, F.col("partner_total")).otherwise(0.0)).alias("top_total"),
        F.sum(F.col("partner_total") ** 2).alias("squares"),
        F.count("*").alias("partner_count"),
        F.sort_array(F.collect_list(F.when(F.col("rn") <= top_n, F.struct("rn", "partner")))).alias("top"),
    )
    positive = F.col("total") > 0
    return out.select(
        *groups,
        F.when(positive, F.col("top_total") / F.col("total")).otherwise(0.0).alias("trade_concentration"),
        F.when(positive, F.col("squares") / F.col("total") ** 2).otherwise(0.0).alias("hhi"),
        "partner_count",
        F.array_join(F.transform("top", lambda t: t["partner"]), ", ").alias("top_partners"),
    )


def bilateral_totals(edge: DataFrame) -> DataFrame:
    return edge.groupBy(
        F.least("exporter", "importer").alias("country_a"), F.greatest("exporter", "importer").alias("country_b")
    ).agg(F.sum("weight").alias("bilateral_trade"))


def country_totals(edge: DataFrame) -> DataFrame:
    return partner_totals(edge).groupBy("country").agg(F.sum("partner_total").alias("total"))


def leverage_pairs(edge: DataFrame, min_share: float = MIN_DEPENDENCE, min_trade: float = 0.0) -> DataFrame:
    """Who depends more on whom: the holder is the less dependent side, the first by name when equal.

    ``exposure_ratio`` is infinite where the holder does not depend at all.
    """
    totals = country_totals(edge)
    a = totals.select(F.col("country").alias("country_a"), F.col("total").alias("total_a"))
    b = totals.select(F.col("country").alias("country_b"), F.col("total").alias("total_b"))
    dep_a, dep_b = F.col("bilateral_trade") / F.col("total_a"), F.col("bilateral_trade") / F.col("total_b")
    pairs = (
        bilateral_totals(edge)
        .where(F.col("bilateral_trade") >= min_trade)
        .join(a, "country_a")
        .join(b, "country_b")
        .where("total_a > 0 AND total_b > 0")
        .withColumns({"dep_a": dep_a, "dep_b": dep_b})
        .where(F.greatest("dep_a", "dep_b") >= min_share)
    )
    a_holds = F.col("dep_a") <= F.col("dep_b")
    out = pairs.select(
        F.when(a_holds, F.col("country_a")).otherwise(F.col("country_b")).alias("holder"),
        F.when(a_holds, F.col("country_b")).otherwise(F.col("country_a")).alias("exposed"),
        "bilateral_trade",
        F.least("dep_a", "dep_b").alias("holder_dependence"),
        F.greatest("dep_a", "dep_b").alias("exposed_dependence"),
    )
    return out.withColumns(
        {
            "asymmetry": F.col("exposed_dependence") - F.col("holder_dependence"),
            "exposure_ratio": F.when(
                F.col("holder_dependence") > 0, F.col("exposed_dependence") / F.col("holder_dependence")
            ).otherwise(float("inf")),
        }
    )


def country_leverage(edge: DataFrame, min_share: float = MIN_DEPENDENCE, min_trade: float = 0.0) -> DataFrame:
    """Leverage held and exposure of each country, and its most critical partner over all pairs."""
    sides = leverage_pairs(edge, min_share, min_trade).select(
        F.explode(
            F.array(
                F.struct(F.col("holder").alias("country"), F.col("asymmetry").alias("held"), F.lit(0.0).alias("exposed")),
                F.struct(F.col("exposed").alias("country"), F.lit(0.0).alias("held"), F.col("asymmetry").alias("exposed")),
            )
        ).alias("s"),
        F.col("holder"),
    )
    sums = sides.groupBy("s.country").agg(
        F.sum("s.held").alias("leverage_held"),
        F.sum("s.exposed").alias("leverage_exposed"),
        F.count_if(F.col("s.country") == F.col("holder")).alias("holds_over"),
        F.count_if(F.col("s.country") != F.col("holder")).alias("exposed_to"),
    )
    totals = country_totals(edge)
    partners = partner_totals(edge).join(totals, "country").where("total > 0")
    critical = partners.groupBy("country").agg(
        F.min_by("partner", F.struct(-F.col("partner_total"), "partner")).alias("critical_partner"),
        (F.max("partner_total") / F.first("total")).alias("critical_dependence"),
    )
    return critical.join(sums, "country", "left").na.fill(0).withColumn(
        "net_leverage", F.col("leverage_held") - F.col("leverage_exposed")
    )


def leverage_profile(pairs: DataFrame, country: str, k: int = 5) -> DataFrame:
    """The k strongest pairs a country holds and the k it is exposed in."""
    held = pairs.where(F.col("holder") == country).orderBy(F.desc("asymmetry"), "exposed").limit(k)
    exposed = pairs.where(F.col("exposed") == country).orderBy(F.desc("asymmetry"), "holder").limit(k)
    return held.withColumn("side", F.lit("holds")).unionByName(exposed.withColumn("side", F.lit("exposed")))


def sector_fragility(flows: DataFrame) -> DataFrame:
    """Import fragility by sector: 0.6 of the suppliers' HHI plus 0.4 of the sector's share of imports.

    Reliance counts named sectors only; the supplier pool is the number of
    countries that export in the sector.
    """
    named = flows.where(F.col("sector").isin(*SECTORS))
    edge = edges(named, "sector")
    suppliers = edge.groupBy("sector", F.col("importer").alias("country")).agg(
        F.sum("weight").alias("sector_imports"),
        F.sum(F.col("weight") ** 2).alias("squares"),
        F.count_if(F.col("weight") > 0).alias("supplier_count"),
        F.min_by("exporter", F.struct(-F.col("weight"), "exporter")).alias("top_supplier"),
        F.max("weight").alias("top_weight"),
    )
    pool = edge.where("weight > 0").groupBy("sector").agg(F.count_distinct("exporter").alias("supplier_pool"))
    all_imports = F.sum("sector_imports").over(Window.partitionBy("country"))
    out = suppliers.withColumn("country_imports", all_imports).join(F.broadcast(pool), "sector")
    hhi = F.when(F.col("sector_imports") > 0, F.col("squares") / F.col("sector_imports") ** 2).otherwise(0.0)
    reliance = F.when(F.col("country_imports") > 0, F.col("sector_imports") / F.col("country_imports")).otherwise(0.0)
    return out.select(
        "sector",
        "country",
        "sector_imports",
        hhi.alias("supplier_hhi"),
        reliance.alias("reliance"),
        (0.6 * hhi + 0.4 * reliance).alias("fragility"),
        "supplier_count",
        "top_supplier",
        F.when(F.col("sector_imports") > 0, F.col("top_weight") / F.col("sector_imports")).otherwise(0.0).alias("top_share"),
        "supplier_pool",
    )


def supply_ranking(flows: DataFrame) -> DataFrame:
    """Sectors by concentration of their exporters: count, HHI, top-3 share, dominant supplier."""
    exports = flows.where(F.col("sector").isin(*SECTORS)).groupBy("sector", "exporter").agg(
        F.sum("trade_value").alias("x")
    )
    rn = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("x"), "exporter"))
    return (
        exports.withColumn("rn", rn)
        .groupBy("sector")
        .agg(
            F.count_if(F.col("x") > 0).alias("exporter_count"),
            (F.sum(F.col("x") ** 2) / F.sum("x") ** 2).alias("supply_hhi"),
            (F.sum(F.when(F.col("rn") <= 3, F.col("x"))) / F.sum("x")).alias("top3_share"),
            F.max(F.when(F.col("rn") == 1, F.col("exporter"))).alias("dominant_supplier"),
        )
    )


def shock(
    edge: DataFrame, country: str, severity: float = 0.5, steps: int = 3, propagation: float = 0.7
) -> DataFrame:
    """Impact of a cut in one country's exports as it spreads through its customers.

    In each step a country's impact is the share of its imports that its
    suppliers' reductions take away, or what it was if larger; its own exports
    shrink by that impact times ``propagation``. Impacts come before the
    step's new reductions, so the last ones never feed back. The origin keeps
    its severity; countries without imports stay at 0. The state between two
    steps is one row, a map over the countries (a few hundred), so each step
    reads it once and the plan grows by one aggregation a step.
    """

    def clamp(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    def of(name: str, field: str) -> Column:
        return F.coalesce(F.try_element_at("state", F.col(name))[field], F.lit(0.0))

    origin = F.create_map(
        F.lit(country), F.struct(F.lit(float(severity)).alias("impact"), F.lit(float(severity)).alias("reduction"))
    )
    state = edge.sparkSession.range(1).select(origin.alias("state"))
    for _ in range(steps):
        hit = (
            edge.where(F.col("importer") != country)
            .crossJoin(F.broadcast(state))
            .select(
                "importer",
                "weight",
                (F.col("weight") * of("exporter", "reduction")).alias("lost"),
                of("importer", "impact").alias("impact"),
                of("importer", "reduction").alias("reduction"),
            )
            .groupBy("importer")
            .agg(
                F.greatest(F.max("impact"), clamp(F.sum("lost") / F.sum("weight"))).alias("impact"),
                F.max("reduction").alias("reduction"),
            )
        )
        reduced = F.greatest("reduction", clamp(F.col("impact") * propagation)).alias("reduction")
        entry = F.struct("importer", F.struct("impact", reduced))
        state = hit.agg(F.map_concat(origin, F.map_from_entries(F.collect_list(entry))).alias("state"))
    return (
        country_features(edge)
        .select("country", "imports")
        .crossJoin(F.broadcast(state))
        .select("country", "imports", of("country", "impact").alias("impact"), of("country", "reduction").alias("reduction"))
    )


def top_edges(edge: DataFrame, n: int) -> DataFrame:
    return edge.orderBy(F.desc("weight"), "exporter", "importer").limit(n)


def connectivity(edge: DataFrame) -> DataFrame:
    """Degree, its share of the largest degree, and the graph's density, per country."""
    sides = edge.select(F.explode(F.array("exporter", "importer")).alias("country"))
    degree = sides.groupBy("country").agg(F.count("*").alias("degree"))
    whole = degree.agg(F.max("degree").alias("max_degree"), F.count("*").alias("n")).crossJoin(
        edge.agg(F.count("*").alias("n_edges"))
    )
    density = F.when(F.col("n") > 1, F.col("n_edges") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return degree.join(F.broadcast(whole)).select(
        "country",
        "degree",
        (F.col("degree") / F.col("max_degree")).alias("degree_ratio"),
        density.alias("density"),
        ((F.col("degree") / F.col("max_degree") + density) / 2).alias("connectivity"),
    )


def newest_metadata(metadata: DataFrame, year: int, max_backfill: int = 5) -> DataFrame:
    """Each country's newest known indicators of the last years up to ``year``, column by column."""
    near = metadata.where(F.col("year").between(year - max_backfill, year))
    values = [c for c in metadata.columns if c not in ("country", "year")]
    return near.groupBy("country").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in values),
        (F.lit(year) - F.max("year")).alias("lag_years"),
    )


def exposure_band(share: Column) -> Column:
    return (
        F.when(share.isNull() | F.isnan(share), "economic exposure unknown")
        .when(share >= 0.10, "severe economic exposure")
        .when(share >= 0.03, "material economic exposure")
        .when(share >= 0.01, "moderate economic exposure")
        .otherwise("limited economic exposure")
    )


def inter_bloc_flows(edge: DataFrame, blocs: DataFrame) -> DataFrame:
    """Trade between blocs, given (country, bloc)."""
    a = blocs.select(F.col("country").alias("exporter"), F.col("bloc").alias("from_bloc"))
    b = blocs.select(F.col("country").alias("importer"), F.col("bloc").alias("to_bloc"))
    return (
        edge.join(a, "exporter").join(b, "importer").groupBy("from_bloc", "to_bloc").agg(F.sum("weight").alias("flow"))
    )


def bloc_evolution(blocs: DataFrame) -> DataFrame:
    """Each country's bloc per year, the one of the year seen before, and if it switched."""
    before = F.lag("bloc").over(Window.partitionBy("country").orderBy("year"))
    return blocs.withColumn("previous_bloc", before).withColumn(
        "switched", F.coalesce(F.col("bloc") != F.col("previous_bloc"), F.lit(False))
    )


def linear_trend(series: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """Least-squares line per key: slope, intercept, R2, population residual deviation, points."""
    return series.groupBy(*keys).agg(
        F.regr_slope(y, t).alias("slope"),
        F.regr_intercept(y, t).alias("intercept"),
        F.regr_r2(y, t).alias("r2"),
        F.sqrt(
            F.greatest(F.lit(0.0), F.regr_syy(y, t) * (1 - F.regr_r2(y, t)) / F.regr_count(y, t))
        ).alias("residual_std"),
        F.regr_count(y, t).alias("n"),
        F.max(t).alias("last_t"),
    )
