"""Trade questions as one call: a checked request in, insights out.

``answer(flows, request)`` takes flows (exporter, importer, year, sector, trade_value) and a
request of named fields, and returns a DataFrame of insights: entity_name, claim, score,
confidence, reason and evidence (JSON). ``capabilities()`` says what may be asked.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.operators import forecast, fusion, graph, trade

#: Field: (type, least, most, default); None stands for no bound or no default.
FIELDS: dict[str, tuple] = {
    "query_type": (str, None, None, None),
    "country": (str, None, 64, None),
    "year": (int, 1900, 2100, None),
    "severity": (float, 0.0, 1.0, None),
    "limit": (int, 1, 50, 5),
    "sector": (str, None, None, "all"),
    "metric": (str, None, None, "exports"),
    "forecast_model": (str, None, None, "auto"),
    "periods": (int, 1, 10, 3),
    "steps": (int, 1, 10, 3),
    "top_n_partners": (int, 1, 10, 3),
    "propagation_factor": (float, 0.0, 1.0, 0.7),
}
CHOICES = {
    "query_type": ("risk", "shock", "leverage", "blocs", "fragility", "forecast"),
    "sector": ("all", *trade.SECTORS),
    "metric": ("imports", "exports"),
    "forecast_model": ("auto", *forecast.METHODS),
}
NEEDS = {"shock": ("country", "severity"), "forecast": ("country",)}
#: Trade below which a pair does not enter the network's ranking of leverage.
NETWORK_FLOOR = 1_000_000.0


def checked(request: dict[str, Any]) -> dict[str, Any]:
    """The request with defaults; unknown fields, wrong types, values out of range are errors."""
    unknown = sorted(set(request) - set(FIELDS))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    out = {}
    for name, (kind, least, most, default) in FIELDS.items():
        value = request.get(name, default)
        if value is None:
            continue
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kind) or isinstance(value, bool):
            raise ValueError(f"{name} must be of type {kind.__name__}")
        size = len(value) if kind is str else value
        if least is not None and size < least or most is not None and size > most:
            raise ValueError(f"{name} is out of range")
        if name in CHOICES and value not in CHOICES[name]:
            raise ValueError(f"{name} must be one of {', '.join(CHOICES[name])}")
        out[name] = value
    if "query_type" not in out:
        raise ValueError("query_type is needed")
    for name in NEEDS.get(out["query_type"], ()):
        if name not in out:
            raise ValueError(f"{out['query_type']} queries need {name}")
    return out


def _insights(rows: DataFrame, name: str, claim: Column, score: Column, confidence: Column, reason: Column, *evidence: str) -> DataFrame:
    return rows.select(
        F.col(name).alias("entity_name"),
        claim.alias("claim"),
        score.cast("double").alias("score"),
        fusion.clamp01(confidence).alias("confidence"),
        reason.alias("reason"),
        F.to_json(F.struct(*evidence)).alias("evidence"),
    )


def _text(form: str, *columns) -> Column:
    return F.format_string(form, *(F.col(c) if isinstance(c, str) else c for c in columns))


def _confidence(edge: DataFrame, flows: DataFrame, propagation: float) -> DataFrame:
    """Per country: completeness of the data, connectivity and propagation, their mean and the limiting one."""
    complete = flows.agg(
        F.avg((F.col("trade_value").isNotNull() & F.col("exporter").isNotNull() & F.col("importer").isNotNull()).cast("int")).alias("completeness")
    )
    parts = trade.connectivity(edge).select("country", "connectivity").crossJoin(F.broadcast(complete))
    assessed = fusion.assess_confidence(parts.withColumn("propagation", F.lit(propagation)), ["completeness", "connectivity", "propagation"])
    return assessed.select("country", "confidence", F.concat(F.lit("limited by "), "limiting").alias("reason"))


def _one_or_top(rows: DataFrame, q: dict[str, Any], order: str, name: str = "country") -> DataFrame:
    """A country's row, or the first ones by falling ``order``; a country that is absent is an error."""
    if "country" not in q:
        return rows.orderBy(F.desc(order), name).limit(q["limit"])
    mine = rows.where(F.col(name) == q["country"])
    if mine.limit(1).count() == 0:
        raise ValueError(f"{q['country']} is not present in the data")
    return mine


def _risk(flows: DataFrame, edge: DataFrame, q: dict[str, Any]) -> DataFrame:
    rows = graph.risk(edge).drop("hhi").join(trade.concentration(edge, top_n=q["top_n_partners"]), "country")
    found = _one_or_top(rows.join(_confidence(edge, flows, 1.0), "country"), q, "risk_score")
    claim = _text("%s has risk score %.3f; HHI %.3f over %d partners", "country", "risk_score", "hhi", "partner_count")
    return _insights(found, "country", claim, F.col("risk_score"), F.col("confidence"), F.col("reason"), "pagerank", "betweenness", "hhi", "trade_concentration", "partner_count", "top_partners")


def _shock(flows: DataFrame, edge: DataFrame, q: dict[str, Any]) -> DataFrame:
    _one_or_top(trade.country_features(edge), q, "exports")
    rows = trade.shock(edge, q["country"], q["severity"], q["steps"], q["propagation_factor"]).where(F.col("country") != q["country"])
    found = rows.join(_confidence(edge, flows, 1.0 / q["steps"]), "country").orderBy(F.desc("impact"), "country").limit(q["limit"])
    claim = _text("%s loses %.1f%% of its supply", "country", F.col("impact") * 100)
    return _insights(found, "country", claim, F.col("impact"), F.col("confidence"), F.col("reason"), "imports", "impact", "reduction")


def _leverage(flows: DataFrame, edge: DataFrame, q: dict[str, Any]) -> DataFrame:
    pairs = trade.leverage_pairs(edge, min_trade=0.0 if "country" in q else NETWORK_FLOOR)
    if "country" in q:
        pairs = trade.leverage_profile(pairs, q["country"], q["limit"])
    else:
        pairs = pairs.orderBy(F.desc("asymmetry"), "holder", "exposed").limit(q["limit"])
    sure = _confidence(edge, flows, 1.0).withColumnRenamed("country", "holder")
    claim = _text("%s depends on %s by %.1f%%, against %.1f%% the other way", "exposed", "holder", F.col("exposed_dependence") * 100, F.col("holder_dependence") * 100)
    return _insights(pairs.join(sure, "holder"), "holder", claim, F.col("asymmetry"), F.col("confidence"), F.col("reason"), "exposed", "bilateral_trade", "exposed_dependence", "holder_dependence")


def _blocs(flows: DataFrame, edge: DataFrame, q: dict[str, Any]) -> DataFrame:
    blocs = graph.trade_blocs(edge)
    if "country" in q:
        found = _one_or_top(blocs.join(_confidence(edge, flows, 1.0), "country"), q, "strength")
        claim = _text("%s trades in the bloc of %s, %.1f%% of it inside", "country", "bloc", F.col("internal_share") * 100)
        return _insights(found, "country", claim, F.col("internal_share"), F.col("confidence"), F.col("reason"), "bloc_id", "bloc", "strength", "modularity")
    sure = _confidence(edge, flows, 1.0).withColumnRenamed("country", "bloc")
    found = graph.bloc_summary(blocs).join(sure, "bloc").orderBy("bloc_id").limit(q["limit"])
    claim = _text("The bloc of %s has %d members", "bloc", "members")
    return _insights(found, "bloc", claim, F.col("mean_internal_share"), F.col("confidence"), F.col("reason"), "members", "member_list", "total_strength")


def _fragility(flows: DataFrame, edge: DataFrame, q: dict[str, Any]) -> DataFrame:
    rows = trade.of_sector(trade.sector_fragility(flows), q["sector"])
    found = _one_or_top(rows, q, "fragility")
    sure = 0.35 + 0.45 * F.least(F.lit(1.0), F.col("supplier_count") / 20) + 0.2 * F.least(F.lit(1.0), F.col("supplier_pool") / 100)
    claim = _text("%s has fragility %.3f in %s; first supplier %s", "country", "fragility", "sector", "top_supplier")
    bounded = F.greatest(F.lit(0.1), F.least(F.lit(0.95), sure))
    return _insights(found, "country", claim, F.col("fragility"), bounded, F.lit("breadth of suppliers"), "sector", "supplier_hhi", "reliance", "supplier_count", "top_share")


def _forecast(flows: DataFrame, q: dict[str, Any]) -> DataFrame:
    side = "exporter" if q["metric"] == "exports" else "importer"
    series = trade.of_sector(flows, q["sector"]).where(F.col(side) == q["country"]).groupBy(F.col(side).alias("country"), "year").agg(F.sum("trade_value").alias("y"))
    if series.limit(1).count() == 0:
        raise ValueError(f"{q['country']} is not present in the data")
    found = forecast.forecast(series, "country", "year", "y", q["periods"], q["forecast_model"])
    claim = _text("%s of %s are %s by the %s model", F.lit(q["metric"]), "country", "trend", "method")
    return _insights(found, "country", claim, F.col("forecast"), F.col("confidence"), F.coalesce(_text("rolling error %.3f", "mape"), F.lit("too few points to test")), "step", "forecast", "method")


def answer(flows: DataFrame, request: dict[str, Any]) -> DataFrame:
    """Insights for a request; see ``FIELDS``, ``CHOICES`` and ``NEEDS`` for what it may hold."""
    q = checked(request)
    if q["query_type"] == "forecast":
        return _forecast(flows, q)
    year = trade.of_year(flows, q.get("year"))
    if q["query_type"] == "fragility":
        return _fragility(year, None, q)
    some = trade.of_sector(year, q["sector"])
    work = {"risk": _risk, "shock": _shock, "leverage": _leverage, "blocs": _blocs}[q["query_type"]]
    return work(some, trade.edges(some), q)


def capabilities() -> dict[str, Any]:
    return {
        "fields": {k: {"type": t.__name__, "least": a, "most": b, "default": d} for k, (t, a, b, d) in FIELDS.items()},
        "choices": {k: list(v) for k, v in CHOICES.items()},
        "needs": {k: list(v) for k, v in NEEDS.items()},
    }
