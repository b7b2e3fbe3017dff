import pytest
from pyspark.sql import functions as F

from geolith import service
from geolith.operators import fusion
from geolith.sources.views import trade_flows


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    return trade_flows(spark, sf_dir).cache()


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        ({"query_type": "risk", "yr": 2000}, "unknown fields: yr"),
        ({"query_type": "risk", "limit": 0}, "limit is out of range"),
        ({"query_type": "risk", "limit": "5"}, "limit must be of type int"),
        ({"query_type": "war"}, "query_type must be one of"),
        ({"query_type": "shock", "country": "NATION_3"}, "shock queries need severity"),
        ({"query_type": "risk", "sector": "gold"}, "sector must be one of"),
        ({}, "query_type is needed"),
    ],
)
def test_bad_requests(bad, message):
    with pytest.raises(ValueError, match=message):
        service.checked(bad)


@pytest.mark.parametrize("kind", service.CHOICES["query_type"])
def test_every_kind_keeps_the_contract(spark, flows, kind):
    country = flows.agg(F.min("exporter")).first()[0]
    more = {"shock": {"country": country, "severity": 1}, "forecast": {"country": country}}.get(kind, {})
    found = service.answer(flows, {"query_type": kind, "limit": 3, **more})
    rows = found.collect()
    assert found.columns == ["entity_name", "claim", "score", "confidence", "reason", "evidence"]
    assert len(rows) <= 3 and (rows or kind == "leverage")
    assert all(r.entity_name and r.claim and 0 <= r.confidence <= 1 and r.evidence.startswith("{") for r in rows)
    agent = found.withColumn("agent", F.lit("trade"))
    assert fusion.invalid_insights(agent).count() == 0


def test_one_country_and_an_unknown_one(flows):
    country = service.answer(flows, {"query_type": "fragility", "limit": 1}).first().entity_name
    for kind in ("risk", "blocs", "fragility"):
        rows = service.answer(flows, {"query_type": kind, "country": country}).collect()
        assert {r.entity_name for r in rows} == {country}
    with pytest.raises(ValueError, match="not present"):
        service.answer(flows, {"query_type": "risk", "country": "Atlantis"})
    assert service.capabilities()["choices"]["sector"][0] == "all"
