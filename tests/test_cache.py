from pyspark.sql import functions as F

from geolith.operators import graph, trade
from geolith.plans import cache
from geolith.sources.views import trade_flows


def test_cached_tables_equal_live_ones_and_are_pruned(spark, sf_dir, tmp_path):
    flows = trade_flows(spark, sf_dir).where("year IN (1999, 2000)").cache()
    folder = str(tmp_path / "cache")
    said = cache.build(flows, folder)
    assert '"1999"' in said and '"2000"' in said
    edges = cache.edges_of(spark, folder, 2000, "all")
    live = trade.edges(flows.where("year = 2000"))
    assert edges.count() == live.count()
    assert abs(edges.agg(F.sum("trade_value")).first()[0] - live.agg(F.sum("weight")).first()[0]) < 1e-3
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "sector" in plan.split("PartitionFilters")[1][:200]
    cached = {r.country: round(r.pagerank, 9) for r in cache.centrality_of(spark, folder, 2000).collect()}
    assert cached == {r.country: round(r.pagerank, 9) for r in graph.centrality(live).collect()}
    country = edges.agg(F.min("exporter")).first()[0]
    assert [r.year for r in cache.history(spark, folder, country).collect()] == [1999, 2000]
    assert cache.quality_of(spark, folder).agg(F.sum("row_count")).first()[0] == flows.count()


def test_rebuilding_one_year_keeps_the_others(spark, sf_dir, tmp_path):
    flows = trade_flows(spark, sf_dir).where("year IN (1999, 2000)").cache()
    folder = str(tmp_path / "cache")
    cache.build(flows, folder)
    before = cache.edges_of(spark, folder, 1999).count()
    cache.build(flows.where("sector = 'agriculture'"), folder, [2000])
    assert cache.edges_of(spark, folder, 1999).count() == before
    assert {r.sector for r in cache.quality_of(spark, folder, 2000).collect()} == {"agriculture"}
