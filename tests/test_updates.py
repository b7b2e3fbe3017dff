"""Yearly updates: stopped at any place and run again, equal to one run without a stop."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from geolith.streaming import events as stream
from geolith.streaming.updates import Updates

SCHEMA = "iso3 string, period int, a double, b double, score double"


def send(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/sent/{name}")


def sent_years(spark, folder, short=False):
    def year(n, shift=0.0):
        return [(f"C{c}", n, float(c + n) if c % 3 else None, float(c * n % 7), c + n / 2 + shift if c != 2 or n > 1 else None) for c in range(8)]

    send(spark, folder, year(1), "1")
    send(spark, folder, year(2) + year(2)[:2] + [("C0", 3, 1.0, 1.0, 2.0)], "2")
    if short:
        return
    send(spark, folder, year(9)[:3], "3-too-few")
    send(spark, folder, [(i, p, 1e6 + p, -50.0, s) for i, p, _, _, s in year(4)], "4-drift")
    send(spark, folder, year(1, 100.0), "5-correction")


def tables(spark, updates):
    schema = spark.createDataFrame([], SCHEMA).schema
    return [
        sorted(map(str, df.collect()))
        for df in (updates.rows(spark, schema), updates.states(spark), updates.log(spark).select("version", "status", "n_drifted", "recommendation"))
    ]


def started(spark, folder):
    live = stream.read_events(spark, f"{folder}/sent/*", spark.createDataFrame([], SCHEMA).schema, 1)
    return Updates(str(folder), ["a", "b"], "score", 0.5, 2.0, min_countries=5), live


def test_updates_log_correct_and_step(spark, tmp_path):
    sent_years(spark, tmp_path)
    updates, live = started(spark, tmp_path)
    assert updates.log(spark).count() == updates.states(spark).count() == 0
    updates.run(live, f"{tmp_path}/cp")
    log = {r.version: r for r in updates.log(spark).collect()}
    assert [log[v].status for v in range(5)] == ["success", "success", "failed_validation", "success", "success"]
    assert log[2].issues == ["too few countries: 3"] and log[1].n_rows == 9
    assert log[3].n_drifted == 2 and log[3].recommendation == "full_retrain" and "a: extreme values" in log[3].warnings
    assert log[0].recommendation == "incremental_update"
    rows = {(r.iso3, r.period): r.score for r in updates.rows(spark, spark.createDataFrame([], SCHEMA).schema).collect()}
    assert len(rows) == 25 and rows["C1", 1] == 101.5 and rows["C0", 3] == 2.0 and ("C0", 9) not in rows
    states = {(r.iso3, r.period): (r.state, r.variance) for r in updates.states(spark).collect()}
    assert ("C2", 1) not in states and len(states) == 24  # no value yet, so no state; corrections step nothing
    x, p = 1.5, 2.0
    for y, period in ((2.0, 2), (3.0, 4)):
        gain = (p + 0.5) / (p + 2.5)
        x, p = x + gain * (y - x), (1 - gain) * (p + 0.5)
        assert states["C1", period] == pytest.approx((x, p))


@pytest.mark.parametrize("lost", range(3))
def test_a_killed_update_is_made_up_for(spark, tmp_path, monkeypatch, lost):
    """The write of rows, states or log of the second update fails once; nothing is lost or doubled."""
    sent_years(spark, tmp_path / "whole", True)
    sent_years(spark, tmp_path / "killed", True)
    whole, live = started(spark, tmp_path / "whole")
    whole.run(live, f"{tmp_path}/cp-whole")
    killed, live = started(spark, tmp_path / "killed")
    table, written = ("rows", "states", "log")[lost], DataFrameWriter.parquet

    def failing(self, path, *args, **kwargs):
        if f"{table}/version=1" in path:
            raise OSError("lost")
        return written(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception, match="lost"):
        killed.run(live, f"{tmp_path}/cp-killed")
    assert killed.log(spark).select(F.max("version")).first()[0] == 0
    monkeypatch.setattr(DataFrameWriter, "parquet", written)
    killed.run(live, f"{tmp_path}/cp-killed")
    assert tables(spark, killed) == tables(spark, whole)
