"""Event operators on values where engines round apart."""

import duckdb

from geolith.plans.events import EVENTS_ACTOR_EXPLORER_SQL, events_actor_explorer


def test_explorer_rounds_tenths_as_sql_does(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    path = f"{tmp_path}/events.parquet"
    # Every value that lies half-way between two tenths, with a neighbour on each side; all of one type and pair.
    con.sql(
        "COPY (SELECT 200 * row_number() OVER (ORDER BY (i * 7919) % 1201, d) AS event_id, TIMESTAMP '2020-01-01' AS ts, 3 AS user_id, 'view' AS event_type, "
        "(125 * i + d) / 100.0::DOUBLE AS value, '{\"k\": 4}' AS props FROM range(400) a(i), (VALUES (-1), (0), (1)) b(d) WHERE 125 * i + d >= 0) "
        f"TO '{path}' (FORMAT parquet)"
    )
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    expected = sorted(r[0] for r in con.sql(f"SELECT event_id FROM ({EVENTS_ACTOR_EXPLORER_SQL})").fetchall())
    assert sorted(r.event_id for r in events_actor_explorer(spark, str(tmp_path)).collect()) == expected
