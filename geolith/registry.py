"""Every registered query of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolith.plans import briefing, events, influence, learning, policy, records, sources, text, trade

PLANS = (trade, policy, events, influence, text, briefing, learning, records, sources)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in PLANS for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in PLANS for k, v in m.ORACLES.items()}
