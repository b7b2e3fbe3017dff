"""Yearly updates of a panel as one resumable stream: validate, look for drift, step the filters, append, log.

Each update writes only its own rows, under its version (the batch's number):

* ``rows/version=k``: its rows; a key's row of the greatest accepted version counts, so corrections win;
* ``states/version=k``: the filter's states it added;
* ``log/version=k``: one row that says what was found, written last. An update without it has not happened.

A batch that is run again after a loss overwrites its own folders and reads only
versions before its own, so a stream that was killed at any place goes on to the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geolith.operators.influence import psi

# Limits of validation and drift.
MIN_COUNTRIES, MISSING_COLUMNS, LOW_OVERLAP, MISSING_SHARE = 50, 5, 0.7, 0.5
DRIFTED_SHARE = 0.3
BELOW, ABOVE = 0.1, 10

STATES = "iso3 string, period long, value double, state double, variance double, innovation double, version long"
STATES_FIELDS = [field.split()[0] for field in STATES.split(", ")[:-1]]
LOG = (
    "status string, issues array<string>, warnings array<string>, n_rows long, n_countries long, overlap double, "
    "psi map<string,double>, shifts map<string,double>, n_drifted int, recommendation string, version long"
)


def _correlation(a: str, b: str) -> Column:
    """Correlation of the rows that have both; null where either does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


@dataclass(frozen=True)
class Updates:
    """Where the tables lie (a folder that driver and executors share), which columns count, and the filter's noise."""

    folder: str
    columns: Sequence[str]
    score: str
    q: float
    r: float
    min_countries: int = MIN_COUNTRIES

    def _read(self, spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
        """A table of all versions written so far; empty before the first."""
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def log(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "log", LOG)

    def _accepted(self, spark: SparkSession, name: str, schema: StructType | str, before: int | None) -> DataFrame:
        """Rows of accepted versions (of those before one)."""
        versions = self.log(spark).where("status = 'success'").select("version")
        if before is not None:
            versions = versions.where(F.col("version") < before)
        return self._read(spark, name, schema).join(F.broadcast(versions), "version", "left_semi")

    def rows(self, spark: SparkSession, schema: StructType, before: int | None = None) -> DataFrame:
        """The panel: each country and period once, as last sent."""
        fields = [f.name for f in schema.fields]
        stored = StructType([*schema.fields, StructField("version", LongType())])
        whole = F.struct("version", *(c for c in fields if c not in ("iso3", "period")))
        last = self._accepted(spark, "rows", stored, before).groupBy("iso3", "period").agg(F.max(whole).alias("last"))
        return last.select(*(c if c in ("iso3", "period") else f"last.{c}" for c in fields))

    def states(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._accepted(spark, "states", STATES, before).select("version", *STATES_FIELDS)

    def _validated(self, reference: DataFrame, new: DataFrame) -> dict:
        """Counts and findings of an update, from one pass over it and one over the reference."""
        cols = list(self.columns)
        ends = [F.struct(F.min(c), F.max(c), F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in cols]
        now = new.agg(F.count("*").alias("n"), F.countDistinct("iso3").alias("countries"), *ends).first()
        usual = reference.agg(
            F.countDistinct("iso3").alias("countries"),
            *(F.percentile_approx(c, [0.01, 0.99], 10_000).alias(c) for c in cols),
        ).first()
        met = new.select("iso3").distinct().join(reference.select("iso3").distinct(), "iso3", "left_semi").count()
        overlap = met / max(usual.countries, 1)
        issues, warnings = [], []
        if now.countries < self.min_countries:
            issues.append(f"too few countries: {now.countries}")
        absent = [c for c in cols if now[c][2] in (None, 1.0)]
        if absent:
            (issues if len(absent) > MISSING_COLUMNS else warnings).append(f"missing columns: {', '.join(absent)}")
        if usual.countries and overlap < LOW_OVERLAP:
            warnings.append(f"low overlap of countries: {overlap:.2f}")
        for c in cols:
            low, high, missing = now[c]
            if c not in absent and missing > MISSING_SHARE:
                warnings.append(f"{c}: {missing:.2f} missing")
            if low is not None and usual[c] and (low < usual[c][0] * BELOW or high > usual[c][1] * ABOVE):
                warnings.append(f"{c}: extreme values")
        known = [c for c in cols if c not in absent and usual[c]]
        return {"known": known, "issues": issues, "warnings": warnings, "n_rows": now.n, "n_countries": now.countries, "overlap": overlap}

    def _drift(self, reference: DataFrame, new: DataFrame, columns: list[str]) -> dict:
        """Stability index of each of ``columns``, how far its correlation with the score moved, and what they advise."""
        found = reduce(DataFrame.unionByName, (psi(reference, new, c) for c in columns)).collect()
        indexes = {r.indicator: r.psi for r in found if r.psi is not None}
        related = [_correlation(c, self.score).alias(c) for c in columns]
        was, now = reference.agg(*related).first(), new.agg(*related).first()
        shifts = {c: abs(was[c] - now[c]) for c in columns if was[c] is not None and now[c] is not None}
        drifted = sum(r.drift for r in found if r.psi is not None)
        full = drifted > len(self.columns) * DRIFTED_SHARE
        return {"psi": indexes, "shifts": shifts, "n_drifted": drifted, "recommendation": "full_retrain" if full else "incremental_update"}

    def _stepped(self, new: DataFrame, states: DataFrame) -> DataFrame:
        """States after the update's values, in order of period; periods not after a country's last one are late and step nothing."""
        last = states.groupBy("iso3").agg(F.max_by(F.struct("period", "state", "variance"), "period").alias("last"))
        values = F.struct(F.col("period").cast("long").alias("period"), F.col(self.score).cast("double").alias("value"))
        told = new.join(last, "iso3", "left").where(F.col("last").isNull() | (F.col("period") > F.col("last.period")))
        series = told.groupBy("iso3").agg(F.sort_array(F.collect_list(values)).alias("series"), F.any_value("last").alias("last"))
        out = "array<struct<period:bigint,value:double,state:double,variance:double,innovation:double>>"
        start = F.struct(F.col("last.state").alias("x"), F.col("last.variance").alias("p"), F.array().cast(out).alias("out"))

        def step(acc: Column, v: Column) -> Column:
            ahead, y = acc["p"] + self.q, v["value"]
            gain = ahead / (ahead + self.r)
            x = F.when(acc["x"].isNull(), y).when(y.isNull(), acc["x"]).otherwise(acc["x"] + gain * (y - acc["x"]))
            p = F.when(x.isNull(), F.lit(None)).when(acc["x"].isNull(), self.r).when(y.isNull(), ahead).otherwise((1 - gain) * ahead)
            row = F.struct(v["period"], y.alias("value"), x.alias("state"), p.alias("variance"), (y - acc["x"]).alias("innovation"))
            return F.struct(x.alias("x"), p.alias("p"), F.when(x.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"))

        stepped = F.explode(F.aggregate("series", start, step, lambda acc: acc["out"]))
        return series.select("iso3", stepped.alias("s")).select("iso3", "s.*")

    def apply(self, batch: DataFrame, version: int) -> None:
        """One update, from a batch of the stream. A repeated key within it counts once, with its greatest row."""
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("iso3", "period")]
        once = batch.groupBy("iso3", "period").agg(F.max(F.struct(*rest)).alias("r")).select("iso3", "period", "r.*")
        path = f"{self.folder}/rows/version={version}"
        once.write.mode("overwrite").parquet(path)
        new = spark.read.schema(batch.schema).parquet(path)
        reference = self.rows(spark, batch.schema, version)
        report = self._validated(reference, new)
        report |= {"psi": {}, "shifts": {}, "n_drifted": 0, "recommendation": "incremental_update"}
        report["status"] = "failed_validation" if report["issues"] else "success"
        if not report["issues"]:
            if report["known"]:  # columns with values in the update and before it; the first update has none
                report |= self._drift(reference, new, report["known"])
            stepped = self._stepped(new, self.states(spark, version))
            stepped.write.mode("overwrite").parquet(f"{self.folder}/states/version={version}")
        fields = StructType.fromDDL(LOG).fields[:-1]
        row = spark.createDataFrame([tuple(report[f.name] for f in fields)], StructType(fields))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/version={version}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Applies all updates that have arrived; the checkpoint remembers which are done."""
        query = (
            stream.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
