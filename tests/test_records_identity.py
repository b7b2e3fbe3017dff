import hashlib

from pyspark.sql import functions as F

from geolith.operators import identity, records

NAMES = [(2, "USA", "United States", "america"), (365, "RUS", "Russia", None), (20, "CAN", "Canada", None)]


def names(spark):
    return spark.createDataFrame(NAMES, "code int, iso3 string, name string, alias string")


def test_years(spark):
    df = spark.createDataFrame([("2001",), ("2001.0",), ("1999-05-04",), ("04/05/1998",), ("12",), ("nan",), (None,)], "x string")
    assert [r.y for r in df.select(records.year_of(F.col("x")).alias("y")).collect()] == [2001, 2001, 1999, 1998, None, None, None]
    assert df.select(records.year_of_serial(F.lit(36526)).alias("y")).first().y == 2000


def test_parties(spark):
    rows = [("2", "Government of United States"), ("900000, 365, 2", "x"), ("rus", None), (None, "America"), ("REBEL GROUP", None), (None, None)]
    found = records.resolve_parties(spark.createDataFrame(rows, "c string, l string"), "c", "l", names(spark), "p")
    by = {(r.c, r.l): (r.p_code, r.p) for r in found.collect()}
    code = 10000 + int(hashlib.md5(b"rebel group").hexdigest()[:8], 16) % 900000
    assert by == {
        rows[0]: (2, "United States"), rows[1]: (365, "Russia"), rows[2]: (365, "Russia"), rows[3]: (2, "United States"),
        rows[4]: (code, "Rebel Group"), rows[5]: (None, None),
    }


def test_master_records_and_issues(spark):
    raw = spark.createDataFrame(
        [("2", "USA side", "365", "Russia side", "1999", "2", "17.0", "7", "70"), ("2", "a", "20", "b", "1980", "1", "1", "8", None)],
        "gwno_a string, side_a string, gwno_b string, side_b string, year string, intensity_level string, bd_best string, dyad_id string, conflict_id string",
    )
    found = records.master_records(raw, "ucdp-dyadic", names(spark))
    r = found.first()
    assert found.count() == 1 and (r.country_a, r.country_b, r.deaths, r.intensity) == ("United States", "Russia", 17.0, 2.0)
    assert r.relationship_type == "conflict" and '"bd_best":"17.0"' in r.raw_row_json
    flags = spark.createDataFrame([("7", "70", "1999", None, "1", "0"), ("7", "70", "1985", "x", "1", "1")], "dyad_id string, conflict_id string, year string, ethnicity_1 string, `7101` string, `99` string")
    issues = records.issue_flags(flags, {"7101": "Ideology"})
    assert [r.issues for r in issues.collect()] == [["Ideology"]]
    assert records.merge_issues(found, issues).first().issue == "Ideology"
    peace = records.master_records(spark.createDataFrame([("2", "2000", "Accord")], "gwno string, year string, pa_name string"), "ucdp-peace-agreements", names(spark)).first()
    assert (peace.relationship_type, peace.issue, peace.conflict_name, peace.country_b) == ("peace_partner", "peace agreement", "Accord", None)
    assert records.sovereign(found, "country_a_code").count() == 1


def test_scores_and_actors(spark):
    df = spark.createDataFrame([(60.0, 50.0, 70.0, 80.0, 90.0), (60.0, 50.0, 70.0, 55.0, 10.0), (2.0, 0.0, 9.0, 0.0, 10.0), (50.0, 40.0, 60.0, None, 10.0)], "score double, ci_lower double, ci_upper double, freedom double, wealth_score double")
    out = [(r.governance_penalty, r.adjusted_score, r.adj_ci_lower) for r in records.adjusted_scores(df).collect()]
    assert out == [(0.0, 63.0, 50.0), (4.0, 56.0, 48.0), (15.0, 0.0, 0.0), (0.0, 50.0, 40.0)]
    actors = spark.createDataFrame([("Peru", "gov"), ("Peru", None), ("nan", "MIL"), (None, "")], "c string, t string")
    assert [r.d for r in actors.select(records.describe_actor(F.col("c"), F.col("t")).alias("d")).collect()] == [
        "a government source in Peru", "an unnamed party from Peru", "a military source", "an unidentified party",
    ]


def test_identity(spark):
    rows = [(699, "India", "IN", "IND", None), (156, "China", "CN", "CHN", ["prc"]), (344, "China, Hong Kong SAR", "HK", "HKG", None)]
    countries = spark.createDataFrame(rows, "country_code int, country_name string, country_iso2 string, country_iso3 string, aliases array<string>")
    asked = spark.createDataFrame([("699",), ("chn",), ("PRC",), ("india ",), ("indai",), ("hong kong",)], "q string")
    found = {r.q: r.iso3 for r in identity.resolve(asked, countries, "q").collect()}
    assert found == {"699": "IND", "chn": "CHN", "PRC": "CHN", "india ": "IND", "indai": None, "hong kong": None}
    missed = asked.where("q IN ('indai', 'hong kong')")
    assert {r.q: r.suggestions for r in identity.suggest(missed, countries, "q").collect()} == {"indai": "India", "hong kong": "China, Hong Kong SAR"}
